"""Text vectors and exact nearest-neighbour search."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from plumbline.functions.columns import col
from plumbline.functions.text import words
from plumbline.operators.stats import latest

#: Queries that travel with the tasks; more of them are shuffled to meet the memory.
QUERY_BLOCK = 2_000

#: Rows of either side in a block, blocks into which a smaller memory is cut, and partitions at most.
BLOCK, LEAST_BLOCKS, MOST_TASKS = 32_768, 32, 4_096

#: Rows looked at before there is a k-th distance, entries of a product held at once, pairs whose distances are computed at once.
FIRST_ROWS, TILE, PAIRS = 1_024, 1 << 20, 1 << 15

#: Bytes of text that a caller's function gets at once; a longer text comes alone.
TEXT_BLOCK = 1 << 20


def embed(
    df: DataFrame, text: str, fn: Callable[[pd.Series], list] | None = None, dimensions: int = 384
) -> DataFrame:
    """Adds `embedding`, from `fn` over parts of Arrow batches or by default from hashed word counts.

    `fn` gets texts of about TEXT_BLOCK bytes together, so its memory does not depend on the rows of a batch.
    """
    if fn is None:
        bag = df.withColumn("__words", F.coalesce(words(F.lower(col(text))), F.array().cast("array<string>")))
        hashed = HashingTF(numFeatures=dimensions, inputCol="__words", outputCol="__tf").transform(bag)
        unit = Normalizer(inputCol="__tf", outputCol="__unit").transform(hashed)
        return unit.withColumn("embedding", vector_to_array("__unit", "float32")).drop("__words", "__tf", "__unit")

    limit = TEXT_BLOCK

    @F.arrow_udf("array<float>")
    def call(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [_listed(fn(part.to_pandas())) for part in _text_parts(batch, limit)]
            yield pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.float32()))

    return df.withColumn("embedding", call(col(text)))


def _text_parts(texts: pa.Array, limit: int) -> Iterator[pa.Array]:
    """Slices of about `limit` bytes of text, one row at least."""
    # Earlier batches are gone; their memory would else stay with the worker.
    pa.default_memory_pool().release_unused()
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("int64"))
    start, done = 0, 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield texts.slice(start, stop - start)
        done, start = int(ends[stop - 1]), stop


def _listed(vectors: list) -> pa.Array:
    return pa.array([np.asarray(v, dtype="float32") for v in vectors], pa.list_(pa.float32()))


def store_memory(df: DataFrame, path: str, text: str = "text", fn=None, dimensions: int = 384) -> None:
    """Append texts with their vectors to a Parquet memory."""
    embed(df, text, fn, dimensions).write.mode("append").parquet(path)


def vector_matrix(column: pa.Array) -> np.ndarray:
    """Equally long vectors, from the values of the list column."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _distances(memory: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    # Row by row in the same order of operations, so equal vectors get equal distances.
    if metric == "l2":
        return np.sqrt(((memory - queries) ** 2).sum(axis=1))
    norms = np.sqrt((memory**2).sum(axis=1) * (queries**2).sum(axis=1))
    dots = (memory * queries).sum(axis=1)
    # Nine digits, so that vectors of one direction tie.
    return np.round(1.0 - np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0), 9)


class Nearest:
    """The k nearest so far of each of a block of queries, ties by id.

    Rows are offered in growing pieces. A product and one comparison with what the k-th distance so far
    asks for leave few pairs; only their distances are computed, row by row. Vectors with missing or
    infinite parts take no part.
    """

    def __init__(self, queries: np.ndarray, k: int, metric: str):
        self.queries, self.k, self.metric = queries, k, metric
        self.own = (queries**2).sum(axis=1)
        self.limit = np.full(len(queries), np.inf)
        self.can = np.isfinite(self.own)
        self.best = None
        size = np.sqrt(self.own)
        # What the product is compared by: l2 puts half the square of a row into a column more.
        self.left = queries if metric == "l2" else np.divide(queries, size[:, None], out=np.zeros_like(queries), where=size[:, None] > 0)

    def offer(self, ids: np.ndarray, memory: np.ndarray) -> None:
        sizes = (memory**2).sum(axis=1)
        fine = np.isfinite(sizes)
        if not fine.all():
            ids, memory, sizes = ids[fine], memory[fine], sizes[fine]
        at, step = 0, FIRST_ROWS if self.best is None else len(ids)
        while at < len(ids):
            self._look(ids[at : at + step], memory[at : at + step], sizes[at : at + step])
            at, step = at + step, 2 * step

    def _look(self, ids: np.ndarray, memory: np.ndarray, sizes: np.ndarray) -> None:
        if self.metric == "l2":
            right, half = memory.T, sizes / 2
        else:
            root = np.sqrt(sizes)
            right, half = np.divide(memory, root[:, None], out=np.zeros_like(memory), where=root[:, None] > 0).T, None
        largest, some, found = np.sqrt(sizes.max(initial=0)), min(self.k, len(ids)), []
        step = max(1, TILE // len(ids))
        for start in range(0, len(self.queries), step):
            part = slice(start, start + step)
            score, own, limit = self.left[part] @ right, self.own[part], self.limit[part].copy()
            if half is not None:
                score -= half
            new = np.flatnonzero(np.isinf(limit) & self.can[part])
            if len(new):
                kth = np.partition(score[new], len(ids) - some, axis=1)[:, len(ids) - some]
                limit[new] = np.sqrt(np.maximum(own[new] - 2 * kth, 0)) if half is not None else 1 - kth
            if half is not None:
                least = (own - (limit + 1e-6 * (np.sqrt(own) + largest + 1)) ** 2) / 2
            else:
                least = 1 - (limit + 1e-6)
            q, row = np.nonzero(score >= np.where(self.can[part], least, np.inf)[:, None])
            for i in range(0, len(q), PAIRS):
                one, other = q[i : i + PAIRS] + start, row[i : i + PAIRS]
                found.append(pd.DataFrame({"q": one, "mem_id": ids[other], "distance": _distances(memory[other], self.queries[one], self.metric)}))
                if len(found) > 8:
                    found = [self._first(found)]
        if found:
            self.best = self._first(found if self.best is None else [self.best, *found])
            full = self.best.groupby("q")["distance"].nth(self.k - 1)
            self.limit[self.best.loc[full.index, "q"]] = full.to_numpy()

    def _first(self, parts: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(parts, ignore_index=True).sort_values(["q", "distance", "mem_id"], ignore_index=True)
        return rows.groupby("q", sort=False).head(self.k).reset_index(drop=True)

    def rows(self, asked: pa.Array, kinds: list[pa.DataType]) -> pa.Table:
        """query_id, mem_id and distance of what was found."""
        if self.best is None:
            return pa.Table.from_arrays([pa.array([], t) for t in kinds], names=["query_id", "mem_id", "distance"])
        columns = [asked.take(pa.array(self.best["q"].to_numpy())), pa.array(self.best["mem_id"].to_numpy(), kinds[1]), pa.array(self.best["distance"].to_numpy(), kinds[2])]
        return pa.Table.from_arrays(columns, names=["query_id", "mem_id", "distance"])


def meet(k: int, metric: str):
    """Queries against memories, for two groups of rows that meet in a task."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        kinds = [a.schema.field("query_id").type, b.schema.field("mem_id").type, pa.float64()]
        if not a.num_rows or not b.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in kinds], names=["query_id", "mem_id", "distance"])
        nearest = Nearest(vector_matrix(a.column("embedding").combine_chunks()), k, metric)
        nearest.offer(b.column("mem_id").to_numpy(), vector_matrix(b.column("embedding").combine_chunks()))
        return nearest.rows(a.column("query_id").combine_chunks(), kinds)

    return run


def knn(
    memory: DataFrame, queries: DataFrame, k: int = 5, metric: str = "l2", query_block: int = QUERY_BLOCK
) -> DataFrame:
    """The k nearest memories `(mem_id, embedding)` of each query `(query_id, embedding)`, exactly.

    Up to `query_block` queries travel with the tasks, which read the memory where it lies and keep k
    rows per query. More queries meet the memory block by block: a task holds one block of each side, and
    no query reaches the driver. That is all pairs, so its work grows with queries times memories.
    """
    shape = [f for f in memory.schema.fields if f.name == "mem_id"][0].dataType.simpleString()
    query_shape = [f for f in queries.schema.fields if f.name == "query_id"][0].dataType.simpleString()
    schema = f"query_id {query_shape}, mem_id {shape}, distance double"
    memory = memory.select("mem_id", "embedding").filter("embedding is not null")
    queries = queries.select("query_id", "embedding").filter("embedding is not null")
    first = queries.limit(query_block + 1).toArrow()
    if not first.num_rows:
        return memory.sparkSession.createDataFrame([], schema)
    if first.num_rows <= query_block:
        near = memory.mapInArrow(_scan(first, k, metric), schema)
    else:
        near = _grid(memory, queries, k, metric, schema)
    return latest(near, ["query_id"], [F.col("distance"), F.col("mem_id")], k)


def _scan(asked: pa.Table, k: int, metric: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(vector_matrix(asked.column("embedding").combine_chunks()), k, metric)
        kinds = None
        for batch in batches:
            if batch.num_rows:
                kinds = [asked.schema.field("query_id").type, batch.schema.field(0).type, pa.float64()]
                nearest.offer(batch.column(0).to_numpy(zero_copy_only=False), vector_matrix(batch.column(1)))
        if kinds:
            yield from nearest.rows(asked.column("query_id").combine_chunks(), kinds).to_batches()

    return scan


def _grid(memory: DataFrame, queries: DataFrame, k: int, metric: str, schema: str) -> DataFrame:
    """Every block of queries meets every block of memories in a task of its own."""
    n, rows = queries.count(), memory.count()
    across = math.ceil(n / BLOCK)
    # Few rows are cut finer, so that there are tasks to share the work.
    down = max(math.ceil(rows / BLOCK), min(math.ceil(rows / FIRST_ROWS), LEAST_BLOCKS))
    tasks = min(4 * across * down, MOST_TASKS)
    a = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(across)).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("r"), "query_id", "embedding")
    b = memory.select(F.pmod(F.xxhash64("mem_id"), F.lit(down)).cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("q"), "mem_id", "embedding")
    asked, kept = (side.repartition(tasks, "q", "r").groupBy("q", "r") for side in (a, b))
    return asked.cogroup(kept).applyInArrow(meet(k, metric), schema)


def label_centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector per label; dimensions are averaged before they are put together."""
    cells = df.select(col(label).alias("query_id"), F.posexplode(col(vector)).alias("pos", "x"))
    means = cells.groupBy("query_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    # One entry per dimension.
    listed = F.array_sort(F.collect_list(F.struct("pos", "m")))
    return means.groupBy("query_id").agg(F.transform(listed, lambda c: c["m"]).alias("embedding"))
