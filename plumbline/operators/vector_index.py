"""Nearest neighbours from an inverted file of vectors.

Vectors are kept by cell, one partition folder per k-means cell, with each cell's centre, rows and radius
(the greatest distance of a member from the centre). A search reads the cells nearest to its queries and
leaves the other folders alone. By the triangle inequality a cell whose centre is further from a query
than its radius plus the k-th distance found so far holds nothing nearer; an exact search goes on
with the cells for which that does not hold, and only with those.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plumbline.operators.stats import latest
from plumbline.operators.vectors import meet, vector_matrix
from plumbline.session import materialized

#: Cells at most, and rows of lowest hash that the centres are fitted on, at most.
MOST_CELLS, SAMPLE = 4_096, 200_000

#: Rows of a cell, and queries of a cell, that meet in one task.
BLOCK = 16_384

#: Distances from centres that are held at once, so that a task's memory does not depend on the number of cells.
TILE = 1 << 19

#: The cell of vectors without a direction, where directions are compared. It is always read.
NO_DIRECTION = -1

#: Allowance for rounding in bounds, relative to the numbers compared.
SLACK = 1e-6


class Index(NamedTuple):
    folder: str
    metric: str
    centres: np.ndarray  # one row per cell
    rows: np.ndarray  # per cell
    radius: np.ndarray  # per cell
    undirected: int  # rows of the cell NO_DIRECTION


def _directed(rows: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as they are compared, and which of them can be: unit vectors where directions are."""
    if metric == "l2":
        return rows, np.ones(len(rows), dtype=bool)
    size = np.sqrt((rows**2).sum(axis=1))
    return rows / np.where(size > 0, size, 1)[:, None], size > 0


def _apart(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of all rows from all centres."""
    square = (rows**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * rows @ centres.T
    return np.sqrt(np.maximum(square, 0))


def _tiles(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose distances from all cells are about TILE, one row at least."""
    step = max(1, TILE // max(cells, 1))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def _assign(centres: np.ndarray, metric: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _tiles(batches, len(centres)):
            if batch.num_rows:
                rows, can = _directed(vector_matrix(batch.column(1)), metric)
                cell = np.argmin(_apart(rows, centres), axis=1)
                far = np.sqrt(((rows - centres[cell]) ** 2).sum(axis=1))
                cell, far = np.where(can, cell, NO_DIRECTION), np.where(can, far, 0.0)
                columns = [*batch.columns, pa.array(far), pa.array(cell.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["mem_id", "embedding", "far", "cell"])

    return run


def _fit(vectors: DataFrame, cells: int, metric: str, sample: int) -> np.ndarray:
    rows = vectors.orderBy(F.xxhash64("mem_id"), "mem_id").limit(sample)
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    if metric == "cosine":
        rows = rows.withColumn("size", size).filter("size > 0")
        rows = rows.withColumn("embedding", F.transform("embedding", lambda x: x / F.col("size")))
    rows = materialized(rows.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")))
    if rows.isEmpty():
        return np.zeros((0, 0))
    return np.array(KMeans(k=max(cells, 2), seed=1, maxIter=10).fit(rows).clusterCenters())


def _vectors(rows: DataFrame, key: str) -> DataFrame:
    """Keys and vectors, written once: the function that makes the vectors runs once a row, and not beside what reads them."""
    return materialized(rows.select(key, "embedding")).filter("embedding is not null and size(embedding) > 0")


def build_index(memory: DataFrame, folder: str, metric: str = "l2", cells: int | None = None, sample: int = SAMPLE) -> None:
    """Keep the memories `(mem_id, embedding)` by cell in a new folder.

    `metric` is `l2` or `cosine`. There are about as many cells as the root of the rows, MOST_CELLS at
    most. Centres are fitted on `sample` rows; every row is kept. Rows without a vector are left out; all
    vectors must have one length.
    """
    spark, vectors = memory.sparkSession, _vectors(memory, "mem_id")
    n = vectors.count()
    centres = _fit(vectors, cells or min(MOST_CELLS, round(math.sqrt(n))), metric, sample)
    listed = [(i, metric, c.tolist()) for i, c in enumerate(centres)] or [(None, metric, None)]
    spark.createDataFrame(listed, "cell int, metric string, centre array<double>").coalesce(1).write.parquet(f"{folder}/centres")
    vectors.limit(0).write.parquet(f"{folder}/shape")
    _append(vectors, folder)


def append_index(memory: DataFrame, folder: str) -> None:
    """Add memories to a folder: its centres stay, radii grow where they must."""
    _append(_vectors(memory, "mem_id"), folder)


def _append(vectors: DataFrame, folder: str) -> None:
    spark = vectors.sparkSession
    kept = spark.read.parquet(f"{folder}/centres").orderBy("cell").collect()
    metric, centres = kept[0]["metric"], np.array([r["centre"] for r in kept if r["cell"] is not None])
    if not len(centres):
        # Fitted on nothing with a direction: one cell around the origin.
        width = vectors.select(F.max(F.size("embedding"))).first()[0] or 1
        centres = np.zeros((1, width))
    shape = vectors.schema["mem_id"].dataType.simpleString()
    kind = vectors.schema["embedding"].dataType.simpleString()
    placed = vectors.mapInArrow(_assign(centres, metric), f"mem_id {shape}, embedding {kind}, far double, cell int")
    # Rows of a cell come together, a large cell in several files.
    placed.hint("rebalance", "cell").write.partitionBy("cell").mode("append").parquet(f"{folder}/vectors")


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/shape").schema.add("far", T.DoubleType()).add("cell", T.IntegerType())
    return spark.read.schema(schema).parquet(f"{folder}/vectors")


def open_index(spark: SparkSession, folder: str) -> Index:
    """Centres, rows and radii of a folder: as many rows as cells reach the driver."""
    kept = spark.read.parquet(f"{folder}/centres").orderBy("cell").collect()
    centres = np.array([r["centre"] for r in kept if r["cell"] is not None])
    found = _stored(spark, folder).groupBy("cell").agg(F.count("*").alias("rows"), F.max("far").alias("far")).collect()
    if not len(centres):
        centres = np.zeros((1, 1))
    rows, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    undirected = 0
    for r in found:
        if r["cell"] == NO_DIRECTION:
            undirected = r["rows"]
        else:
            rows[r["cell"]], radius[r["cell"]] = r["rows"], r["far"]
    return Index(folder, kept[0]["metric"], centres, rows, radius, undirected)


def _route(index: Index, probes: int, known: bool):
    """Cells to read for queries: the `probes` nearest, or with known k-th distances all others that may hold something nearer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.flatnonzero(index.rows)
        for batch in _tiles(batches, len(full)):
            if not batch.num_rows or not (len(full) or index.undirected):
                continue
            rows, can = _directed(vector_matrix(batch.column(1)), index.metric)
            apart = _apart(rows, index.centres[full])
            order = np.argsort(apart, axis=1, kind="stable")
            first = np.zeros(apart.shape, dtype=bool)
            np.put_along_axis(first, order[:, :probes], True, axis=1)
            if known:
                limit = batch.column(2).to_numpy(zero_copy_only=False)
                # Unit vectors at cosine distance t are sqrt(2 t) apart; a query without a direction is as far from all.
                limit = np.sqrt(2 * np.maximum(limit + 1e-9, 0)) if index.metric == "cosine" else limit
                limit = np.where(can, limit, np.inf)
                bound = apart - index.radius[full]
                first = ~first & (bound <= (limit + SLACK * (1 + limit + apart.max(axis=1, initial=0)))[:, None])
            q, c = np.nonzero(first)
            cell = full[c]
            if index.undirected and not known:
                q, cell = np.append(q, np.arange(len(rows))), np.append(cell, np.full(len(rows), NO_DIRECTION))
            for start in range(0, len(q), BLOCK):
                at = pa.array(q[start : start + BLOCK])
                rest = pa.array(cell[start : start + BLOCK].astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), rest], names=["query_id", "embedding", "cell"])

    return run


def routes(queries: DataFrame, index: Index, probes: int, known: bool = False) -> DataFrame:
    """Rows (query_id, embedding, cell): which cells are read for which query."""
    shape, kind = (queries.schema[c].dataType.simpleString() for c in ("query_id", "embedding"))
    return queries.mapInArrow(_route(index, probes, known), f"query_id {shape}, embedding {kind}, cell int")


def _search(asked: DataFrame, index: Index, k: int, shape: str) -> DataFrame:
    """The k nearest of each query within the cells it is routed to, k per part of a cell."""
    spark = asked.sparkSession
    counts = asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("query_parts")).collect()
    sizes = {NO_DIRECTION: index.undirected} | dict(enumerate(index.rows.tolist()))
    plan = [(r["cell"], r["query_parts"], -(-sizes[r["cell"]] // BLOCK)) for r in counts]
    # One row per cell that is read; both sides of the cogroup get columns of their own.
    parts = [F.broadcast(spark.createDataFrame(plan, "cell int, query_parts int, row_parts int")) for _ in range(2)]
    stored = _stored(spark, index.folder).filter(F.col("cell").isin([c for c, _, _ in plan]))
    rows = stored.join(parts[0], "cell").select(
        F.col("cell").alias("c"), F.pmod(F.xxhash64("mem_id"), "row_parts").cast("int").alias("r"),
        F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)).alias("q"), "mem_id", "embedding",
    )
    queries = asked.join(parts[1], "cell").select(
        F.col("cell").alias("c"), F.explode(F.sequence(F.lit(0), F.col("row_parts") - 1)).alias("r"),
        F.pmod(F.xxhash64("query_id"), "query_parts").cast("int").alias("q"), "query_id", "embedding",
    )
    query_shape = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {query_shape}, mem_id {shape}, distance double"
    return queries.groupBy("c", "r", "q").cogroup(rows.groupBy("c", "r", "q")).applyInArrow(meet(k, index.metric), schema)


def search_index(index: Index, queries: DataFrame, k: int = 5, probes: int = 8, exact: bool = False) -> DataFrame:
    """The k nearest memories of each query `(query_id, embedding)`: query_id, mem_id, distance, ties by mem_id.

    The `probes` cells nearest to a query are read; other folders are not. With `exact`, so are those
    that may hold something nearer than the k-th distance found there, and the result is that of `knn`.
    Queries without a vector get no rows; an id that is asked with several vectors is one query of all.
    """
    spark = queries.sparkSession
    shape = _stored(spark, index.folder).schema["mem_id"].dataType.simpleString()
    asked = _vectors(queries, "query_id")
    routed = materialized(routes(asked, index, probes))
    near = latest(_search(routed, index, k, shape), ["query_id"], [F.col("distance"), F.col("mem_id")], k)
    if not exact:
        return near
    near = materialized(near)
    kth = near.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("last"))
    limit = F.coalesce(F.when(F.col("n") >= k, F.col("last")), F.lit(float("inf"))).alias("kth")
    rest = materialized(routes(asked.join(kth, "query_id", "left").select("query_id", "embedding", limit), index, probes, known=True))
    if rest.isEmpty():
        return near
    both = near.unionByName(_search(rest, index, k, shape))
    return latest(both, ["query_id"], [F.col("distance"), F.col("mem_id")], k)
