"""Exact top-k search by inner product with a ball tree per shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from plumbline.llm.common import Workspace

#: Queries that travel with the tasks at once; more queries are searched block by block.
QUERY_BLOCK = 2_048

#: Vectors of a tree, and of a leaf.
TREE_ROWS, LEAF_ROWS = 16_384, 64

#: Leaves a query looks into before the shards share their k-th scores.
FIRST_LEAVES = 4


class BallTree:
    """Balls around halves of the rows, halved again down to leaves of LEAF_ROWS vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order, self.leaves, self.nodes = np.arange(len(ids)), [], []
        # A node: centre, radius, children or the leaf's range of rows.
        self.ids, self.vectors = ids, vectors
        self.order = order
        if len(ids):
            self._build(0, len(ids))
        self.ids, self.vectors = ids[self.order], vectors[self.order]

    def _build(self, start: int, stop: int) -> int:
        rows = self.vectors[self.order[start:stop]]
        centre = rows.mean(axis=0)
        radius = float(np.sqrt(((rows - centre) ** 2).sum(axis=1).max()))
        node = len(self.nodes)
        self.nodes.append([centre, radius, None, start, stop])
        if stop - start > LEAF_ROWS and radius > 0:
            # Cut half-way along the line between two far rows.
            far = rows[((rows - rows[0]) ** 2).sum(axis=1).argmax()]
            other = rows[((rows - far) ** 2).sum(axis=1).argmax()]
            along, middle = rows @ (far - other), (stop - start) // 2
            self.order[start:stop] = self.order[start:stop][np.argpartition(along, middle)]
            self.nodes[node][2] = (self._build(start, start + middle), self._build(start + middle, stop))
        return node

    def bounds(self, queries: np.ndarray, nodes: list[int]) -> np.ndarray:
        """No row of a node scores above `q . centre + |q| radius`; a little is added for rounding."""
        centres = np.stack([self.nodes[n][0] for n in nodes])
        radii = np.array([self.nodes[n][1] for n in nodes])
        norms = np.sqrt((queries**2).sum(axis=1))
        top = queries @ centres.T + norms[:, None] * radii
        return top + 1e-9 * (np.abs(top) + norms[:, None] * (np.abs(centres).sum(axis=1) + radii) + 1)

    def leaf_list(self) -> list[int]:
        return [i for i, n in enumerate(self.nodes) if n[2] is None]


class Best:
    """The k best (score, smaller id) of each query so far."""

    def __init__(self, queries: int, k: int, floor: np.ndarray | None):
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)
        self.floor = np.full(queries, -np.inf) if floor is None else floor

    def needed(self) -> np.ndarray:
        """A row below this score cannot enter the result any more."""
        return np.maximum(self.score[:, -1], self.floor)

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        score = np.concatenate([self.score[at], scores], axis=1)
        named = np.concatenate([self.id[at], np.broadcast_to(ids, scores.shape)], axis=1)
        keep = np.lexsort((named, -score), axis=1)[:, : self.score.shape[1]]
        self.score[at], self.id[at] = np.take_along_axis(score, keep, 1), np.take_along_axis(named, keep, 1)

    def merge(self, other: "Best") -> None:
        self.add(np.arange(len(self.score)), other.score, other.id)


def exact_products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles while they are exact there, else in 64-bit integers."""
    most = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * queries.shape[1]
    if most < 2.0**53:
        return queries @ rows.T
    return (queries.astype(np.int64) @ rows.astype(np.int64).T).astype(np.float64)


def search(tree: BallTree, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None, first: bool) -> Best:
    """Branch and bound: a node is left out for every query whose k-th score is above its bound.

    With `first`, only the FIRST_LEAVES leaves of highest bound are read per query.
    """
    best = Best(len(queries), k, floor)
    if not tree.nodes or not len(queries):
        return best

    def read(node: int, at: np.ndarray) -> None:
        _, _, _, start, stop = tree.nodes[node]
        scores = exact_products(queries[at], tree.vectors[start:stop])
        scores[query_ids[at][:, None] == tree.ids[start:stop]] = -np.inf
        best.add(at, scores, tree.ids[start:stop])

    leaves = tree.leaf_list()
    bounds = tree.bounds(queries, leaves)
    tops = np.argsort(-bounds, axis=1)[:, :FIRST_LEAVES]
    for column in tops.T:
        for leaf in np.unique(column):
            read(leaves[leaf], np.flatnonzero(column == leaf))
    if first:
        return best
    done = np.zeros(bounds.shape, dtype=bool)
    np.put_along_axis(done, tops, True, axis=1)
    position = {node: i for i, node in enumerate(leaves)}
    stack = [(0, np.arange(len(queries)))]
    while stack:
        node, at = stack.pop()
        children = tree.nodes[node][2]
        if children is None:
            at = at[~done[at, position[node]]]
            at = at[bounds[at, position[node]] >= best.needed()[at]]
            if len(at):
                read(node, at)
            continue
        limits = tree.bounds(queries[at], list(children))
        # The child that promises more to most queries is read first (popped last in, first out).
        order = np.argsort(limits.mean(axis=0))
        for c in order:
            open_ = at[limits[:, c] >= best.needed()[at]]
            if len(open_):
                stack.append((children[c], open_))
    return best


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k rows of `vectors` of highest integer inner product with each query, without the query's own row.

    Both tables have id (long) and vector (array of long). Returns query_id, rank (from 1), vec_id and
    score; ties go to the smaller id; a query with fewer candidates gets all of them.

    A block of queries (at most `query_block`, so of bounded size) travels with the tasks. Every task
    is a shard: it builds ball trees of TREE_ROWS vectors. First, each tree answers from a few leaves
    and the k-th best score over all shards becomes the floor that all shards share; then each tree is
    searched with that floor, which no complete result can fall below. k rows per query and task are
    shuffled. Rows that repeat an id are all candidates, except for the query of that id; an id that is
    asked several times is asked once, with its smallest vector. Ids and vectors must not be NULL or hold
    NULL; vectors of another length than the first query's take no part. Scores must fit 64 bits.
    """
    spark, work = vectors.sparkSession, Workspace(vectors.sparkSession)
    schema = "query_id long, vec_id long, score long"
    queries = work.table(queries.groupBy("id").agg(F.min("vector").alias("vector")), "queries")
    n_blocks = -(-queries.count() // query_block)
    parts = []
    for block in range(n_blocks):
        # About query_block rows by hash; the number of blocks grows with the queries.
        rows = queries.filter(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == block).toArrow()
        ids = rows["id"].to_numpy().astype(np.int64)
        if not len(ids):
            continue
        lists = rows["vector"].to_pylist()
        width = len(lists[0])
        fits = np.array([len(v) == width for v in lists])
        asked = (ids[fits], np.array([v for v in lists if len(v) == width], dtype=np.float64))
        first = _scan(spark, vectors, asked, k, None, schema)
        floors = _best(first, k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor"))
        # One number per query of the block.
        known = {r["query_id"]: r["floor"] for r in floors.filter(F.col("n") >= k).collect()}
        floor = np.array([known.get(i, -np.inf) for i in asked[0].tolist()], dtype=np.float64)
        parts.append(_scan(spark, vectors, asked, k, floor, schema))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _scan(spark, vectors: DataFrame, asked: tuple, k: int, floor: np.ndarray | None, schema: str) -> DataFrame:
    shared, first = spark.sparkContext.broadcast((*asked, floor)), floor is None

    def extend(best: Best | None, waiting: list) -> Best:
        """Search one more tree, knowing what the task has found so far."""
        query_ids, queries, floor = shared.value
        tree = BallTree(*(np.concatenate(x) for x in zip(*waiting)))
        if best is None:
            return search(tree, query_ids, queries, k, floor, first)
        known = best.score[:, -1] if floor is None else np.maximum(floor, best.score[:, -1])
        best.merge(search(tree, query_ids, queries, k, known, first))
        return best

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, best, waiting, n = shared.value[1].shape[1], None, [], 0
        for batch in batches:
            vector = batch.column(1)
            if isinstance(vector, pa.ChunkedArray):
                vector = vector.combine_chunks()
            right = np.diff(vector.offsets.to_numpy()) == width
            batch = batch.filter(pa.array(right))
            if not batch.num_rows:
                continue
            flat = batch.column(1).flatten().to_numpy().astype(np.float64).reshape(-1, width)
            waiting.append((batch.column(0).to_numpy().astype(np.int64), flat))
            n += batch.num_rows
            if n >= TREE_ROWS:
                best = extend(best, waiting)
                waiting, n = [], 0
        if waiting:
            best = extend(best, waiting)
        if best is not None:
            q, r = np.nonzero(np.isfinite(best.score))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shared.value[0][q]), pa.array(best.id[q, r]), pa.array(best.score[q, r].astype(np.int64))],
                names=["query_id", "vec_id", "score"],
            )

    return vectors.select("id", "vector").mapInArrow(scan, schema)
