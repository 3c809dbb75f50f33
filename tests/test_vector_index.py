"""Inverted file of vectors against the full scan."""

import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.operators import vector_index as V, vectors
from plumbline.session import ensure_checkpoint_dir


def folder(spark):
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/index-{uuid.uuid4().hex}"


def clustered(n, width, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, width)) * 5
    return [(i, (centres[i % 12] + r.normal(size=width)).tolist()) for i in range(n)]


def tables(spark, memory, asked):
    return (
        spark.createDataFrame(memory, "mem_id long, embedding array<double>").repartition(3),
        spark.createDataFrame(asked, "query_id long, embedding array<double>"),
    )


def rows(df):
    return sorted((r["query_id"], r["mem_id"], round(r["distance"], 6)) for r in df.collect())


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_exact_search_equals_the_full_scan(spark, metric, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 40)
    memory = clustered(400, 6, 1) + [(500, [0.0] * 6), (501, [0.0] * 6), (502, None), (503, [1.0] * 6), (504, [1.0] * 6)]
    asked = clustered(30, 6, 2) + [(100, [0.0] * 6), (101, [1.0] * 6), (102, None)]
    m, q = tables(spark, memory, asked)
    path = folder(spark)
    V.build_index(m.filter("mem_id % 3 < 2"), path, metric)
    V.append_index(m.filter("mem_id % 3 = 2"), path)
    index = V.open_index(spark, path)
    assert index.rows.sum() + index.undirected == 404 and (index.undirected == 2) == (metric == "cosine")
    assert rows(V.search_index(index, q, 4, probes=1, exact=True)) == rows(vectors.knn(m, q, 4, metric))


def test_few_cells_are_read_and_most_neighbours_found(spark):
    m, q = tables(spark, clustered(1200, 8, 3), clustered(60, 8, 4))
    path = folder(spark)
    V.build_index(m, path, cells=24)
    index = V.open_index(spark, path)
    found, want = (set((a, b) for a, b, _ in rows(x)) for x in (V.search_index(index, q, 5, probes=3), vectors.knn(m, q, 5)))
    assert len(found & want) >= 0.9 * len(want)
    one = q.filter("query_id = 0")
    cells = {r["cell"] for r in V.routes(one.select("query_id", "embedding"), index, 3).collect()}
    assert len(cells) == 3 and index.rows[list(cells)].sum() < 0.5 * index.rows.sum()
    plan = V.search_index(index, one, 5, probes=3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_fewer_memories_than_neighbours_and_none(spark):
    m, q = tables(spark, [(1, [1.0, 2.0]), (2, [3.0, 4.0])], [(7, [0.0, 0.0])])
    path = folder(spark)
    V.build_index(m, path)
    index = V.open_index(spark, path)
    assert [r[:2] for r in rows(V.search_index(index, q, 5, exact=True))] == [(7, 1), (7, 2)]
    path = folder(spark)
    V.build_index(m.filter("mem_id < 0"), path)
    assert V.search_index(V.open_index(spark, path), q, 5, exact=True).collect() == []


def test_one_vector_held_by_most_rows(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 50)
    memory = [(i, [1.0, 1.0]) for i in range(300)] + [(300 + i, [float(i), -1.0]) for i in range(20)]
    m, q = tables(spark, memory, [(i, [1.0, 1.0]) for i in range(120)])
    path = folder(spark)
    V.build_index(m, path)
    got = V.search_index(V.open_index(spark, path), q, 3, exact=True)
    assert got.groupBy("query_id").agg(F.collect_set("mem_id").alias("s")).filter(F.array_sort("s") == F.array(*[F.lit(i).cast("long") for i in range(3)])).count() == 120


def test_each_text_is_embedded_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def lengths(batch):
        seen.add(len(batch))
        return [[float(len(t)), float(i % 3)] for i, t in enumerate(batch)]

    texts = spark.createDataFrame([(i, "x" * (i % 17 + 1)) for i in range(300)], "mem_id long, text string").repartition(2)
    path = folder(spark)
    V.build_index(vectors.embed(texts.filter("mem_id < 200"), "text", lengths), path, cells=4)
    V.append_index(vectors.embed(texts.filter("mem_id >= 200"), "text", lengths), path)
    assert V.open_index(spark, path).rows.sum() == 300 and seen.value == 300


def test_distances_from_centres_are_held_in_tiles(monkeypatch):
    held, apart = [], V._apart

    def counted(rows, centres):
        held.append(len(rows) * len(centres))
        return apart(rows, centres)

    monkeypatch.setattr(V, "_apart", counted)
    monkeypatch.setattr(V, "TILE", 100, raising=False)
    points = np.random.default_rng(5).normal(size=(57, 3))
    batch = pa.RecordBatch.from_pydict({"mem_id": list(range(57)), "embedding": points.tolist()})
    out = pa.Table.from_batches(V._assign(points[:10], "l2")([batch]))
    assert out["cell"].to_pylist() == np.argmin(apart(points, points[:10]), axis=1).tolist() and out["mem_id"].to_pylist() == list(range(57))
    index = V.Index("", "l2", points[:10], np.ones(10, np.int64), np.zeros(10), 0)
    assert pa.Table.from_batches(V._route(index, 2, False)([batch.rename_columns(["query_id", "embedding"])])).num_rows == 114
    assert max(held) <= 100
