import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import classify, history, stats, vectors

T0 = dt.datetime(2024, 1, 1)
SESSION = "dataset string, session_id bigint, ts timestamp_ntz, question string, answer string, key_finding string"


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(5)
    words = ["sales", "profit", "the", "trend", "Region", "score", "x", "y", "z"]
    rows = []
    for i in range(300):
        question = "the " + " ".join(rng.sample(words, 3)) if rng.random() < 0.7 else " ".join(rng.sample(words, 2))
        at = T0 + dt.timedelta(seconds=rng.randrange(4000))
        rows.append(("big" if i % 3 else f"d{i % 5}", i, at, question, f"Answer {i}. More", f"Answer {i}"))
    return rows, spark.createDataFrame(rows, SESSION)


def test_context_equals_brute_force(spark, log):
    rows, sessions = log
    asked = [(k, d, q) for k, (d, q) in enumerate([("big", "The trend"), ("d0", "profit Y"), ("d1", "nothing"), ("big", "q z x sales"), ("none", "the")])]
    got: dict = {}
    found = history.context_retrieval(spark.createDataFrame(asked, "q_id bigint, dataset string, question string"), sessions)
    for r in found.orderBy("q_id", "ts", "session_id").collect():
        got.setdefault(r["q_id"], []).append(r["session_id"])
    for k, d, q in asked:
        words = set(q.lower().split())
        hits = sorted((r[2], r[1]) for r in rows if r[0] == d and words & set(r[3].lower().split()))
        assert got.get(k, []) == [i for _, i in hits[-3:]]


def test_enhanced_question(spark, log):
    _, sessions = log
    asked = spark.createDataFrame([(1, "big", "the trend"), (2, "big", "nothing")], "q_id bigint, dataset string, question string")
    out = {r["q_id"]: r["enhanced"] for r in history.enhanced_question(asked, history.context_retrieval(asked, sessions)).collect()}
    assert out[2] == "nothing" and out[1].count(". From '") == 3 and out[1].endswith("when answering.")


def test_retention_and_insights(log):
    rows, sessions = log
    kept = history.retain_sessions(sessions).collect()
    for d in {r[0] for r in rows}:
        newest = sorted(((r[2], r[1]) for r in rows if r[0] == d), reverse=True)[:20]
        assert sorted((r["ts"], r["session_id"]) for r in kept if r["dataset"] == d) == sorted(newest)
    insights = history.insight_rows(sessions)
    assert history.retain_insights(insights).groupBy("dataset", "topic").count().agg(F.max("count")).first()[0] == 5
    assert {r["topic"] for r in insights.select("topic").distinct().collect()} <= {"sales", "time", "performance", "general"}


def test_topic_search(log):
    rows, sessions = log
    out = history.topic_search(history.insight_rows(sessions), sessions, ["SALES", "trend"]).collect()
    for term in ("SALES", "trend"):
        want = sorted((r[2], r[1]) for r in rows if r[0] == "big" and term.lower() in r[3].lower())[-3:]
        got = sorted((r["ts"], r["session_id"]) for r in out if r["kind"] == "session" and r["term"] == term and r["dataset"] == "big")
        assert got == want
    assert not [r for r in out if r["kind"] == "insight" and r["term"] == "trend"]


def test_artifact_matching(spark):
    at = T0 + dt.timedelta(hours=1)

    def name(d, seconds, kind="png"):
        return f"charts/{d}_{(at + dt.timedelta(seconds=seconds)):%Y%m%d_%H%M%S}.{kind}"

    paths = [name("a", 0), name("b", 119), name("c", 120), name("c_x", -3), name("d", 121), name("e", -60), name("e", 60), name("f", 5), name("f", 0), "junk.png"]
    artifacts = history.artifact_parts(spark.createDataFrame([(p,) for p in paths], "path string"))
    sessions = spark.createDataFrame([(d, i, at + dt.timedelta(milliseconds=250)) for i, d in enumerate("abcdefg")], "dataset string, session_id int, ts timestamp_ntz")
    got = {r["dataset"]: (r["path"], r["seconds_apart"]) for r in history.match_artifacts(sessions, artifacts).collect()}
    assert got == {
        "a": (name("a", 0), 0), "b": (name("b", 119), 119), "c": (name("c", 120), 120), "d": (None, None),
        "e": (name("e", -60), 60), "f": (name("f", 0), 0), "g": (None, None),
    }


def catalog(spark, tables):
    rows = [(d, i, c, k) for d, cols in tables.items() for i, (c, k) in enumerate(cols)]
    return spark.createDataFrame(rows, "dataset string, ordinal int, column_name string, kind string")


def test_table_domain_and_suggestions(spark):
    tables = {
        "sleep": [("Person ID", "numeric"), ("Sleep Duration", "numeric")],
        "split": [("Arm Blood", "numeric"), ("Pressure Max", "numeric")],
        "far": [("Arm Blood", "numeric"), ("x", "numeric"), ("Pressure Max", "numeric")],
        "shop": [("customer", "categorical"), ("unit price", "numeric")],
        "none": [("a", "categorical"), ("b", "datetime")],
    }
    c = catalog(spark, tables)
    domains = {r["dataset"]: r["domain"] for r in classify.table_domain(c).collect()}
    assert domains == {
        "sleep": "Sleep/Health", "split": "Healthcare/Medical", "far": "Mixed/General", "shop": "Business/Finance", "none": "Mixed/General",
    }
    rows = classify.suggest_questions(c, 12).collect()
    listed = {d: [r["question"] for r in sorted(rows, key=lambda r: r["position"]) if r["dataset"] == d] for d in tables}
    assert len(listed["far"]) == 12 and listed["far"][10] == "What is the distribution of values in Arm Blood?"
    assert listed["far"][11] == "How does x correlate with other key variables?"
    assert "sleep" in listed["split"][0] and "sleep" not in listed["shop"][0]
    assert classify.suggest_questions(c, 4).count() == 4 * len(tables)


def test_question_rules(spark):
    c = catalog(spark, {"t": [("g", "categorical"), ("Price", "numeric"), ("qty", "numeric")], "n": [("a", "numeric")], "e": [("d", "datetime")]})
    asked = [
        (1, "t", "Show the correlation"), (2, "t", "Is there a difference by PRICE?"), (3, "n", "compare it"),
        (4, "e", "plot distribution"), (5, "t", "how many rows"),
    ]
    q = spark.createDataFrame(asked, "q_id int, dataset string, question string")
    got = {r["q_id"]: (r["wants_chart"], r["chart"], r["analysis"]) for r in classify.question_intent(q, c).collect()}
    assert got == {
        1: (True, "correlation", "comparison"), 2: (False, "comparison", "comparison"), 3: (True, "distribution", "distribution"),
        4: (True, "summary", "aggregation"), 5: (False, "distribution", "comparison"),
    }
    target = {r["q_id"]: r["target_column"] for r in stats.target_column(q, c).collect()}
    assert target == {1: "g", 2: "Price", 3: "a", 4: "d", 5: "g"}
    relevant = [(r["dataset"], r["column_name"]) for r in classify.relevant_columns(c).orderBy("dataset", "kind", "ordinal").collect()]
    assert relevant == [("n", "a"), ("t", "g"), ("t", "Price"), ("t", "qty")]


def test_text_domain(spark):
    texts = ["A clinical trial of medicine in a hospital", "government policy", "art", "", None, "Research STUDY of market strategy and sales"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")

    def domains():
        return [r["domain"] for r in classify.text_domain(df, "t").orderBy("i").collect()]

    assert domains() == ["Healthcare/Medical", "Government/Policy", "General", "General", "General", "Business/Finance"]


def test_catalog_tables(spark):
    c = catalog(spark, {"a": [("x", "numeric")], "b": [("y", "numeric"), ("z", "categorical")]})
    only_a = spark.createDataFrame([("a",), ("a",)], "dataset string")
    sizes = spark.createDataFrame([("a", 7)], "dataset string, n_rows bigint")
    info = {r["dataset"]: tuple(r)[1:] for r in history.catalog_info(c, sizes, only_a, only_a, only_a).collect()}
    assert info == {"a": (7, 1, "x", True, True, 2), "b": (None, 2, "y,z", False, False, 0)}
    rows = {r["dataset"]: tuple(r)[1:] for r in history.catalog_summary(classify.table_domain(c), only_a, only_a).collect()}
    assert rows == {"a": ("Mixed/General", 1, 2, 2), "b": ("Mixed/General", 1, 0, 0), None: (None, 2, 2, 2)}


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_nearest_in_one_pass_and_in_blocks(spark, metric):
    rng = np.random.default_rng(2)
    memory = [[float(v) for v in rng.integers(-2, 3, 4)] for _ in range(200)]
    memory[0] = [0.0] * 4
    asked = [[float(v) for v in rng.normal(size=4)] for _ in range(30)]
    m = spark.createDataFrame(list(enumerate(memory)), "mem_id bigint, embedding array<float>").repartition(5)
    q = spark.createDataFrame(list(enumerate(asked)), "query_id bigint, embedding array<float>")

    def found(block):
        rows = vectors.knn(m, q, 5, metric, query_block=block).collect()
        return {(r["query_id"], r["mem_id"]): round(r["distance"], 9) for r in rows}

    one, blocks = found(100), found(7)
    assert one == blocks and len(one) == 150
    for k, v in enumerate(asked):
        a, b = np.asarray(memory), np.asarray(v, dtype="float32").astype(float)
        if metric == "l2":
            d = np.sqrt(((a - b) ** 2).sum(1))
        else:
            n = np.linalg.norm(a, axis=1) * np.linalg.norm(b)
            d = 1 - np.divide(a @ b, n, out=np.zeros(len(a)), where=n > 0)
        want = np.sort(d)[:5]
        assert sorted(x for (i, _), x in one.items() if i == k) == pytest.approx(list(want), abs=1e-6)


def test_embedding_store_and_search(spark, tmp_path):
    path = str(tmp_path / "memory")
    first = spark.createDataFrame([(1, "red apple pie"), (2, "blue sky")], "mem_id bigint, text string")
    vectors.store_memory(first, path, dimensions=256)
    vectors.store_memory(spark.createDataFrame([(3, "green apple")], "mem_id bigint, text string"), path, dimensions=256)
    asked = vectors.embed(spark.createDataFrame([(9, "Apple pie")], "query_id bigint, text string"), "text", dimensions=256)
    near = vectors.knn(spark.read.parquet(path), asked, 2, "cosine").orderBy("distance").collect()
    assert [r["mem_id"] for r in near] == [1, 3]
    own = vectors.embed(first, "text", lambda batch: [[float(len(t)), 1.0] for t in batch])
    assert [list(r["embedding"]) for r in own.orderBy("mem_id").collect()] == [[13.0, 1.0], [8.0, 1.0]]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_many_queries_are_shuffled_to_the_memory(spark, metric, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 64)
    monkeypatch.setattr(vectors, "FIRST_ROWS", 8)
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.integers(-2, 3, 4)]) for i in range(300)]
    rows += [(300, [0.0] * 4), (301, [float("nan"), 1.0, 1.0, 1.0]), (302, None)]
    m = spark.createDataFrame(rows, "mem_id bigint, embedding array<float>").repartition(5)
    q = m.withColumnRenamed("mem_id", "query_id")
    grid = vectors.knn(m, q, 5, metric, query_block=50)
    # No block of queries is a scan of its own.
    assert grid._jdf.queryExecution().toString().count("MapInArrow") == 0
    found = {}
    for r in grid.collect():
        found.setdefault(r["query_id"], []).append((r["distance"], r["mem_id"]))
    assert len(found) == 301
    a = np.array([v for _, v in rows[:301]])
    for i in range(301):
        if metric == "l2":
            d = np.sqrt(((a - a[i]) ** 2).sum(axis=1))
        else:
            n = np.sqrt((a**2).sum(axis=1) * (a[i] ** 2).sum())
            d = np.round(1 - np.divide((a * a[i]).sum(axis=1), n, out=np.zeros(len(a)), where=n > 0), 9)
        assert sorted(found[i]) == sorted(zip(d.tolist(), range(301)))[:5]


def test_a_callers_embedding_gets_texts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TEXT_BLOCK", 100)
    rows = spark.createDataFrame([(i, "x" * (300 if i == 5 else 30)) for i in range(20)] + [(20, None)], "mem_id bigint, text string").coalesce(1)
    # Rows that the function gets together, and their characters.
    got = vectors.embed(rows, "text", lambda part: [[float(len(part)), float(part.fillna("").str.len().sum())]] * len(part))
    seen = [tuple(r["embedding"]) for r in got.orderBy("mem_id").collect()]
    assert len(seen) == 21 and seen[5] == (1.0, 300.0)
    assert max(chars for rows_, chars in seen if rows_ > 1) <= 100
