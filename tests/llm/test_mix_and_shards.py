"""Properties of rendezvous shards and of the Pareto mix."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm.mixing import mix_sources
from plumbline.llm.sharding import assign_shards, with_shard
from plumbline.llm.substrings import remove_repeats, repeated_spans, sliding_argmin
from tests.llm.conftest import words


@pytest.fixture(scope="module")
def keys(spark):
    return spark.range(6000).selectExpr("id AS doc_id", "concat('text ', id) AS text").repartition(5).cache()


def test_a_new_shard_takes_rows_only_into_itself(keys):
    rows = assign_shards(keys, [1.0] * 8, grow_by=1.0).collect()
    assert all(r["grown_shard"] in (r["shard"], 8) for r in rows)
    moved = sum(r["grown_shard"] == 8 for r in rows)
    assert 0.8 * 6000 / 9 < moved < 1.2 * 6000 / 9
    for shard in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))


def test_weights_share_out_the_rows(keys):
    counts = collections.Counter(r["shard"] for r in with_shard(keys, [1.0, 3.0, 0.0, 2.0]).collect())
    assert set(counts) == {0, 1, 3} and all(abs(counts[s] / 1000 - w) < 0.15 for s, w in ((0, 1), (1, 3), (3, 2)))
    with pytest.raises(ValueError):
        with_shard(keys, [0.0])


def test_slots_stay_gapless_with_many_classes_and_repeats(spark, monkeypatch, keys):
    monkeypatch.setattr("plumbline.llm.sharding.WINDOW_ROWS", 50)
    twice = keys.unionByName(keys.filter("doc_id % 3 = 0")).unionByName(keys.filter("doc_id = 7"))
    few, many = (assign_shards(twice, [1.0] * 3).collect() for _ in range(2))
    assert sorted(map(tuple, few)) == sorted(map(tuple, many))
    by = collections.defaultdict(list)
    for r in few:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(5)
    rows = [(i, " ".join("w" for _ in range(r.choice([3, 20, 60, 200, 900]))), f"s{i % 5}" if i % 7 else None) for i in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


def test_sources_come_near_their_targets(corpus):
    rows = mix_sources(corpus, [5.0, 2.0, 1.0], 1.5).select("*", "mix.*").collect()
    again = mix_sources(corpus.repartition(7), [5.0, 2.0, 1.0], 1.5).select("*", "mix.*").collect()
    assert sorted((r["doc_id"], r["copies"]) for r in rows) == sorted((r["doc_id"], r["copies"]) for r in again)
    total = sum(r["size"] for r in rows)
    targets = {r["source"]: r["target"] for r in rows}
    assert abs(sum(targets.values()) - 1.5 * total) < 1 and len(targets) == 6
    for source, target in targets.items():
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["size"] * r["copies"] for r in own) - target) <= max(r["size"] for r in own)
        assert all(0 <= r["copies"] <= 2 for r in own) and target <= 2 * own[0]["source_size"] + 1e-6


def test_full_documents_have_the_higher_chance(corpus):
    rows = mix_sources(corpus.withColumn("source", F.lit("one")), [1.0], 0.6).select("mix.*").collect()
    taken = {long: [r["copies"] for r in rows if (r["size"] >= 50) == long] for long in (False, True)}
    short, full = (sum(x) / len(x) for x in (taken[False], taken[True]))
    assert set(taken[True]) == {0, 1} and 0.4 < short / full < 0.6


# Substrings -----------------------------------------------------------------------------------


def test_leftmost_smallest():
    import numpy as np

    values = np.array([5, 3, 3, 9, 1, 7, 1, 8, 8, 8], dtype=np.uint64)
    for width in (1, 2, 3, 5, 7):
        got = sliding_argmin(values, width)
        assert got.tolist() == [i + int(np.argmin(values[i : i + width])) for i in range(len(values) - width + 1)]


def test_spans_name_sources_that_hold_the_same_words(spark):
    passage = words(80, 5, 2000)
    rows = [
        (3, words(60, 1, 2000) + " " + passage), (1, passage + " " + words(30, 2, 2000)), (9, words(10, 3, 2000) + " " + passage + " " + passage),
        (4, " ".join(passage.split()[:60]) + " end"), (5, " ".join(passage.split()[:49])), (None, passage),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {i: (t or "").split() for i, t in rows}
    spans = {r["doc"]: r["spans"] for r in repeated_spans(docs).collect()}
    assert set(spans) == {3, 9, 4}
    for doc, found in spans.items():
        for s in found:
            assert s["source"] < doc and s["n"] >= 50
            assert texts[doc][s["start"] : s["start"] + s["n"]] == texts[s["source"]][s["source_start"] : s["source_start"] + s["n"]]
    assert [(s["start"], s["n"], s["source"], s["source_start"]) for s in spans[3]] == [(60, 80, 1, 0)]
    out = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in remove_repeats(docs).collect()}
    assert out == {3: (140, 80), 1: (110, 0), 9: (170, 160), 4: (61, 60), 5: (49, 0), None: (80, 0)}


@pytest.mark.parametrize("window, anchor", [(6, 3), (5, 1)])
def test_short_windows_equal_brute_force(spark, window, anchor):
    rows = [(i, words(40, i, 4)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    first = {}
    for i, t in rows:
        w = t.split()
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), i)
    for r in remove_repeats(docs, window=window, anchor=anchor).collect():
        w = rows[r["doc_id"]][1].split()
        gone = {q for p in range(len(w) - window + 1) if first[tuple(w[p : p + window])] < r["doc_id"] for q in range(p, p + window)}
        assert r["kept"] == " ".join(x for q, x in enumerate(w) if q not in gone) and r["n_removed"] == len(gone)
