"""Toxicity: counts, ratios and scores against plain versions, held-out accuracy, odd tables."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import toxicity as T
from plumbline.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plain_grams(text):
    text = " " + (text or "").lower() + " "
    text = re.sub(r"[\t\n\x0b\x0c\r \x85\xa0]+", " ", text)
    return [text[i : i + n] for n in T.GRAMS for i in range(len(text) - n + 1)]


TEXTS = ["You IDIOT, go\n\n away", "", None, "ab", "Ünï çødé ♥ İstanbul", "a " * 40, "x\ty", "same same", "same same", "z"]


def test_grams_are_those_of_each_text_alone():
    got = [Counter() for _ in TEXTS]
    for row, bucket in T.gram_buckets(pa.array(TEXTS)):
        for r, b in zip(row.tolist(), bucket.tolist()):
            got[r][b] += 1
    alone = []
    for t in TEXTS:
        c = Counter()
        for _, bucket in T.gram_buckets(pa.array([t])):
            c.update(bucket.tolist())
        alone.append(c)
    assert got == alone and got[7] == got[8]
    for t, c in zip(TEXTS, got):
        grams = plain_grams(t)
        assert sum(c.values()) == len(grams) and len(c) <= len(set(grams))
    assert len(got[0]) > 0.95 * len(set(plain_grams(TEXTS[0])))


def test_ratios_equal_counts_over_classes(spark):
    docs = [(i, f"{'bad idiot' if i % 2 else 'nice day'} number {i % 7}") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    model = T.learn_toxicity(df, labels)
    buckets = [Counter(), Counter()]
    for i, t in docs:
        for _, b in T.gram_buckets(pa.array([t])):
            buckets[i % 2].update(set(b.tolist()))
    seen = sorted(set(buckets[0]) | set(buckets[1]))
    whole = [sum(c[b] + 1 for b in seen) for c in buckets]
    for b in seen:
        want = math.log((buckets[1][b] + 1) / whole[1]) - math.log((buckets[0][b] + 1) / whole[0])
        assert abs(model.ratio[model.feature[b]] - want) < 1e-9
    scores = {r["doc_id"]: r["score"] for r in T.score_toxicity(df, model).collect()}
    assert all((scores[i] > 0.5) == bool(i % 2) for i, _ in docs)
    # Plain score of one text.
    present = {model.feature[x] for _, b in T.gram_buckets(pa.array([docs[3][1]])) for x in b.tolist()} - {-1}
    length = math.sqrt(sum(model.ratio[f] ** 2 for f in present) + T.DAMPING)
    z = model.intercept + sum(model.weight[f] * model.ratio[f] for f in present) / length
    assert abs(scores[3] - 1 / (1 + math.exp(-z))) < 1e-5


def test_fit_finds_the_least_loss():
    r = np.random.default_rng(3)
    rows = r.normal(size=(200, 3)).astype(np.float32) / 3
    labels = (rows[:, 0] + 0.3 * r.normal(size=200) > 0).astype(float)
    weight, intercept = T.fit_logistic(rows, labels)

    def loss(w, b):
        z = rows @ w + b
        return np.mean(np.logaddexp(0, z) - labels * z) + T.PENALTY / 2 * (w**2).sum()

    best = loss(weight, intercept)
    assert all(best <= loss(weight + 0.2 * r.normal(size=3), intercept + 0.2 * r.normal()) for _ in range(50))


def test_held_out_texts(spark):
    rows = QUERIES["op13_toxicity"](spark, SF)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    joined = rows.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out and toxic is not null").collect()
    toxic, other = ([r["score"] for r in joined if r["toxic"] == t] for t in (1, 0))
    above = np.mean([[a > b for b in other] for a in toxic])
    assert above > 0.75 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in joined)
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_nothing_but_the_text_decides(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    labels = spark.read.parquet(f"{odd_dir}/labels.parquet").selectExpr("doc_id", "cast(doc_id % 2 as int) toxic")
    model = T.learn_toxicity(docs, labels)
    scored = T.score_toxicity(docs, model)
    assert sorted(scored.columns) == sorted(docs.columns) and dict(scored.dtypes)["score"] == "double"
    by_text = {}
    for r in scored.collect():
        by_text.setdefault(r["text"], set()).add(r["score"])
    assert all(len(s) == 1 for s in by_text.values()) and by_text[None] == by_text[""]


def test_texts_beyond_a_block_are_scored_whole(spark):
    filler = "some calm words stand here "
    docs = [(i, "vile scum " + filler if i % 2 else filler) for i in range(60)] + [(100, filler * 60_000 + "vile scum " * 20), (101, filler * 60_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = T.learn_toxicity(df, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int"))
    scores = {r["doc_id"]: r["score"] for r in T.score_toxicity(df, model, keep=["doc_id"]).filter("doc_id >= 100").collect()}
    assert scores[100] > 0.5 > scores[101]


@pytest.mark.parametrize("labels, share", [([], 0.5), ([(1, 1), (2, 1)], 1.0), ([(1, 0), (99, 1), (2, 0), (2, 1)], 0.0), ([(3, 1)], 0.5)])
def test_without_both_classes_the_share_is_the_score(spark, labels, share):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (None, "c")], "doc_id long, text string")
    model = T.learn_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model == share
    assert [r["score"] for r in T.score_toxicity(docs, model).collect()] == [share] * 4


def test_ids_shared_by_many_rows_count_once(spark):
    docs = [(1, "good text")] * 300 + [(i, "bad scum" if i % 2 else "good text") for i in range(2, 30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    few = spark.createDataFrame([(1, "good text")] + docs[300:], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2 if i > 1 else 0) for i in range(1, 30)], "doc_id long, toxic int")
    a, b = T.learn_toxicity(df, labels), T.learn_toxicity(few, labels)
    assert np.allclose(a.ratio, b.ratio) and np.allclose(a.weight, b.weight) and a.intercept == b.intercept
