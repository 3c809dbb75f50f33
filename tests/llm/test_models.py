"""Language, quality and language-model scores against plain versions, and on held-out rows."""

import collections
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import langid as L, mixing_lm as M, quality as Q, queries
from plumbline.llm.mixing import share_out
from tests.llm.conftest import words

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = queries.op2(spark, SF).join(docs, "doc_id").collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 for r in rows)
    held = [r["lang_pred"] == r["lang"] for r in rows if r["held_out"]]
    assert len(held) > 100 and sum(held) / len(held) > 0.97


def test_bloom_filter_returns_all_languages_of_each_gram(spark):
    texts = [("aa bb cc dd " * 5, "x"), ("dd ee ff gg " * 5, "y"), ("hh ii", "z"), (None, "z"), ("aa", None)]
    model = L.learn_languages(spark.createDataFrame(texts, "text string, lang string"))
    assert model.languages == ["x", "y", "z"]
    counts = {name: collections.Counter() for name in "xyz"}
    for text, lang in texts[:3]:
        padded = f"  {text}  "
        counts[lang].update(padded[i : i + 4] for i in range(len(padded) - 3) if padded[i : i + 4].strip())
    totals = {k: sum(c.values()) for k, c in counts.items()}
    for gram in set().union(*counts.values()):
        top = max(counts[k][gram] / totals[k] for k in counts)
        member = [counts[k][gram] >= L.LEAST_COUNT and counts[k][gram] / totals[k] >= L.LEAST_SHARE * top for k in "xyz"]
        found = np.array([int.from_bytes(gram.encode(), "little")], dtype=np.uint32)
        got = L.popcounts(model, found, np.zeros(1, np.int64), 1)[0] > 0
        assert all(g for g, m in zip(got, member) if m)
    rows = [("aa bb", ), ("ee ff gg",), ("123 ...",), (None,), ("",), ("qqqq",)]
    pred = [r["lang_pred"] for r in L.predict_languages(spark.createDataFrame(rows, "text string"), model).collect()]
    assert pred[:5] == ["x", "y", "und", "und", "und"] and pred[5] in "xyz"
    nothing = L.learn_languages(spark.createDataFrame([], "text string, lang string"))
    assert [r["lang_pred"] for r in L.predict_languages(spark.createDataFrame(rows[:1], "text string"), nothing).collect()] == ["und"]


def test_quality_of_held_out_texts(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = queries.op5(spark, SF).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.95
    assert all(r["predicted"] == 1 for r in held if r["quality"] == 1 and r["score"] > 0.5)


def test_votes_equal_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(Q, "BLOCK", 7)
    good = [(i, words(80, i, 300), 1) for i in range(20)]
    bad = [(100 + i, " ".join(["spam!!!"] * (10 + i)), 0) for i in range(20)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    model = Q.learn_quality(docs, docs)
    texts = pa.array([words(50, 900, 300), "spam!!! " * 9, "", None, "zzz qqq"], pa.string())
    rows = (Q.term_counts(texts) * model.rarity) @ model.axes
    for row, score, text in zip(rows, Q.vote(model, texts), texts.to_pylist()):
        size = math.sqrt(float((row**2).sum()))
        near = sorted(((float(row @ v) / size if size > 1e-9 else 0.0, l) for v, l in zip(model.vectors, model.labels)), key=lambda x: -x[0])[: Q.NEIGHBOURS]
        weight = [max(0.0, min(1.0, s)) ** Q.SHARPNESS for s, _ in near]
        plain = sum(w * l for w, (_, l) in zip(weight, near)) / sum(weight) if sum(weight) > 1e-12 else model.prior
        assert abs(plain - score) < 0.02, text
    assert Q.vote(model, texts)[0] > 0.9 and Q.vote(model, texts)[1] < 0.1 and Q.vote(model, texts)[2] == 0.5
    assert Q.learn_quality(docs, docs.filter("quality = 1")) is None
    assert [r["score"] for r in Q.score_quality(docs.limit(1), None).collect()] == [0.5]


def test_repeated_ids_reach_the_driver_once(spark, monkeypatch):
    rows = [(i % 4, words(20, i, 300) if i % 2 else "spam!!! " * (3 + i % 5), i % 2) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(5)
    fetched, frame = [], type(docs)
    plain = frame.toArrow
    monkeypatch.setattr(frame, "toArrow", lambda self: (fetched.append(plain(self)), fetched[-1])[1])
    model = Q.learn_quality(docs, docs)
    assert max(t.num_rows for t in fetched) == 4 and len(model.labels) == 4
    least = {i: min(Q.term_counts(pa.array([t])).astype("<f4").tobytes() for k, t, _ in rows if k == i) for i in range(4)}
    assert {r["__key"]: r["terms"] for r in fetched[-1].to_pylist()} == least


# Language model --------------------------------------------------------------------------------


def token_list(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + [None]


def test_base_scores_and_counts(spark):
    rows = [(i, t) for i, t in enumerate([words(60, 1, 30), words(40, 2, 30) + " NEW Words", None, "", " \n", "w1 w1 W1", words(60, 1, 30)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in M.score_texts(docs, "doc_id not in (1, 5)").collect()}
    counts = collections.Counter(w for i, t in rows if i not in (1, 5) for w in token_list(t))
    n, kinds = sum(counts.values()), len(counts)
    for i, t in rows:
        tokens, r = token_list(t), got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert abs(r["base_score"] - sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (kinds + 1))) for w in tokens)) < 1e-9
        assert r["score"] < 0 and abs(r["bits_per_byte"] + r["score"] * math.log2(10) / (len((t or "").encode()) + 1)) < 1e-9
    alone = M.score_texts(docs, "false").collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and abs(r["base_score"]) < 1e-9 for r in alone)


def random_model(seed=0):
    rng = np.random.default_rng(seed)
    table = lambda n: rng.normal(size=n).astype(np.float32)
    return M.Model(table(M.CODES), [table(M.SLOTS), table(M.SLOTS)], np.ones(M.CODES), np.ones(M.CODES), 10, 10)


def plain_code_score(model, code, contexts):
    """One text, token by token, with the same updates."""
    weights = np.tile(np.array(M.FIRST_WEIGHTS), (2, M.CODE_BITS, 1))
    refine, seen, total = np.zeros((M.CODE_BITS, 8)), np.zeros((M.CODES, 2)), 0.0
    for start in range(0, len(code), M.CHUNK):
        steps, shown, moved = np.zeros_like(weights), [], np.zeros_like(refine)
        for t in range(start, min(start + M.CHUNK, len(code))):
            node = 1
            for b in range(M.CODE_BITS):
                bit = int(code[t]) >> (M.CODE_BITS - 1 - b) & 1
                own = seen[node]
                x = np.array([
                    model.plain[node], model.orders[0][contexts[0][t] * M.CODES + node], model.orders[1][contexts[1][t] * M.CODES + node],
                    math.log((own[1] + 0.4) / (own[0] + 0.4)),
                ])
                gate = int(own.sum() > 0)
                odds = float(weights[gate, b] @ x)
                bucket = int(min(max(odds + 4, 0), 7))
                odds = min(max(odds + refine[b, bucket], -12), 12)
                total -= math.log1p(math.exp(-odds if bit else odds))
                error = bit - 1 / (1 + math.exp(-odds))
                steps[gate, b] += error * x
                moved[b, bucket] += error
                shown.append((node, bit))
                node = node << 1 | bit
        weights += M.RATE * steps
        refine += M.REFINE_RATE * moved
        for node, bit in shown:
            seen[node, bit] += 1
    return total


def test_code_scores_equal_a_token_by_token_version():
    model = random_model()
    tokens = M.tokens_of(pa.array([words(90, 1, 50), "", words(33, 2, 50), None, "a b"], pa.string()))
    contexts = M._contexts(tokens)
    for i, got in enumerate(M.code_scores(model, tokens)):
        a, b = tokens.first[i], tokens.first[i + 1]
        plain = plain_code_score(model, tokens.code[a:b], [c[a:b] for c in contexts])
        assert abs(plain - got) < 1e-3 * max(1, abs(plain))


def test_probabilities_of_all_codes_sum_to_one():
    model = random_model(4)
    codes = np.arange(M.CODES)
    tokens = M.Tokens(codes.astype(np.uint64), codes, np.arange(M.CODES + 1))
    assert abs(np.exp(M.code_scores(model, tokens)).sum() - 1) < 1e-4


def test_model_beats_the_base_on_held_out_texts(spark):
    rows = [r for r in queries.op7(spark, SF).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > 0.97 * sum(r["base_score"] for r in rows)


def test_bit_tables_count_all_texts(spark):
    texts = [words(50, i, 20) for i in range(9)]
    plain, orders = M.learn_bits(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4))
    tokens = M.tokens_of(pa.array(texts))
    nodes, bits = M._nodes(tokens.code)
    seen, ones = (np.bincount(n.ravel(), minlength=M.CODES) for n in (nodes, nodes[bits == 1]))
    used = seen > 0
    assert np.allclose(plain[used], np.log((ones + 0.4) / (seen - ones + 0.4))[used], atol=1e-5)
    slot = (M._contexts(tokens)[1][:, None] * M.CODES + nodes).ravel()
    assert np.count_nonzero(orders[1]) <= len(np.unique(slot)) and orders[1][slot].any()


@pytest.mark.parametrize("total, weights, limits, expected", [
    (10, [5, 2, 1], [100, 100, 100], [6.25, 2.5, 1.25]), (12, [5, 2, 1], [4, 100, 100], [4, 16 / 3, 8 / 3]),
    (99, [1, 1], [3, 4], [3, 4]), (5, [1, 1], [0, 9], [0, 5]), (0, [1], [4], [0]),
])
def test_shares_stop_at_limits(total, weights, limits, expected):
    assert np.allclose(share_out(total, weights, limits), expected)
