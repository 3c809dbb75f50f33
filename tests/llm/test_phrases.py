"""Phrases against plain counts; tries that burst and spill; odd tables."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import phrases as P
from plumbline.llm.common import Workspace


def plain_counts(docs):
    out = defaultdict(Counter)
    for text, lang in docs:
        if text is None:
            continue
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower):
            words = re.findall(r"[^ \t]+", piece)
            for n in range(1, 5):
                out["und" if lang is None else lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    return out


def plain(docs, least, top):
    rows = []
    for lang, f in plain_counts(docs).items():
        whole = sum(n for p, n in f.items() if len(p) == 1)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in found.items():
            inside = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= 80 * a for b in inside):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]], whole, score))
        rows += [(lang, i + 1, r[2].decode(), *r[3:]) for i, r in enumerate(sorted(ranked)[:top])]
    return sorted(rows)


def texts(n, seed, vocabulary=30):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        words = [f"w{int(x)}" for x in r.zipf(1.4, 40) % vocabulary]
        words[5:8] = ["New", "YORK", "city"]
        for at in r.integers(0, 40, 6):
            words[at] += "., ;\n\t!"[int(r.integers(0, 7))]
        out.append((" ".join(words), ["en", "de", None][i % 3] if i % 7 else "en"))
    return out


def mined(spark, docs, least=30, top=2_000):
    df = spark.createDataFrame(docs, "text string, lang string").repartition(4)
    out = P.mine_phrases(df, least, top)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, out.collect()))


def test_equals_plain_counts(spark):
    docs = texts(120, 1) + [("É é É é", "fr")] * 40 + [(None, "en"), ("", None), (" \n.;", "de"), ("a\x0bb\x0cc a b", "es")] * 35
    want = plain(docs, 30, 2_000)
    assert mined(spark, docs) == want and {r[0] for r in want} >= {"en", "de", "und", "fr", "es"}
    assert mined(spark, docs, 5, 7) == plain(docs, 5, 7)


def test_small_tries_burst_and_spill_without_loss(spark, monkeypatch):
    # Closures carry the constants of the module to the workers by reference, so a job of one process is looked at.
    monkeypatch.setattr(P, "BURST", 8)
    monkeypatch.setattr(P, "ENTRIES", 200)
    docs = texts(60, 2, 200)
    batch = [pa.RecordBatch.from_arrays([pa.array([l or P.UNKNOWN for _, l in part]), pa.array([t for t, _ in part])], names=["lang", "text"]) for part in (docs[:20], docs[20:25], docs[25:])]
    runs = list(P._count(1, 4)(iter(batch)))
    assert len(runs) > 3
    got, prefixes = defaultdict(Counter), {}
    for run in runs:
        rows = run.to_pylist()
        assert len({(r["lang"], r["phrase"]) for r in rows}) == len(rows)
        for r in rows:
            got[r["lang"]][tuple(r["phrase"].split(" ")) if r["phrase"] else ()] += r["n"]
            assert prefixes.setdefault((r["lang"], *r["phrase"].split(" ")[:2]), r["prefix"]) == r["prefix"]
    want = plain_counts(docs)
    for lang in want:
        assert got[lang].pop(()) == sum(n for p, n in want[lang].items() if len(p) == 1)
        assert got[lang] == want[lang]


def test_runs_are_sorted_by_words():
    docs = texts(20, 3)
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 20), pa.array([t for t, _ in docs])], names=["lang", "text"])
    (run,) = P._count(1, 4)(iter([batch]))
    words = [tuple(w.encode() for w in r["phrase"].split(" ")) for r in run.to_pylist() if r["phrase"]]
    assert words == sorted(words)


def test_a_trie_keeps_counts_when_it_bursts(monkeypatch):
    monkeypatch.setattr(P, "BURST", 4)
    monkeypatch.setattr(P, "HOT", 20)
    r = np.random.default_rng(5)
    trie, want = P.Trie(), Counter()
    for _ in range(30):
        head = np.minimum(r.integers(0, 6, 50), 2)
        suffix = (r.integers(1, 4, 50) << 42) | (r.integers(0, 4, 50) << 21) | r.integers(0, 9, 50)
        want.update(zip(head.tolist(), suffix.tolist()))
        trie.add(*P._distinct(head, suffix))
    assert isinstance(trie.root[2], P.Node) and trie.cold and trie.entries >= len(want)
    got = Counter()
    for left in (trie.entries // 4, 0):
        for h, s, c in zip(*(x.tolist() for x in trie.pop(left))):
            got[h, s] += c
    assert got == want and not trie.root and not trie.cold and trie.entries == 0


def test_crowded_pairs_get_longer_prefixes():
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de"]), pa.array(["a b c d a b e f", "a b c d"])], names=["lang", "text"])
    (run,) = P._count(3, 4, None, {("en", "a b")})(iter([batch]))
    prefixes = {(r["lang"], r["phrase"]): r["prefix"] for r in run.to_pylist()}
    assert prefixes["en", "a b c"] == prefixes["en", "a b c d"] != prefixes["en", "a b e"] == prefixes["en", "a b e f"]
    assert prefixes["de", "a b c"] == prefixes["de", "a b c d"] not in (prefixes["en", "a b c"], prefixes["en", "a b e"])


def test_the_bitmap_lets_every_frequent_pair_pass(spark):
    docs = texts(60, 4, 500)
    work = Workspace(spark)
    df = spark.createDataFrame(docs, "text string, lang string")
    got = {(r["lang"], r["phrase"]): r["n"] for r in P.count_phrases(df, 3, work).filter("words > 0").collect()}
    assert got == {(lang, " ".join(p)): n for lang, f in plain_counts(docs).items() for p, n in f.items() if n >= 3}


def test_one_text_of_many_blocks_and_one_pair_of_most_words(spark):
    docs = [("to be " * 250_000 + "or not", "en"), ("to be or not to be", None)]
    got = mined(spark, docs, 2)
    assert got == plain(docs, 2, 2_000) and got[0][3] > 200_000


def test_empty_table_and_no_frequent_phrase(spark):
    assert mined(spark, []) == [] and mined(spark, [("a b c", "en")]) == [] and mined(spark, [(None, None)]) == []


@pytest.mark.parametrize("a, l, r", [(5 * 10**12, 6 * 10**12, 7 * 10**12), (4 * 10**18, 4 * 10**18, 4 * 10**18)])
def test_scores_beyond_64_bits(spark, a, l, r):
    got = spark.sql(f"select (2000000 * cast({a}L as decimal(20,0))) div (cast({l}L as decimal(20,0)) + {r}L)").first()[0]
    assert got == 2_000_000 * a // (l + r)
