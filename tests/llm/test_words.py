import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from plumbline.llm import words as W
from plumbline.llm.common import Workspace, blocks, id_bitmap, in_bitmap
from plumbline.llm.components import connected_components
from tests.llm.conftest import edge_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n\x0bé Z", max_size=60)), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    found = W.split_words(pa.array(texts, pa.string()))
    listed = [WORD.findall(t or "") for t in texts]
    assert found.counts.tolist() == [len(x) for x in listed]
    assert [w.decode() for w in W.spell(found, np.arange(len(found.start)))] == [w for x in listed for w in x]
    hashes = W.hash_words(found).tolist()
    flat = [w for x in listed for w in x]
    assert all((a == b) == (x == y) for a, x in zip(hashes, flat) for b, y in zip(hashes, flat))


def test_slices_and_long_words():
    texts = pa.array(edge_texts(), pa.string())
    whole = W.hash_words(W.split_words(texts))
    parts = [W.hash_words(W.split_words(texts.slice(i, 3))) for i in range(0, len(texts), 3)]
    assert (np.concatenate(parts) == whole).all()


def test_grams_are_equal_where_sequences_are():
    items = W.mix(np.arange(300, dtype=np.uint64) % np.uint64(7))
    for n in (1, 2, 3, 5, 20, 50):
        got = W.hash_grams(items, n)
        assert len(got) == 300 - n + 1
        assert all((got[i] == got[j]) == (i % 7 == j % 7) for i in range(0, len(got), 11) for j in range(len(got)))
    assert len(W.hash_grams(items[:3], 5)) == 0


def test_blocks_hold_all_rows_in_order():
    batch = pa.RecordBatch.from_pydict({"text": [None, "a" * 10, "", "b" * 30, "c"], "n": [0, 1, 2, 3, 4]})
    parts = list(blocks(batch, "text", 12))
    assert [n for p in parts for n in p.column(1).to_pylist()] == [0, 1, 2, 3, 4] and len(parts) >= 2


def test_bitmap_never_loses_an_id(spark):
    ids = spark.range(0, 1000, 7).withColumnRenamed("id", "k")
    bitmap = id_bitmap(ids, "k", 1 << 12)
    rows = spark.range(1000).selectExpr("id AS k", "concat('t', id) AS text")
    inside = {r["k"] for r in in_bitmap(rows, "k", bitmap).collect()}
    outside = {r["k"] for r in in_bitmap(rows, "k", bitmap, inside=False).collect()}
    assert inside >= set(range(0, 1000, 7)) and inside | outside == set(range(1000)) and not inside & outside


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))] + [(500 + i, 501 + i) for i in range(40)] + [(900, 700 + i) for i in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r["vertex"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long"), Workspace(spark)).collect()}
    assert got == {v: find(v) for v in list(root)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Workspace(spark)).count() == 0
