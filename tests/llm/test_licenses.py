"""Licence scans against exhaustive alignment, and their spans."""

import random

import numpy as np
import pyarrow as pa

from plumbline.llm import licenses as L
from plumbline.llm.contamination import normal_words
from tests.llm.conftest import words

MIT = L.TEMPLATES["MIT notice"]


def common(a, b):
    """Longest common subsequence, in full."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_alignment_equals_the_full_one_inside_the_band():
    r = random.Random(3)
    for _ in range(60):
        template = np.array([r.randrange(1, 9) for _ in range(r.randrange(3, 30))], np.uint64)
        edited = [x for x in template.tolist() if r.random() > 0.1]
        text = np.array([99] * L.BAND + edited + [77] * L.BAND, np.uint64)
        matched, start, stop = L.align(template, text)
        assert matched == common(template.tolist(), text.tolist()) and 0 <= start < stop <= len(text)


def test_every_window_keeps_a_fingerprint():
    grams = np.random.default_rng(1).integers(0, 50, 200).astype(np.uint64)
    for window in (1, 2, 5):
        kept = set(L.winnow(grams, window).tolist())
        assert all(any(p in kept for p in range(i, i + window)) for i in range(200 - window + 1))
    assert len(L.winnow(grams[:0])) == 0 and len(L.winnow(grams[:1])) == 1


def test_places_coverage_and_edits(spark):
    edited = MIT.split()
    edited[5] = "changed"
    del edited[12]
    rows = [
        (1, words(30, 1) + " " + MIT + " " + words(20, 2)), (2, words(10, 3) + "\n" + " ".join(edited).upper()), (3, words(200, 4)), (4, None), (5, ""),
        (6, "Released under the MIT License.\n" + words(40, 5) + "\nReleased under the MIT License."), (7, " ".join(MIT.split()[:12])),
        (8, words(20_000, 6, 5_000) + " " + L.TEMPLATES["GPL-3.0"]), (None, "Released under the MIT License."),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, licenses string")
    got = {r["doc_id"]: [(m["template"], m["start"], m["stop"], m["matched"]) for m in r["licenses"]] for r in L.scan_licenses(docs).collect()}
    size = len(normal_words(pa.array([MIT]))[0])
    assert got[1] == [("MIT notice", 30, 30 + size, size)]
    assert got[2] == [("MIT notice", 10, 10 + size - 1, size - 2)]
    assert got[3] == got[4] == got[5] == got[7] == []
    assert got[6] == [("MIT", 0, 5, 5), ("MIT", 45, 50, 5)] and got[None] == [("MIT", 0, 5, 5)]
    assert got[8] == [("GPL-3.0", 20_000, 20_012, 12)]
    assert all(r["licenses"] == [] for r in L.scan_licenses(docs, {}).collect())
    assert L.scan_licenses(docs.limit(0)).count() == 0
