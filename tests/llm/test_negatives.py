"""Hard negatives against all pairs, and what the intervals promise."""

import numpy as np
import pytest

from plumbline.llm import negatives as N


def plain(rows, anchors, positives=5, negatives=3):
    """All scores of all pairs, in Python integers."""
    usable = [(i, l, v) for i, l, v in rows if i is not None and l is not None and v and None not in v]
    first = {}
    for row in usable:
        if row[0] in anchors and (row[0] not in first or row[1:] < first[row[0]][1:]):
            first[row[0]] = row
    out = []
    for a, label, q in first.values():
        scored = [(-sum(x * y for x, y in zip(q, v)), i, l) for i, l, v in usable if i != a and len(v) == len(q)]
        for score, p, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            fit = sorted((s, i) for s, i, l in scored if l != label and 50 * -score <= 100 * -s <= 95 * -score)
            out += [(a, p, k + 1, i, -score, -s) for k, (s, i) in enumerate(fit[:negatives])]
    return sorted(out)


def clustered(n, width, seed, spread):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, width))
    return [(int(i), int(i // 6 % 3), np.floor(40 * (centres[i % 6] + spread * r.normal(size=width))).astype(int).tolist()) for i in range(n)]


def mined(spark, rows, anchors, **more):
    df = spark.createDataFrame(rows, "id long, label int, vector array<long>").repartition(3)
    out = N.mine_negatives(df, spark.createDataFrame([(a,) for a in anchors], "id long"), **more)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("width, spread", [(5, 0.5), (64, 0.3), (130, 1.0)])
def test_equals_all_pairs_in_several_parts(spark, width, spread):
    rows = clustered(400, width, width, spread)
    anchors = list(range(0, 400, 20))
    want = plain(rows, anchors)
    assert want and mined(spark, rows, anchors, block=64) == want
    assert mined(spark, rows, anchors) == want


def test_ties_repeats_gaps_and_lengths(spark):
    rows = clustered(60, 4, 1, 0.2) + [(100 + i, i % 2, [1, 2, 3, 4]) for i in range(40)]
    rows += [(0, 0, [5, 5, 5, 5]), (0, 1, [5, 5, 5, 5]), (100, 0, [1, 2, 3, 4])] * 2
    rows += [(None, 0, [1, 1, 1, 1]), (200, None, [1, 1, 1, 1]), (201, 0, None), (202, 0, []), (203, 0, [None, 1, 1, 1]), (204, 1, [0, 0, 0, 0])]
    rows += [(300 + i, i % 2, [i - 5, 7]) for i in range(12)]
    anchors = [0, 20, 100, 200, 201, 202, 203, 204, 300, 305, 999, None]
    want = plain(rows, anchors)
    assert any(a == 300 for a, *_ in want) or any(a == 305 for a, *_ in want)
    assert mined(spark, rows, anchors, block=16) == want


def test_one_label_and_one_vector_hold_most_rows(spark):
    rows = [(i, 0 if i % 5 else 1, [3, 1, 2]) for i in range(300)] + [(1000 + i, 2, [i % 7, 2, 1]) for i in range(60)]
    anchors = [0, 1, 1000, 1003]
    assert mined(spark, rows, anchors, block=32) == plain(rows, anchors)


def test_large_components_are_scored_as_integers(spark):
    rows = [(i, i % 2, [3_000_000_001 - i % 3, 1, -i]) for i in range(12)]
    anchors = [0, 1]
    rows = [(i, l, [v[0] // 3, *v[1:]]) for i, l, v in rows]
    got = mined(spark, rows, anchors)
    assert got == plain(rows, anchors) == []
    rows = [(i, i % 2, [(1_000_000_001 - i) * (2 if i % 2 == 0 else 1), 1, -i]) for i in range(12)]
    assert mined(spark, rows, [0]) == plain(rows, [0]) != []


def test_empty_tables(spark):
    assert mined(spark, [], [1]) == [] and mined(spark, clustered(10, 3, 2, 0.1), []) == []


@pytest.mark.parametrize("width", [1, 3, 64, 65, 200])
def test_intervals_hold_the_score(width):
    r = np.random.default_rng(width)
    rows = r.integers(-300, 300, (500, width))
    rows[:3] = 0
    rows[3:6] = rows[6]
    for centres in (np.zeros((1, width)), N.fit_centres(rows.astype(float)), rows[:1].astype(float)):
        codes = N.encode(rows, centres)
        assert codes.code.shape == (500, -(-width // 64)) and (codes.alignment <= 1 + 1e-9).all()
        low, high = N.intervals(rows[:40], codes, centres)
        score = rows[:40] @ rows.T
        assert (low <= score).all() and (score <= high).all()


def test_intervals_leave_out_what_is_far():
    rows = np.array([v for _, _, v in clustered(600, 256, 3, 0.1)])
    centres = N.fit_centres(rows.astype(float))
    low, high = N.intervals(rows[:6], N.encode(rows, centres), centres)
    floor = -np.partition(-low, 5, axis=1)[:, 5]
    assert (high >= floor[:, None]).mean() < 0.2


def test_windows_are_exact():
    p = np.array([0, 1, 2, 19, 20, 21, 39, 40, 2**61, 2**61 + 1])
    low, high = N.window_of(p)
    for s, a, b in zip(p.tolist(), low.tolist(), high.tolist()):
        assert 50 * s <= 100 * a and 50 * s > 100 * (a - 1) and 100 * b <= 95 * s and 100 * (b + 1) > 95 * s
