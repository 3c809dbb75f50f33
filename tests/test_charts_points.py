"""Point reduction for charts."""

import datetime as dt

import numpy as np

from plumbline.operators import charts


def plain_ends(points, pixels):
    low, high = min(t for t, _ in points), max(t for t, _ in points)
    cells = {}
    for t, v in points:
        at = 0 if high == low else min(int((t - low) / (high - low) * pixels), pixels - 1)
        cells.setdefault(at, []).append((t, v))
    out = set()
    for at, ps in cells.items():
        by_value = sorted(ps, key=lambda p: (p[1], p[0]))
        out |= {(at, *p) for p in (min(ps), max(ps), by_value[0], by_value[-1])}
    return out


def test_trend_points_keep_the_picture(spark):
    r, start = np.random.default_rng(1), dt.datetime(2024, 1, 1)
    points = [(int(s), float(v)) for s, v in zip(r.integers(0, 10_000, 3000), r.integers(0, 50, 3000))]
    rows = [(start + dt.timedelta(seconds=s), v) for s, v in points] + [(None, 1.0), (start, None), (start, float("nan"))]
    df = spark.createDataFrame(rows, "t timestamp_ntz, v double")
    got = charts.trend_points(df, "t", "v", 40).collect()
    assert {(p["pixel"], int((p["time"] - start).total_seconds()), p["value"]) for p in got} == plain_ends(points, 40)
    assert len(got) <= 160
    one = charts.trend_points(df.limit(0).union(spark.createDataFrame([(start, 2.0)], df.schema)), "t", "v").collect()
    assert [(p["pixel"], p["value"]) for p in one] == [(0, 2.0)]
    assert charts.trend_points(df.limit(0), "t", "v").collect() == []


def test_scatter_grid_counts_every_point(spark):
    r = np.random.default_rng(2)
    rows = [(float(a), float(b)) for a, b in r.normal(size=(2000, 2))] + [(None, 1.0), (1.0, None)]
    got = charts.scatter_grid(spark.createDataFrame(rows, "x double, y double"), "x", "y", 20, 10).collect()
    assert len(got) <= 200 and sum(p["n"] for p in got) == 2000
    assert all(0 <= p["column"] < 20 and 0 <= p["row"] < 10 for p in got) and {(p["x"], p["y"]) for p in got} <= set(rows)
    flat = charts.scatter_grid(spark.createDataFrame([(1.0, 1.0)] * 5, "x double, y double"), "x", "y").collect()
    assert [(p["column"], p["row"], p["n"]) for p in flat] == [(0, 0, 5)]
