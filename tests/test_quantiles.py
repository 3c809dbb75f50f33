import math
import random

import numpy as np
import pandas as pd
import pytest

from plumbline.operators.quantiles import quantiles, summary

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def frame(spark, values):
    return spark.createDataFrame(pd.DataFrame({"x": pd.Series(values, dtype="float64")}))


def shapes():
    rng = np.random.default_rng(7)
    yield "uniform", rng.random(3000) * 100 - 50
    yield "heavy tail", np.exp(rng.normal(0, 8, 3000))
    yield "one value holds a third", np.concatenate([np.full(1000, 4.25), rng.normal(4, 3, 2000)])
    yield "two values", np.array([1.0] * 700 + [2.0] * 800)
    yield "tiny and huge", np.array([5e-324, 0.0, 1e-300, 1e300, -1e308, 1.7e308, -1.7e308] * 200)
    yield "neighbouring floats", np.array([1.0, math.nextafter(1.0, 2), math.nextafter(1.0, 0)] * 400)
    yield "constant", np.full(1500, -3.5)
    yield "whole numbers", rng.integers(0, 40, 2500).astype(float)


@pytest.mark.parametrize("name,values", list(shapes()), ids=[n for n, _ in shapes()])
@pytest.mark.parametrize("limit", [100_000, 30])
def test_equals_pandas(spark, name, values, limit):
    got = quantiles(frame(spark, values), ["x"], PROBS, rank_limit=limit)["x"]
    ordered = sorted(values)
    for p, q in zip(PROBS, got):
        at = p * (len(ordered) - 1)
        low, high = float(ordered[math.floor(at)]), float(ordered[math.ceil(at)])
        want = low if low == high else low + (high - low) * (at - math.floor(at))
        assert q == pytest.approx(want, rel=1e-12, abs=0), p


def test_missing_values_and_empty_input(spark):
    df = spark.createDataFrame(
        [(1, None, float("nan")), (2, None, 1.0), (3, None, None), (10, None, 3.0)], "a int, b double, c double"
    )
    got = quantiles(df, ["a", "b", "c"], [0.25, 0.5])
    assert got == {"a": [1.75, 2.5], "b": [None, None], "c": [1.5, 2.0]}
    assert quantiles(df.filter("a > 99"), ["a"], [0.5]) == {"a": [None]}
    assert summary(df, ["c"])["c"].count == 2


def test_infinite_values(spark):
    values = [float("-inf"), float("inf")] + [random.Random(1).random() for _ in range(400)]
    got = quantiles(frame(spark, values), ["x"], [0.5], rank_limit=10)["x"][0]
    assert got == pytest.approx(float(np.median(values)))


def test_the_number_of_jobs_does_not_depend_on_the_spread(spark):
    rng = np.random.default_rng(3)
    tracker = spark.sparkContext.statusTracker()
    jobs = []
    for values in (rng.random(300_000), np.exp(rng.normal(0, 20, 300_000))):
        df = frame(spark, values).repartition(4)
        group = f"quantiles-{len(jobs)}"
        spark.sparkContext.setJobGroup(group, group)
        got = quantiles(df, ["x"], [0.25, 0.5], rank_limit=1_000)["x"]
        assert got == [pytest.approx(float(np.quantile(values, p)), rel=1e-9) for p in (0.25, 0.5)]
        jobs.append(len(tracker.getJobIdsForGroup(group)))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[0] == jobs[1] < 16


def test_wide_tables_go_in_batches(spark):
    df = spark.range(50).selectExpr(*[f"id * {i + 1} AS c{i}" for i in range(70)])
    got = quantiles(df, df.columns, [0.5], rank_limit=10)
    assert all(got[f"c{i}"] == [24.5 * (i + 1)] for i in range(70))
