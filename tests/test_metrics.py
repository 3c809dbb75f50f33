"""States of slices: merged, replaced, and compared with the whole table."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import stats
from plumbline.plans import metrics as M


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, float(i * i % 997) if i % 13 else None, i % 7, "v" + str(i % 5), None if i % 3 else "t") for i in range(3000)]
    return spark.createDataFrame(data, "id long, x double, k int, s string, u string")


def sliced(spark, rows, path, parts=3):
    kept = M.Metrics(spark, str(path))
    for p in range(parts):
        kept.add(rows.filter(F.col("id") % parts == p), f"day-{p}")
    return kept


def numbers(df):
    return {r["column"]: {c: r[c] for c in ("count", "mean", "std", "min", "q1", "median", "q3", "max")} for r in df.collect()}


def test_merged_states_equal_the_whole_table(spark, rows, tmp_path):
    kept = sliced(spark, rows, tmp_path)
    assert kept.slices() == ["day-0", "day-1", "day-2"]
    want, exact, merged = numbers(stats.basic_stats(rows)), numbers(kept.exact_stats(rows)), numbers(kept.basic_stats())
    for c in want:
        for f in want[c]:
            assert exact[c][f] == pytest.approx(want[c][f], rel=1e-9), (c, f)
            if f not in ("q1", "median", "q3"):
                assert merged[c][f] == pytest.approx(want[c][f], rel=1e-9), (c, f)
    near = {r["column"]: r["distinct"] for r in kept.basic_stats().collect()}
    assert abs(near["id"] - 3000) < 100 and near["k"] == 7
    left, right = ({(r["col1"], r["col2"]): r["r"] for r in df.collect()} for df in (kept.corr_matrix(), stats.corr_matrix(rows)))
    assert left.keys() == right.keys() and all(left[k] == pytest.approx(right[k], abs=1e-9) for k in left)


def test_adding_a_slice_reads_that_slice_alone_and_again_replaces_it(spark, rows, tmp_path):
    kept = sliced(spark, rows, tmp_path, 2)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    extra = rows.limit(40).mapInArrow(counted, rows.schema)
    kept.add(extra, "more")
    assert 40 <= read.value <= 40 * 4
    assert numbers(kept.basic_stats())["id"]["count"] == 3040
    kept.add(rows.limit(10), "more")
    assert numbers(kept.basic_stats())["id"]["count"] == 3010 and len(kept.slices()) == 3
    before = read.value
    kept.basic_stats().collect()
    kept.top_values().collect()
    assert read.value == before


def test_frequent_values_have_bounds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "KEPT", 3)
    kept = M.Metrics(spark, str(tmp_path))
    for name, text in (("a", "aaaabbbccd"), ("b", "ddddaaab")):
        kept.add(spark.createDataFrame([(c,) for c in text], "s string"), name)
    got = {r["value"]: (r["at_least"], r["at_most"]) for r in kept.top_values(9).collect()}
    assert got == {"a": (7, 7), "b": (4, 4), "c": (2, 3), "d": (4, 6)}


def test_empty_slices_gaps_and_names(spark, rows, tmp_path):
    kept = M.Metrics(spark, str(tmp_path))
    kept.add(rows.limit(0), "007")
    kept.add(rows.filter("id < 5").withColumn("x", F.lit(None).cast("double")), "7")
    assert kept.slices() == ["007", "7"]
    got = numbers(kept.basic_stats())
    assert got["id"]["count"] == 5 and got["x"] == dict.fromkeys(got["x"], None) | {"count": 0}
    assert got["id"]["std"] == pytest.approx(2.5**0.5)
    with pytest.raises(ValueError):
        kept.add(rows, "../x")


def test_wrong_hints_cost_time_but_no_result(spark, rows):
    from plumbline.operators.quantiles import quantiles

    want = quantiles(rows, ["x", "k"], [0.25, 0.5])
    assert quantiles(rows, ["x", "k"], [0.25, 0.5], hints={"x": [(-5.0, -4.0), (0.0, 900.0)], "k": [(1.0, 1.0), (3.0, 3.0)]}) == want


def test_merged_metrics_copy_no_rows_per_column(spark):
    from workload import files, registry  # noqa: F401  (importing registers the queries)

    held = registry.QUERIES["metrics_merged"](spark, "/root/testdata/sf0.001")
    assert "Expand" not in held._jdf.queryExecution().toString()
    assert [(r["ranks_hold"], r["distinct_holds"]) for r in held.collect()] == [(True, True)] * 8
