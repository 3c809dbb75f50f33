import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import charts, classify, cleaning, history, profile, stats
from plumbline.operators.ordered import forward_fill

SLEEP = "`Person ID` bigint, Gender string, `Sleep Duration` double, `Stress Level` int, Same int, Tags map<string,int>"


@pytest.fixture(scope="module")
def sleep(spark):
    rows = [
        (1, "F", 7.5, 3, 1, {"a": 1}), (2, "M", None, 8, 1, None), (3, "F", 6.0, 8, 1, {"b": 2}),
        (4, None, float("nan"), 5, 1, {"a": 1}), (5, "M", 8.25, 2, 1, {}), (5, "M", 8.25, 2, 1, {}),
    ]
    return spark.createDataFrame(rows, SLEEP)


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_column_profile_with_blanks_in_names_and_nested_cells(sleep):
    rows = by(profile.column_profile(sleep), "column")
    assert [rows[c]["num_missing"] for c in sleep.columns] == [0, 1, 2, 0, 0, 1]
    assert [rows[c]["num_unique"] for c in sleep.columns] == [5, 2, 3, 4, 1, 3]
    assert rows["Sleep Duration"]["mean"] == pytest.approx(7.5) and rows["Sleep Duration"]["median"] == pytest.approx(7.875)
    assert [tuple(v) for v in rows["Gender"]["top_values"]] == [("M", 3), ("F", 2)]
    assert rows["Same"]["num_outliers"] == 0 and rows["Tags"]["mean"] is None


def test_duplicates_score_and_overview(sleep):
    assert profile.duplicate_count(sleep).first()[0] == 1
    assert profile.quality_score(sleep).first()[0] == round((1 - 4 / 36) * 70 + (1 - 1 / 6) * 30, 2)
    assert profile.quality_score(sleep.limit(0)).first()[0] is None
    assert list(profile.overview(sleep).first()) == [6, 6, 4, 1, 4, 1]


def test_dataset_profile_sample_is_ordered(sleep):
    row = profile.dataset_profile(sleep, "csv", order_by=["Person ID"]).first()
    assert row["n_rows"] == 6 and len(row["sample"]) == 3 and '"Person ID":1' in row["sample"][0]


def test_approximate_forms_run(sleep):
    assert profile.nunique(sleep.drop("Tags"), approx=True).count() == 5
    assert stats.basic_stats(sleep, approx=True).count() == 4


def test_basic_column_counts_nan_as_missing(sleep):
    row = stats.basic_column(sleep, "Sleep Duration").first()
    assert (row["mean"], row["records"], row["missing"]) == (7.5, 6, 2)


def test_distribution_matches_pandas(spark):
    values = [1.0, 2.0, 3.0, 10.0]
    row = stats.distribution(spark.createDataFrame([(v,) for v in values], "x double"), "x").first()
    assert row["skew"] == pytest.approx(1.763632614803888) == pytest.approx(pd.Series(values).skew())
    assert (row["median"], row["skew_class"], row["direction"]) == (2.5, "high", "right")
    for few in ([], [3.0], [2.0, 2.0, 2.0]):
        row = stats.distribution(spark.createDataFrame([(v,) for v in few], "x double"), "x").first()
        assert row["skew"] is None and row["skew_class"] == "normal"


def test_correlations_equal_pandas_with_gaps_and_constants(spark):
    frame = pd.DataFrame(
        {
            "a": [1.0, 2, 3, 4, 5, 6], "b": [2.0, None, 5, 9, 10, 12], "c": [5.0, 4, 4, 2, None, 0],
            "k": [1.0] * 6, "d": [1e6 + v for v in (3, 1, 2, 6, 4, 5)],
        }
    )
    want = frame.corr()
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in frame.itertuples(index=False)]
    for row in stats.corr_matrix(spark.createDataFrame(rows, "a double, b double, c double, k double, d double")).collect():
        r = want.loc[row["col1"], row["col2"]]
        if math.isnan(r):
            assert row["r"] is None
        else:
            assert row["r"] == pytest.approx(r, abs=1e-7)


def test_corr_findings_keep_column_order(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, -1.0 * i, (i * 7) % 5 * 1.0) for i in range(50)], "a double, b double, c double, d double")
    found = [(r["col1"], r["col2"], r["strength"], r["direction"]) for r in stats.corr_findings(stats.corr_matrix(df)).collect()]
    assert found == [("a", "b", "strong", "positive"), ("a", "c", "strong", "negative"), ("b", "c", "strong", "negative")]


def test_histogram_counts_all_and_survives_a_constant(spark):
    df = spark.createDataFrame([(float(i % 17),) for i in range(500)] + [(None,)], "x double")
    rows = charts.histogram(df, "x").collect()
    assert len(rows) == 30 and sum(r["n"] for r in rows) == 500
    flat = charts.histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x").collect()
    assert sum(r["n"] for r in flat) == 2 and charts.histogram(df.limit(0), "x").count() == 0


def test_trend_line_and_chart_choice(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-05 10:00:00' + make_interval(0,0,0,id) AS made_date, cast(id AS double) AS v FROM range(40)")
    rows = charts.chart_data(df, "trend").collect()
    assert {r["time"].month for r in rows} == {1, 2} and len(rows) == 2
    assert charts.chart_data(df, "trend", unit=None).count() == 40
    assert charts.chart_data(df.select("v"), "trend") is None and charts.chart_data(df, "comparison") is None
    assert charts.scatter_points(df.withColumn("w", F.col("v")), "v", "w").count() == 40


def test_density_integrates_to_about_one(spark):
    df = spark.createDataFrame([(float((i * 37) % 101),) for i in range(1000)], "x double")
    rows = sorted((r["x"], r["density"]) for r in charts.violin_density(df, "x").collect())
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(rows, rows[1:]))
    assert 0.8 < area < 1.01


def test_zscore_and_iqr_outliers(spark):
    df = spark.createDataFrame([(float(i % 10),) for i in range(100)] + [(500.0,), (None,)], "x double")
    assert [r[0] for r in stats.zscore_outliers(df, "x").collect()] == [500.0]
    assert [r[0] for r in stats.iqr_outliers(df, "x").collect()] == [500.0]
    assert stats.zscore_outliers(df.filter("x = 1"), "x").count() == 0


def test_imputation(spark):
    df = spark.createDataFrame([(1, 2.0, "b"), (2, None, "a"), (3, 4.0, None), (4, 9.0, "a"), (5, None, "b")], "i int, x double, s string")
    assert [r["x"] for r in cleaning.impute_mean(df, ["x"]).orderBy("i").collect()] == [2, 5, 4, 9, 5]
    assert [r["x"] for r in cleaning.impute_median(df, ["x"]).orderBy("i").collect()] == [2, 4, 4, 9, 4]
    assert [r["s"] for r in cleaning.impute_mode(df).orderBy("i").collect()] == ["b", "a", "a", "a", "b"]
    assert [r["s"] for r in cleaning.impute_unknown(df).orderBy("i").collect()][2] == "Unknown"
    blank = spark.createDataFrame([(None,), (None,)], "s string")
    assert [r[0] for r in cleaning.impute_mode(blank).collect()] == ["Unknown"] * 2


def test_capping_keeps_nulls_and_is_idempotent_with_the_same_fences(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 100)] + [(None,)], "x double")
    low, high = stats.iqr_fences(df, ["x"])["x"]
    capped = cleaning.cap_outliers(df)
    values = [r[0] for r in capped.collect()]
    assert values.count(None) == 1 and max(v for v in values if v is not None) == high
    assert sorted(v for v in values if v is not None)[0] >= low


def test_forward_fill_with_one_key_holding_most_rows(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = []
    for i in range(4000):
        key = None if i % 50 == 0 else ("hot" if i % 3 else f"k{i % 7}")
        value = float(i) if rng.random() < 0.02 else None
        rows.append((key, int(i // 4), i, value, str(i) if value and i % 2 else None))
    df = spark.createDataFrame(rows, "k string, t int, id int, x double, s string")
    got = {r["id"]: (r["x"], r["s"]) for r in forward_fill(df, ["x", "s"], ["t", "id"], ["k"]).collect()}
    last: dict = {}
    for key, t, i, x, s in sorted(rows, key=lambda r: (r[1], r[2])):
        old = last.get(key, (None, None))
        last[key] = (old[0] if x is None else x, old[1] if s is None else s)
        assert got[i] == last[key]
    whole = {r["id"]: r["x"] for r in forward_fill(df, ["x"], ["t", "id"]).collect()}
    carried = None
    for _, t, i, x, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        carried = carried if x is None else x
        assert whole[i] == carried


@pytest.mark.parametrize(
    "sample,other",
    [
        ("2024-01-05", "2024-1-6"), ("25/12/2023", "3/4/2024"), ("12/25/2023", "1/2/2024"), ("2024/01/05", "2024/2/6"),
        ("25-12-2023", "1-2-2024"), ("12-25-2023", "1-2-2024"), ("20240105", "20240206"), ("05.01.2024", "6.2.2024"),
        ("2024-01-05 10:11:12", "2024-01-05 1:2:3"), ("25/12/2023 10:11:12", "1/2/2024 1:1:1"),
    ],
)
def test_standardize_types_finds_the_format(spark, sample, other):
    df = spark.createDataFrame([(1, None, "12"), (2, sample, "7"), (3, other, "8"), (4, "bad", "9")], "i int, join_date string, digits string")
    out = cleaning.standardize_types(df, ["i"])
    assert dict(out.dtypes) == {"i": "int", "join_date": "timestamp_ntz", "digits": "bigint"}
    rows = [r["join_date"] for r in out.orderBy("i").collect()]
    assert rows[0] is None and rows[1] is not None and rows[2] is not None and rows[3] is None


def test_clean_strings_by_column_name(spark):
    df = spark.createDataFrame([(" o'neil ", "ab-1 ", "Ünder, x", None)], "name string, code string, remark string, title string")
    assert list(cleaning.clean_strings(df).first()) == ["ONeil", "AB1", "nder x", None]
    assert cleaning.clean_strings(df, ascii_only=False).first()["remark"] == "Ünder x"


def test_sanitize_only_touches_date_columns(spark):
    df = spark.createDataFrame([(" a ", "2024-01-02", "nan", "")], "description string, my_date string, x string, y string")
    assert dict(cleaning.sanitize(df).dtypes)["description"] == "string"
    row = cleaning.sanitize(df).first()
    assert row["description"] == "a" and row["my_date"].year == 2024 and row["x"] is None and row["y"] is None
    assert cleaning.sanitize(df, legacy_d_prefix=True).first()["description"] is None


def test_ranges_and_years(spark):
    df = spark.createDataFrame([(-3, 2e6, 9), (50, 10.0, 3), (None, None, None)], "age int, salary double, rating int")
    assert [tuple(r) for r in cleaning.validate_ranges(df).collect()] == [(0, 1e6, 5), (50, 10.0, 3), (None, None, None)]
    assert [r["invalid"] for r in cleaning.invalid_counts(df).orderBy("ordinal").collect()] == [1, 1, 1]
    dated = spark.sql("SELECT timestamp_ntz'2023-05-06 00:00:00' AS order_date, date'2020-01-01' AS born")
    assert cleaning.year_features(dated).columns == ["order_date", "born", "order_date_year"]


def test_clean_structured_and_its_report(sleep):
    plain = sleep.drop("Tags")
    out = cleaning.clean_structured(plain)
    assert out.filter("`Sleep Duration` IS NULL OR Gender IS NULL").count() == 0 and out.count() == 6
    plan = cleaning.CleaningPlan("median", "mode", drop_duplicates=True, cap_outliers=True, title_text=True)
    assert cleaning.clean_structured(plain, plan).count() == 5
    report = cleaning.cleaning_report(plain, "sleep", plan).collect()
    assert {r["step"] for r in report} == {"fill missing", "cap outliers", "title case", "drop duplicates"}
    none = cleaning.CleaningPlan(numbers=None, strings=None)
    assert cleaning.cleaning_report(plain, "sleep", none).count() == 0
    summary = cleaning.cleaning_summary(out.dropDuplicates(), plain).first()
    assert summary["rows_removed"] == 1 and summary["missing_values_removed"] == 3


def test_impute_all_fills_times_in_order(spark):
    df = spark.sql("SELECT id, IF(id % 2 = 0, timestamp_ntz'2024-01-01 00:00:00', NULL) AS seen, 's' AS s FROM range(4)")
    assert cleaning.impute_all(df, ["id"]).filter("seen IS NULL").count() == 0


def test_comprehensive_bundle(sleep):
    bundle = stats.comprehensive(sleep.drop("Tags"))
    assert {k: v.count() for k, v in bundle.items()} == {
        "descriptive_stats": 8, "correlation_matrix": 16, "data_types": 5, "unique_values": 5, "missing_values": 5,
    }


def test_long_digit_strings_are_kept(spark):
    long, longer = "12345678901234567890123", "1" * 40
    df = spark.createDataFrame([("7", long, longer)], "a string, b string, c string")
    out = cleaning.standardize_types(df, ["a"])
    assert dict(out.dtypes) == {"a": "bigint", "b": "decimal(38,0)", "c": "string"}
    row = out.first()
    assert (row["a"], int(row["b"]), row["c"]) == (7, int(long), longer)


def test_untouched_integers_keep_type_and_value(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(big, None, 1.0), (big + 1, 2, 2.0), (big + 2, 4, 900.0)], "k bigint, g int, x double")
    for out in (cleaning.impute_mean(df), cleaning.impute_median(df)):
        assert dict(out.dtypes) == {"k": "bigint", "g": "double", "x": "double"}
        assert sorted((r["k"], r["g"]) for r in out.collect()) == [(big, 3.0), (big + 1, 2.0), (big + 2, 4.0)]
    capped = cleaning.cap_outliers(df)
    assert dict(capped.dtypes)["k"] == "bigint" and max(r["k"] for r in capped.collect()) == big + 2


def test_hot_keys_are_dealt_among_tasks(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        asked = spark.range(2000).selectExpr("id AS q_id", "if(id % 10 = 0, concat('d', id), 'hot') AS dataset", "concat('compare a ', id) AS question")
        columns = spark.createDataFrame([("hot", 0, "a", "numeric"), ("hot", 1, "b", "categorical")], "dataset string, ordinal int, column_name string, kind string")
        sessions = asked.selectExpr("dataset", "q_id AS session_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "question", "question AS key_finding").limit(50)
        pictures = spark.createDataFrame([("hot", "x.png")], "dataset string, path string").withColumn("made", F.expr("timestamp_ntz'2024-01-01 00:00:30'"))
        placed = asked.selectExpr("dataset", "q_id AS session_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts")
        joined = {
            "intent": (classify.question_intent(asked, columns), 2000), "target": (stats.target_column(asked, columns), 2000),
            "match": (history.match_artifacts(placed, pictures), 2000),
        }
        for name, (df, n) in joined.items():
            hot = df.filter("dataset = 'hot'").groupBy(F.spark_partition_id()).count().collect()
            assert df.count() == n and len(hot) >= 5, name
        assert history.context_retrieval(asked, sessions).count() > 0
        plan = history.context_retrieval(asked, sessions)._jdf.queryExecution().executedPlan().toString()
        assert "__salt" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_questions_on_unknown_datasets_are_kept(spark):
    asked = spark.createDataFrame([(1, "none", "show the trend")], "q_id int, dataset string, question string")
    columns = spark.createDataFrame([], "dataset string, ordinal int, column_name string, kind string")
    row = classify.question_intent(asked, columns).first()
    assert (row["chart"], row["analysis"]) == ("summary", "aggregation")
    assert stats.target_column(asked, columns).first()["target_column"] is None


def test_duplicates_tell_the_places_of_gaps_apart(spark):
    df = spark.createDataFrame([(None, 1), (1, None), (None, None), (None, None), (1, 1), (None, 1)], "a int, b int")
    assert profile.duplicate_count(df).first()[0] == 2
    assert profile.duplicate_count(df.limit(0)).first()[0] == 0


def test_only_frequent_keys_copy_the_lookup(spark, monkeypatch):
    from plumbline.operators import joins

    monkeypatch.setattr(joins, "FREQUENT", 1)
    probe = spark.createDataFrame([("a", i) for i in range(40)] + [("b", 40), (None, 41), ("z", 42)], "k string, i int")
    lookup = spark.createDataFrame([(k, ord(k)) for k in "abcdefgh"], "k string, v int")
    joined = joins.frequent_join(probe, lookup, ["k"], ["i"], "left")
    want = [(i, 97 if i < 40 else 98 if i == 40 else None) for i in range(43)]
    assert sorted((r["i"], r["v"]) for r in joined.collect()) == want
    # All keys of the lookup once, the frequent one 16 times.
    copies = joins.copies_of(lookup, joins.frequent_keys(probe, ["k"]), ["k"]).groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in copies} == {"a": 16, **{k: 1 for k in "bcdefgh"}}
