"""Profiles, statistics and chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.columns import time_like_columns
from plumbline.operators import charts, profile, stats
from plumbline.plans import reports
from plumbline.plans.answers import answer_multiple
from workload.registry import query, union_all

LINEITEM_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]
LINEITEM_STRINGS = ["l_returnflag", "l_linestatus"]
LINEITEM = [*LINEITEM_NUMBERS, *LINEITEM_STRINGS, "l_shipdate"]
LINEITEM_TYPES = ["bigint"] * 3 + ["int"] + ["double"] * 4 + ["string"] * 2 + ["timestamp_ntz"]
DIRTY = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def top_text(table: str, column: str, k: int) -> str:
    return (
        f"(SELECT string_agg(v || '=' || n, ', ' ORDER BY n DESC, v) FROM (SELECT {column} AS v, count(*) AS n "
        f"FROM {table} WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT {k}) top)"
    )


def profile_row(i: int, c: str) -> str:
    kind = LINEITEM_TYPES[i]
    base = (
        f"SELECT {i} AS ordinal, '{c}' AS \"column\", '{kind}' AS dtype, count(*) - count({c}) AS num_missing, "
        f"round((count(*) - count({c})) / count(*), 4) AS pct_missing, count(DISTINCT {c}) AS num_unique, "
    )
    x = f"cast({c} AS double)"
    if c in LINEITEM_NUMBERS:
        far = (
            f"(SELECT count(*) FROM lineitem, (SELECT avg({x}) AS m, stddev_samp({x}) AS s FROM lineitem) z "
            f"WHERE z.s > 0 AND abs({x} - z.m) > 3 * z.s)"
        )
        rest = (
            f"round(min({x}), 4) AS min, round(max({x}), 4) AS max, round(avg({x}), 4) AS mean, "
            f"round(quantile_cont({x}, 0.5), 4) AS median, round(stddev_samp({x}), 4) AS std, cast({far} AS double) AS num_outliers, "
            "NULL::VARCHAR AS min_date, NULL::VARCHAR AS max_date, NULL::VARCHAR AS top_values"
        )
    elif c in LINEITEM_STRINGS:
        rest = (
            "NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::VARCHAR, "
            f"NULL::VARCHAR, {top_text('lineitem', c, 5)}"
        )
    else:
        rest = (
            "NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, "
            f"cast(min({c}) AS VARCHAR), cast(max({c}) AS VARCHAR), NULL::VARCHAR"
        )
    return base + rest + " FROM lineitem"


@query("column_profile", union_all([profile_row(i, c) for i, c in enumerate(LINEITEM)]))
def column_profile(t):
    found = profile.column_profile(t("lineitem"))
    listed = F.transform("top_values", lambda v: F.concat(v["value"], F.lit("="), v["n"]))
    return found.withColumn("top_values", F.array_join(listed, ", ")).withColumn("num_outliers", F.col("num_outliers").cast("double"))


DUPLICATES = "(SELECT count(*) FROM orders_dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_dirty) u)"
MISSING = "(SELECT " + " + ".join(f"count(*) - count({c})" for c in DIRTY) + " FROM orders_dirty)"


@query("duplicate_count", f"SELECT {DUPLICATES} AS num_duplicates")
def duplicate_count(t):
    return profile.duplicate_count(t("orders_dirty"))


@query(
    "dataset_profile",
    f"""
SELECT 'csv' AS data_type, count(*) AS n_rows, 6 AS n_cols, '{",".join(DIRTY)}' AS columns, 1 AS document_count,
       {DUPLICATES} AS num_duplicates FROM orders_dirty
""",
)
def dataset_profile(t):
    return profile.dataset_profile(t("orders_dirty"), "csv").withColumn("columns", F.array_join("columns", ","))


@query(
    "overview",
    f"SELECT count(*) AS records, 6 AS features, 3 AS numeric, 2 AS categorical, {MISSING} AS missing, {DUPLICATES} AS duplicates FROM orders_dirty",
)
def overview(t):
    return profile.overview(t("orders_dirty"))


@query(
    "quality_score",
    f"""
SELECT round(((1 - {MISSING} / (count(*) * 6)) * 0.7 + (1 - ({DUPLICATES}) / count(*)) * 0.3) * 100, 2) AS quality_score
FROM orders_dirty
""",
)
def quality_score(t):
    return profile.quality_score(t("orders_dirty"))


@query(
    "nunique",
    union_all(
        [f"SELECT {i} AS ordinal, '{c}' AS \"column\", count(DISTINCT {c}) AS num_unique FROM orders_dirty" for i, c in enumerate(DIRTY)]
    ),
)
def nunique(t):
    return profile.nunique(t("orders_dirty"))


@query(
    "top_values",
    union_all(
        [
            f"""(SELECT '{c}' AS "column", {c} AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank
FROM part GROUP BY {c} ORDER BY n DESC, value LIMIT 5)"""
            for c in ["p_name", "p_brand", "p_type"]
        ]
    ),
)
def top_values(t):
    return profile.top_values(t("part"))


@query("head_sample", "SELECT * FROM orders_dirty ORDER BY o_orderkey, o_custkey LIMIT 3")
def head_sample(t):
    return profile.head_sample(t("orders_dirty"), ["o_orderkey", "o_custkey"])


def stats_row(table: str, i: int, c: str) -> str:
    x = f"cast({c} AS double)"
    return (
        f"SELECT {i} AS ordinal, '{c}' AS \"column\", round(avg({x}), 4) AS mean, round(stddev_samp({x}), 4) AS std, "
        f"round(min({x}), 4) AS min, round(quantile_cont({x}, 0.25), 4) AS q1, round(quantile_cont({x}, 0.5), 4) AS median, "
        f"round(quantile_cont({x}, 0.75), 4) AS q3, round(max({x}), 4) AS max, count({c}) AS count FROM {table}"
    )


@query("basic_stats", union_all([stats_row("lineitem", i, c) for i, c in enumerate(LINEITEM_NUMBERS)]))
def basic_stats(t):
    return stats.basic_stats(t("lineitem"))


DIRTY_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]
DESCRIPTIONS = {
    "count": "count({x})", "mean": "avg({x})", "std": "stddev_samp({x})", "min": "min({x})",
    "25%": "quantile_cont({x}, 0.25)", "50%": "quantile_cont({x}, 0.5)", "75%": "quantile_cont({x}, 0.75)", "max": "max({x})",
}


@query(
    "describe",
    union_all(
        [
            f"SELECT '{name}' AS statistic, "
            + ", ".join(f"round(cast({e.format(x=f'cast({c} AS double)')} AS double), 4) AS {c}" for c in DIRTY_NUMBERS)
            + " FROM orders_dirty"
            for name, e in DESCRIPTIONS.items()
        ]
    ),
)
def describe(t):
    return stats.describe(t("orders_dirty"))


def corr_cell(table: str, columns: list[str], i: int, j: int) -> str:
    a, b = columns[i], columns[j]
    return (
        f"SELECT {i} AS i, {j} AS j, '{a}' AS col1, '{b}' AS col2, "
        f"round(corr(cast({a} AS double), cast({b} AS double)), 4) + 0.0 AS r FROM {table}"
    )


@query("corr_matrix", union_all([corr_cell("lineitem", LINEITEM_NUMBERS, i, j) for i in range(8) for j in range(8)]))
def corr_matrix(t):
    return stats.corr_matrix(t("lineitem"))


PEOPLE = ["c_custkey", "c_acctbal", "age", "salary", "rating"]


@query(
    "corr_findings",
    f"""
WITH m AS ({union_all([corr_cell("people", PEOPLE, i, j) for i in range(5) for j in range(i + 1, 5)])})
SELECT col1, col2, r, CASE WHEN abs(r) > 0.7 THEN 'strong' ELSE 'moderate' END AS strength,
       CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction
FROM m WHERE abs(r) > 0.5 ORDER BY i, j LIMIT 3
""",
)
def corr_findings(t):
    return stats.corr_findings(stats.corr_matrix(t("people")))


EVENT_FENCES = """
SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3,
       q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM events
"""


@query(
    "iqr_outliers",
    f"WITH f AS ({EVENT_FENCES}) SELECT event_id, value FROM events, f WHERE value < lo OR value > hi",
)
def iqr_outliers(t):
    return stats.iqr_outliers(t("events"), "value").select("event_id", "value")


@query(
    "zscore_outliers",
    """
WITH m AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)
SELECT event_id, value FROM events, m WHERE abs(value - m) > 3 * s
""",
)
def zscore_outliers(t):
    return stats.zscore_outliers(t("events").select("event_id", "value"), "value")


@query(
    "distribution",
    f"""
WITH f AS ({EVENT_FENCES}), d AS (
  SELECT avg(value) AS mean, stddev_samp(value) AS std, skewness(value) AS skew, count(*) AS n,
         count(*) FILTER (value < lo OR value > hi) AS outliers, any_value(q2) AS median FROM events, f)
SELECT 'value' AS "column", round(mean, 4) AS mean, round(median, 4) AS median, round(std, 4) AS std,
       round(skew, 4) AS skew,
       CASE WHEN abs(skew) > 1 THEN 'high' WHEN abs(skew) > 0.5 THEN 'moderate' ELSE 'normal' END AS skew_class,
       CASE WHEN abs(skew) > 0.5 THEN CASE WHEN skew > 0 THEN 'right' ELSE 'left' END END AS direction,
       outliers, round(outliers * 100.0 / n, 4) AS outlier_pct
FROM d
""",
)
def distribution(t):
    return stats.distribution(t("events"), "value")


GROUPS = """
SELECT l_returnflag AS category, avg(l_extendedprice) AS mean, count(l_extendedprice) AS count,
       stddev_samp(l_extendedprice) AS std FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1
"""


@query("group_compare", f"SELECT category, round(mean, 4) AS mean, count, round(std, 4) AS std FROM ({GROUPS}) g")
def group_compare(t):
    return stats.group_compare(t("lineitem"), "l_returnflag", "l_extendedprice")


@query(
    "compare_summary",
    """
WITH g AS (SELECT o_orderpriority AS category, avg(o_totalprice) AS mean FROM orders_dirty
           WHERE o_orderpriority IS NOT NULL GROUP BY 1)
SELECT (SELECT category FROM g ORDER BY mean DESC, category LIMIT 1) AS highest, round(max(mean), 4) AS highest_mean,
       (SELECT category FROM g ORDER BY mean, category LIMIT 1) AS lowest, round(min(mean), 4) AS lowest_mean,
       stddev_samp(mean) > avg(mean) * 0.1 AS varies FROM g
""",
)
def compare_summary(t):
    return stats.compare_summary(stats.group_compare(t("orders_dirty"), "o_orderpriority", "o_totalprice"))


@query(
    "basic_column",
    """
SELECT 'o_totalprice' AS "column", round(avg(o_totalprice), 4) AS mean, count(*) AS records,
       count(*) - count(o_totalprice) AS missing FROM orders_dirty
""",
)
def basic_column(t):
    return stats.basic_column(t("orders_dirty"), "o_totalprice")


@query(
    "histogram",
    """
WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
c AS (SELECT least(cast(floor((l_extendedprice - lo) / (hi - lo) * 30) AS int), 29) AS bin, count(*) AS n
      FROM lineitem, e GROUP BY 1)
SELECT cast(b.bin AS int) AS bin, round(lo + b.bin * ((hi - lo) / 30), 4) AS low,
       round(lo + (b.bin + 1) * ((hi - lo) / 30), 4) AS high, coalesce(n, 0) AS n
FROM (SELECT unnest(range(30)) AS bin) b CROSS JOIN e LEFT JOIN c ON c.bin = b.bin
""",
)
def histogram(t):
    return charts.histogram(t("lineitem"), "l_extendedprice")


@query(
    "ols_trend",
    """
SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
       round(regr_r2(l_extendedprice, l_quantity), 4) AS r2, regr_count(l_extendedprice, l_quantity)::BIGINT AS n
FROM lineitem
""",
)
def ols_trend(t):
    return charts.ols_trend(t("lineitem"), "l_quantity", "l_extendedprice")


@query("bar_means", "SELECT p_brand AS category, round(avg(p_retailprice), 4) AS mean FROM part GROUP BY 1")
def bar_means(t):
    return charts.bar_means(t("part"), "p_brand", "p_retailprice")


@query(
    "trend_line",
    "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS time, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1",
)
def trend_line(t):
    orders = t("orders")
    return charts.trend_line(orders, time_like_columns(orders)[0], "o_totalprice")


@query(
    "trend_points",
    """
WITH p AS (SELECT o_orderdate::TIMESTAMP AS time, o_totalprice AS value, epoch_us(o_orderdate::TIMESTAMP)::DOUBLE AS place FROM orders),
e AS (SELECT min(place) AS lo, max(place) AS hi FROM p),
c AS (SELECT least(floor((place - lo) / (hi - lo) * 100), 99)::INT AS pixel, time, value FROM p, e),
m AS (SELECT pixel, min({'a': time, 'b': value}) AS f, max({'a': time, 'b': value}) AS l, min({'a': value, 'b': time}) AS d, max({'a': value, 'b': time}) AS u
      FROM c GROUP BY 1)
SELECT DISTINCT pixel, time, round(value, 4) AS value FROM (
  SELECT pixel, f.a AS time, f.b AS value FROM m UNION ALL SELECT pixel, l.a, l.b FROM m
  UNION ALL SELECT pixel, d.b, d.a FROM m UNION ALL SELECT pixel, u.b, u.a FROM m)
""",
)
def trend_points(t):
    return charts.trend_points(t("orders"), "o_orderdate", "o_totalprice", 100)


@query(
    "scatter_grid",
    """
WITH e AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM lineitem)
SELECT least(floor((l_quantity - a) / (b - a) * 40), 39)::INT AS "column", least(floor((l_extendedprice - c) / (d - c) * 30), 29)::INT AS "row",
       round(min({'x': l_quantity, 'y': l_extendedprice}).x, 4) AS x, round(min({'x': l_quantity, 'y': l_extendedprice}).y, 4) AS y, count(*) AS n
FROM lineitem, e GROUP BY 1, 2
""",
)
def scatter_grid(t):
    return charts.scatter_grid(t("lineitem"), "l_quantity", "l_extendedprice", 40, 30)


def spelled(question: str, method: str, columns: str, sql: str) -> str:
    """A result of one row or several as (statistic, value) lines."""
    return f"""SELECT '{question}' AS question, '{method}' AS method, '{columns}' AS columns, statistic, value
FROM (SELECT COLUMNS(*)::VARCHAR FROM ({sql}) r) UNPIVOT INCLUDE NULLS (value FOR statistic IN (COLUMNS(*)))"""


BY_FLAG = """
WITH g AS (SELECT l_returnflag AS category, avg(l_extendedprice) AS mean FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1)
SELECT (SELECT category FROM g ORDER BY mean DESC, category LIMIT 1) AS highest, max(mean) AS highest_mean,
       (SELECT category FROM g ORDER BY mean, category LIMIT 1) AS lowest, min(mean) AS lowest_mean, stddev_samp(mean) > avg(mean) * 0.1 AS varies FROM g
"""

SPREAD = """
WITH f AS (SELECT quantile_cont(l_tax, 0.25) AS q1, quantile_cont(l_tax, 0.5) AS q2, quantile_cont(l_tax, 0.75) AS q3 FROM lineitem),
d AS (SELECT avg(l_tax) AS mean, stddev_samp(l_tax) AS std, skewness(l_tax) AS skew, count(*) AS n, any_value(q2) AS median,
      count(*) FILTER (l_tax < q1 - 1.5 * (q3 - q1) OR l_tax > q3 + 1.5 * (q3 - q1)) AS outliers FROM lineitem, f)
SELECT 'l_tax' AS "column", mean, median, std, round(skew, 4) AS skew,
       CASE WHEN abs(skew) > 1 THEN 'high' WHEN abs(skew) > 0.5 THEN 'moderate' ELSE 'normal' END AS skew_class,
       CASE WHEN abs(skew) > 0.5 THEN CASE WHEN skew > 0 THEN 'right' ELSE 'left' END END AS direction, outliers, outliers * 100.0 / n AS outlier_pct FROM d
"""

LINKED = f"""
SELECT 'l_quantity' AS col1, 'l_extendedprice' AS col2, r, CASE WHEN abs(r) > 0.7 THEN 'strong' ELSE 'moderate' END AS strength,
       CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction
FROM (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem) c WHERE abs(r) > 0.5
"""

LEVEL = """
SELECT 0 AS ordinal, 'l_discount' AS "column", avg(l_discount) AS mean, stddev_samp(l_discount) AS std, min(l_discount) AS min,
       quantile_cont(l_discount, 0.25) AS q1, quantile_cont(l_discount, 0.5) AS median, quantile_cont(l_discount, 0.75) AS q3,
       max(l_discount) AS max, count(l_discount) AS count FROM lineitem
"""

MANY = {
    "Spread of tax": ("distribution", ["l_tax"], SPREAD), "Price by flag": ("comparison", ["l_returnflag", "l_extendedprice"], BY_FLAG),
    "Are these linked": ("correlation", ["l_quantity", "l_extendedprice"], LINKED), "Level of discount": ("aggregation", ["l_discount"], LEVEL),
}


@query(
    "answers_shared",
    f"""
SELECT question, method, columns, statistic, round(try_cast(value AS DOUBLE), 3) AS number, CASE WHEN try_cast(value AS DOUBLE) IS NULL THEN value END AS word
FROM ({union_all([spelled(q, m, ",".join(c), sql) for q, (m, c, sql) in MANY.items()])}) a
""",
)
def answers_shared(t):
    """Questions of all kinds on one table, from shared scans."""
    rows = answer_multiple(t("lineitem"), list(MANY), {q: m for q, (m, _, _) in MANY.items()}, {q: c for q, (_, c, _) in MANY.items()})
    number = F.expr("try_cast(value as double)")
    return rows.select("question", "method", "columns", "statistic", F.round(number, 3).alias("number"), F.when(number.isNull(), F.col("value")).alias("word"))


@query(
    "box_stats",
    f"""
WITH f AS ({EVENT_FENCES})
SELECT 'value' AS "column", round(min(value) FILTER (value BETWEEN lo AND hi), 4) AS whisker_low,
       round(any_value(q1), 4) AS q1, round(any_value(q2), 4) AS median, round(any_value(q3), 4) AS q3,
       round(max(value) FILTER (value BETWEEN lo AND hi), 4) AS whisker_high,
       count(*) FILTER (value < lo OR value > hi) AS outliers
FROM events, f
""",
)
def box_stats(t):
    return charts.box_stats(t("events"), "value")


@query(
    "violin_density",
    """
WITH s AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS n, stddev_samp(value) AS sd,
                  sd * pow(n, -0.2) AS w FROM events),
b AS (SELECT least(floor((value - lo) / (hi - lo) * 256), 255) AS bin, count(*) AS c FROM events, s GROUP BY 1),
g AS (SELECT cast(p AS int) AS point, lo + p * (hi - lo) / 63 AS x FROM s, (SELECT unnest(range(64)) AS p) r)
SELECT point, round(x, 4) AS x,
       round(sum(c * exp(-pow((x - (lo + bin * ((hi - lo) / 256) + lo + (bin + 1) * ((hi - lo) / 256)) / 2) / w, 2) / 2)
                 / (n * w * 2.5066282746310002)), 4) AS density
FROM g, b, s GROUP BY point, x
""",
)
def violin_density(t):
    return charts.violin_density(t("events"), "value")


@query(
    "data_context",
    union_all(
        [
            f"SELECT 'numeric' AS kind, '{c}' AS \"column\", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
            f"round(min({c}), 4)::DOUBLE AS min, round(max({c}), 4)::DOUBLE AS max, NULL::DOUBLE AS num_unique, NULL::VARCHAR AS top FROM part"
            for c in ["p_partkey", "p_size", "p_retailprice"]
        ]
        + [
            f"SELECT 'categorical', '{c}', NULL, NULL, NULL, NULL, count(DISTINCT {c}), {top_text('part', c, 3)} FROM part"
            for c in ["p_name", "p_brand", "p_type"]
        ]
    ),
)
def data_context(t):
    return reports.data_context(t("part")).withColumn("num_unique", F.col("num_unique").cast("double"))


@query(
    "report_stats",
    "SELECT ordinal, \"column\", mean, std, min, max FROM ("
    + union_all([stats_row("lineitem", i, c) for i, c in enumerate(LINEITEM_NUMBERS[:5])])
    + ") s",
)
def report_stats(t):
    return reports.report_stats(t("lineitem"))


@query(
    "feature_table",
    "SELECT ordinal, \"column\", dtype, num_missing, num_unique, mean, std FROM ("
    + union_all([profile_row(i, c) for i, c in enumerate(LINEITEM)])
    + ") p WHERE ordinal < 10",
)
def feature_table(t):
    return reports.feature_table(t("lineitem"))
