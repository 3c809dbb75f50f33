"""Cleaning of the dirty views."""

from __future__ import annotations

from plumbline.operators import cleaning as C
from plumbline.operators.ordered import forward_fill
from workload.registry import query, union_all
from workload.tables import DIRTY_NUMBERS, DUPLICATES, MISSING

KEEP = "o_orderkey, o_custkey, o_orderstatus, o_orderdate"

STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def strip_sql(x: str) -> str:
    return STRIP.format(x=x)


def title_sql(x: str) -> str:
    return (
        rf"array_to_string(list_transform(regexp_extract_all({x}, '\p{{L}}+|[^\p{{L}}]+'), "
        "lambda w: upper(w[1]) || lower(w[2:])), '')"
    )


@query(
    "impute_mean",
    f"""
SELECT {KEEP}, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM orders_dirty)), 4) AS o_totalprice,
       o_orderpriority FROM orders_dirty
""",
)
def impute_mean(t):
    return C.impute_mean(t("orders_dirty"), ["o_totalprice"])


@query(
    "impute_median",
    f"""
SELECT {KEEP}, round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM orders_dirty)), 4) AS o_totalprice,
       o_orderpriority FROM orders_dirty
""",
)
def impute_median(t):
    return C.impute_median(t("orders_dirty"), ["o_totalprice"])


MODE = """(SELECT o_orderpriority FROM orders_dirty WHERE o_orderpriority IS NOT NULL
 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"""


@query(
    "impute_mode",
    f"SELECT {KEEP}, round(o_totalprice, 4) AS o_totalprice, coalesce(o_orderpriority, {MODE}) AS o_orderpriority FROM orders_dirty",
)
def impute_mode(t):
    return C.impute_mode(t("orders_dirty"))


@query(
    "impute_unknown",
    f"SELECT {KEEP}, round(o_totalprice, 4) AS o_totalprice, coalesce(o_orderpriority, 'Unknown') AS o_orderpriority FROM orders_dirty",
)
def impute_unknown(t):
    return C.impute_unknown(t("orders_dirty"))


@query(
    "ffill",
    """
SELECT event_id, user_id, ts, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value
FROM event_gaps
""",
)
def ffill(t):
    return forward_fill(t("event_gaps"), ["value"], ["ts", "event_id"], ["user_id"])


@query("drop_duplicates", f"SELECT DISTINCT {KEEP}, round(o_totalprice, 4) AS o_totalprice, o_orderpriority FROM orders_dirty")
def drop_duplicates(t):
    return t("orders_dirty").dropDuplicates()


def fences_sql(table: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        q1, q3 = f"quantile_cont(cast({c} AS double), 0.25)", f"quantile_cont(cast({c} AS double), 0.75)"
        parts.append(f"{q1} - 1.5 * ({q3} - {q1}) AS {c}_lo, {q3} + 1.5 * ({q3} - {q1}) AS {c}_hi")
    return f"SELECT {', '.join(parts)} FROM {table}"


def capped_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN least(greatest(cast({c} AS double), {c}_lo), {c}_hi) END"


@query(
    "cap_outliers",
    f"""
WITH f AS ({fences_sql("orders_dirty", DIRTY_NUMBERS)})
SELECT o_orderkey, o_custkey, round({capped_sql("o_totalprice")}, 4) AS o_totalprice, o_orderstatus, o_orderdate, o_orderpriority
FROM orders_dirty, f
""",
)
def cap_outliers(t):
    return C.cap_outliers(t("orders_dirty"))


@query(
    "convert_dates",
    """
SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice, customer_code,
       try_strptime(order_date, '%d/%m/%Y') AS order_date FROM orders_text_dates
""",
)
def convert_dates(t):
    return C.convert_dates(t("orders_text_dates"), {"order_date": "d/M/yyyy"})


@query(
    "standardize_types",
    """
SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice, cast(customer_code AS bigint) AS customer_code,
       try_strptime(order_date, '%d/%m/%Y') AS order_date FROM orders_text_dates
""",
)
def standardize_types(t):
    return C.standardize_types(t("orders_text_dates"), ["o_orderkey"])


def keep_plain(x: str) -> str:
    return f"regexp_replace({x}, '[^a-zA-Z0-9\\s]', '', 'g')"


@query(
    "clean_strings",
    f"""
SELECT c_custkey, {keep_plain(title_sql(strip_sql("c_name")))} AS c_name,
       {keep_plain(title_sql(strip_sql("c_title")))} AS c_title,
       {keep_plain(f"upper({strip_sql('c_code')})")} AS c_code,
       {keep_plain(strip_sql("remark"))} AS remark, {keep_plain(strip_sql("signup_date"))} AS signup_date
FROM customer_dirty
""",
)
def clean_strings(t):
    return C.clean_strings(t("customer_dirty"))


@query(
    "title_columns",
    f"""
SELECT c_custkey, {", ".join(f"{title_sql(strip_sql(c))} AS {c}" for c in ["c_name", "c_title", "c_code", "remark", "signup_date"])}
FROM customer_dirty
""",
)
def title_columns(t):
    return C.title_columns(t("customer_dirty"))


def sane_sql(c: str) -> str:
    return f"nullif(nullif({strip_sql(c)}, 'nan'), '')"


@query(
    "sanitize",
    f"""
SELECT c_custkey, {", ".join(f"{sane_sql(c)} AS {c}" for c in ["c_name", "c_title", "c_code", "remark"])},
       try_strptime({sane_sql("signup_date")}, '%Y-%m-%d') AS signup_date
FROM customer_dirty
""",
)
def sanitize(t):
    return C.sanitize(t("customer_dirty"), {"signup_date": "yyyy-M-d"})


@query(
    "validate_ranges",
    """
SELECT c_custkey, round(c_acctbal, 4) AS c_acctbal, least(greatest(age, 0), 120) AS age,
       round(least(greatest(salary, 0), 1000000), 4) AS salary, least(greatest(rating, 1), 5) AS rating FROM people
""",
)
def validate_ranges(t):
    return C.validate_ranges(t("people"))


@query(
    "invalid_counts",
    union_all(
        [
            f"SELECT {i} AS ordinal, '{c}' AS \"column\", count(*) FILTER ({c} < {lo} OR {c} > {hi}) AS invalid FROM people"
            for i, (c, (lo, hi)) in enumerate(C.RANGES.items())
        ]
    ),
)
def invalid_counts(t):
    return C.invalid_counts(t("people"))


@query("year_features", "SELECT *, cast(year(o_orderdate) AS int) AS o_orderdate_year FROM orders")
def year_features(t):
    return C.year_features(t("orders"))


@query(
    "cleaning_summary",
    f"""
SELECT {DUPLICATES} AS rows_removed, 6 AS columns_remaining,
       {MISSING} - (SELECT sum(CASE WHEN o_totalprice IS NULL THEN 1 ELSE 0 END)::BIGINT FROM (SELECT DISTINCT * FROM orders_dirty) u)
           AS missing_values_removed,
       (SELECT round(((1 - sum(CASE WHEN o_totalprice IS NULL THEN 1 ELSE 0 END) / (count(*) * 6)) * 0.7 + 0.3) * 100, 2)
        FROM (SELECT DISTINCT * FROM orders_dirty) u) AS data_quality_score
""",
)
def cleaning_summary(t):
    original = t("orders_dirty")
    return C.cleaning_summary(C.impute_unknown(original).dropDuplicates(), original)


PLAN = C.CleaningPlan(
    numbers="median", strings="mode", drop_duplicates=True, cap_outliers=True, title_text=True
)
FILLED = f"""
SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus, o_orderdate,
       coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM orders_dirty)) AS o_totalprice,
       coalesce(o_orderpriority, {MODE}) AS o_orderpriority FROM orders_dirty
"""


@query(
    "clean_structured",
    f"""
WITH u AS ({FILLED}), f AS ({fences_sql("u", DIRTY_NUMBERS)})
SELECT o_orderkey, o_custkey, round({capped_sql("o_totalprice")}, 4) AS o_totalprice,
       {title_sql("o_orderstatus")} AS o_orderstatus, o_orderdate, {title_sql("o_orderpriority")} AS o_orderpriority
FROM u, f
""",
)
def clean_structured(t):
    return C.clean_structured(t("orders_dirty"), PLAN)


def report_line(step: str, column: str | None, n: str, detail: str) -> str:
    name = f"'{column}'" if column else "NULL"
    return f"SELECT 'orders' AS dataset, '{step}' AS step, {name} AS \"column\", {n} AS n_changed, '{detail}' AS detail"


def count_where(condition: str) -> str:
    return f"(SELECT count(*) FROM orders_dirty, f WHERE {condition})"


@query(
    "cleaning_report",
    f"WITH f AS ({fences_sql('orders_dirty', DIRTY_NUMBERS)})\n"
    + union_all(
        [report_line("fill missing", c, count_where(f"{c} IS NULL"), "median") for c in DIRTY_NUMBERS]
        + [report_line("fill missing", c, count_where(f"{c} IS NULL"), "mode") for c in ["o_orderstatus", "o_orderpriority"]]
        + [report_line("cap outliers", c, count_where(f"{c} < {c}_lo OR {c} > {c}_hi"), "1.5 IQR") for c in DIRTY_NUMBERS]
        + [
            report_line("title case", c, count_where(f"{title_sql(strip_sql(c))} IS DISTINCT FROM {c}"), "strip and title")
            for c in ["o_orderstatus", "o_orderpriority"]
        ]
        + [report_line("drop duplicates", None, DUPLICATES, "full rows")]
    ),
)
def cleaning_report(t):
    return C.cleaning_report(t("orders_dirty"), "orders", PLAN)
