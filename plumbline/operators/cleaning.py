"""Cleaning of tables: imputation, de-duplication, type repair, capping, text format, reports."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.columns import (
    clip,
    col,
    literal_table,
    long_table,
    number,
    numeric_columns,
    present,
    string_columns,
    time_typed_columns,
)
from plumbline.functions.text import strip, title_case
from plumbline.operators.ordered import forward_fill
from plumbline.operators.profile import duplicate_count, missing_cells, score, value_counts
from plumbline.operators.quantiles import quantiles, summary
from plumbline.operators.stats import iqr_fences, outside
from plumbline.session import materialized

# Accepted ranges per column name.
RANGES = {"age": (0, 120), "salary": (0, 1_000_000), "rating": (1, 5)}

# Date formats in the order they are tried.
DATE_FORMATS = [
    "yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "yyyy/M/d", "d-M-yyyy", "M-d-yyyy", "yyyyMMdd", "d.M.yyyy",
    "yyyy-M-d H:m:s", "d/M/yyyy H:m:s",
]
DATE_WORDS = ("date", "time", "timestamp")
TITLE_WORDS = ("name", "title", "description")
UPPER_WORDS = ("code", "id", "abbreviation")


def impute_mean(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Fill missing numbers with the column mean; columns without gaps keep values and type.

    One scan finds gaps and means.
    """
    columns = numeric_columns(df) if columns is None else columns
    seen = summary(df, columns)
    gaps = {c: s.mean for c, s in seen.items() if s.count < s.rows}
    return df.withColumns({c: F.coalesce(number(df, c), F.lit(m).cast("double")) for c, m in gaps.items()})


def impute_median(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Fill missing numbers with the column median; columns without gaps keep values and type."""
    columns = numeric_columns(df) if columns is None else columns
    seen = summary(df, columns)
    gaps = [c for c, s in seen.items() if s.count < s.rows]
    medians = quantiles(df, gaps, [0.5], seen)
    return df.withColumns({c: F.coalesce(number(df, c), F.lit(medians[c][0]).cast("double")) for c in gaps})


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """The most frequent value per string column, ties to the smallest."""
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("value").alias("value")))
    return value_counts(df, columns).groupBy("column").agg(best["value"].alias("mode"))


def impute_mode(df: DataFrame, columns: list[str] | None = None, default: str = "Unknown") -> DataFrame:
    columns = string_columns(df) if columns is None else columns
    if not columns:
        return df
    # One entry per column.
    best = modes(df, columns).agg(F.map_from_entries(F.collect_list(F.struct("column", "mode"))).alias("m"))
    filled = df.withColumn("__modes", best.scalar())
    return filled.withColumns(
        {c: F.coalesce(col(c), F.col("__modes")[F.lit(c)], F.lit(default)) for c in columns}
    ).drop("__modes")


def impute_unknown(df: DataFrame, columns: list[str] | None = None, default: str = "Unknown") -> DataFrame:
    columns = string_columns(df) if columns is None else columns
    return df.withColumns({c: F.coalesce(col(c), F.lit(default)) for c in columns})


def impute_all(
    df: DataFrame, order_by: list[str] | None = None, partition_by: list[str] | None = None
) -> DataFrame:
    """Median for numbers, mode for strings, forward fill for time columns when an order is given."""
    out = impute_mode(impute_median(df))
    times = time_typed_columns(df)
    return forward_fill(out, times, order_by, partition_by) if times and order_by else out


def cap_outliers(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pull values beyond the fences back to them.

    Columns with such values become double; the others keep values and type.
    """
    columns = numeric_columns(df) if columns is None else columns
    fences = {c: f for c, f in iqr_fences(df, columns).items() if f[0] is not None}
    if not fences:
        return df
    far = df.agg(*[F.coalesce(F.bool_or(outside(number(df, c), *f)), F.lit(False)).alias(f"f{i}") for i, (c, f) in enumerate(fences.items())])
    far = far.first()
    return df.withColumns({c: clip(number(df, c), *f) for i, (c, f) in enumerate(fences.items()) if far[f"f{i}"]})


def convert_dates(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """Parse string columns with the given pattern each; unreadable values become NULL."""
    return df.withColumns({c: F.try_to_timestamp(col(c), F.lit(f)).cast("timestamp_ntz") for c, f in formats.items()})


def first_values(df: DataFrame, columns: list[str], order_by: list[str]):
    """One row: per column the first non-null value in the stated order."""
    order = F.struct(*[col(c) for c in order_by])
    return df.agg(
        *[F.min_by(col(c), F.when(col(c).isNotNull(), order)).alias(f"v{i}") for i, c in enumerate(columns)]
    ).first()


def fitting_formats(df: DataFrame, columns: list[str], order_by: list[str]) -> dict[str, str]:
    """Per column the first format that reads its first value; columns without one are left out."""
    if not columns:
        return {}
    row = first_values(df, columns, order_by)
    samples = literal_table(df, [(i, row[f"v{i}"]) for i in range(len(columns))], {"i": "int", "v": "string"})
    fits = samples.select(
        "i",
        *[F.try_to_timestamp("v", F.lit(f)).isNotNull().alias(f"f{k}") for k, f in enumerate(DATE_FORMATS)],
    ).collect()
    chosen = {}
    for r in fits:
        for k, f in enumerate(DATE_FORMATS):
            if r[f"f{k}"]:
                chosen[columns[r["i"]]] = f
                break
    return chosen


def standardize_types(df: DataFrame, order_by: list[str]) -> DataFrame:
    """Date-named strings to timestamps by the format of the first value; digit strings to numbers.

    Two small decisions run first (one row each); the result is one projection.
    """
    strings = string_columns(df)
    dates = [c for c in strings if any(w in c.lower() for w in DATE_WORDS)]
    others = [c for c in strings if c not in dates]
    formats = fitting_formats(df, dates, order_by)
    changes = {
        c: (
            F.try_to_timestamp(col(c), F.lit(formats[c])) if c in formats else F.try_to_timestamp(col(c))
        ).cast("timestamp_ntz")
        for c in dates
    }
    if others:
        digits = df.agg(
            *[F.bool_and(F.coalesce(col(c).rlike(r"^\d+$"), F.lit(False))).alias(f"d{i}") for i, c in enumerate(others)],
            *[F.max(F.length(col(c))).alias(f"n{i}") for i, c in enumerate(others)],
        ).first()
        for i, c in enumerate(others):
            # Numbers too long for a type keep the next wider one, in the end their text.
            if digits[f"d{i}"] and digits[f"n{i}"] <= 38:
                changes[c] = col(c).try_cast("bigint" if digits[f"n{i}"] <= 18 else "decimal(38,0)")
    return df.withColumns(changes)


def clean_strings(df: DataFrame, ascii_only: bool = True) -> DataFrame:
    """Strip, then Title or UPPER case by column name, then drop special characters.

    `ascii_only` also drops accented letters; otherwise all letters and digits stay.
    """
    keep = r"[^a-zA-Z0-9\s]" if ascii_only else r"[^\p{L}\p{N}\s]"
    changes = {}
    for name in string_columns(df):
        if name == "metadata":
            continue
        lower, c = name.lower(), strip(col(name))
        if any(w in lower for w in TITLE_WORDS):
            c = title_case(c)
        elif any(w in lower for w in UPPER_WORDS):
            c = F.upper(c)
        changes[name] = F.regexp_replace(c, keep, "")
    return df.withColumns(changes)


def title_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Strip and Title-case; NULL stays NULL."""
    columns = string_columns(df) if columns is None else columns
    return df.withColumns({c: title_case(strip(col(c))) for c in columns})


def validate_ranges(df: DataFrame, rules: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Clip the ruled columns to their range."""
    rules = RANGES if rules is None else rules
    return df.withColumns(
        {c: clip(col(c), low, high).cast(df.schema[c].dataType) for c, (low, high) in rules.items() if c in df.columns}
    )


def invalid_counts(df: DataFrame, rules: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Values outside their range, per ruled column."""
    rules = {c: r for c, r in (RANGES if rules is None else rules).items() if c in df.columns}
    row = df.agg(
        *[F.count_if(~col(c).between(low, high)).alias(f"invalid__{i}") for i, (c, (low, high)) in enumerate(rules.items())]
    )
    return long_table(row, list(rules), {"invalid": "bigint"})


def year_features(df: DataFrame) -> DataFrame:
    """`<column>_year` for every time column with `date` in its name."""
    return df.withColumns({f"{c}_year": F.year(col(c)) for c in time_typed_columns(df) if "date" in c.lower()})


def sanitize(
    df: DataFrame, formats: dict[str, str] | None = None, legacy_d_prefix: bool = False
) -> DataFrame:
    """Strip strings, turn `nan` and empty text into NULL, and read date-named columns.

    A column counts as a date when its name holds `date`; `legacy_d_prefix` widens that to every
    name that starts with `d`.
    """
    formats = formats or {}
    changes = {}
    for name in string_columns(df):
        c = strip(col(name))
        c = F.when(~c.isin("nan", ""), c)
        lower = name.lower()
        if "date" in lower or (legacy_d_prefix and lower.startswith("d")):
            read = F.try_to_timestamp(c, F.lit(formats[name])) if name in formats else F.try_to_timestamp(c)
            c = read.cast("timestamp_ntz")
        changes[name] = c
    return df.withColumns(changes)


def cleaning_summary(cleaned: DataFrame, original: DataFrame) -> DataFrame:
    """Rows and missing cells removed, columns left and the quality score, in one row."""
    before = original.agg(F.struct(F.count("*").alias("n"), missing_cells(original).alias("missing")).alias("s"))
    after = cleaned.agg(F.count("*").alias("n"), missing_cells(cleaned).alias("missing"))
    counts = after.withColumn("before", before.scalar()).withColumn("duplicates", duplicate_count(cleaned).scalar())
    return counts.select(
        (F.col("before.n") - F.col("n")).alias("rows_removed"),
        F.lit(len(cleaned.columns)).alias("columns_remaining"),
        (F.col("before.missing") - F.col("missing")).cast("bigint").alias("missing_values_removed"),
        score(F.col("n"), F.col("missing"), F.col("duplicates"), len(cleaned.columns)).alias("data_quality_score"),
    )


@dataclass
class CleaningPlan:
    """Which steps to take. The defaults fill numbers with the mean and strings with `Unknown`."""

    numbers: str | None = "mean"
    strings: str | None = "unknown"
    drop_duplicates: bool = False
    date_formats: dict[str, str] = field(default_factory=dict)
    cap_outliers: bool = False
    title_text: bool = False


def clean_structured(df: DataFrame, plan: CleaningPlan | None = None) -> DataFrame:
    """Impute, de-duplicate, convert, cap and format, in that order."""
    plan = plan or CleaningPlan()
    strings = string_columns(df)
    out = df
    if plan.numbers == "mean":
        out = impute_mean(out)
    elif plan.numbers == "median":
        out = impute_median(out)
    if plan.strings == "mode":
        out = impute_mode(out)
    elif plan.strings == "unknown":
        out = impute_unknown(out)
    if plan.drop_duplicates:
        out = out.dropDuplicates()
        if plan.cap_outliers:  # the fences take several scans, which must not repeat the shuffle
            out = materialized(out)
    if plan.date_formats:
        out = convert_dates(out, plan.date_formats)
    if plan.cap_outliers:
        out = cap_outliers(out)
    if plan.title_text:
        out = title_columns(out, [c for c in strings if c not in plan.date_formats])
    return out


def cleaning_report(df: DataFrame, dataset: str, plan: CleaningPlan | None = None) -> DataFrame:
    """What each step of a plan would change: `(dataset, step, column, n_changed, detail)`.

    Counts refer to the table as it comes in, all of them from one aggregation.
    """
    plan = plan or CleaningPlan()
    steps: list[tuple[str, str, str]] = []
    aggregates = []

    def add(step: str, column: str, detail: str, count) -> None:
        aggregates.append(count.alias(f"n_changed__{len(steps)}"))
        steps.append((step, column, detail))

    if plan.numbers:
        for c in numeric_columns(df):
            add("fill missing", c, plan.numbers, F.count_if(~present(df, c)))
    if plan.strings:
        for c in string_columns(df):
            add("fill missing", c, plan.strings, F.count_if(col(c).isNull()))
    for c, f in plan.date_formats.items():
        unread = col(c).isNotNull() & F.try_to_timestamp(col(c), F.lit(f)).isNull()
        add("convert dates", c, "unreadable", F.count_if(unread))
    if plan.cap_outliers:
        for c, (low, high) in iqr_fences(df, numeric_columns(df)).items():
            add("cap outliers", c, "1.5 IQR", F.count_if(outside(number(df, c), low, high)))
    if plan.title_text:
        for c in string_columns(df):
            if c not in plan.date_formats:
                add("title case", c, "strip and title", F.count_if(~title_case(strip(col(c))).eqNullSafe(col(c))))
    if aggregates:
        keys = [str(i) for i in range(len(steps))]
        counts = long_table(df.agg(*aggregates), keys, {"n_changed": "bigint"}, key="key")
        named = F.array(*[F.struct(F.lit(s).alias("step"), F.lit(c).alias("column"), F.lit(d).alias("detail")) for s, c, d in steps])
        out = counts.withColumn("s", F.get(named, F.col("ordinal"))).select(
            F.lit(dataset).alias("dataset"), "s.step", "s.column", "n_changed", "s.detail"
        )
    else:
        fields = {"dataset": "string", "step": "string", "column": "string", "n_changed": "bigint", "detail": "string"}
        out = literal_table(df, [], fields)
    if plan.drop_duplicates:
        removed = duplicate_count(df).select(
            F.lit(dataset).alias("dataset"), F.lit("drop duplicates").alias("step"), F.lit(None).cast("string").alias("column"),
            F.col("num_duplicates").alias("n_changed"), F.lit("full rows").alias("detail"),
        )
        out = out.unionByName(removed)
    return out


def is_text_table(df: DataFrame) -> bool:
    """A table of documents rather than of records."""
    return "content" in df.columns and (len(df.columns) <= 5 or "metadata" in df.columns)
