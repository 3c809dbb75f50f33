"""Profiles of whole tables: one scan for all counts and moments, one aggregation for all values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from plumbline.functions.columns import (
    col,
    kind_of,
    literal_table,
    long_table,
    number,
    numeric_columns,
    present,
    string_columns,
    time_typed_columns,
)
from plumbline.operators.quantiles import quantiles, summary


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of equal rows; NULL equals NULL.

    128 bits of hash per row are shuffled instead of the rows. Hashes pass over NULL, so the places of
    the NULLs are hashed as well. Tables with nested columns are grouped by their rows: maps have no
    hash, and NULLs inside a value would be passed over.
    """
    cells = [col(c) for c in df.columns]
    if any(isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType)) for f in df.schema.fields):
        groups = df.groupBy(*cells).agg(F.count("*").alias("__n"))
    else:
        gaps = F.array(*[c.isNull() for c in cells])
        keys = [F.xxhash64(gaps, *cells).alias("__a"), F.xxhash64(F.lit(1), gaps, *cells).alias("__b")]
        groups = df.select(*keys).groupBy("__a", "__b").agg(F.count("*").alias("__n"))
    return groups.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("bigint").alias("num_duplicates"))


def missing_cells(df: DataFrame):
    """Aggregate expression: missing cells over all columns."""
    total = F.lit(0)
    for c in df.columns:
        total = total + F.count_if(~present(df, c))
    return total


def overview(df: DataFrame) -> DataFrame:
    """Counts of records, features by kind, missing cells and duplicates, in one row."""
    counts = df.agg(F.count("*").alias("records"), missing_cells(df).cast("bigint").alias("missing"))
    return counts.select(
        "records",
        F.lit(len(df.columns)).alias("features"),
        F.lit(len(numeric_columns(df))).alias("numeric"),
        F.lit(len(string_columns(df))).alias("categorical"),
        "missing",
        duplicate_count(df).scalar().alias("duplicates"),
    )


def dataset_profile(df: DataFrame, data_type: str, documents: int = 1, order_by: list[str] | None = None) -> DataFrame:
    """One row describing a table. With `order_by` the first three rows are included as JSON."""
    out = df.agg(F.count("*").alias("n_rows")).select(
        F.lit(data_type).alias("data_type"),
        "n_rows",
        F.lit(len(df.columns)).alias("n_cols"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        F.lit(documents).alias("document_count"),
        duplicate_count(df).scalar().alias("num_duplicates"),
    )
    if order_by:
        head = head_sample(df, order_by).select(
            F.struct(*[col(c) for c in order_by]).alias("k"), F.to_json(F.struct(*[col(c) for c in df.columns])).alias("j")
        )
        sample = head.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "j"))), lambda r: r["j"]).alias("s"))
        out = out.withColumn("sample", sample.scalar())
    return out


def head_sample(df: DataFrame, order_by: list[str], rows: int = 3) -> DataFrame:
    """The first rows in a stated order."""
    return df.orderBy(*[col(c) for c in order_by]).limit(rows)


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """`(column, value, n)` of the non-null strings of all given columns, counted in one aggregation."""
    columns = string_columns(df) if columns is None else columns
    pairs = df.select(*[col(c).cast("string").alias(c) for c in columns]).unpivot([], [col(c) for c in columns], "column", "value")
    return pairs.filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = 5) -> DataFrame:
    """The k most frequent values per column, ties by value."""
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    return value_counts(df, columns).withColumn("rank", rank).filter(F.col("rank") <= k)


def _native(df: DataFrame, name: str) -> tuple[str, Column]:
    """A column in one of three common types that keep its values apart."""
    kind, c = df.schema[name].dataType, col(name)
    if isinstance(kind, T.IntegralType):
        return "bigint", c.cast("bigint")
    if isinstance(kind, T.DateType):
        return "bigint", F.unix_date(c).cast("bigint")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "bigint", F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return "double", number(df, name)
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        return "string", F.when(c.isNotNull(), F.to_json(F.struct(c)))
    return "string", c.cast("string")


def _distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """`(ordinal, num_unique)`: columns of a common type are stacked and counted together."""
    families: dict[str, list[Column]] = {}
    for i, name in enumerate(columns):
        kind, value = _native(df, name)
        cell = F.when(value.isNotNull(), F.struct(F.lit(i).alias("ordinal"), value.alias("value")))
        families.setdefault(kind, []).append(cell.alias(f"c{i}"))
    out = None
    for cells in families.values():
        wide = df.select(*cells)
        stacked = wide.unpivot([], wide.columns, "name", "cell").filter("cell is not null").select("cell.*")
        counts = stacked.groupBy("ordinal", "value").agg(F.lit(1).alias("one")).groupBy("ordinal").agg(F.count("*").alias("num_unique"))
        out = counts if out is None else out.unionByName(counts)
    return out


def nunique(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Distinct non-null values per column.

    The exact form shuffles every distinct value once; `approx` keeps a sketch per column instead.
    """
    columns = df.columns if columns is None else columns
    if approx:
        row = df.agg(*[F.approx_count_distinct(col(c)).alias(f"num_unique__{i}") for i, c in enumerate(columns)])
        return long_table(row, columns, {"num_unique": "bigint"})
    counted = _distinct_counts(df, columns)
    names = literal_table(df, list(enumerate(columns)), {"ordinal": "int", "column": "string"})
    # Both sides hold at most one row per column.
    return names.join(F.broadcast(counted), "ordinal", "left").select(
        "ordinal", "column", F.coalesce("num_unique", F.lit(0)).alias("num_unique")
    )


def column_profile(df: DataFrame, top: int = 5, approx: bool = False) -> DataFrame:
    """One row per column: type, missing, distinct, and what fits its kind.

    Numeric columns get extremes, mean, median, deviation and the count beyond three deviations,
    strings their most frequent values, dates their extremes.
    """
    numbers, strings, times = numeric_columns(df), string_columns(df), time_typed_columns(df)
    seen = summary(df, numbers)
    medians = quantiles(df, numbers, [0.5], seen)

    fields = {
        "dtype": "string", "num_missing": "bigint", "pct_missing": "double", "min": "double",
        "max": "double", "mean": "double", "median": "double", "std": "double",
        "num_outliers": "bigint", "min_date": "string", "max_date": "string",
    }
    aggregates = []
    for i, name in enumerate(df.columns):
        nothing = F.lit(None)
        cells = {
            "dtype": F.lit(df.schema[name].dataType.simpleString()),
            "num_missing": F.count_if(~present(df, name)),
            "pct_missing": F.try_divide(F.count_if(~present(df, name)).cast("double"), F.count("*").cast("double")),
        }
        if name in numbers:
            x, known = number(df, name), seen[name]
            far = F.count_if(F.abs(x - known.mean) > 3 * known.std) if known.std else F.lit(0)
            cells |= {
                "min": F.lit(known.low), "max": F.lit(known.high), "mean": F.lit(known.mean),
                "median": F.lit(medians[name][0]), "std": F.lit(known.std), "num_outliers": far,
            }
        elif name in times:
            cells |= {"min_date": F.min(col(name)).cast("string"), "max_date": F.max(col(name)).cast("string")}
        aggregates += [cells.get(f, nothing).alias(f"{f}__{i}") for f in fields]
    stats = long_table(df.agg(*aggregates), df.columns, fields)
    out = stats.join(F.broadcast(nunique(df, approx=approx).drop("ordinal")), "column", "left")
    if strings:
        best = top_values(df, strings, top).groupBy("column").agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "value", "n"))), lambda v: F.struct(v["value"], v["n"])
            ).alias("top_values")
        )
        # One row per string column.
        out = out.join(F.broadcast(best), "column", "left")
    return out


def column_catalog(df: DataFrame, dataset: str) -> DataFrame:
    """The schema as rows `(dataset, ordinal, column_name, kind)`."""
    rows = [(dataset, i, f.name, kind_of(f.dataType)) for i, f in enumerate(df.schema.fields)]
    return literal_table(df, rows, {"dataset": "string", "ordinal": "int", "column_name": "string", "kind": "string"})


def score(rows: Column, missing: Column, duplicates: Column, width: int) -> Column:
    complete = 1 - F.try_divide(missing.cast("double"), (rows * width).cast("double"))
    unique = 1 - F.try_divide(duplicates.cast("double"), rows.cast("double"))
    return F.round((complete * 0.7 + unique * 0.3) * 100, 2)


def quality_score(df: DataFrame) -> DataFrame:
    """Share of filled cells and of unique rows, weighted 70 to 30, in percent. NULL on empty input."""
    counts = df.agg(F.count("*").alias("n"), missing_cells(df).alias("missing")).withColumn(
        "duplicates", duplicate_count(df).scalar()
    )
    return counts.select(score(F.col("n"), F.col("missing"), F.col("duplicates"), len(df.columns)).alias("quality_score"))
