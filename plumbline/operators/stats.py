"""Descriptive statistics, correlation, distribution and group comparison."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.columns import (
    adjusted_skew,
    col,
    literal_table,
    long_table,
    number,
    numeric_columns,
    present,
)
from plumbline.operators.joins import frequent_join
from plumbline.operators.quantiles import quantiles, summary


STATISTICS = {"mean": "double", "std": "double", "min": "double", "q1": "double", "median": "double", "q3": "double",
              "max": "double", "count": "bigint"}


def summaries(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """All statistics of `basic_stats` per column, as numbers."""
    seen = summary(df, columns)
    cuts = quantiles(df, columns, [0.25, 0.5, 0.75], seen)
    out = {}
    for c in columns:
        s, (q1, median, q3) = seen[c], cuts[c]
        out[c] = {"mean": s.mean, "std": s.std, "min": s.low, "q1": q1, "median": median, "q3": q3, "max": s.high, "count": s.count}
    return out


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, deviation and extremes, one row per column, from one scan."""
    aggregates = []
    for i, c in enumerate(columns):
        x = number(df, c)
        cells = {"mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x)}
        aggregates += [cell.alias(f"{name}__{i}") for name, cell in cells.items()]
    return long_table(df.agg(*aggregates), columns, {n: "double" for n in ("mean", "std", "min", "max")})


def basic_stats(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles, one row per numeric column.

    The exact form runs its scans when called and returns one small row per column; `approx` stays
    lazy and reads the data once.
    """
    columns = numeric_columns(df) if columns is None else columns
    if approx:
        aggregates = []
        for i, c in enumerate(columns):
            x = number(df, c)
            cuts = F.percentile_approx(x, [0.25, 0.5, 0.75])
            quarters = [F.element_at(cuts, k) for k in (1, 2, 3)]
            cells = [F.avg(x), F.stddev_samp(x), F.min(x), *quarters, F.max(x), F.count(x)]
            aggregates += [cell.alias(f"{f}__{i}") for cell, f in zip(cells, STATISTICS)]
        return long_table(df.agg(*aggregates), columns, STATISTICS)
    found = summaries(df, columns)
    rows = [(i, c, *[found[c][f] for f in STATISTICS]) for i, c in enumerate(columns)]
    return literal_table(df, rows, {"ordinal": "int", "column": "string", **STATISTICS})


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The same statistics with one row per statistic and one column per numeric column."""
    columns = numeric_columns(df) if columns is None else columns
    found = summaries(df, columns)
    names = {"count": "count", "mean": "mean", "std": "std", "min": "min", "25%": "q1", "50%": "median", "75%": "q3", "max": "max"}
    rows = [
        (name, *[None if found[c][f] is None else float(found[c][f]) for c in columns]) for name, f in names.items()
    ]
    return literal_table(df, rows, {"statistic": "string", **{c: "double" for c in columns}})


def corr_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every two numeric columns, long form `(i, j, col1, col2, r)`.

    One scan finds means and deviations, a second one sums cross products of the scaled columns, as
    products of blocks of rows: one pass for any number of columns. A pair is measured over the rows
    where both cells hold a value; r is NULL where one side does not vary there.
    """
    columns = numeric_columns(df) if columns is None else columns
    seen = summary(df, columns)
    cells = []
    for i, c in enumerate(columns):
        scale = seen[c].std if seen[c].std and math.isfinite(seen[c].std) else 1.0
        cells.append(((number(df, c) - F.lit(seen[c].mean)) / F.lit(scale)).cast("double").alias(f"v{i}"))
    sums = "i int, " + ", ".join(f"{name} binary" for name in PAIR_SUMS)
    parts = df.select(*cells).mapInArrow(_cross_products, sums)
    found = parts.repartition("i").mapInArrow(_correlations, "i int, j int, r double")
    names = F.array(*[F.lit(c) for c in columns])
    return found.select("i", "j", F.get(names, F.col("i")).alias("col1"), F.get(names, F.col("j")).alias("col2"), "r")


#: Per column and partner: rows with both, sums and squares of either side over them, and products.
PAIR_SUMS = ("n", "s", "t", "q", "u", "p")


def _cross_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a task, a row per column."""
    total = None
    for batch in batches:
        x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])
        here = ~np.isnan(x)
        x, m = np.where(here, x, 0.0), here.astype(np.float64)
        s, q = x.T @ m, (x**2).T @ m
        sums = np.stack([m.T @ m, s, s.T, q, q.T, x.T @ x])
        total = sums if total is None else total + sums
    if total is not None:
        rows = [pa.array([total[k, i].tobytes() for i in range(total.shape[1])], pa.binary()) for k in range(len(PAIR_SUMS))]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.shape[1], dtype=np.int32)), *rows], names=["i", *PAIR_SUMS])


def _correlations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the tasks' sums as they stream by, one row of the matrix at a time."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for r, i in enumerate(batch.column(0).to_pylist()):
            sums = np.stack([np.frombuffer(c[r].as_buffer(), np.float64) for c in batch.columns[1:]])
            held[i] = held[i] + sums if i in held else sums
    for i, (n, s, t, q, u, p) in held.items():
        with np.errstate(all="ignore"):
            # s, q: this column over the partner's rows; t, u: the partner over this column's.
            left, right = q - s * s / n, u - t * t / n
            r = (p - s * t / n) / np.sqrt(left * right)
        varies = (n > 1) & (left > 1e-12 * np.maximum(q, 1e-300)) & (right > 1e-12 * np.maximum(u, 1e-300))
        r = np.where(varies, np.clip(r, -1.0, 1.0), np.nan)
        r[i] = 1.0 if varies[i] else np.nan
        size = len(r)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(size, i, np.int32)), pa.array(np.arange(size, dtype=np.int32)), pa.array(r, mask=np.isnan(r))], names=["i", "j", "r"]
        )


def corr_findings(matrix: DataFrame, k: int = 3) -> DataFrame:
    """The first k pairs in column order that correlate beyond 0.5."""
    r = F.col("r")
    strong = matrix.filter((F.col("i") < F.col("j")) & (F.abs(r) > 0.5))
    return (
        strong.orderBy("i", "j")
        .limit(k)
        .select(
            "col1", "col2", "r",
            F.when(F.abs(r) > 0.7, "strong").otherwise("moderate").alias("strength"),
            F.when(r > 0, "positive").otherwise("negative").alias("direction"),
        )
    )


def iqr_fences(df: DataFrame, columns: list[str]) -> dict[str, tuple[float | None, float | None]]:
    """Tukey fences at 1.5 interquartile ranges."""
    fences = {}
    for c, (q1, q3) in quantiles(df, columns, [0.25, 0.75]).items():
        fences[c] = (None, None) if q1 is None else (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    return fences


def outside(x: Column, low: float | None, high: float | None) -> Column:
    if low is None:
        return F.lit(False)
    return (x < low) | (x > high)


def iqr_outliers(df: DataFrame, column: str) -> DataFrame:
    """Rows beyond the fences; the fences are literals on the plain column, so the test reaches the scan."""
    low, high = iqr_fences(df, [column])[column]
    return df.filter(outside(col(column), low, high) & present(df, column))


def zscore_outliers(df: DataFrame, column: str, z: float = 3.0) -> DataFrame:
    """Rows more than z deviations from the mean; none without spread."""
    x = number(df, column)
    moments = df.agg(F.struct(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std")).alias("moments"))
    marked = df.withColumn("__moments", moments.scalar())
    far = F.abs(x - F.col("__moments.mean")) > z * F.col("__moments.std")
    return marked.filter((F.col("__moments.std") > 0) & far).drop("__moments")


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Centre, spread, skew class and outliers of one column, in one row."""
    x = number(df, column)
    q1, median, q3 = quantiles(df, [column], [0.25, 0.5, 0.75])[column]
    low, high = (None, None) if q1 is None else (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    row = df.agg(
        F.avg(x).alias("mean"), F.lit(median).cast("double").alias("median"), F.stddev_samp(x).alias("std"),
        adjusted_skew(x).alias("skew"), F.count_if(outside(x, low, high)).alias("outliers"),
        F.count("*").alias("n"),
    )
    return distribution_row(row, column)


def distribution_row(row: DataFrame, column: str) -> DataFrame:
    """Classes of skew and the share of outliers, from the moments and counts of a column."""
    size = F.abs("skew")
    return row.select(
        F.lit(column).alias("column"), "mean", "median", "std", "skew",
        F.when(size > 1, "high").when(size > 0.5, "moderate").otherwise("normal").alias("skew_class"),
        F.when(size > 0.5, F.when(F.col("skew") > 0, "right").otherwise("left")).alias("direction"),
        "outliers",
        F.try_divide(F.col("outliers") * 100.0, F.col("n").cast("double")).alias("outlier_pct"),
    )


def group_compare(df: DataFrame, category: str, value: str) -> DataFrame:
    """Mean, non-null count and deviation of a value per category; rows without category drop out."""
    x = number(df, value)
    return (
        df.filter(col(category).isNotNull())
        .groupBy(col(category).alias("category"))
        .agg(F.avg(x).alias("mean"), F.count(x).alias("count"), F.stddev_samp(x).alias("std"))
    )


def compare_summary(groups: DataFrame) -> DataFrame:
    """Highest and lowest group mean and whether the means vary by more than a tenth of their mean."""
    known = groups.filter(F.col("mean").isNotNull())
    top = F.min(F.struct(-F.col("mean"), F.col("category").alias("c"), F.col("mean").alias("m")))
    bottom = F.min(F.struct(F.col("mean").alias("m"), F.col("category").alias("c")))
    row = known.agg(
        top.alias("top"), bottom.alias("bottom"), F.stddev_samp("mean").alias("spread"), F.avg("mean").alias("centre")
    )
    return row.select(
        F.col("top.c").alias("highest"), F.col("top.m").alias("highest_mean"),
        F.col("bottom.c").alias("lowest"), F.col("bottom.m").alias("lowest_mean"),
        F.coalesce(F.col("spread") > F.col("centre") * 0.1, F.lit(False)).alias("varies"),
    )


def basic_column(df: DataFrame, column: str) -> DataFrame:
    """Mean, records and missing cells of one column."""
    return df.agg(
        F.avg(number(df, column)).alias("mean"), F.count("*").alias("records"),
        F.count_if(~present(df, column)).alias("missing"),
    ).select(F.lit(column).alias("column"), "mean", "records", "missing")


def comprehensive(df: DataFrame) -> dict[str, DataFrame]:
    """The bundle of descriptions, correlations, types, distinct and missing counts."""
    from plumbline.operators.profile import nunique

    types = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    missing = df.agg(*[F.count_if(~present(df, c)).alias(f"missing__{i}") for i, c in enumerate(df.columns)])
    return {
        "descriptive_stats": describe(df),
        "correlation_matrix": corr_matrix(df),
        "data_types": literal_table(df, types, {"column": "string", "dtype": "string"}),
        "unique_values": nunique(df),
        "missing_values": long_table(missing, df.columns, {"missing": "bigint"}),
    }


def target_column(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per question the first column of its dataset named in it, else the first column, else none.

    The catalog is folded to one row per dataset before the join, and questions on a dataset asked
    about very often are dealt among tasks.
    """
    listed = catalog.groupBy("dataset").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "column_name"))).alias("columns")
    )
    named = F.filter("columns", lambda c: F.contains(F.lower("question"), F.lower(c["column_name"])))
    pick = F.coalesce(F.get(named, F.lit(0)), F.get(F.col("columns"), F.lit(0)))
    joined = frequent_join(questions, listed, ["dataset"], ["question"], "left")
    return joined.select(*questions.columns, pick["column_name"].alias("target_column"))


def latest(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows per key in the given order.

    Spark keeps k rows per key and input partition before the shuffle, so a hot key stays small.
    """
    rank = F.row_number().over(Window.partitionBy(*[col(c) for c in keys]).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= k).drop("__rank")
