"""The reduced data behind a chart: bins, fitted lines, group means, five-number summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.columns import col, numeric_columns, number, string_columns, time_like_columns
from plumbline.functions.text import STOP_WORDS, not_blank, polarity
from plumbline.operators.corpus import word_counts
from plumbline.operators.quantiles import quantiles
from plumbline.operators.stats import corr_matrix, group_compare


def _bins(values: DataFrame, extent: Column, bins: int) -> DataFrame:
    """Counts of `x` in equal-width bins of the extent `(low, high)`, empty bins included."""
    low, high = F.col("extent.low"), F.col("extent.high")
    share = F.coalesce(F.try_divide(F.col("x") - low, high - low), F.lit(0.0))
    index = F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")
    counts = (
        values.filter("x is not null").withColumn("extent", extent).groupBy(index.alias("bin")).agg(F.count("*").alias("n"))
    )
    frame = values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).withColumn("extent", extent)
    width = (high - low) / bins
    # At most one row per bin.
    return (
        frame.filter(low.isNotNull())
        .join(F.broadcast(counts), "bin", "left")
        .select(
            "bin", (low + F.col("bin") * width).alias("low"), (low + (F.col("bin") + 1) * width).alias("high"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins over the range of a column."""
    values = df.select(number(df, column).alias("x"))
    extent = values.agg(F.struct(F.min("x").alias("low"), F.max("x").alias("high")).alias("e")).scalar()
    return _bins(values, extent, bins)


def ols_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of y over x."""
    a, b = number(df, x), number(df, y)
    return df.agg(
        F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"),
        F.regr_r2(b, a).alias("r2"), F.regr_count(b, a).alias("n"),
    )


def scatter_points(df: DataFrame, x: str, y: str, share: float = 1.0, seed: int = 0) -> DataFrame:
    """The complete points of a scatter chart, or a hash sample of them when asked for."""
    points = df.select(number(df, x).alias("x"), number(df, y).alias("y")).filter("x is not null and y is not null")
    return points if share >= 1 else points.sample(share, seed)


def bar_means(df: DataFrame, category: str, value: str) -> DataFrame:
    return group_compare(df, category, value).select("category", "mean")


def trend_line(df: DataFrame, time: str, value: str, unit: str | None = "month") -> DataFrame:
    """Mean of a value per time unit; with `unit=None` the raw points."""
    if unit is None:
        return df.select(col(time).alias("time"), number(df, value).alias("value"))
    bucket = F.date_trunc(unit, col(time).cast("timestamp")).cast("timestamp_ntz").alias("time")
    return df.groupBy(bucket).agg(F.avg(number(df, value)).alias("value"))


def _place(x: Column, extent: Column, cells: int) -> Column:
    """The cell of a value among equal parts of its range; the greatest value is of the last one."""
    share = F.try_divide(x - extent["low"], extent["high"] - extent["low"])
    return F.least(F.floor(F.coalesce(share, F.lit(0.0)) * cells), F.lit(cells - 1)).cast("int")


def trend_points(df: DataFrame, time: str, value: str, pixels: int = 800) -> DataFrame:
    """The points that a line chart of this width can show: (pixel, time, value), four per pixel at most.

    Of the points of each pixel column the first, the last, the least and the greatest are kept, over
    which a line has the same picture as over all. Points without time or value are left out; ties go to
    the smaller value or the earlier time at the lower end and to the greater or later one at the upper.
    """
    t = col(time).cast("timestamp")
    points = df.select(t.alias("time"), number(df, value).cast("double").alias("value")).filter("time is not null and value is not null")
    points = points.withColumn("at", F.unix_micros("time").cast("double"))
    extent = points.agg(F.struct(F.min("at").alias("low"), F.max("at").alias("high")).alias("e")).scalar()
    placed = points.select(_place(F.col("at"), extent, pixels).alias("pixel"), "time", "value")
    along, across = F.struct("time", "value"), F.struct("value", "time")
    ends = placed.groupBy("pixel").agg(F.min(along).alias("a"), F.max(along).alias("b"), F.min(across).alias("c"), F.max(across).alias("d"))
    kept = F.array_distinct(F.array("a", "b", *[F.struct(F.col(f"{c}.time"), F.col(f"{c}.value")) for c in "cd"]))
    return ends.select("pixel", F.inline(kept)).select("pixel", F.col("time").cast("timestamp_ntz").alias("time"), "value")


def scatter_grid(df: DataFrame, x: str, y: str, across: int = 200, down: int = 150) -> DataFrame:
    """One point for each cell of a chart that holds any: (column, row, x, y, n), the least of its n points."""
    points = df.select(number(df, x).cast("double").alias("x"), number(df, y).cast("double").alias("y")).filter("x is not null and y is not null")
    extents = points.agg(F.struct(*[F.struct(F.min(c).alias("low"), F.max(c).alias("high")).alias(c) for c in "xy"]).alias("e")).scalar()
    placed = points.select(_place(F.col("x"), extents["x"], across).alias("column"), _place(F.col("y"), extents["y"], down).alias("row"), F.struct("x", "y").alias("p"))
    return placed.groupBy("column", "row").agg(F.min("p").alias("p"), F.count("*").alias("n")).select("column", "row", "p.x", "p.y", "n")


def box_stats(df: DataFrame, column: str) -> DataFrame:
    """Quartiles, whiskers at the last values inside the fences, and the count beyond them."""
    x = number(df, column)
    q1, median, q3 = quantiles(df, [column], [0.25, 0.5, 0.75])[column]
    if q1 is None:
        low = high = None
    else:
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = F.when(x.between(F.lit(low), F.lit(high)), x)
    row = df.agg(
        F.min(inside).alias("whisker_low"), F.max(inside).alias("whisker_high"),
        (F.count(x) - F.count(inside)).alias("outliers"),
    )
    cuts = [F.lit(v).cast("double").alias(n) for v, n in ((q1, "q1"), (median, "median"), (q3, "q3"))]
    return row.select(F.lit(column).alias("column"), "whisker_low", *cuts, "whisker_high", "outliers")


def violin_density(df: DataFrame, column: str, bins: int = 256, points: int = 64) -> DataFrame:
    """Gaussian density on a fixed grid, from bin counts instead of raw rows."""
    x = number(df, column)
    counts = histogram(df, column, bins).filter("n > 0").withColumn("centre", (F.col("low") + F.col("high")) / 2)
    shape = df.agg(
        F.struct(F.count(x).alias("n"), F.stddev_samp(x).alias("std"), F.min(x).alias("low"), F.max(x).alias("high")).alias("s")
    )
    grid = counts.withColumn("s", shape.scalar()).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    # Scott's rule.
    width = F.col("s.std") * F.pow(F.col("s.n").cast("double"), F.lit(-0.2))
    at = F.col("s.low") + F.col("point") * (F.col("s.high") - F.col("s.low")) / (points - 1)
    z = F.try_divide(at - F.col("centre"), width)
    kernel = F.try_divide(F.col("n") * F.exp(-z * z / 2), F.col("s.n") * width * 2.5066282746310002)
    return grid.groupBy("point", at.alias("x")).agg(F.sum(kernel).alias("density"))


def sentiment_hist(df: DataFrame, text: str, bins: int = 20) -> DataFrame:
    """Polarity of the non-blank texts in bins over [-1, 1]."""
    values = df.filter(not_blank(col(text))).select(polarity(col(text)).alias("x"))
    return _bins(values, F.struct(F.lit(-1.0).alias("low"), F.lit(1.0).alias("high")), bins)


def word_weights(df: DataFrame, text: str, k: int = 200, stop_words: list[str] | None = None) -> DataFrame:
    """The k most frequent lower-case words without stop words, weighted by the most frequent one."""
    stop = STOP_WORDS["en"] if stop_words is None else stop_words
    top = word_counts(df, F.lower(col(text))).filter(~F.col("word").isin(stop)).orderBy(F.desc("n"), "word").limit(k)
    # A window over the k kept rows.
    return top.withColumn("weight", F.col("n") / F.max("n").over(Window.partitionBy(F.lit(1))))


def chart_data(
    df: DataFrame, kind: str, x: str | None = None, y: str | None = None, unit: str | None = "month"
) -> DataFrame | None:
    """The data of one chart kind; missing columns default to the first fitting ones. None if none fits."""
    numbers, strings = numeric_columns(df), string_columns(df)
    if kind == "correlation" and len(numbers) >= 2:
        return corr_matrix(df, numbers)
    if kind == "distribution" and numbers:
        return histogram(df, y or numbers[0])
    if kind == "comparison" and numbers and strings:
        return bar_means(df, x or strings[0], y or numbers[0])
    if kind == "scatter" and len(numbers) >= 2:
        return scatter_points(df, x or numbers[0], y or numbers[1])
    if kind == "trend" and numbers:
        times = [x] if x else time_like_columns(df)
        return trend_line(df, times[0], y or numbers[0], unit) if times else None
    return None
