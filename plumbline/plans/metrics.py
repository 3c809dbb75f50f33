"""Statistics of a table that grows by slices, kept as states that merge.

A slice is read once, when it is added: its states go to folders of its own below the table's, and
adding it again replaces them. Numbers keep count, mean, squared deviations, extremes, a KLL sketch of
quantiles and an HLL sketch of distinct values; pairs of numbers keep sums of products around centres
fixed by the first slice; texts keep their most frequent values with the count that any other value may
have at most. Merging reads states only, so a report over all slices costs no scan of the table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.utils import AnalysisException

from plumbline.functions.columns import col, number, numeric_columns, string_columns
from plumbline.operators import stats
from plumbline.operators.quantiles import Summary, quantiles
from plumbline.operators.stats import _correlations, _cross_products, PAIR_SUMS, latest, literal_table

#: Parameter of the quantile sketches and the error in rank that it allows for, with margin; bits of distinct sketches.
KLL_K, RANK_ERROR, HLL_BITS = 4_096, 0.002, 14

#: Most frequent values kept per text column and slice.
KEPT = 1_000

QUARTERS = [0.25, 0.5, 0.75]


class Metrics:
    """States of a table's slices below one shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, kind: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{kind}")

    def _write(self, df: DataFrame, kind: str, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{kind}/slice=s.{name}")

    def _centres(self, df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
        """Centre and scale per numeric column, as the first slice has them; for later columns 0 and 1."""
        try:
            kept = self._read("centres").collect()
        except AnalysisException:  # the first slice
            row = df.agg(*[f(number(df, c)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_samp))]).first() if columns else {}
            found = [(c, float(row[f"m{i}"] or 0.0), float(row[f"s{i}"] or 1.0)) for i, c in enumerate(columns)]
            literal_table(df, found, {"column": "string", "centre": "double", "scale": "double"}).coalesce(1).write.parquet(f"{self.folder}/centres")
            return {c: (m, s) for c, m, s in found}
        return {r["column"]: (r["centre"], r["scale"]) for r in kept}

    def add(self, df: DataFrame, name: str) -> None:
        """Add a slice, or replace the one of this name. `name` consists of letters, digits, `_`, `-` and `.`."""
        if not re.fullmatch(r"[\w.-]+", name):
            raise ValueError(f"not a name of a slice: {name!r}")
        numbers, texts = numeric_columns(df), string_columns(df)
        centres = self._centres(df, numbers)
        cells = [F.count("*").alias("rows")]
        for i, c in enumerate(numbers):
            x = number(df, c).cast("double")
            cells += [
                F.struct(
                    F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.count("*").alias("rows"), F.count(x).alias("count"), F.avg(x).alias("mean"),
                    (F.var_pop(x) * F.count(x)).alias("squares"), F.min(x).alias("low"), F.max(x).alias("high"),
                    F.kll_sketch_agg_double(x, F.lit(KLL_K)).alias("ranks"), F.hll_sketch_agg(x.cast("string"), HLL_BITS).alias("values"),
                ).alias(f"c{i}")
            ]
        if numbers:
            states = df.agg(*cells).select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(numbers))])))
            self._write(states, "numbers", name)
            scaled = [((number(df, c).cast("double") - F.lit(m)) / F.lit(s)).alias(f"v{i}") for i, c in enumerate(numbers) for m, s in [centres.get(c, (0.0, 1.0))]]
            sums = df.select(*scaled).mapInArrow(_cross_products, "i int, " + ", ".join(f"{s} binary" for s in PAIR_SUMS))
            self._write(sums.withColumn("columns", F.lit("\x1f".join(numbers))), "pairs", name)
        if texts:
            said = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in texts])).alias("cell")).select("cell.*")
            counts = said.filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
            first = latest(counts, ["column"], [F.desc("n"), F.col("value")], KEPT)
            # What is left out occurs as often as the least of a full list, at most.
            least = F.when(F.count("*").over(Window.partitionBy("column")) == KEPT, F.min("n").over(Window.partitionBy("column"))).otherwise(0)
            self._write(first.withColumn("most_left", least), "values", name)

    def slices(self) -> list[str]:
        return sorted(r["slice"].removeprefix("s.") for r in self._read("numbers").select("slice").distinct().collect())

    def _merged(self) -> DataFrame:
        """One row per numeric column: sums of states, merged sketches."""
        states = self._read("numbers")
        whole = states.groupBy("column").agg(F.sum("count").alias("n"), (F.sum(F.col("count") * F.col("mean")) / F.sum("count")).alias("centre"))
        joined = states.join(F.broadcast(whole), "column")  # one row per column
        spread = F.col("squares") + F.col("count") * (F.col("mean") - F.col("centre")) ** 2
        return joined.groupBy("column").agg(
            F.min("ordinal").alias("ordinal"), F.sum("rows").alias("rows"), F.sum("count").alias("count"), F.first("centre").alias("mean"),
            F.sum(spread).alias("squares"), F.min("low").alias("min"), F.max("high").alias("max"),
            F.kll_merge_agg_double("ranks").alias("ranks"), F.hll_union_agg("values").alias("values"),
        )

    def basic_stats(self) -> DataFrame:
        """As `stats.basic_stats` over all slices, and `distinct`.

        Count, mean, deviation and extremes are exact; quartiles have an error in rank of at most
        RANK_ERROR, distinct values one of about 2 in 100.
        """
        m = self._merged()
        cut = [F.kll_sketch_get_quantile_double("ranks", F.lit(p)) for p in QUARTERS]
        deviation = F.when(F.col("count") > 1, F.sqrt(F.col("squares") / (F.col("count") - 1)))
        here = F.col("count") > 0
        return m.select(
            "ordinal", "column", "mean", deviation.alias("std"), "min", *[F.when(here, q).alias(n) for q, n in zip(cut, ("q1", "median", "q3"))],
            "max", "count", F.hll_sketch_estimate("values").alias("distinct"),
        )

    def exact_stats(self, df: DataFrame) -> DataFrame:
        """As `stats.basic_stats`, with quartiles exact over `df`, all slices together.

        The merged sketches give two values that hold each quartile between them, so that the table is
        read only to count and to rank what lies between.
        """
        low, high = ([F.kll_sketch_get_quantile_double("ranks", F.lit(min(max(p + e, 0.0), 1.0))) for p in QUARTERS] for e in (-RANK_ERROR, RANK_ERROR))
        rows = self._merged().filter("count > 0").select("*", F.array(*low).alias("low_ends"), F.array(*high).alias("high_ends")).drop("ranks", "values").collect()
        deviation = {r["column"]: (r["squares"] / (r["count"] - 1)) ** 0.5 if r["count"] > 1 else None for r in rows}
        seen = {r["column"]: Summary(r["rows"], r["count"], r["min"], r["max"], r["mean"], deviation[r["column"]]) for r in rows}
        columns = [r["column"] for r in sorted(rows, key=lambda r: r["ordinal"])]
        hints = {r["column"]: list(zip(r["low_ends"], r["high_ends"])) for r in rows}
        cuts = quantiles(df, columns, QUARTERS, seen, hints=hints)
        out = [(i, c, s.mean, s.std, s.low, *cuts[c], s.high, s.count) for i, (c, s) in enumerate((c, seen[c]) for c in columns)]
        return literal_table(df, out, {"ordinal": "int", "column": "string", **stats.STATISTICS})

    def corr_matrix(self) -> DataFrame:
        """As `stats.corr_matrix` over all slices, which must have the same numeric columns."""
        pairs = self._read("pairs")
        named = [r["columns"] for r in pairs.select("columns").distinct().collect()]
        if len(named) > 1:
            raise ValueError("slices of different columns have no common matrix")
        names = F.array(*[F.lit(c) for c in named[0].split("\x1f")])
        found = pairs.select("i", *PAIR_SUMS).repartition("i").mapInArrow(_correlations, "i int, j int, r double")
        return found.select("i", "j", F.get(names, F.col("i")).alias("col1"), F.get(names, F.col("j")).alias("col2"), "r")

    def top_values(self, k: int = 10) -> DataFrame:
        """The k most frequent values per text column: column, value, at_least and at_most.

        Bounds are equal where no slice has more than KEPT distinct values of the column.
        """
        values = self._read("values")
        slices = values.groupBy("column", "slice").agg(F.first("most_left").alias("most_left"))
        slack = slices.groupBy("column").agg(F.sum("most_left").alias("slack"))
        sums = values.groupBy("column", "value").agg(F.sum("n").alias("at_least"), F.sum("most_left").alias("own"))
        found = sums.join(F.broadcast(slack), "column").select("column", "value", "at_least", (F.col("at_least") + F.col("slack") - F.col("own")).alias("at_most"))
        return latest(found, ["column"], [F.desc("at_least"), F.col("value")], k)
