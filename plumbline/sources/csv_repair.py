"""Separators, headers and cells of CSV files that need help."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.functions.columns import col
from plumbline.functions.text import bind
from plumbline.operators.cleaning import sanitize

# Candidate separators in order of preference.
SEPARATORS = [",", ";", "\t", "|"]
SAMPLE_LINES = 10

#: Cells read beyond the first line's width, to tell lines that have too many.
EXTRA_CELLS = 16

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def guess_delimiter(text: Column) -> Column:
    """The separator that occurs most, and equally often per line, in the first ten lines.

    The score is the share of lines that agree with the first one times the mean count; ties go to
    the earlier candidate and NULL means none occurs.
    """
    lines = F.filter(F.slice(F.split(text, "\r\n|\n|\r", SAMPLE_LINES + 1), 1, SAMPLE_LINES), lambda s: s != "")

    def best(some: Column) -> Column:
        def score(rank: int, separator: str) -> Column:
            counts = F.transform(some, lambda s: F.length(s) - F.length(F.replace(s, F.lit(separator), F.lit(""))))

            def rate(c: Column) -> Column:
                # Both factors share the line count, so whole numbers decide the order exactly.
                agree = F.size(F.filter(c, lambda n: n == F.get(c, F.lit(0))))
                total = F.aggregate(c, F.lit(0), lambda a, n: a + n)
                return F.struct(
                    (-agree * total).alias("score"), F.lit(rank).alias("rank"), F.lit(separator).alias("separator")
                )

            return bind(counts, rate)

        top = F.array_min(F.array(*[score(i, s) for i, s in enumerate(SEPARATORS)]))
        return bind(top, lambda t: F.when(t["score"] < 0, t["separator"]))

    return bind(lines, best)


def file_delimiters(files: DataFrame) -> DataFrame:
    """Adds `delimiter` to `(path, content)` rows."""
    return files.withColumn("delimiter", guess_delimiter(F.col("content")))


def text_head(spark: SparkSession, path: str, lines: int = SAMPLE_LINES, encoding: str = "UTF-8") -> str:
    """The first lines of a file or folder."""
    rows = spark.read.option("encoding", encoding).option("lineSep", "\n").csv(path, sep="\u0001", quote="", escape="").limit(lines)
    return "\n".join(r[0] or "" for r in rows.select(F.col("_c0")).collect())


def dedupe_names(names: list[str]) -> list[str]:
    """Repeated names get `_1`, `_2`, … in order of appearance, passing over names that are taken."""
    taken, count = set(names), {}
    out = []
    for name in names:
        if name not in count:
            count[name] = 0
            out.append(name)
            continue
        fresh = name
        while fresh in taken:
            count[name] += 1
            fresh = f"{name}_{count[name]}"
        taken.add(fresh)
        out.append(fresh)
    return out


def _is_number(cell: str | None) -> bool:
    return bool(re.match(r"^-?\d+(\.\d+)?$", "nan" if cell is None else cell))


def header_choice(names: list[str | None], head: list[list[str | None]]) -> tuple[list[str], int]:
    """Final column names and how many of the first data rows to drop.

    A header with unnamed or repeated columns gives way to the first of five rows in which at least
    half of the cells are not numbers.
    """
    unnamed = [n for n in names if n is None or n == "" or n.startswith("Unnamed")]
    final = [f"Unnamed: {i}" if not n else n for i, n in enumerate(names)]
    drop = 0
    if unnamed or len(set(final)) < len(final):
        for i, row in enumerate(head[:5]):
            cells = ["nan" if v is None else v for v in row]
            if sum(not _is_number(v) for v in cells) >= len(cells) / 2:
                final, drop = [v.strip() for v in cells], i + 1
                break
    return dedupe_names(final), drop


def read_repaired_csv(
    spark: SparkSession, path: str, encoding: str = "UTF-8", separator: str | None = None, **options
) -> DataFrame:
    """Read a CSV of unknown separator and header as strings.

    The separator is the one the first lines agree on, a comma if none occurs. Short lines are padded
    with NULL; lines with more cells than the first are left out, and `surplus_lines` returns them.
    Only the first rows reach the driver, to decide on the header.
    """
    wide, width = _wide(spark, path, encoding, separator, options)
    raw = wide.filter(~_surplus(wide, width)).select(*wide.columns[:width])
    top = [list(r) for r in raw.limit(6).collect()]
    if not top:
        raise ValueError(f"no rows in {path}")
    names, drop = header_choice(top[0], top[1:])
    # The lines above the data are the first of the file; they are recognised by their text, and
    # only in the first partition, so the whole file is never numbered.
    first = F.spark_partition_id() == 0
    position = F.monotonically_increasing_id()
    numbered = raw.withColumn("__line", F.when(first, position))
    body = numbered.filter(F.col("__line").isNull() | (F.col("__line") > drop)).drop("__line")
    return body.toDF(*names)


def surplus_lines(
    spark: SparkSession, path: str, encoding: str = "UTF-8", separator: str | None = None, **options
) -> DataFrame:
    """The cells of the lines that `read_repaired_csv` leaves out: `(cells)`."""
    wide, width = _wide(spark, path, encoding, separator, options)
    return wide.filter(_surplus(wide, width)).select(F.array(*[F.col(c) for c in wide.columns]).alias("cells"))


def _wide(spark: SparkSession, path: str, encoding: str, separator: str | None, options: dict) -> tuple[DataFrame, int]:
    """The file with EXTRA_CELLS more columns than its first line has, and that line's width."""
    separator = separator or _separator(spark, path, encoding)
    reader = spark.read.options(header=False, sep=separator, encoding=encoding, mode="PERMISSIVE", **options)
    width = len(reader.csv(path).columns)
    names = [f"_c{i}" for i in range(width + EXTRA_CELLS)]
    return reader.schema(", ".join(f"{n} string" for n in names)).csv(path), width


def _surplus(wide: DataFrame, width: int) -> Column:
    """A cell beyond the first line's width that holds something; empty ones come from closing separators."""
    return F.coalesce(*[F.col(c) for c in wide.columns[width:]]).isNotNull()


def _separator(spark: SparkSession, path: str, encoding: str) -> str:
    sample = spark.createDataFrame([(text_head(spark, path, SAMPLE_LINES, encoding),)], "t string")
    return sample.select(guess_delimiter(F.col("t")).alias("d")).first()["d"] or ","


def typed(df: DataFrame, na_values: tuple[str, ...] = ("",)) -> DataFrame:
    """Give string columns the narrowest type that reads all their values: whole, real, or string."""
    strings = df.columns
    checks = []
    for i, c in enumerate(strings):
        x = F.when(~F.trim(col(c)).isin(*na_values), F.trim(col(c)))
        checks += [
            F.bool_and(x.rlike(r"^[+-]?\d{1,18}$")).alias(f"w{i}"),
            F.bool_and(x.rlike(NUMBER)).alias(f"r{i}"),
            F.count(x).alias(f"n{i}"),
        ]
    seen = df.agg(*checks).first()
    changes = {}
    for i, c in enumerate(strings):
        value = F.when(~F.trim(col(c)).isin(*na_values), col(c))
        if seen[f"n{i}"] and seen[f"w{i}"]:
            changes[c] = F.trim(value).try_cast("bigint")
        elif seen[f"n{i}"] and seen[f"r{i}"]:
            changes[c] = F.trim(value).try_cast("double")
        else:
            changes[c] = value
    return df.withColumns(changes)


def normalize_csv(spark: SparkSession, path: str, out: str, fmt: str = "parquet", **options) -> DataFrame:
    """Repair, sanitise and type a CSV, write it, and return the written table."""
    table = typed(sanitize(read_repaired_csv(spark, path, **options)))
    writer = table.write.mode("errorifexists")
    if fmt == "csv":
        writer.option("header", True).csv(out)
        return spark.read.csv(out, header=True, inferSchema=True)
    writer.format(fmt).save(out)
    return spark.read.format(fmt).load(out)
