"""Bytes to text, tolerant of the usual encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Windows-1252 characters of the bytes 0x80-0x9F that have one, in byte order.
C1_BYTES = [0x80, *range(0x82, 0x8D), 0x8E, *range(0x91, 0x9D), 0x9E, 0x9F]
C1_TEXT = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def is_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def has_undefined_cp1252(content: Column) -> Column:
    """True where a byte has no windows-1252 character."""
    return F.decode(content, "ISO-8859-1").rlike("[\\x81\\x8D\\x8F\\x90\\x9D]")


def encoding_of(content: Column) -> Column:
    return F.when(is_utf8(content), "utf-8").when(has_undefined_cp1252(content), "utf-8-lossy").otherwise("cp1252")


def decoded(content: Column) -> Column:
    """UTF-8 where valid, else windows-1252, else UTF-8 without its bad bytes."""
    latin = F.decode(content, "ISO-8859-1")
    cp1252 = F.translate(latin, "".join(chr(b) for b in C1_BYTES), C1_TEXT)
    lossy = F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))
    return F.when(is_utf8(content), content.cast("string")).when(has_undefined_cp1252(content), lossy).otherwise(cp1252)


def read_whole_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row `(path, content, encoding)` per file, for documents that fit a cell."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", decoded(F.col("content")).alias("content"), encoding_of(F.col("content")).alias("encoding"))
