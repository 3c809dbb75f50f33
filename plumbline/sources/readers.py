"""Readers by format, and the choice among them by file name."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions.columns import col
from plumbline.functions.text import not_blank
from plumbline.operators.corpus import chunks_fixed, chunks_recursive
from plumbline.sources.csv_repair import typed
from plumbline.sources.encoding import read_whole_files

# File kinds by extension.
KINDS = {".csv": "csv", ".xlsx": "excel", ".xls": "excel", ".json": "json", ".pdf": "pdf", ".txt": "text"}

CORRUPT = "_corrupt"

# Spellings read as missing when a table is typed after reading.
NA_VALUES = ("", "NA", "N/A", "NaN", "nan", "NULL", "null", "None", "n/a", "<NA>")


def read_csv(spark: SparkSession, path: str, na_values: tuple[str, ...] | None = None, **options) -> DataFrame:
    """Header and inferred types; reader options pass through.

    With several spellings for missing, cells are read as strings first and typed afterwards.
    """
    if na_values is None:
        return spark.read.options(**{"header": True, "inferSchema": True, **options}).csv(path)
    text = spark.read.options(**{"header": True, "inferSchema": False, **options}).csv(path)
    return typed(text, tuple(na_values))


def read_json(spark: SparkSession, path: str, record_path: str | None = None, **options) -> DataFrame:
    """A list becomes one row per element, an object one row, and so does each line of JSON lines.

    Where nothing can be parsed, files come back as `content` and `metadata`; of files in which some
    records cannot, the others become rows and `json_rejects` returns the rest. `record_path` names a
    nested array whose elements become the rows.
    """
    df = _json(spark, path, options)
    if df.columns == [CORRUPT]:
        files = read_whole_files(spark, path)
        return files.select("content", F.create_map(F.lit("source"), F.col("path")).alias("metadata"))
    if CORRUPT in df.columns:
        df = _json(spark, path, {**options, "mode": "DROPMALFORMED"})
    if record_path:
        rows = df.select(F.explode(F.col(record_path)).alias("record"))
        return rows.select("record.*")
    return df


def json_rejects(spark: SparkSession, path: str) -> DataFrame:
    """The records that `read_json` could not parse: `(content, metadata)`."""
    if _has_json_lines(spark, path):
        records = spark.read.text(path).select(F.col("value").alias("content"), F.input_file_name().alias("path"))
    else:
        records = read_whole_files(spark, path)
    bad = records.filter(not_blank(F.col("content")) & F.try_parse_json("content").isNull())
    return bad.select("content", F.create_map(F.lit("source"), F.col("path")).alias("metadata"))


def _json(spark: SparkSession, path: str, options: dict) -> DataFrame:
    """JSON lines are read line by line, which also splits large files; other files as a whole."""
    settings = {"multiLine": not _has_json_lines(spark, path), "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return spark.read.options(**{**settings, **options}).json(path)


def _has_json_lines(spark: SparkSession, path: str) -> bool:
    """Does the first line hold a whole object and the next one begin another?"""
    lines = [r[0].strip() for r in spark.read.text(path).filter(not_blank(F.col("value"))).limit(2).collect()]
    if len(lines) < 2 or not lines[1].startswith("{"):
        return False
    try:
        return isinstance(json.loads(lines[0]), dict)
    except ValueError:
        return False


def read_text(spark: SparkSession, path: str, overlap: int | None = None, size: int = 1000) -> DataFrame:
    """Documents in chunks `(content, metadata, length)`; an overlap asks for separator-aware chunks."""
    files = read_whole_files(spark, path).filter(not_blank(F.col("content"))).drop("encoding")
    if overlap is None:
        chunks = chunks_fixed(files, "content", size)
    else:
        chunks = chunks_recursive(files, "content", size, overlap)
    out = chunks.select("content", F.create_map(F.lit("source"), F.col("path")).alias("metadata"), "length")
    if out.isEmpty():
        raise ValueError(f"no text in {path}")
    return out


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Width, height and size per image; files that are no images keep NULL measures."""
    sizes = spark.read.format("binaryFile").load(path).select("path", (F.col("length") / 1024.0).alias("size_kb"))
    shapes = spark.read.format("image").option("dropInvalid", True).load(path)
    shapes = shapes.select(F.col("image.origin").alias("path"), "image.width", "image.height")

    def plain(c):
        # The two readers write the scheme differently: file:/x and file:///x.
        return F.regexp_replace(c, "^file:/+", "/")

    sizes, shapes = sizes.withColumn("path", plain(F.col("path"))), shapes.withColumn("path", plain(F.col("path")))
    return sizes.join(shapes, "path", "left")


def image_profile(images: DataFrame) -> DataFrame:
    return images.agg(
        F.count("*").alias("num_images"), F.avg("width").alias("avg_width"), F.avg("height").alias("avg_height"),
        F.avg("size_kb").alias("avg_file_size_kb"),
    )


def dataset_name(path: str) -> str:
    return os.path.splitext(os.path.basename(path.rstrip("/")))[0].lower()


def file_kind(path: str) -> str:
    kind = KINDS.get(os.path.splitext(path)[1].lower())
    if kind is None:
        raise ValueError(f"unsupported file type: {path}")
    return kind


def read_dataset(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read a file by its extension."""
    kind = file_kind(path)
    if kind == "csv":
        return read_csv(spark, path, **options)
    if kind == "json":
        return read_json(spark, path, **options)
    if kind == "text":
        return read_text(spark, path, **options)
    raise NotImplementedError(f"{kind} files need decoding first; give their page texts to page_chunks")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def list_artifacts(spark: SparkSession, path: str, glob: str = "*.html") -> DataFrame:
    """Chart files with their dataset and time of change; file contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    dataset = F.regexp_extract(name, r"^(.*)_\d{8}_\d{6}", 1)
    return files.select(dataset.alias("dataset"), "path", F.col("modificationTime").alias("modified")).filter(
        col("dataset") != ""
    )
