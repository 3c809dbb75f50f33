"""Shared pieces: intermediate tables, folds, bitmaps of ids, batches of bounded size."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.functions.columns import col
from plumbline.session import ensure_checkpoint_dir

#: Bytes of text handled at once inside a task; longer documents are handled alone.
TEXT_BLOCK = 1 << 20

#: Rows of a written table that one task may handle, where their number is known.
TABLE_ROWS = 100_000

#: Bits of an id bitmap. Its size never depends on the data; a crowded one only filters less.
BITMAP_BITS = 1 << 23


class Workspace:
    """Intermediate tables in a folder of their own below the session's checkpoint folder.

    A written table cuts the lineage and survives lost executors. Tables that a returned DataFrame
    reads stay; `drop` removes one that nothing reads any more.
    """

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.root = f"{spark.sparkContext.getCheckpointDir()}/llm-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """The written table. Known to have few `rows`, at most, it is written by as few tasks as these need."""
        path = f"{self.root}/{name}"
        if rows is not None:
            df = df.coalesce(-(-rows // TABLE_ROWS) or 1)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a missing id counts as 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds, F.lit(0))


def blocks(batch: pa.RecordBatch, column: str, limit: int = TEXT_BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about `limit` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    # Earlier batches are gone; their memory would else stay with the worker.
    pa.default_memory_pool().release_unused()
    text = batch.column(batch.schema.get_field_index(column))
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype("int64"))
    start, done = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(start, stop - start)
        done, start = int(ends[stop - 1]), stop


def text_rows(docs: DataFrame, keep: list[str], text: str) -> tuple[DataFrame, int]:
    """The columns `keep` of `docs` and the place of the text, which is added behind them if they lack it."""
    if text in keep:
        return docs.select(*map(col, keep)), keep.index(text)
    return docs.select(*map(col, keep), col(text).alias("__text")), len(keep)


def id_bitmap(ids: DataFrame, column: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """One bit per hashed id: a set that may hold more than was put in, never less.

    At most bits / 64 rows reach the driver, whatever the number of ids.
    """
    bit = F.pmod(F.xxhash64(F.col(column)), F.lit(bits))
    cells = ids.select(bit.alias("b")).select(
        F.shiftright("b", 6).cast("int").alias("cell"), F.expr("shiftleft(1L, cast(b & 63 as int))").alias("mask")
    )
    got = cells.groupBy("cell").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[got["cell"].to_numpy()] = got["mask"].to_numpy()
    return out.view(np.uint64)


def in_bitmap(df: DataFrame, column: str, bitmap: np.ndarray, inside: bool = True) -> DataFrame:
    """Rows whose id may be in the bitmap (or, with inside=False, surely is not)."""
    shared, bits = df.sparkSession.sparkContext.broadcast(bitmap), len(bitmap) * 64
    schema = df.schema
    marked = df.withColumn("__bit", F.pmod(F.xxhash64(F.col(column)), F.lit(bits)))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column(batch.num_columns - 1).to_numpy().astype(np.uint64)
            hit = (shared.value[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1)
            rows = batch.filter(pa.array(hit.astype(bool) == inside))
            yield pa.RecordBatch.from_arrays(rows.columns[:-1], names=rows.schema.names[:-1])

    return marked.mapInArrow(keep, schema)
