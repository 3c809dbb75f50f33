"""Named datasets and the stored log, as catalog tables and Parquet folders."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.operators.history import retain_insights, retain_sessions
from plumbline.operators.profile import column_catalog


def put(df: DataFrame, name: str, table: bool = False) -> None:
    """Register a dataset under its name, as a view or as a saved table."""
    if table:
        df.write.mode("errorifexists").saveAsTable(name)
    else:
        df.createOrReplaceTempView(name)


def get(spark: SparkSession, name: str) -> DataFrame:
    if not spark.catalog.tableExists(name):
        raise KeyError(f"no dataset named {name!r}")
    return spark.table(name)


def names(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def column_catalogs(spark: SparkSession, datasets: list[str]) -> DataFrame:
    """Schemas of several datasets in one catalog."""
    out = column_catalog(get(spark, datasets[0]), datasets[0])
    for name in datasets[1:]:
        out = out.unionByName(column_catalog(get(spark, name), name))
    return out


class Log:
    """Sessions, findings and dataset records in one folder, appended to and read back trimmed.

    Every append is a folder of its own below the kind's `batches`. A compaction writes the kept rows to a
    new folder below `generations` and then, last, one numbered file below `pointers` that names it and the
    batches it covers. A reader takes the highest pointer's generation and all batches it does not cover, so
    a compaction that dies loses nothing and one that runs while others append leaves their batches in.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, *parts: str) -> str:
        return os.path.join(self.folder, *parts)

    def _fs(self, path: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, *parts: str, complete: bool = False) -> list[str]:
        """Names in a folder; of tables only those that are written to the end, if asked."""
        fs, at = self._fs(self._path(*parts))
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(n for n in names if not complete or fs.exists(self._fs(self._path(*parts, n, "_SUCCESS"))[1]))

    def append(self, kind: str, rows: DataFrame) -> None:
        rows.write.parquet(self._path(kind, "batches", uuid.uuid4().hex))

    def _pointer(self, kind: str) -> tuple[int, str | None, set[str]]:
        """Number of the last compaction, its generation and the batches it covers."""
        # Files that are still being written have another ending.
        numbers = [int(n.removesuffix(".json")) for n in self._names(kind, "pointers") if n.endswith(".json")]
        if not numbers:
            return 0, None, set()
        row = json.loads("".join(r["value"] for r in self.spark.read.text(self._path(kind, "pointers", f"{max(numbers):09d}.json")).collect()))
        return max(numbers), row["generation"], set(row["covers"])

    def _folders(self, kind: str) -> list[str]:
        _, generation, covered = self._pointer(kind)
        fresh = [self._path(kind, "batches", n) for n in self._names(kind, "batches", complete=True) if n not in covered]
        return fresh + ([self._path(kind, "generations", generation)] if generation else [])

    def read(self, kind: str) -> DataFrame:
        return self.spark.read.parquet(*self._folders(kind))

    def compact(self, kind: str) -> None:
        """Bring the kept rows of a kind together. Others may append meanwhile, or compact: the later one then fails."""
        number, _, _ = self._pointer(kind)
        covers = set(self._names(kind, "batches", complete=True))
        kept = {"sessions": self.sessions, "insights": self.insights, "datasets": self.datasets}[kind]
        # The rows are those of the folders listed here, whatever is appended from now on.
        rows, fresh = kept(self.spark.read.parquet(*self._folders_of(kind, covers))), uuid.uuid4().hex
        rows.hint("rebalance").write.parquet(self._path(kind, "generations", fresh))
        self._point(kind, number + 1, fresh, covers)

    def _folders_of(self, kind: str, batches: set[str]) -> list[str]:
        _, generation, covered = self._pointer(kind)
        listed = [self._path(kind, "batches", n) for n in sorted(batches - covered)]
        return listed + ([self._path(kind, "generations", generation)] if generation else [])

    def _point(self, kind: str, number: int, generation: str, covers: set[str]) -> None:
        """Write the pointer under another name and give it its own, which only one can."""
        text = json.dumps({"generation": generation, "covers": sorted(covers)})
        fs, draft = self._fs(self._path(kind, "pointers", f"{generation}.draft"))
        stream = fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        _, final = self._fs(self._path(kind, "pointers", f"{number:09d}.json"))
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"another compaction of {kind} was faster")

    def sweep(self, kind: str) -> None:
        """Delete what the last pointer has made superfluous; no reader may still use an earlier one."""
        number, generation, covered = self._pointer(kind)
        old = [("batches", n) for n in self._names(kind, "batches") if n in covered]
        old += [("generations", n) for n in self._names(kind, "generations") if n != generation] if generation else []
        old += [("pointers", n) for n in self._names(kind, "pointers") if n.endswith(".json") and int(n.removesuffix(".json")) < number]
        for folder, name in old:
            fs, at = self._fs(self._path(kind, folder, name))
            fs.delete(at, True)

    def sessions(self, rows: DataFrame | None = None) -> DataFrame:
        """The last twenty sessions per dataset."""
        return retain_sessions(self.read("sessions") if rows is None else rows)

    def insights(self, rows: DataFrame | None = None) -> DataFrame:
        """The last five findings per dataset and topic."""
        return retain_insights(self.read("insights") if rows is None else rows)

    def datasets(self, rows: DataFrame | None = None) -> DataFrame:
        """The latest record per dataset."""
        rows = self.read("datasets") if rows is None else rows
        newest = F.max_by(F.struct(*rows.columns), "load_time").alias("r")
        return rows.groupBy("dataset").agg(newest).select("r.*")
