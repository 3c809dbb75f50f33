"""Registration of queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from workload.views import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(tables) -> DataFrame`; doubles of the result are rounded to four digits."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(Tables(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn

    return register


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    real = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    # Adding zero turns -0.0 into 0.0.
    return df.withColumns({c: F.round(F.col(f"`{c}`").cast("double"), digits) + F.lit(0.0) for c in real})


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def words_sql(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"
