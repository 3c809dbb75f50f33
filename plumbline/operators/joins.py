"""Joins whose probe side may hold a large share of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Tasks among which one key of the probe side is dealt.
SALTS = 16

#: Keys of the probe side that count as frequent, at most. Any other key has less than one in so many of its rows.
FREQUENT = 1_000


def salted_join(
    probe: DataFrame, lookup: DataFrame, keys: list[str], spread_by: list[str], how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Join to a lookup of few rows per key, each key of the probe side dealt among `salts` tasks.

    Adaptive execution splits a hot key only where both inputs come straight from a shuffle, which an
    aggregated lookup does not. Rows of the probe are dealt by a hash of `spread_by`, the lookup is
    repeated once per salt: meant for lookups much smaller than the probe side.
    """
    dealt = probe.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.lit(salts)).cast("int"))
    copies = lookup.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*keys, "__salt"], how).drop("__salt")


def frequent_join(
    probe: DataFrame, lookup: DataFrame, keys: list[str], spread_by: list[str], how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """As `salted_join`, for lookups that may be as large as the probe side.

    Only the FREQUENT most frequent keys of the probe side are dealt, and rows without a key, so all but
    that many rows of the lookup stay single. The probe side is read once more, to count its keys.
    """
    often = frequent_keys(probe, keys)
    missing = F.greatest(*[F.col(c).isNull() for c in keys], F.lit(False))
    deal = F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.lit(salts)).cast("int")
    # A bounded number of rows.
    dealt = probe.join(F.broadcast(often), keys, "left").withColumn("__salt", F.when(F.col("__often") | missing, deal).otherwise(0)).drop("__often")
    return dealt.join(copies_of(lookup, often, keys, salts), [*keys, "__salt"], how).drop("__salt")


def frequent_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The FREQUENT most frequent keys, marked `__often`."""
    counts = rows.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("__n"))
    return counts.orderBy(F.desc("__n"), *keys).limit(FREQUENT).select(*keys, F.lit(True).alias("__often"))


def copies_of(lookup: DataFrame, often: DataFrame, keys: list[str], salts: int = SALTS) -> DataFrame:
    """Rows of the lookup for salt 0, those of frequent keys for every salt."""
    salted = F.when(F.col("__often"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return lookup.join(F.broadcast(often), keys, "left").withColumn("__salt", F.explode(salted)).drop("__often")
