"""Rendezvous hashing of record keys over weighted shards."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Rows that one numbering window may hold on average; more rows make more windows.
WINDOW_ROWS = 50_000

#: Bits of md5 that make the uniform number of a (key, shard) pair; exact in a double.
UNIFORM_BITS = 52


def uniform(key: Column, salt: str) -> Column:
    """A number in (0, 1) from the md5 of key and salt."""
    digits = F.substring(F.md5(F.concat(key, F.lit(":" + salt)).cast("binary")), 1, UNIFORM_BITS // 4)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**UNIFORM_BITS)


def rendezvous(key: str, weights: list[float]) -> Column:
    """The shard of a key: each shard draws `-ln(u(key, shard)) / weight`, the least draw wins.

    A draw depends on nothing but the key and its own shard, so a new shard takes the rows on which
    it wins and moves no other row, and a row's chance of a shard is the shard's share of weight.
    A missing key counts as the text `null`. Ties (equal draws) go to the lower shard number.
    """
    if not weights or any(w < 0 for w in weights) or not any(weights):
        raise ValueError("weights must not be negative, and one must be above zero")
    text = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    draws = [
        F.struct((-F.log(uniform(text, str(shard))) / weight).alias("draw"), F.lit(shard).alias("shard"))
        for shard, weight in enumerate(weights)
        if weight
    ]
    return (draws[0] if len(draws) == 1 else F.least(*draws))["shard"]


def with_shard(docs: DataFrame, weights: list[float], key: str = "doc_id", name: str = "shard") -> DataFrame:
    """`docs` with the shard of each row's key; nothing is shuffled. A column of that name is replaced."""
    return docs.withColumn(name, rendezvous(key, weights))


def assign_shards(
    docs: DataFrame, weights: list[float], key: str = "doc_id", text: str = "text", grow_by: float | None = None
) -> DataFrame:
    """Shard, place in the shard, size and checksum of every row of `docs`.

    Returns `key`, size (UTF-8 bytes of the text, none if missing, plus 1), text_crc32, shard, slot and
    grown_shard: the shard once one more shard of weight `grow_by` exists (NULL without `grow_by`).

    Slots count 0, 1, … in each shard, in the order of a uniform number drawn from the key. That number
    is cut into classes; rows are counted per class and numbered within a class behind the classes
    before it, so no window holds a whole shard. Rows that repeat key and text are counted once with
    their number and take as many slots in a row. A missing key is a key like any other. Other columns
    are not read; an empty table gives none.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    named = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    columns = ["key", "size", "text_crc32", "shard", "grown_shard", "place"]
    rows = docs.select(
        F.col(key).alias("key"), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"), rendezvous(key, weights).alias("shard"),
        (rendezvous(key, [*weights, grow_by]) if grow_by else F.lit(None)).cast("int").alias("grown_shard"),
        uniform(named, "slot").alias("place"),
    )
    classes = max(1, math.ceil(docs.count() / (WINDOW_ROWS * len(weights))))
    rows = rows.groupBy(*columns).agg(F.count("*").alias("times"))
    rows = rows.withColumn("class", F.floor(F.col("place") * classes).cast("int"))
    # One row per shard and class.
    counts = rows.groupBy("shard", "class").agg(F.sum("times").alias("n"))
    base = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("class").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("shard", "class", base.alias("base"))
    inside = W.partitionBy("shard", "class").orderBy("place", "key", "text_crc32", "size")
    before = F.coalesce(F.sum("times").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before).join(counts, ["shard", "class"])
    slots = F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1))
    numbered = rows.withColumn("again", slots)
    return numbered.select(
        F.col("key").alias(key), "size", "text_crc32", "shard",
        (F.col("base") + F.col("before") + F.col("again")).cast("long").alias("slot"), "grown_shard",
    )
