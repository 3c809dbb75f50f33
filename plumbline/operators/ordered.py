"""Ordered scans that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.columns import col
from plumbline.session import materialized


def range_split(df: DataFrame, columns: list[str]) -> DataFrame:
    """Range-partition by the sort columns and fix each row's part number in `__part`.

    The ranges come from a sample, so the split is pinned with a reliable checkpoint: both later
    uses must see the same parts, also after an executor is lost.
    """
    parts = df.repartitionByRange(*[col(c) for c in columns])
    return materialized(parts.withColumn("__part", F.spark_partition_id()))


def forward_fill(
    df: DataFrame, columns: list[str], order_by: list[str], partition_by: list[str] | None = None
) -> DataFrame:
    """Carry the last non-null value forward within each partition key.

    Every part fills itself; what a part inherits from earlier parts of its key is one row per part
    border, so a single hot key is spread over many tasks.
    """
    keys = partition_by or []
    parts = range_split(df, keys + order_by)
    order = [col(c) for c in order_by]
    by_part: list[Column] = [F.col("__part"), *[col(k) for k in keys]]

    last = parts.groupBy(*by_part).agg(
        *[
            F.max_by(col(c), F.when(col(c).isNotNull(), F.struct(*order))).alias(f"__last{i}")
            for i, c in enumerate(columns)
        ]
    )
    earlier = Window.partitionBy(*[col(k) for k in keys]).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(
        *by_part, *[F.last(f"__last{i}", ignorenulls=True).over(earlier).alias(f"__carry{i}") for i in range(len(columns))]
    )
    reached = F.lit(False)
    for i in range(len(columns)):
        reached = reached | F.col(f"__carry{i}").isNotNull()
    renamed = {k: f"__key{j}" for j, k in enumerate(["__part", *keys])}
    carried = carried.filter(reached).withColumnsRenamed(renamed)
    match = F.lit(True)
    for k, other in renamed.items():
        match = match & col(k).eqNullSafe(F.col(other))
    # Only the first key of a part can reach back, so at most one row per part is broadcast.
    joined = parts.join(F.broadcast(carried), match, "left")

    so_far = Window.partitionBy(*by_part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = {
        c: F.coalesce(F.last(col(c), ignorenulls=True).over(so_far), F.col(f"__carry{i}"))
        for i, c in enumerate(columns)
    }
    return joined.select(*[filled[c].alias(c) if c in filled else col(c) for c in df.columns])
