"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import Workspace


def connected_components(links: DataFrame, work: Workspace, name: str = "components") -> DataFrame:
    """Per linked vertex, the smallest vertex of its component: rows (vertex, root), for links (a, b).

    Large stars and small stars in turn until nothing changes, which takes about log^2 of the longest
    path in rounds. Neighbours are never gathered: each vertex' smallest neighbour is a minimum, summed
    up before the shuffle, and written; both sides of the join that brings it back are then tables, so
    that a vertex with a large share of all links can be split among tasks.
    """
    stars = work.table(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0"
    )
    before, step = None, 0
    while True:
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        step += 1
        # Large star: every larger neighbour joins the smallest of the neighbourhood.
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = work.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-{step}-low", 2 * state[0])
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = work.table(large.distinct(), f"{name}-{step}-large", 2 * state[0])
        # Small star: a vertex and its smaller neighbours join the smallest of them.
        least = work.table(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-{step}-least", 2 * state[0])
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        following = work.table(small.distinct(), f"{name}-{step}", 4 * state[0])
        work.drop(f"{name}-{step - 1}", f"{name}-{step}-low", f"{name}-{step}-large", f"{name}-{step}-least", 2 * state[0])
        stars = following
    roots = stars.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct()
    return stars.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionByName(roots)
