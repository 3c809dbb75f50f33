"""Mixing sources to target weights by Pareto order sampling of documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.functions.columns import col
from plumbline.llm.common import Workspace
from plumbline.llm.sharding import uniform

#: Bins per narrowing of a source's ranking; two narrowings leave one row in a million of it.
BINS = 1024

#: Words from which a document counts in full; shorter ones carry SHORT_WEIGHT.
FULL_WORDS, SHORT_WEIGHT = 50, 0.5


def word_count(text: str) -> Column:
    """Number of longest runs without ASCII white space; a missing text has none."""
    # A word starts at each byte that is no white space and follows white space or the start.
    blank = F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(blank, " "), lambda w: w != "")).cast("long")


def share_out(total: float, weights: list[float], limits: list[float]) -> list[float]:
    """`total` in proportion to the weights; what exceeds a limit is shared again among the others."""
    given = [0.0] * len(weights)
    open_ = [i for i, limit in enumerate(limits) if limit > 0 and weights[i] > 0]
    while open_ and total > 0:
        scale = total / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * scale > limits[i]]
        if not full:
            for i in open_:
                given[i] = weights[i] * scale
            break
        for i in full:
            given[i] = float(limits[i])
            total -= limits[i]
        open_ = [i for i in open_ if i not in full]
    return given


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """Per source its words, its target and the expected copies of its short and its full documents.

    `sizes` has source, size and long. Sources are taken by code point, NULL last, and get `weights`
    in turn. The targets add up to `share` of all words unless limits (`most` times the source's
    words) forbid it. Inside a source the target is shared between short and full documents in the
    same way. One row per source passes through the driver, never a document.
    """
    sums = sizes.groupBy("source", "long").agg(F.sum("size").alias("words")).toPandas()
    names = sorted({s for s in sums["source"] if s is not None and s == s}, key=lambda s: [ord(c) for c in s])
    names += [None] if sums["source"].isna().any() else []
    rows, totals, parts = [], [], []
    for name in names:
        own = sums[sums["source"].isna() if name is None else sums["source"] == name]
        parts.append([int(own.loc[own["long"] == flag, "words"].sum()) for flag in (False, True)])
        totals.append(sum(parts[-1]))
    given = share_out(share * sum(totals), [weights[i % len(weights)] for i in range(len(names))], [most * t for t in totals])
    for name, total, part, target in zip(names, totals, parts, given):
        inner = share_out(target, [SHORT_WEIGHT * part[0], 1.0 * part[1]], [most * p for p in part])
        copies = [g / p if p else 0.0 for g, p in zip(inner, part)]
        rows.append((name, total, float(target), float(copies[0]), float(copies[1])))
    spark = sizes.sparkSession
    return spark.createDataFrame(rows, "source string, source_size long, target double, short_copies double, long_copies double")


def plan_mix(
    docs: DataFrame, weights: list[float], share: float, most: float = 2.0, key: str = "doc_id", text: str = "text",
    source: str = "source", seed: str = "mix",
) -> DataFrame:
    """What decides the mix, one row per source: its words, target, expected copies and cut.

    A document of a source is expected e times, with e up to `most`. floor(e) copies are certain. The
    rest pi = e - floor(e) is the chance of one more copy, higher for full documents than for short
    ones (`SHORT_WEIGHT`). Pareto order sampling: each document draws a uniform number u from its key
    and ranks by u/(1-u) : pi/(1-pi); the source takes the lowest ranks until it holds the words that
    its target leaves beside the certain copies. The sample thus has a fixed size, in words: the last
    document is taken if that brings the source nearer to its target. Documents with pi = 0 never win.

    Ranks are cut in two rounds of `BINS` bins summed by source, so that only a millionth of a source
    is ever sorted in one window.
    """
    work = Workspace(docs.sparkSession)
    sizes = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(text).alias("size"))
    sizes = work.table(sizes.withColumn("long", F.col("size") >= FULL_WORDS), "sizes")
    targets = source_targets(sizes, weights, share, most)
    rows = work.table(_ranked(_join(sizes, targets), seed).withColumns({"coarse": F.floor(F.col("bin") / BINS), "fine": F.col("bin") % BINS}), "ranked")
    drawn = rows.filter("rank is not null")
    sure = rows.groupBy("source", "target").agg(F.sum(F.col("certain") * F.col("size")).alias("sure"))
    want = sure.select("source", (F.col("target") - F.col("sure")).alias("want"))

    def edge(sums: DataFrame, by: str, want: DataFrame) -> DataFrame:
        """Per source the first bin that brings the running words over `want`, and what it may add."""
        running = F.sum("words").over(W.partitionBy("source").orderBy(by))
        over = _join(sums.withColumn("through", running), want).filter(F.col("through") > F.col("want"))
        first = over.groupBy("source").agg(F.min(F.struct(by, "through", "words", "want")).alias("e"))
        return first.select("source", F.col(f"e.{by}").alias(f"edge_{by}"), F.expr("e.want - (e.through - e.words)").alias("want"))

    # Both sums have at most BINS rows per source; the edges have one.
    first = work.table(edge(drawn.groupBy("source", "coarse").agg(F.sum("size").alias("words")), "coarse", want), "first")
    inner = _join(drawn, first.drop("want")).filter("coarse = edge_coarse")
    second = edge(inner.groupBy("source", "fine").agg(F.sum("size").alias("words")), "fine", first)
    second = work.table(_join(second, first.drop("want"), "left"), "second")
    close = _join(drawn, second).filter("coarse = edge_coarse and fine = edge_fine")
    before = F.coalesce(F.sum("size").over(W.partitionBy("source").orderBy("rank", "key", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # Half a document over or under: whichever is nearer to the target.
    taken = close.withColumn("before", before).filter(F.col("before") + F.col("size") / 2 <= F.col("want"))
    cut = taken.groupBy("source").agg(F.max(F.struct("rank", "key", "size")).alias("cut"))
    edges = second.select("source", (F.col("edge_coarse") * BINS + F.col("edge_fine")).alias("edge"))
    plan = work.table(_join(_join(targets, edges, "left"), cut, "left"), "plan")
    work.drop("sizes", "ranked", "first", "second")
    return plan


def _ranked(rows: DataFrame, seed: str) -> DataFrame:
    """Adds the certain copies and, where one more may be drawn, rank and bin."""
    e = F.when(F.col("long"), F.col("long_copies")).otherwise(F.col("short_copies"))
    rows = rows.withColumn("certain", F.floor(e)).withColumn("pi", e - F.floor(e))
    u = uniform(F.coalesce(F.col("key").cast("string"), F.lit("null")), seed)
    odds = (u / (1 - u)) / (F.col("pi") / (1 - F.col("pi")))
    # x/(1+x) brings the ranking value into (0, 1) and keeps its order.
    rows = rows.withColumn("rank", F.when(F.col("pi") > 0, odds / (1 + odds)))
    return rows.withColumn("bin", F.floor(F.col("rank") * (BINS * BINS)).cast("long"))


def mix_sources(
    docs: DataFrame, weights: list[float], share: float, most: float = 2.0, key: str = "doc_id", text: str = "text",
    source: str = "source", seed: str = "mix", keep: list[str] | None = None,
) -> DataFrame:
    """The columns `keep` of `docs` (all if None) with a struct `mix`: size, source_size, target, copies.

    `copies` says how often the mix takes the document, as `plan_mix` decides; with the plan, one row
    per source, every row is decided where it lies. Rows that repeat key, source and size share their
    draw and are all taken or not. Documents without words are taken like any other but weigh nothing.
    A missing source is a source of its own, a missing key draws as `null`. An empty table gives no
    rows. Reruns agree.
    """
    plan = plan_mix(docs, weights, share, most, key, text, source, seed)
    plan = plan.select(F.struct(*plan.columns).alias("__plan"), F.col("source").alias("__of"))
    kept = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*map(col, kept)).alias("__kept"), F.col(key).alias("key"), F.col(source).alias("source"), word_count(text).alias("size"))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("__of"))).select("__kept", "key", "size", "__plan.*")
    rows = _ranked(rows.withColumn("long", F.col("size") >= FULL_WORDS), seed)
    at_cut = F.expr("bin = edge and cut is not null and struct(rank, key, size) <= cut")
    extra = F.coalesce(F.expr("rank is not null and (edge is null or bin < edge)") | at_cut, F.lit(False))
    copies = (F.col("certain") + extra.cast("int")).cast("long").alias("copies")
    return rows.select("__kept.*", F.struct("size", "source_size", "target", copies).alias("mix"))


def _join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on source, NULL being a source; `right` has one row per source."""
    right = right.withColumnRenamed("source", "__source")
    return left.join(right, F.col("source").eqNullSafe(F.col("__source")), how).drop("__source")
