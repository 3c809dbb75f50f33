"""Exact quantiles that never gather a whole column in one task.

The wanted ranks are closed in by rank, so the number of scans does not depend on how the values are
spread: approximate percentiles, whose error in rank is known, give two values between which a rank
must lie; a second scan counts the rows below and between them. That leaves about 4 rows in
ACCURACY. A bracket that still holds more than RANK_LIMIT rows is narrowed again, the others are
ranked value by value. What reaches the driver is a few numbers per column and quantile.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from plumbline.functions.columns import number

#: Rows of a bracket that are ranked in one window.
RANK_LIMIT = 100_000

#: Rank error of an approximate percentile is at most 1 / ACCURACY of the rows.
ACCURACY = 10_000

#: Brackets per aggregation, which bounds expressions and rows on the driver for wide tables.
BATCH = 60


@dataclass
class Summary:
    """Rows of the table, and count, extremes, mean and sample deviation of a column's values."""

    rows: int
    count: int
    low: float | None
    high: float | None
    mean: float | None
    std: float | None


def summary(df: DataFrame, columns: list[str]) -> dict[str, Summary]:
    """The summaries of several columns from one scan."""
    if not columns:
        return {}
    functions = (F.count, F.min, F.max, F.avg, F.stddev_samp)
    values = df.select(*[number(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    row = values.agg(
        F.count("*").alias("rows"),
        *[f(f"v{i}").alias(f"s{i}_{k}") for i in range(len(columns)) for k, f in enumerate(functions)],
    ).first()
    return {c: Summary(row["rows"], *[row[f"s{i}_{k}"] for k in range(len(functions))]) for i, c in enumerate(columns)}


def quantiles(
    df: DataFrame,
    columns: list[str],
    probs: list[float],
    seen: dict[str, Summary] | None = None,
    rank_limit: int | None = None,
    hints: dict[str, list[tuple[float, float]]] | None = None,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column, as pandas defines them.

    Runs jobs and returns plain numbers: `len(columns) * len(probs)` of them. `seen` spares the
    first scan where the summaries are known. `hints` has per column two values for each prob that
    probably hold it between them; one that does not only costs what it would have spared.
    """
    if not columns:
        return {}
    seen = summary(df, columns) if seen is None else seen
    values = df.select(*[number(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    brackets, positions = {}, {}
    for i, c in enumerate(columns):
        known = seen[c]
        for j, p in enumerate(probs):
            if known.count:
                at = p * (known.count - 1)
                positions[i, j] = at
                brackets[i, j] = Bracket(i, math.floor(at), math.ceil(at), known.low, known.high, 0, known.count)
    hinted = {key: hints[columns[key[0]]][key[1]] for key in brackets if columns[key[0]] in (hints or {})}
    for batch in _batches(list(hinted)):
        close = [Bracket(brackets[k].column, brackets[k].first, brackets[k].last, *hinted[k], 0, 0) for k in batch]
        for k, (below, inside) in zip(batch, _counted(values, close)):
            b = brackets[k]
            if below <= b.first <= b.last < below + inside:
                b.low, b.high, b.below, b.inside = *hinted[k], below, inside
    limit = RANK_LIMIT if rank_limit is None else rank_limit
    while wide := [b for b in brackets.values() if b.inside > limit and b.low < b.high and not b.settled]:
        for batch in _batches(wide):
            _narrow(values, batch)
    found = {}
    for batch in _batches([b for b in brackets.values() if b.low < b.high]):
        found |= _ranked(values, batch)
    result = {}
    for i, c in enumerate(columns):
        row = []
        for j in range(len(probs)):
            at, b = positions.get((i, j)), brackets.get((i, j))
            if at is None:
                row.append(None)
                continue
            low, high = (b.low, b.low) if b.low == b.high else (found[i, b.first], found[i, b.last])
            row.append(low if low == high else low + (high - low) * (at - math.floor(at)))
        result[c] = row
    return result


@dataclass
class Bracket:
    """Two values between which the ranks `first` to `last` of a column lie, and the rows below and in it."""

    column: int
    first: int
    last: int
    low: float
    high: float
    below: int
    inside: int
    margin: float = 2 / ACCURACY
    settled: bool = False

    def holds(self):
        return F.col(f"v{self.column}").between(F.lit(self.low), F.lit(self.high))


def _batches(brackets: list) -> list[list]:
    return [brackets[i : i + BATCH] for i in range(0, len(brackets), BATCH)]


def _counted(values: DataFrame, brackets: list[Bracket]) -> list[tuple[int, int]]:
    """Rows below and in each bracket, from one scan."""
    counts = []
    for k, b in enumerate(brackets):
        counts += [F.count_if(F.col(f"v{b.column}") < F.lit(b.low)).alias(f"b{k}"), F.count_if(b.holds()).alias(f"i{k}")]
    row = values.agg(*counts).first()
    return [(row[f"b{k}"], row[f"i{k}"]) for k in range(len(brackets))]


def _narrow(values: DataFrame, brackets: list[Bracket]) -> None:
    """Closes each bracket in around its ranks: one scan for the new ends, one for the counts."""
    # Brackets of one column with the same ends, as at the start, share one summary.
    alike: dict[tuple, list[Bracket]] = {}
    for b in brackets:
        alike.setdefault((b.column, b.low, b.high), []).append(b)
    cuts = []
    for k, group in enumerate(alike.values()):
        ends = []
        for b in group:
            ends += [max(0.0, (b.first - b.below) / b.inside - b.margin), min(1.0, (b.last - b.below + 1) / b.inside + b.margin)]
        cuts.append(F.percentile_approx(F.when(group[0].holds(), F.col(f"v{group[0].column}")), ends, ACCURACY).alias(f"c{k}"))
    row = values.agg(*cuts).first()
    closed = {}
    for k, group in enumerate(alike.values()):
        closed |= {id(b): row[f"c{k}"][2 * j : 2 * j + 2] for j, b in enumerate(group)}
    tried = [Bracket(b.column, b.first, b.last, *closed[id(b)], 0, 0) for b in brackets]
    for old, new, (below, inside) in zip(brackets, tried, _counted(values, tried)):
        if not below <= old.first <= old.last < below + inside:
            old.margin *= 4
        elif inside == old.inside:
            # Few distinct values are left, however many rows: ranking them is cheap.
            old.settled = True
        else:
            old.low, old.high, old.below, old.inside = new.low, new.high, below, inside


def _ranked(values: DataFrame, brackets: list[Bracket]) -> dict[tuple[int, int], float]:
    """The value at each (column, rank), from running counts over the distinct values of the brackets."""
    cells = [
        F.when(b.holds(), F.struct(F.lit(k).alias("id"), F.col(f"v{b.column}").alias("x"))).alias(f"s{k}") for k, b in enumerate(brackets)
    ]
    wide = values.select(*cells)
    members = wide.unpivot([], wide.columns, "name", "cell").filter("cell IS NOT NULL").select("cell.*")
    counts = members.groupBy("id", "x").agg(F.count("*").alias("n"))
    order = Window.partitionBy("id").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    running = counts.withColumn("upto", F.sum("n").over(order)).withColumn("before", F.col("upto") - F.col("n"))
    wanted = [(k, b.column, rank, rank - b.below) for k, b in enumerate(brackets) for rank in {b.first, b.last}]
    hits = " OR ".join(f"(id = {k} AND before <= {offset} AND upto > {offset})" for k, _, _, offset in wanted)
    rows = running.filter(hits).collect()
    return {
        (column, rank): next(r["x"] for r in rows if r["id"] == k and r["before"] <= offset < r["upto"])
        for k, column, rank, offset in wanted
    }
