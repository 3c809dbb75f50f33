"""Hard negatives by rotated one-bit codes whose intervals decide what is scored.

Every vector is taken relative to the nearest of a few centres and turned by one random rotation per
length, so that the direction r of what is left has no special axes. It is kept as the signs of r (one bit
per component, packed into words), the length of what is left, and the alignment of r with its code
vector c = signs / sqrt(width), alignment = <r, c>. A code is a deterministic summary:

    r = alignment * c + rest,  |rest| = sqrt(1 - alignment^2),  rest orthogonal to c.

An anchor's direction q is rotated as well and rounded to PLANES bits per component; <q, c> is then a sum
of popcounts of the code with the bit planes, with an error of at most the rounding's length. By
Cauchy-Schwarz the cosine of q and r lies within

    alignment * <q, c>  +-  ( sqrt(1 - alignment^2) * sqrt(1 - <q, c>^2) + what rounding may add ).

and the score is its inner product with the centre plus that cosine times both lengths. No case falls
outside, so only candidates whose interval meets what is asked are scored, and those are scored as
whole integers. How much that saves depends on the vectors: alignments are about 0.8, so that intervals
around one centre span half of all cosines; vectors close to their centres have short intervals.

Anchors meet rows in blocks: both are dealt by hash into parts of about BLOCK rows and every pair of
parts is a group of its own, so no group grows with the data, whatever label or vector is frequent.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from plumbline.llm.common import Workspace

#: Rows, or anchors, of a part; bits per component of a rotated anchor; anchors looked at together.
BLOCK, PLANES, TILE = 8_192, 6, 64

#: Centres, and the rows of lowest hash that they are fitted on, at most; rounds of fitting. Centres
#: decide how long intervals are, never what is found.
CENTRES, SAMPLE, ROUNDS = 64, 4_096, 5

#: Intervals are widened by this share of the longest possible score, for rounding of doubles.
SLACK = 1e-9

#: Sums of products below this are exact in doubles.
EXACT = 2.0**53

#: Above this share of surviving pairs a tile is scored by one matrix product.
DENSE = 0.02


@lru_cache(maxsize=8)
def rotation(width: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(width).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def fit_centres(sample: np.ndarray) -> np.ndarray:
    """k-means centres of a sample (rows of doubles), started from rows spread over it."""
    k = max(1, min(CENTRES, len(sample) // 16))
    centres = sample[:: -(-len(sample) // k)][:k].copy()
    for _ in range(ROUNDS):
        cell = nearest_centre(sample, centres)
        size = np.bincount(cell, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, sample)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


def nearest_centre(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * rows @ centres.T, axis=1)


class Codes(NamedTuple):
    code: np.ndarray  # words of 64 bits per row
    alignment: np.ndarray
    length: np.ndarray  # of what is left of a vector without its centre
    cell: np.ndarray  # number of the centre


def encode(vectors: np.ndarray, centres: np.ndarray) -> Codes:
    """Codes of integer vectors (rows); what equals its centre has length 0."""
    n, width = vectors.shape
    rows = vectors.astype(np.float64)
    cell = nearest_centre(rows, centres)
    rows -= centres[cell]
    length = np.sqrt((rows**2).sum(axis=1))
    turned = (rows / np.maximum(length, 1e-300)[:, None]) @ rotation(width).T
    bits = np.zeros((n, -(-width // 64) * 64), dtype=np.uint8)
    bits[:, :width] = turned >= 0
    return Codes(np.packbits(bits, axis=1).view(np.uint64), np.abs(turned).sum(axis=1) / np.sqrt(width), length, cell.astype(np.int32))


def intervals(anchors: np.ndarray, rows: Codes, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products of anchors (integer rows) and coded rows: anchors x rows."""
    n, width = anchors.shape
    exact = anchors.astype(np.float64)
    size = np.sqrt((exact**2).sum(axis=1))
    turned = (exact / np.maximum(size, 1e-300)[:, None]) @ rotation(width).T
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / (2**PLANES - 1), 1e-300)
    level = np.clip(np.rint((turned - low[:, None]) / step[:, None]), 0, 2**PLANES - 1).astype(np.uint8)
    rounded = low[:, None] + step[:, None] * level
    off = np.sqrt(((turned - rounded) ** 2).sum(axis=1))
    words = rows.code.shape[1]
    plane = np.zeros((n, words * 64), dtype=np.uint8)
    ones = np.bitwise_count(rows.code).sum(axis=1, dtype=np.int32)
    inside = np.zeros((n, len(rows.code)), dtype=np.int32)
    for p in range(PLANES):
        plane[:, :width] = (level >> p) & 1
        packed = np.packbits(plane, axis=1).view(np.uint64)
        for w in range(words):
            inside += np.bitwise_count(packed[:, w, None] & rows.code[None, :, w]).astype(np.int32) << p
    # Sum of q over set bits, less the sum over the others.
    share = (2 * (low[:, None] * ones[None, :] + step[:, None] * inside) - rounded.sum(axis=1)[:, None]) / np.sqrt(width)
    least = np.maximum(np.abs(share) - off[:, None], 0)
    radius = np.sqrt(np.maximum(1 - rows.alignment**2, 0))[None, :] * np.sqrt(np.maximum(1 - least**2, 0)) + rows.alignment[None, :] * off[:, None]
    whole = size[:, None] * rows.length[None, :]
    far = np.sqrt((centres**2).sum(axis=1))[rows.cell]
    middle = (exact @ centres.T)[:, rows.cell] + whole * (rows.alignment[None, :] * share)
    radius = whole * radius + SLACK * size[:, None] * (rows.length + far)[None, :]
    return middle - radius, middle + radius


def scores(anchors: np.ndarray, vectors: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Integer inner products of the wanted pairs (anchors x rows); other cells are meaningless."""
    largest = float(np.abs(anchors).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * anchors.shape[1]
    if largest < EXACT and wanted.mean() > DENSE:
        return (anchors.astype(np.float64) @ vectors.T.astype(np.float64)).astype(np.int64)
    out = np.zeros(wanted.shape, dtype=np.int64)
    a, r = np.nonzero(wanted)
    for at in range(0, len(a), 1 << 16):
        i, j = a[at : at + (1 << 16)], r[at : at + (1 << 16)]
        out[i, j] = np.einsum("ij,ij->i", anchors[i], vectors[j])
    return out


def highest(value: np.ndarray, valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k highest valid values of each row, ties to the smaller column; fewer if there are fewer."""
    least = np.iinfo(np.int64).min
    masked = np.where(valid, value, least)
    if masked.shape[1] > k:
        floor = -np.partition(~masked, k - 1, axis=1)[:, k - 1] - 1  # ~x = -x - 1 turns the order without overflow
        valid = valid & (masked >= floor[:, None])
    r, c = np.nonzero(valid)
    order = np.lexsort((c, ~value[r, c], r))
    r, c = r[order], c[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    return r[rank < k], c[rank < k]


def _floor_of(low: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest lower bound of each row: k candidates surely reach it."""
    if low.shape[1] < k:
        return np.full(len(low), -np.inf)
    return -np.partition(-low, k - 1, axis=1)[:, k - 1]


def window_of(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest integer n with 50 score <= 100 n <= 95 score."""
    return -((-score) // 2), score // 20 * 19 + score % 20 * 19 // 20


class Part:
    """Rows of one part, by ascending id."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("id")
        self.id, self.label = (table.column(c).to_numpy() for c in ("id", "label"))
        self.vectors = _matrix(table.column("vector"), np.int64)
        self.codes = Codes(_matrix(table.column("code"), np.uint64), *(table.column(c).to_numpy() for c in ("alignment", "length", "cell")))


def _matrix(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


def nearest_of_label(anchors: Part, rows: Part, centres: np.ndarray, k: int) -> pa.Table:
    """Of each anchor, the k rows of its label of highest score within this part."""
    out = []
    for at in range(0, len(anchors.id), TILE):
        asked = slice(at, at + TILE)
        q = anchors.vectors[asked]
        mine = (rows.label[None, :] == anchors.label[asked, None]) & (rows.id[None, :] != anchors.id[asked, None])
        low, high = intervals(q, rows.codes, centres)
        wanted = mine & (high >= _floor_of(np.where(mine, low, -np.inf), k)[:, None])
        score = scores(q, rows.vectors, wanted)
        a, r = highest(score, wanted, k)
        out.append((anchors.id[asked][a], rows.id[r], score[a, r]))
    columns = [np.concatenate(c).astype(np.int64) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else [()] * 3)]
    return pa.Table.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "positive_id", "score"])


def within_windows(anchors: Part, positives: list[list[int]], rows: Part, centres: np.ndarray, k: int) -> pa.Table:
    """Of each anchor and positive, the k rows of other labels of highest score within the positive's window."""
    most = max(map(len, positives), default=0)
    score_of = np.full((len(positives), most), -1, dtype=np.int64)
    for i, p in enumerate(positives):
        score_of[i, : len(p)] = p
    lowest, greatest = window_of(score_of)
    out = []
    for at in range(0, len(anchors.id), TILE):
        asked = slice(at, at + TILE)
        q = anchors.vectors[asked]
        other = (rows.label[None, :] != anchors.label[asked, None]) & (rows.id[None, :] != anchors.id[asked, None])
        low, high = intervals(q, rows.codes, centres)
        meets = []
        for j in range(most):
            # A window below zero is empty; so is the place of a positive that an anchor does not have.
            least, top = lowest[asked, j, None], greatest[asked, j, None]
            meet = other & (score_of[asked, j, None] >= 0) & (high >= least) & (low <= top)
            sure = np.where(meet & (low >= least) & (high <= top), low, -np.inf)
            meets.append(meet & (high >= _floor_of(sure, k)[:, None]))
        wanted = np.logical_or.reduce(meets) if meets else np.zeros((len(q), len(rows.id)), dtype=bool)
        score = scores(q, rows.vectors, wanted)
        for j, meet in enumerate(meets):
            a, r = highest(score, meet & (score >= lowest[asked, j, None]) & (score <= greatest[asked, j, None]), k)
            out.append((anchors.id[asked][a], np.full(len(a), j + 1), rows.id[r], score[a, r]))
    columns = [np.concatenate(c).astype(np.int64) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else [()] * 4)]
    return pa.Table.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "place", "negative_id", "score"])


def _centres(coordinates: dict[int, np.ndarray], width: int) -> np.ndarray:
    """Centres for vectors of this length: the origin where the sample has none."""
    return coordinates.get(width, np.zeros((1, width)))


def _code(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            sizes = np.diff(vectors.offsets.to_numpy())
            flat, first = vectors.flatten().to_numpy(), np.cumsum(sizes) - sizes
            for width in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == width)
                rows = flat[first[at][:, None] + np.arange(width)].astype(np.int64)
                codes = encode(rows, _centres(shared.value, width))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(np.full(len(at), width, np.int32)),
                        pa.array([r.tobytes() for r in rows], pa.binary()), pa.array([c.tobytes() for c in codes.code], pa.binary()),
                        pa.array(codes.alignment), pa.array(codes.length), pa.array(codes.cell),
                    ],
                    names=["id", "label", "width", "vector", "code", "alignment", "length", "cell"],
                )

    return run


CODED = "id long, label long, width int, vector binary, code binary, alignment double, length double, cell int"


def mine_negatives(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, block: int = BLOCK
) -> DataFrame:
    """Hard negatives of each anchor and each of its positives.

    `vectors` has id (long), label (integer) and vector (array of long); `anchors` has the ids of rows to
    start from. A row's score is its integer inner product with the anchor, which must fit a long. An
    anchor's positives are the first `positives` other rows of its label, by score and then smaller id; the negatives of
    a positive are the first `negatives` rows of another label with 50 * p <= 100 * n <= 95 * p for its score p.
    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score.

    Rows with a NULL anywhere or an empty vector take no part. Vectors of different length are never
    compared. Rows that repeat an id are candidates each, but for the anchor of that id; an anchor id with
    several rows is asked once, with its smallest (label, vector). Further columns are not read. An empty table gives no rows.
    """
    work = Workspace(vectors.sparkSession)
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull())
    rows = vectors.select(F.col("id").cast("long"), F.col("label").cast("long"), "vector").filter(usable)
    sample = rows.orderBy(F.xxhash64("id"), "id", "vector").limit(SAMPLE).select("vector").collect()
    widths = {len(r["vector"]) for r in sample}
    centres = {w: fit_centres(np.array([r["vector"] for r in sample if len(r["vector"]) == w], dtype=np.float64)) for w in widths}
    shared = work.spark.sparkContext.broadcast(centres)
    coded = work.table(rows.mapInArrow(_code(shared), CODED), "coded")
    asked = rows.join(anchors.select(F.col("id").cast("long")).distinct(), "id", "left_semi")
    asked = asked.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", "row.label", "row.vector")
    asked = work.table(asked.mapInArrow(_code(shared), CODED), "anchors")

    # Positives: a frequent label has parts of its own, the others share cells of about a block.
    counts = coded.groupBy("width", "label").agg(F.count("*").alias("rows"))
    asking = asked.groupBy("width", "label").agg(F.count("*").alias("anchors"))
    counts = work.table(counts.join(asking, ["width", "label"]), "counts")
    few = counts.filter(F.col("rows") <= block).agg(F.sum("rows")).first()[0] or 0
    cells = -(-few // block) or 1
    label, large = F.xxhash64("width", "label"), F.col("rows") > block
    counts = counts.select(
        "width", "label", F.when(large, label).otherwise(F.pmod(label, F.lit(cells))).alias("place"), large.alias("large"),
        F.when(large, F.ceil(F.col("rows") / block)).otherwise(1).cast("int").alias("row_parts"),
        F.when(large, F.ceil(F.col("anchors") / block)).otherwise(1).cast("int").alias("anchor_parts"),
    )
    key = ["width", "place", "large", "row_part", "anchor_part"]
    left = _paired(asked.join(counts, ["width", "label"]), "anchor_part", "row_part").select(*key, *_named(coded))
    right = _paired(coded.join(counts, ["width", "label"]), "row_part", "anchor_part").select(*key, *_named(coded))

    def near(a: pa.Table, r: pa.Table) -> pa.Table:
        anchors, rows = Part(a), Part(r)
        return nearest_of_label(anchors, rows, _centres(shared.value, rows.vectors.shape[1]), positives)

    near_schema = "anchor_id long, positive_id long, score long"
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_both(near, near_schema), near_schema)
    order = W.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    found = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    found = work.table(found, "positives")

    # Negatives: every part of anchors meets every part of rows.
    lists = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("places"))
    lists = lists.select(F.col("anchor_id").alias("id"), F.transform("places", lambda p: p["score"]).alias("positives"))
    sizes = coded.groupBy("width").agg(F.ceil(F.count("*") / block).cast("int").alias("row_parts"))
    parts = asked.groupBy("width").agg(F.ceil(F.count("*") / block).cast("int").alias("anchor_parts"))
    grid = work.table(sizes.join(parts, "width"), "grid")
    key = ["width", "row_part", "anchor_part"]
    left = _paired(asked.join(lists, "id").join(grid, "width"), "anchor_part", "row_part").select(*key, *_named(coded), "positives")
    right = _paired(coded.join(grid, "width"), "row_part", "anchor_part").select(*key, *_named(coded))

    def hard(a: pa.Table, r: pa.Table) -> pa.Table:
        a = a.sort_by("id")
        anchors, rows = Part(a), Part(r)
        return within_windows(anchors, a.column("positives").to_pylist(), rows, _centres(shared.value, rows.vectors.shape[1]), negatives)

    hard_schema = "anchor_id long, place long, negative_id long, score long"
    mined = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_both(hard, hard_schema), hard_schema)
    order = W.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "negative_id")
    mined = mined.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    mined = mined.select("anchor_id", F.col("place").cast("int").alias("place"), "rank", "negative_id", F.col("score").alias("negative_score"))
    mined = work.table(mined, "mined")
    work.drop("coded", "anchors", "counts", "grid")
    joined = mined.join(found.withColumnRenamed("score", "positive_score"), ["anchor_id", "place"])
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _named(coded: DataFrame) -> list[str]:
    return [c for c in coded.columns if c != "width"]


def _paired(rows: DataFrame, own: str, other: str) -> DataFrame:
    """Each row in its own part, once for every part of the other side."""
    placed = rows.withColumn(own, F.pmod(F.xxhash64("id", F.lit(11)), F.col(f"{own}s")).cast("int"))
    placed = placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))
    # New names for old columns: both sides of a cogroup come from the same tables.
    return placed.select(*[F.col(c).alias(c) for c in placed.columns])


def _both(run, schema: str):
    """Runs on groups that have rows on both sides."""
    names = [c.split()[0] for c in schema.split(", ")]

    def group(a: pa.Table, r: pa.Table) -> pa.Table:
        if a.num_rows and r.num_rows:
            return run(a, r)
        return pa.Table.from_arrays([pa.array([], pa.int64()) for _ in names], names=names)

    return group
