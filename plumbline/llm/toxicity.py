"""Toxicity scores: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased, runs of blanks become one space, and a space stands at both ends. Its n-grams of
GRAMS characters, hashed into BUCKETS, count once per text. From labelled texts each bucket gets

    ratio = log( (a + n1) / (sum a + n1) ) - log( (a + n0) / (sum a + n0) )

for n1 and n0 labelled texts of either class that hold it. The FEATURES buckets whose ratio is furthest
from zero in standard errors become features of value ratio, scaled to a damped length, on which a
logistic regression is fitted. Its intercept is moved from the sample's classes to those of all labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from plumbline.functions.columns import col
from plumbline.llm.common import Workspace, blocks, text_rows
from plumbline.llm.words import mix

#: Labelled ids per class that the model is fitted on, at most.
PER_CLASS = 2_048

#: Characters of an n-gram, buckets (a power of two), and features.
GRAMS, BUCKETS, FEATURES = (3, 4, 5), 1 << 20, 4_096

#: Smoothing of counts, constant of the damped length, weight of the penalty, steps of the fit.
SMOOTHING, DAMPING, PENALTY, STEPS = 1.0, 1.0, 3e-4, 300

_BLANKS = np.array([9, 10, 11, 12, 13, 32, 133, 160], dtype=np.uint32)


class ToxicityModel(NamedTuple):
    feature: np.ndarray  # per bucket, the number of its feature or -1
    ratio: np.ndarray  # per feature
    weight: np.ndarray  # per feature
    intercept: float


def characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts end to end, and the row of each. NULL is empty."""
    texts = [(t or "").lower() for t in column.to_pylist()]
    sizes = np.array([len(t) + 2 for t in texts], dtype=np.int64)
    points = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le"), dtype="<u4")
    row = np.repeat(np.arange(len(texts)), sizes)
    blank = np.isin(points, _BLANKS)
    keep = np.ones(len(points), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1] & (row[1:] == row[:-1]))
    return np.where(blank, np.uint32(32), points)[keep], row[keep]


def gram_buckets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per length of n-grams: the row and the bucket of every n-gram of the texts, repeats included."""
    points, row = characters(column)
    wide = points.astype(np.uint64)
    code = np.zeros(0, np.uint64)
    for n in range(1, max(GRAMS) + 1):
        if len(wide) < n:
            return
        code = wide if n == 1 else mix(code[:-1] * np.uint64(0x100000001B3) + wide[n - 1 :] + np.uint64(n))
        if n in GRAMS:
            whole = row[: len(code)] == row[n - 1 :]
            yield row[: len(code)][whole], (code[whole] >> np.uint64(40)).astype(np.int64) % BUCKETS


def presence(column: pa.Array, feature: np.ndarray, features: int) -> np.ndarray:
    """Which features each text has: rows x features, as 0 and 1."""
    out = np.zeros((len(column), features), dtype=np.uint8)
    for row, bucket in gram_buckets(column):
        number = feature[bucket]
        known = number >= 0
        out[row[known], number[known]] = 1
    return out


def _scaled(present: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    rows = present.astype(np.float32) * ratio.astype(np.float32)
    return rows / np.sqrt((rows**2).sum(axis=1, keepdims=True) + DAMPING)


def fit_logistic(rows: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept of least penalised log loss, by accelerated gradient steps."""
    n = len(rows)
    weight, intercept = np.zeros(rows.shape[1]), 0.0
    ahead, ahead0, momentum = weight.copy(), intercept, 1.0
    # Rows are no longer than 1, so the loss is smooth with constant (1 + 1) / 4.
    step = 1 / (0.5 + PENALTY)
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-(rows @ ahead.astype(np.float32) + ahead0))) - labels
        following = ahead - step * (rows.T @ error.astype(np.float32) / n + PENALTY * ahead)
        following0 = ahead0 - step * error.mean()
        grown = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = following + (momentum - 1) / grown * (following - weight)
        ahead0 = following0 + (momentum - 1) / grown * (following0 - intercept)
        weight, intercept, momentum = following, following0, grown
    return weight, float(intercept)


def learn_toxicity(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS
) -> ToxicityModel | float:
    """The model of labelled texts, or the share of label 1 where not both classes have a text.

    `labels` has key and a label of 0 or 1. Ids with contrary labels, missing labels and ids without a
    text are left out. Of each class the `per_class` ids of lowest hash are taken, a bounded sample
    whatever the tables' sizes; an id that several rows share counts once, with its least text. All
    labelled ids with a text count for the classes' shares. Ties of features go to the lower bucket. Without any
    label the share is 0.5.
    """
    work = Workspace(docs.sparkSession)
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("__key"))
    known = known.agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("other")).filter("label = other").drop("other")
    texts = docs.select(F.col(key).alias("__key"), F.col(text).alias("text")).filter("length(text) > 0")
    known = work.table(known.join(texts.select("__key"), "__key", "left_semi"), "known")
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if set(shares) != {0, 1}:
        return float(next(iter(shares), 0.5))
    picked = None
    for value in (0, 1):
        part = known.filter(F.col("label") == value).orderBy(F.xxhash64("__key"), "__key").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    # At most two classes of per_class ids; of their texts, one each.
    sample = texts.join(F.broadcast(picked), "__key").groupBy("__key").agg(F.min("label").alias("label"), F.min("text").alias("text"))
    sample = work.table(sample, "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            for part in blocks(batch, "text"):
                of = part.column(0).to_numpy()
                # Each length of n-grams counts apart; a bucket that two lengths share counts for both.
                for row, bucket in gram_buckets(part.column(1)):
                    once = np.unique(row * BUCKETS + bucket)
                    for value in (0, 1):
                        held[value] += np.bincount(once[of[once // BUCKETS] == value] % BUCKETS, minlength=BUCKETS)
        seen = np.flatnonzero(held.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(held[0, seen]), pa.array(held[1, seen])], names=["bucket", "n0", "n1"])

    counts = sample.select("label", "text").mapInArrow(count, "bucket long, n0 long, n1 long")
    counts = work.table(counts.groupBy("bucket").agg(*[(F.sum(c) + SMOOTHING).alias(c) for c in ("n0", "n1")]), "counts")
    whole = counts.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
    ratio = F.log(F.col("n1") / whole["n1"]) - F.log(F.col("n0") / whole["n0"])
    strength = F.abs(ratio) / F.sqrt(1 / F.col("n1") + 1 / F.col("n0"))
    best = counts.select("bucket", ratio.alias("ratio"), strength.alias("strength")).orderBy(F.desc("strength"), "bucket").limit(FEATURES)
    got = best.toArrow()
    feature = np.full(BUCKETS, -1, dtype=np.int16)
    feature[got["bucket"].to_numpy()] = np.arange(got.num_rows)
    ratios = got["ratio"].to_numpy()
    shared, n = docs.sparkSession.sparkContext.broadcast(feature), len(ratios)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                bits = np.packbits(presence(part.column(2), shared.value, n), axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([b.tobytes() for b in bits], pa.binary())], names=["__key", "label", "bits"])

    kind = dict(docs.dtypes)[key]
    marked = sample.select("__key", "label", "text").mapInArrow(mark, f"__key {kind}, label int, bits binary").toArrow().sort_by("__key")
    bits = np.frombuffer(b"".join(marked["bits"].to_pylist()), dtype=np.uint8).reshape(marked.num_rows, -1)
    said = marked["label"].to_numpy().astype(np.float64)
    weight, intercept = fit_logistic(_scaled(np.unpackbits(bits, axis=1)[:, :n], ratios), said)
    work.drop("known", "sample", "counts")
    # From the sample's odds to those of all labelled ids.
    intercept += float(np.log(shares[1] / shares[0]) - np.log(said.sum() / (len(said) - said.sum())))
    return ToxicityModel(feature, ratios, weight, intercept)


def toxic_share(model: ToxicityModel, column: pa.Array) -> np.ndarray:
    rows = _scaled(presence(column, model.feature, len(model.ratio)), model.ratio)
    return 1 / (1 + np.exp(-(rows @ model.weight + model.intercept)))


def score_toxicity(
    docs: DataFrame, model: ToxicityModel | float, text: str = "text", keep: list[str] | None = None, score_name: str = "score"
) -> DataFrame:
    """The columns `keep` of `docs` (all if None) with a score (0 to 1, higher: label 1 likelier).

    Every whole text is scored by itself, so repeated rows score alike. Texts that are missing, empty or
    without a feature score what the intercept says; without a model all score the share of label 1. A column
    named like the score gives way. An empty table gives none.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != score_name]
    if not isinstance(model, ToxicityModel):
        return docs.select(*map(col, kept), F.lit(model).cast("double").alias(score_name))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, at = text_rows(docs, kept, text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, batch.schema.names[at]):
                value = toxic_share(shared.value, part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(value)], names=[*kept, score_name])

    schema = T.StructType([*rows.schema.fields[: len(kept)], T.StructField(score_name, T.DoubleType())])
    return rows.mapInArrow(score, schema)
