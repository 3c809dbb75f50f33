"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from plumbline.functions.columns import col
from plumbline.llm.common import blocks, text_rows
from plumbline.llm.words import hash_words, split_words

#: Labelled texts per class that the model is fitted on, at most.
PER_CLASS = 2_048

#: Latent dimensions, neighbours that vote, and labelled vectors compared at once.
DIMENSIONS, NEIGHBOURS, BLOCK = 64, 15, 1_024

#: Terms: hashed runs of four byte kinds, hashed words, and buckets of word statistics.
KIND_TERMS, WORD_TERMS, STAT_TERMS = 640, 320, 64
TERMS = KIND_TERMS + WORD_TERMS + STAT_TERMS

#: Neighbours vote with their cosine to this power.
SHARPNESS = 8

# Kinds of bytes: letters, capitals, digits, blanks, line ends, marks of sentences, of emphasis, of
# noise, of tables and code, and the rest.
_KIND = np.full(256, 9, dtype=np.uint8)
_KIND[97:123] = 0
_KIND[128:] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
for _kind, _marks in ((3, b" \t"), (4, b"\n\r"), (5, b".,;:'\"-"), (6, b"!?"), (7, b"#$%&*@^~"), (8, b"|<>{}[]()/\\=_+`")):
    _KIND[list(_marks)] = _kind


class QualityModel(NamedTuple):
    rarity: np.ndarray  # per term
    axes: np.ndarray  # TERMS x DIMENSIONS
    vectors: np.ndarray  # unit rows, one per labelled text
    labels: np.ndarray  # 0 or 1
    prior: float  # share of label 1


def term_counts(column: pa.Array) -> np.ndarray:
    """Damped counts of the terms of each text, each family scaled to unit length."""
    words, n = split_words(column), len(column)
    out = np.zeros((n, TERMS), dtype=np.float32)
    # Runs of four kinds, over whole texts.
    kinds = _KIND[words.data].astype(np.int64)
    sizes = _text_sizes(column)
    ends = np.cumsum(sizes)
    run = np.maximum(sizes - 3, 0)
    text = np.repeat(np.arange(n), run)
    at = (ends - sizes)[text] + np.arange(len(text)) - np.repeat(np.cumsum(run) - run, run)
    code = ((kinds[at] * 10 + kinds[at + 1]) * 10 + kinds[at + 2]) * 10 + kinds[at + 3]
    out[:, :KIND_TERMS] = np.bincount(text * KIND_TERMS + code * 7919 % 10007 % KIND_TERMS, minlength=n * KIND_TERMS).reshape(n, -1)
    # Words.
    hashes, of = hash_words(words), words.docs()
    term = (hashes >> np.uint64(33)).astype(np.int64) % WORD_TERMS
    out[:, KIND_TERMS : KIND_TERMS + WORD_TERMS] = np.bincount(of * WORD_TERMS + term, minlength=n * WORD_TERMS).reshape(n, -1)
    np.log1p(out, out=out)
    for start, stop in ((0, KIND_TERMS), (KIND_TERMS, KIND_TERMS + WORD_TERMS)):
        part = out[:, start:stop]
        part /= np.maximum(np.sqrt((part**2).sum(axis=1, keepdims=True)), 1e-9)
    # Statistics in buckets: words, words that repeat the one before, distinct words, word length.
    count = np.maximum(words.counts, 1)
    again = np.zeros(len(hashes), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((hashes, of))
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
    length = np.bincount(of, weights=words.end - words.start, minlength=n) / count
    stats = (
        np.log2(count), 15 * np.bincount(of[again], minlength=n) / count,
        15 * np.bincount(of[order][fresh], minlength=n) / count, length,
    )
    offset = KIND_TERMS + WORD_TERMS
    for i, value in enumerate(stats):
        out[np.arange(n), offset + 16 * i + np.clip(value, 0, 15).astype(np.int64)] = 0.5
    out[words.counts == 0] = 0
    return out


def _text_sizes(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows**2).sum(axis=1, keepdims=True)), 1e-9)


def learn_quality(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS
) -> QualityModel | None:
    """Latent-semantic vectors of labelled texts.

    `labels` has key and a label of 0 or 1. Ids with contrary labels are left out. Of each class the
    `per_class` ids of lowest hash are taken, a bounded sample whatever the table's size; all labelled
    ids count for the prior. The sampled texts' damped term counts, weighted by rarity, give the axes:
    the strongest right singular vectors. Without labelled texts of both classes there is no model.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("__key"))
    known = known.agg(F.min(label).alias("__label"), F.max(label).alias("__other")).filter("__label = __other").drop("__other")
    shares = {r["__label"]: r["n"] for r in known.groupBy("__label").agg(F.count("*").alias("n")).collect()}
    if set(shares) != {0, 1}:
        return None
    picked = None
    for value in (0, 1):
        part = known.filter(F.col("__label") == value).orderBy(F.xxhash64("__key"), "__key").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    # At most two classes of per_class ids.
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("text")).filter(F.length("text") > 0)
    rows = rows.join(F.broadcast(picked), "__key").select("__key", F.col("__label").cast("int").alias("label"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                terms = term_counts(part.column(2)).astype("<f4")
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([r.tobytes() for r in terms], pa.binary())], names=["__key", "label", "terms"]
                )

    key_type = dict(docs.dtypes)[key]
    counted = rows.mapInArrow(count, f"__key {key_type}, label int, terms binary")
    # An id that several texts share counts once, with its least vector, before rows reach the driver.
    counted = counted.groupBy("__key").agg(F.min("label").alias("label"), F.min("terms").alias("terms"))
    got = counted.toArrow().to_pandas().sort_values("__key")
    if got["label"].nunique() < 2:
        return None
    terms = np.stack([np.frombuffer(t, dtype="<f4") for t in got["terms"]])
    rarity = (np.log((1 + len(terms)) / (1 + (terms > 0).sum(axis=0))) + 0.2).astype(np.float32)
    weighted = _unit(terms * rarity)
    _, axes = np.linalg.eigh((weighted.T @ weighted).astype(np.float64))
    axes = axes[:, ::-1][:, :DIMENSIONS].astype(np.float32)
    return QualityModel(
        rarity, axes, np.ascontiguousarray(_unit(weighted @ axes)), got["label"].to_numpy().astype(np.float32), shares[1] / (shares[0] + shares[1])
    )


def vote(model: QualityModel, column: pa.Array) -> np.ndarray:
    """Score of each text: its nearest labelled texts vote, weighted by similarity."""
    terms = term_counts(column)
    rows = _unit((terms * model.rarity) @ model.axes)
    k = min(NEIGHBOURS, len(model.labels))
    near = np.zeros((len(rows), 0), dtype=np.float32)
    said = near
    for start in range(0, len(model.labels), BLOCK):
        cosine = rows @ model.vectors[start : start + BLOCK].T
        top = np.argpartition(-cosine, min(k, cosine.shape[1]) - 1, axis=1)[:, :k]
        near = np.concatenate([near, np.take_along_axis(cosine, top, 1)], axis=1)
        said = np.concatenate([said, model.labels[start : start + BLOCK][top]], axis=1)
        best = np.argsort(-near, axis=1, kind="stable")[:, :k]
        near, said = np.take_along_axis(near, best, 1), np.take_along_axis(said, best, 1)
    weight = np.clip(near, 0, 1).astype(np.float64) ** SHARPNESS
    whole = weight.sum(axis=1)
    return np.where(whole > 1e-12, (weight * said).sum(axis=1) / np.maximum(whole, 1e-12), model.prior)


def score_quality(docs: DataFrame, model: QualityModel | None, text: str = "text", keep: list[str] | None = None, score_name: str = "score") -> DataFrame:
    """The columns `keep` of `docs` (all if None) with a score (0 to 1, higher: label 1 likelier).

    Each text is compared with all labelled vectors, block by block, by exact cosine; the NEIGHBOURS
    nearest vote with their cosine to the power SHARPNESS. Texts that are missing, empty or unlike all
    labelled texts get the share of label 1 among all labelled ids; without a model that is 0.5.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != score_name]
    if model is None:
        return docs.select(*map(col, kept), F.lit(0.5).alias(score_name))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, at = text_rows(docs, kept, text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, batch.schema.names[at]):
                value = vote(shared.value, part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(value)], names=[*kept, score_name])

    schema = T.StructType([*rows.schema.fields[: len(kept)], T.StructField(score_name, T.DoubleType())])
    return rows.mapInArrow(score, schema)
