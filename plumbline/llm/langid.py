"""Language identification with bit-sliced Bloom filters of n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from plumbline.functions.columns import col
from plumbline.llm.common import Workspace, blocks
from plumbline.llm.words import mix, text_bytes

#: Slots of the filter, one bit per language each, and slots that an n-gram sets.
SLOTS, HASHES = 1 << 20, 3

#: An n-gram belongs to a language that uses it at least this often, and at no less than this share
#: of the rate of the language that uses it most.
LEAST_COUNT, LEAST_SHARE = 3, 0.1

UNDETERMINED = "und"

# Bytes that are no ASCII letters become spaces; bytes of other characters stay.
_PLAIN = np.full(256, 32, dtype=np.uint8)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)
_BLANK = np.uint32(0x20202020)


class LanguageModel(NamedTuple):
    languages: list[str]  # by code point; bit i of a slot stands for language i
    slots: np.ndarray  # SLOTS rows of one or more words of language bits
    prior: list[float]  # share of n-grams


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All 4-byte n-grams of the texts, in lower case with two spaces around each, and their text.

    Four spaces in a row are no n-gram.
    """
    data, offsets = text_bytes(column)
    data = _PLAIN[data]
    found = np.ndarray(shape=(len(data) - 3,), dtype="<u4", buffer=data, strides=(1,))
    sizes = np.maximum(np.diff(offsets) - 3, 0)
    text = np.repeat(np.arange(len(sizes)), sizes)
    at = offsets[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    found = found[at]
    keep = found != _BLANK
    return found[keep], text[keep]


def _padded(docs: DataFrame, text: str, *others) -> DataFrame:
    return docs.select(F.concat(F.lit("  "), F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("  ")).alias("text"), *others)


def slot_numbers(found: np.ndarray) -> Iterator[np.ndarray]:
    whole = mix(found.astype(np.uint64) + np.uint64(1))
    for i in range(HASHES):
        yield ((whole >> np.uint64(20 * i)) & np.uint64(SLOTS - 1)).astype(np.int64)


def learn_languages(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """The filter learned from all rows with a language.

    N-grams are counted per language over all texts, one row per n-gram and language; those that
    pass LEAST_COUNT and LEAST_SHARE set their language's bit in HASHES slots. What reaches the driver
    is one row per language and at most SLOTS words of bits per 64 languages.
    """
    rows = _padded(docs.filter(F.col(lang).isNotNull()), text, F.col(lang).alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                names = part.column(1).dictionary_encode()
                codes, values = names.indices.to_numpy(), names.dictionary
                found, of = grams(part.column(0))
                for code in range(len(values)):
                    gram, n = np.unique(found[codes[of] == code], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([values[code].as_py()] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n)],
                        names=["lang", "gram", "n"],
                    )

    work = Workspace(docs.sparkSession)
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    counts = work.table(counts, "counts")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    known = [name for name in languages if totals[name]]
    if not known:
        return LanguageModel([], np.zeros((SLOTS, 1), np.uint8), [])
    listed = F.array(*[F.lit(name) for name in languages])
    sizes = F.array(*[F.lit(float(totals[name])) for name in languages])
    index = (F.array_position(listed, F.col("lang")) - 1).cast("int")
    rated = counts.withColumn("index", index).withColumn("rate", F.col("n") / F.element_at(sizes, F.col("index") + 1))
    # One row per language in a window.
    top = F.max("rate").over(W.partitionBy("gram"))
    members = rated.withColumn("top", top).filter((F.col("n") >= LEAST_COUNT) & (F.col("rate") >= LEAST_SHARE * F.col("top")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, index = batch.column(0).to_numpy().astype(np.uint32), batch.column(1).to_numpy()
            bit = np.int64(1) << (index % 64).astype(np.int64)
            for slot in slot_numbers(gram):
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(index // 64), pa.array(bit)], names=["slot", "word", "bits"])

    placed = members.select("gram", "index").mapInArrow(place, "slot long, word int, bits long")
    got = placed.groupBy("slot", "word").agg(F.bit_or("bits").alias("bits")).toArrow()
    work.drop("counts")
    slots = np.zeros((SLOTS, -(-len(languages) // 64)), dtype=np.int64)
    slots[got["slot"].to_numpy(), got["word"].to_numpy()] = got["bits"].to_numpy()
    slots = slots.view(np.uint64)
    for narrow, width in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)):
        if len(languages) <= width:
            slots = slots.astype(narrow)
            break
    whole = sum(totals.values())
    return LanguageModel(languages, slots, [totals[name] / whole for name in languages])


def popcounts(model: LanguageModel, found: np.ndarray, of: np.ndarray, texts: int) -> np.ndarray:
    """Per text and language, how many of its n-grams the filter returns for the language."""
    masks = None
    for slot in slot_numbers(found):
        masks = model.slots[slot] if masks is None else masks & model.slots[slot]
    out = np.zeros((texts, len(model.languages)))
    for i in range(len(model.languages)):
        word = masks[:, i // 64]
        out[:, i] = np.bincount(of[((word >> word.dtype.type(i % 64)) & word.dtype.type(1)).astype(bool)], minlength=texts)
    return out


def false_positive_rates(model: LanguageModel) -> np.ndarray:
    """Per language, the chance that an n-gram it lacks finds all its slots set."""
    fill = []
    for i in range(len(model.languages)):
        word = model.slots[:, i // 64]
        fill.append(((word >> word.dtype.type(i % 64)) & word.dtype.type(1)).mean())
    return np.array(fill) ** HASHES


def predict_languages(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `docs` (all if None) with lang_pred and score.

    Every n-gram of a text asks the filter once and gets the bits of all languages that hold it. The
    counts of bits, less the share that false positives explain, (hits/n - f)/(1 - f), decide; score
    is the winner's share of the sum. Ties go to the first language by code point; a text none of
    whose n-grams is known gets the most frequent language with its share of the training data.
    Missing texts, texts without a letter, and all texts if nothing was learned are `und`, score 0.
    """
    shared, rates = docs.sparkSession.sparkContext.broadcast(model), false_positive_rates(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in blocks(batch, "__text"):
                n = part.num_rows
                found, of = grams(part.column(part.num_columns - 1))
                asked = np.maximum(np.bincount(of, minlength=n), 1)[:, None]
                share = np.clip((popcounts(model, found, of, n) / asked - rates) / np.maximum(1 - rates, 1e-9), 0, None)
                whole = share.sum(axis=1)
                best = share.argmax(axis=1)
                score = share[np.arange(n), best] / np.maximum(whole, 1e-300)
                usual = int(np.argmax(model.prior))
                best, score = np.where(whole > 0, best, usual), np.where(whole > 0, score, model.prior[usual])
                names = pa.array(model.languages).take(pa.array(best))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], names, pa.array(np.minimum(score, 1.0))], names=[*part.schema.names[:-1], "lang_pred", "score"]
                )

    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    readable = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    if not model.languages:
        return docs.select(*map(col, kept), F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    padded = F.concat(F.lit("  "), F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("  "))
    marked = docs.select(*map(col, kept), readable.alias("__read"), padded.alias("__text"))
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema.fields[:-1])
    out = marked.mapInArrow(predict, f"{names}, lang_pred string, score double")
    return out.withColumns({
        "lang_pred": F.when(F.col("__read"), F.col("lang_pred")).otherwise(UNDETERMINED),
        "score": F.when(F.col("__read"), F.col("score")).otherwise(0.0),
    }).drop("__read")
