"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A token is spelled as CODE_BITS bits of a code (from its first letters, its last letters and a hash)
and then named among the tokens of that code by its share of their training counts. Each bit has four
predictions, in the logistic domain: from training counts after no context, after the code of the token
before, and after the two tokens before (hashed), and from what the text itself has shown so far. A
gate (place of the bit, and whether the text has been there before) picks a set of weights; the
weighted sum, refined by a correction per bit place and size of the sum, is the log odds of the bit.
Weights, corrections and the text's own counts start afresh in each text and learn from it as it is
read, CHUNK tokens at a time. All probabilities sum to one over the tokens of a code and the codes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from plumbline.functions.columns import col
from plumbline.llm.common import Workspace, blocks
from plumbline.llm.words import Words, hash_words, mix, pair, split_words

CODE_BITS = 10
CODES = 1 << CODE_BITS

#: Hashed contexts per order; a table has CODES slots for each.
CONTEXTS = 1024
SLOTS = CODES * CONTEXTS

#: Tokens read between two updates, learning rates of weights and corrections, first weights.
CHUNK, RATE, REFINE_RATE = 32, 0.02, 0.02
FIRST_WEIGHTS = (0.2, 0.4, 0.3, 0.4)

#: Bytes of text read side by side; more texts at once spare steps.
SIDE_BY_SIDE = 2 << 20

#: Bytes of text in a bucket of documents that are scored together.
BUCKET_BYTES = 16 << 20

#: Slots of a table that travel as one value.
SEGMENT = 1 << 15

END = np.uint64(0x656E64)


class Model(NamedTuple):
    plain: np.ndarray  # log odds per node, after no context
    orders: list[np.ndarray]  # per order, log odds per slot
    code_tokens: np.ndarray  # per code, training tokens
    code_kinds: np.ndarray  # and distinct ones
    tokens: int
    kinds: int


class Tokens(NamedTuple):
    word: np.ndarray  # hash
    code: np.ndarray
    first: np.ndarray  # per text, index of its first token; one more entry at the end


def tokens_of(column: pa.Array) -> Tokens:
    """The words of each text, A-Z in lower case, and one end token behind them."""
    words = split_words(column, lower=True)
    hashes, texts = hash_words(words), len(words.first) - 1
    place = np.arange(len(hashes)) + words.docs()
    first = words.first + np.arange(texts + 1)
    word, code = np.full(first[-1], END, np.uint64), np.zeros(first[-1], np.int64)
    word[place], code[place] = hashes, _codes(words, hashes)
    return Tokens(word, code, first)


def _codes(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Four bits from the first two bytes, four from the last letters, two from the whole token."""
    data, start, end = words.data, words.start, words.end
    head = data[start].astype(np.uint64) * np.uint64(256) + np.where(end - start > 1, data[np.minimum(start + 1, len(data) - 1)], 0).astype(np.uint64)
    # A mark at the end is passed over.
    marked = np.isin(data[end - 1], np.frombuffer(b".,;:!?", np.uint8)) & (end - start > 1)
    last = end - 1 - marked
    tail = data[last].astype(np.uint64) * np.uint64(256) + np.where(last > start, data[np.maximum(last - 1, 0)], 0).astype(np.uint64)
    parts = [mix(head) >> np.uint64(60), mix(tail + np.uint64(1 << 20)) >> np.uint64(60), hashes >> np.uint64(62)]
    return ((parts[0] << np.uint64(6)) | (parts[1] << np.uint64(2)) | parts[2]).astype(np.int64)


def _contexts(tokens: Tokens) -> list[np.ndarray]:
    """Per token its hashed contexts, one per order; texts begin with empty contexts."""
    n = len(tokens.word)
    back = np.arange(n) - np.repeat(tokens.first[:-1], np.diff(tokens.first))
    one = np.where(back >= 1, np.roll(tokens.code, 1), CODES - 1)
    before = np.where(back >= 1, np.roll(tokens.word, 1), np.uint64(1))
    earlier = np.where(back >= 2, np.roll(tokens.word, 2), np.uint64(2))
    two = (pair(before, earlier) >> np.uint64(54)).astype(np.int64)
    return [one % CONTEXTS, two % CONTEXTS]


def _nodes(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per token and bit, the bits before it (with a one in front) and the bit."""
    place = np.arange(CODE_BITS)
    return (1 << place) | (code[..., None] >> (CODE_BITS - place)), (code[..., None] >> (CODE_BITS - 1 - place)) & 1


def bucketed(docs: DataFrame, key: str, text: str, train: str) -> tuple[DataFrame, int]:
    """Rows with a bucket of about BUCKET_BYTES of text; copies of a text under other ids are spread."""
    body = F.coalesce(F.col(text), F.lit(""))
    whole = docs.select(F.octet_length(body).cast("long").alias("n")).agg(F.sum("n")).first()[0] or 0
    n = max(1, math.ceil(whole / BUCKET_BYTES))
    rows = docs.select(
        F.col(key).alias("key"), F.expr(train).alias("train"), body.alias("text"),
        F.pmod(F.xxhash64(F.col(key), body), F.lit(n)).cast("int").alias("bucket"),
    )
    return rows, n


def _words_of_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct tokens of each bucket, with their training counts."""
    held: dict[int, list] = {}

    def merged(parts: list) -> list:
        word, code, n = (np.concatenate(x) for x in zip(*parts))
        kinds, at, inverse = np.unique(word, return_index=True, return_inverse=True)
        return [(kinds, code[at], np.bincount(inverse, weights=n, minlength=len(kinds)).astype(np.int64))]

    for batch in batches:
        for part in blocks(batch, "text"):
            tokens = tokens_of(part.column(0))
            size = np.diff(tokens.first)
            counts = np.repeat(part.column(2).to_numpy(zero_copy_only=False).astype(np.int64), size)
            bucket = np.repeat(part.column(1).to_numpy(), size)
            for b in np.unique(bucket):
                own = bucket == b
                held.setdefault(int(b), []).append(merged([(tokens.word[own], tokens.code[own], counts[own])])[0])
                if sum(len(x[0]) for x in held[int(b)]) > 1 << 20:
                    held[int(b)] = merged(held[int(b)])
    for b, parts in held.items():
        word, code, n = merged(parts)[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(word), b, np.int32)), pa.array(word.view(np.int64)), pa.array(code.astype(np.int32)), pa.array(n)],
            names=["bucket", "word", "code", "n"],
        )


def _count_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each slot's bit was seen and was one, summed over the task's texts."""
    seen = np.zeros((3, SLOTS), np.int64)
    ones = np.zeros((3, SLOTS), np.int64)
    for batch in batches:
        for part in blocks(batch, "text"):
            tokens = tokens_of(part.column(0))
            nodes, bits = _nodes(tokens.code)
            for i, context in enumerate([np.zeros(len(tokens.code), np.int64), *_contexts(tokens)]):
                slot = (context[:, None] * CODES + nodes).ravel()
                top = CODES if i == 0 else SLOTS
                seen[i, :top] += np.bincount(slot, minlength=top)
                ones[i, :top] += np.bincount(slot[bits.ravel() == 1], minlength=top)
    yield from _segments(seen, ones)


def _segments(seen: np.ndarray, ones: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(seen.shape[0]):
        for start in range(0, SLOTS, SEGMENT):
            cut = slice(start, start + SEGMENT)
            if seen[i, cut].any():
                values = np.stack([seen[i, cut], ones[i, cut]])
                wide = values.astype("<u4") if values.max() < 1 << 32 else values.astype("<u8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i * (SLOTS // SEGMENT) + start // SEGMENT], pa.int32()), pa.array([wide.tobytes()], pa.binary())],
                    names=["segment", "counts"],
                )


def _add_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the values of a segment as they stream by."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for segment, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = value.as_buffer()
            got = np.frombuffer(raw, "<u4" if raw.size == 2 * SEGMENT * 4 else "<u8").astype(np.int64)
            held[segment] = held[segment] + got if segment in held else got
    for segment, counts in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([counts.astype("<u8").tobytes()], pa.binary())], names=["segment", "counts"])


def _log_odds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _add_segments(batches):
        seen, ones = np.frombuffer(batch.column(1)[0].as_buffer(), "<u8").reshape(2, -1).astype(np.float64)
        odds = np.log((ones + 0.4) / (seen - ones + 0.4)).astype("<f4")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([odds.tobytes()], pa.binary())], names=["segment", "odds"])


def learn_bits(texts: DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    """Log odds of all slots, from all training texts; the tables have a fixed size."""
    spread = F.pmod(F.spark_partition_id(), F.lit(16))
    parts = texts.select("text").mapInArrow(_count_bits, "segment int, counts binary").withColumn("salt", spread)
    parts = parts.repartition("segment", "salt").drop("salt").mapInArrow(_add_segments, "segment int, counts binary")
    got = parts.repartition("segment").mapInArrow(_log_odds, "segment int, odds binary").toArrow()
    tables = np.zeros((3, SLOTS), np.float32)
    for segment, odds in zip(got["segment"].to_pylist(), got["odds"]):
        i, start = divmod(segment, SLOTS // SEGMENT)
        tables[i, start * SEGMENT : (start + 1) * SEGMENT] = np.frombuffer(odds.as_buffer(), "<f4")
    return tables[0, :CODES].copy(), [tables[1], tables[2]]


def code_scores(model: Model, tokens: Tokens) -> np.ndarray:
    """Per text, the natural log probability of its tokens' codes.

    Texts are read side by side, CHUNK tokens at a time; each has its own weights (per gate, input and
    bit place), corrections and counts. Arrays are texts x tokens x bits, one per input.
    """
    size = np.diff(tokens.first)
    order = np.argsort(-size, kind="stable")
    contexts, n = _contexts(tokens), len(size)
    out = np.zeros(n)
    weights = [[np.full((n, CODE_BITS), w, np.float32) for w in FIRST_WEIGHTS] for _ in range(2)]
    refine = np.zeros(n * CODE_BITS * 8, np.float32)
    zeros, ones = np.zeros(n * CODES, np.float32), np.zeros(n * CODES, np.float32)
    place = np.arange(CODE_BITS, dtype=np.int32)
    for start in range(0, int(size.max(initial=0)), CHUNK):
        # Texts in order of length, so those that go on are a prefix.
        live = int(np.searchsorted(-size[order], -start, side="left"))
        texts = order[:live]
        lane = np.arange(live, dtype=np.int32)[:, None, None]
        at = tokens.first[:-1][texts][:, None] + start + np.arange(CHUNK)
        real = start + np.arange(CHUNK) < size[texts][:, None]
        at = np.where(real, at, 0)
        nodes, bits = _nodes(tokens.code[at].astype(np.int32))
        cell = lane * CODES + nodes
        zero, one = zeros[cell], ones[cell]
        inputs = [model.plain[nodes]]
        inputs += [odds[contexts[i][at].astype(np.int32)[..., None] * CODES + nodes] for i, odds in enumerate(model.orders)]
        inputs.append(np.log((one + np.float32(0.4)) / (zero + np.float32(0.4))))
        gate = zero + one > 0
        sums = [sum(w[:live, None] * x for w, x in zip(weights[g], inputs)) for g in range(2)]
        total = np.where(gate, sums[1], sums[0])
        slot = (lane * CODE_BITS + place) * 8 + np.clip(total + 4, 0, 7).astype(np.int32)
        total = np.clip(total + refine[slot], -12, 12)
        sign = (2 * bits - 1).astype(np.float32)
        miss = np.exp(-sign * total)
        shown = real[..., None]
        out[texts] -= (np.log1p(miss) * shown).sum(axis=(1, 2), dtype=np.float64)
        error = sign * (miss / (1 + miss)) * shown
        gated = error * gate
        for k, x in enumerate(inputs):
            both, upper = (error * x).sum(axis=1), (gated * x).sum(axis=1)
            weights[1][k][:live] += np.float32(RATE) * upper
            weights[0][k][:live] += np.float32(RATE) * (both - upper)
        refine[: live * CODE_BITS * 8] += REFINE_RATE * np.bincount(slot.ravel(), weights=error.ravel(), minlength=live * CODE_BITS * 8)
        hit = bits.astype(bool) & shown
        ones[: live * CODES] += np.bincount(cell[hit], minlength=live * CODES)
        zeros[: live * CODES] += np.bincount(cell[~hit & shown], minlength=live * CODES)
    return out


def _score(shared):
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        model = shared.value
        known = words["word"].to_numpy().view(np.uint64)
        order = np.argsort(known)
        known, count = known[order], words["c"].to_numpy()[order]
        out = []
        for batch in docs.combine_chunks().to_batches():
            for part in blocks(batch, "text", SIDE_BY_SIDE):
                tokens = tokens_of(part.column(part.schema.get_field_index("text")))
                c = count[np.searchsorted(known, tokens.word)].astype(np.float64)
                base = np.log((c + 0.5) / (model.tokens + 0.5 * (model.kinds + 1)))
                within = np.log((c + 0.5) / (model.code_tokens[tokens.code] + 0.5 * (model.code_kinds[tokens.code] + 1)))
                starts = tokens.first[:-1]
                scores = code_scores(model, tokens) + np.add.reduceat(within, starts)
                size = pc.binary_length(part.column(part.schema.get_field_index("text"))).to_numpy() + 1
                out.append(pa.RecordBatch.from_arrays(
                    [
                        part.column(part.schema.get_field_index("key")), part.column(part.schema.get_field_index("train")),
                        pa.array(np.diff(tokens.first)), pa.array(np.add.reduceat((c > 0).astype(np.int64), starts)),
                        pa.array(np.add.reduceat(base, starts) / math.log(10)), pa.array(scores / math.log(10)),
                        pa.array(-scores / math.log(2) / size),
                    ],
                    names=["key", "train", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"],
                ))
        return pa.Table.from_batches(out)

    return run


def score_texts(docs: DataFrame, train: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, train, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.

    `train` is a SQL condition on the columns of `docs`: the rows to learn from. Token counts and bit
    counts cover all of them; a token is known if a training text has it. base_score is the smoothed
    unigram log10 probability; score is the mixing model's, bits_per_byte the same in bits per byte of text and one
    for its end. Missing texts count as empty: one end token. Without training rows all counts are 0.

    Documents are dealt into buckets of bounded text; each bucket's distinct tokens are counted, joined
    with the counts of all buckets, and met by the bucket's documents. The bit tables, of a fixed size, are
    broadcast. Rows that repeat id and text share a bucket, copies under other ids do not.
    """
    work = Workspace(docs.sparkSession)
    rows, n = bucketed(docs, key, text, train)
    listed = rows.select("text", "bucket", F.col("train").cast("int").alias("train")).repartition(n, "bucket")
    words = work.table(listed.mapInArrow(_words_of_buckets, "bucket int, word long, code int, n long"), "words")
    counts = work.table(words.groupBy("word").agg(F.first("code").alias("code"), F.sum("n").alias("c")), "counts")
    known = counts.filter("c > 0").groupBy("code").agg(F.sum("c").alias("tokens"), F.count("*").alias("kinds")).toPandas()
    code_tokens, code_kinds = np.zeros(CODES), np.zeros(CODES)
    code_tokens[known["code"]], code_kinds[known["code"]] = known["tokens"], known["kinds"]
    plain, orders = learn_bits(rows.filter("train"))
    model = Model(plain, orders, code_tokens, code_kinds, int(code_tokens.sum()), int(code_kinds.sum()))
    met = work.table(words.join(counts.select("word", "c"), "word").select("bucket", "word", "c"), "met")
    work.drop("words", "counts")
    key_type = dict(docs.dtypes)[key]
    schema = f"key {key_type}, train boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double"
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = rows.groupBy("bucket").cogroup(met.groupBy("bucket")).applyInArrow(_score(shared), schema)
    return scored.select(
        col("key").alias(key), "train", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
        "bits_per_byte",
    )
