"""Benchmark passages in training documents: BM25 retrieval with block-max bounds, then overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from plumbline.functions.columns import col
from plumbline.llm.common import blocks, text_rows
from plumbline.llm.words import hash_grams, hash_words, split_words, text_bytes

#: Words of a cell. A passage is two neighbouring cells, so any run of CELL + 1 words lies in one.
CELL = 64

#: BM25.
K1, B = 1.2, 0.75

#: A passage is retrieved if it scores this share of what the test passage scores for itself.
LEAST_SHARE = 0.5

#: Runs of this many words are compared, and these shares of question and answer must be found.
GRAM, LEAST_QUESTION, LEAST_ANSWER = 3, 0.6, 0.6

#: Test passages per block of the index, and words per index that travels with the tasks (about 60
#: bytes each).
BLOCK_UNITS, INDEX_WORDS = 16, 500_000

MATCHES = "array<struct<item_id:bigint,start:int,score:double,question_overlap:double,answer_overlap:double>>"

# ASCII marks become blanks; letters, digits and bytes of other characters stay.
_PLAIN = np.full(256, 32, dtype=np.uint8)
_PLAIN[48:58] = np.arange(48, 58)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)


class Index(NamedTuple):
    """Terms are numbered by rising bound, so that a passage's terms sort from common to telling."""

    vocabulary: np.ndarray  # hashes in order, and
    numbers: np.ndarray  # the term number of each
    seen: np.ndarray  # a table of hash remainders, to pass over other words quickly
    bound: np.ndarray  # per term, its highest share of a test passage's own score
    block_at: np.ndarray  # per term, where its blocks start
    block: np.ndarray  # block numbers, rising within a term
    entry_key: np.ndarray  # term and block in one number, rising
    block_bound: np.ndarray  # highest share within the block
    post_at: np.ndarray  # per entry of `block`, where its postings start
    post_unit: np.ndarray
    post_share: np.ndarray
    unit_item: np.ndarray  # per test passage, its item
    blocks: int
    item_id: np.ndarray
    question: list[np.ndarray]  # per item, hashes of its runs of words
    answer: list[np.ndarray]


def normal_words(column: pa.Array):
    """Words of letters and digits, in lower case, as hashes, with the index of each text's first word."""
    data, offsets = text_bytes(pc.utf8_lower(column))
    plain = [None, pa.py_buffer(offsets), pa.py_buffer(_PLAIN[data[:-8]])]
    words = split_words(pa.Array.from_buffers(pa.large_binary(), len(column), plain))
    return hash_words(words), words.first


def _split_item(text: str) -> tuple[str, str]:
    """Question and answer: the last sentence or line is the answer, if there are several."""
    parts = re.split(r"(?<=[.!?])\s+|\n+", text.strip())
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


def _hashes(text: str) -> np.ndarray:
    return normal_words(pa.array([text]))[0]


def _runs(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hash_grams(hashes, min(GRAM, len(hashes)))) if len(hashes) else hashes


def build_index(items: list[tuple[int, str]], df: dict[int, int], units: int, mean_length: float) -> Index | None:
    """The index of one group of items; `df`, `units` and `mean_length` describe all items."""
    unit_item, unit_hashes, item_id, question, answer = [], [], [], [], []
    for key, text in items:
        asked, told = _split_item(text)
        first, second = _hashes(asked), _hashes(told)
        if not len(first) + len(second):
            continue
        for part in _units(np.concatenate([first, second])):
            unit_item.append(len(item_id))
            unit_hashes.append(part)
        item_id.append(key)
        question.append(_runs(first))
        answer.append(_runs(second))
    if not item_id:
        return None
    # Test passages of like length share a block, which keeps block bounds tight.
    order = sorted(range(len(unit_hashes)), key=lambda u: (len(unit_hashes[u]), u))
    terms, unit, share = [], [], []
    for number, u in enumerate(order):
        term, tf = np.unique(unit_hashes[u], return_counts=True)
        idf = np.array([np.log(1 + (units - df[t] + 0.5) / (df[t] + 0.5)) for t in term.tolist()])
        weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(unit_hashes[u]) / mean_length))
        terms.append(term)
        unit.append(np.full(len(term), number))
        share.append(weight / weight.sum())
    terms, unit, share = (np.concatenate(x) for x in (terms, unit, share))
    vocabulary, number = np.unique(terms, return_inverse=True)
    bound = np.zeros(len(vocabulary))
    np.maximum.at(bound, number, share)
    rank = np.empty(len(vocabulary), dtype=np.int64)
    rank[np.argsort(bound, kind="stable")] = np.arange(len(vocabulary))
    term = rank[number]
    sort = np.lexsort((unit, term))
    term, unit, share = term[sort], unit[sort], share[sort]
    n_blocks = -(-len(order) // BLOCK_UNITS)
    cell = term * n_blocks + unit // BLOCK_UNITS
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    seen = np.zeros(1 << 20, dtype=bool)
    seen[(vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    return Index(
        vocabulary, rank, seen, np.sort(bound), np.searchsorted(term[first], np.arange(len(vocabulary) + 1)), cell[first] % n_blocks, cell[first],
        np.maximum.reduceat(share, first), np.append(first, len(term)), unit, share, np.array(unit_item)[order], n_blocks,
        np.array(item_id), question, answer,
    )


def _units(hashes: np.ndarray) -> list[np.ndarray]:
    """Test passages of an item: even parts of at most CELL words."""
    return np.array_split(hashes, -(-len(hashes) // CELL))


def _ranges(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the given ranges, and the range each belongs to."""
    n = stops - starts
    of = np.repeat(np.arange(len(n)), n)
    return starts[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n), of


def retrieve(index: Index, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All (text, passage, test passage, share) with a share of at least LEAST_SHARE.

    Bounds cut the work three times, as in block-max WAND, for all passages of a batch at once:
    passages whose terms' bounds sum to less than the threshold hold nothing; among the others, terms
    that together stay below it are left out of the search for blocks; and only blocks whose own
    bounds, with those terms added, reach it are scored in full.
    """
    floor = LEAST_SHARE - 1e-9
    hit = np.flatnonzero(index.seen[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(index.vocabulary, hashes[hit]), len(index.vocabulary) - 1)
    good = index.vocabulary[at] == hashes[hit]
    hit, term = hit[good], index.numbers[at[good]]
    counts = np.diff(first)
    cells = -(-counts // CELL)
    passages = np.maximum(cells - 1, np.minimum(cells, 1))
    base = np.cumsum(passages) - passages
    text = np.searchsorted(first, hit, side="right") - 1
    cell = (hit - first[text]) // CELL
    # A word is in the passage that starts with its cell and in the one before.
    here, before = cell < passages[text], cell > 0
    passage = np.concatenate([(base[text] + cell)[here], (base[text] + cell - 1)[before]])
    term = np.concatenate([term[here], term[before]])
    total = int(passages.sum())
    able = np.bincount(passage, weights=index.bound[term], minlength=total) >= floor
    keep = able[passage]
    key = np.sort(passage[keep] * len(index.vocabulary) + term[keep])
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    passage, term = key // len(index.vocabulary), key % len(index.vocabulary)
    nothing = tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0),)
    if not len(key):
        return nothing
    begins = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
    of = np.cumsum(np.append(True, passage[1:] != passage[:-1])) - 1
    running = np.cumsum(index.bound[term])
    running -= np.append(0, running)[begins][of]
    telling = running >= floor
    rest = np.bincount(of, weights=np.where(telling, 0, index.bound[term]), minlength=len(begins))
    # Blocks that hold a telling term.
    chosen = np.flatnonzero(telling)
    entry, pick = _ranges(index.block_at[term[chosen]], index.block_at[term[chosen] + 1])
    upper = np.bincount(of[chosen[pick]] * index.blocks + index.block[entry], weights=index.block_bound[entry], minlength=len(rest) * index.blocks)
    pairs = np.flatnonzero((upper.reshape(-1, index.blocks) + rest[:, None]).ravel() >= floor)
    if not len(pairs):
        return nothing
    # Full scores of the test passages of those blocks.
    group, block = pairs // index.blocks, pairs % index.blocks
    ends = np.append(begins[1:], len(term))
    row, candidate = _ranges(begins[group], ends[group])
    cell_key = term[row] * index.blocks + block[candidate]
    place = np.minimum(np.searchsorted(index.entry_key, cell_key), len(index.entry_key) - 1)
    found = index.entry_key[place] == cell_key
    place, candidate = place[found], candidate[found]
    post, which = _ranges(index.post_at[place], index.post_at[place + 1])
    slot = candidate[which] * BLOCK_UNITS + index.post_unit[post] % BLOCK_UNITS
    share = np.bincount(slot, weights=index.post_share[post], minlength=len(pairs) * BLOCK_UNITS)
    slot = np.flatnonzero(share >= floor)
    candidate = slot // BLOCK_UNITS
    unit = block[candidate] * BLOCK_UNITS + slot % BLOCK_UNITS
    passage = passage[begins[group[candidate]]]
    text = np.searchsorted(np.cumsum(passages), passage, side="right")
    return text, passage - base[text], unit, share[slot]


def verify(index: Index, hashes: np.ndarray, first: np.ndarray, found: tuple) -> list[list[dict]]:
    """Per text, the items whose question and answer its retrieved passages hold."""
    text, passage, unit, share = found
    out: list[list[dict]] = [[] for _ in range(len(first) - 1)]
    item = index.unit_item[unit]
    order = np.lexsort((passage, item, text))
    cuts = np.flatnonzero(np.append(True, np.diff(text[order]) | np.diff(item[order])))
    for rows in np.split(order, cuts[1:]) if len(order) else []:
        t, i = int(text[rows[0]]), int(item[rows[0]])
        words = hashes[first[t] : first[t + 1]]
        parts = [words[p * CELL : (p + 2) * CELL] for p in np.unique(passage[rows])]

        def overlap(runs: np.ndarray, n_words: int) -> float:
            if not len(runs):
                return 1.0
            return float(np.isin(runs, np.concatenate([hash_grams(part, n_words) for part in parts])).mean())

        asked = max(overlap(index.question[i], n) for n in range(1, GRAM + 1))
        told = max(overlap(index.answer[i], n) for n in range(1, GRAM + 1))
        if asked >= LEAST_QUESTION and told >= LEAST_ANSWER:
            best = rows[np.argmax(share[rows])]
            out[t].append({
                "item_id": int(index.item_id[i]), "start": int(passage[best]) * CELL, "score": float(share[best]),
                "question_overlap": asked, "answer_overlap": told,
            })
    return out


def _indexes(items: DataFrame, key: str, text: str) -> Iterator[Index]:
    """Indexes of about INDEX_WORDS words each, one after the other."""
    rows = items.select(F.col(key).cast("long").alias("item_id"), F.col(text).alias("text"))
    rows = rows.filter("item_id is not null and length(text) > 0").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(1).to_pylist():
                for part in _units(_hashes(" ".join(_split_item(value)))) if len(_hashes(value)) else []:
                    terms = np.unique(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(terms.view(np.int64)), pa.array(np.full(len(terms), len(part), np.int64))], names=["term", "length"]
                    )
                    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([len(part)])], names=["term", "length"])

    terms = rows.mapInArrow(count, "term long, length long")
    units, words = terms.filter("term is null").agg(F.count("*"), F.sum("length")).first()
    if not units:
        return
    groups = -(-words // INDEX_WORDS)
    group = F.pmod(F.xxhash64("item_id", "text"), F.lit(groups))
    df = terms.filter("term is not null").groupBy("term").agg(F.count("*").alias("df"))
    for number in range(groups):
        own = rows.filter(group == number)
        # The terms of one group of items, with their counts among all items.
        held = own.mapInArrow(count, "term long, length long").select("term").distinct()
        table = df.join(held, "term").toArrow()
        counts = dict(zip(table["term"].to_numpy().view(np.uint64).tolist(), table["df"].to_pylist()))
        listed = sorted((r["item_id"], r["text"]) for r in own.collect())
        index = build_index(listed, counts, units, words / units)
        if index is not None:
            yield index


def find_contamination(
    docs: DataFrame, items: DataFrame, key: str = "item_id", text: str = "text", keep: list[str] | None = None,
    name: str = "contamination",
) -> DataFrame:
    """The columns `keep` of `docs` (all if None) with the array `name`: the test items each document holds.

    `items` has key and text. Items are cut into test passages of at most CELL words and indexed for
    BM25. All passages of all documents (CELL words and their successors, over the whole text) query
    the index and retrieve every test passage whose share of its own score reaches LEAST_SHARE. An item
    counts if at least LEAST_QUESTION of the runs of GRAM words of its question and LEAST_ANSWER of
    those of its answer (its last sentence) stand in the retrieved passages; words are compared in
    lower case without ASCII marks, and shorter parts as a whole. Each entry gives the item, the first
    word of the best passage, that passage's share, and both overlaps.

    Rows are judged one by one where they lie: nothing is shuffled. Items travel with the tasks in
    indexes of bounded size, one pass for each. Items without id or words take no part; missing or
    empty texts, and all texts if there are no items, hold none. Repeated documents are judged alike.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != name]
    rows, at = text_rows(docs, kept, text)
    rows = rows.withColumn(name, F.lit(None).cast(MATCHES))
    indexes = _indexes(items, key, text)
    index = next(indexes, None)
    while index is not None:
        following = next(indexes, None)
        # The last pass hands on only what is kept.
        names = rows.columns if following is not None else [*kept, name]
        shared = docs.sparkSession.sparkContext.broadcast(index)
        rows, index = rows.mapInArrow(_scan(shared, at, len(names) - 1), rows.select(*map(col, names)).schema), following
    return rows.select(*map(col, kept), F.coalesce(col(name), F.array().cast(MATCHES)).alias(name))


def _scan(shared, at: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, batch.schema.names[at]):
                hashes, first = normal_words(part.column(at))
                found = verify(shared.value, hashes, first, retrieve(shared.value, hashes, first))
                so_far = part.column(part.num_columns - 1)
                if any(found):
                    both = [(a or []) + b or None for a, b in zip(so_far.to_pylist(), found)]
                    so_far = pa.array(both, so_far.type)
                names = [*part.schema.names[:width], part.schema.names[-1]]
                yield pa.RecordBatch.from_arrays([*part.columns[:width], so_far], names=names)

    return run
