"""Removal of long repeated word sequences by compaction of a De Bruijn graph.

The edges of the graph are the runs of `window` words (50 by default) of all texts; two edges meet
where one's last 49 words are the other's first. What repeats is a path of edges that several
documents walk. Edges are never listed one by one where a whole path can stand for them:

1. Each document is cut into pieces: longest runs of consecutive edges whose smallest inner gram of
   20 words (the anchor) is the same. Equal edges have equal anchors, at the same place, so whatever
   repeats can be found by joining on anchors; a piece holds 16 edges on average.
2. An anchor of a single document ends there. Pieces of the others are joined on their content
   (128 bits over all their words). Where every occurrence of an anchor has one and the same piece,
   the path does not branch: the piece as a whole is repeated, and its smallest document its source.
3. Where an anchor occurs in different pieces, the path branches. Only those pieces are opened into
   single edges, which are joined on their own hash.
4. Paths grow: runs of a document whose source coordinates continue each other are one span. The
   words at its source coordinates are read again and their digest goes with the span; words are
   removed only if the document's own words have that digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import Workspace, blocks, id_bitmap, in_bitmap
from plumbline.llm.words import hash_grams, hash_words, pair, split_words, starts_of

WINDOW, ANCHOR = 50, 20

PIECE = "doc long, row long, pos int, n int, anchor long, content long, lead boolean"
RUNS = "array<struct<start:int,n:int,source:bigint,source_start:int>>"
SPANS = "array<struct<start:int,n:int,source:bigint,source_start:int,digests:array<binary>>>"


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Per position the index of the leftmost smallest of `width` values, by doubling."""
    at, best, covered = np.arange(len(values)), values, 1
    while covered < width:
        step = min(covered, width - covered)
        left, right = best[:-step], best[step:]
        take = right < left
        at = np.where(take, at[step:], at[:-step])
        best = np.where(take, right, left)
        covered += step
    return at


def _pieces(part: pa.RecordBatch, window: int, anchor: int) -> pa.RecordBatch:
    docs = part.column(0).to_numpy(zero_copy_only=False)
    rows, words = part.column(1).to_numpy(), split_words(part.column(2))
    hashes = hash_words(words)
    starts, text = starts_of(words.first, window)
    edges, inner = hash_grams(hashes, window), hash_grams(hashes, anchor)
    if not len(starts):
        return pa.RecordBatch.from_pydict({k: [] for k in _schema(PIECE).names}, _schema(PIECE))
    low = sliding_argmin(inner, window - anchor + 1)[starts]
    begin = np.ones(len(starts), dtype=bool)
    begin[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(begin)
    n = np.diff(np.append(first, len(starts)))
    # The first and the last edge cover all words of a piece, which has at most `window` edges.
    content = pair(pair(edges[starts[first]], edges[starts[first + n - 1]]), n.astype(np.uint64))
    named, of = inner[low[first]], text[first]
    # The first of a document's equal pieces may be the source of others.
    order = np.lexsort((first, content, named, of))
    same = np.zeros(len(first), dtype=bool)
    same[1:] = (content[order][1:] == content[order][:-1]) & (named[order][1:] == named[order][:-1]) & (of[order][1:] == of[order][:-1])
    lead = np.empty(len(first), dtype=bool)
    lead[order] = ~same
    return pa.RecordBatch.from_arrays(
        [
            pa.array(docs[of].astype(np.int64)), pa.array(rows[of]), pa.array((starts[first] - words.first[:-1][of]).astype(np.int32)), pa.array(n.astype(np.int32)),
            pa.array(named.view(np.int64)), pa.array(content.view(np.int64)), pa.array(lead),
        ],
        schema=_schema(PIECE),
    )


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in text.split(", ")])


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Per document with repeats: doc, row and spans, an array of (start, n, source, source_start, digests).

    A span is a run of `n` >= `window` words of the document, from word `start`, that the document
    `source` of smaller id also holds, from word `source_start`. Every run of `window` words that also
    starts in a document of smaller id lies in a span. Spans of different sources may overlap. `digests`
    are those of the source's words, one for each row of that id.
    Documents without an id take no part. Rows that repeat an id repeat nothing from each other; `row`,
    a hash of the text, tells them apart.
    """
    work = Workspace(docs.sparkSession)
    texts = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    texts = texts.filter("doc is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                yield _pieces(part, window, anchor)

    pieces = work.table(texts.filter(F.length("text") >= 2 * window - 1).mapInArrow(cut, PIECE), "pieces")
    shared = pieces.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").select("anchor")
    shared = work.table(shared, "shared")
    found = work.table(pieces.join(shared, "anchor"), "found")
    work.drop("pieces")

    # Distinct contents, their smallest document, and whether their anchor has other contents too.
    contents = found.groupBy("anchor", "content").agg(
        F.min("doc").alias("source"), F.expr("min_by(pos, doc) filter (where lead)").alias("source_pos")
    )
    contents = work.table(contents, "contents")
    branching = contents.groupBy("anchor").agg(F.count("*").alias("k")).filter("k > 1").select("anchor", F.lit(True).alias("branches"))
    contents = work.table(contents.join(work.table(branching, "branching"), "anchor", "left"), "paths")
    runs = found.join(contents, ["anchor", "content"])
    runs = runs.select("doc", "row", "pos", "n", "source", "source_pos", F.coalesce("branches", F.lit(False)).alias("branches"))
    runs = work.table(runs.filter("branches or doc > source"), "runs")

    whole = runs.filter("not branches").select("doc", "row", "pos", "n", "source", "source_pos")
    opened = runs.filter("branches").groupBy("doc", "row").agg(F.collect_list(F.struct("pos", "n")).alias("parts"))
    opened = work.table(opened, "opened")
    near = in_bitmap(texts, "doc", id_bitmap(opened, "doc"))
    edges = near.join(opened, ["doc", "row"]).select("doc", "row", "text", "parts")
    edges = edges.mapInArrow(_open(window), "edge long, other long, doc long, row long, pos int, lead boolean")
    edges = work.table(edges, "edges")
    known = edges.groupBy("edge", "other").agg(
        F.min("doc").alias("source"), F.max("doc").alias("high"), F.expr("min_by(pos, doc) filter (where lead)").alias("source_pos")
    )
    known = work.table(known.filter("source < high").drop("high"), "known")
    single = edges.join(known, ["edge", "other"]).filter("doc > source")
    single = single.select("doc", "row", "pos", F.lit(1).alias("n"), "source", "source_pos")
    both = whole.unionByName(single).groupBy("doc", "row").agg(F.collect_list(F.struct("pos", "n", "source", "source_pos")).alias("runs"))

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _grow(batch, window)

    spans = both.mapInArrow(join_up, f"doc long, row long, spans {RUNS}").select("doc", "row", F.inline("spans"))
    spans = work.table(spans, "unverified")
    places = spans.select("source", "source_start", "n").distinct()
    places = work.table(places.groupBy(F.col("source").alias("doc")).agg(F.collect_list(F.struct("source_start", "n")).alias("places")), "places")
    said = in_bitmap(texts, "doc", id_bitmap(places, "doc")).join(places, "doc").select("doc", "text", "places")
    said = said.mapInArrow(_digests, "source long, source_start int, n int, digest binary")
    said = work.table(said.groupBy("source", "source_start", "n").agg(F.collect_set("digest").alias("digests")), "said")
    spans = spans.join(said, ["source", "source_start", "n"]).groupBy("doc", "row")
    spans = work.table(spans.agg(F.collect_list(F.struct("start", "n", "source", "source_start", "digests")).alias("spans")), "spans")
    work.drop("unverified", "places", "said", "shared", "found", "contents", "branching", "paths", "runs", "opened", "edges", "known")
    return spans


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the words at the places that spans name as their source."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    for batch in batches:
        for part in blocks(batch, "text"):
            rows = []
            for body, doc, places in zip(part.column(1).cast(pa.binary()), part.column(0).to_pylist(), part.column(2)):
                words = body.as_py().split()
                for place in places.as_py():
                    start, n = place["source_start"], place["n"]
                    rows.append((doc, start, n, digest(words[start : start + n])))
            columns = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["source", "source_start", "n", "digest"])


def _open(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                words = split_words(part.column(2))
                hashes = hash_words(words)
                # A second, independent hash makes the key 128 bits wide.
                edges, other = hash_grams(hashes, window), hash_grams(hashes ^ np.uint64(0xA0761D6478BD642F), window)
                parts = part.column(3)
                cells, lists = parts.flatten(), np.diff(parts.offsets.to_numpy())
                pos, n = (cells.field(i).to_numpy().astype(np.int64) for i in (0, 1))
                of = np.repeat(np.repeat(np.arange(part.num_rows), lists), n)
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                place = np.repeat(pos, n) + inner
                at = words.first[:-1][of] + place
                order = np.lexsort((place, edges[at], of))
                same = np.zeros(len(at), dtype=bool)
                same[1:] = (edges[at[order]][1:] == edges[at[order]][:-1]) & (of[order][1:] == of[order][:-1])
                lead = np.empty(len(at), dtype=bool)
                lead[order] = ~same
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(edges[at].view(np.int64)), pa.array(other[at].view(np.int64)), pa.array(part.column(0).to_numpy()[of]),
                        pa.array(part.column(1).to_numpy()[of]), pa.array(place.astype(np.int32)), pa.array(lead),
                    ],
                    names=["edge", "other", "doc", "row", "pos", "lead"],
                )

    return run


def _grow(batch: pa.RecordBatch, window: int) -> Iterator[pa.RecordBatch]:
    """Joins runs whose coordinates and source coordinates continue each other."""
    lists = batch.column(2)
    of = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    pos, n, source, source_pos = (lists.flatten().field(i).to_numpy().astype(np.int64) for i in range(4))
    order = np.lexsort((pos, pos - source_pos, source, of))
    of, pos, n, source, source_pos = of[order], pos[order], n[order], source[order], source_pos[order]
    begin = np.ones(len(of), dtype=bool)
    begin[1:] = (of[1:] != of[:-1]) | (source[1:] != source[:-1]) | ((pos - source_pos)[1:] != (pos - source_pos)[:-1])
    begin[1:] |= pos[1:] > (pos + n)[:-1]
    first = np.flatnonzero(begin)
    last = np.append(first[1:], len(of)) - 1
    length = pos[last] + n[last] - pos[first] + window - 1
    counts = np.bincount(of[first], minlength=batch.num_rows)
    spans = pa.StructArray.from_arrays(
        [
            pa.array(pos[first].astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(source[first]),
            pa.array(source_pos[first].astype(np.int32)),
        ],
        names=["start", "n", "source", "source_start"],
    )
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, spans)], names=["doc", "row", "spans"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """`docs` without the words that repeat: key, n_words, n_removed, kept (words joined by one space), spans.

    A word goes if one of the runs of `window` words that cover it also starts in a document of smaller
    id; runs are judged on the input. Missing and empty texts, and texts shorter than `window` words,
    are kept whole (as no words if missing). Documents without an id are kept whole. An empty table
    gives none. Other columns are not read.
    """
    spans = repeated_spans(docs, key, text, window, anchor)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    bitmap = id_bitmap(spans, "doc")
    marked = rows.withColumns({"doc": F.coalesce(F.col("key").cast("long"), F.lit(-1).cast("long")), "row": F.xxhash64("text")})
    # Only documents that may hold a span are shuffled.
    hit = in_bitmap(marked, "doc", bitmap).join(spans, ["doc", "row"], "left").select("key", "text", "spans")
    clear = in_bitmap(marked, "doc", bitmap, inside=False).select("key", "text", F.lit(None).cast(SPANS).alias("spans"))
    key_type = dict(docs.dtypes)[key]
    schema = f"key {key_type}, n_words long, n_removed long, kept string, spans {SPANS}"
    out = hit.unionByName(clear).mapInArrow(_remove, schema)
    return out.withColumnRenamed("key", key)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in blocks(batch, "text"):
            yield _without_spans(part)


def _without_spans(part: pa.RecordBatch) -> pa.RecordBatch:
    total, removed, kept = [], [], []
    for body, spans in zip(part.column(1).cast(pa.binary()), part.column(2)):
        words = (body.as_py() or b"").split()
        total.append(len(words))
        if spans.is_valid:
            gone = np.zeros(len(words) + 1, dtype=np.int64)
            for span in spans.as_py():
                start, stop = span["start"], span["start"] + span["n"]
                if digest(words[start:stop]) in span["digests"]:
                    gone[start] += 1
                    gone[stop] -= 1
            out = np.cumsum(gone[:-1]) > 0
            words = [w for w, g in zip(words, out.tolist()) if not g]
        removed.append(total[-1] - len(words))
        kept.append(b" ".join(words))
    return pa.RecordBatch.from_arrays(
        [part.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), part.column(2)],
        names=["key", "n_words", "n_removed", "kept", "spans"],
    )
