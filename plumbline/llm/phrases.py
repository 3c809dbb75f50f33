"""Phrases that belong together, from exact counts kept in burstable tries.

Every task counts its texts' phrases in a trie over word ids. Containers of the trie are hash tables of
whole suffixes: one for all rare first words, one for each frequent one; one of these that holds more than
BURST entries bursts into a node with a container per next word. When a trie holds more than ENTRIES, its largest subtrees leave as runs sorted by words, until half
is left. Runs are shuffled by the phrase's first words, the prefix, and summed per prefix partition.

A phrase of three or four words is frequent only if its pairs are. So words and pairs are counted first,
and longer phrases only where a bitmap of hashed frequent pairs has all their pairs: it may let a few too
many pass, never too few. Prefixes have two words; pairs that hold more than a share of all words get
prefixes of three, so that no partition is left with one crowded pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.llm.common import Workspace, blocks
from plumbline.llm.words import Words, _LOWER, hash_words, pair, text_bytes

#: Words of the longest phrase. Suffixes pack three word ids of ID_BITS bits.
LONGEST, ID_BITS = 4, 21

#: Entries at which a container bursts, a trie's entries in memory, and suffixes at once that give a first word its subtree.
BURST, ENTRIES, HOT = 4_096, 1 << 20, 32

#: Bits of the bitmap per frequent pair, and at most.
BITS_PER_PAIR, MOST_BITS = 16, 1 << 30

#: Pairs with more than one in CROWDED of all words have prefixes of three words; there are fewer of them than that.
CROWDED = 2_048

#: Language of texts without one.
UNKNOWN = "und"

_KIND = np.zeros(256, dtype=np.uint8)  # 0: of a word, 1: between words, 2: between pieces
_KIND[[9, 32]] = 1
_KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2


def piece_words(column: pa.Array) -> tuple[Words, np.ndarray]:
    """Words of all texts, A-Z in lower case, and for each whether the next word follows in its piece."""
    data, offsets = text_bytes(column)
    data = _LOWER[data]
    n = len(data) - 8
    kind = _KIND[data[:n]]
    inside = kind == 0
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    piece = np.cumsum(kind == 2)[start] if n else np.zeros(0, np.int64)
    follows = np.zeros(len(start), dtype=bool)
    follows[:-1] = piece[1:] == piece[:-1]
    follows[first[1:][first[1:] > 0] - 1] = False  # the last word of a text
    return Words(data, first, start, end), follows


class Trie:
    """Counts of phrases (head, suffix): head is language and first word, suffix packs the ids of up to three more.

    The root is a hash container of whole phrases. A first word that comes with HOT different suffixes at
    once gets a subtree of its own; what the root has of it stays there and is added when a run is made.
    `longest` tells how many ids of a suffix can be set, so that keys of pairs stay small numbers.
    """

    def __init__(self, longest: int = LONGEST):
        self.cold: dict[int, int] = {}
        self.root: dict[int, dict] = {}  # head -> container or node
        self.entries = 0
        self.unused = ID_BITS * (LONGEST - longest)
        self.width = ID_BITS * (longest - 1)

    def add(self, head: np.ndarray, suffix: np.ndarray, count: np.ndarray) -> None:
        """Adds distinct phrases, sorted by head and suffix."""
        if not len(head):
            return
        cuts = np.flatnonzero(np.append(True, head[1:] != head[:-1]))
        sizes = np.diff(np.append(cuts, len(head)))
        root, own = self.root, np.zeros(len(cuts), dtype=bool)
        for i, (key, size) in enumerate(zip(head[cuts].tolist(), sizes.tolist())):
            own[i] = size >= HOT or key in root
        rest = ~np.repeat(own, sizes)
        cold, before = self.cold, len(self.cold)
        get = cold.get
        for key, n in zip(self._packed(head[rest], suffix[rest]), count[rest].tolist()):
            cold[key] = get(key, 0) + n
        grown = len(cold) - before
        for at, size in zip(cuts[own].tolist(), sizes[own].tolist()):
            key, end = int(head[at]), at + size
            more, root[key] = _insert(root.get(key, {}), suffix[at:end].tolist(), count[at:end].tolist(), 2 * ID_BITS)
            grown += more
        self.entries += grown

    def _packed(self, head: np.ndarray, suffix: np.ndarray) -> list[int]:
        if self.width <= 2 * ID_BITS - 10:
            return (head << self.width | suffix >> self.unused).tolist()
        return [h << self.width | s for h, s in zip(head.tolist(), (suffix >> self.unused).tolist())]

    def _taken(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, counts = list(self.cold), np.fromiter(self.cold.values(), np.int64, len(self.cold))
        mask, self.cold = (1 << self.width) - 1, {}
        if self.width <= 2 * ID_BITS - 10:
            packed = np.array(keys, np.int64)
            return packed >> self.width, (packed & mask) << self.unused, counts
        return np.array([k >> self.width for k in keys], np.int64), np.array([k & mask for k in keys], np.int64) << self.unused, counts

    def pop(self, left: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Takes the root's container and the largest subtrees out until `left` entries remain: heads, suffixes and counts."""
        self.entries -= len(self.cold)
        parts = [self._taken()]
        whole = {key: _entries(content) for key, content in self.root.items()}
        for key in sorted(whole, key=whole.get, reverse=True):
            if self.entries <= left:
                break
            self.entries -= whole[key]
            for table in _containers(self.root.pop(key)):
                parts.append((np.full(len(table), key), np.fromiter(table, np.int64, len(table)), np.fromiter(table.values(), np.int64, len(table))))
        return tuple(np.concatenate(c) for c in zip(*parts))


class Node(dict):
    """A burst container: next word id -> container or node."""


def _insert(content: dict, suffixes: list[int], counts: list[int], shift: int) -> tuple[int, dict]:
    """Adds whole suffixes whose next word id stands at `shift`; the number of new entries and the content, burst if too large."""
    if isinstance(content, Node):
        grown, at = 0, 0
        while at < len(suffixes):
            word, end = suffixes[at] >> shift & (1 << ID_BITS) - 1, at + 1
            while end < len(suffixes) and suffixes[end] >> shift & (1 << ID_BITS) - 1 == word:
                end += 1
            more, content[word] = _insert(content.get(word, {}), suffixes[at:end], counts[at:end], shift - ID_BITS)
            grown, at = grown + more, end
        return grown, content
    before, get = len(content), content.get
    for s, c in zip(suffixes, counts):
        content[s] = get(s, 0) + c
    grown = len(content) - before
    if len(content) > BURST and shift > 0:
        node = Node()
        for s, c in content.items():
            node.setdefault(s >> shift & (1 << ID_BITS) - 1, {})[s] = c
        content = node
    return grown, content


def _entries(content: dict) -> int:
    return sum(map(_entries, content.values())) if isinstance(content, Node) else len(content)


def _containers(content: dict) -> Iterator[dict]:
    if isinstance(content, Node):
        for child in content.values():
            yield from _containers(child)
    else:
        yield content


class Vocabulary:
    """Ids from 1 for the words and languages a task has seen."""

    def __init__(self):
        self.ids: dict[int, int] = {}
        self.words: list[bytes] = [b""]
        self.hashes: list[int] = [0]
        self.langs: dict[str, int] = {}

    def number(self, words: Words, hashes: np.ndarray) -> np.ndarray:
        distinct, where, of = np.unique(hashes, return_index=True, return_inverse=True)
        ids = np.empty(len(distinct), dtype=np.int64)
        for i, (h, w) in enumerate(zip(distinct.tolist(), where.tolist())):
            known = self.ids.get(h)
            if known is None:
                known = self.ids[h] = len(self.words)
                self.hashes.append(h)
                self.words.append(words.data[words.start[w] : words.end[w]].tobytes())
            ids[i] = known
        return ids[of]

    def language(self, names: pa.Array) -> np.ndarray:
        coded = names.dictionary_encode()
        known = np.array([self.langs.setdefault(n, len(self.langs)) for n in coded.dictionary.to_pylist()], dtype=np.int64)
        return known[coded.indices.to_numpy()] if len(known) else np.zeros(0, np.int64)


def _distinct(head: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((suffix, head))
    head, suffix = head[order], suffix[order]
    fresh = np.ones(len(head), dtype=bool)
    fresh[1:] = (head[1:] != head[:-1]) | (suffix[1:] != suffix[:-1])
    at = np.flatnonzero(fresh)
    return head[at], suffix[at], np.diff(np.append(at, len(head)))


def _run(trie: Trie, vocabulary: Vocabulary, left: int, crowded: set[tuple[str, str]]) -> pa.RecordBatch:
    """The largest subtrees as rows (lang, prefix, phrase, n), sorted by language and words.

    The prefix is a hash of the first two words, or of three. The count of all words of a language is the entry of no word.
    """
    head, suffix, count = trie.pop(left)
    mask = (1 << ID_BITS) - 1
    ids = np.stack([head & mask] + [suffix >> (ID_BITS * k) & mask for k in (2, 1, 0)])
    spelled = pa.array(vocabulary.words, pa.binary())
    rank = np.empty(len(spelled), dtype=np.int64)
    rank[pc.sort_indices(spelled).to_numpy()] = np.arange(len(spelled))
    order = np.lexsort((*rank[ids[: 1 + int((ids[1:] > 0).any(axis=1).sum())][::-1]], head >> ID_BITS))
    ids, head = ids[:, order], head[order]
    # A phrase may come from the root and from a subtree.
    same = np.append(True, (head[1:] != head[:-1]) | (ids[1:, 1:] != ids[1:, :-1]).any(axis=0)) if len(head) else np.zeros(0, bool)
    count = np.add.reduceat(count[order], np.flatnonzero(same)) if len(head) else count
    ids, head = ids[:, same], head[same]
    text, names = spelled.cast(pa.string()), pa.array(list(vocabulary.langs), pa.string())
    lang, phrase = names.take(pa.array(head >> ID_BITS)), text.take(pa.array(ids[0]))
    hashes = np.array(vocabulary.hashes, dtype=np.uint64)
    prefix = pair(hashes[ids[0]], hashes[ids[1]])
    for k in range(1, LONGEST):
        more = ids[k] > 0
        if not more.any():
            break
        longer = pc.binary_join_element_wise(phrase, text.take(pa.array(ids[k])), " ")
        if k == 2 and crowded:
            hot = pc.is_in(pc.binary_join_element_wise(lang, phrase, "\t"), pa.array([f"{a}\t{b}" for a, b in crowded]))
            prefix = np.where(hot.to_numpy(zero_copy_only=False), pair(prefix, hashes[ids[2]]), prefix)
        phrase = longer if more.all() else pc.if_else(pa.array(more), longer, phrase)
    return pa.RecordBatch.from_arrays([lang, pa.array((prefix >> np.uint64(33)).astype(np.int32)), phrase, pa.array(count)], names=["lang", "prefix", "phrase", "n"])


def pair_hashes(lang: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hash of each word with the next one, in a language."""
    return pair(pair(hashes[:-1], hashes[1:]), lang[:-1])


def hash_languages(names: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(names)
    # Languages are hashed as words are; an empty name is a word of no byte.
    return hash_words(Words(data, np.arange(len(names) + 1), offsets[:-1], offsets[1:]))


def _count(shortest: int, longest: int, bitmap=None, crowded: set[tuple[str, str]] = frozenset()):
    """Phrases of `shortest` to `longest` words of (lang, text), summed per task as far as memory allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, vocabulary = Trie(longest), Vocabulary()
        for batch in batches:
            for part in blocks(batch, "text"):
                words, follows = piece_words(part.column(1))
                if len(vocabulary.words) + len(words.start) >= 1 << ID_BITS:
                    yield _run(trie, vocabulary, 0, crowded)
                    trie, vocabulary = Trie(longest), Vocabulary()
                hashes = hash_words(words)
                ids = vocabulary.number(words, hashes)
                head = (vocabulary.language(part.column(0))[words.docs()] << ID_BITS) | ids
                joined = follows[:-1]
                if bitmap is not None:
                    bits = len(bitmap.value) * 64
                    bit = pair_hashes(hash_languages(part.column(0))[words.docs()], hashes) % np.uint64(bits) if len(hashes) else np.zeros(0, np.uint64)
                    joined = joined & ((bitmap.value[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)
                heads, suffixes = [], []
                if shortest == 1:
                    heads += [head, head & ~((1 << ID_BITS) - 1)]
                    suffixes += [np.zeros(len(ids), np.int64)] * 2
                at, suffix = np.arange(len(ids)), np.zeros(len(ids), np.int64)
                for n in range(2, longest + 1):
                    more = at + n - 2 < len(ids) - 1
                    at, suffix = at[more], suffix[more]
                    more = joined[at + n - 2]
                    at, suffix = at[more], suffix[more]
                    suffix = suffix | ids[at + n - 1] << (ID_BITS * (LONGEST - n))
                    if n >= shortest:
                        heads.append(head[at])
                        suffixes.append(suffix)
                trie.add(*_distinct(np.concatenate(heads), np.concatenate(suffixes)))
                if trie.entries > ENTRIES:
                    yield _run(trie, vocabulary, ENTRIES // 2, crowded)
        if trie.entries:
            yield _run(trie, vocabulary, 0, crowded)

    return run


RUNS = "lang string, prefix int, phrase string, n long"


def _merged(runs: DataFrame, least: int) -> DataFrame:
    """Runs summed per prefix partition; phrases of fewer than `least` occurrences go."""
    sums = runs.repartition("lang", "prefix").groupBy("lang", "prefix", "phrase").agg(F.sum("n").alias("n"))
    words = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    return sums.filter((F.col("n") >= least) | (F.col("phrase") == "")).select("lang", "phrase", words.alias("words"), "n")


def _pair_bitmap(pairs: DataFrame) -> np.ndarray:
    """Bits of the hashes of frequent pairs (lang, phrase); its size follows their number up to MOST_BITS."""
    number = pairs.count()
    bits = 1 << 12
    while bits < min(number * BITS_PER_PAIR, MOST_BITS):
        bits *= 2

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, _ = piece_words(batch.column(1))
            langs = hash_languages(batch.column(0))[words.docs()]
            hashes = pair_hashes(langs, hash_words(words))[::2] if batch.num_rows else np.zeros(0, np.uint64)
            bit = hashes % np.uint64(bits)
            cell, mask = (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(mask.view(np.int64))], names=["cell", "mask"])

    got = pairs.select("lang", "phrase").mapInArrow(place, "cell long, mask long").groupBy("cell").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[got["cell"].to_numpy()] = got["mask"].to_numpy()
    return out.view(np.uint64)


def count_phrases(docs: DataFrame, least: int, work: Workspace, text: str = "text", lang: str = "lang") -> DataFrame:
    """All phrases of one to LONGEST words with at least `least` occurrences: lang, phrase, words and n, as a table.

    The entry of no words per language has the count of all its words.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text")).filter("text is not null")
    short = work.table(_merged(rows.mapInArrow(_count(1, 2), RUNS), least), "short")
    pairs = short.filter("words = 2")
    whole = short.filter("words = 0").agg(F.sum("n")).first()[0] or 0
    # Fewer than CROWDED pairs, since each holds that share of all words.
    crowded = {(r["lang"], r["phrase"]) for r in pairs.filter(F.col("n") > whole / CROWDED).select("lang", "phrase").collect()}
    bitmap = work.spark.sparkContext.broadcast(_pair_bitmap(pairs))
    long = work.table(_merged(rows.mapInArrow(_count(3, LONGEST, bitmap, crowded), RUNS), least), "long")
    return short.unionByName(long)


def _wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def mine_phrases(docs: DataFrame, least: int = 30, top: int = 2_000, text: str = "text", lang: str = "lang") -> DataFrame:
    """Phrases of two to four words whose words belong together, the `top` best of each language.

    Returns lang, rank (from 1), phrase, a (its occurrences), l and r (those of both sides of its weakest
    cut), n (all words of the language) and score = floor(2000000 a / (l + r)). Phrases lie within pieces of
    text between `.,;:!?` and line ends, A-Z count as lower case, words are what space and tab separate.
    Counts are exact and whole: phrases of at least `least` occurrences are candidates; one that lies within a
    longer candidate with four fifths of its occurrences or more goes. Of cuts with one score the earliest
    counts; ties in rank go to the more frequent phrase, then to the first in byte order.

    A NULL text has no words; a NULL language is `und`. Repeated rows count each. Other columns are not
    read. An empty table gives no rows.
    """
    work = Workspace(docs.sparkSession)
    counted = count_phrases(docs, least, work, text, lang)
    phrases, totals = counted.filter("words > 0"), counted.filter("words = 0").select("lang", F.col("n").alias("whole"))
    candidates = phrases.filter("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    # Both sides of every cut have been counted: they are at least as frequent as the whole.
    listed, k = F.split("phrase", " "), F.col("k")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice(listed, F.lit(1), k), " ").alias("first"), F.array_join(F.slice(listed, k + 1, F.size(listed)), " ").alias("rest"))
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    cuts = cuts.withColumn("score", F.expr("(2000000 * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + r)"))
    weakest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # The most frequent longer candidate that each shorter one lies in.
    inner = F.explode(
        F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda size: F.transform(
            F.sequence(F.lit(1), F.col("words") - size + 1), lambda at: F.array_join(F.slice(listed, at, size), " "))))
    )
    inner = candidates.filter("words > 2").select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = weakest.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * _wide(F.col("longer")) < 80 * _wide(F.col("a"))))
    order = W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    best = left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    # One row per language.
    best = best.join(totals, "lang")
    return best.select("lang", "rank", "phrase", "a", "cut.l", "cut.r", F.col("whole").alias("n"), "cut.score")
