"""Near duplicates by a chosen-path similarity join on MinHash signatures.

Documents are sets of hashed word shingles. Texts of equal sets are one class and go on as its member
of smallest id. A forest of independent trees then brings similar sets together:

* At the root all sets are together. A node picks one minwise token (a signature coordinate), and
  with probability p a second one; a set goes to the child of each value it has there. p is 1 on the
  first TWICE levels, where most pairs are found; below, `forest_shape` derives it from the threshold.
* A node of weight LEAF at most is a leaf; larger nodes branch again, one join with the signatures for
  two levels. A pair that agrees in a share a of its tokens parts below a node with probability
  f = (1-p) u + p u^2, u = 1 - a (1 - f of the child). `chance_of_loss` averages f^trees over what
  signatures make of the similarity; trees and p keep it within MISS down to DEPTH. Components lose less,
  since similar sets are linked in several ways.
* Leaves are compared exhaustively: first by signature, then, for what is left, on the full sets.

Larger nodes after CROWDED tokens are crowds, and before that the ones whose sets mostly resemble each
other, since branching would only repeat these. A crowd is first dealt into leaves that share a few of its
sets, over which most near copies are linked. That decides only which pairs need no
further look: in a node of several components these meet part by part, each part of a component with the
parts of the others. Where one component has most of the sets that costs little more than the node
itself and is done at once; a node where it would take over FINISH rows per set branches on first, to DEPTH
tokens at most. A leaf yields only sets that resemble one of another component, and only their texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.common import Workspace, blocks, id_bitmap, in_bitmap
from plumbline.llm.components import connected_components
from plumbline.llm.words import hash_grams, hash_words, mix, pair, split_words, starts_of

SHINGLE = 5

#: Signature coordinates, fewest trees, levels of two tokens and the largest chance of a second one below,
#: tokens on a path, chance of loss allowed for a pair at the threshold that is together in no leaf above DEPTH.
COORDINATES, TREES, TWICE, MOST_SECOND, DEPTH, MISS = 64, 4, 2, 0.75, 8, 4e-4

#: Tokens after which crowds are dealt and linked, and rows per set with which a crowd of several components is done.
CROWDED, FINISH = 4, 8

#: A leaf holds sets of this weight, or FEW sets of any size; a set weighs 1 for each WEIGHT shingles begun.
LEAF, FEW, WEIGHT = 1_000, 8, 1_000

#: Leaves look at pairs whose signatures agree in this share; at a true 0.8 less is as rare as 1e-4,
#: at 0.85 as 1e-6. Thresholds below 0.8 get a smaller share.
LEAST_AGREEMENT = 0.6

#: Sets that the parts of a crowd share.
PIVOTS = 32

_RNG = np.random.default_rng(20)
_FACTORS = _RNG.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def _agreements(similarity: float) -> np.ndarray:
    """Chance of each number of tokens in which signatures of this similarity agree."""
    return np.array([comb(COORDINATES, k) * similarity**k * (1 - similarity) ** (COORDINATES - k) for k in range(COORDINATES + 1)])


def _least(similarity: float) -> int:
    """Tokens in which a pair has to agree: LEAST_AGREEMENT, or less where that costs more than half of MISS."""
    lost = np.cumsum(_agreements(similarity))
    return min(int(np.ceil(LEAST_AGREEMENT * COORDINATES)), max(1, int(np.searchsorted(lost, MISS / 2))))


def chance_of_loss(similarity: float, trees: int, second: float, depth: int) -> float:
    """Chance that a pair shares no leaf in any tree of this depth, or agrees in too few tokens to be looked at."""
    agree = np.arange(COORDINATES + 1) / COORDINATES
    parted = np.zeros(len(agree))
    for level in range(depth, 0, -1):
        alone, p = 1 - agree * (1 - parted), 1.0 if level <= TWICE else second
        parted = (1 - p) * alone + p * alone**2
    return float((_agreements(similarity) * np.where(np.arange(len(agree)) >= _least(similarity), parted**trees, 1.0)).sum())


def forest_shape(similarity: float) -> tuple[int, float]:
    """Trees, and chance of a second token, with which a pair at the threshold is kept down to DEPTH."""
    trees = TREES
    while chance_of_loss(similarity, trees, MOST_SECOND, DEPTH) > MISS:
        trees += 1
    seconds = (hundredths / 100 for hundredths in range(101))
    return trees, next(p for p in seconds if chance_of_loss(similarity, trees, p, DEPTH) <= MISS)


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of all texts, sorted within a text, and where each text's begin.

    Words are compared with A-Z in lower case. A text of fewer words than `size` has its whole
    sequence as one shingle; a text without words has none.
    """
    words = split_words(column, lower=True)
    hashes, counts = hash_words(words), words.counts
    at, text = starts_of(words.first, size)
    found = [hash_grams(hashes, size)[at]]
    owner = [text]
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            # The number of words keeps sequences of different length apart.
            found.append(mix(hash_grams(hashes, n)[words.first[:-1][short]] + np.uint64(n)))
            owner.append(short)
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    fresh = np.ones(len(found), dtype=bool)
    fresh[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    found, owner = found[fresh], owner[fresh]
    return found, np.searchsorted(owner, np.arange(len(column) + 1))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: size of its set, two hashes of the set, and its signature."""
    for batch in batches:
        for part in blocks(batch, "text"):
            shingles, first = shingle_sets(part.column(1))
            n = np.diff(first)
            full = np.flatnonzero(n)
            one, two = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            signature = np.zeros((len(n), COORDINATES), np.uint32)
            if len(full):
                starts = first[:-1][full]
                one[full] = np.add.reduceat(mix(shingles), starts)
                two[full] = np.add.reduceat(mix(shingles ^ np.uint64(0xA0761D6478BD642F)), starts)
                for i in range(COORDINATES):
                    value = ((shingles * _FACTORS[i] + _SHIFTS[i]) >> np.uint64(32)).astype(np.uint32)
                    signature[full, i] = np.minimum.reduceat(value, starts)
            rows = signature.astype("<u4").tobytes()
            width = 4 * COORDINATES
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(2), pa.array(n.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                    pa.array([rows[i * width : (i + 1) * width] for i in range(len(n))], pa.binary()),
                ],
                names=["doc", "row", "n", "one", "two", "signature"],
            )


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4").reshape(len(column), COORDINATES)


def _children(node: np.ndarray, signature: np.ndarray, rows: np.ndarray, second_chance: float) -> tuple[np.ndarray, np.ndarray]:
    """The children to which sets (rows of `signature`) go from their nodes, and those sets."""
    draw = mix(node + np.uint64(0x1234567))
    chance = (mix(draw) >> np.uint64(40)).astype(np.float64) / (1 << 24)
    first = (draw % np.uint64(COORDINATES)).astype(np.int64)
    second = (first + 1 + ((draw >> np.uint64(32)) % np.uint64(COORDINATES - 1)).astype(np.int64)) % COORDINATES
    nodes, of = [], []
    for token, at in ((first, np.arange(len(node))), (second, np.flatnonzero(chance < second_chance))):
        value = signature[rows[at], token[at]].astype(np.uint64)
        nodes.append(pair(node[at], (token[at].astype(np.uint64) << np.uint64(32)) | value))
        of.append(rows[at])
    return np.concatenate(nodes), np.concatenate(of)


def _rows(node: np.ndarray, doc: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(doc), pa.array(weight)], names=["node", "doc", "weight"])


def _plant(trees: int):
    """Level 1: every tree's root sends the set to its children."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                doc, weight, signature = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
                for tree in range(trees):
                    root = np.full(len(doc), tree + 1, np.uint64)
                    node, of = _children(root, signature, np.arange(len(doc)), 1.0)
                    yield _rows(node, doc[of], weight[of])

    return run


def _branch(chances: list[float]):
    """Sends sets (node, signature, further columns) down as many levels as there are chances of a second token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                node, of, signature = batch.column(0).to_numpy().view(np.uint64), np.arange(batch.num_rows), _matrix(batch.column(1))
                for chance in chances:
                    node, of = _children(node, signature, of, chance)
                rest = [pa.array(c.to_numpy()[of]) for c in batch.columns[2:]]
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), *rest], names=["node", *batch.schema.names[2:]])

    return run


def _plant_forest(sets: DataFrame, trees: int, work: Workspace) -> DataFrame:
    """Rows (node, doc, weight) of level 1, from `sets` (doc, n, signature)."""
    weighed = sets.select("doc", (1 + F.floor(F.col("n") / WEIGHT)).cast("long").alias("weight"), "signature")
    return work.table(weighed.mapInArrow(_plant(trees), "node long, doc long, weight long"), "level-1")


def _sizes(rows: DataFrame, component: str) -> DataFrame:
    """Nodes of several components: sets in them, and whether they are leaves."""
    sizes = rows.groupBy("node").agg(F.count("*").alias("size"), F.sum("weight").alias("weight"), F.min(component).alias("low"), F.max(component).alias("high"))
    return sizes.filter("low <> high").select("node", "size", ((F.col("weight") <= LEAF) | (F.col("size") <= FEW)).alias("small"))


def _parted(rows: DataFrame, sizes: DataFrame, name: str, number: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Leaves (node, doc), and the rows of larger nodes with their size, from one join that is written once."""
    met = work.table(rows.join(sizes, "node"), name, number)
    return met.filter("small").select("node", "doc"), met.filter("not small").drop("small")


def _down(rows: DataFrame, number: int, sets: DataFrame, depth: int, second: float, work: Workspace, turn: str) -> tuple[DataFrame, int]:
    """Sends the rows of nodes down. One join brings the signatures, two levels at a time below the first ones."""
    chances = [1.0] if depth < TWICE else [second, second]
    large = rows.join(sets.select("doc", "signature"), "doc").select("node", "signature", *[c for c in rows.columns if c != "node"])
    depth += len(chances)
    return work.table(large.mapInArrow(_branch(chances), rows.schema), f"level-{depth}{turn}", 4 * number), depth


def _pivots() -> tuple[Column, Column]:
    """A set's place in its node, and whether it is one of about PIVOTS sets of the node."""
    place = F.pmod(F.xxhash64("doc", "node"), F.lit(1 << 30))
    return place, place < F.lit(float(PIVOTS << 30)) / F.col("size")


def _resembling(least: int):
    """Nodes in which half of the sets given, at least, agree with one of them in `least` tokens, and the share that doesn't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches):
            node, signature = batch.column(0).to_numpy(), _matrix(batch.column(1))
            found = []
            for start, stop in _bounds(node):
                part = signature[start:stop]
                share = max(((part == one).sum(axis=1) >= least).mean() for one in part)
                if share >= 0.5:
                    found.append((node[start], 1 - share))
            if found:
                nodes, others = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(others, pa.float64())], names=["node", "others"])

    return run


def _dense(crowds: DataFrame, least: int, number: int, sets: DataFrame, work: Workspace, turn: str) -> DataFrame:
    """Crowds that are dealt where they are: most of their sets resemble each other, and what does not is a few leaves.

    That is judged by the pivots; a wrong guess costs rows, but no link.
    """
    pivots = crowds.filter(_pivots()[1]).select("node", "doc").join(sets.select("doc", "signature"), "doc").select("node", "signature")
    told = pivots.repartition("node").sortWithinPartitions("node").mapInArrow(_resembling(least), "node long, others double")
    whole = crowds.groupBy("node").agg(F.sum("weight").alias("whole"))
    # Each set meets the others of its node in parts of half a LEAF, twice the number of which FINISH allows.
    few = F.col("others") * F.col("whole") <= FINISH * LEAF / 4
    return work.table(told.join(whole, "node").filter(few).select("node"), f"dense{turn}", number)


def _grow(rows: DataFrame, second: float, least: int, sets: DataFrame, work: Workspace) -> tuple[list[DataFrame], dict[int, DataFrame]]:
    """Leaves (node, doc) from level 1 to CROWDED, and by depth the rows of crowds that go no further."""
    leaves, crowded, depth = [], {}, 1
    while True:
        number = rows.count()
        sizes = work.table(_sizes(rows, "doc"), f"sizes-{depth}", number)
        met, crowds = _parted(rows, sizes, f"leaves-{depth}", number, work)
        leaves.append(met)
        if crowds.isEmpty():
            return leaves, crowded
        if depth >= CROWDED:
            return leaves, crowded | {depth: crowds}
        dense = _dense(crowds, least, number, sets, work, f"-{depth}")
        if not dense.isEmpty():
            crowded[depth] = work.table(crowds.join(dense, "node", "left_semi"), f"crowds-{depth}", number)
            crowds = crowds.join(dense, "node", "left_anti")
            if crowds.isEmpty():
                return leaves, crowded
        rows, depth = _down(crowds.drop("size"), number, sets, depth, second, work, "")


def _finish(crowded: dict[int, DataFrame], second: float, sets: DataFrame, work: Workspace) -> list[DataFrame]:
    """Leaves (node, doc) in which all pairs of different components of the rows (node, doc, weight, component) meet.

    The rows of crowds are given by depth; those that branch meet the ones of the depth they come to.
    """
    leaves, later, depth = [], dict(crowded), min(crowded)
    rows = later.pop(depth)
    while True:
        number = rows.count()
        sizes = work.table(_sizes(rows, "component"), f"mixed-{depth}", number)
        few, crowds = _parted(rows, sizes, f"crowd-{depth}", number, work)
        leaves.append(few)
        crowds = crowds.drop("size")
        if not crowds.isEmpty():
            met, now = _pairs_of_parts(crowds, number, work, f"-{depth}", FINISH if depth < DEPTH else None)
            leaves.append(met)
            crowds = crowds.join(now, "node", "left_anti")
        if not crowds.isEmpty() and depth < DEPTH:
            rows, depth = _down(crowds, number, sets, depth, second, work, "-mixed")
            rows = rows.unionByName(later.pop(depth)) if depth in later else rows
        elif later:
            depth = min(later)
            rows = later.pop(depth)
        else:
            return leaves


def _deal(rows: DataFrame) -> DataFrame:
    """Parts of crowded nodes, each with the node's PIVOTS sets of lowest hash in about all of it."""
    place, pivot = _pivots()
    parts = F.ceil(F.col("size") / (LEAF - PIVOTS)).cast("int")
    part = F.when(pivot, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(place, parts)))
    return rows.select(F.explode(part).alias("part"), "node", "doc").select(F.xxhash64("node", "part").alias("node"), "doc")


def _pairs_of_parts(rows: DataFrame, number: int, work: Workspace, turn: str, most: int | None) -> tuple[DataFrame, DataFrame]:
    """Leaves (node, doc) in which any two sets of a node meet, unless they are of one component.

    Components of more than half a LEAF have parts of their own, which need not meet each other; the
    others are dealt into common parts. Nodes that would take more than `most` rows per set are left
    out, unless it is None; the nodes that are not are returned as well.
    """
    half = max(LEAF // 2, 1)
    counts = rows.groupBy("node", "component").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))
    own = F.col("weight") > half
    counts = counts.select("node", "component", "weight", "n", own.alias("own"), F.when(own, F.col("component")).otherwise(F.lit(0)).alias("slot"))
    counts = work.table(counts, f"counts{turn}", number)
    slots = counts.groupBy("node", "own", "slot").agg(F.ceil(F.sum("weight") / half).cast("int").alias("parts"), F.sum("n").alias("n"))
    slots = work.table(slots, f"slots{turn}", number)
    # A set is copied once for every part that its own part meets.
    whole = slots.groupBy("node").agg(F.sum("parts").alias("all"), F.sum("n").alias("size"))
    own_parts = F.when(F.col("own"), F.col("parts")).otherwise(0)
    copies = slots.join(whole, "node").groupBy("node", "size").agg(F.sum(F.col("n") * (F.col("all") - own_parts)).alias("copies"))
    now = copies if most is None else copies.filter(F.col("copies") <= most * F.col("size"))
    now = work.table(now.select("node"), f"now{turn}", number)
    slots = slots.join(now, "node")
    placed = rows.select("node", "doc", "component").join(counts.select("node", "component", "own", "slot"), ["node", "component"])
    placed = placed.join(slots, ["node", "own", "slot"])
    placed = placed.select("node", "doc", F.xxhash64("own", "slot", F.pmod(F.xxhash64("doc"), "parts").cast("int")).alias("part"))
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p")
    parts = slots.select("node", "own", "slot", part).select("node", "own", "slot", F.xxhash64("own", "slot", "p").alias("part"))
    parts = work.table(parts, f"parts{turn}")
    other = parts.select("node", *[F.col(c).alias(f"{c}_2") for c in ("own", "slot", "part")])
    pairs = parts.join(other, "node").filter("part <= part_2 and not (own and own_2 and slot = slot_2)")
    pairs = pairs.select("node", F.array_distinct(F.array("part", "part_2")).alias("both"), F.xxhash64("node", "part", "part_2").alias("leaf"))
    met = work.table(pairs.select("node", F.explode("both").alias("part"), "leaf"), f"met{turn}")
    return work.table(placed.join(met, ["node", "part"]).select(F.col("leaf").alias("node"), "doc"), f"pairs{turn}"), now


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut and joined so that each holds whole groups of the first column, sorted before."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        if last or (held and held[-1].column(0)[-1].as_py() != key[0]):
            if held and held[-1].column(0)[-1].as_py() != key[0]:
                yield _stack(held)
                held = []
            if last:
                yield _stack([*held, batch.slice(0, last)])
                held = []
        held.append(batch.slice(last))
    if held:
        yield _stack(held)


def _stack(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _bounds(key: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return list(zip(cuts.tolist(), np.append(cuts[1:], len(key)).tolist()))


def _alike(least: int):
    """Groups of the sets of a leaf that agree in `least` tokens with a set of another component, over one or several of these.

    A group is named by its members, so that trees which find the same group name it alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches):
            docs, signature, component = batch.column(1).to_numpy(), _matrix(batch.column(2)), batch.column(3).to_numpy()
            names, members = [], []
            for start, stop in _bounds(batch.column(0).to_numpy()):
                for group in _clusters(signature[start:stop], component[start:stop], least):
                    inside = docs[start:stop][group]
                    name = np.add.reduce(mix(inside.view(np.uint64))) + np.uint64(len(inside))
                    names.append(np.full(len(inside), name, np.uint64))
                    members.append(start + group)
            if names:
                at = pa.array(np.concatenate(members))
                rest = [c.take(at) for c in batch.columns[3:]]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names).view(np.int64)), *rest], names=["group", *batch.schema.names[3:]])

    return run


def _clusters(signature: np.ndarray, component: np.ndarray, least: int) -> list[np.ndarray]:
    left, out = np.arange(len(signature)), []
    while len(left):
        member, edge, left = [left[:1]], left[:1], left[1:]
        while len(edge) and len(left):
            agree = np.zeros(len(left), dtype=bool)
            for at in edge:
                open_ = np.flatnonzero(~agree & (component[left] != component[at]))
                agree[open_[(signature[left[open_]] == signature[at]).sum(axis=1) >= least]] = True
            edge, left = left[agree], left[~agree]
            member.append(edge)
        if len(member) > 1 and len(member[1]):
            out.append(np.concatenate(member))
    return out


def _links(threshold: tuple[int, int]):
    """Links between the components of a group on full sets: enough of them to connect whatever is similar within it."""
    above, of = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches):
            for start, stop in _bounds(batch.column(0).to_numpy()):
                part = batch.slice(start, stop - start)
                # Small components go first: once they have met the rest, a large one has nothing left to meet.
                _, root, sizes = np.unique(part.column(1).to_numpy(), return_inverse=True, return_counts=True)
                order = np.lexsort((root, sizes[root]))
                part, root = part.take(pa.array(order)), root[order]
                docs = part.column(1).to_numpy()
                shingles, first = shingle_sets(part.column(2))
                values, code = np.unique(shingles, return_inverse=True)
                sizes, owner = np.diff(first), np.repeat(np.arange(len(docs)), np.diff(first))
                a, b = [], []
                marked = np.zeros(len(values), dtype=bool)
                for i in range(len(docs) - 1):
                    # Sets already connected with this one need no comparison.
                    if (root[i + 1 :] == root[i]).all():
                        continue
                    own = code[first[i] : first[i + 1]]
                    marked[own] = True
                    common = np.bincount(owner[first[i + 1] :][marked[code[first[i + 1] :]]], minlength=len(docs))
                    marked[own] = False
                    near = np.flatnonzero((of * common >= above * (sizes + sizes[i] - common)) & (np.arange(len(docs)) > i))
                    for j in near[root[near] != root[i]]:
                        if root[j] != root[i]:
                            root[root == root[j]] = root[i]
                            a.append(docs[i])
                            b.append(docs[j])
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: tuple[int, int] = (85, 100)
) -> DataFrame:
    """Per row of `docs`: key, text_hash (xxhash64), n_shingles, component_id and kept.

    Two sets are linked if of * common >= above * union, for threshold (above, of), on full sets.
    component_id is the smallest id reachable over links; kept says whether that is the row's own.
    Texts that are missing or without words have an empty set, are linked with nothing and are their
    own component. Rows that repeat an id are judged each by its own text. Rows without an id take no
    part: no component, kept. An empty table gives none. Other columns are not read.
    """
    work = Workspace(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    hashed = rows.select("doc", "text", F.xxhash64("text").alias("row"))
    told = work.table(hashed.mapInArrow(_describe, "doc long, row long, n long, one long, two long, signature binary"), "told")
    # One set per class: the row of smallest id, as it comes out of the map-side aggregation.
    first = F.min(F.struct("doc", "row", "signature")).alias("first")
    classes = told.filter("n > 0 and doc is not null").groupBy("n", "one", "two").agg(first)
    number = told.count()
    classes = work.table(classes.select("n", "one", "two", F.col("first.doc").alias("rep"), "first.row", "first.signature"), "classes", 2 * number)
    # Where an id is repeated, it may stand for several sets; these are named by a hash instead.
    several = classes.groupBy("rep").agg(F.count("*").alias("k")).filter("k > 1").select("rep", F.lit(True).alias("several"))
    several = work.table(several, "several", number)
    named = F.when(F.col("several"), F.xxhash64("rep", "n", "one", "two")).otherwise(F.col("rep"))
    sets = classes.join(several, "rep", "left").select("n", "one", "two", F.col("rep").alias("doc"), named.alias("set"), "row", "signature")
    # From here on the signatures of classes suffice.
    rows = work.table(told.drop("signature"), "rows")
    work.drop("told")

    signed = sets.select(F.col("set").alias("doc"), "n", "signature", F.col("doc").alias("id"), "row")
    similarity = threshold[0] / threshold[1]
    (trees, second), least = forest_shape(similarity), _least(similarity)

    def link(leaves: list[DataFrame], component: DataFrame | None, turn: str) -> DataFrame:
        """Links (a, b) among components (doc, component) of sets that share a leaf; without them each set is its own."""
        met = reduce(DataFrame.unionByName, leaves).withColumnRenamed("node", "leaf").join(signed.drop("n"), "doc")
        own = F.col("doc").alias("component")
        if component is not None:
            met, own = met.join(component, "doc", "left"), F.coalesce("component", "doc").alias("component")
        met = met.select("leaf", "doc", "signature", own, "id", "row")
        groups = met.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(_alike(least), "group long, component long, id long, row long")
        # A row with its signature counts for several of a plain table, one with its text for more.
        groups = work.table(groups.distinct(), f"groups{turn}", 5 * sum(leaf.count() for leaf in leaves))
        # Only the texts of sets in groups are shuffled, each once.
        texts = in_bitmap(hashed.filter("doc is not null"), "doc", id_bitmap(groups, "id"))
        texts = texts.groupBy(F.col("doc").alias("id"), "row").agg(F.first("text").alias("text"))
        full = groups.join(texts, ["id", "row"]).select("group", "component", "text")
        found = full.repartition("group").sortWithinPartitions("group").mapInArrow(_links(threshold), "a long, b long")
        found = work.table(found, f"links{turn}", 10 * groups.count())
        work.drop(f"groups{turn}")
        return found

    leaves, crowded = _grow(_plant_forest(signed, trees, work), second, least, signed, work)
    if crowded:
        leaves.append(work.table(_deal(reduce(DataFrame.unionByName, crowded.values())), "dealt"))
    links = link(leaves, None, "")
    roots = connected_components(links, work)
    if crowded:
        # Crowds of one component are done; in the others every pair of components gets its chance.
        component = roots.select(F.col("vertex").alias("doc"), F.col("root").alias("component"))
        for depth, crowds in crowded.items():
            known = crowds.drop("size").join(component, "doc", "left").select("node", "doc", "weight", F.coalesce("component", "doc").alias("component"))
            crowded[depth] = work.table(known, f"known-{depth}")
        more = link(_finish(crowded, second, signed, work), component, "-2")
        if not more.isEmpty():
            # Components of components.
            joined = connected_components(more, work, "connected").select(F.col("vertex").alias("root"), F.col("root").alias("lower"))
            single = joined.join(roots.select(F.col("vertex").alias("root")), "root", "left_anti").select(F.col("root").alias("vertex"), F.col("lower").alias("root"))
            roots = roots.join(joined, "root", "left").select("vertex", F.coalesce("lower", "root").alias("root")).unionByName(single)
    levels = [f"{name}-{depth}" for name in ("level", "sizes", "leaves", "dense", "crowds", "known", "mixed", "crowd", "counts", "slots", "now", "parts", "met", "pairs") for depth in range(1, DEPTH + 3)]
    work.drop("dealt", *levels, *[f"level-{depth}-mixed" for depth in range(DEPTH + 3)])

    # Components are named by the smallest id of their sets.
    roots = work.table(roots.join(sets.select(F.col("set").alias("vertex"), "doc"), "vertex"), "roots")
    number = roots.count()
    lowest = work.table(roots.groupBy("root").agg(F.min("doc").alias("low")), "lowest", number)
    linked = work.table(roots.join(lowest, "root").select(F.col("vertex").alias("set"), "low"), "linked", number)
    final = sets.drop("signature").join(linked, "set", "left").select("n", "one", "two", F.coalesce("low", "doc").alias("low"))
    final = work.table(final, "final")
    out = rows.join(final, ["n", "one", "two"], "left")
    work.drop("classes", "several", "links", "links-2", "roots", "lowest", "linked")
    component = F.when(F.col("doc").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("low")), F.col("doc")))
    return out.select(
        F.col("doc").alias(key), F.col("row").alias("text_hash"), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"),
    )
