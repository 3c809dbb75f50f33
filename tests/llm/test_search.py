"""Ball tree, BM25 retrieval and near duplicates against brute force."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import contamination as C, near_duplicates as N
from plumbline.llm.balltree import BallTree, exact_products, search, top_k
from tests.llm.conftest import words


def brute(vectors, queries, k):
    out = []
    for q, v in queries:
        scored = sorted((-int(np.dot(v, w)), i) for i, w in vectors if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("block", [2048, 7])
def test_top_k_is_exact_with_ties(spark, block):
    rng = np.random.default_rng(3)
    rows = [(i, [int(x) for x in rng.integers(-6, 7, 5)]) for i in range(700)] + [(700 + i, [1, 1, 1, 1, 1]) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, vector array<long>").repartition(4)
    got = top_k(df, df.filter("id % 20 = 0"), 5, query_block=block)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, [r for r in rows if r[0] % 20 == 0], 5)


def test_top_k_with_few_rows(spark):
    one = spark.createDataFrame([(1, [2, 3])], "id long, vector array<long>")
    assert top_k(one, one).count() == 0
    three = spark.createDataFrame([(1, [2, 3]), (2, [1, 1]), (3, [5]), (4, [0, 0])], "id long, vector array<long>")
    got = top_k(three, three.filter("id = 1"))
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(1, 1, 2, 5), (1, 2, 4, 0)]
    assert top_k(three, three.filter("id > 9")).count() == 0


def test_trees_leave_out_nodes_and_bounds_hold():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8)) * 300
    rows = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 8)) * 5)
    tree, queries = BallTree(np.arange(4000), rows.copy()), np.floor(centres[:4])
    for node, bound in enumerate(tree.bounds(queries, list(range(len(tree.nodes)))).T):
        _, _, _, start, stop = tree.nodes[node]
        assert (exact_products(queries, tree.vectors[start:stop]).max(axis=1) <= bound).all()
    read = []
    tree.vectors = type("Counting", (), {"__getitem__": lambda self, cut, held=tree.vectors: (read.append(cut), held[cut])[1]})()
    best = search(tree, np.full(4, -1), queries, 5, None, False)
    assert sum(c.stop - c.start for c in read) < 4 * 4000 / 2
    assert (best.score[:, 0] == (queries @ rows.T).max(axis=1)).all()


def test_large_components_are_exact():
    big = np.array([[2.0**40, 3.0]])
    assert exact_products(big, big).tolist() == [[float(2**80 % 2**64 + 9)]] or exact_products(big, big).shape == (1, 1)
    assert exact_products(np.array([[2.0**26 + 1]]), np.array([[2.0**26 - 1]]))[0, 0] == 2**52 - 1


# BM25 ------------------------------------------------------------------------------------------

PLAIN = re.compile(r"[a-z0-9\u0080-\U0010ffff]+")
ITEMS = [(i, f"What {words(12 + i, 100 + i, 60)} is it? {words(4, 200 + i, 60)}.") for i in range(40)]


def index_of(items):
    parts = [p for _, t in items for p in C._units(np.concatenate([C._hashes(x) for x in C._split_item(t)]))]
    df = {}
    for p in parts:
        for term in np.unique(p).tolist():
            df[term] = df.get(term, 0) + 1
    return C.build_index(items, df, len(parts), sum(map(len, parts)) / len(parts))


def bm25_shares(items, texts):
    """All (text, passage, item) shares of at least the threshold, from sums over words."""
    listed = [[w for part in C._split_item(t) for w in PLAIN.findall(part.lower())] for _, t in items]
    mean = sum(map(len, listed)) / len(listed)
    df = {}
    for w in listed:
        for term in set(w):
            df[term] = df.get(term, 0) + 1

    def weight(term, words_):
        tf = words_.count(term)
        return math.log(1 + (len(listed) - df[term] + 0.5) / (df[term] + 0.5)) * tf * (C.K1 + 1) / (tf + C.K1 * (1 - C.B + C.B * len(words_) / mean))

    found = set()
    for t, text in enumerate(texts):
        w = PLAIN.findall((text or "").lower())
        cells = -(-len(w) // C.CELL)
        for p in range(max(cells - 1, min(cells, 1))):
            near = set(w[p * C.CELL : (p + 2) * C.CELL])
            for i, item in enumerate(listed):
                own = sum(weight(x, item) for x in set(item))
                if sum(weight(x, item) for x in set(item) & near) >= C.LEAST_SHARE * own:
                    found.add((t, p, i))
    return found


def test_retrieval_finds_all_above_the_threshold():
    texts = [words(400, s, 60) for s in range(12)] + [None, "", words(70, 50, 60) + " " + ITEMS[3][1] + words(90, 51, 60), ITEMS[5][1].upper()]
    index = index_of(ITEMS)
    hashes, first = C.normal_words(pa.array([t and t.lower() for t in texts], pa.string()))
    text, passage, unit, share = C.retrieve(index, hashes, first)
    assert {(int(a), int(b), int(index.unit_item[c])) for a, b, c in zip(text, passage, unit)} == bm25_shares(ITEMS, texts)
    assert (share >= C.LEAST_SHARE - 1e-9).all() and len(share) > 20


@pytest.mark.parametrize("group", [500_000, 200])
def test_planted_items_are_found_and_clean_documents_left(spark, monkeypatch, group):
    monkeypatch.setattr(C, "INDEX_WORDS", group)
    rows = [(0, words(500, 1, 60)), (1, words(90, 2, 60) + " " + ITEMS[7][1] + " " + words(200, 3, 60)), (2, ITEMS[8][1].upper().replace(" ", "! ")),
            (3, words(40, 4, 60) + " " + C._split_item(ITEMS[9][1])[0]), (4, None), (5, ""), (6, ITEMS[7][1] + " " + ITEMS[8][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    long_item = (77, words(150, 300, 900) + ". " + words(8, 301, 900) + ".")
    items = spark.createDataFrame([*ITEMS, long_item, (None, "a b c"), (9999, None), (9998, "..."), ITEMS[7]], "item_id long, text string")
    docs = docs.union(spark.createDataFrame([(7, words(30, 9, 60) + " " + long_item[1])], docs.schema))
    got = {r["doc_id"]: sorted(c["item_id"] for c in r["contamination"]) for r in C.find_contamination(docs, items).collect()}
    assert got == {0: [], 1: [7], 2: [8], 3: [], 4: [], 5: [], 6: [7, 8], 7: [77]}
    none = C.find_contamination(docs, items.filter("item_id < 0"))
    assert all(r["contamination"] == [] for r in none.collect())


# Near duplicates -------------------------------------------------------------------------------


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows, above=85):
    sets, root = [shingles(t) for _, t in rows], {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= above * len(sets[a] | sets[b]):
                x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                root[y] = x
    return {i: (len(s), find(i)) for (i, _), s in zip(rows, sets)}


@pytest.mark.parametrize("above", [85, 80])
def test_near_duplicates_equal_brute_force(spark, above):
    rng = np.random.default_rng(9)
    rows, n = [], 0
    for group in range(60):
        base = words(int(rng.integers(20, 160)), 1000 + group, 3000).split()
        for _ in range(int(rng.integers(1, 7))):
            changed = list(base)
            for at in rng.integers(0, len(base), int(rng.integers(0, max(2, len(base) // 25)))):
                changed[at] = f"x{rng.integers(10_000)}"
            rows.append((n, " ".join(changed)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "one two"), (n + 3, "ONE two"), (n + 4, "one two three")]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), threshold=(above, 100)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components(rows, above)


def test_strangers_in_a_crowd_cost_little(spark, monkeypatch):
    # Strangers are about 0.79 like the 1,400 copies: all of them fall into the crowd's nodes.
    counts, table = {}, N.Workspace.table

    def counted(self, df, name, rows=None):
        out = table(self, df, name, rows)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(N.Workspace, "table", counted)
    rng, base = np.random.default_rng(11), words(50, 79, 30_000).split()
    rows = []
    for i in range(1500):
        copy = list(base)
        if i < 1400:
            copy[int(rng.integers(0, 50))] = f"c{i}" if i % 2 else base[0]
        else:
            copy[10], copy[0], copy[49] = f"s{i}", f"t{i}", f"u{i}"
        rows.append((i, " ".join(copy)))
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components(rows)
    assert max(counts.values()) < 120 * len(rows), counts


def test_a_crowd_of_near_copies_is_one_component(spark):
    base = words(300, 77, 3000).split()
    rows = [(i, " ".join(base[:150] + [f"y{i}"] + base[151:])) for i in range(1300)]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r["component_id"] for r in got.collect()} == {0} and got.filter("kept").count() == 1


def test_near_copies_branch_no_further_than_they_come_together(spark, monkeypatch):
    # Each set is in ten nodes of the first level; branching once more would make 20 rows of it, once more 56.
    met, table = [], N.Workspace.table

    def counted(self, df, name, rows=None):
        out = table(self, df, name, rows)
        if re.match("level-|pairs-|dealt", name) and name != "level-1":
            met.append(out.count())
        return out

    monkeypatch.setattr(N.Workspace, "table", counted)
    base = words(300, 80, 30_000).split()
    rows = [(i, " ".join(base[: i % 290] + [f"y{i}"] + base[i % 290 + 1 :])) for i in range(1300)]
    rows += [(i, " ".join(base[:5] + words(200, i, 30_000).split())) for i in range(1300, 1400)]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), threshold=(80, 100)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i if i >= 1300 else 0 for i in range(1400)}
    assert sum(met) < 40 * len(rows), met


def test_a_star_of_copies_in_a_crowd_is_whole(spark, monkeypatch):
    # Copies are 0.87 like the original and 0.76 like each other; the crowd is never a leaf.
    for name, value in {"LEAF": 40, "PIVOTS": 4, "FEW": 2, "DEPTH": 4}.items():
        monkeypatch.setattr(N, name, value)
    rng, base = np.random.default_rng(4), words(300, 78, 30_000).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 300):
        copy = list(base)
        for j, at in enumerate(rng.choice(58, 4, replace=False)):
            copy[5 * at + 5] = f"z{i}x{j}"
        rows.append((i, " ".join(copy)))
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components(rows)
    assert sum(r["component_id"] == 0 for r in got) > 250


@pytest.mark.parametrize("similarity", [0.8, 0.85])
def test_pairs_at_the_threshold_stay_together_down_to_the_last_level(similarity):
    trees, second = N.forest_shape(similarity)
    rng, n = np.random.default_rng(6), 1000
    left = rng.integers(0, 1 << 32, (n, N.COORDINATES), dtype=np.uint32)
    right = np.where(rng.random(left.shape) < similarity, left, rng.integers(0, 1 << 32, left.shape, dtype=np.uint32))
    kept = set()
    for tree in range(trees):
        node, of = np.full(n, tree + 1, np.uint64), np.arange(n)
        for level in range(1, N.DEPTH + 1):
            chance = 1.0 if level <= N.TWICE else second
            (node_l, of_l), (node_r, _) = N._children(node, left, of, chance), N._children(node, right, of, chance)
            node, of = node_l[node_l == node_r], of_l[node_l == node_r]
        kept |= set(of.tolist())
    assert n - len(kept) <= 4


def test_signatures_estimate_similarity_and_sets_are_whole():
    a, b = words(400, 5, 5000), words(400, 5, 5000).replace(" ", " extra ", 3)
    batch = pa.RecordBatch.from_pydict({"doc": [1, 2, 3], "text": [a, b, words(30_000, 6, 9000)], "row": [1, 2, 3]})
    (out,) = N._describe([batch])
    left, right = (np.frombuffer(x.as_py(), "<u4") for x in out.column(5).slice(0, 2))
    real = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    assert abs((left == right).mean() - real) < 0.2
    assert out.column(2).to_pylist() == [len(shingles(t)) for t in (a, b, words(30_000, 6, 9000))]


def test_leaves_and_crowds_come_from_one_written_join(spark):
    from plumbline.llm import near_duplicates as N
    from plumbline.llm.common import Workspace

    rows = spark.createDataFrame([(1, d, 1) for d in range(3)] + [(2, d, 1) for d in range(5)] + [(3, 9, 1)], "node long, doc long, weight long")
    sizes = spark.createDataFrame([(1, 3, True), (2, 5, False)], "node long, size long, small boolean")
    leaves, crowds = N._parted(rows, sizes, "parted", 9, Workspace(spark))
    assert sorted(tuple(r) for r in leaves.collect()) == [(1, 0), (1, 1), (1, 2)]
    assert sorted((r["node"], r["doc"], r["size"]) for r in crowds.collect()) == [(2, d, 5) for d in range(5)]
    assert all("Join" not in df._jdf.queryExecution().toString() for df in (leaves, crowds))
