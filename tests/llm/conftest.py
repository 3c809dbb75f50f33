import random

import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, shard string, mix string, contamination string, kept string, doc bigint, row string"


def words(n: int, seed: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def edge_texts() -> list[str | None]:
    base, other = words(300, 1), words(120, 2)
    changed = base.split()
    changed[150] = "other"
    moved = words(40, 3) + " " + " ".join(base.split()[100:180]) + " " + words(30, 4)
    return [
        None, "", " \n\t ", "a", "A", "one two three four", "ONE two three four", base, base, base.upper(), " ".join(changed), moved,
        other, other + "\n", "\x0b".join(other.split()), "the " * 200, "the " * 230, "x" * 700, "é" * 90 + " ñ ß", "Ünï çødé ♥ 日本語",
        words(60, 5) + " " + words(60, 5), words(49, 6), words(50, 7), words(50, 7) + " more", words(20_000, 8, 5_000),
        words(20_000, 8, 5_000) + " tail", " nbsp em", "!!! ### $$$", base, None,
    ]


@pytest.fixture(scope="session")
def edge_dir(spark, tmp_path_factory):
    """All tables, with hard cases among the documents; ids are distinct."""
    texts = edge_texts()
    rows = [
        (i, t, ["en", "de", None, "fr"][i % 4] if i else None, [None, "a", "é", "b"][i % 4], None if t is None else len(t), "s", "x", "m", "c", "k", 1, "r")
        for i, t in enumerate(texts)
    ]
    return write(spark, tmp_path_factory.mktemp("edge"), rows)


@pytest.fixture(scope="session")
def odd_dir(spark, tmp_path_factory):
    """As `edge_dir`, with missing and repeated ids and repeated rows."""
    texts = edge_texts()
    rows = [(i, t, "en", "a", None, "s", "x", "m", "c", "k", 1, "r") for i, t in enumerate(texts)]
    rows += [(None, texts[7], None, None, None, *[None] * 7)] * 2 + [(7, texts[7], "en", "a", None, "s", "x", "m", "c", "k", 1, "r")] * 3
    rows += [(7, texts[12], "en", "a", None, "s", "x", "m", "c", "k", 1, "r"), (None, None, None, None, None, *[None] * 7)]
    return write(spark, tmp_path_factory.mktemp("odd"), rows)


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [], filled=False)


def write(spark, folder, rows, filled: bool = True) -> str:
    path = str(folder)
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, i % 2, 0) for i in range(0, 30)] + [(3, None, 1), (None, 1, 0), (4, 0, 0), (4, 1, 0), (99, 1, 1)]
    vectors = [(i, [float((i * 7 + j * 3) % 11 - 5) / 4 for j in range(6)], 0) for i in range(120)]
    vectors += [(200, None, 0), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (202, [float("nan")] * 6, 1), (203, [float("inf")] * 6, 1), (204, [], 0), (None, [1.0] * 6, 0)]
    items = [(1, "What is the " + words(30, 1) + ". The answer is here."), (2, None), (3, ""), (None, "x y z"), (4, words(50, 7)), (4, words(50, 7))]
    spark.createDataFrame(labels if filled else [], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(vectors if filled else [], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame(items if filled else [], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path
