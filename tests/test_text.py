import string

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import corpus


def apply(spark, fn, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("t"))).collect()]


TEXTS = ["", "  ", "\ta b c\n", "o'neil mc-donald 3rd", "café №5!", "Émile  zola\r\nx", None]


def test_strip_and_words(spark):
    assert apply(spark, X.strip, TEXTS) == [None if t is None else t.strip() for t in TEXTS]
    assert apply(spark, X.words, TEXTS) == [None if t is None else t.split() for t in TEXTS]
    assert apply(spark, X.word_count, TEXTS) == [None if t is None else len(t.split()) for t in TEXTS]


def test_title_case_follows_letters(spark):
    values = [t for t in TEXTS if t is not None]
    assert apply(spark, X.title_case, values) == [t.title() for t in values]


def test_basic_clean_keeps_letters_of_all_scripts(spark):
    assert apply(spark, X.basic_clean, ["  a \n b#c ", "café №5!", "x_y - z?", None]) == ["a bc", "café 5!", "x_y - z?", None]


def test_tokens(spark):
    got = apply(spark, X.tokens, ["The 3 cats, and the dog's tail... it IS " + string.punctuation, ""])
    assert got == [["cats", "dogs", "tail"], []]


def test_key_finding(spark):
    long = "x" * 101
    got = apply(spark, X.key_finding, ["One. Two. Three", "", None, long, "y" * 100])
    assert got == ["One", "No key finding", "No key finding", "x" * 100 + "...", "y" * 100]


def test_key_values_last_wins(spark):
    text = "Action Input: x=0 Action Input: A = 1; b=2\n noise; a =3=4;c="
    got = apply(spark, X.key_values, [text, "no pairs", ""])
    assert [[tuple(p) for p in g] for g in got] == [[("b", "2"), ("a", "3=4"), ("c", "")], [], []]


def test_listed_questions(spark):
    numbered = "Sure:\n1. What is the mean of x?\n2. Why so?\n3. What is the mean of x?"
    marked = "- Which group is the largest?\n• Is it stable over time?"
    plain = "nothing here\nplease tell what changed"
    first, second, third, none = apply(spark, lambda c: X.listed_questions(c, 5), [numbered, marked, plain, "short"])
    assert first[0] == "What is the mean of x?" and len(first) == len(set(first))
    assert "Which group is the largest?" in second and "Is it stable over time?" in second
    assert third == ["please tell what changed?"] and none == []


def test_polarity_and_language(spark):
    assert apply(spark, X.polarity, ["good good bad", "nothing", ""]) == pytest.approx([0.7 / 3, 0, 0])
    got = apply(spark, X.language_vote, ["the cat and the dog", "der Hund und die Katze", "le chat et les rats", "zzz"])
    assert got == ["en", "de", "fr", "unknown"]


@pytest.mark.parametrize("length", [0, 1, 999, 1000, 1001, 2500])
def test_fixed_chunks_join_to_the_text(spark, length):
    text = ("abcdé fghi" * 300)[:length]
    rows = corpus.chunks_fixed(spark.createDataFrame([(1, text)], "id int, t string"), "t").orderBy("chunk").collect()
    assert "".join(r["content"] for r in rows) == text
    assert all(r["length"] <= 1000 for r in rows)


def test_blank_chunks_drop_out(spark):
    df = spark.createDataFrame([(1, " " * 1500), (2, None), (3, "a" + " " * 1500)], "id int, t string")
    assert [r["id"] for r in corpus.chunks_fixed(df, "t").collect()] == [3]


def test_recursive_chunks_overlap_and_cover():
    text = "\n\n".join(" ".join(f"word{i}x{j}" for j in range(40)) for i in range(30))
    pieces = corpus.split_recursive(text, 300, 60)
    assert all(0 < len(p) <= 300 for p in pieces)
    assert {w for p in pieces for w in p.split()} == set(text.split())
    assert any(a.split()[-1] in b.split()[:12] for a, b in zip(pieces, pieces[1:]))
    assert corpus.split_recursive("x" * 700, 300, 60)[0] == "x" * 300


def test_recursive_chunks_are_parts_of_their_text():
    for text in ("a  b   c", "x\n\n\n\ny", "  lead " + "w" * 50 + "\n\n" + "one two  three\nfour " * 20, "", " \n "):
        spans = corpus.split_spans(text, 30, 8)
        assert all(0 < b - a <= 30 and text[a:b] == text[a:b].strip() for a, b in spans)
        assert spans == sorted(spans)
        inside = {i for a, b in spans for i in range(a, b)}
        assert inside >= {i for i, c in enumerate(text) if not c.isspace()}
    assert corpus.split_recursive("a  b   c", 30, 8) == ["a  b   c"]


def test_recursive_chunks_as_rows(spark):
    df = spark.createDataFrame([(1, "a b " * 400), (2, ""), (3, None)], "id int, t string")
    rows = corpus.chunks_recursive(df, "t", 100, 20).collect()
    assert {r["id"] for r in rows} == {1} and max(r["length"] for r in rows) <= 100


def test_text_profile_of_nothing_is_zero(spark):
    empty = spark.createDataFrame([("",)], "t string")
    assert list(corpus.text_profile(empty, "t").first()) == [0, 0, 0, 0]


def test_lemmas_of_rows_that_share_a_key(spark):
    from plumbline.operators import corpus

    rows = spark.createDataFrame([(1, "running fast running"), (1, "slow walking"), (2, "nothing here"), (3, None)], "doc_id int, text string")
    lemmas = spark.createDataFrame([("running", "run"), ("walking", "walk"), ("unseen", "none")], "form string, lemma string")
    got = corpus.normalize_text(rows, "text", "doc_id", lemmas).collect()
    assert sorted((r["doc_id"], r["tokens"] or []) for r in got) == [(1, ["run", "fast", "run"]), (1, ["slow", "walk"]), (2, ["nothing", "here"]), (3, [])]
