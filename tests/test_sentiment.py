"""Polarity with negation and intensity against a plain reading."""

import re

import pytest

from plumbline.operators import sentiment as S

LEXICON = {"good": 0.7, "bad": -0.7, "great": 0.8, "awful": -1.0}

TEXTS = [
    "This is good.", "This is not good.", "Not at all good", "not a b c good", "Not now, good day", "never very good!", "It isn’t bad; really great",
    "extremely extremely awful", "", None, "nothing here", "GOOD bad\ngood", "don't good", "great", "barely good, too bad",
]


def plain(text):
    tokens = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)*|[.,;:!?\n]", (text or "").lower().replace("’", "'"))
    values = []
    for i, t in enumerate(tokens):
        if t in LEXICON:
            factor = 1.0
            for w in reversed(tokens[max(0, i - S.REACH) : i]):
                if re.fullmatch(r"[.,;:!?\n]", w):
                    break
                factor *= S.MODIFIERS.get(w, 1.0)
            values.append(max(-1.0, min(1.0, LEXICON[t] * factor)))
    return (sum(values) / len(values) if values else 0.0), len(values)


def test_negation_and_intensity(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    lexicon = spark.createDataFrame(list(LEXICON.items()), "word string, polarity double")
    got = {r["id"]: (r["polarity"], r["hits"]) for r in S.polarity_in_context(df, "t", "id", lexicon).collect()}
    for i, t in enumerate(TEXTS):
        want = plain(t)
        assert got[i] == (pytest.approx(want[0]), want[1]), t
    assert got[1][0] == pytest.approx(-0.35) and got[3][0] == 0.7 and got[4][0] == 0.7


def test_many_texts_of_one_key_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "good")] * 50 + [(1, "not good"), (None, "bad")], "id int, t string")
    lexicon = spark.createDataFrame([("good", 0.7), ("bad", -0.7), ("good", 0.9)], "word string, polarity double")
    got = {r["id"]: (round(r["polarity"], 6), r["hits"]) for r in S.polarity_in_context(df, "t", "id", lexicon).collect()}
    assert got == {1: (round((50 * 0.7 - 0.35) / 51, 6), 51), None: (-0.7, 1)}
    assert S.polarity_in_context(df.limit(0), "t", "id", lexicon).collect() == []
    assert {r["hits"] for r in S.polarity_in_context(df, "t", "id", lexicon.limit(0)).collect()} == {0}
