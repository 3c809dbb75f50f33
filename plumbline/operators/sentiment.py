"""Polarity of texts from a lexicon table, with the words before each hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.columns import col
from plumbline.operators.joins import salted_join

#: Words before a hit that bear on it, within its clause.
REACH = 3

# What a word before a hit does to its polarity; negations turn and weaken it.
MODIFIERS = {
    "not": -0.5, "no": -0.5, "never": -0.5, "neither": -0.5, "nor": -0.5, "without": -0.5, "hardly": -0.5, "cannot": -0.5,
    "don't": -0.5, "doesn't": -0.5, "didn't": -0.5, "isn't": -0.5, "wasn't": -0.5, "aren't": -0.5, "won't": -0.5, "can't": -0.5,
    "very": 1.3, "really": 1.3, "extremely": 1.5, "highly": 1.3, "so": 1.2, "too": 1.2, "quite": 1.1,
    "slightly": 0.7, "somewhat": 0.7, "rather": 0.8, "barely": 0.5, "fairly": 0.8,
}

#: Words, and marks that end a clause.
TOKEN = r"(\p{L}+(?:['’]\p{L}+)*|[.,;:!?\n])"


def contexts(text: Column) -> Column:
    """Per word of a text: the word in lower case and the words of its clause within REACH before it."""
    tokens = F.regexp_extract_all(F.replace(F.lower(text), F.lit("’"), F.lit("'")), F.lit(TOKEN), F.lit(1))

    def around(ts: Column) -> Column:
        def one(word: Column, i: Column) -> Column:
            before = F.slice(ts, F.greatest(i - REACH + 1, F.lit(1)), F.least(i, F.lit(REACH)))
            # What stands before the last mark belongs to another clause.
            last = F.aggregate(
                before, F.array().cast("array<string>"),
                lambda held, t: F.when(t.rlike(r"^[.,;:!?\n]$"), F.array().cast("array<string>")).otherwise(F.concat(held, F.array(t))),
            )
            return F.struct(word.alias("word"), last.alias("before"))

        return F.filter(F.transform(ts, one), lambda w: ~w["word"].rlike(r"^[.,;:!?\n]$"))

    return F.transform(F.array(tokens), around)[0]


def polarity_in_context(
    df: DataFrame, text: str, key: str, lexicon: DataFrame, modifiers: dict[str, float] | None = None
) -> DataFrame:
    """`(key, polarity, hits)` per key: the mean over lexicon words of their polarity, each times its modifiers.

    `lexicon` is `(word, polarity)` in lower case, one polarity per word, of any size. A hit is multiplied
    by every modifier among the REACH words before it in its clause and kept within [-1, 1]: "not good" is
    -0.5 times good. Texts without a hit, empty or missing, have polarity 0.
    """
    factors = MODIFIERS if modifiers is None else modifiers
    rows = df.select(col(key).alias("key"), col(text).alias("text"))
    said = rows.select("key", F.posexplode(contexts(F.col("text"))).alias("at", "w")).select("key", "at", "w.*")
    known = lexicon.groupBy("word").agg(F.min("polarity").cast("double").alias("polarity"))
    found = salted_join(said, known, ["word"], ["key", "at"])
    table = F.create_map(*[x for w, f in factors.items() for x in (F.lit(w), F.lit(float(f)))]) if factors else None
    factor = F.lit(1.0) if table is None else F.aggregate("before", F.lit(1.0), lambda f, w: f * F.coalesce(table[w], F.lit(1.0)))
    value = F.greatest(F.least(F.col("polarity") * factor, F.lit(1.0)), F.lit(-1.0))
    # A row without a value for every text keeps those without a hit.
    hits = found.select("key", value.alias("value")).unionByName(rows.select("key", F.lit(None).cast("double").alias("value")))
    out = hits.groupBy("key").agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("polarity"), F.count("value").alias("hits"))
    return out.withColumnRenamed("key", key)
