"""Statistics over text collections and the splitting of texts into chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.columns import col
from plumbline.functions.text import basic_clean, language_vote, not_blank, tokens, word_count, words
from plumbline.operators.joins import salted_join

# The separators tried from coarse to fine.
SEPARATORS = ["\n\n", "\n", " ", ""]


def text_profile(df: DataFrame, text: str) -> DataFrame:
    """Characters and words per non-empty text, zeros without any."""
    sizes = df.select(F.length(col(text)).alias("size"), word_count(col(text)).alias("words")).filter("size > 0")
    filled = sizes.agg(
        F.avg("size").alias("avg_text_length"), F.min("size").alias("min_text_length"),
        F.max("size").alias("max_text_length"), F.avg("words").alias("avg_token_count"),
    )
    return filled.na.fill(0)


def language_hist(df: DataFrame, text: str, lang: str | None = None) -> DataFrame:
    """Texts per language, from a column or by stop-word vote over the whole text."""
    language = col(lang) if lang else language_vote(col(text))
    return df.filter(not_blank(col(text))).groupBy(language.alias("lang")).agg(F.count("*").alias("n"))


def clean_text(df: DataFrame, text: str = "content", drop_metadata: bool = False) -> DataFrame:
    out = df.withColumn("cleaned_content", basic_clean(col(text)))
    return out.drop("metadata") if drop_metadata else out


def clean_text_stats(cleaned: DataFrame) -> DataFrame:
    """Words per cleaned text; long texts on average count as high quality."""
    n = F.col("n")
    row = cleaned.select(word_count(F.col("cleaned_content")).alias("n")).agg(
        F.count("*").alias("document_count"), F.avg(n).alias("avg_doc_length"), F.min(n).alias("min_doc_length"),
        F.max(n).alias("max_doc_length"), F.sum(n).alias("total_words"),
    )
    quality = F.when(F.col("avg_doc_length") > 50, "high").otherwise("medium")
    return row.withColumn("content_quality", quality)


def normalize_text(df: DataFrame, text: str, key: str, lemmas: DataFrame | None = None, stop_words: list[str] | None = None) -> DataFrame:
    """`(key, tokens)`: the normalised words of each text, in order, with their lemmas if a table gives some.

    `lemmas` is `(form, lemma)`, one lemma per form; other words stay. The distinct words of a text meet the
    table by a join in which a frequent word is dealt among tasks; only what is found there goes back to the text.
    """
    rows = df.select(col(key).alias("key"), tokens(col(text), stop_words).alias("tokens"))
    if lemmas is not None:
        said = rows.select("key", F.explode(F.array_distinct("tokens")).alias("form"))
        known = lemmas.filter("form is not null and lemma is not null").groupBy("form").agg(F.min("lemma").alias("lemma"))
        hits = salted_join(said, known, ["form"], ["key"])
        found = hits.groupBy(F.col("key").alias("of")).agg(F.map_from_entries(F.collect_set(F.struct("form", "lemma"))).alias("lemmas"))
        rows = rows.join(found, F.col("key").eqNullSafe(F.col("of")), "left")
        stems = F.transform("tokens", lambda w: F.coalesce(F.element_at("lemmas", w), w))
        rows = rows.select("key", F.when(F.col("lemmas").isNull(), F.col("tokens")).otherwise(stems).alias("tokens"))
    return rows.withColumnRenamed("key", key)


def corpus_stats(df: DataFrame, text: str) -> DataFrame:
    return df.agg(
        F.count("*").alias("num_docs"), F.coalesce(F.avg(F.coalesce(word_count(col(text)), F.lit(0))), F.lit(0.0)).alias("avg_len")
    )


def word_counts(df: DataFrame, text: Column) -> DataFrame:
    """Occurrences per whitespace word; equal words meet in the map-side aggregation first."""
    return df.select(F.explode(words(text)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def word_freq(df: DataFrame, text: str, k: int = 20) -> DataFrame:
    return word_counts(df, col(text)).orderBy(F.desc("n"), "word").limit(k)


def chunks_fixed(df: DataFrame, text: str, size: int = 1000) -> DataFrame:
    """Consecutive pieces of `size` characters without overlap; blank pieces drop out."""
    c = col(text)
    starts = F.sequence(F.lit(0), F.floor((F.greatest(F.length(c), F.lit(1)) - 1) / size).cast("int"))
    pieces = F.transform(starts, lambda i: F.substr(c, i * size + 1, F.lit(size)))
    rest = [col(n) for n in df.columns if n != text]
    out = df.filter(c.isNotNull()).select(*rest, F.posexplode(pieces).alias("chunk", "content"))
    return out.filter(not_blank(F.col("content"))).withColumn("length", F.length("content"))


def _atoms(text: str, start: int, stop: int, size: int, step: int, separators: list[str]) -> Iterator[tuple[int, int]]:
    """Spans of at most `size` characters that follow each other, each with the separator behind it."""
    if stop - start <= size:
        yield start, stop
        return
    separator = next((s for s in separators if s == "" or text.find(s, start, stop) >= 0), "")
    if separator == "":
        # No separator left: windows that share what neighbouring pieces may share.
        for at in range(start, stop, step):
            yield at, min(at + size, stop)
            if at + size >= stop:
                return
        return
    finer = separators[separators.index(separator) + 1 :]
    while start < stop:
        found = text.find(separator, start, stop)
        end = stop if found < 0 else found + len(separator)
        yield from _atoms(text, start, end, size, step, finer)
        start = end


def split_spans(text: str, size: int, overlap: int, separators: list[str] = SEPARATORS) -> list[tuple[int, int]]:
    """Spans of at most `size` characters, cut at the coarsest separators that fit, in order.

    Neighbouring spans share up to `overlap` characters. White space at the ends of a span is left
    out, everything else lies in a span.
    """
    spans: list[tuple[int, int]] = []
    window: list[tuple[int, int]] = []

    def flush() -> None:
        piece = text[window[0][0] : window[-1][1]]
        start = window[0][0] + len(piece) - len(piece.lstrip())
        if piece.strip():
            spans.append((start, start + len(piece.strip())))

    for atom in _atoms(text, 0, len(text), size, max(1, size - overlap), separators):
        filled = len(text[atom[0] : atom[1]].rstrip())
        if window and atom[0] + filled - window[0][0] > size:
            flush()
            end = window[-1][1]
            while window and (end - window[0][0] > overlap or atom[0] + filled - window[0][0] > size):
                window.pop(0)
        window.append(atom)
    if window:
        flush()
    return spans


def split_recursive(text: str, size: int, overlap: int, separators: list[str] = SEPARATORS) -> list[str]:
    """The pieces of `text` that `split_spans` finds; each is a part of it, unchanged."""
    return [text[a:b] for a, b in split_spans(text, size, overlap, separators)]


def chunks_recursive(df: DataFrame, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Overlapping chunks cut at blank lines, lines or blanks; Arrow batches, one text at a time.

    `start` is the chunk's place in the text, counted from 0.
    """

    @F.pandas_udf("array<struct<start:int,content:string>>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: [{"start": a, "content": t[a:b]} for a, b in split_spans(t or "", size, overlap)])

    rest = [col(n) for n in df.columns if n != text]
    pieces = df.select(*rest, F.posexplode(split(col(text))).alias("chunk", "__piece"))
    return pieces.select(*rest, "chunk", "__piece.content", F.length("__piece.content").alias("length"), "__piece.start")


def page_chunks(pages: DataFrame, size: int = 1000) -> DataFrame:
    """Chunks of page texts `(path, page, text)`; a missing page number becomes 0."""
    numbered = pages.withColumn("page", F.coalesce("page", F.lit(0)))
    return chunks_fixed(numbered, "text", size)
