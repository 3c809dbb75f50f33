"""Text expressions. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Stop words used for normalisation, word weights and language votes.
STOP_WORDS = {
    "en": [
        "a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "been",
        "but", "by", "can", "did", "do", "does", "for", "from", "had", "has", "have", "he", "her",
        "his", "how", "if", "in", "into", "is", "it", "its", "more", "no", "not", "of", "on", "or",
        "our", "she", "so", "than", "that", "the", "their", "them", "then", "there", "these",
        "they", "this", "to", "was", "we", "were", "what", "when", "which", "who", "will", "with",
        "would", "you", "your",
    ],
    "de": [
        "aber", "als", "auch", "auf", "aus", "bei", "das", "dem", "den", "der", "des", "die", "ein",
        "eine", "er", "es", "ich", "im", "ist", "mit", "nicht", "oder", "sich", "sie", "sind", "und",
        "von", "war", "wie", "wir", "zu",
    ],
    "es": [
        "al", "como", "con", "del", "el", "ella", "en", "es", "esta", "este", "fue", "la", "las",
        "lo", "los", "no", "o", "para", "pero", "por", "que", "se", "su", "un", "una", "y",
    ],
    "fr": [
        "au", "avec", "ce", "cette", "dans", "de", "des", "du", "elle", "en", "est", "et", "il",
        "la", "le", "les", "mais", "ne", "nous", "ou", "par", "pas", "pour", "que", "qui", "sont",
        "sur", "un", "une", "vous",
    ],
}

# A small opinion lexicon, word to polarity in [-1, 1].
POLARITY = {
    "excellent": 1.0, "best": 1.0, "great": 0.8, "good": 0.7, "better": 0.5, "nice": 0.6,
    "strong": 0.4, "positive": 0.2, "new": 0.1, "right": 0.3, "bad": -0.7, "worst": -1.0,
    "poor": -0.4, "wrong": -0.5, "negative": -0.3, "terrible": -1.0, "error": -0.4, "risk": -0.3,
    "fail": -0.5, "slow": -0.3,
}

# The patterns a listed question may match, in order of preference.
QUESTION_PATTERNS = [
    r"\d+\.\s*(.+?\?)",
    r"(?:^|\n)\s*([^?\n]{10,}\?)",
    r"(?:Question|Q)\s*\d*:?\s*(.+?\?)",
    r"(?:^|\n)\s*[-•*]\s*(.+?\?)",
    r"(?:^|\n)([A-Z][^?\n]{10,}\?)",
]
LIST_MARK = r"^\d+\.\s*|^[-•*]\s*"
QUESTION_WORDS = ["what", "how", "why", "which", "where", "when"]

# The characters that count as whitespace.
WHITESPACE = (
    " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"(?U)[\s\x1c-\x1f]+"


def bind(value: Column, use) -> Column:
    """Evaluate `value` once and hand it to `use`, for expressions that refer to it repeatedly."""
    return F.transform(F.array(value), use)[0]


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace of any kind; only the ends are looked at."""
    return F.btrim(c, F.lit(WHITESPACE))


def words(c: Column) -> Column:
    """Whitespace-separated words, none of them empty."""
    return F.when(not_blank(c), F.split(strip(c), SPACE)).when(c.isNotNull(), F.array().cast("array<string>"))


def word_count(c: Column) -> Column:
    return F.when(not_blank(c), F.size(F.split(strip(c), SPACE))).when(c.isNotNull(), 0)


def not_blank(c: Column) -> Column:
    return strip(c) != ""


def title_case(c: Column) -> Column:
    """A capital after every non-letter, the rest lower case."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    cased = F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))
    return F.array_join(cased, "")


def basic_clean(c: Column) -> Column:
    """Collapse whitespace, strip, then drop all but word characters and `.,!?-`."""
    return F.regexp_replace(strip(F.regexp_replace(c, SPACE, " ")), r"[^\p{L}\p{N}_\s.,!?-]", "")


def tokens(c: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-case words without digits, punctuation, stop words and words of one or two letters."""
    stop = STOP_WORDS["en"] if stop_words is None else stop_words
    plain = F.regexp_replace(F.lower(c), r"[\p{Nd}\p{Punct}]+", "")
    return F.filter(words(plain), lambda w: (F.length(w) > 2) & ~w.isin(stop))


def key_finding(answer: Column) -> Column:
    """The first sentence, cut to 100 characters."""
    first = F.substring_index(answer, ". ", 1)
    cut = F.concat(F.substring(first, 1, 100), F.when(F.length(first) > 100, "...").otherwise(""))
    return F.when(F.coalesce(answer, F.lit("")) == "", "No key finding").otherwise(cut)


def key_values(text: Column) -> Column:
    """`key=value` pairs as an array of structs; the last value of a key wins."""
    body = F.substring_index(text, "Action Input:", -1)
    parts = F.filter(F.split(body, "[\n;]"), lambda p: p.contains("="))
    pairs = F.transform(
        parts,
        lambda p: F.struct(
            F.lower(strip(F.substring_index(p, "=", 1))).alias("key"),
            strip(F.substr(p, F.instr(p, "=") + 1)).alias("value"),
        ),
    )

    def last_of_each(found: Column) -> Column:
        def is_last(pair: Column, i: Column) -> Column:
            later = F.slice(found, i + 2, F.size(found))
            return ~F.exists(later, lambda other: other["key"] == pair["key"])

        return F.filter(found, is_last)

    return bind(pairs, last_of_each)


def listed_questions(text: Column, limit: int) -> Column:
    """Questions found in a free-form list, at most `limit` of them."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit("(?im)" + p), F.lit(1)) for p in QUESTION_PATTERNS])
    found = F.transform(found, lambda q: F.regexp_replace(strip(q), LIST_MARK, ""))
    found = F.slice(F.array_distinct(F.filter(found, lambda q: F.length(q) > 10)), 1, limit)

    lines = F.transform(F.split(text, "\n"), strip)
    asks = "(?i)\\?|" + "|".join(QUESTION_WORDS)
    lines = F.filter(lines, lambda s: (F.length(s) > 10) & s.rlike(asks))
    lines = F.transform(lines, lambda s: F.regexp_replace(s, LIST_MARK, ""))
    lines = F.transform(lines, lambda s: F.when(s.endswith("?"), s).otherwise(F.concat(s, F.lit("?"))))
    lines = F.slice(F.array_distinct(lines), 1, limit)
    return bind(found, lambda some: F.when(F.size(some) > 0, some).otherwise(lines))


def plain_answer(c: Column) -> Column:
    """An answer without the chart symbols, on one line."""
    # The symbols dropped from report text.
    return strip(F.regexp_replace(F.regexp_replace(c, "[📊📈📉💡🔍⚡🧠🎯]+", ""), SPACE, " "))


def plain_question(c: Column) -> Column:
    return strip(F.replace(c, F.lit("*"), F.lit("")))


def letters(c: Column, wanted: list[str]) -> Column:
    """The wanted words among the lower-case letter runs of a text, repeats kept."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+)"), F.lit(1))
    return F.filter(runs, lambda w: w.isin(wanted))


def count_in(found: Column, group: list[str]) -> Column:
    return F.size(F.filter(found, lambda w: w.isin(group)))


def polarity(c: Column, lexicon: dict[str, float] | None = None) -> Column:
    """Mean polarity of the lexicon words in a text, 0 without any."""
    scores = POLARITY if lexicon is None else lexicon
    by_score: dict[float, list[str]] = {}
    for word, score in scores.items():
        by_score.setdefault(score, []).append(word)

    def mean_score(hits: Column) -> Column:
        total = F.lit(0.0)
        for score, group in by_score.items():
            total = total + F.lit(score) * count_in(hits, group)
        return F.coalesce(F.try_divide(total, F.size(hits).cast("double")), F.lit(0.0))

    return bind(letters(c, list(scores)), mean_score)


def language_vote(c: Column) -> Column:
    """The language whose stop words occur most often; `unknown` without a hit, ties by name."""

    def winner(hits: Column) -> Column:
        votes = [
            F.struct((-count_in(hits, group)).alias("votes"), F.lit(name).alias("lang"))
            for name, group in sorted(STOP_WORDS.items())
        ]
        return F.when(F.size(hits) > 0, F.array_min(F.array(*votes))["lang"]).otherwise("unknown")

    every = sorted({w for group in STOP_WORDS.values() for w in group})
    return bind(letters(c, every), winner)
