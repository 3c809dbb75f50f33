"""Text collections: profiles, cleaning, words, chunks, domains, vectors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window as W, functions as F

from plumbline.functions import text as X
from plumbline.operators import charts, classify, corpus, rules, sentiment as context, vectors
from plumbline.plans.answers import answer, answer_multiple, answer_text
from plumbline.sources.csv_repair import SEPARATORS, guess_delimiter
from workload.clean import strip_sql
from workload.registry import query, words_sql

N_WORDS = r"len(regexp_extract_all(text, '\S+'))"
COLLAPSED = r"regexp_replace(text, '\s+', ' ', 'g')"
CLEANED = f"regexp_replace({strip_sql(COLLAPSED)}, '[^\\p{{L}}\\p{{N}}_\\s.,!?-]', '', 'g')"


def chunks_sql(table: str, keep: str) -> str:
    return f"""
SELECT {keep}, cast(i AS int) AS chunk, substr(text, i * 1000 + 1, 1000) AS content,
       length(substr(text, i * 1000 + 1, 1000)) AS length
FROM (SELECT *, unnest(range(0, (greatest(length(text), 1) - 1) // 1000 + 1)) AS i FROM {table}) c
WHERE regexp_matches(substr(text, i * 1000 + 1, 1000), '\\S')
"""


@query("text_chunks_fixed", chunks_sql("documents", "doc_id"))
def text_chunks_fixed(t):
    return corpus.chunks_fixed(t("documents").select("doc_id", "text"), "text")


@query("text_chunks_recursive")
def text_chunks_recursive(t):
    return corpus.chunks_recursive(t("documents").select("doc_id", "text"), "text")


@query(
    "chunk_coverage",
    r"""
SELECT doc_id, length(regexp_replace(text, '\s', '', 'g')) AS covered, 0 AS altered, 0 AS too_long, 0 AS disordered
FROM documents WHERE regexp_matches(text, '\S')
""",
)
def chunk_coverage(t):
    """Per text: characters in chunks, without white space, and chunks that break a rule."""
    chunks = corpus.chunks_recursive(t("documents").withColumn("whole", F.col("text")).select("doc_id", "whole", "text"), "text")
    per = W.partitionBy("doc_id").orderBy("chunk")
    until = F.col("start") + F.col("length")
    chunks = chunks.withColumns({"before": F.coalesce(F.max(until).over(per.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
                                 "previous": F.coalesce(F.lag("start").over(per), F.lit(-1))})
    fresh = F.expr("substring(whole, greatest(start, before) + 1, greatest(0, start + length - greatest(start, before)))")
    return chunks.groupBy("doc_id").agg(
        F.sum(F.length(F.regexp_replace(fresh, r"\s", ""))).alias("covered"),
        F.count_if(F.expr("substring(whole, start + 1, length) <> content")).alias("altered"),
        F.count_if(F.col("length") > 1000).alias("too_long"),
        F.count_if((F.col("start") <= F.col("previous")) | (F.col("start") > 0) & (until <= F.col("before"))).alias("disordered"),
    )


PAGES = "(SELECT 'talk/' || conv_id AS path, coalesce(CASE WHEN role <> 'system' THEN turn END, 0) AS page, text FROM conversations)"


@query("page_chunks", chunks_sql(PAGES, "path, page"))
def page_chunks(t):
    pages = t("conversations").select(
        F.concat(F.lit("talk/"), "conv_id").alias("path"), F.when(F.col("role") != "system", F.col("turn")).alias("page"), "text"
    )
    return corpus.page_chunks(pages)


LINES = r"list_filter(string_split_regex(text, '\r\n|\n|\r')[1:10], lambda s: s <> '')"


def separator_counts(i: int, s: str) -> str:
    sep = "chr(9)" if s == "\t" else f"'{s}'"
    return f"list_transform(lines, lambda s: length(s) - length(replace(s, {sep}, ''))) AS c{i}"


@query(
    "guess_delimiter",
    f"""
WITH l AS (SELECT doc_id, {LINES} AS lines FROM documents),
c AS (SELECT doc_id, {", ".join(separator_counts(i, s) for i, s in enumerate(SEPARATORS))} FROM l),
s AS (SELECT doc_id, {", ".join(f"coalesce(len(list_filter(c{i}, lambda n: n = c{i}[1])) * list_sum(c{i}), 0) AS s{i}" for i in range(4))} FROM c),
m AS (SELECT *, greatest(s0, s1, s2, s3) AS top FROM s)
SELECT doc_id, CASE WHEN top = 0 THEN NULL WHEN s0 = top THEN ',' WHEN s1 = top THEN ';' WHEN s2 = top THEN chr(9)
       ELSE '|' END AS delimiter FROM m
""",
)
def delimiters(t):
    return t("documents").select("doc_id", guess_delimiter(F.col("text")).alias("delimiter"))


@query(
    "text_profile",
    f"""
SELECT round(avg(length(text)), 4) AS avg_text_length, min(length(text)) AS min_text_length,
       max(length(text)) AS max_text_length, round(avg({N_WORDS}), 4) AS avg_token_count
FROM documents WHERE length(text) > 0
""",
)
def text_profile(t):
    return corpus.text_profile(t("documents"), "text")


HITS = r"list_filter(regexp_extract_all(lower(text), '\p{L}+'), lambda w: w IN "
ALL_STOP = words_sql(sorted({w for g in X.STOP_WORDS.values() for w in g}))
VOTES = ", ".join(f"len(list_filter(hits, lambda w: w IN {words_sql(g)})) AS {name}" for name, g in sorted(X.STOP_WORDS.items()))


@query(
    "language_hist",
    f"""
WITH h AS (SELECT {HITS}{ALL_STOP}) AS hits FROM documents WHERE regexp_matches(text, '\\S')),
v AS (SELECT {VOTES} FROM h),
g AS (SELECT *, greatest(de, en, es, fr) AS top FROM v)
SELECT CASE WHEN top = 0 THEN 'unknown' WHEN de = top THEN 'de' WHEN en = top THEN 'en' WHEN es = top THEN 'es'
       ELSE 'fr' END AS lang, count(*) AS n FROM g GROUP BY 1
""",
)
def language_hist(t):
    return corpus.language_hist(t("documents"), "text")


@query("clean_text", f"SELECT doc_id, text AS content, {CLEANED} AS cleaned_content FROM documents")
def clean_text(t):
    return corpus.clean_text(t("documents").select("doc_id", F.col("text").alias("content")))


@query(
    "clean_text_stats",
    f"""
WITH c AS (SELECT len(regexp_extract_all({CLEANED}, '\\S+')) AS n FROM documents)
SELECT count(*) AS document_count, round(avg(n), 4) AS avg_doc_length, cast(min(n) AS int) AS min_doc_length,
       cast(max(n) AS int) AS max_doc_length, cast(sum(n) AS bigint) AS total_words,
       CASE WHEN avg(n) > 50 THEN 'high' ELSE 'medium' END AS content_quality FROM c
""",
)
def clean_text_stats(t):
    return corpus.clean_text_stats(corpus.clean_text(t("documents").select(F.col("text").alias("content"))))


@query("corpus_stats", f"SELECT count(*) AS num_docs, round(avg({N_WORDS}), 4) AS avg_len FROM documents")
def corpus_stats(t):
    return corpus.corpus_stats(t("documents"), "text")


WORDS = r"SELECT unnest(regexp_extract_all({x}, '\S+')) AS word FROM documents"


@query(
    "word_freq",
    f"SELECT word, count(*) AS n FROM ({WORDS.format(x='text')}) w GROUP BY 1 ORDER BY n DESC, word LIMIT 20",
)
def word_freq(t):
    return corpus.word_freq(t("documents"), "text")


@query(
    "word_weights",
    f"""
WITH k AS (SELECT word, count(*) AS n FROM ({WORDS.format(x='lower(text)')}) w
           WHERE word NOT IN {words_sql(X.STOP_WORDS["en"])} GROUP BY 1 ORDER BY n DESC, word LIMIT 200)
SELECT word, n, round(n / (SELECT max(n) FROM k), 4) AS weight FROM k
""",
)
def word_weights(t):
    return charts.word_weights(t("documents"), "text")


@query(
    "normalize_text",
    rf"""
WITH p AS (SELECT doc_id, regexp_replace(regexp_replace(lower(text), '\p{{Nd}}+', '', 'g'), '[[:punct:]]+', '', 'g') AS plain
           FROM documents)
SELECT doc_id, array_to_string(list_filter(regexp_extract_all(plain, '\S+'),
       lambda w: length(w) > 2 AND w NOT IN {words_sql(X.STOP_WORDS["en"])}), ' ') AS tokens FROM p
""",
)
def normalize_text(t):
    return t("documents").select("doc_id", F.array_join(X.tokens(F.col("text")), " ").alias("tokens"))


FORMS = r"""
forms AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+ing')) AS form FROM benchmark)"""


@query(
    "lemma_text",
    rf"""
WITH {FORMS.strip()},
p AS (SELECT doc_id, regexp_replace(regexp_replace(lower(text), '\p{{Nd}}+', '', 'g'), '[[:punct:]]+', '', 'g') AS plain
      FROM documents),
w AS (SELECT doc_id, list_filter(regexp_extract_all(plain, '\S+'),
      lambda w: length(w) > 2 AND w NOT IN {words_sql(X.STOP_WORDS["en"])}) AS words FROM p),
f AS (SELECT list(form) AS listed FROM forms)
SELECT doc_id, array_to_string(list_transform(words, lambda x: CASE WHEN list_contains(listed, x) THEN left(x, -3) ELSE x END), ' ') AS tokens
FROM w, f
""",
)
def lemma_text(t):
    """Words of the benchmark that end in `ing` stand for their stem."""
    found = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+ing)"), F.lit(1))).alias("form")
    lemmas = t("benchmark").select(found).distinct().withColumn("lemma", F.expr("left(form, length(form) - 3)"))
    rows = corpus.normalize_text(t("documents"), "text", "doc_id", lemmas)
    return rows.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


SCORE = "CASE w " + " ".join(f"WHEN '{w}' THEN {s}" for w, s in X.POLARITY.items()) + " END"
POLARITIES = f"""
SELECT id, text, coalesce(list_avg(list_transform({HITS}{words_sql(list(X.POLARITY))}), lambda w: {SCORE})), 0) AS polarity
FROM question_texts WHERE regexp_matches(text, '\\S')
"""
QUESTION_TEXTS = "question_texts AS (SELECT q_id AS id, question AS text FROM questions)"


@query("sentiment", f"WITH {QUESTION_TEXTS} SELECT id AS q_id, round(polarity, 4) AS polarity FROM ({POLARITIES}) p")
def sentiment(t):
    return t("questions").select("q_id", X.polarity(F.col("question")).alias("polarity"))


@query(
    "sentiment_hist",
    f"""
WITH {QUESTION_TEXTS},
c AS (SELECT least(cast(floor((polarity + 1) / 2 * 20) AS int), 19) AS bin, count(*) AS n FROM ({POLARITIES}) p GROUP BY 1)
SELECT cast(b.bin AS int) AS bin, round(-1 + b.bin * 0.1::DOUBLE, 4) AS low, round(-1 + (b.bin + 1) * 0.1::DOUBLE, 4) AS high,
       coalesce(n, 0) AS n
FROM (SELECT unnest(range(20)) AS bin) b LEFT JOIN c ON c.bin = b.bin
""",
)
def sentiment_hist(t):
    return charts.sentiment_hist(t("questions"), "question")


QUOTE = "'"
LEXICON = ", ".join(f"('{w}', {v}::DOUBLE)" for w, v in X.POLARITY.items())
FACTORS = ", ".join(f"('{w.replace(QUOTE, QUOTE * 2)}', {f}::DOUBLE)" for w, f in context.MODIFIERS.items())


@query(
    "sentiment_in_context",
    rf"""
WITH t AS (SELECT id, regexp_extract_all(replace(lower(text), '’', chr(39)), '{context.TOKEN.replace(QUOTE, QUOTE * 2)}', 1) AS ts
           FROM (SELECT q_id AS id, 'This is not very ' || question || ' not good, never bad. Really great!' AS text FROM questions)),
w AS (SELECT id, unnest(ts) AS word, generate_subscripts(ts, 1) AS i FROM t),
l(word, polarity) AS (VALUES {LEXICON}), f(word, factor) AS (VALUES {FACTORS}),
h AS (SELECT w.id, w.i, polarity FROM w JOIN l ON l.word = w.word),
ends AS (SELECT h.id, h.i, max(c.i) AS mark FROM h JOIN w c ON c.id = h.id AND c.i < h.i AND regexp_matches(c.word, '^[.,;:!?\n]$') GROUP BY 1, 2),
m AS (SELECT h.id, h.i, f.factor FROM h LEFT JOIN ends e ON e.id = h.id AND e.i = h.i
      JOIN w b ON b.id = h.id AND b.i BETWEEN h.i - {context.REACH} AND h.i - 1 AND b.i > coalesce(e.mark, 0) JOIN f ON f.word = b.word),
p AS (SELECT id, i, product(factor) AS factor FROM m GROUP BY 1, 2),
v AS (SELECT h.id, greatest(least(h.polarity * coalesce(p.factor, 1), 1), -1) AS value FROM h LEFT JOIN p ON p.id = h.id AND p.i = h.i)
SELECT t.id AS q_id, round(coalesce(avg(value), 0), 4) AS polarity, count(value) AS hits FROM t LEFT JOIN v ON v.id = t.id GROUP BY 1
""",
)
def sentiment_in_context(t):
    """Questions within a frame of negations, with the small lexicon as a table."""
    lexicon = t.spark.createDataFrame(list(X.POLARITY.items()), "word string, polarity double")
    framed = F.concat(F.lit("This is not very "), F.col("question"), F.lit(" not good, never bad. Really great!"))
    return context.polarity_in_context(t("questions").select("q_id", framed.alias("text")), "text", "q_id", lexicon)


def found_sql(phrases: list[str]) -> str:
    return " + ".join(f"contains(lower(text), '{p}')::INT" for p in phrases)


@query(
    "text_domain",
    f"""
WITH s AS (SELECT doc_id, {", ".join(f"{found_sql(p)} AS s{i}" for i, p in enumerate(rules.TEXT_DOMAINS.values()))} FROM documents),
m AS (SELECT *, greatest({", ".join(f"s{i}" for i in range(len(rules.TEXT_DOMAINS)))}) AS top FROM s)
SELECT doc_id, CASE WHEN top < 2 THEN 'General' {" ".join(f"WHEN s{i} = top THEN '{d}'" for i, d in enumerate(rules.TEXT_DOMAINS))} END AS domain
FROM m
""",
)
def text_domain(t):
    return classify.text_domain(t("documents").select("doc_id", "text"), "text").drop("text")


MET = ", ".join(f"bool_or(contains(lower(text), '{p}'))::INT AS p{i}" for i, p in enumerate(classify.PHRASES))


def group_score(i: int, phrases: list[str]) -> str:
    return " + ".join(f"p{classify.PHRASES.index(p)}" for p in phrases) + f" AS s{i}"


@query(
    "corpus_domain",
    f"""
WITH met AS (SELECT sum(length(text))::BIGINT AS content_length, count(*) AS chunks, {MET} FROM documents),
s AS (SELECT content_length, chunks, {", ".join(group_score(i, p) for i, p in enumerate(rules.TEXT_DOMAINS.values()))} FROM met),
m AS (SELECT *, greatest({", ".join(f"s{i}" for i in range(len(rules.TEXT_DOMAINS)))}) AS top FROM s)
SELECT CASE WHEN top < 2 THEN 'General' {" ".join(f"WHEN s{i} = top THEN '{d}'" for i, d in enumerate(rules.TEXT_DOMAINS))} END AS domain,
       content_length, chunks FROM m
""",
)
def corpus_domain(t):
    return classify.corpus_domain(t("documents"), "text")


@query("key_finding", "SELECT session_id, key_finding FROM sessions")
def key_finding(t):
    return t("sessions").select("session_id", X.key_finding(F.col("answer")).alias("key_finding"))


@query(
    "parse_keyvals",
    f"""
WITH p AS (SELECT event_id, unnest(regexp_split_to_array(split_part(text, 'Action Input:', 2), '[;\n]')) AS part,
                  generate_subscripts(regexp_split_to_array(split_part(text, 'Action Input:', 2), '[;\n]'), 1) AS i FROM event_inputs),
kv AS (SELECT event_id, i, lower({strip_sql("split_part(part, '=', 1)")}) AS key,
              {strip_sql("substr(part, strpos(part, '=') + 1)")} AS value FROM p WHERE contains(part, '='))
SELECT event_id, key, arg_max(value, i) AS value FROM kv GROUP BY 1, 2
""",
)
def parse_keyvals(t):
    return t("event_inputs").select("event_id", F.inline(X.key_values(F.col("text"))))


def extracted(pattern: str) -> str:
    # `.` stops at line ends in Spark; spelled out here.
    plain = pattern.replace(".+?", r"[^\n]+?")
    return f"regexp_extract_all(text, '(?im){plain}', 1)"


MARK = X.LIST_MARK
FOUND = " || ".join(extracted(p) for p in X.QUESTION_PATTERNS)
WH = "|".join(X.QUESTION_WORDS)


@query(
    "extract_questions",
    rf"""
WITH raw AS (SELECT id, text, list_filter(list_transform({FOUND},
        lambda q: regexp_replace({strip_sql("q")}, '{MARK}', '')), lambda q: length(q) > 10) AS f,
     list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda s: {strip_sql("s")}),
        lambda s: length(s) > 10 AND regexp_matches(s, '(?i)\?|{WH}')),
        lambda s: regexp_replace(s, '{MARK}', '')) AS l FROM question_lists),
part AS (SELECT id, CASE WHEN len(f) > 0 THEN f
         ELSE list_transform(l, lambda s: CASE WHEN s LIKE '%?' THEN s ELSE s || '?' END) END AS q FROM raw),
flat AS (SELECT id, unnest(q) AS question, generate_subscripts(q, 1) AS i FROM part),
once AS (SELECT id, question, min(i) AS i FROM flat GROUP BY 1, 2),
ranked AS (SELECT id, question, row_number() OVER (PARTITION BY id ORDER BY i) AS position FROM once)
SELECT id, cast(position AS int) AS position, question FROM ranked WHERE position <= 8
""",
)
def extract_questions(t):
    found = X.listed_questions(F.col("text"), 8)
    rows = t("question_lists").select("id", F.posexplode(found).alias("position", "question"))
    return rows.withColumn("position", F.col("position") + 1)


def knn_sql(distance: str) -> str:
    return f"""
WITH cells AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
means AS (SELECT label, pos, avg(x) AS m FROM cells GROUP BY 1, 2),
q AS (SELECT label AS query_id, list(m ORDER BY pos) AS v FROM means GROUP BY 1),
d AS (SELECT query_id, vec_id AS mem_id, {distance}(embedding::DOUBLE[], v) AS distance FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, mem_id) AS rank FROM d)
SELECT query_id, mem_id, round(distance, 4) AS distance FROM r WHERE rank <= 5
"""


def nearest(t, metric: str):
    table = t("embeddings")
    memory = table.select(F.col("vec_id").alias("mem_id"), "embedding")
    return vectors.knn(memory, vectors.label_centroids(table, "label", "embedding"), 5, metric)


@query("knn_exact", knn_sql("list_distance"))
def knn_exact(t):
    return nearest(t, "l2")


@query("knn_cosine", knn_sql("list_cosine_distance"))
def knn_cosine(t):
    return nearest(t, "cosine")


def pairwise_sql(sides: str, distance: str) -> str:
    return f"""
WITH {sides},
d AS (SELECT query_id, mem_id, {distance} AS distance FROM q, m),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, mem_id) AS rank FROM d)
SELECT query_id, mem_id, round(distance, 4) AS distance FROM r WHERE rank <= 5
"""


@query(
    "knn_many",
    pairwise_sql(
        """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings),
m AS (SELECT vec_id AS mem_id, embedding::DOUBLE[] AS w FROM embeddings)""",
        "list_distance(v, w)",
    ),
)
def knn_many(t):
    """Every vector against all."""
    table = t("embeddings")
    memory, asked = (table.select(F.col("vec_id").alias(name), "embedding") for name in ("mem_id", "query_id"))
    return vectors.knn(memory, asked, 5)


VOCABULARY = ["the", "of", "and", "to", "in", "that", "is", "it", "der", "die", "und", "la", "le", "de", "les", "el", "que", "los", "en", "on"]


def vocabulary_counts(batch: pd.Series) -> list:
    counts = batch.fillna("").str.lower().str.split()
    return [[words.count(w) for w in VOCABULARY] for words in counts]


def counts_sql(table: str, key: str, name: str, vector: str) -> str:
    words = ", ".join(f"len(list_filter(words, lambda w: w = '{w}'))::DOUBLE" for w in VOCABULARY)
    listed = r"regexp_extract_all(lower(text), '\S+')"
    return f"SELECT {key} AS {name}, [{words}] AS {vector} FROM (SELECT {key}, {listed} AS words FROM {table}) x"


WORD_SEARCH = pairwise_sql(
    f"q AS ({counts_sql('benchmark', 'item_id', 'query_id', 'v')}), m AS ({counts_sql('documents', 'doc_id', 'mem_id', 'w')})",
    "CASE WHEN list_sum(v) = 0 OR list_sum(w) = 0 THEN 1.0 ELSE round(1 - list_inner_product(v, w) / sqrt(list_inner_product(v, v) * list_inner_product(w, w)), 9) END",
)


def counted(t):
    """Documents and test items with the caller's embedding: counts of a few words."""
    memory = vectors.embed(t("documents").select(F.col("doc_id").alias("mem_id"), "text"), "text", vocabulary_counts)
    return memory, vectors.embed(t("benchmark").select(F.col("item_id").alias("query_id"), "text"), "text", vocabulary_counts)


@query("memory_search_words", WORD_SEARCH)
def memory_search_words(t):
    return vectors.knn(*counted(t), 5, "cosine")


@query("memory_search")
def memory_search(t):
    memory = vectors.embed(t("documents").select(F.col("doc_id").alias("mem_id"), "text"), "text")
    asked = vectors.embed(t("benchmark").select(F.col("item_id").alias("query_id"), "text"), "text")
    return vectors.knn(memory, asked, 5, "cosine")


ASKED = [
    "Show the distribution of quantity", "How do prices compare by flag?", "Which columns correlate?",
    "What is the average price?",
]
KINDS = dict(zip(ASKED, ["distribution", "comparison", "correlation", "aggregation"]))


@query("answer_multiple")
def answers(t):
    return answer_multiple(t("lineitem"), ASKED, KINDS)


@query(
    "answer_text",
    f"SELECT word, count(*) AS n FROM ({WORDS.format(x='text')}) w GROUP BY 1 ORDER BY n DESC, word LIMIT 20",
)
def text_answer(t):
    return answer_text(t("documents"), "text", "Which keyword is most frequent?").result


@query(
    "answer_chart",
    """
SELECT 'bars' AS chart, l_returnflag AS label, round(avg(l_quantity), 4) AS value FROM lineitem GROUP BY 2
UNION ALL
SELECT 'points', CAST(count(*) AS VARCHAR), round(avg(l_orderkey), 4) FROM lineitem
UNION ALL
SELECT 'trend', CAST(year(l_shipdate) * 100 + month(l_shipdate) AS VARCHAR), round(avg(l_orderkey), 4) FROM lineitem GROUP BY 2
""",
)
def chart_answer(t):
    """The charts that questions lead to: by words, and by a kind the caller names."""
    table = t("lineitem")
    bars = answer(table, "Compare l_quantity by l_returnflag").chart
    points = answer(table, "How do the numbers relate?", chart="scatter").chart
    trend = answer(table, "How does it grow?", chart="trend").chart
    month = (F.year("time") * 100 + F.month("time")).cast("string")
    return (
        bars.select(F.lit("bars").alias("chart"), F.col("category").alias("label"), F.col("mean").alias("value"))
        .unionByName(points.agg(F.lit("points").alias("chart"), F.count("*").cast("string").alias("label"), F.avg("x").alias("value")))
        .unionByName(trend.select(F.lit("trend").alias("chart"), month.alias("label"), "value"))
    )
