"""The registered queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.balltree import top_k
from plumbline.llm.common import fold
from plumbline.llm.contamination import find_contamination
from plumbline.llm.langid import learn_languages, predict_languages
from plumbline.llm.licenses import scan_licenses
from plumbline.llm.mixing import mix_sources
from plumbline.llm.mixing_lm import score_texts
from plumbline.llm.near_duplicates import near_duplicates
from plumbline.llm.negatives import mine_negatives
from plumbline.llm.phrases import mine_phrases
from plumbline.llm.quality import learn_quality, score_quality
from plumbline.llm.sharding import assign_shards
from plumbline.llm.substrings import remove_repeats
from plumbline.llm.toxicity import learn_toxicity, score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Weights of sources in code-point order, repeating, and the share of all words that the mix holds.
MIX_WEIGHTS, MIX_SHARE, MIX_MOST = [5.0, 2.0, 1.0], 1.5, 2.0

SHARDS = 8


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


USABLE_VECTOR = "vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"

WHOLE_NUMBERS = "transform(embedding, x -> floor(cast(x as double) * 256))"

WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def uniform_sql(key: str, salt: str) -> str:
    return f"((('0x' || substr(md5({key} || ':{salt}'), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0"


@query("op6_mix_sources", rf"""
WITH docs AS (
  SELECT doc_id, source, len({WORDS_SQL}) AS size FROM documents
), parts AS (
  SELECT source, sum(size) AS words, sum(CASE WHEN size < 50 THEN size ELSE 0 END) AS short_words,
         sum(CASE WHEN size >= 50 THEN size ELSE 0 END) AS long_words
  FROM docs GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight,
         1.5 * (SELECT sum(words) FROM parts) AS total
  FROM parts
), filled AS (
  SELECT *, (total - coalesce(sum(2.0 * words) OVER before, 0)) / (sum(weight) OVER after) AS scale
  FROM weighed
  WINDOW before AS (ORDER BY words / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (ORDER BY words / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), level AS (
  SELECT coalesce(arg_min(scale, words / weight) FILTER (WHERE weight * scale <= 2.0 * words), 1e300) AS scale FROM filled
), targets AS (
  SELECT f.source, f.words, f.short_words, f.long_words, least(f.weight * l.scale, 2.0 * f.words) AS target FROM filled f, level l
), inside AS (
  SELECT *, CASE WHEN 0.5 * short_words + long_words = 0 THEN 0 ELSE target / (0.5 * short_words + long_words) END AS rate FROM targets
), copies AS (
  SELECT *, CASE WHEN long_words = 0 THEN 0 WHEN rate > 2 THEN 2.0 ELSE rate END AS long_copies,
         CASE WHEN short_words = 0 THEN 0 WHEN long_words = 0 THEN target / short_words
              WHEN rate > 2 THEN least(2.0, (target - 2.0 * long_words) / short_words) ELSE 0.5 * rate END AS short_copies
  FROM inside
), chances AS (
  SELECT d.doc_id, d.size, c.source, c.words, c.target, CASE WHEN size >= 50 THEN long_copies ELSE short_copies END AS e,
         {uniform_sql("doc_id::VARCHAR", "mix")} AS u
  FROM docs d JOIN copies c ON d.source IS NOT DISTINCT FROM c.source
), ranked AS (
  SELECT *, floor(e) AS certain, e - floor(e) AS pi, CASE WHEN e > floor(e) THEN u / (1 - u) / ((e - floor(e)) / (1 - (e - floor(e)))) END AS odds
  FROM chances
), run AS (
  SELECT *, coalesce(sum(CASE WHEN pi > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY odds / (1 + odds) NULLS LAST, doc_id, size
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         target - sum(certain * size) OVER (PARTITION BY source) AS want
  FROM ranked
)
SELECT doc_id, size::BIGINT AS size, words::BIGINT AS source_size, round(target, 4) AS target,
       (size * (certain + CASE WHEN pi > 0 AND before + size / 2 <= want THEN 1 ELSE 0 END))::BIGINT AS taken, source
FROM run""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_SHARE, MIX_MOST, keep=["doc_id", "source"])
    taken = (F.col("mix.size") * F.col("mix.copies")).alias("taken")
    return mixed.select("doc_id", "mix.size", "mix.source_size", F.round("mix.target", 4).alias("target"), taken, "source")


def _draw_sql(shards: int) -> str:
    draws = [f"{{'draw': -ln({uniform_sql('doc_id::VARCHAR', str(s))}) / 1.0, 'shard': {s}}}" for s in range(shards)]
    return f"least({', '.join(draws)})"


# The table of CRC-32 (reversed polynomial 0xEDB88320) is built from its rule.
@query("op9_shard_documents", rf"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS entries
), bytes AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS digits FROM documents
), sized AS (
  SELECT doc_id, n + 1 AS size,
         xor(list_reduce(list_concat([4294967295], list_transform(range(n), lambda i: ('0x' || substr(digits, (2 * i + 1)::INT, 2))::BIGINT)),
                         lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM bytes, crc
), placed AS (
  SELECT *, {_draw_sql(SHARDS)}.shard AS shard, {_draw_sql(SHARDS + 1)}.shard AS grown_shard,
         {uniform_sql("doc_id::VARCHAR", "slot")} AS place
  FROM sized
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY place, doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM placed""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = assign_shards(table(spark, sf_dir, "documents"), [1.0] * SHARDS, grow_by=1.0)
    return shards.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op8_top_k", """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    vectors = rows.filter(USABLE_VECTOR).select(F.col("vec_id").alias("id"), F.expr(WHOLE_NUMBERS).alias("vector"))
    return top_k(vectors, vectors.filter("id % 50 = 0"), k=5)


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 5) == 0)
    model = learn_languages(docs.filter(~F.col("held_out")).select("text", "lang"))
    return predict_languages(docs, model, keep=["doc_id", "held_out"])


def quality_model(spark: SparkSession, sf_dir: str):
    """Fitted on the labels of all folds but one."""
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 3) != 1)
    return learn_quality(table(spark, sf_dir, "documents"), labels)


@query("op5_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 3) == 1)
    scored = score_quality(docs, quality_model(spark, sf_dir), keep=["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op1_substring_dedup", rf"""
WITH docs AS (
  SELECT doc_id, {WORDS_SQL} AS words FROM documents
), windows AS (
  SELECT doc_id, unnest(range(len(words) - 49)) AS pos, words FROM docs WHERE len(words) >= 50
), keyed AS (
  SELECT doc_id, pos, md5(array_to_string(words[pos + 1 : pos + 50], ' ')) AS k FROM windows
), repeated AS (
  SELECT doc_id, pos FROM keyed QUALIFY min(doc_id) OVER (PARTITION BY k) < doc_id
), covered AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(pos, pos + 50)) AS p FROM repeated)
), gone AS (
  SELECT doc_id, list(p) AS ps FROM covered GROUP BY doc_id
), kept AS (
  SELECT d.doc_id, len(d.words) AS n_words, coalesce(len(g.ps), 0) AS n_removed,
         CASE WHEN g.ps IS NULL THEN d.words ELSE
           list_transform(list_sort(list_filter(list_transform(range(len(d.words)), lambda i: CASE WHEN list_contains(g.ps, i) THEN NULL ELSE i END), lambda i: i IS NOT NULL)), lambda i: d.words[i + 1]) END AS words
  FROM docs d LEFT JOIN gone g ON d.doc_id = g.doc_id
)
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(words, ' ')) AS kept_sha256 FROM kept""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    found = marked.select("doc_id", F.explode("contamination").alias("c"))
    return found.select("doc_id", "c.item_id", "c.start", "c.score", "c.question_overlap", "c.answer_overlap")


@query("op10_near_duplicates", rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_transform({WORDS_SQL}, lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS words FROM documents
), shingled AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
           ELSE list_transform(range(len(words) - 4), lambda i: array_to_string(words[i + 1 : i + 5], ' ')) END) AS shingles
  FROM docs
), cells AS (
  SELECT doc_id, md5(unnest(shingles)) AS s FROM shingled
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM cells a JOIN cells b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN shingled x ON x.doc_id = a JOIN shingled y ON y.doc_id = b
  WHERE 100 * n >= 85 * (len(x.shingles) + len(y.shingles) - n)
), ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS v, doc_id AS w FROM docs UNION SELECT r.v, t.b FROM reach r JOIN ways t ON r.w = t.a
), lowest AS (
  SELECT v, min(w) AS component_id FROM reach GROUP BY v
)
SELECT doc_id, len(shingles)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM shingled JOIN lowest ON v = doc_id""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@query("op7_lm_scores")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("train", fold("doc_id", 5) != 1)
    scored = score_texts(docs, "train")
    return scored.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"
    )


@query("op3_license_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", F.explode("licenses").alias("l"))
    return found.select("doc_id", "l.template", "l.start", "l.stop", "l.matched", "l.coverage")


# Scores are sums of whole numbers below 2^53, exact as doubles.
@query("op11_hard_negatives", """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS alike, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, (row_number() OVER best)::INT AS rank, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.alike
  AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
WINDOW best AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER best <= 3""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label").filter(USABLE_VECTOR + " and label is not null")
    label = F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    rows = rows.select(F.col("vec_id").alias("id"), label.alias("label"), F.expr(WHOLE_NUMBERS).alias("vector"))
    return mine_negatives(rows, rows.filter("id % 50 = 0").select("id"))


@query("op13_toxicity")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 5) == 0)
    model = learn_toxicity(docs, table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0))
    scored = score_toxicity(docs, model, keep=["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op12_phrases", r"""
WITH pieces AS (
  SELECT doc_id, lang, words, row_number() OVER () AS piece FROM (
    SELECT doc_id, coalesce(lang, 'und') AS lang,
           unnest(list_transform(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]'),
                                 lambda p: regexp_extract_all(p, '[^\x20\x09]+'))) AS words
    FROM documents)
), grams AS (
  SELECT lang, m, array_to_string(words[i : i + m - 1], ' ') AS phrase
  FROM (SELECT lang, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM pieces, (VALUES (1), (2), (3), (4)) s(m))
), counted AS (
  SELECT lang, phrase, m, count(*) AS a FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(a)::BIGINT AS n FROM counted WHERE m = 1 GROUP BY lang
), candidates AS (
  SELECT lang, phrase, m, a, string_split(phrase, ' ') AS w FROM counted WHERE m > 1 AND a >= 30
), sides AS (
  SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 : m], ' ') AS tail
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates)
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a) // (x.a::HUGEINT + y.a) AS score
  FROM sides c JOIN counted x ON x.lang = c.lang AND x.phrase = c.head JOIN counted y ON y.lang = c.lang AND y.phrase = c.tail
), weakest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), within_longer AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(w[i : i + s - 1], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM candidates))
  ) GROUP BY ALL
), ranked AS (
  SELECT t.*, row_number() OVER (PARTITION BY t.lang ORDER BY score DESC, a DESC, t.phrase) AS rank
  FROM weakest t LEFT JOIN within_longer i ON i.lang = t.lang AND i.phrase = t.phrase
  WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * t.a
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))
