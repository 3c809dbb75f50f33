"""Classification of texts, tables and questions by word rules, and suggested questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.columns import col
from plumbline.functions.search import phrase_places
from plumbline.functions.text import bind
from plumbline.operators import rules as R
from plumbline.operators.joins import frequent_join
from plumbline.operators.stats import latest


def mentions(text: Column, phrases: list[str]) -> Column:
    """True where a lower-case text contains any of the phrases."""
    return reduce(lambda a, b: a | b, [text.contains(p) for p in phrases])


PHRASES = sorted({p for group in R.TEXT_DOMAINS.values() for p in group})


def _domain_of(found: Column) -> Column:
    """The domain with most of the found phrases, at least two; ties go to the earlier one."""

    def score(rank: int, name: str, group: list[str]) -> Column:
        hits = F.size(F.array_intersect(found, F.array(*[F.lit(PHRASES.index(p)) for p in group])))
        return F.struct((-hits).alias("found"), F.lit(rank).alias("rank"), F.lit(name).alias("name"))

    best = F.array_min(F.array(*[score(i, n, g) for i, (n, g) in enumerate(R.TEXT_DOMAINS.items())]))
    return bind(best, lambda b: F.when(b["found"] <= -2, b["name"]).otherwise(R.TEXT_DOMAIN_DEFAULT))


def text_domain(df: DataFrame, text: str) -> DataFrame:
    """Adds `domain`: the one with most phrases found anywhere in the text, at least two."""
    found = df.withColumn("__found", phrase_places(F.lower(col(text)), PHRASES))
    return found.withColumn("domain", _domain_of(F.col("__found"))).drop("__found")


def corpus_domain(df: DataFrame, text: str) -> DataFrame:
    """One row `(domain, content_length, chunks)` for all texts together.

    Every text is searched in whole; only the phrases met, a fixed list, are brought together.
    """
    met = df.select(F.length(col(text)).alias("size"), phrase_places(F.lower(col(text)), PHRASES).alias("found"))
    one_each = met.select("size", F.posexplode_outer("found").alias("pos", "phrase"))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    row = one_each.agg(
        F.coalesce(F.sum(F.when(first, F.col("size"))), F.lit(0)).alias("content_length"),
        F.count_if(first).alias("chunks"),
        F.collect_set("phrase").alias("found"),
    )
    return row.select(_domain_of(F.col("found")).alias("domain"), "content_length", "chunks")


def _names_mention(catalog: DataFrame, rule_sets: dict[str, list[str]]) -> DataFrame:
    """Per dataset one flag per rule: do the blank-joined lower-case column names contain a phrase?

    Names are tested where they are, so only flags are shuffled and a very wide table stays cheap.
    A two-word phrase may also span two neighbouring columns; those are matched by position.
    """
    name = F.lower("column_name")
    flags = {f"__rule{i}": mentions(name, phrases) for i, phrases in enumerate(rule_sets.values())}
    phrases = sorted({p for group in rule_sets.values() for p in group if " " in p})
    inside = catalog.groupBy("dataset").agg(*[F.bool_or(f).alias(n) for n, f in flags.items()])
    if not phrases:
        return inside
    halves = {p: p.split(" ", 1) for p in phrases}
    ends = F.array(*[name.endswith(a) for a, _ in halves.values()])
    starts = F.array(*[name.startswith(b) for _, b in halves.values()])
    none = F.array(*[F.lit(False) for _ in phrases])
    sides = catalog.select(
        "dataset",
        F.explode(
            F.array(
                F.struct(F.col("ordinal").alias("gap"), ends.alias("left"), none.alias("right")),
                F.struct((F.col("ordinal") - 1).alias("gap"), none.alias("left"), starts.alias("right")),
            )
        ).alias("s"),
    ).select("dataset", "s.*")
    sides = sides.filter(F.exists("left", lambda x: x) | F.exists("right", lambda x: x))
    gaps = sides.groupBy("dataset", "gap").agg(
        *[(F.bool_or(F.col("left")[i]) & F.bool_or(F.col("right")[i])).alias(f"__span{i}") for i in range(len(phrases))]
    )
    spans = gaps.groupBy("dataset").agg(*[F.bool_or(f"__span{i}").alias(f"__span{i}") for i in range(len(phrases))])
    joined = inside.join(spans, "dataset", "left")
    for r, group in enumerate(rule_sets.values()):
        for i, p in enumerate(phrases):
            if p in group:
                joined = joined.withColumn(f"__rule{r}", F.col(f"__rule{r}") | F.coalesce(f"__span{i}", F.lit(False)))
    return joined


def _first_rule(flagged: DataFrame, rule_sets: dict[str, list[str]], default: str) -> DataFrame:
    names = list(rule_sets)
    verdict = F.when(F.col("__rule0"), names[0])
    for i, n in enumerate(names[1:], 1):
        verdict = verdict.when(F.col(f"__rule{i}"), n)
    return flagged.select("dataset", verdict.otherwise(default).alias("domain"))


def table_domain(catalog: DataFrame) -> DataFrame:
    """Domain per dataset from its column names; the first rule that fits wins.

    `catalog` holds `(dataset, ordinal, column_name, kind)` with ordinals counted without gaps.
    """
    return _first_rule(_names_mention(catalog, R.TABLE_DOMAINS), R.TABLE_DOMAINS, R.TABLE_DOMAIN_DEFAULT)


def question_topics(df: DataFrame, question: str = "question") -> DataFrame:
    """One row per question and topic; `general` where no topic word occurs."""
    hits = bind(F.lower(col(question)), lambda q: F.array_compact(F.array(*[F.when(mentions(q, words), F.lit(t)) for t, words in R.TOPICS.items()])))
    topics = F.when(F.size("__hits") > 0, F.col("__hits")).otherwise(F.array(F.lit(R.TOPIC_DEFAULT)))
    return df.withColumn("__hits", hits).withColumn("topic", F.explode(topics)).drop("__hits")


def wants_chart(question: Column) -> Column:
    return bind(F.lower(question), lambda q: mentions(q, R.CHART_WORDS))


def chart_kind(question: Column, numeric: Column, categorical: Column) -> Column:
    """Chart kind from the words of a question and the number of columns of each kind."""
    q = F.lower(question)
    compares = q.contains("compare") | q.contains("difference")
    return (
        F.when(q.contains("correlation") & (numeric >= 2), "correlation")
        .when(q.contains("distribution") & (numeric >= 1), "distribution")
        .when(compares & (categorical >= 1) & (numeric >= 1), "comparison")
        .when(numeric >= 1, "distribution")
        .otherwise("summary")
    )


def analysis_kind(numeric: Column, categorical: Column) -> Column:
    """Analysis from the kinds of columns at hand."""
    return (
        F.when((categorical >= 1) & (numeric >= 1), "comparison")
        .when(numeric >= 2, "correlation")
        .when(numeric >= 1, "distribution")
        .otherwise("aggregation")
    )


def question_intent(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per question: is a chart wanted, which kind, and which analysis.

    A question on a dataset that the catalog lacks is one on a dataset without columns.
    """
    kinds = catalog.groupBy("dataset").agg(
        F.count_if(F.col("kind") == "numeric").alias("__numeric"),
        F.count_if(F.col("kind") == "categorical").alias("__categorical"),
    )
    joined = frequent_join(questions, kinds, ["dataset"], ["question"], "left")
    numeric, categorical = (F.coalesce(c, F.lit(0)) for c in ("__numeric", "__categorical"))
    return joined.select(
        *questions.columns,
        wants_chart(F.col("question")).alias("wants_chart"),
        chart_kind(F.col("question"), numeric, categorical).alias("chart"),
        analysis_kind(numeric, categorical).alias("analysis"),
    )


def relevant_columns(catalog: DataFrame, k: int = 3) -> DataFrame:
    """The first k columns per dataset, numeric ones before categorical ones."""
    usable = catalog.filter(F.col("kind").isin("numeric", "categorical"))
    first_numeric = (F.col("kind") != "numeric").cast("int")
    return latest(usable, ["dataset"], [first_numeric, F.col("ordinal")], k)


def suggest_questions(catalog: DataFrame, n: int = 10, domain: str | None = None) -> DataFrame:
    """n questions per dataset `(dataset, position, question)`.

    Ten templates by domain come first, then one question per column with rotating templates. A known
    `domain` takes the place of the rule on column names.
    """
    if domain is None:
        domains = _first_rule(
            _names_mention(catalog, R.SUGGESTION_DOMAINS), R.SUGGESTION_DOMAINS, R.SUGGESTION_DOMAIN_DEFAULT
        )
    else:
        domains = catalog.select("dataset").distinct().withColumn("domain", F.lit(domain))
    fixed = len(R.GENERAL_QUESTIONS)

    def listed(texts: list[str]) -> Column:
        return F.array(*[F.lit(t) for t in texts[:n]])

    is_health = F.col("domain") != R.SUGGESTION_DOMAIN_DEFAULT
    templates = F.when(is_health, listed(R.HEALTH_QUESTIONS)).otherwise(listed(R.GENERAL_QUESTIONS))
    out = domains.select("dataset", F.posexplode(templates).alias("position", "question"))
    if n > fixed:
        first = latest(catalog, ["dataset"], [F.col("ordinal")], n - fixed)
        rotating = F.array(*[F.lit(t) for t in R.COLUMN_QUESTIONS])
        text = F.replace(
            F.get(rotating, F.col("ordinal") % len(R.COLUMN_QUESTIONS)), F.lit("{}"), F.col("column_name")
        )
        own = first.select("dataset", (F.col("ordinal") + fixed).cast("int").alias("position"), text.alias("question"))
        out = out.unionByName(own)
    return out.withColumn("position", F.col("position") + 1)
