"""The log of analysis sessions and findings: retention, retrieval, search, matching, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.text import key_finding, words
from plumbline.operators.classify import question_topics
from plumbline.operators.joins import salted_join
from plumbline.operators.stats import latest

KEEP_SESSIONS = 20
KEEP_INSIGHTS = 5


def newest(*columns: str) -> list[Column]:
    return [F.desc(c) for c in columns]


def retain_sessions(sessions: DataFrame, k: int = KEEP_SESSIONS) -> DataFrame:
    return latest(sessions, ["dataset"], newest("ts", "session_id"), k)


def retain_insights(insights: DataFrame, k: int = KEEP_INSIGHTS) -> DataFrame:
    return latest(insights, ["dataset", "topic"], newest("ts", "session_id"), k)


def session_rows(answers: DataFrame) -> DataFrame:
    """Answers `(dataset, session_id, ts, question, answer, …)` completed to session rows."""
    return answers.withColumn("key_finding", key_finding(F.col("answer")))


def insight_rows(sessions: DataFrame) -> DataFrame:
    """One finding per session and topic of its question."""
    topics = question_topics(sessions.select("dataset", "session_id", "ts", "question", "answer"))
    return topics.select("dataset", "topic", key_finding(F.col("answer")).alias("insight"), "question", "ts", "session_id")


def context_retrieval(questions: DataFrame, sessions: DataFrame, k: int = 3) -> DataFrame:
    """For each question the k latest sessions of its dataset that share a word with it.

    A session that is among the k latest for a question is among the k latest for one of its words,
    so k sessions per (dataset, word) are enough: no word, however frequent, meets more than k.
    Returns `(q_id, rank, …)` from oldest to newest.
    """
    spoken = F.array_distinct(words(F.lower("question")))
    said = sessions.select("dataset", "session_id", "ts", F.explode(spoken).alias("word"))
    recent = latest(said, ["dataset", "word"], newest("ts", "session_id"), k)
    asked = questions.select("q_id", "dataset", F.explode(spoken).alias("word"))
    shared = salted_join(asked, recent, ["dataset", "word"], ["q_id"]).groupBy("q_id", "dataset", "session_id", "ts").agg(F.lit(1).alias("one"))
    best = latest(shared, ["q_id"], newest("ts", "session_id"), k).drop("one")
    return best.join(sessions.select("dataset", "session_id", "question", "key_finding"), ["dataset", "session_id"])


def enhanced_question(questions: DataFrame, context: DataFrame) -> DataFrame:
    """The question followed by its numbered earlier findings, oldest first."""
    found = F.array_sort(F.collect_list(F.struct("ts", "session_id", "question", "key_finding")))
    # At most k findings per question.
    listed = context.groupBy("q_id").agg(found.alias("__found"))
    lines = F.transform(
        "__found",
        lambda f, i: F.concat(
            (i + 1).cast("string"), F.lit(". From '"), f["question"], F.lit("': "), f["key_finding"], F.lit("\n")
        ),
    )
    # The text around the findings.
    text = F.concat(
        F.col("question"), F.lit("\nRelevant previous findings:\n"), F.array_join(lines, ""),
        F.lit("\nPlease consider these previous findings when answering."),
    )
    joined = questions.join(listed, "q_id", "left")
    return joined.withColumn("enhanced", F.coalesce(text, F.col("question"))).drop("__found")


def topic_search(
    insights: DataFrame, sessions: DataFrame, terms: list[str], k_insights: int = 5, k_sessions: int = 3
) -> DataFrame:
    """Latest findings and sessions per dataset and search term.

    The terms are an argument of the call; each row is tested against them where it lies.
    """

    def hits(*texts: Column) -> Column:
        def holds(term: Column) -> Column:
            found = F.lit(False)
            for t in texts:
                found = found | F.contains(F.coalesce(F.lower(t), F.lit("")), F.lower(term))
            return found

        return F.explode(F.filter(F.array(*[F.lit(t) for t in terms]), holds))

    a = insights.withColumn("term", hits(F.col("topic")))
    a = latest(a, ["dataset", "term"], [*newest("ts", "session_id"), F.col("topic")], k_insights)
    b = sessions.withColumn("term", hits(F.col("question"), F.col("key_finding")))
    b = latest(b, ["dataset", "term"], newest("ts", "session_id"), k_sessions)
    return a.select(
        F.lit("insight").alias("kind"), "dataset", "term", "ts", "session_id", "question", F.col("insight").alias("finding")
    ).unionByName(
        b.select(
            F.lit("session").alias("kind"), "dataset", "term", "ts", "session_id", "question",
            F.col("key_finding").alias("finding"),
        )
    )


def artifact_parts(artifacts: DataFrame, path: str = "path") -> DataFrame:
    """Dataset and time from names like `<dataset>_yyyyMMdd_HHmmss.png`; other names drop out."""
    name = F.regexp_extract(F.col(path), r"([^/]*)$", 1)
    stamp = F.regexp_extract(name, r"_(\d{8}_\d{6})", 1)
    return (
        artifacts.withColumn("dataset", F.regexp_extract(name, r"^(.*?)_\d{8}_\d{6}", 1))
        .withColumn("made", F.try_to_timestamp(stamp, F.lit("yyyyMMdd_HHmmss")).cast("timestamp_ntz"))
        .filter(F.col("made").isNotNull())
    )


def match_artifacts(sessions: DataFrame, artifacts: DataFrame, tolerance: int = 120) -> DataFrame:
    """The artefact of each session: same second, else nearest within the tolerance, else none.

    Artefacts are thinned to one per second and laid out in buckets as long as the tolerance, each
    bucket with its neighbours: at most three times `tolerance` entries, whatever the data. A
    session then meets the one row of its bucket.
    """
    seconds = F.unix_seconds(F.col("made").cast("timestamp"))
    parts = artifacts.select("dataset", seconds.alias("s"), "path")
    single = parts.groupBy("dataset", "s").agg(F.min("path").alias("path"))
    home = F.floor(F.col("s") / tolerance)
    near = single.select(
        "dataset", "s", "path", F.explode(F.array(home - 1, home, home + 1)).alias("bucket")
    )
    buckets = near.groupBy("dataset", "bucket").agg(F.collect_list(F.struct("s", "path")).alias("near"))
    at = F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp")))
    placed = sessions.withColumn("__s", at).withColumn("bucket", F.floor(F.col("__s") / tolerance))
    joined = salted_join(placed, buckets, ["dataset", "bucket"], ["session_id"], "left")
    scored = F.transform(
        "near", lambda a: F.struct(F.abs(a["s"] - F.col("__s")).alias("apart"), a["path"].alias("path"))
    )
    best = F.array_min(F.filter(scored, lambda a: a["apart"] <= tolerance))
    return (
        joined.withColumn("__best", best)
        .select(*sessions.columns, F.col("__best.path").alias("path"), F.col("__best.apart").alias("seconds_apart"))
    )


def recent_artifacts(artifacts: DataFrame, k: int = 5) -> DataFrame:
    """The newest artefacts per dataset."""
    return latest(artifacts, ["dataset"], [F.desc("modified"), F.col("path")], k)


def catalog_info(catalog: DataFrame, sizes: DataFrame, profiles: DataFrame, questions: DataFrame, insights: DataFrame) -> DataFrame:
    """Per dataset its shape, column names, and what is known about it.

    `sizes` is `(dataset, n_rows)`; the other frames need a `dataset` column each.
    """
    columns = catalog.groupBy("dataset").agg(
        F.count("*").alias("n_cols"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column_name"))), lambda c: c["column_name"]), ",").alias("columns"),
    )

    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("dataset").agg(F.count("*").alias(name))

    joined = (
        columns.join(sizes, "dataset", "left")
        .join(counts(profiles, "__profiles"), "dataset", "left")
        .join(counts(questions, "__questions"), "dataset", "left")
        .join(counts(insights, "num_insights"), "dataset", "left")
    )
    return joined.select(
        "dataset", "n_rows", "n_cols", "columns",
        F.col("__profiles").isNotNull().alias("has_profile"), F.col("__questions").isNotNull().alias("has_questions"),
        F.coalesce("num_insights", F.lit(0)).alias("num_insights"),
    )


def catalog_summary(datasets: DataFrame, questions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Questions and sessions per dataset with its domain; the row without dataset holds the totals."""
    asked = questions.groupBy("dataset").agg(F.count("*").alias("questions"))
    held = sessions.groupBy("dataset").agg(F.count("*").alias("history"))
    per = (
        datasets.select("dataset", "domain")
        .join(asked, "dataset", "left")
        .join(held, "dataset", "left")
        .select(
            "dataset", F.coalesce("domain", F.lit("Unknown")).alias("domain"),
            F.coalesce("questions", F.lit(0)).alias("questions"), F.coalesce("history", F.lit(0)).alias("history"),
        )
    )
    return per.groupingSets(
        [["dataset", "domain"], []], "dataset", "domain"
    ).agg(F.count("*").alias("datasets"), F.sum("questions").alias("questions"), F.sum("history").alias("history"))


def dataset_listing(records: DataFrame, questions: DataFrame, sessions: DataFrame, insights: DataFrame, k: int = 3) -> DataFrame:
    """Each dataset with its file, load time and shape, what was asked of it, and its k main topics.

    `records` is `(dataset, file_path, load_time, n_rows, n_cols)`; the other frames are summed per
    dataset before they are joined. `topics` lists `topic (findings)`, most findings first.
    """
    asked = questions.groupBy("dataset").agg(F.count("*").alias("questions"))
    held = sessions.groupBy("dataset").agg(F.count("*").alias("history"))
    per = insights.groupBy("dataset", "topic").agg(F.count("*").alias("n"))
    main = latest(per, ["dataset"], [F.desc("n"), F.col("topic")], k)
    # At most k topics per dataset.
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "topic"))), lambda x: F.concat(x["topic"], F.lit(" ("), (-x["n"]).cast("string"), F.lit(")")))
    topics = main.groupBy("dataset").agg(F.array_join(listed, ", ").alias("topics"))
    joined = records.join(asked, "dataset", "left").join(held, "dataset", "left").join(topics, "dataset", "left")
    return joined.select(
        "dataset", "file_path", "load_time", "n_rows", "n_cols", F.coalesce("questions", F.lit(0)).alias("questions"),
        F.coalesce("history", F.lit(0)).alias("history"), F.coalesce("topics", F.lit("")).alias("topics"),
    )
