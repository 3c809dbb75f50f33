"""The tables a report is laid out from."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.columns import col, long_table, number, numeric_columns, present, string_columns
from plumbline.functions.text import plain_answer, plain_question
from plumbline.operators import profile, stats
from plumbline.operators.history import match_artifacts, recent_artifacts
from plumbline.operators.profile import top_values


def session_report(sessions: DataFrame, artifacts: DataFrame | None = None) -> DataFrame:
    """Sessions in order with plain answers, and the chart file of those that had one."""
    rows = sessions.select(
        "dataset", "session_id", "ts", plain_question(F.col("question")).alias("question"),
        plain_answer(F.col("answer")).alias("answer"), "key_finding", "context_used", "had_visualization",
    )
    if artifacts is None:
        return rows
    shown = match_artifacts(rows, artifacts)
    return shown.withColumn("path", F.when(F.col("had_visualization"), F.col("path"))).drop("seconds_apart")


def feature_table(df: DataFrame, k: int = 10) -> DataFrame:
    """Type, missing and distinct values, mean and deviation of the first k columns.

    One aggregation beside the distinct counts; nothing else of a profile is computed.
    """
    shown = df.select(*[col(c) for c in df.columns[:k]])
    numbers = numeric_columns(shown)
    aggregates = []
    for i, c in enumerate(shown.columns):
        x = number(shown, c) if c in numbers else F.lit(None).cast("double")
        aggregates += [
            F.lit(shown.schema[c].dataType.simpleString()).alias(f"dtype__{i}"),
            F.count_if(~present(shown, c)).alias(f"num_missing__{i}"), F.avg(x).alias(f"mean__{i}"), F.stddev_samp(x).alias(f"std__{i}"),
        ]
    fields = {"dtype": "string", "num_missing": "bigint", "mean": "double", "std": "double"}
    rows = long_table(shown.agg(*aggregates), shown.columns, fields)
    # One row per column.
    joined = rows.join(F.broadcast(profile.nunique(shown).drop("ordinal")), "column")
    return joined.select("ordinal", "column", "dtype", "num_missing", "num_unique", "mean", "std")


def report_stats(df: DataFrame, k: int = 5) -> DataFrame:
    """Mean, deviation and extremes of the first k numeric columns, in one scan."""
    return stats.moments(df, numeric_columns(df)[:k])


def data_context(df: DataFrame, k: int = 5, top: int = 3) -> DataFrame:
    """A short description of the first numeric and categorical columns, long form."""
    numbers, strings = numeric_columns(df)[:k], string_columns(df)[:k]
    out = None
    if numbers:
        out = stats.moments(df, numbers).select(
            F.lit("numeric").alias("kind"), "column", "mean", "std", "min", "max",
            F.lit(None).cast("bigint").alias("num_unique"), F.lit(None).cast("string").alias("top"),
        )
    if strings:
        unique = profile.nunique(df, strings).select("column", "num_unique")
        best = top_values(df, strings, top).groupBy("column").agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))), lambda v: F.concat(v["value"], F.lit("="), v["n"])),
                ", ",
            ).alias("top")
        )
        nothing = [F.lit(None).cast("double").alias(c) for c in ("mean", "std", "min", "max")]
        block = unique.join(best, "column", "left").select(
            F.lit("categorical").alias("kind"), "column", *nothing, "num_unique", "top"
        )
        out = block if out is None else out.unionByName(block)
    if out is None:
        raise ValueError("no numeric or categorical column")
    return out


def report_tables(
    df: DataFrame,
    questions: DataFrame | None = None,
    sessions: DataFrame | None = None,
    artifacts: DataFrame | None = None,
    shown_questions: int = 8,
) -> dict[str, DataFrame]:
    """All tables of the report on one dataset."""
    tables = {
        "overview": profile.overview(df),
        "features": feature_table(df),
    }
    if numeric_columns(df):
        tables["statistics"] = report_stats(df)
    if questions is not None:
        clean = questions.orderBy("position").limit(shown_questions)
        tables["questions"] = clean.withColumn("question", plain_question(F.col("question")))
    if sessions is not None:
        pictures = None if artifacts is None else artifacts.filter(F.col("path").endswith(".png"))
        tables["sessions"] = session_report(sessions, pictures)
    if artifacts is not None and "modified" in artifacts.columns:
        tables["artifacts"] = recent_artifacts(artifacts.filter(F.col("path").endswith(".html")))
    return tables


def basic_report(df: DataFrame, answers: DataFrame) -> dict[str, DataFrame]:
    """Profile and answers only."""
    return {"features": feature_table(df), "answers": answers}
