"""Asking questions with the log of earlier findings at hand."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from plumbline.functions.columns import literal_table
from plumbline.operators.history import context_retrieval, enhanced_question, insight_rows, session_rows
from plumbline.plans.answers import Answer, answer, as_rows
from plumbline.sources.catalog import Log

SESSION = {
    "dataset": "string", "session_id": "bigint", "ts": "timestamp_ntz", "original_input": "string", "question": "string",
    "answer": "string", "key_finding": "string", "context_used": "int", "had_visualization": "boolean",
}


def answer_text(a: Answer) -> DataFrame:
    """The result of an answer, a few statistics, as one text `(answer)`."""
    lines = as_rows(a.result, a.method, a.columns).select(F.concat_ws("=", "statistic", "value").alias("line"))
    text = F.array_join(F.array_sort(F.collect_list("line")), "; ")
    head = f"{a.method} of {', '.join(a.columns) or 'the table'}. "
    return lines.agg(F.concat(F.lit(head), text).alias("answer"))


def stored_sessions(log: Log, df: DataFrame) -> DataFrame:
    """The kept sessions, none before the first one."""
    try:
        return log.sessions()
    except AnalysisException:
        return literal_table(df, [], SESSION)


def ask(
    df: DataFrame, dataset: str, question: str, log: Log, typed_as: str | None = None, at: dt.datetime | None = None
) -> tuple[Answer, DataFrame]:
    """Answer a question, log it with its findings, and return the answer with its context.

    `typed_as` is what the user entered when that was not the question itself, such as its number.
    """
    at = at or dt.datetime.now()
    number = int((at - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    asked = literal_table(df, [(number, dataset, question)], {"q_id": "bigint", "dataset": "string", "question": "string"})
    context = context_retrieval(asked, stored_sessions(log, df))
    found = enhanced_question(asked, context)
    a = answer(df, question)
    row = answer_text(a).select(
        F.lit(dataset).alias("dataset"), F.lit(number).cast("bigint").alias("session_id"),
        F.lit(at).cast("timestamp_ntz").alias("ts"), F.lit(typed_as or question).alias("original_input"),
        F.lit(question).alias("question"), "answer", F.lit(context.count()).cast("int").alias("context_used"),
        F.lit(a.chart is not None).alias("had_visualization"),
    )
    session = session_rows(row).select(*SESSION)
    log.append("sessions", session)
    log.append("insights", insight_rows(session))
    return a, found
