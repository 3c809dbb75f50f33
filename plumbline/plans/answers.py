"""From a question to statistics and chart data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from plumbline.functions.columns import adjusted_skew, col, literal_table, number, numeric_columns, present, string_columns
from plumbline.functions.text import plain_question
from plumbline.operators import charts, classify, corpus, stats
from plumbline.session import materialized


@dataclass
class Answer:
    """Statistics and, where asked for, the data of a chart."""

    question: str
    method: str
    columns: list[str]
    result: DataFrame
    chart: DataFrame | None = None
    chart_kind: str | None = None


@dataclass
class Decision:
    """What the word rules say about a question."""

    wants_chart: bool
    chart: str
    analysis: str


def decide(df: DataFrame, question: str) -> Decision:
    """The rules of `classify` for one question; a one-row projection that needs no job."""
    counts = [F.lit(len(numeric_columns(df))), F.lit(len(string_columns(df)))]
    row = literal_table(df, [(question,)], {"question": "string"}).select(
        classify.wants_chart(F.col("question")).alias("wants_chart"),
        classify.chart_kind(F.col("question"), *counts).alias("chart"), classify.analysis_kind(*counts).alias("analysis"),
    )
    return Decision(**row.first().asDict())


def find_column(question: str, columns: list[str]) -> str | None:
    """The first column named in the question, else the first."""
    return next((c for c in columns if c.lower() in question.lower()), columns[0] if columns else None)


def relevant_columns(numbers: list[str], strings: list[str], k: int = 3) -> list[str]:
    return (numbers + strings)[:k]


def question_chart(df: DataFrame, question: str, kind: str) -> DataFrame | None:
    """The data of a chart of that kind, on the columns that the question names."""
    number = find_column(question, numeric_columns(df))
    if kind == "comparison":
        return charts.chart_data(df, kind, find_column(question, string_columns(df)), number)
    return charts.chart_data(df, kind, y=number if kind == "distribution" else None)


def _pick(wanted: list[str], among: list[str]) -> str | None:
    return next((c for c in wanted if c in among), among[0] if among else None)


def choose(
    df: DataFrame, question: str, kind: str | None = None, columns: list[str] | None = None, chart: str | None = None
) -> tuple[str, list[str], str | None]:
    """Analysis, its columns and the chart kind, if one is wanted, for a question."""
    numbers, strings = numeric_columns(df), string_columns(df)
    rules = decide(df, question)
    kind = kind or rules.analysis
    wanted = columns or relevant_columns(numbers, strings)
    drawn = chart or (rules.chart if rules.wants_chart else None)
    number, category = _pick(wanted, numbers), _pick(wanted, strings)
    chosen = [c for c in wanted if c in numbers]
    if kind == "correlation" and len(chosen) >= 2:
        return kind, chosen, drawn
    if kind in ("distribution", "aggregation") and number:
        return kind, [number], drawn
    if kind == "comparison" and number and category:
        return kind, [category, number], drawn
    if wanted and wanted[0] in numbers:
        return "basic", [wanted[0]], drawn
    return "overview", [], drawn


def _result(df: DataFrame, method: str, columns: list[str]) -> DataFrame:
    if method == "correlation":
        return stats.corr_findings(stats.corr_matrix(df, columns))
    if method == "distribution":
        return stats.distribution(df, *columns)
    if method == "comparison":
        return stats.compare_summary(stats.group_compare(df, *columns))
    if method == "aggregation":
        return stats.basic_stats(df, columns)
    if method == "basic":
        return stats.basic_column(df, *columns)
    return df.agg(F.count("*").alias("records")).select(
        "records", F.lit(len(df.columns)).alias("features"), F.lit(len(numeric_columns(df))).alias("numeric"),
        F.lit(len(string_columns(df))).alias("categorical"),
    )


def answer(
    df: DataFrame, question: str, kind: str | None = None, columns: list[str] | None = None, chart: str | None = None
) -> Answer:
    """Answer a question on a table; kind, columns and chart kind default to the word rules.

    A chart comes with the answer if the question asks for one or `chart` names its kind
    (correlation, distribution, comparison, scatter or trend).
    """
    method, chosen, drawn = choose(df, question, kind, columns, chart)
    data = question_chart(df, question, drawn) if drawn else None
    return Answer(question, method, chosen, _result(df, method, chosen), data, None if data is None else drawn)


# Words that choose the analysis of a text collection.
TEXT_ANALYSES = {
    "frequency": ["word", "keyword", "frequency"],
    "cloud": ["cloud", "overview", "summary"],
    "sentiment": ["sentiment", "tone", "positive", "negative"],
}


def text_analysis_kind(question: str) -> str:
    q = question.lower()
    return next((kind for kind, words in TEXT_ANALYSES.items() if any(w in q for w in words)), "corpus")


def answer_text(df: DataFrame, text: str, question: str) -> Answer:
    """Answer a question on a text collection."""
    kind = text_analysis_kind(question)
    if kind == "frequency":
        found = corpus.word_freq(df, text)
        return Answer(question, kind, [text], found, found)
    if kind == "cloud":
        found = charts.word_weights(df, text)
        return Answer(question, kind, [text], found, found)
    if kind == "sentiment":
        found = charts.sentiment_hist(df, text)
        return Answer(question, kind, [text], found, found)
    return Answer(question, kind, [text], corpus.corpus_stats(df, text), corpus.word_freq(df, text))


def as_rows(table: DataFrame, method: str, columns: list[str]) -> DataFrame:
    """A table as `(statistic, value)` lines, so that different kinds can be united."""
    cells = F.create_map(*[x for c in table.columns for x in (F.lit(c), F.col(c).cast("string"))])
    return table.select(F.explode(cells).alias("statistic", "value")).select(
        F.lit(method).alias("method"), F.lit(",".join(columns)).alias("columns"), "statistic", "value"
    )


def shared_results(df: DataFrame, wanted: list[tuple[str, tuple[str, ...]]]) -> dict[tuple, DataFrame]:
    """The results of many analyses `(method, columns)` of one table from scans that all of them share.

    Quartiles of all columns take the same few scans; one scan has all moments and counts, one all groups,
    one all correlations. The number of scans does not grow with the number of analyses.
    """
    of = {m: list(dict.fromkeys(c for method, columns in wanted if method == m for c in columns)) for m in ("distribution", "aggregation", "basic")}
    pairs = list(dict.fromkeys(columns for method, columns in wanted if method == "comparison"))
    linked = [c for c in numeric_columns(df) if any(c in columns for method, columns in wanted if method == "correlation")]
    found = stats.summaries(df, list(dict.fromkeys(of["distribution"] + of["aggregation"])))
    cells = [F.count("*").alias("rows")]
    for i, c in enumerate(of["distribution"]):
        q1, q3 = found[c]["q1"], found[c]["q3"]
        low, high = (None, None) if q1 is None else (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
        cells += [adjusted_skew(number(df, c)).alias(f"skew{i}"), F.count_if(stats.outside(number(df, c), low, high)).alias(f"outliers{i}")]
    for i, c in enumerate(of["basic"]):
        cells += [F.avg(number(df, c)).alias(f"mean{i}"), F.count_if(~present(df, c)).alias(f"missing{i}")]
    row = df.agg(*cells).first()
    groups = None
    if pairs:
        values = list(dict.fromkeys(v for _, v in pairs))
        keyed = F.explode(F.array(*[F.struct(F.lit(c).alias("by"), col(c).cast("string").alias("category")) for c in dict.fromkeys(c for c, _ in pairs)]))
        stacked = df.select(keyed.alias("key"), *[number(df, v).alias(f"v{i}") for i, v in enumerate(values)]).filter("key.category is not null")
        sums = [F.struct(F.avg(f"v{i}").alias("mean"), F.count(f"v{i}").alias("count"), F.stddev_samp(f"v{i}").alias("std")).alias(f"g{i}") for i in range(len(values))]
        groups = materialized(stacked.groupBy("key.by", "key.category").agg(*sums))
    matrix = materialized(stats.corr_matrix(df, linked)) if linked else None
    out = {}
    for method, columns in wanted:
        c = columns[0] if columns else None
        if method == "aggregation":
            out[method, columns] = literal_table(df, [(0, c, *[found[c][f] for f in stats.STATISTICS])], {"ordinal": "int", "column": "string", **stats.STATISTICS})
        elif method == "distribution":
            i, f = of["distribution"].index(c), found[c]
            cell = {"mean": "double", "median": "double", "std": "double", "skew": "double", "outliers": "bigint", "n": "bigint"}
            one = literal_table(df, [(f["mean"], f["median"], f["std"], row[f"skew{i}"], row[f"outliers{i}"], row["rows"])], cell)
            out[method, columns] = stats.distribution_row(one, c)
        elif method == "comparison":
            at = values.index(columns[1])
            out[method, columns] = stats.compare_summary(groups.filter(F.col("by") == c).select("category", f"g{at}.*"))
        elif method == "correlation":
            place = F.create_map(*[x for k, n in enumerate(columns) for x in (F.lit(n), F.lit(k))])
            own = matrix.filter(F.col("col1").isin(*columns) & F.col("col2").isin(*columns))
            out[method, columns] = stats.corr_findings(own.select(place[F.col("col1")].alias("i"), place[F.col("col2")].alias("j"), "col1", "col2", "r"))
        elif method == "basic":
            i = of["basic"].index(c)
            out[method, columns] = literal_table(df, [(c, row[f"mean{i}"], row["rows"], row[f"missing{i}"])], {"column": "string", "mean": "double", "records": "bigint", "missing": "bigint"})
        else:
            shape = (row["rows"], len(df.columns), len(numeric_columns(df)), len(string_columns(df)))
            out[method, columns] = literal_table(df, [shape], {"records": "bigint", "features": "int", "numeric": "int", "categorical": "int"})
    return out


def answer_multiple(
    df: DataFrame, questions: list[str], kinds: dict[str, str] | None = None, columns: dict[str, list[str]] | None = None
) -> DataFrame:
    """All questions on one table as `(question, method, columns, statistic, value)` rows.

    Chart data come as rows of method `chart <kind>`, a line per cell. The analyses of all questions share
    their scans. Should these fail, because one column cannot be read as it must be, each analysis is run
    by itself. A question that cannot be planned, or whose analysis or chart fails when run, becomes a row
    with method `error`; the others are answered. Results are computed when this is called.
    """
    planned, failed = {}, []
    for q in questions:
        try:
            planned[q] = choose(df, q, (kinds or {}).get(q), (columns or {}).get(q))
        except Exception as problem:  # one bad question must not stop the rest
            failed.append((q, "error", "", "message", str(problem)))
    wanted = list(dict.fromkeys((method, tuple(chosen)) for method, chosen, _ in planned.values()))
    try:
        results = shared_results(df, wanted)
    except Exception:  # which analysis is to blame shows when each runs alone
        results = {}
    asked: dict[tuple, list[str]] = {}
    charts_of: dict[tuple, tuple[str, str]] = {}
    for q, (method, chosen, drawn) in planned.items():
        asked.setdefault((method, tuple(chosen)), []).append(q)
        if drawn:
            named = (f"chart {drawn}", (find_column(q, numeric_columns(df)), find_column(q, string_columns(df))))
            asked.setdefault(named, []).append(q)
            charts_of[named] = (q, drawn)
    done = []
    for plan, said in asked.items():
        try:
            if plan in charts_of:
                data = question_chart(df, *charts_of[plan])
                rows = None if data is None else materialized(as_rows(data, plan[0], []))
            else:
                result = results.get(plan)
                rows = materialized(as_rows(_result(df, plan[0], list(plan[1])) if result is None else result, plan[0], list(plan[1])))
        except Exception as problem:
            failed += [(q, "error", "", "message", str(problem)[:1000]) for q in said]
            continue
        if rows is not None:
            done.append(rows.withColumn("question", F.explode(F.array(*[F.lit(q) for q in said]))))
    names = ["question", "method", "columns", "statistic", "value"]
    out = literal_table(df, failed, {n: "string" for n in names})
    for rows in done:
        out = out.unionByName(rows)
    return out.withColumn("question", plain_question(F.col("question")))


def dataset_metrics(df: DataFrame, name: str, folder: str, refresh: bool = False) -> dict[str, DataFrame]:
    """Statistics and correlations of a dataset, computed once and kept as tables under a shared folder.

    `refresh` computes them again, for data that have changed.
    """
    spark = df.sparkSession
    compute = {"basic_stats": stats.basic_stats, "corr_matrix": stats.corr_matrix}
    out = {}
    for kind, fn in compute.items():
        path = f"{folder}/{name}/{kind}"
        if refresh:
            fn(df).write.mode("overwrite").parquet(path)
        try:
            out[kind] = spark.read.parquet(path)
        except AnalysisException:  # not kept yet
            fn(df).write.mode("errorifexists").parquet(path)
            out[kind] = spark.read.parquet(path)
    return out
