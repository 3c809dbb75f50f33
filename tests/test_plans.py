import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.plans import answers, reports, sessions
from plumbline.sources.catalog import Log


@pytest.fixture(scope="module")
def sales(spark):
    rows = [(i, f"r{i % 3}", float(i % 3 * 10 + i % 7), float(i)) for i in range(90)]
    return spark.createDataFrame(rows, "id int, region string, price double, units double")


def test_answer_by_kind(sales):
    compared = answers.answer(sales, "Compare price by region", columns=["region", "price"])
    assert compared.method == "comparison" and compared.chart.count() == 3
    assert compared.result.first()["highest"] == "r2" and compared.result.first()["varies"]
    assert answers.answer(sales, "How large?", "correlation").result.count() == 1
    assert answers.answer(sales, "How large?", "correlation").chart is None
    assert answers.answer(sales, "Show the distribution", "distribution", ["price"]).chart.count() == 30
    assert answers.answer(sales, "mean?", "aggregation", ["units"]).result.first()["median"] == 44.5
    assert answers.answer(sales, "mean?", "correlation", ["units"]).method == "basic"
    assert answers.answer(sales.select("region"), "anything").result.first()["records"] == 90
    assert answers.find_column("what is UNITS", ["price", "units"]) == "units"


def test_answer_many_shares_plans_and_reports_errors(sales, monkeypatch):
    real = answers.choose

    def fragile(df, question, *rest):
        if "boom" in question:
            raise RuntimeError("no")
        return real(df, question, *rest)

    monkeypatch.setattr(answers, "choose", fragile)
    rows = answers.answer_multiple(sales, ["*a*?", "b?", "boom"]).collect()
    assert {r["question"] for r in rows} == {"a?", "b?", "boom"}
    assert [r["value"] for r in rows if r["method"] == "error"] == ["no"]
    assert len([r for r in rows if r["question"] == "a?"]) == 5


MANY = {
    "Spread of units?": ("distribution", ["units"]), "And price?": ("distribution", ["price"]), "Mean units?": ("aggregation", ["units"]),
    "Mean price?": ("aggregation", ["price"]), "By region?": ("comparison", ["region", "price"]), "Units by region?": ("comparison", ["region", "units"]),
    "Linked?": ("correlation", ["units", "price"]), "Plain?": ("other", ["units"]), "Shape?": ("other", ["region"]),
}


def test_shared_results_equal_single_ones(sales):
    kinds, columns = ({q: a[i] for q, a in MANY.items()} for i in (0, 1))
    got = answers.answer_multiple(sales, list(MANY), kinds, columns).collect()
    for q, (kind, chosen) in MANY.items():
        one = answers.answer(sales, q, kind, chosen)
        want = answers.as_rows(one.result, one.method, one.columns).collect()
        mine = {(r["method"], r["columns"], r["statistic"]): r["value"] for r in got if r["question"] == q and not r["method"].startswith("chart")}
        assert mine.keys() == {(r["method"], r["columns"], r["statistic"]) for r in want}, q
        for r in want:
            value = mine[r["method"], r["columns"], r["statistic"]]
            try:
                assert float(value) == pytest.approx(float(r["value"]), rel=1e-9), (q, r)
            except (TypeError, ValueError):
                assert value == r["value"], (q, r)


def test_scans_do_not_grow_with_the_questions(spark, sales, tmp_path):
    sales.write.parquet(f"{tmp_path}/sales")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    stored = spark.read.parquet(f"{tmp_path}/sales")
    seen = []
    for questions in (["Mean units?", "And price?", "By region?", "Linked?"], list(MANY)):
        before = read.value
        kinds, columns = ({q: MANY[q][i] for q in questions} for i in (0, 1))
        answers.answer_multiple(stored.mapInArrow(counted, stored.schema), questions, kinds, columns).collect()
        seen.append(read.value - before)
    assert seen[1] <= seen[0], seen


def test_a_failure_when_run_is_one_error_row(spark):
    df = spark.sql("SELECT cast(id AS double) AS good, CASE WHEN id < 50 THEN 1.0 ELSE raise_error('cannot be read') END AS bad FROM range(100)")
    df = df.selectExpr("good", "cast(bad AS double) AS bad")
    rows = answers.answer_multiple(df, ["a?", "b?", "c?"], {"a?": "aggregation", "b?": "aggregation", "c?": "distribution"}, {"a?": ["good"], "b?": ["bad"], "c?": ["good"]}).collect()
    assert {r["question"] for r in rows if r["method"] == "error"} == {"b?"} and "cannot be read" in next(r["value"] for r in rows if r["method"] == "error")
    assert next(r["value"] for r in rows if r["question"] == "a?" and r["statistic"] == "mean") == "49.5"
    assert next(r["value"] for r in rows if r["question"] == "c?" and r["statistic"] == "median") == "49.5"


def test_charts_show_the_columns_that_are_named(sales):
    shown = answers.answer(sales, "Show the distribution of units")
    assert shown.chart_kind == "distribution" and shown.chart.agg(F.max("high")).first()[0] == 89.0
    bars = answers.answer(sales, "Compare price by region").chart
    assert bars.columns == ["category", "mean"] and abs(bars.filter("category = 'r2'").first()["mean"] - sales.filter("region = 'r2'").agg(F.avg("price")).first()[0]) < 1e-9
    assert answers.answer(sales, "units?", chart="scatter").chart.columns == ["x", "y"]
    dated = sales.withColumn("order_date", F.expr("date'2024-01-15' + id"))
    assert answers.answer(dated, "trend of price", chart="trend").chart.count() == 4
    rows = answers.answer_multiple(sales, ["Show the distribution of units", "Show the distribution of price"])
    drawn = rows.filter("method = 'chart distribution'").groupBy("question").count().collect()
    assert {r["count"] for r in drawn} == {120} and len(drawn) == 2


def test_answer_text(spark):
    df = spark.createDataFrame([("good good day",), ("bad day",), (" ",)], "t string")
    assert answers.answer_text(df, "t", "word frequency?").result.first()["n"] == 2
    assert answers.answer_text(df, "t", "give an overview").result.columns == ["word", "n", "weight"]
    assert answers.answer_text(df, "t", "what is the tone").result.agg(F.sum("n")).first()[0] == 2
    other = answers.answer_text(df, "t", "how long?")
    assert other.result.first()["num_docs"] == 3 and other.chart.count() == 3


def test_report_tables(spark, sales):
    questions = spark.range(12).selectExpr("cast(id AS int) AS position", "concat('*q', id) AS question")
    sessions = spark.sql(
        "SELECT 'd' AS dataset, 1 AS session_id, timestamp_ntz'2024-01-01 00:00:00' AS ts, '*q?' AS question, '📊 A \n b' AS answer,"
        " 'A' AS key_finding, 0 AS context_used, true AS had_visualization"
    )
    files = spark.sql(
        "SELECT 'd' AS dataset, 'd_20240101_000005.png' AS path, timestamp_ntz'2024-01-01 00:00:05' AS made, timestamp'2024-01-01' AS modified"
        " UNION ALL SELECT 'd', 'd_20240101_000005.html', timestamp_ntz'2024-01-01 00:00:05', timestamp'2024-01-01'"
    )
    tables = reports.report_tables(sales, questions, sessions, files)
    assert set(tables) == {"overview", "features", "statistics", "questions", "sessions", "artifacts"}
    assert tables["questions"].count() == 8 and tables["questions"].first()["question"] == "q0"
    row = tables["sessions"].first()
    assert (row["question"], row["answer"], row["path"]) == ("q?", "A b", "d_20240101_000005.png")
    assert tables["artifacts"].count() == 1 and tables["statistics"].count() == 3
    assert reports.basic_report(sales, sessions)["features"].count() == 4


def test_metrics_are_kept(sales, tmp_path):
    first = answers.dataset_metrics(sales, "sales", str(tmp_path))
    again = answers.dataset_metrics(sales.limit(0), "sales", str(tmp_path))
    assert first["basic_stats"].count() == again["basic_stats"].count() == 3
    assert again["corr_matrix"].count() == 9


def test_asking_logs_and_finds_context(spark, sales, tmp_path):
    log = Log(spark, str(tmp_path / "log"))
    start = dt.datetime(2024, 5, 1, 10, 0, 0)
    first, alone = sessions.ask(sales, "sales", "Compare price by region", log, at=start)
    assert first.method == "comparison" and alone.first()["enhanced"] == "Compare price by region"
    _, found = sessions.ask(sales, "sales", "Show price by id", log, "2", start + dt.timedelta(minutes=1))
    assert "From 'Compare price by region': comparison of region, id" in found.first()["enhanced"]
    rows = log.sessions().orderBy("ts").collect()
    assert [(r["original_input"], r["context_used"], r["had_visualization"]) for r in rows] == [
        ("Compare price by region", 0, True), ("2", 1, True),
    ]
    assert rows[0]["ts"] == start and "highest=" in rows[0]["answer"]
    assert {r["topic"] for r in log.insights().collect()} == {"comparison", "general"}


def test_the_log_can_be_compacted(spark, tmp_path):
    log = Log(spark, str(tmp_path))
    for i in range(25):
        log.append("sessions", spark.sql(f"SELECT 'd' AS dataset, {i}L AS session_id, timestamp_ntz'2024-01-01 00:00:{i:02d}' AS ts"))
    log.compact("sessions")
    assert log.read("sessions").count() == 20 and len(list((tmp_path / "sessions" / "generations").glob("*/*.parquet"))) == 1
    log.sweep("sessions")
    assert log.read("sessions").count() == 20 and not list((tmp_path / "sessions" / "batches").glob("*"))
    log.append("sessions", spark.sql("SELECT 'd' AS dataset, 99L AS session_id, timestamp_ntz'2024-01-02 00:00:00' AS ts"))
    assert {r["session_id"] for r in log.sessions().collect()} == set(range(6, 25)) | {99}


def test_compaction_loses_nothing_when_killed_or_raced(spark, tmp_path, monkeypatch):
    def session(i):
        return spark.sql(f"SELECT 'd' AS dataset, {i}L AS session_id, timestamp_ntz'2024-01-01 00:00:{i:02d}' AS ts")

    def ids():
        return {r["session_id"] for r in log.sessions().collect()}

    log, point = Log(spark, str(tmp_path)), Log._point
    for i in range(3):
        log.append("sessions", session(i))

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(Log, "_point", killed)
    with pytest.raises(KeyboardInterrupt):
        log.compact("sessions")
    assert ids() == {0, 1, 2}

    def raced(self, *args):
        # Another one appends, and then compacts, before this one's pointer is written.
        log.append("sessions", session(3))
        monkeypatch.setattr(Log, "_point", point)
        Log(spark, str(tmp_path)).compact("sessions")
        point(self, *args)

    monkeypatch.setattr(Log, "_point", raced)
    with pytest.raises(RuntimeError):
        log.compact("sessions")
    assert ids() == {0, 1, 2, 3}

    def late(self, *args):
        log.append("sessions", session(4))
        point(self, *args)

    monkeypatch.setattr(Log, "_point", late)
    log.compact("sessions")
    assert ids() == {0, 1, 2, 3, 4}
    log.sweep("sessions")
    assert ids() == {0, 1, 2, 3, 4} and len(list((tmp_path / "sessions" / "batches").glob("*"))) == 1
    log.append("sessions", session(5))
    monkeypatch.setattr(Log, "_point", point)
    log.compact("sessions")
    assert ids() == {0, 1, 2, 3, 4, 5}


def test_metrics_are_kept_until_refreshed(spark, sales, tmp_path):
    first = answers.dataset_metrics(sales, "s", str(tmp_path))["basic_stats"].filter("column = 'price'").first()["mean"]
    doubled = sales.withColumn("price", F.col("price") * 2)
    assert answers.dataset_metrics(doubled, "s", str(tmp_path))["basic_stats"].filter("column = 'price'").first()["mean"] == first
    again = answers.dataset_metrics(doubled, "s", str(tmp_path), refresh=True)["basic_stats"].filter("column = 'price'").first()["mean"]
    assert again == pytest.approx(2 * first)
