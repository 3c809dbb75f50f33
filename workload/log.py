"""The session log, the dataset catalog and the reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import classify, history, rules, stats
from plumbline.plans import reports
from workload.registry import query

SESSION = ["dataset", "session_id", "ts", "question", "answer", "key_finding"]
TERMS = ["sales", "time", "player", "general"]


def any_of(x: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in phrases) + ")"


TOPICS = (
    "list_filter(["
    + ", ".join(f"CASE WHEN {any_of('lower(question)', w)} THEN '{t}' END" for t, w in rules.TOPICS.items())
    + "], lambda x: x IS NOT NULL)"
)


def topics_sql(table: str) -> str:
    return f"SELECT *, unnest(CASE WHEN len({TOPICS}) > 0 THEN {TOPICS} ELSE ['general'] END) AS topic FROM {table}"


def latest_sql(table: str, keys: str, order: str, k: int) -> str:
    return f"SELECT * EXCLUDE (rank) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rank FROM {table}) r WHERE rank <= {k}"


@query("question_topics", f"SELECT q_id, topic FROM ({topics_sql('questions')}) t")
def question_topics(t):
    return classify.question_topics(t("questions")).select("q_id", "topic")


INSIGHTS = f"SELECT dataset, topic, key_finding AS insight, question, ts, session_id FROM ({topics_sql('sessions')}) t"


@query("insight_rows", INSIGHTS)
def insight_rows(t):
    return history.insight_rows(t("sessions"))


@query("retain_sessions", f"SELECT dataset, session_id, ts, key_finding FROM ({latest_sql('sessions', 'dataset', 'ts DESC, session_id DESC', 20)}) s")
def retain_sessions(t):
    return history.retain_sessions(t("sessions")).select("dataset", "session_id", "ts", "key_finding")


@query("retain_insights", latest_sql(f"({INSIGHTS})", "dataset, topic", "ts DESC, session_id DESC", 5))
def retain_insights(t):
    return history.retain_insights(history.insight_rows(t("sessions")))


@query("recent_sessions", f"SELECT dataset, session_id, ts, question FROM ({latest_sql('sessions', 'dataset', 'ts DESC, session_id DESC', 10)}) s")
def recent_sessions(t):
    return history.retain_sessions(t("sessions"), 10).select("dataset", "session_id", "ts", "question")


WORDS = r"unnest(list_distinct(regexp_extract_all(lower(question), '\S+')))"
CONTEXT = f"""
WITH asked AS (SELECT q_id, dataset, {WORDS} AS word FROM questions),
said AS (SELECT session_id, dataset, ts, {WORDS} AS word FROM sessions),
shared AS (SELECT DISTINCT q_id, dataset, session_id, ts FROM asked JOIN said USING (dataset, word)),
best AS ({latest_sql("shared", "q_id", "ts DESC, session_id DESC", 3)}),
context AS (SELECT b.q_id, b.dataset, b.session_id, b.ts, s.question, s.key_finding FROM best b JOIN sessions s USING (session_id))
"""


@query("context_retrieval", f"{CONTEXT} SELECT * FROM context")
def context_retrieval(t):
    return history.context_retrieval(t("questions"), t("sessions"))


@query(
    "enhanced_question",
    f"""
{CONTEXT}, numbered AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY ts, session_id) AS i FROM context),
listed AS (SELECT q_id, string_agg(i || '. From ''' || question || ''': ' || key_finding || chr(10), '' ORDER BY i) AS lines
           FROM numbered GROUP BY 1)
SELECT q.q_id, q.question || coalesce(chr(10) || 'Relevant previous findings:' || chr(10) || lines || chr(10) ||
       'Please consider these previous findings when answering.', '') AS enhanced
FROM questions q LEFT JOIN listed USING (q_id)
""",
)
def enhanced_question(t):
    questions = t("questions")
    found = history.context_retrieval(questions, t("sessions"))
    return history.enhanced_question(questions, found).select("q_id", "enhanced")


@query(
    "topic_search",
    f"""
WITH terms AS (SELECT unnest({TERMS}) AS term),
i AS ({INSIGHTS}),
a AS ({latest_sql("(SELECT * FROM i, terms WHERE contains(topic, term))", "dataset, term", "ts DESC, session_id DESC, topic", 5)}),
b AS ({latest_sql("(SELECT * FROM sessions, terms WHERE contains(lower(question), term) OR contains(lower(key_finding), term))", "dataset, term", "ts DESC, session_id DESC", 3)})
SELECT 'insight' AS kind, dataset, term, ts, session_id, question, insight AS finding FROM a
UNION ALL SELECT 'session', dataset, term, ts, session_id, question, key_finding FROM b
""",
)
def topic_search(t):
    sessions = t("sessions")
    return history.topic_search(history.insight_rows(sessions), sessions, TERMS)


PICTURES = r"""
SELECT path, regexp_extract(path, '([^/]*?)_\d{8}_\d{6}', 1) AS made_for,
       strptime(regexp_extract(path, '_(\d{8}_\d{6})', 1), '%Y%m%d_%H%M%S') AS made FROM artifacts WHERE path LIKE '%.png'
"""
MATCHED = f"""
pictures AS ({PICTURES}),
near AS (SELECT s.session_id, p.path, abs(epoch(p.made) - epoch(s.ts))::BIGINT AS apart FROM sessions s JOIN pictures p
         ON p.made_for = s.dataset AND abs(epoch(p.made) - epoch(s.ts)) <= 120),
pick AS (SELECT session_id, path, apart FROM
         (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY apart, path) AS rank FROM near) r WHERE rank = 1)
"""


def pictures(t):
    return history.artifact_parts(t("artifacts").filter(F.col("path").endswith(".png")))


@query(
    "match_artifacts",
    f"""
WITH {MATCHED} SELECT s.dataset, s.session_id, s.ts, pick.path, cast(apart AS double) AS seconds_apart
FROM sessions s LEFT JOIN pick USING (session_id)
""",
)
def match_artifacts(t):
    matched = history.match_artifacts(t("sessions").select("dataset", "session_id", "ts"), pictures(t))
    return matched.withColumn("seconds_apart", F.col("seconds_apart").cast("double"))


@query(
    "recent_artifacts",
    latest_sql(
        r"(SELECT regexp_extract(path, '([^/]*?)_\d{8}_\d{6}', 1) AS dataset, path, modified FROM artifacts WHERE path LIKE '%.html')",
        "dataset", "modified DESC, path", 5,
    ),
)
def recent_artifacts(t):
    charts = history.artifact_parts(t("artifacts").filter(F.col("path").endswith(".html")))
    return history.recent_artifacts(charts.select("dataset", "path", "modified"))


@query(
    "session_report",
    rf"""
WITH {MATCHED}
SELECT s.dataset, s.session_id, s.ts, trim(replace(question, '*', '')) AS question,
       regexp_replace(regexp_replace(regexp_replace(answer, '[📊📈📉💡🔍⚡🧠🎯]+', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS answer,
       key_finding, context_used, had_visualization, CASE WHEN had_visualization THEN pick.path END AS path
FROM sessions s LEFT JOIN pick USING (session_id)
""",
)
def session_report(t):
    return reports.session_report(t("sessions"), pictures(t))


NAMES = "names AS (SELECT dataset, string_agg(lower(column_name), ' ' ORDER BY ordinal) AS names FROM catalog GROUP BY 1)"


def rule_sql(sets: dict[str, list[str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of('names', p)} THEN '{n}'" for n, p in sets.items()) + f" ELSE '{default}' END"


DOMAINS = f"SELECT dataset, {rule_sql(rules.TABLE_DOMAINS, rules.TABLE_DOMAIN_DEFAULT)} AS domain FROM names"


@query("table_domain", f"WITH {NAMES} {DOMAINS}")
def table_domain(t):
    return classify.table_domain(t("catalog"))


KINDS = """kinds AS (SELECT dataset, count(*) FILTER (kind = 'numeric') AS nums, count(*) FILTER (kind = 'categorical') AS cats
FROM catalog GROUP BY 1)"""


def home_questions(t):
    """Questions addressed to the many datasets of the catalog."""
    return t("questions").select("q_id", F.col("home").alias("dataset"), "question")


@query(
    "question_intent",
    f"""
WITH {KINDS}
SELECT q_id, dataset, question, {any_of("lower(question)", rules.CHART_WORDS)} AS wants_chart,
       CASE WHEN contains(lower(question), 'correlation') AND nums >= 2 THEN 'correlation'
            WHEN contains(lower(question), 'distribution') AND nums >= 1 THEN 'distribution'
            WHEN (contains(lower(question), 'compare') OR contains(lower(question), 'difference')) AND cats >= 1 AND nums >= 1
            THEN 'comparison' WHEN nums >= 1 THEN 'distribution' ELSE 'summary' END AS chart,
       CASE WHEN cats >= 1 AND nums >= 1 THEN 'comparison' WHEN nums >= 2 THEN 'correlation'
            WHEN nums >= 1 THEN 'distribution' ELSE 'aggregation' END AS analysis
FROM (SELECT q_id, home AS dataset, question FROM questions) q LEFT JOIN kinds USING (dataset)
""",
)
def question_intent(t):
    return classify.question_intent(home_questions(t), t("catalog"))


@query(
    "target_column",
    """
WITH hits AS (SELECT q_id, column_name, ordinal, contains(lower(question), lower(column_name)) AS named
              FROM (SELECT q_id, home AS dataset, question FROM questions) q LEFT JOIN catalog USING (dataset))
SELECT q_id, target_column FROM (SELECT q_id, column_name AS target_column,
       row_number() OVER (PARTITION BY q_id ORDER BY named DESC, ordinal) AS rank FROM hits) r WHERE rank = 1
""",
)
def target_column(t):
    return stats.target_column(home_questions(t), t("catalog")).select("q_id", "target_column")


@query(
    "relevant_columns",
    latest_sql("(SELECT * FROM catalog WHERE kind IN ('numeric', 'categorical'))", "dataset", "kind <> 'numeric', ordinal", 3),
)
def relevant_columns(t):
    return classify.relevant_columns(t("catalog"))


def listed(texts: list[str]) -> str:
    return "[" + ", ".join(f"'{q}'" for q in texts) + "]"


OWN = "CASE ordinal % 4 " + " ".join(
    f"WHEN {i} THEN replace('{q}', '{{}}', column_name)" for i, q in enumerate(rules.COLUMN_QUESTIONS)
) + " END"


@query(
    "suggest_questions",
    f"""
WITH {NAMES},
t AS (SELECT dataset, CASE WHEN {rule_sql(rules.SUGGESTION_DOMAINS, rules.SUGGESTION_DOMAIN_DEFAULT)} <> 'General'
      THEN {listed(rules.HEALTH_QUESTIONS)} ELSE {listed(rules.GENERAL_QUESTIONS)} END AS qs FROM names)
SELECT dataset, cast(generate_subscripts(qs, 1) AS int) AS position, unnest(qs) AS question FROM t
UNION ALL SELECT dataset, cast(ordinal + 11 AS int), {OWN} FROM catalog WHERE ordinal < 2
""",
)
def suggest_questions(t):
    return classify.suggest_questions(t("catalog"), 12)


@query(
    "catalog_info",
    f"""
WITH i AS (SELECT home AS dataset, count(*) AS n FROM ({topics_sql('sessions')}) t GROUP BY 1),
c AS (SELECT dataset, count(*) AS n_cols, string_agg(column_name, ',' ORDER BY ordinal) AS columns FROM catalog GROUP BY 1),
z AS (SELECT 'd' || cast(l_orderkey AS string) AS dataset, count(*) AS n_rows FROM lineitem GROUP BY 1)
SELECT dataset, n_rows, n_cols, columns, true AS has_profile, dataset IN (SELECT home FROM questions) AS has_questions,
       coalesce(i.n, 0) AS num_insights
FROM c LEFT JOIN z USING (dataset) LEFT JOIN i USING (dataset)
""",
)
def catalog_info(t):
    name = F.concat(F.lit("d"), F.col("l_orderkey").cast("string")).alias("dataset")
    sizes = t("lineitem").groupBy(name).agg(F.count("*").alias("n_rows"))
    insights = classify.question_topics(t("sessions").select(F.col("home").alias("dataset"), "question"))
    return history.catalog_info(t("catalog"), sizes, sizes, home_questions(t), insights)


@query(
    "catalog_summary",
    f"""
WITH {NAMES}, d AS ({DOMAINS}),
q AS (SELECT home AS dataset, count(*) AS n FROM questions GROUP BY 1),
h AS (SELECT home AS dataset, count(*) AS n FROM sessions GROUP BY 1),
per AS (SELECT dataset, domain, coalesce(q.n, 0) AS questions, coalesce(h.n, 0) AS history
        FROM d LEFT JOIN q USING (dataset) LEFT JOIN h USING (dataset))
SELECT dataset, domain, 1 AS datasets, questions, history FROM per
UNION ALL SELECT NULL, NULL, count(*), sum(questions)::BIGINT, sum(history)::BIGINT FROM per
""",
)
def catalog_summary(t):
    datasets = classify.table_domain(t("catalog"))
    sessions = t("sessions").select(F.col("home").alias("dataset"))
    return history.catalog_summary(datasets, home_questions(t), sessions)


@query(
    "dataset_listing",
    f"""
WITH per AS (SELECT dataset, topic, count(*) AS n FROM ({INSIGHTS}) i GROUP BY 1, 2),
main AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY n DESC, topic) AS r FROM per),
topics AS (SELECT dataset, string_agg(topic || ' (' || n || ')', ', ' ORDER BY n DESC, topic) AS topics FROM main WHERE r <= 3 GROUP BY 1)
SELECT dataset, dataset || '.csv' AS file_path, load_time, n_rows, 7 AS n_cols, n_questions AS questions, n_rows AS history,
       coalesce(topics, '') AS topics
FROM (SELECT dataset, max(ts) AS load_time, count(*) AS n_rows FROM sessions GROUP BY 1) s
LEFT JOIN (SELECT dataset, count(*) AS n_questions FROM questions GROUP BY 1) q USING (dataset) LEFT JOIN topics USING (dataset)
""",
)
def dataset_listing(t):
    sessions = t("sessions")
    records = sessions.groupBy("dataset").agg(F.max("ts").alias("load_time"), F.count("*").alias("n_rows"))
    records = records.withColumns({"file_path": F.concat("dataset", F.lit(".csv")), "n_cols": F.lit(7)})
    return history.dataset_listing(records, t("questions"), sessions, history.insight_rows(sessions))
