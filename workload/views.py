"""Views derived from the given tables, as SQL that Spark and DuckDB both run.

They add what cleaning and history operators need and the plain tables lack: missing cells,
duplicates, untidy text, a session log and a catalog of many datasets.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]

STEMS = [
    "Show the distribution of Unit Price for",
    "Is there a correlation between Stress Level and Sleep Hours in",
    "Compare the difference in sales by customer for",
    "What is the trend over time of revenue in",
    "How many items are there in",
    "Which player has the best score in",
    "Summarize the records of",
]
COLUMN_NAMES = [
    "Unit Price", "Stress Level", "Sleep Hours", "Customer ID", "Created At", "Team", "Score Total",
    "Route", "Temperature", "Machine", "User Name", "Post Count", "Student", "Arm Blood",
    "Pressure Max", "Resting Heart", "Rate Limit", "Ref", "Flag", "Amount", "Kind", "Note", "Zone",
    "Batch", "Notes", "Tag", "Level", "Units", "Lot",
]


def _choice(key: str, values: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {cases} END"


DIRTY = """
SELECT o_orderkey, o_custkey, o_orderstatus,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN o_totalprice * 20
            ELSE o_totalprice END AS o_totalprice,
       o_orderdate, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM {orders}
"""

VIEWS = {
    "orders_dirty": f"{DIRTY} UNION ALL {DIRTY} WHERE o_orderkey % 17 = 0",
    "orders_text_dates": """
SELECT o_orderkey, o_totalprice, cast(o_custkey AS string) AS customer_code,
       CASE WHEN o_orderkey % 19 = 3 THEN 'bad'
            ELSE lpad(cast(day(o_orderdate) AS string), 2, '0') || '/' ||
                 lpad(cast(month(o_orderdate) AS string), 2, '0') || '/' ||
                 cast(year(o_orderdate) AS string) END AS order_date
FROM {orders}
""",
    "customer_dirty": """
SELECT c_custkey,
       CASE WHEN c_custkey % 2 = 0 THEN '  ' || upper(c_name) || ' ' ELSE chr(9) || lower(c_name) END AS c_name,
       CASE c_custkey % 4 WHEN 0 THEN 'o''' || lower(c_mktsegment) WHEN 1 THEN replace(c_mktsegment, 'U', 'é')
            WHEN 2 THEN replace(c_mktsegment, 'I', '-') ELSE c_mktsegment END AS c_title,
       ' seg-' || lower(c_mktsegment) || ' ' AS c_code,
       CASE WHEN c_custkey % 7 = 0 THEN 'nan' WHEN c_custkey % 9 = 0 THEN '  '
            ELSE ' ' || c_mktsegment || chr(10) END AS remark,
       CASE WHEN c_custkey % 8 = 0 THEN 'nan' WHEN c_custkey % 10 = 0 THEN 'soon'
            ELSE '2024-' || cast(c_custkey % 12 + 1 AS string) || '-' || cast(c_custkey % 28 + 1 AS string)
            END AS signup_date
FROM {customer}
""",
    "people": """
SELECT c_custkey, c_acctbal, cast(c_custkey % 150 - 5 AS int) AS age, c_acctbal * 400 AS salary,
       cast(c_custkey % 8 AS int) AS rating
FROM {customer}
""",
    "event_gaps": """
SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value FROM {events}
""",
    "event_inputs": """
SELECT event_id, 'Thought: look; Action Input: User = ' || cast(user_id AS string) || '; type=' || event_type ||
       chr(10) || ' note = a=b ;' || CASE WHEN event_id % 2 = 0 THEN 'USER=' || props ELSE 'stray' END AS text
FROM {events}
""",
    "questions": f"""
SELECT conv_id * 1000 + turn AS q_id, 'd' || cast(conv_id % 3 AS string) AS dataset,
       'd' || cast(conv_id AS string) AS home, {_choice("conv_id", STEMS)} || ' ' || text || '?' AS question
FROM {{conversations}} WHERE role = 'user'
""",
    "sessions": f"""
SELECT u.conv_id * 1000 + u.turn AS session_id, 'd' || cast(u.conv_id % 3 AS string) AS dataset,
       'd' || cast(u.conv_id AS string) AS home, u.conv_id AS conv_id,
       timestamp '2024-01-01 00:00:00' + u.conv_id * interval '1' minute + u.turn * interval '1' second AS ts,
       u.text AS original_input, {_choice("u.conv_id", STEMS)} || ' ' || u.text || '?' AS question, a.text AS answer,
       CASE WHEN coalesce(a.text, '') = '' THEN 'No key finding'
            ELSE substr(split_part(a.text, '. ', 1), 1, 100) ||
                 CASE WHEN length(split_part(a.text, '. ', 1)) > 100 THEN '...' ELSE '' END END AS key_finding,
       cast(u.conv_id % 4 AS int) AS context_used, (u.conv_id + u.turn) % 3 <> 0 AS had_visualization
FROM {{conversations}} u JOIN {{conversations}} a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user'
""",
    "artifacts": """
SELECT 'charts/' || dataset || '_' || cast(year(t) AS string) || lpad(cast(month(t) AS string), 2, '0') ||
       lpad(cast(day(t) AS string), 2, '0') || '_' || lpad(cast(hour(t) AS string), 2, '0') ||
       lpad(cast(minute(t) AS string), 2, '0') || lpad(cast(second(t) AS string), 2, '0') ||
       CASE WHEN session_id % 2 = 0 THEN '.png' ELSE '.html' END AS path, t AS modified
FROM (SELECT dataset, session_id, ts + (conv_id % 5) * interval '60' second AS t FROM {sessions}) s
""",
    "catalog": f"""
SELECT 'd' || cast(l_orderkey AS string) AS dataset,
       cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS int) AS ordinal,
       {_choice("pick", COLUMN_NAMES)} AS column_name,
       CASE pick % 3 WHEN 0 THEN 'numeric' WHEN 1 THEN 'categorical' ELSE 'datetime' END AS kind
FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS pick FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber) p
""",
    "question_lists": f"""
SELECT conv_id * 1000 + turn AS id,
       CASE conv_id % 4
         WHEN 0 THEN 'Sure, here they are:' || chr(10) || '1. ' || {_choice("conv_id + turn", STEMS)} || ' ' || text ||
              '?' || chr(10) || '2. Why does it grow in turn ' || cast(turn AS string) || '?'
         WHEN 1 THEN '- ' || {_choice("conv_id", STEMS)} || ' ' || text || '?' || chr(10) || '• Is it so?'
         WHEN 2 THEN 'Question 1: ' || {_choice("turn", STEMS)} || ' row ' || cast(turn AS string) || '?' || chr(10) || text
         ELSE 'please see what changed' || chr(10) || '  3. ' || text END AS text
FROM {{conversations}}
""",
}


def needed(text: str) -> list[str]:
    """The views a SQL text refers to, each after those it depends on."""
    found: list[str] = []

    def visit(sql: str) -> None:
        for name in VIEWS:
            if name not in found and re.search(rf"(?<![\w']){name}(?![\w'])", sql):
                visit(VIEWS[name])
                found.append(name)

    visit(text)
    return found


def oracle(text: str) -> str:
    """Prefix a SQL text with the views it uses."""
    names = needed(text)
    plain = {n: VIEWS[n].format(**{x: x for x in [*TABLES, *VIEWS]}) for n in names}
    body = text.strip()
    if not names:
        return body
    views = ",\n".join(f"{n} AS ({sql.strip()})" for n, sql in plain.items())
    if body[:5].upper() == "WITH ":
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"


class Tables:
    """Given tables and derived views as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        sql = VIEWS[name]
        used = {x for x in [*TABLES, *VIEWS] if "{" + x + "}" in sql}
        df = self.spark.sql(sql, **{x: self(x) for x in used})
        zoned = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
        return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned})
