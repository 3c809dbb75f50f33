"""Readers, writers and stores, on files written from the given tables into a fresh shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.operators import corpus, rules, stats, vector_index, vectors
from plumbline.operators.cleaning import is_text_table
from plumbline.plans import reports
from plumbline.plans.answers import dataset_metrics
from plumbline.plans.load import load_dataset
from plumbline.plans.metrics import RANK_ERROR, Metrics
from plumbline.session import ensure_checkpoint_dir
from plumbline.sources import encoding
from plumbline.sources.catalog import Log
from plumbline.sources.csv_repair import normalize_csv, read_repaired_csv, surplus_lines
from plumbline.sources.readers import read_dataset, write_table
from workload.log import latest_sql, rule_sql
from workload.registry import query, union_all
from workload.tables import LINEITEM, LINEITEM_NUMBERS, profile_row, stats_row
from workload.texts import CLEANED, VOCABULARY, WORD_SEARCH, counted, vocabulary_counts


def folder(t) -> str:
    """A new folder below the one that driver and executors share."""
    ensure_checkpoint_dir(t.spark)
    return f"{t.spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


CUSTOMER = "c_custkey, c_name, c_nationkey, round(c_acctbal, 4) AS c_acctbal, c_mktsegment"


@query("read_csv", f"SELECT {CUSTOMER} FROM customer")
def csv_rows(t):
    path = f"{folder(t)}/customer.csv"
    write_table(t("customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), path, "csv")
    read = read_dataset(t.spark, path)
    return read.withColumns({c: F.col(c).cast("bigint") for c in ("c_custkey", "c_nationkey")})


@query("read_json", "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice FROM orders")
def json_rows(t):
    path = f"{folder(t)}/orders.json"
    write_table(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), path, "json")
    return read_dataset(t.spark, path).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query(
    "decode_texts",
    """
SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 OR strlen(text) = length(text) THEN 'utf-8' ELSE 'cp1252' END AS encoding
FROM documents
""",
)
def decoded_texts(t):
    """Texts as bytes, in UTF-8 or one byte per character."""
    raw = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode("text", "ISO-8859-1"))
    rows = t("documents").select("doc_id", raw.alias("raw"))
    return rows.select("doc_id", encoding.decoded(F.col("raw")).alias("text"), encoding.encoding_of(F.col("raw")).alias("encoding"))


def untidy_csv(t) -> str:
    """Suppliers behind a title line and a header with a repeated name, with some surplus cells."""
    path = f"{folder(t)}/suppliers"
    more = F.when(F.col("s_suppkey") % 10 == 0, F.lit(";surplus")).otherwise(F.lit(""))
    body = t("supplier").select(F.concat(F.concat_ws(";", "s_suppkey", "s_nationkey", "s_name"), more).alias("line"))
    head = t.spark.createDataFrame([("suppliers;;",), ("code;code;name",)], "line string").coalesce(1)
    head.unionByName(body).coalesce(1).write.text(path)
    return path


@query(
    "repaired_csv",
    """
SELECT cast(s_suppkey AS VARCHAR) AS code, cast(s_nationkey AS VARCHAR) AS code_1, s_name AS name, false AS surplus
FROM supplier WHERE s_suppkey % 10 <> 0
UNION ALL
SELECT cast(s_suppkey AS VARCHAR), cast(s_nationkey AS VARCHAR), s_name, true FROM supplier WHERE s_suppkey % 10 = 0
""",
)
def repaired_csv(t):
    path = untidy_csv(t)
    rows = read_repaired_csv(t.spark, path).withColumn("surplus", F.lit(False))
    cells = [F.col("cells")[i].alias(n) for i, n in enumerate(["code", "code_1", "name"])]
    return rows.unionByName(surplus_lines(t.spark, path).select(*cells, F.lit(True).alias("surplus")))


@query("normalize_csv", "SELECT s_suppkey AS code, s_nationkey::BIGINT AS code_1, s_name AS name FROM supplier WHERE s_suppkey % 10 <> 0")
def normalized_csv(t):
    return normalize_csv(t.spark, untidy_csv(t), f"{folder(t)}/clean")


@query("session_store", f"SELECT dataset, session_id, ts, key_finding FROM ({latest_sql('sessions', 'dataset', 'ts DESC, session_id DESC', 20)}) s")
def session_store(t):
    log, rows = Log(t.spark, folder(t)), t("sessions")
    log.append("sessions", rows.filter("session_id % 2 = 0"))
    log.append("sessions", rows.filter("session_id % 2 = 1"))
    return log.sessions().select("dataset", "session_id", "ts", "key_finding")


COUNTED = " + ".join(rf"len(list_filter(words, lambda w: w = '{w}'))" for w in VOCABULARY)


@query(
    "memory_store",
    rf"SELECT doc_id, text, ({COUNTED})::DOUBLE AS counted FROM (SELECT *, regexp_extract_all(lower(text), '\S+') AS words FROM documents) d",
)
def memory_store(t):
    path, rows = folder(t), t("documents").select("doc_id", "text")
    for rest in (0, 1):
        vectors.store_memory(rows.filter(F.col("doc_id") % 2 == rest), path, "text", vocabulary_counts)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return t.spark.read.parquet(path).select("doc_id", "text", total.alias("counted"))


def word_index(t):
    """Documents in an inverted file, half of them added later, and the questions."""
    path, (memory, asked) = folder(t), counted(t)
    half = F.col("mem_id") % 2 == 0
    vector_index.build_index(memory.filter(half), path, "cosine")
    vector_index.append_index(memory.filter(~half), path)
    return vector_index.open_index(t.spark, path), memory, asked


@query("memory_search_ivf", WORD_SEARCH)
def memory_search_ivf(t):
    """The exact search: cells that may hold something nearer are read as well."""
    index, _, asked = word_index(t)
    return vector_index.search_index(index, asked, 5, exact=True)


@query("ivf_recall", "SELECT count(DISTINCT item_id) AS queries, true AS nine_in_ten, true AS fewer_rows FROM benchmark")
def ivf_recall(t):
    """The approximate search against the exact one: memories found that are as near, and rows read."""
    index, memory, asked = word_index(t)
    near, exact = vector_index.search_index(index, asked, 5, probes=8), vectors.knn(memory, asked, 5, "cosine")
    kth = exact.groupBy("query_id").agg(F.max("distance").alias("kth"))
    found = near.join(kth, "query_id").agg(F.count_if(F.col("distance") <= F.col("kth") + 1e-9).alias("found"))
    cells = vector_index.routes(asked.select("query_id", "embedding"), index, 8)
    rows = t.spark.createDataFrame([(i, int(n)) for i, n in enumerate(index.rows)], "cell int, rows long")
    read = cells.join(F.broadcast(rows), "cell").agg(F.sum("rows").alias("read"), F.countDistinct("query_id").alias("queries"))
    # Three single rows become one.
    single = exact.agg(F.count("*").alias("wanted")).unionByName(found, allowMissingColumns=True).unionByName(read, allowMissingColumns=True)
    whole = single.agg(*[F.max(c).alias(c) for c in ("wanted", "found", "read", "queries")])
    return whole.select(
        "queries", (F.col("found") >= 0.9 * F.col("wanted")).alias("nine_in_ten"),
        (F.col("read") < F.col("queries") * F.lit(int(index.rows.sum() + index.undirected))).alias("fewer_rows"),
    )


PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@query(
    "comprehensive",
    union_all([f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS num_unique, count(*) - count({c}) AS missing FROM part" for c in PART]),
)
def bundle(t):
    found = stats.comprehensive(t("part").select(*PART))
    joined = found["unique_values"].join(found["missing_values"], "column").join(found["data_types"], "column")
    return joined.select("column", "num_unique", "missing")


@query("kept_columns", f"SELECT doc_id, text AS content, {CLEANED} AS cleaned_content, true AS is_text FROM documents")
def kept_columns(t):
    """A text table with its metadata dropped."""
    rows = t("documents").select("doc_id", F.col("text").alias("content"), F.create_map(F.lit("source"), F.col("source")).alias("metadata"))
    return corpus.clean_text(rows, drop_metadata=True).withColumn("is_text", F.lit(is_text_table(rows)))


@query(
    "basic_report",
    "SELECT ordinal, \"column\", dtype, num_missing, num_unique, mean, std FROM ("
    + union_all([profile_row(i, c) for i, c in enumerate(LINEITEM)]) + ") p WHERE ordinal < 10",
)
def basic_report(t):
    return reports.basic_report(t("lineitem"), t("sessions"))["features"]


NAMES = "'c_custkey c_name c_nationkey c_acctbal c_mktsegment'"


@query(
    "load_dataset",
    f"""
SELECT 'customer' AS dataset, 'csv' AS file_type, domain, n_rows, 5 AS n_cols, n_rows AS clean_rows, 8 AS questions
FROM (SELECT {rule_sql(rules.TABLE_DOMAINS, rules.TABLE_DOMAIN_DEFAULT)} AS domain, (SELECT count(*) FROM customer) AS n_rows
      FROM (SELECT {NAMES} AS names) n) d
""",
)
def loaded_dataset(t):
    path = f"{folder(t)}/customer.csv"
    write_table(t("customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), path, "csv")
    loaded = load_dataset(t.spark, path)
    counts = {"clean_rows": loaded.clean, "questions": loaded.questions}
    record = loaded.record.select("dataset", "file_type", "domain", "n_rows", "n_cols")
    return record.withColumns({n: df.agg(F.count("*")).scalar() for n, df in counts.items()})


@query("dataset_metrics", union_all([stats_row("lineitem", i, c) for i, c in enumerate(LINEITEM_NUMBERS)]))
def kept_metrics(t):
    path = folder(t)
    for _ in range(2):
        found = dataset_metrics(t("lineitem"), "lineitem", path)
    return found["basic_stats"]


def sliced_metrics(t, table: str, key: str, slices: int = 4) -> Metrics:
    """States of a table that came in slices."""
    kept = Metrics(t.spark, folder(t))
    for part in range(slices):
        kept.add(t(table).filter(F.col(key) % slices == part), f"part-{part}")
    return kept


@query("metrics_exact", union_all([stats_row("lineitem", i, c) for i, c in enumerate(LINEITEM_NUMBERS)]))
def metrics_exact(t):
    """Statistics of merged slices; quartiles ranked between the ends that the merged sketches give."""
    return sliced_metrics(t, "lineitem", "l_orderkey").exact_stats(t("lineitem"))


def sketch_row(i: int, c: str) -> str:
    x = f"cast({c} AS double)"
    return (
        f"SELECT {i} AS ordinal, '{c}' AS \"column\", count({c}) AS count, round(avg({x}), 4) AS mean, round(stddev_samp({x}), 4) AS std, "
        f"round(min({x}), 4) AS min, round(max({x}), 4) AS max, true AS ranks_hold, true AS distinct_holds FROM lineitem"
    )


@query("metrics_merged", union_all([sketch_row(i, c) for i, c in enumerate(LINEITEM_NUMBERS)]))
def metrics_merged(t):
    """Statistics from states alone: exact moments, and whether quartiles and distinct counts keep their error."""
    found, rows = sliced_metrics(t, "lineitem", "l_orderkey").basic_stats(), t("lineitem")
    held = None
    for r in found.collect():
        # Each column is counted by value on its own; counted together, rows would be copied once per column.
        values = rows.select(F.col(r["column"]).cast("double").alias("x")).filter("x is not null").groupBy("x").agg(F.count("*").alias("n"))
        off = []
        for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            # The wanted rank lies between the rows below the value and those not above it, within the error.
            below, upto = (F.sum(F.when(side, F.col("n")).otherwise(0)) / F.sum("n") for side in (F.col("x") < r[name], F.col("x") <= r[name]))
            off.append(F.greatest(below - p, F.lit(p) - upto) <= RANK_ERROR)
        near = F.abs(F.count("*") - r["distinct"]) <= 0.05 * F.count("*") + 1
        row = values.agg((off[0] & off[1] & off[2]).alias("ranks_hold"), near.alias("distinct_holds")).withColumn("column", F.lit(r["column"]))
        held = row if held is None else held.unionByName(row)
    return found.select("ordinal", "column", "count", "mean", "std", "min", "max").join(held, "column")


@query(
    "metrics_top_values",
    union_all(
        [
            f"""(SELECT '{c}' AS "column", {c} AS value, count(*) AS at_least, count(*) AS at_most
FROM part GROUP BY {c} ORDER BY at_least DESC, value LIMIT 5)"""
            for c in ["p_brand", "p_type"]
        ]
    ),
)
def metrics_top_values(t):
    return sliced_metrics(t, "part", "p_partkey").top_values(5).filter(F.col("column").isin("p_brand", "p_type"))
