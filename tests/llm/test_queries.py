"""The registered queries against SQL, and on hard, odd and empty tables."""

import duckdb
import pytest

import corpus_pipeline
from plumbline.llm import queries
from workload.check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_rows_equal_sql(spark, db, name):
    ok, note = compare(spark, db, name, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert ok, note


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_hard_cases_equal_sql(spark, edge_dir, name):
    c = duckdb.connect()
    for table in ("documents", "labels", "embeddings", "benchmark"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{edge_dir}/{table}.parquet/*.parquet'")
    ok, note = compare(spark, c, name, queries.QUERIES[name], queries.ORACLES[name], edge_dir)
    assert ok, note


ALL = {**queries.QUERIES, "pipeline": corpus_pipeline.run}


@pytest.mark.parametrize("name", sorted(ALL))
def test_missing_and_repeated_ids_do_not_crash(spark, odd_dir, name):
    rows = ALL[name](spark, odd_dir).collect()
    if name not in ("op3_license_scan", "op4_decontamination", "op8_top_k", "op11_hard_negatives", "op12_phrases", "pipeline"):
        assert len(rows) == spark.read.parquet(f"{odd_dir}/documents.parquet").count()


@pytest.mark.parametrize("name", sorted(ALL))
def test_empty_tables_give_no_rows(spark, empty_dir, name):
    assert ALL[name](spark, empty_dir).collect() == []


def test_no_broadcast_or_cross_product_of_documents(spark):
    for name in ("op1_substring_dedup", "op10_near_duplicates", "op9_shard_documents"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_stages_keep_the_columns_and_take_effect(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd_dir)
        assert out.columns == docs.columns and out.schema.fields[0].dataType == docs.schema.fields[0].dataType, name
    single = corpus_pipeline.drop_near_duplicates(spark, docs, odd_dir).collect()
    kept = [(r["doc_id"], r["text"]) for r in single if r["doc_id"] is not None]
    assert len(kept) == len(set(kept)) and not any(i in (8, 9, 10, 28) for i, _ in kept)
    clean = corpus_pipeline.decontaminate(spark, docs, odd_dir)
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in clean.collect()} >= {22, 23}
