"""The corpus pipeline: five stages, each written as a table and read again by the next.

Every stage takes the rows its predecessor kept, with any further columns, and lets its decisions take
effect. All but the last return the columns they were given. Rows without an id pass the stages that
need one to tell documents apart; missing and empty texts are documents like others: they score the
prior in the first stage, are near duplicates of nothing and hold no test item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions.columns import col
from plumbline.llm.common import Workspace, id_bitmap, in_bitmap
from plumbline.llm.contamination import find_contamination
from plumbline.llm.mixing import mix_sources
from plumbline.llm.near_duplicates import near_duplicates
from plumbline.llm.quality import score_quality
from plumbline.llm.queries import MIX_MOST, MIX_SHARE, MIX_WEIGHTS, SHARDS, quality_model, table
from plumbline.llm.sharding import with_shard


#: Texts of this similarity in five-word shingles, in hundredths, are near duplicates.
NEAR = (80, 100)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled texts call good: those of score 0.5 or more."""
    scored = score_quality(docs, quality_model(spark, sf_dir), score_name="__score")
    return scored.filter(F.col("__score") >= 0.5).select(*map(col, docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of smallest id; repeated rows go too.

    Only documents that may have to go, or whose id is repeated, are shuffled with their texts.
    """
    work = Workspace(spark)
    told = near_duplicates(docs, threshold=NEAR).groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    told = work.table(told.agg(F.min("kept").alias("__kept"), F.count("*").alias("__rows")).filter("__id is not null"), "told")
    touched = told.filter("not __kept or __rows > 1")
    bitmap = id_bitmap(touched, "__id")
    marked = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__hash": F.xxhash64("text")})
    named = marked.filter("__id is not null")
    doubtful = in_bitmap(named, "__id", bitmap).join(told.select("__id", "__hash", "__kept"), ["__id", "__hash"])
    doubtful = doubtful.filter("__kept").dropDuplicates(["__id", "__hash"])
    kept = [in_bitmap(named, "__id", bitmap, inside=False), marked.filter("__id is null"), doubtful]
    columns = list(map(col, docs.columns))
    return kept[0].select(*columns).unionByName(kept[1].select(*columns)).unionByName(kept[2].select(*columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no question and answer of `benchmark`."""
    marked = find_contamination(docs, table(spark, sf_dir, "benchmark"), name="__items")
    return marked.filter(F.size("__items") == 0).select(*map(col, docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mix_sources(docs.select(F.struct(*map(col, docs.columns)).alias("__doc"), "doc_id", "text", "source"), MIX_WEIGHTS, MIX_SHARE, MIX_MOST, keep=["__doc"])
    copies = F.sequence(F.lit(1).cast("long"), F.col("mix.copies"))
    return mixed.filter("mix.copies > 0").select("__doc", F.explode(copies).alias("__copy")).select("__doc.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard."""
    return with_shard(docs, [1.0] * SHARDS)


STAGES = [
    ("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("decontamination", decontaminate),
    ("mixing", mix), ("sharding", shard),
]

#: Votes of neighbours, a branching join and BM25 bounds have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = table(spark, sf_dir, "documents"), Workspace(spark)
    for number, (name, stage) in enumerate(STAGES):
        docs = work.table(stage(spark, docs, sf_dir), name)
        if number:
            work.drop(STAGES[number - 1][0])
    return docs
