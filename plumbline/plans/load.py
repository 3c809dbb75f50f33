"""From a file to a clean, described dataset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.operators import classify, corpus, profile
from plumbline.operators.cleaning import CleaningPlan, clean_structured, is_text_table
from plumbline.sources.readers import dataset_name, file_kind, read_dataset


@dataclass
class Loaded:
    """What loading yields. Profiles and cleaning plans have run their statistics; the rows are lazy."""

    name: str
    raw: DataFrame
    clean: DataFrame
    dataset_profile: DataFrame
    column_profile: DataFrame | None
    domain: DataFrame
    questions: DataFrame
    record: DataFrame
    languages: DataFrame | None = None


def load_dataset(
    spark: SparkSession, path: str, plan: CleaningPlan | None = None, n_questions: int = 8, load_time=None, **options
) -> Loaded:
    """Read, profile, clean, classify and suggest questions for one file."""
    name, kind = dataset_name(path), file_kind(path)
    raw = read_dataset(spark, path, **options)
    catalog = profile.column_catalog(raw, name)
    languages = None
    if is_text_table(raw):
        languages = corpus.language_hist(raw, "content")
        clean = corpus.clean_text(raw)
        described = corpus.text_profile(raw, "content")
        columns = None
        domain = classify.corpus_domain(raw, "content").select(F.lit(name).alias("dataset"), "domain")
    else:
        clean = clean_structured(raw, plan)
        described = profile.dataset_profile(raw, kind)
        columns = profile.column_profile(raw)
        domain = classify.table_domain(catalog)
    questions = classify.suggest_questions(catalog, n_questions)
    when = F.current_timestamp() if load_time is None else F.lit(load_time)
    size = raw.agg(F.count("*").alias("n_rows"))
    record = size.select(
        F.lit(name).alias("dataset"), F.lit(path).alias("file_path"), F.lit(kind).alias("file_type"),
        when.cast("timestamp").alias("load_time"), domain.select("domain").scalar().alias("domain"), "n_rows",
        F.lit(len(raw.columns)).alias("n_cols"),
    )
    return Loaded(name, raw, clean, described, columns, domain, questions, record, languages)
