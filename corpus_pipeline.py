"""Corpus pipeline: classify quality, keep one of each near-duplicate group, decontaminate, redact, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents; extra columns of docs stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard_join, mixing, pii, quality
from tidemark.llm.common import release, stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts. Empty and null texts go; so do none for a null id or a repeated row."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model, score="_quality_score", predicted="_quality_kept").where("_quality_kept = 1").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more on five-word shingles: the smallest doc_id.

    Documents without words or without an id are groups of their own and stay. Of rows that share an id and a text one stays,
    with whichever of its other columns; rows that share an id but not the text stay or go together.
    """
    groups = stored(jaccard_join.jaccard_components(docs.select("doc_id", "text"), k=5, tenths=8).select("doc_id", "component_id"), "groups")
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = stored(groups.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    if repeated.limit(1).count() == 0:
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage within a fifth of its words of a benchmark item. Null ids and texts stay; rows of one id go together."""
    found = decontaminate.contaminations(docs, table(spark, sf_dir, "benchmark")).select("doc_id").where("doc_id IS NOT NULL").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets in texts replaced by <KIND>; n_chars follows. Every document stays."""
    clean = docs.withColumn("text", pii.redact(F.col("text")))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken for every document: the mix to train on."""
    return mixing.mix(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are a Parquet table in the shared folder, removed once the next one is written.

    The last table is removed when the driver's JVM ends.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            release(before)
        before = docs
    return docs
