"""The corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination and mixing, in this order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollgrid.llm import decontaminate, language_id, line_dedup, mixing, near_dedup
from rollgrid.llm.common import broadcast_if_small, read, row_keys, stored


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is unknown, or known with a score near chance only, go."""
    return language_id.known_language(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more hold go; n_chars follows the new text. The documents themselves all stay."""
    columns = docs.columns
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five words, similarity 0.8): the one of the smallest id."""
    found = near_dedup.near_duplicates(docs, percent=80, shingle=5, shared=near_dedup.SHARED_80)
    gone = stored(found.where(~F.col("kept") & F.col("component_id").isNotNull()).select("k1", "k2").distinct(), "near-gone")
    k1, k2 = row_keys(F.col("doc_id"), F.col("text"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), k1, k2).join(broadcast_if_small(gone), ["k1", "k2"], "left_anti")
    return rows.select("row.*")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    found = decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))
    gone = stored(found.where("contaminated").select("k1", "k2").distinct(), "benchmark-gone")
    k1, k2 = row_keys(F.col("doc_id"), F.col("text"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), k1, k2).join(broadcast_if_small(gone), ["k1", "k2"], "left_anti")
    return rows.select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken: doc_id, size, source_size, target, copies, taken."""
    return mixing.mix(docs)


STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near duplicates", near_stage),
    ("benchmark", benchmark_stage),
    ("mixing", mixing_stage),
]

#: The network of the first stage has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
