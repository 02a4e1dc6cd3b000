"""From documents to training sequences, in stages that are each written as Parquet and read again.

Language ID, one document of each group of near copies, benchmark decontamination,
mixing sources to target weights, token ids in training order. All stages but the
last return the columns of their input; each works on all rows the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protomatch.llm.chosen_path import similar_documents
from protomatch.llm.decontam import find_leaks
from protomatch.llm.langid import UNKNOWN, fit_on, identify
from protomatch.llm.mixing import ADDED, mix_sources, tempered_shares
from protomatch.llm.staging import shared_folder, written
from protomatch.llm.token_output import training_shards

LEAST_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of no language: no letters, or no language at least as likely as all others together."""
    found = identify(docs, fit_on(docs))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked documents; of repeated rows, one."""
    found = similar_documents(docs).groupBy("id", "h").agg(
        F.min("class_id").alias("class_id"), F.min("class_h").alias("class_h"), F.count("*").alias("times"),
    )
    found = written(found, shared_folder(spark), "groups")
    first = F.col("id").eqNullSafe(F.col("class_id")) & (F.col("h") == F.col("class_h"))
    # All columns in one struct: no name of theirs can meet one of the groups'.
    rows = docs.select(F.struct("*").alias("row"))
    digest = F.xxhash64(F.coalesce("row.text", F.lit("")))
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("id")) & (digest == F.col("h"))
    kept = rows.join(found.where(~first | (F.col("times") > 1)), same, "left_anti")
    again = found.where(first & (F.col("times") > 1))
    if not again.isEmpty():
        once = rows.join(again, same, "left_semi").withColumns({"id": F.col("row.doc_id"), "digest": digest}).dropDuplicates(["id", "digest"])
        kept = kept.unionByName(once.select("row"))
    return kept.select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark item."""
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("items") == 0).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, and those of raised sources again until the weights are met; rows lie in the order of the mix."""
    return mix_sources(docs, tempered_shares(docs)).orderBy("mix_slot", "mix_copy", "doc_id").drop(*ADDED)


def training_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of token sequences in training order."""
    return training_shards(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("training_order", training_order),
]

# Language models, tokens and keyed orders are not SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
