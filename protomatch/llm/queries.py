"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from protomatch.llm.chosen_path import similar_documents
from protomatch.llm.decontam import find_leaks
from protomatch.llm.hard_negatives import mine_hard_negatives
from protomatch.llm.imatch import fingerprint_documents
from protomatch.llm.langid import fit_on as fit_languages
from protomatch.llm.langid import identify
from protomatch.llm.lexical_search import rank_documents
from protomatch.llm.licenses import license_digest, scan_licenses
from protomatch.llm.mixing import mix_sources, tempered_shares
from protomatch.llm.quality_cnn import fit_on as fit_quality
from protomatch.llm.quality_cnn import score_documents
from protomatch.llm.repeated_windows import remove_repeated_windows
from protomatch.llm.sharding import first_map, place_records, read_map, slot_sizes, write_map
from protomatch.llm.staging import shared_folder
from protomatch.llm.suffix import remove_repeats
from protomatch.llm.token_output import training_shards

SHARDS = 24


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "source", F.octet_length("text").alias("n_bytes"))
    mixed = mix_sources(docs, tempered_shares(docs, size_col="n_bytes"), size_col="n_bytes")
    return mixed.select("doc_id", "source", "mix_slot", "mix_block", "mix_copy")


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    sizes = slot_sizes(docs)
    path = f"{shared_folder(spark)}/slot-map"
    write_map(spark, first_map(sizes, SHARDS), sizes, path)
    placed = place_records(docs, read_map(spark, path))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(_documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s[1] - s[0])
    return done.select(
        F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(_documents(spark, sf_dir))


def op5_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar_documents(_documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_links")


def _remainder(n: int) -> Column:
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % n


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = fit_languages(docs.where(_remainder(4) != 2))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("row.doc_id", "lang_pred", "score").select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(scan_licenses(_documents(spark, sf_dir)))


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_shards(_documents(spark, sf_dir))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(_documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("row.doc_id", (F.size("items") > 0).alias("contaminated"), F.col("items").alias("item_ids"), "score", "coverage")


def op10_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(_remainder(3) != 1)
    net = fit_quality(docs, labels)
    scored = score_documents(docs, net).withColumnRenamed("id", "doc_id")
    return scored.select(
        "doc_id", (_remainder(3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op11_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeated_windows(_documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s[1] - s[0])
    return done.select(
        F.col("id").alias("doc_id"), "n_words", removed.alias("n_removed"), F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_virtual_slots": op2_virtual_slots,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_imatch": op4_imatch,
    "op5_chosen_path": op5_chosen_path,
    "op6_language_id": op6_language_id,
    "op7_license_scan": op7_license_scan,
    "op8_training_order": op8_training_order,
    "op9_decontaminate": op9_decontaminate,
    "op10_quality_cnn": op10_quality_cnn,
    "op11_repeated_windows": op11_repeated_windows,
    "op12_ranked_search": op12_ranked_search,
    "op13_hard_negatives": op13_hard_negatives,
}
