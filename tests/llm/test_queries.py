"""Queries of the subpackage that have SQL, over whole tables of the smallest data set."""

from __future__ import annotations

import os

import pytest

from protomatch.llm.queries import QUERIES
from protomatch.llm.sql import ORACLES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test data missing")


def plain(value):
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


def sorted_rows(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in at)) for r in rows)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    df = QUERIES[name](spark, DATA)
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(columns, cursor.fetchall())


@pytest.mark.parametrize("name, columns", [
    ("op12_ranked_search", ["item_id", "rank", "doc_id", "score"]),
    ("op13_hard_negatives", ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]),
])
def test_contract_columns(spark, name, columns):
    assert QUERIES[name](spark, DATA).columns[:len(columns)] == columns


@pytest.mark.parametrize("name, columns", [
    ("op2_virtual_slots", ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]),
    ("op3_suffix_dedup", ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]),
    ("op4_imatch", ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]),
    ("op6_language_id", ["doc_id", "held_out", "lang_pred", "score"]),
    ("op7_license_scan", ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]),
    ("op10_quality_cnn", ["doc_id", "held_out", "score", "predicted"]),
    ("op11_repeated_windows", ["doc_id", "n_words", "n_removed", "kept_sha256"]),
])
def test_contract_columns_and_one_row_per_document(spark, name, columns):
    df = QUERIES[name](spark, DATA)
    assert df.columns[:len(columns)] == columns
    ids = [r[0] for r in df.select("doc_id").collect()]
    assert sorted(ids) == sorted(r[0] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect())
