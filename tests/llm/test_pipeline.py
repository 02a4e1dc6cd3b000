import os

import __spark_entry__
import numpy as np
import pytest

import corpus_pipeline
from protomatch.llm.decontam import words_of
from protomatch.llm.mixing import mix_sources, tempered_shares
from protomatch.llm.token_output import DTYPE, END, Permutation, read_encoding
from tests.llm.helpers import documents, odd_rows
from tests.llm.test_chosen_path import brute, copies

SMALL = "/root/testdata/sf0.001"


def test_stages_in_order_and_registered(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontaminate", "mix", "training_order"]
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{k}_") for q in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_one_document_of_each_group_stays(spark):
    rows = [*copies(7, 12), (3, "a repeated row of words"), (3, "a repeated row of words"), (None, "no id but words"), (None, "no id but words")]
    docs = documents(spark, [(i, t, "en", "a", 1) for i, t in rows])
    kept = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    assert kept.columns == docs.columns
    want = {c for _, c, _ in brute(rows)}
    got = [str(r["doc_id"]) for r in kept.collect()]
    assert len(got) == len(want) + (len(got) - len(set(got))) and set(got) == want


def test_mix_lies_in_the_order_of_its_slots(spark):
    rows = [(k, f"text {k} " * 900, "en", "big" if k % 3 else f"s{k % 4}", 1) for k in range(300)]
    docs = documents(spark, rows)
    slots = mix_sources(docs, tempered_shares(docs)).select("doc_id", "mix_slot", "mix_copy").collect()
    want = [r["doc_id"] for r in sorted(slots, key=lambda r: (r["mix_slot"], r["mix_copy"], r["doc_id"]))]
    assert [r["doc_id"] for r in corpus_pipeline.mix(spark, docs, SMALL).collect()] == want and len({r["mix_slot"] for r in slots}) > 100


def test_odd_rows_and_empty_tables_pass_all_stages(spark):
    for rows in (odd_rows(), []):
        docs = documents(spark, rows, clashes=True)
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL)
            assert name == "training_order" or docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.count() == (1 if rows else 0)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="given tables are absent")
def test_run_keeps_clean_documents_and_drops_leaks_and_copies(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    items = [" ".join(words_of(r["text"])) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    shards = sorted(corpus_pipeline.run(spark, SMALL).collect(), key=lambda r: r["shard"])
    classes = {int(i): int(c) for i, c, _ in brute([(i, t) for i, t in docs.items()])}
    clean = {i for i, t in docs.items() if not any(f" {x} " in f" {' '.join(words_of(t))} " for x in items)}
    want = {i for i in docs if classes[i] == i and i in clean}
    assert {i for r in shards for i in r["doc_ids"]} == want
    data = np.frombuffer(b"".join(r["payload"] for r in shards), DTYPE).reshape(-1, shards[0]["stride"] // 2)
    order, encoding, held, texts = Permutation(len(data)), read_encoding(), [], set()
    for token in data[order.slot(np.arange(len(data)))].ravel().tolist():
        if token == END:
            texts.add(encoding.decode(held))
            held = []
        else:
            held.append(token)
    assert texts - {""} == {docs[i] for i in want}
