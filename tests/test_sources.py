"""Readers and writers on small files."""

from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from helpers import rows_of
from protomatch.operators.control import length_class
from protomatch.operators.enrich import add_spacer_details
from protomatch.operators.parse import coerce_numbers, parse_ids
from protomatch.sources import (
    drop_header_lines,
    pairs_to_lines,
    read_fasta,
    read_hits,
    read_hits_tables,
    read_imgvr_metadata,
    read_nucleoid_table,
    read_phage_lengths,
    read_phage_names,
    read_search_results,
    read_spacer_details,
    read_spacer_pairs,
    read_strain_names,
    read_taxonomy,
    write_length_classes,
    write_score_table,
)
from protomatch.sources.staging import SharedStage


def written(tmp_path, name, text):
    path = tmp_path / name
    path.write_bytes(text.encode())
    return str(path)


def test_hits_keep_odd_numbers_as_text_and_lose_carriage_returns(spark, tmp_path):
    path = written(tmp_path, "h.txt", "G-Cr1-Sp1\tT1\t+\t12\td\t1\t0\tACGT\t32\r\nG-Cr1-Sp2\tT2\t-\tx\td\tNA\t0\tNN\tx\r\n")
    df = read_hits(spark, path, "TypeIE", "gb>150kb", "shuffled")
    assert rows_of(df, "position", "mismatches", "alignment_length", "system", "target_database", "run") == [
        (12, "1", "32", "TypeIE", "gb>150kb", "shuffled"), (None, None, "x", "TypeIE", "gb>150kb", "shuffled")]
    both = read_search_results(spark, [(path, "TypeIE", "gb>150kb", "a"), (path, "TypeIF", "gb<150kb", "b")])
    assert both.count() == 4


def test_lookups(spark, tmp_path):
    names = written(tmp_path, "n", "target.id\ttarget.GCA\tspecies\r\nT1\tC1\tphage x\r\n")
    assert rows_of(read_phage_names(spark, names), "target_id", "target_gca", "phage") == [("T1", "C1", "phage x")]
    lengths = written(tmp_path, "l", "any\theader\there\nc1\tC1\t500\r\nc2\tC1\t600\n")
    assert rows_of(read_phage_lengths(spark, lengths)) == [("C1", 500), ("C1", 600)]
    meta = written(tmp_path, "m", "T1\tvOTU\tCL\t500\t91.5\r\n")
    assert read_imgvr_metadata(spark, meta).first()["target_completeness"] == 91.5
    details = written(tmp_path, "d", "G\t01\tACGT\t007\tsp\t1.5\tI-E\tGG\t28\tid\r\n")
    row = read_spacer_details(spark, details, "TypeIE").first()
    assert (row["crispr"], row["spacer"], row["repeat_length"], row["id"], row["system"]) == ("01", "007", 28, "id", "TypeIE")
    assert read_strain_names(spark, written(tmp_path, "s", "GCF_1\tk12\n")).first()["strain"] == "k12"
    assert read_taxonomy(spark, written(tmp_path, "t", "RS_GCF_1.1\td__B\n")).first()["taxonomy"] == "d__B"


def test_na_and_empty_cells_are_missing_in_every_reader(spark, tmp_path):
    hits = read_hits(spark, written(tmp_path, "h", "G-Cr1-Sp1\tNA\t+\tNA\t\t1\t0\tNA\t32\r\n"), "s", "gb>150kb", "r")
    assert rows_of(hits, "spacer_id", "target_id", "position", "details", "alignment_seq") == [("G-Cr1-Sp1", None, None, None, None)]
    names = read_phage_names(spark, written(tmp_path, "n", "target.id\ttarget.GCA\tspecies\nNA\tC1\tNA\r\n"))
    assert rows_of(names, "target_id", "target_gca", "phage") == [(None, "C1", None)]
    assert rows_of(read_phage_lengths(spark, written(tmp_path, "l", "a\tb\tc\nc1\tNA\tNA\r\n"))) == [(None, None)]
    meta = read_imgvr_metadata(spark, written(tmp_path, "m", "NA\tNA\tCL\tNA\tNA\r\n"))
    assert rows_of(meta) == [(None, None, "CL", None, None)]
    details = read_spacer_details(spark, written(tmp_path, "d", "G\t01\tNA\tNA\tsp\tNA\t\tGG\tNA\tid\r\n"))
    row = details.first()
    assert [row[c] for c in ("spacer_seq", "spacer", "crispr_score", "crispr_type", "repeat_length")] == [None] * 5
    assert rows_of(read_strain_names(spark, written(tmp_path, "s", "NA\tNA\n"))) == [(None, None)]
    assert rows_of(read_taxonomy(spark, written(tmp_path, "t", "NA\t\n"))) == [(None, None)]


def test_a_missing_spacer_sequence_has_no_score(spark, tmp_path):
    hits = read_hits(spark, written(tmp_path, "h2", "G-Cr1-Sp1\tT1\t+\t1\td\t0\t0\tAC\t32\n"), "s", "gb>150kb", "r")
    details = read_spacer_details(spark, written(tmp_path, "d2", "G\t1\tNA\t1\tsp\t1\tI\tGG\t2\tid\n")).drop("spacer_id")
    row = add_spacer_details(coerce_numbers(parse_ids(hits)), details).first()
    assert row["spacer_length"] is None and row["score"] is None


def test_nucleoid_tables_have_a_declared_schema(spark, tmp_path):
    head = "target_id\tnucleoid_forming\tshell_id\ttubulin_id\tshell_evalue\ttubulin_evalue\tshell_description\ttubulin_description\textra\r\n"
    path = written(tmp_path, "nf", head + "T1\tNF\tNA\tt\t1e-5\t\tx\ty\tz\r\n")
    table = read_nucleoid_table(spark, path, "target_id", text=True)
    assert rows_of(table, "target_id", "shell_id", "shell_evalue", "tubulin_evalue", "extra") == [("T1", None, "1e-5", None, "z")]
    table.write.parquet(str(tmp_path / "nf.parquet"))
    assert rows_of(read_nucleoid_table(spark, str(tmp_path / "nf.parquet"), "target_id")) == rows_of(table)
    with pytest.raises(AnalysisException):
        read_nucleoid_table(spark, str(tmp_path / "nf.parquet")).collect()


def test_stored_hits_are_stacked_by_name_with_typed_columns(spark, tmp_path):
    from helpers import hits

    a, b = hits(spark, {"target_id": "A"}), hits(spark, {"target_id": "B"}).drop("details").withColumn("score", F.lit(7))
    a.write.parquet(str(tmp_path / "a"))
    b.write.parquet(str(tmp_path / "b"))
    both = read_hits_tables(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert rows_of(both, "target_id", "score", "details") == [("A", 30.0, "q"), ("B", 7.0, None)]
    with pytest.raises(AnalysisException):
        a.drop("score").write.parquet(str(tmp_path / "c"))
        read_hits_tables(spark, str(tmp_path / "c")).collect()


def test_files_of_equal_tags_are_one_scan(spark, tmp_path):
    paths = [written(tmp_path, f"h{k}", f"G-Cr1-Sp{k}\tT1\t+\t12\td\t1\t0\tACGT\t32\n") for k in range(6)]
    table = read_search_results(spark, [(p, "TypeIE", "gb>150kb", "a" if k % 2 else "b") for k, p in enumerate(paths)])
    assert table.count() == 6
    assert table._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2


def test_length_classes_are_directories(spark, tmp_path):
    targets = length_class(spark.createDataFrame([("a", 10), ("b", 200_000), ("c", None)], "target_id string, target_length bigint"))
    write_length_classes(targets, str(tmp_path / "classes"))
    back = spark.read.parquet(str(tmp_path / "classes"))
    assert rows_of(back, "target_id", "size_class") == rows_of(targets, "target_id", "size_class")
    assert len(list((tmp_path / "classes").glob("size_class=*"))) == 3


def test_spacers_in_several_tokens_are_put_together(spark, tmp_path):
    path = written(tmp_path, "p3", ">a ACGT GGTT\tac\n>b\n")
    assert rows_of(read_spacer_pairs(spark, path)) == [("ACGTGGTTAC", "a"), (None, "b")]


def test_pairs_become_lines_and_sequences(spark, tmp_path):
    path = written(tmp_path, "p", ">a ACGT\r\n  >b\t gg\n\n")
    lines = pairs_to_lines(spark.read.text(path))
    assert rows_of(lines, "line") == [(">a",), (">b",), ("ACGT",), ("gg",)]
    assert rows_of(read_spacer_pairs(spark, path)) == [("ACGT", "a"), ("GG", "b")]


def test_header_lines_hold_an_at_sign_anywhere(spark):
    df = spark.createDataFrame([("@head",), ("mid @ line",), ("kept",), (None,)], "value string")
    assert rows_of(drop_header_lines(df)) == [("kept",), (None,)]


def test_fasta_records_span_lines(spark, tmp_path):
    path = written(tmp_path, "f.fa", ">a one two\r\nACGT\r\nac\r\n>b\nGG\n\nTT>T\n>c last\n")
    assert rows_of(read_fasta(spark, path), "seq_id", "description", "seq") == [
        ("a", "one two", "ACGTAC"), ("b", None, "GGTT>T"), ("c", "last", "")]


def test_score_table_is_one_sorted_file(spark, tmp_path):
    df = spark.createDataFrame([(20.0, 1), (18.0, None)], "score double, n int")
    write_score_table(df, str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("part-*"))
    assert len(files) == 1 and files[0].read_text().split() == ["score,n", "18.0,", "20.0,1"]


def test_stage_reads_back_and_discards(spark, tmp_path):
    stage = SharedStage(spark, str(tmp_path))
    df = stage(spark.range(3).filter("id > 5"), "empty")
    assert df.columns == ["id"] and df.count() == 0
    stage.discard()
    assert list(tmp_path.iterdir()) == []
