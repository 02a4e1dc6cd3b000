"""Missing values, ordering and formatting, each with its expected answer spelled out."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helpers import hits, rows_of
from protomatch.functions import number_text, strict, unique_count
from protomatch.operators.collapse import collapse_targets
from protomatch.operators.dedupe import dedupe_spacers
from protomatch.operators.enrich import add_spacer_details, add_strain_names, genbank_targets, without_ambiguous_runs
from protomatch.operators.joins import left_lookup, repeated_keys
from protomatch.operators.parse import coerce_numbers, parse_ids, strip_version
from protomatch.operators.report import (
    add_host_target_stats,
    annotate_taxonomy,
    host_target_representatives,
    normalise_taxonomy,
    relationship_summary,
    score_table,
    top_hits,
)
from protomatch.operators.select import select_hits, spacers_without_completeness


def parsed(spark, spacer_id, target_id, **options):
    raw = spark.createDataFrame([(spacer_id, target_id)], "spacer_id string, target_id string")
    return parse_ids(raw, **options).first().asDict()


def test_ids_split_into_parts(spark):
    row = parsed(spark, "GCF_1.1-Cr2-Sp3-dup-4", "T1-shuffled")
    assert row == {"gcf": "GCF_1.1", "crispr": "2", "spacer": "3", "shared_spacer": "4", "target_id": "T1",
                   "shuffled": "shuffled"}


def test_missing_pieces_are_null_and_surplus_ones_dropped(spark):
    row = parsed(spark, "GCF_1.1", "T1-a-b")
    assert (row["crispr"], row["spacer"], row["shared_spacer"]) == (None, None, None)
    assert (row["target_id"], row["shuffled"]) == ("T1", "a")
    assert parsed(spark, "G-Cr1-Sp2", "T1")["shared_spacer"] is None
    assert parsed(spark, "G-Cr1-Cr9-Sp2", "T1")["crispr"] == "1"
    assert parsed(spark, None, None)["gcf"] is None


def test_hyphens_in_target_ids_can_be_kept(spark):
    row = parsed(spark, "G-Cr1-Sp1", "T-1-shuffled", split_on="last")
    assert (row["target_id"], row["shuffled"]) == ("T-1", "shuffled")
    assert parsed(spark, "G-Cr1-Sp1", "T1", split_on="last")["shuffled"] == "non-shuffled"
    with pytest.raises(ValueError):
        parsed(spark, "G", "T", split_on="middle")


def test_words_in_number_columns_become_null(spark):
    raw = spark.createDataFrame([("x", "NA", "3")], "alignment_length string, mismatches string, gaps string")
    assert tuple(coerce_numbers(raw).first()) == (None, None, 3.0)


def test_missing_alignment_is_kept_and_double_n_dropped(spark):
    df = spark.createDataFrame([("A",), ("ANNA",), (None,), ("NAN",)], "alignment_seq string")
    assert rows_of(without_ambiguous_runs(df)) == [("A",), ("NAN",), (None,)]


def test_score_counts_mismatches_twice_and_gaps_thrice(spark):
    found = spark.createDataFrame(
        [("g", "1", "1", 2.0, 1.0), ("g", "1", "2", None, 0.0), ("g", "1", "3", 0.0, 0.0)],
        "gcf string, crispr string, spacer string, mismatches double, gaps double")
    details = spark.createDataFrame([("g", "1", "1", "ACGTACGTAC"), ("g", "1", "2", "ACGT")],
                                    "gcf string, crispr string, spacer string, spacer_seq string")
    rows = {r["spacer"]: r for r in add_spacer_details(found, details).collect()}
    assert rows["1"]["score"] == 3.0 and rows["1"]["notes"] == ""
    assert rows["2"]["score"] is None and rows["2"]["spacer_length"] == 4
    assert rows["3"]["spacer_length"] is None


def test_details_of_another_system_do_not_match(spark):
    found = spark.createDataFrame([("g", "1", "1", 0.0, 0.0, "TypeIE")],
                                  "gcf string, crispr string, spacer string, mismatches double, gaps double, system string")
    details = spark.createDataFrame([("g", "1", "1", "ACGT", "TypeIF")],
                                    "gcf string, crispr string, spacer string, spacer_seq string, system string")
    assert add_spacer_details(found, details).first()["spacer_seq"] is None


def test_strains_match_on_the_accession_prefix(spark):
    found = spark.createDataFrame([("GCF_000000001.1",)], "gcf string")
    strains = spark.createDataFrame([("GCF_000000001.1_ASM9", "k12")], "assembly string, strain string")
    assert add_strain_names(found, strains).first()["strain"] == "k12"


def test_repeated_lookup_keys_multiply_rows(spark):
    names = spark.createDataFrame([("T1", "C1", "p")], "target_id string, target_gca string, phage string")
    lengths = spark.createDataFrame([("C1", 5), ("C1", 6)], "target_gca string, target_length bigint")
    assert genbank_targets(names, lengths).count() == 2
    assert rows_of(repeated_keys(lengths, ["target_gca"])) == [(2, "C1")]


def test_missing_keys_match_only_when_asked(spark):
    left = spark.createDataFrame([(None, 1)], "k string, a int")
    lookup = spark.createDataFrame([(None, 2)], "k string, b int")
    assert left_lookup(left, lookup, ["k"]).first()["b"] is None
    assert left_lookup(left, lookup, ["k"], match_nulls=True).first()["b"] == 2
    with pytest.raises(ValueError):
        left_lookup(left, lookup.withColumn("a", F.lit(1)), ["k"])


def test_strict_maximum_is_spoiled_by_one_missing_value(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "k string, v int")
    def top(policy):
        value = strict(F.max("v"), F.count("v"), F.count(F.lit(1)), policy)
        return rows_of(df.groupBy("k").agg(value.alias("v")), "k", "v")
    assert top("propagate") == [("a", None), ("b", 2)]
    assert top("ignore") == [("a", 1), ("b", 2)]


def test_a_missing_score_removes_the_spacer(spark):
    df = hits(spark, {"spacer_seq": "A", "score": 9.0}, {"spacer_seq": "A", "score": None, "target_id": "T2"},
              {"spacer_seq": "C", "score": 5.0})
    assert rows_of(select_hits(df, "score"), "spacer_seq") == [("C",)]
    assert rows_of(select_hits(df, "score", null_policy="ignore"), "spacer_seq") == [("A",), ("C",)]


def test_a_missing_completeness_counts_only_among_top_scores(spark):
    df = hits(spark,
              {"spacer_seq": "A", "score": 9.0}, {"spacer_seq": "A", "score": 9.0, "target_completeness": None},
              {"spacer_seq": "C", "score": 9.0}, {"spacer_seq": "C", "score": 8.0, "target_completeness": None})
    assert rows_of(select_hits(df, "completeness"), "spacer_seq") == [("C",)]
    assert rows_of(spacers_without_completeness(df), "spacer_seq") == [("A",)]
    assert len(rows_of(select_hits(df, "completeness", null_policy="ignore"))) == 2


def test_counts_are_taken_after_each_rule(spark):
    df = hits(spark,
              {"target_id": "T1", "score": 9.0}, {"target_id": "T2", "score": 9.0, "gcf": "G2"},
              {"target_id": "T3", "score": 7.0},
              {"spacer_seq": "CC", "target_id": "T1", "score": 5.0})
    rows = select_hits(df).filter("spacer_seq = 'ACGT'").collect()
    assert [(r.target_id, r.spacer_hits_total, r.spacer_hits_topscoring, r.host_target_hits, r.spacer_hits_final)
            for r in rows] == [("T1", 3, 2, 2, 1)]


def test_groups_do_not_reach_across_files(spark):
    df = hits(spark, {"score": 9.0}, {"score": 8.0, "run": "shuffled"}, {"score": 7.0, "system": "TypeIF"},
              {"score": 6.0, "target_database": "IMGVR>150kb"})
    assert select_hits(df).count() == 4


def test_collapse_keeps_order_and_prints_missing_as_na(spark):
    df = hits(spark,
              {"target_id": "T2", "target_length": 10, "phage": "x", "position": 7},
              {"target_id": "T1", "target_length": 10, "phage": None, "position": 100000},
              {"target_id": "T3", "target_length": 20, "phage": "x", "strand": "-", "position": 5})
    row = collapse_targets(select_hits(df)).collect()
    assert len(row) == 1
    row = row[0]
    assert row["target_id"] == "T3;T1;T2" and row["phage"] == "x;NA" and row["target_length"] == 20
    assert row["strand"] == "-;+;+" and row["position"] == "5;100000;7"
    assert row["shell_id"] == "NA" and row["spacer_hits_final"] == 1


def test_collapse_repeats_identical_hits_and_keeps_other_differences(spark):
    df = hits(spark, {}, {}, {"gcf": "G2"})
    rows = collapse_targets(select_hits(df.filter("gcf = 'G1'"))).collect()
    assert [(r.gcf, r.strand, r.spacer_hits_final) for r in rows] == [("G1", "+;+", 1)]
    both = hits(spark, {}, {"crispr": "2"})
    rows = collapse_targets(select_hits(both)).collect()
    assert sorted((r.crispr, r.strand, r.spacer_hits_final) for r in rows) == [("1", "+;+", 2), ("2", "+;+", 2)]


def test_collapsed_length_is_spoiled_by_a_missing_one(spark):
    df = hits(spark, {"target_id": "T1"}, {"target_id": "T2", "target_length": None})
    row = collapse_targets(select_hits(df)).first()
    assert row["target_length"] is None and row["target_id"] == "T1;T2"


def test_collapse_can_give_arrays(spark):
    row = collapse_targets(select_hits(hits(spark, {"target_id": "T1"}, {"target_id": "T2"})), as_array=True).first()
    assert row["target_id"] == ["T1", "T2"]


def test_dedupe_prefers_score_then_length_then_database(spark):
    df = hits(spark,
              {"score": 9.0, "target_length": 5, "target_database": "IMGVR<150kb"},
              {"score": 9.0, "target_length": 5, "target_database": "gb>150kb"},
              {"score": 9.0, "target_length": 4, "target_database": "gb<150kb"},
              {"score": 8.0, "target_length": 9, "target_database": "gb<150kb"})
    row = dedupe_spacers(df, count_before=True).collect()
    assert [(r.target_database, r.spacer_hits, r.spacer_hits_before) for r in row] == [("gb>150kb", 1, 4)]
    by_name = dedupe_spacers(df, database_preference=["IMGVR<150kb", "IMGVR>150kb", "gb<150kb"]).first()
    assert by_name["target_database"] == "IMGVR<150kb"
    again = dedupe_spacers(dedupe_spacers(df).drop("spacer_hits"))
    assert rows_of(again) == rows_of(dedupe_spacers(df))


def test_dedupe_drops_spacers_with_missing_values(spark):
    df = hits(spark, {"spacer_seq": "A"}, {"spacer_seq": "A", "score": None},
              {"spacer_seq": "C"}, {"spacer_seq": "C", "target_length": None},
              {"spacer_seq": "G"}, {"spacer_seq": "G", "score": 1.0, "target_length": None})
    assert rows_of(dedupe_spacers(df), "spacer_seq") == [("G",)]
    assert len(rows_of(dedupe_spacers(df, null_policy="ignore"), "spacer_seq")) == 3


def test_score_table_bins_low_scores_and_leaves_absent_cells_null(spark):
    df = hits(spark, {"score": 10.0}, {"score": 18.0}, {"score": 20.0}, {"score": 20.0, "shuffled": "shuffled"},
              {"score": None})
    table = score_table(df, headings=["TypeIE_non-shuffled", "TypeIE_shuffled"])
    assert [tuple(r) for r in table.collect()] == [(18.0, 2, None), (20.0, 1, 1), (None, 1, None)]
    assert score_table(df).columns == table.columns


def test_score_table_filters(spark):
    df = hits(spark, {"target_length": 200_000, "nucleoid_forming": "NF"}, {"target_length": 199_999},
              {"target_length": None, "nucleoid_forming": "nonNF;NF"})
    def total(**options):
        return sum(r[1] for r in score_table(df, headings=["TypeIE_non-shuffled"], **options).collect())
    assert (total(), total(size="large"), total(size="small"), total(nucleoid_only=True)) == (3, 1, 1, 2)
    with pytest.raises(ValueError):
        score_table(df, size="medium")


def test_taxonomy_accessions_lose_prefix_and_version(spark):
    tax = spark.createDataFrame([("RS_GCF_1.1", "b"), ("GB_GCA_2.1", "c")], "gcf_tax string, taxonomy string")
    assert rows_of(normalise_taxonomy(tax), "gcf_tax") == [("GB_GCA_2",), ("GCF_1",)]
    df = hits(spark, {"gcf": "GCF_1.2", "score": 25.0, "nucleoid_forming": "NF"},
              {"gcf": "GCF_2.1", "score": 26.0, "nucleoid_forming": "NF"}, {"score": 24.0, "nucleoid_forming": "NF"},
              {"score": 30.0})
    assert rows_of(annotate_taxonomy(df, tax), "gcf", "taxonomy") == [("GCF_1.2", "b"), ("GCF_2.1", None)]
    assert spark.range(1).select(strip_version(F.lit("a.b.c"))).first()[0] == "a"


def test_host_target_counts_take_a_missing_target_as_one(spark):
    df = top_hits(hits(spark, *[{"nucleoid_forming": "NF", **r} for r in (
        {"target_id": "T1"}, {"target_id": "T1", "score": 27.0}, {"target_id": None},
        {"target_gca": None}, {"score": 25.0})])).select("gcf", "target_gca", "target_id", "score", "nucleoid_forming")
    stats = rows_of(add_host_target_stats(df), "target_gca", "target_id", "host_cluster_hits", "targets_in_relationship")
    assert stats == [("C1", "T1", 3, 2), ("C1", "T1", 3, 2), ("C1", None, 3, 2), (None, "T1", 1, 1)]
    best = host_target_representatives(df)
    assert rows_of(best, "target_gca", "target_id", "score", "scores_all") == [
        ("C1", "T1", 30.0, "30;27"), ("C1", None, 30.0, "30"), (None, "T1", 30.0, "30")]
    assert tuple(relationship_summary(best).first()) == (3, 1, 2, 2)


def test_a_missing_score_removes_the_relationship(spark):
    df = hits(spark, {"score": 30.0}, {"score": None}, {"target_id": "T2"}).select(
        "gcf", "target_gca", "target_id", "score", "nucleoid_forming")
    assert rows_of(host_target_representatives(df), "target_id") == [("T2",)]


def test_unique_count_and_number_text(spark):
    df = spark.createDataFrame([(1.0,), (1.5,), (None,), (100000.0,)], "v double")
    assert df.agg(unique_count(F.col("v"))).first()[0] == 4
    assert [r[0] for r in df.select(number_text(F.col("v"))).collect()] == ["1", "1.5", "NA", "100000"]
