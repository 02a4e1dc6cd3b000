"""The registered queries, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protomatch.operators import control, profile, report
from protomatch.operators.collapse import COLLAPSED, SEPARATOR, collapse_targets, long_hits, long_targets
from protomatch.operators.dedupe import dedupe_spacers
from protomatch.operators.enrich import (
    add_spacer_details,
    add_strain_names,
    add_targets,
    genbank_targets,
    ungapped,
    without_ambiguous_runs,
)
from protomatch.operators.parse import coerce_numbers, parse_ids
from protomatch.operators.search import SearchSettings, search
from protomatch.operators.seed_index import build_index, search_index
from protomatch.operators.select import SPACER_KEYS, select_hits
from protomatch.plans import classified_kind, classified_matches, process_all, stack, tagged_search, ungapped_matches
from protomatch.plans.workflow import is_kind
from protomatch.sources import LAYOUTS, drop_header_lines, pairs_to_lines, parse_cells, rejected_cells, schemas
from protomatch.sources.staging import SharedStage, Stage
from protomatch_checks import fixtures

Query = Callable[[SparkSession, str], DataFrame]


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_ids(fixtures.search_hits(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    look = fixtures.lookups(spark, sf_dir)
    return add_spacer_details(coerce_numbers(_parsed(spark, sf_dir)), look.spacer_details)


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified hits of both kinds of database, before the gap filter."""
    return classified_matches(fixtures.search_hits(spark, sf_dir), fixtures.lookups(spark, sf_dir))


def _ungapped(spark: SparkSession, sf_dir: str, stage: Stage) -> DataFrame:
    """Classified hits of both kinds of database without gaps."""
    return ungapped_matches(fixtures.search_hits(spark, sf_dir), fixtures.lookups(spark, sf_dir), stage=stage)


def _selected(spark: SparkSession, sf_dir: str, upto: str, stage: SharedStage | None = None) -> DataFrame:
    """Hits after the rules, from classified hits without gaps, stored by spacer for the rules that read them several times."""
    stage = stage or SharedStage(spark)
    hits, buckets = stage.dealt(_ungapped(spark, sf_dir, stage), "ungapped", SPACER_KEYS)
    return select_hits(hits, upto=upto, stage=stage, buckets=buckets)


def parse_ids_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir)


def coerce_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coerce_numbers(fixtures.search_hits(spark, sf_dir))


def fasta_pairs_to_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fixtures.target_sequences(spark, sf_dir).select(
        "target_id", F.concat(F.lit(">"), F.col("target_id"), F.lit("  "), F.col("seq")).alias("value")
    )
    return pairs_to_lines(pairs, keep=["target_id"])


def drop_header_lines_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = fixtures.tables(spark, sf_dir, "documents")["documents"]
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "value"))
    return drop_header_lines(lines)


def target_lookup_genbank(spark: SparkSession, sf_dir: str) -> DataFrame:
    look = fixtures.lookups(spark, sf_dir)
    hits = _parsed(spark, sf_dir).filter(is_kind("genbank"))
    return add_targets(hits, genbank_targets(look.phage_names, look.phage_lengths))


def target_lookup_imgvr(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _parsed(spark, sf_dir).filter(is_kind("imgvr"))
    return add_targets(hits, fixtures.lookups(spark, sf_dir).imgvr_metadata)


def spacer_join_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


def strain_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_strain_names(_parsed(spark, sf_dir), fixtures.lookups(spark, sf_dir).strain_names)


def no_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_ambiguous_runs(_parsed(spark, sf_dir))


def classify_genbank_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    look = fixtures.lookups(spark, sf_dir)
    return classified_kind(fixtures.search_hits(spark, sf_dir).filter(is_kind("genbank")), look, "genbank")


def classify_imgvr_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    look = fixtures.lookups(spark, sf_dir)
    return classified_kind(fixtures.search_hits(spark, sf_dir).filter(is_kind("imgvr")), look, "imgvr")


def ungapped_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ungapped(spark, sf_dir, SharedStage(spark))


def top_score_per_spacer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir, "score")


def top_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir, "completeness")


def host_target_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir, "support")


def collapse_targets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of each spacer as lists, from raw hits of all databases, all rules applied."""
    stage = SharedStage(spark)
    selected, buckets = stage.dealt(_selected(spark, sf_dir, "support", stage), "selected", SPACER_KEYS)
    collapsed = collapse_targets(selected, as_array=True, buckets=buckets)
    # Lists are compared as the text that the other form of the collapse gives.
    return collapsed.withColumns({c: F.array_join(F.col(c).cast("array<string>"), SEPARATOR) for c in COLLAPSED})


def collapse_long_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of each spacer as numbered rows."""
    return long_targets(_selected(spark, sf_dir, "support"))


def collapse_long_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of each spacer as numbered rows, target by target."""
    return long_hits(_selected(spark, sf_dir, "support"))


def union_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return process_all(fixtures.search_hits(spark, sf_dir), fixtures.lookups(spark, sf_dir), stage=SharedStage(spark))


def union_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected hits of each system as a table of its own, stacked."""
    selected = SharedStage(spark)(_selected(spark, sf_dir, "support"), "selected")
    return stack([selected.filter(F.col("system") == s) for s in ("TypeIII", "TypeIE", "TypeIF")])


def dedupe_spacers_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe_spacers(union_databases(spark, sf_dir), count_before=True)


def _unique_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe_spacers(union_databases(spark, sf_dir))


def score_table_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.score_table(_unique_hits(spark, sf_dir), stage=SharedStage(spark))


def score_table_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.score_table(_unique_hits(spark, sf_dir), size="large", stage=SharedStage(spark))


def score_table_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.score_table(_unique_hits(spark, sf_dir), size="small", stage=SharedStage(spark))


def score_table_nf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.score_table(_unique_hits(spark, sf_dir), nucleoid_only=True, stage=SharedStage(spark))


def taxonomy_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    taxonomy = fixtures.derived(spark, sf_dir, fixtures.TAXONOMY)
    return report.annotate_taxonomy(_unique_hits(spark, sf_dir), taxonomy)


def _top_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = ungapped(_classified(spark, sf_dir)).select("gcf", "target_gca", "target_id", "score", "nucleoid_forming")
    return SharedStage(spark)(report.top_hits(table), "top_hits")


def host_cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.add_host_target_stats(_top_hits(spark, sf_dir))


def host_target_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.host_target_representatives(_top_hits(spark, sf_dir))


def long_score_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.long_scores(_top_hits(spark, sf_dir))


def relationship_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.relationship_summary(host_target_representative(spark, sf_dir))


def seed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(fixtures.spacer_sequences(spark, sf_dir), fixtures.target_sequences(spark, sf_dir),
                  SearchSettings(both_strands=False))


def seed_search_both_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(fixtures.spacer_sequences(spark, sf_dir, reverse_some=True),
                  fixtures.target_sequences(spark, sf_dir))


def prepared_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets prepared once, searched by two sets of spacers."""
    index = build_index(fixtures.target_sequences(spark, sf_dir), f"{SharedStage(spark).root}/index")
    one = search_index(fixtures.spacer_sequences(spark, sf_dir), index, SearchSettings(both_strands=False))
    both = search_index(fixtures.spacer_sequences(spark, sf_dir, reverse_some=True), index)
    return stack([one.withColumn("search", F.lit("one strand")), both.withColumn("search", F.lit("both strands"))])


def shuffled_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.shuffle_sequences(fixtures.target_sequences(spark, sf_dir), "target_id", key="md5")


def profile_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    screened = profile.screen_profiles(fixtures.proteins(spark, sf_dir), fixtures.emissions(spark))
    return screened.select("protein_id", "profile", "score")


def genome_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    proteins = fixtures.proteins(spark, sf_dir)
    hits = profile.best_hits(profile.screen_profiles(proteins, fixtures.emissions(spark)))
    return profile.classify_genomes(proteins.select("genome_id").distinct(), hits, fixtures.THRESHOLDS)


def length_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    look = fixtures.lookups(spark, sf_dir)
    return control.length_class(genbank_targets(look.phage_names, look.phage_lengths))


def missing_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_cells(fixtures.derived(spark, sf_dir, fixtures.RAW_CELLS), schemas.HITS)


def rejected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a hit file that the reader cannot read as they stand."""
    found = rejected_cells(fixtures.derived(spark, sf_dir, fixtures.RAW_LINES), LAYOUTS["hits"])
    return found.select("l_orderkey", "l_linenumber", "cells", "reason", F.array_join("bad_columns", ",").alias("bad_columns"))


def split_on_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target ids that hold hyphens of their own; only the last one starts the control tag."""
    hits = fixtures.search_hits(spark, sf_dir).withColumn("target_id", F.concat(F.lit("virus-"), "target_id"))
    return parse_ids(hits, "last")


def search_to_score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From sequences to the score table: search, control, processing, one hit per spacer, counts."""
    spacers = fixtures.searched_spacers(spark, sf_dir)
    passage = F.floor(F.regexp_extract("spacer_id", r"-Sp(\d+)", 1).cast("bigint") / 100)
    system = F.element_at(F.array(F.lit("TypeIE"), F.lit("TypeIF"), F.lit("TypeIII")), (passage % 3 + 1).cast("int"))
    hits = tagged_search(spacers.select("spacer_id", "seq"), fixtures.target_sequences(spark, sf_dir), system,
                         fixtures.SEARCHED_DATABASE, control_key="md5")
    unique = dedupe_spacers(process_all(hits, fixtures.searched_lookups(spark, sf_dir)))
    # Few of these spacers hit the control, so the columns are named; others would be an error.
    return report.score_table(unique, headings=report.HEADINGS)


def _gapped(spark: SparkSession, sf_dir: str, settings: SearchSettings) -> DataFrame:
    found = search(fixtures.edited_spacers(spark, sf_dir), fixtures.target_sequences(spark, sf_dir), settings)
    return found.select("spacer_id", "target_id", "strand", "position", "mismatches", "gaps", "alignment_length")


def gapped_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gapped(spark, sf_dir, SearchSettings(gaps=fixtures.GAPS))


def gapped_search_long_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gapped(spark, sf_dir, SearchSettings(seed=fixtures.LONG_SEED, gaps=fixtures.GAPS))


QUERIES: dict[str, Query] = {
    "q01_parse_ids": parse_ids_query,
    "q02_coerce_numeric": coerce_numeric,
    "q03_fasta_pairs_to_lines": fasta_pairs_to_lines,
    "q04_drop_header_lines": drop_header_lines_query,
    "q05_target_lookup_genbank": target_lookup_genbank,
    "q06_target_lookup_imgvr": target_lookup_imgvr,
    "q07_spacer_join_score": spacer_join_score,
    "q08_strain_prefix_join": strain_prefix_join,
    "q09_no_ambiguous": no_ambiguous,
    "q10_classify_genbank": classify_genbank_query,
    "q11_classify_imgvr": classify_imgvr_query,
    "q12_ungapped": ungapped_query,
    "q13_top_score_per_spacer": top_score_per_spacer,
    "q14_top_completeness": top_completeness,
    "q15_host_target_support": host_target_support,
    "q16_collapse_targets": collapse_targets_query,
    "q17_union_databases": union_databases,
    "q18_union_systems": union_systems,
    "q19_dedupe_spacers": dedupe_spacers_query,
    "q20_score_table_all": score_table_all,
    "q21_score_table_large": score_table_large,
    "q22_score_table_small": score_table_small,
    "q23_score_table_nf": score_table_nf,
    "q24_taxonomy_hits": taxonomy_hits,
    "q25_host_cluster_stats": host_cluster_stats,
    "q26_host_target_representative": host_target_representative,
    "q27_relationship_summary": relationship_summary,
    "q28_seed_search": seed_search,
    "q29_seed_search_both_strands": seed_search_both_strands,
    "q30_shuffled_control": shuffled_control,
    "q31_profile_screen": profile_screen,
    "q32_genome_classification": genome_classification,
    "q33_length_partition": length_partition,
    "q34_missing_cells": missing_cells,
    "q35_split_on_last": split_on_last,
    "q36_search_to_score_table": search_to_score_table,
    "q37_gapped_search": gapped_search,
    "q38_gapped_search_long_seed": gapped_search_long_seed,
    "q43_prepared_search": prepared_search,
    "q39_collapse_long_targets": collapse_long_targets,
    "q40_collapse_long_hits": collapse_long_hits,
    "q41_long_score_list": long_score_list,
    "q42_rejected_lines": rejected_lines,
}
