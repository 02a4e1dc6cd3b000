"""The analysis from raw search hits to reports, as lazy plans and as a run to disk."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from protomatch.operators.collapse import collapse_targets
from protomatch.operators.control import SHUFFLED_TAG, shuffle_sequences
from protomatch.operators.dedupe import DATABASE_PREFERENCE, dedupe_spacers
from protomatch.operators.enrich import (
    GAP_WEIGHT,
    MATCH_COLUMN_ORDER,
    MISMATCH_WEIGHT,
    add_spacer_details,
    add_strain_names,
    add_targets,
    classify_genbank,
    classify_imgvr,
    fill_label,
    front,
    genbank_targets,
    spacer_keys,
    ungapped,
    without_ambiguous_runs,
    without_gaps,
)
from protomatch.operators.parse import NUMERIC_COLUMNS, REAL_RUN, coerce_numbers, parse_ids
from protomatch.operators.report import (
    ANNOTATED_SCORE,
    LENGTH_CUTOFF,
    SCORE_FLOOR,
    TOP_SCORE,
    annotate_taxonomy,
    counts_table,
    flagged_counts,
    host_target_representatives,
    relationship_summary,
    top_hits,
)
from protomatch.operators.search import SearchSettings, query_extent, search
from protomatch.operators.seed_index import SeedIndex, build_index, search_index
from protomatch.operators.select import SPACER_KEYS, select_hits
from protomatch.plans.manifest import Digests, Manifest, content_digests, digest
from protomatch.sources import sinks
from protomatch.sources.staging import SharedStage, Stage, dealt, lazily

KINDS = ("genbank", "imgvr")


@dataclass(frozen=True)
class AnalysisSettings:
    """Every parameter of the analysis in one place; the defaults are the published ones.

    ``other_databases`` is the kind of hits whose database label is missing or
    starts neither with ``gb`` nor with ``IMGVR``; unless set, such a hit is an error.
    ``headings`` fixes the columns of the score tables; they come from the data otherwise.
    """

    split_on: str = "first"
    mismatch_weight: int = MISMATCH_WEIGHT
    gap_weight: int = GAP_WEIGHT
    match_nulls: bool = False
    null_policy: str = "propagate"
    database_preference: Sequence[str] = DATABASE_PREFERENCE
    other_databases: str | None = None
    length_cutoff: int = LENGTH_CUTOFF
    score_floor: int = SCORE_FLOOR
    annotated_score: float = ANNOTATED_SCORE
    top_score: float = TOP_SCORE
    headings: Sequence[str] | None = None


DEFAULTS = AnalysisSettings()


@dataclass(frozen=True)
class Lookups:
    """Side tables of the analysis."""

    spacer_details: DataFrame
    strain_names: DataFrame
    phage_names: DataFrame
    phage_lengths: DataFrame
    imgvr_metadata: DataFrame
    nucleoid_genbank: DataFrame
    nucleoid_imgvr: DataFrame


def index_with_control(targets: DataFrame, folder: str, settings: SearchSettings = SearchSettings(),
                       seed: int = 42, control_key: str = "xxhash64") -> dict[str, SeedIndex]:
    """Prepare the targets and their shuffled control for several searches, by run."""
    runs = {REAL_RUN: targets, SHUFFLED_TAG: shuffle_sequences(targets, "target_id", seed, control_key)}
    return {run: build_index(t, f"{folder}/{run}", settings) for run, t in runs.items()}


def search_with_control(queries: DataFrame, targets: DataFrame | Mapping[str, SeedIndex], settings: SearchSettings = SearchSettings(),
                        seed: int = 42, control_key: str = "xxhash64") -> DataFrame:
    """Search the targets and their shuffled control alike; ``run`` tells which a hit is from.

    Targets prepared by ``index_with_control`` have their control with them.
    """
    if isinstance(targets, Mapping):
        return stack([search_index(queries, index, settings).withColumn("run", F.lit(run)) for run, index in targets.items()])
    extent = query_extent(queries, settings)
    runs = {REAL_RUN: targets, SHUFFLED_TAG: shuffle_sequences(targets, "target_id", seed, control_key)}
    return stack([search(queries, t, settings, extent).withColumn("run", F.lit(run)) for run, t in runs.items()])


def tagged_search(queries: DataFrame, targets: DataFrame | Mapping[str, SeedIndex], system: str | Column, target_database: str | Column,
                  settings: SearchSettings = SearchSettings(), seed: int = 42, control_key: str = "xxhash64") -> DataFrame:
    """Search with control, tagged with its system and database: rows as the analysis takes them.

    Tags are texts, or columns over the hits. Numbers are text, as in result
    files, so both sources can be stacked.
    """
    found = search_with_control(queries, targets, settings, seed, control_key)
    return found.withColumns({
        **{c: F.col(c).cast("string") for c in NUMERIC_COLUMNS},
        "position": F.col("position").cast("bigint"), "system": F.lit(system), "target_database": F.lit(target_database),
    })


def is_kind(target_kind: str, other: str | None = None) -> Column:
    """Hits searched against databases of this kind, by the database label; each hit is of one kind.

    Labels that are missing or unknown are of the ``other`` kind, or an error without it.
    """
    label = F.col("target_database")
    unknown = F.lit(other) if other else F.raise_error(F.concat(
        F.lit("unknown kind of target database: "), F.coalesce(label, F.lit("missing")))).cast("string")
    kind = F.when(label.startswith("IMGVR"), "imgvr").when(label.startswith("gb"), "genbank").otherwise(unknown)
    if target_kind not in KINDS or other not in (*KINDS, None):
        raise ValueError(f"kinds of target database are {KINDS}")
    return kind == target_kind


def match_table(hits: DataFrame, lookups: Lookups, target_kind: str, split_on: str = "first",
                settings: AnalysisSettings | None = None) -> DataFrame:
    """Parsed, scored and named matches of one kind of target database, gapped ones included."""
    use = settings or AnalysisSettings(split_on=split_on)
    targets = (
        genbank_targets(lookups.phage_names.select("target_id", "target_gca", "phage"), lookups.phage_lengths,
                        use.match_nulls)
        if target_kind == "genbank" else lookups.imgvr_metadata
    )
    parsed = parse_ids(coerce_numbers(without_ambiguous_runs(hits)), use.split_on)
    scored = add_spacer_details(parsed, lookups.spacer_details, use.match_nulls, use.mismatch_weight, use.gap_weight)
    named = add_targets(add_strain_names(scored, lookups.strain_names, use.match_nulls), targets, use.match_nulls)
    return front(named, MATCH_COLUMN_ORDER)


def stack(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables, matched by column name; columns a table lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def all_matches(hits: DataFrame, lookups: Lookups, settings: AnalysisSettings = DEFAULTS) -> DataFrame:
    """The match table of both kinds of database; reads the hits once per kind."""
    return stack([
        match_table(hits.filter(is_kind(k, settings.other_databases)), lookups, k, settings=settings) for k in KINDS
    ])


def _classify_kind(matches: DataFrame, lookups: Lookups, kind: str, match_nulls: bool) -> DataFrame:
    if kind == "genbank":
        return classify_genbank(matches, lookups.nucleoid_genbank, match_nulls)
    return classify_imgvr(matches, lookups.nucleoid_imgvr, match_nulls)


def classify(matches: DataFrame, lookups: Lookups, settings: AnalysisSettings = DEFAULTS) -> DataFrame:
    """Nucleoid labels, looked up by genome for one kind of database and by target for the other.

    Reads ``matches`` once per kind, so they should come from a table; from raw
    hits ``classified_matches`` is the shorter plan.
    """
    return stack([
        _classify_kind(matches.filter(is_kind(k, settings.other_databases)), lookups, k, settings.match_nulls)
        for k in KINDS
    ])


def _labelled_targets(lookups: Lookups, kind: str) -> DataFrame:
    """Targets of one kind of database with their labels, those included that only the labels know."""
    if kind == "genbank":
        names = genbank_targets(lookups.phage_names.select("target_id", "target_gca", "phage"), lookups.phage_lengths)
        return classify_genbank(names, lookups.nucleoid_genbank).drop("target_completeness")
    known = lookups.imgvr_metadata.join(lookups.nucleoid_imgvr.select("target_id").distinct(), ["target_id"], "full")
    return classify_imgvr(known, lookups.nucleoid_imgvr)


def classified_kind(hits: DataFrame, lookups: Lookups, kind: str, settings: AnalysisSettings = DEFAULTS, stage: Stage = lazily) -> DataFrame:
    """Matches of one kind of database with their labels: the rows that classifying its ``match_table`` gives.

    A label depends on the target, so the targets are labelled and the hits look up both at once, before the
    spacer's letters widen them. Where missing keys match, hits without a target may have a label, so there
    the match table itself is classified. With a shared ``stage`` hits go from lookup to lookup in buckets of its key, which take less room
    than a shuffle; the spacers' details should then be in buckets too.
    """
    classified = _classify_kind(match_table(hits, lookups, kind, settings=settings), lookups, kind, settings.match_nulls)
    if settings.match_nulls:
        return classified
    parsed = parse_ids(coerce_numbers(without_ambiguous_runs(hits)), settings.split_on)
    parsed, _ = dealt(stage, parsed, f"parsed_{kind}", ["target_id"])
    found = fill_label(add_targets(parsed, _labelled_targets(lookups, kind)))
    found, _ = dealt(stage, found, f"labelled_{kind}", spacer_keys(found, lookups.spacer_details))
    if kind == "genbank":
        found = found.withColumn("target_completeness", F.lit(100.0))
    scored = add_spacer_details(found, lookups.spacer_details, mismatch_weight=settings.mismatch_weight, gap_weight=settings.gap_weight)
    return add_strain_names(scored, lookups.strain_names).select(*classified.columns)


def classified_matches(hits: DataFrame, lookups: Lookups, settings: AnalysisSettings = DEFAULTS) -> DataFrame:
    """Matches with their labels, each kind labelled in its own branch: two scans of the hits."""
    return stack([
        classified_kind(hits.filter(is_kind(k, settings.other_databases)), lookups, k, settings) for k in KINDS
    ])


def ungapped_matches(hits: DataFrame, lookups: Lookups, settings: AnalysisSettings = DEFAULTS, stage: Stage = lazily) -> DataFrame:
    """Matches with their labels and without gaps; with a shared ``stage`` looked up by way of buckets."""
    if not isinstance(stage, SharedStage) or settings.match_nulls:
        return ungapped(classified_matches(hits, lookups, settings))
    details, _ = stage.dealt(lookups.spacer_details, "spacer_details", spacer_keys(hits, lookups.spacer_details))
    use = replace(lookups, spacer_details=details)
    plain = without_gaps(hits)
    return ungapped(stack([
        classified_kind(plain.filter(is_kind(k, settings.other_databases)), use, k, settings, stage) for k in KINDS
    ]))


def process_matches(matches: DataFrame, lookups: Lookups, null_policy: str | None = None,
                    stage: Stage | None = None, settings: AnalysisSettings = DEFAULTS) -> DataFrame:
    """Match table to processed hits: classify, keep ungapped, select, collapse.

    Groups are kept apart by the file columns, so one call for any number of
    systems, databases and runs equals processing each result file on its own
    and stacking the results. Intermediate tables are read several times and go
    to the shared folder by default; ``stage=lazily`` repeats their plans instead,
    which is for small data only.
    """
    stage = stage or SharedStage(matches.sparkSession)
    return _process(ungapped(classify(matches, lookups, settings)), None, null_policy or settings.null_policy, stage)


def _process(kept: DataFrame, buckets: int | None, null_policy: str, stage: Stage) -> DataFrame:
    selected = select_hits(kept, null_policy=null_policy, stage=stage, buckets=buckets)
    stored, dealt_to = dealt(stage, selected, "selected", SPACER_KEYS)
    return collapse_targets(stored, null_policy, buckets=dealt_to)


def process_all(hits: DataFrame, lookups: Lookups, null_policy: str | None = None, stage: Stage | None = None,
                settings: AnalysisSettings = DEFAULTS) -> DataFrame:
    """Processed hits of every system, database and run from one table of raw hits; the hits are scanned twice.

    Matches are stored with their labels and without those that have gaps, so no lookup is done again when they are read, and
    in buckets of their spacer, so that no rule moves whole rows.
    """
    stage = stage or SharedStage(hits.sparkSession)
    kept, buckets = dealt(stage, ungapped_matches(hits, lookups, settings, stage), "ungapped", SPACER_KEYS)
    return _process(kept, buckets, null_policy or settings.null_policy, stage)


def score_tables(unique: DataFrame, headings: Sequence[str] | None = None,
                 settings: AnalysisSettings = DEFAULTS, stage: Stage = lazily) -> dict[str, DataFrame]:
    """The four score tables of de-duplicated hits, from one aggregate; with a ``stage`` the hits are read once for all."""
    counts = stage(flagged_counts(unique, settings.length_cutoff, settings.score_floor), "flagged_counts")
    rows = {"all": F.lit(True), "large": F.col("large"), "small": ~F.col("large"), "nucleoid": F.col("nucleoid")}
    return {name: counts_table(counts.filter(only), headings or settings.headings) for name, only in rows.items()}


RESULTS = (
    "target_matches", "processed", "hits", "unique_hits", "score_table_all", "score_table_large", "score_table_small",
    "score_table_nucleoid", "nucleoid_hits", "top_hits", "host_target_representatives", "relationship_summary",
)


def _inputs(hits: DataFrame, lookups: Lookups, taxonomy: DataFrame, settings: AnalysisSettings, headings: Sequence[str] | None) -> dict[str, Digests]:
    """Digests of every result from what it is made of."""
    of = {f.name: content_digests(getattr(lookups, f.name)) for f in fields(Lookups)}
    part = lambda name, *more: digest(name, *[getattr(settings, s) for s in more])
    match = digest(part("target_matches", "split_on", "mismatch_weight", "gap_weight", "match_nulls", "other_databases"), *[
        of[n] for n in ("spacer_details", "strain_names", "phage_names", "phage_lengths", "imgvr_metadata")])
    labels = (of["nucleoid_genbank"], of["nucleoid_imgvr"])
    matches = {p: digest(match, d) for p, d in content_digests(hits, sinks.RUN_PARTITIONS).items()}
    process = digest(part("processed", "match_nulls", "null_policy", "other_databases"), *labels)
    processed = {p: digest(process, d) for p, d in matches.items()}
    systems = {(p[0],) for p in processed}
    stacked = {s: digest("hits", {p: d for p, d in processed.items() if p[0] == s[0]}) for s in systems}
    unique = digest(part("unique_hits", "database_preference", "null_policy"), stacked)
    scores = digest(part("scores", "length_cutoff", "score_floor", "headings"), headings, unique)
    top = digest(part("top_hits", "top_score", "match_nulls", "other_databases"), *labels, matches)
    single = {
        "unique_hits": unique, **{f"score_table_{n}": digest(n, scores) for n in ("all", "large", "small", "nucleoid")},
        "nucleoid_hits": digest(part("nucleoid_hits", "annotated_score", "match_nulls"), unique, content_digests(taxonomy)),
        "top_hits": top, "host_target_representatives": digest("representatives", top), "relationship_summary": digest("summary", top),
    }
    return {"target_matches": matches, "processed": processed, "hits": stacked, **{n: {(): d} for n, d in single.items()}}


def run_workflow(hits: DataFrame, lookups: Lookups, taxonomy: DataFrame, out: str,
                 headings: Sequence[str] | None = None, settings: AnalysisSettings = DEFAULTS) -> dict[str, str]:
    """Run everything and write each table below ``out``; returns where each one is.

    Each step continues from the table the previous one wrote, so a lost
    executor costs one step. A further run with the same ``out`` compares digests of the
    inputs and settings with those of the tables (``manifest``): what depends on a change is made again, of
    partitioned tables only the search results (system, database, run) that changed, and the rest stays.
    Tables that are no result go to the shared checkpoint folder and are
    deleted at the end, also when a step fails.
    """
    spark = hits.sparkSession
    paths = {name: f"{out}/{name}" for name in RESULTS}
    manifest, wanted = Manifest(spark, out), _inputs(hits, lookups, taxonomy, settings, headings)
    only = lambda table, rows: table if rows is None else table.filter(rows)

    def stored(name: str, shape: DataFrame) -> DataFrame:
        # The schema is kept so an empty table reads back too.
        return spark.read.schema(shape.schema).parquet(paths[name])

    def single(name: str, table: DataFrame) -> DataFrame:
        manifest.refresh(name, wanted[name], lambda _: table, sinks.write_annotated_hits)
        return stored(name, table)

    made = all_matches(hits, lookups, settings)
    manifest.refresh("target_matches", wanted["target_matches"], lambda rows: all_matches(only(hits, rows), lookups, settings),
                     sinks.write_match_table, sinks.RUN_PARTITIONS)
    matches = stored("target_matches", made)
    stage = SharedStage(spark)
    try:
        processed = manifest.refresh(
            "processed", wanted["processed"],
            lambda rows: process_matches(only(matches, rows), lookups, stage=stage, settings=settings), sinks.write_processed, sinks.RUN_PARTITIONS)
    finally:
        stage.discard()
    processed = spark.read.parquet(paths["processed"]) if processed is None else stored("processed", processed)
    manifest.refresh("hits", wanted["hits"], lambda rows: only(processed, rows), sinks.write_hits_table, ("system",))
    unique = single("unique_hits", dedupe_spacers(stored("hits", processed), settings.database_preference, settings.null_policy))
    if any(manifest.known(f"score_table_{n}") != wanted[f"score_table_{n}"] for n in ("all", "large", "small", "nucleoid")):
        stage = SharedStage(spark)
        try:
            for name, table in score_tables(unique, headings, settings, stage).items():
                manifest.refresh(f"score_table_{name}", wanted[f"score_table_{name}"], lambda _, t=table: t, sinks.write_score_table)
        finally:
            stage.discard()
    single("nucleoid_hits", annotate_taxonomy(unique, taxonomy, settings.annotated_score, settings.match_nulls))
    best = single("top_hits", top_hits(ungapped(classify(matches, lookups, settings)), settings.top_score))
    chosen = single("host_target_representatives", host_target_representatives(best))
    single("relationship_summary", relationship_summary(chosen))
    return paths
