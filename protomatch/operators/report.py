"""Score tables, taxonomy-annotated hits and host-target relationships."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from protomatch.functions import number_text, total_order, unique_count
from protomatch.operators.collapse import SEPARATOR
from protomatch.operators.enrich import NOT_NUCLEOID_FORMING
from protomatch.operators.joins import left_lookup, null_safe_join
from protomatch.operators.parse import strip_version
from protomatch.operators.places import with_places
from protomatch.sources.staging import Stage, lazily

LENGTH_CUTOFF = 200_000
SCORE_FLOOR = 18
ANNOTATED_SCORE = 25
TOP_SCORE = 26
HEADINGS = tuple(f"{s}_{r}" for s in ("TypeIE", "TypeIF", "TypeIII") for r in ("non-shuffled", "shuffled"))


def nucleoid_forming() -> Column:
    """True unless the label is exactly the negative one; a mixed label passes."""
    return F.col("nucleoid_forming") != NOT_NUCLEOID_FORMING


def score_counts(hits: DataFrame, size: str | None = None, nucleoid_only: bool = False,
                 cutoff: int = LENGTH_CUTOFF, floor: int = SCORE_FLOOR) -> DataFrame:
    """Hits per (system, run tag, score), scores at or below ``floor`` in one bin."""
    if size == "large":
        hits = hits.filter(F.col("target_length") >= cutoff)
    elif size == "small":
        hits = hits.filter(F.col("target_length") < cutoff)
    elif size is not None:
        raise ValueError(f"size must be 'large', 'small' or None, not {size!r}")
    if nucleoid_only:
        hits = hits.filter(nucleoid_forming())
    return hits.groupBy("system", "shuffled", _binned(floor)).agg(F.count(F.lit(1)).alias("score_freq"))


def _binned(floor: int) -> Column:
    return F.when(F.col("score") <= floor, F.lit(float(floor))).otherwise(F.col("score")).alias("score")


def flagged_counts(hits: DataFrame, cutoff: int = LENGTH_CUTOFF, floor: int = SCORE_FLOOR) -> DataFrame:
    """Counts from which every score table follows, in one aggregate: ``large`` (NULL without a length) and ``nucleoid`` tell them apart."""
    flags = [(F.col("target_length") >= cutoff).alias("large"), F.coalesce(nucleoid_forming(), F.lit(False)).alias("nucleoid")]
    return hits.groupBy("system", "shuffled", _binned(floor), *flags).agg(F.count(F.lit(1)).alias("score_freq"))


def counts_table(counts: DataFrame, headings: Sequence[str] | None = None) -> DataFrame:
    """Counts as a table of one column per system and run tag; without ``headings`` reads ``counts`` twice, so from a stored table."""
    heading = F.concat_ws("_", "system", "shuffled")
    if headings:
        missing = F.raise_error(F.concat(F.lit("no column of the score table for heading "), heading))
        heading = F.when(heading.isin(list(headings)), heading).otherwise(missing)
    grouped = counts.withColumn("heading", heading).groupBy("score")
    pivot = grouped.pivot("heading", list(headings)) if headings else grouped.pivot("heading")
    return pivot.agg(F.sum("score_freq")).orderBy(F.col("score").asc_nulls_last())


def score_table(hits: DataFrame, size: str | None = None, nucleoid_only: bool = False,
                cutoff: int = LENGTH_CUTOFF, floor: int = SCORE_FLOOR,
                headings: Sequence[str] | None = None, stage: Stage = lazily) -> DataFrame:
    """Score frequencies with one column per system and run tag; absent cells are NULL.

    The columns come from the data unless ``headings`` names them, which fixes
    their order and saves a job; a heading that is in the data and not among
    them is an error when the table is computed. With a ``stage`` the counts are stored
    first, so that the columns are looked up in them and ``hits`` are computed once.
    """
    return counts_table(stage(score_counts(hits, size, nucleoid_only, cutoff, floor), "score_counts"), headings)


def normalise_taxonomy(taxonomy: DataFrame) -> DataFrame:
    """Assembly accession without database prefix and version; other prefixes stay and never match."""
    return taxonomy.withColumn("gcf_tax", strip_version(F.regexp_replace("gcf_tax", "RS_", "")))


def annotate_taxonomy(hits: DataFrame, taxonomy: DataFrame, min_score: float = ANNOTATED_SCORE,
                      match_nulls: bool = False) -> DataFrame:
    """Well-scored hits on nucleus-forming targets with the taxonomy of their host."""
    kept = hits.filter(nucleoid_forming() & (F.col("score") >= min_score))
    return left_lookup(kept.withColumn("gcf_tax", strip_version(F.col("gcf"))),
                       normalise_taxonomy(taxonomy), ["gcf_tax"], match_nulls)


def top_hits(hits: DataFrame, min_score: float = TOP_SCORE) -> DataFrame:
    return hits.filter((F.col("score") >= min_score) & nucleoid_forming())


def host_target_stats(hits: DataFrame) -> DataFrame:
    """Hits and distinct targets of each host and target cluster."""
    return (
        hits.groupBy("gcf", "target_gca", "target_id").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("gcf", "target_gca").agg(
            F.sum("n").alias("host_cluster_hits"),
            F.count(F.lit(1)).alias("targets_in_relationship"),
        )
    )


def add_host_target_stats(hits: DataFrame) -> DataFrame:
    """Attach ``host_target_stats`` to every hit."""
    keys = ["gcf", "target_gca"]
    return null_safe_join(hits, host_target_stats(hits), keys, null_safe=keys)


def _score_lists(hits: DataFrame, keys: list[str]) -> DataFrame:
    """All scores per relationship, best first. Equal scores are counted, not gathered."""
    entry = F.struct(F.col("score").isNotNull().alias("known"), F.col("score"), F.col("n"))
    repeated = F.flatten(F.transform("scores", lambda s: F.array_repeat(number_text(s["score"]), s["n"].cast("int"))))
    return (
        hits.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*keys).agg(F.sort_array(F.collect_list(entry), asc=False).alias("scores"))
        .select(*keys, F.array_join(repeated, SEPARATOR).alias("scores_all"))
    )


def long_scores(hits: DataFrame, stage: Stage | None = None) -> DataFrame:
    """One row per relationship and score, best first: how often it occurred (``n``) and its ``score_place``."""
    keys = ["gcf", "target_gca", "target_id"]
    counted = hits.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("n"))
    return with_places(counted, keys, [F.col("score").desc_nulls_last()], "score_place", stage)


def host_target_representatives(hits: DataFrame) -> DataFrame:
    """Best hit per (host, target cluster, target) with all its scores listed.

    One missing score removes the relationship, as it has no maximum.
    """
    keys = ["gcf", "target_gca", "target_id"]
    others = [c for c in sorted(hits.columns) if c not in (*keys, "score")]
    order = [F.col("score").desc_nulls_first(), *total_order(*others)]
    best = (
        hits.withColumn("__row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        .filter(F.col("__row") == 1).drop("__row")
        .filter(F.col("score").isNotNull())
    )
    best = null_safe_join(best, host_target_stats(hits), keys[:2], null_safe=keys[:2])
    return null_safe_join(best, _score_lists(hits, keys), keys, null_safe=keys)


def relationship_summary(representatives: DataFrame) -> DataFrame:
    """One row: relationships, hosts, target contigs and target clusters."""
    return representatives.agg(
        F.count(F.lit(1)).alias("total_host_target_relationships"),
        unique_count(F.col("gcf")).alias("unique_hosts"),
        unique_count(F.col("target_id")).alias("unique_target_contigs"),
        unique_count(F.col("target_gca")).alias("unique_target_clusters"),
    )
