"""Lookup joins and scores that turn parsed hits into the match table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protomatch.operators.joins import left_lookup
from protomatch.operators.parse import assembly_key
from protomatch.sources.schemas import NUCLEOID_COLUMNS

NOT_NUCLEOID_FORMING = "nonNF"
MISMATCH_WEIGHT = 2
GAP_WEIGHT = 3

MATCH_COLUMN_ORDER = (
    "gcf", "strain", "target_id", "target_gca", "phage", "target_length", "shuffled", "notes",
    "spacer_length", "alignment_length", "mismatches", "gaps", "score", "crispr_type", "crispr_score",
    "repeat_seq", "repeat_length", "spacer_seq",
)
CLASSIFIED_COLUMN_ORDER = ("gcf", "target_gca", "strain", "phage", "nucleoid_forming", "score", "notes")
_IMGVR_CLASHES = ("target_length", "phage", "imgvr_cluster", "cluster_count", "target_completeness")


def front(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Move ``columns`` to the front and keep the rest in place."""
    first = [c for c in columns if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def _keys(left: DataFrame, right: DataFrame, *keys: str) -> list[str]:
    """Lookups that come one per system carry a ``system`` column and join on it too."""
    return [*keys, "system"] if "system" in left.columns and "system" in right.columns else list(keys)


def spacer_keys(hits: DataFrame, details: DataFrame) -> list[str]:
    """What spacers are looked up by."""
    return _keys(hits, details, "gcf", "crispr", "spacer")


def add_spacer_details(hits: DataFrame, details: DataFrame, match_nulls: bool = False,
                       mismatch_weight: int = MISMATCH_WEIGHT, gap_weight: int = GAP_WEIGHT) -> DataFrame:
    """Spacer sequence and array details by (host, array, spacer), then length and score."""
    joined = left_lookup(hits, details, spacer_keys(hits, details), match_nulls)
    return joined.withColumns({"spacer_length": F.length("spacer_seq"), "notes": F.lit("")}).withColumn(
        "score",
        (F.col("spacer_length") - mismatch_weight * F.col("mismatches") - F.col("gaps") * gap_weight).cast("double"),
    )


def add_strain_names(hits: DataFrame, strains: DataFrame, match_nulls: bool = False) -> DataFrame:
    """Strain by assembly accession; names may carry text after the accession."""
    named = strains.withColumn("assembly", assembly_key(F.col("assembly")))
    keyed = hits.withColumn("assembly", assembly_key(F.col("gcf")))
    return left_lookup(keyed, named, _keys(keyed, named, "assembly"), match_nulls)


def genbank_targets(names: DataFrame, lengths: DataFrame, match_nulls: bool = False) -> DataFrame:
    """Target names with their genome length; several contig lengths repeat the target."""
    return left_lookup(names, lengths.select("target_gca", "target_length"), ["target_gca"], match_nulls)


def add_targets(hits: DataFrame, targets: DataFrame, match_nulls: bool = False) -> DataFrame:
    return left_lookup(hits, targets, ["target_id"], match_nulls)


def without_ambiguous_runs(matches: DataFrame) -> DataFrame:
    """Drop alignments with two or more N in a row; a missing alignment stays."""
    return matches.filter(~F.coalesce(F.col("alignment_seq").contains("NN"), F.lit(False)))


def fill_label(matches: DataFrame) -> DataFrame:
    """The negative label where there is none."""
    return matches.withColumn(
        "nucleoid_forming", F.coalesce(F.col("nucleoid_forming"), F.lit(NOT_NUCLEOID_FORMING))
    )


def classify_genbank(matches: DataFrame, nucleoid: DataFrame, match_nulls: bool = False) -> DataFrame:
    """Nucleoid labels by genome accession; these genomes count as complete."""
    labels = nucleoid.select("target_gca", *NUCLEOID_COLUMNS)
    joined = left_lookup(matches, labels, ["target_gca"], match_nulls)
    return fill_label(joined.withColumn("target_completeness", F.lit(100.0)))


def classify_imgvr(matches: DataFrame, nucleoid: DataFrame, match_nulls: bool = False) -> DataFrame:
    """Nucleoid labels by target; columns the matches already have are dropped from the lookup."""
    labels = nucleoid.drop(*_IMGVR_CLASHES).select("target_id", *NUCLEOID_COLUMNS)
    return fill_label(left_lookup(matches, labels, ["target_id"], match_nulls))


def ungapped(classified: DataFrame) -> DataFrame:
    return front(classified, CLASSIFIED_COLUMN_ORDER).filter(F.col("gaps") == 0)


def without_gaps(hits: DataFrame) -> DataFrame:
    """Raw hits whose gaps read as none: those that ``ungapped`` keeps."""
    return hits.filter(F.col("gaps").try_cast("double") == 0)
