"""Splitting packed identifiers and coercing alignment numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC_COLUMNS = ("alignment_length", "mismatches", "gaps")
REAL_RUN = "non-shuffled"
# A versioned assembly accession, e.g. three letters, _, nine digits, dot, version.
ACCESSION_LENGTH = 15


def before(value: Column, separator: str) -> Column:
    """First piece of a text split at every ``separator``."""
    return F.substring_index(value, separator, 1)


def after(value: Column, separator: str) -> Column:
    """Second piece; NULL when there is none. Surplus pieces are dropped."""
    return F.when(value.contains(separator), F.substring_index(F.substring_index(value, separator, 2), separator, -1))


def coerce_numbers(hits: DataFrame) -> DataFrame:
    """Alignment numbers from text; anything else becomes NULL."""
    return hits.withColumns({c: F.col(c).try_cast("double") for c in NUMERIC_COLUMNS})


def split_target_id(value: Column, split_on: str = "first") -> tuple[Column, Column]:
    """(target, control tag). ``split_on="last"`` keeps hyphens inside the target id."""
    if split_on == "first":
        return before(value, "-"), after(value, "-")
    if split_on == "last":
        tail = F.when(value.contains("-"), F.substring_index(value, "-", -1))
        head = F.substr(value, F.lit(1), F.length(value) - F.length(tail) - 1)
        return F.coalesce(head, value), tail
    raise ValueError(f"split_on must be 'first' or 'last', not {split_on!r}")


def parse_ids(hits: DataFrame, split_on: str = "first") -> DataFrame:
    """Host, array, spacer and duplicate tag from ``spacer_id``; control tag from ``target_id``."""
    target, tag = split_target_id(F.col("target_id"), split_on)
    rest = [c for c in hits.columns if c not in ("spacer_id", "target_id")]
    array, spacer = F.col("__array"), F.col("__spacer")
    return (
        hits.withColumn("__array", after(F.col("spacer_id"), "-Cr"))
        .withColumn("__spacer", after(array, "-Sp"))
        .select(
            before(F.col("spacer_id"), "-Cr").alias("gcf"),
            before(array, "-Sp").alias("crispr"),
            before(spacer, "-dup-").alias("spacer"),
            after(spacer, "-dup-").alias("shared_spacer"),
            target.alias("target_id"),
            F.coalesce(tag, F.lit(REAL_RUN)).alias("shuffled"),
            *rest,
        )
    )


def assembly_key(value: Column) -> Column:
    return F.substring(value, 1, ACCESSION_LENGTH)


def strip_version(value: Column) -> Column:
    """Everything before the first dot."""
    return F.substring_index(value, ".", 1)
