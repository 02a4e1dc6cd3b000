"""One row per spacer over all databases of a system."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from protomatch.functions import total_order
from protomatch.functions.nulls import check_null_policy

# Assumed order: the database whose genomes are the better described comes first.
DATABASE_PREFERENCE = ("gb<150kb", "gb>150kb", "IMGVR<150kb", "IMGVR>150kb")
TIE_BREAK = (
    "target_database", "gcf", "crispr", "spacer", "shared_spacer", "details", "mismatches", "alignment_length",
    "strain", "run",
)


def dedupe_spacers(hits: DataFrame, database_preference: Sequence[str] = DATABASE_PREFERENCE,
                   null_policy: str = "propagate", count_before: bool = False) -> DataFrame:
    """Best row per (system, run tag, spacer): top score, then longest target, then preferred database.

    A missing score spoils its spacer, and so does a missing length among the
    top scores: sorting missing values first puts them in the chosen row, which
    is then dropped. Rows past the first are discarded before the shuffle.
    ``spacer_hits`` is the count after the reduction, hence 1;
    ``count_before`` adds the count before it.
    """
    group = ["system", "shuffled", "spacer_seq"]
    propagate = check_null_policy(null_policy) == "propagate"
    rank = F.array_position(F.array(*[F.lit(d) for d in database_preference]), F.col("target_database"))

    def best(column: str):
        key = F.col(column)
        return key.desc_nulls_first() if propagate else key.desc_nulls_last()

    # Databases outside the list come after those in it.
    order = [best("score"), best("target_length"),
             F.nullif(rank, F.lit(0)).asc_nulls_last(),
             *total_order(*[c for c in TIE_BREAK if c in hits.columns])]
    first = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    chosen = (
        hits.withColumn("__row", first).filter(F.col("__row") == 1).drop("__row")
        .filter(F.col("score").isNotNull() & F.col("target_length").isNotNull())
        .withColumn("spacer_hits", F.lit(1).cast("bigint"))
    )
    if not count_before:
        return chosen
    before = hits.groupBy(*group).agg(F.count(F.lit(1)).alias("spacer_hits_before"))
    return chosen.join(before, group)
