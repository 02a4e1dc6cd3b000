"""Table outputs. Big tables go to partitioned parquet, the small pivots to one CSV file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN_PARTITIONS = ("system", "target_database", "run")


def _write_partitioned(table: DataFrame, path: str, mode: str, partitions_only: bool, *partitions: str) -> None:
    """One directory per partition value, best scores first within each file.

    Rebalancing gathers each directory's rows into few files and splits those
    of a large one over several tasks. ``partitions_only`` overwrites the directories
    that the rows belong to and leaves the others as they are.
    """
    (
        table.hint("rebalance", *partitions)
        .sortWithinPartitions(*partitions, F.col("score").desc_nulls_last())
        .write.mode(mode).option("partitionOverwriteMode", "dynamic" if partitions_only else "static")
        .partitionBy(*partitions).parquet(path)
    )


def write_match_table(matches: DataFrame, path: str, mode: str = "error", partitions_only: bool = False) -> None:
    """Scored matches before classification; rows with gaps are still in."""
    _write_partitioned(matches, path, mode, partitions_only, *RUN_PARTITIONS)


def write_processed(hits: DataFrame, path: str, mode: str = "error", partitions_only: bool = False) -> None:
    """Processed hits, one directory per search result they came from."""
    _write_partitioned(hits, path, mode, partitions_only, *RUN_PARTITIONS)


def write_hits_table(hits: DataFrame, path: str, mode: str = "error", partitions_only: bool = False) -> None:
    """Processed hits of all databases, one directory per system."""
    _write_partitioned(hits, path, mode, partitions_only, "system")


def write_length_classes(targets: DataFrame, path: str, mode: str = "error") -> None:
    """Targets with a ``size_class``, one directory per class, for searches of one class at a time."""
    targets.hint("rebalance", "size_class").write.mode(mode).partitionBy("size_class").parquet(path)


def write_annotated_hits(hits: DataFrame, path: str, mode: str = "error") -> None:
    hits.write.mode(mode).parquet(path)


def write_score_table(table: DataFrame, path: str, mode: str = "error") -> None:
    """One row per score, so a single sorted file; absent cells stay empty."""
    table.coalesce(1).sortWithinPartitions(F.col("score").asc_nulls_last()).write.mode(mode).option(
        "header", True
    ).csv(path)
