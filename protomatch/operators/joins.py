"""Equi-joins against lookups.

No broadcast hints: Spark broadcasts a side only after checking its size, at
planning time or from the finished shuffle, and otherwise joins by shuffle with
oversized partitions split at run time.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], null_safe: Sequence[str] = (),
                   how: str = "inner") -> DataFrame:
    """Join on ``on``; the keys also named in ``null_safe`` match missing to missing."""
    renamed = {k: f"__right_{k}" for k in on}
    other = right.withColumnsRenamed(renamed)
    terms = [
        F.col(k).eqNullSafe(F.col(renamed[k])) if k in null_safe else F.col(k) == F.col(renamed[k]) for k in on
    ]
    return left.join(other, reduce(lambda a, b: a & b, terms), how).drop(*renamed.values())


def left_lookup(left: DataFrame, lookup: DataFrame, on: Sequence[str], match_nulls: bool = False) -> DataFrame:
    """Left join keeping the fan-out of repeated lookup keys.

    A missing key never matches by default; ``match_nulls`` lets it match a
    missing key of the lookup.
    """
    clash = (set(left.columns) & set(lookup.columns)) - set(on)
    if clash:
        raise ValueError(f"columns on both sides of the lookup: {sorted(clash)}")
    if match_nulls:
        return null_safe_join(left, lookup, on, null_safe=on, how="left")
    return left.join(lookup, list(on), "left")


def repeated_keys(lookup: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, hence multiply the rows they match."""
    return lookup.groupBy(*on).count().filter(F.col("count") > 1)
