"""Missing-value, ordering and formatting rules shared by every operator.

The analysis treats a missing value as contagious (one missing score spoils the
group maximum), counts it as a value of its own, prints it as ``NA`` and sorts
it last. Spark's defaults differ on each of those points, so the rules are
spelled out here once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_POLICIES = ("propagate", "ignore")


def check_null_policy(policy: str) -> str:
    if policy not in NULL_POLICIES:
        raise ValueError(f"null_policy must be one of {NULL_POLICIES}, not {policy!r}")
    return policy


def strict(value: Column, known: Column, rows: Column, null_policy: str = "propagate") -> Column:
    """``value`` when every one of ``rows`` is ``known``; NULL otherwise.

    With ``null_policy="ignore"`` missing inputs do not spoil the value.
    """
    if check_null_policy(null_policy) == "ignore":
        return value
    return F.when(known == rows, value)


def na_text(value: Column) -> Column:
    """Text form of a value with a missing one printed as ``NA``."""
    return F.coalesce(value.cast("string"), F.lit("NA"))


def number_text(value: Column) -> Column:
    """Text form of a number: whole values without a decimal point, missing as ``NA``."""
    whole = value.cast("double") == F.floor(value.cast("double"))
    return na_text(F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string")))


def unique_count(value: Column) -> Column:
    """Aggregate: number of distinct values, a missing value counting as one."""
    return F.countDistinct(value) + F.coalesce(F.max(value.isNull().cast("int")), F.lit(0))


def total_order(*columns: str) -> list[Column]:
    """Ascending sort keys with missing values last."""
    return [F.col(c).asc_nulls_last() for c in columns]


def keeps_nulls_last(column: str, descending: bool = False) -> list[Column]:
    """Struct fields that make ``sort_array`` order ``column`` with missing values last."""
    value = -F.col(column) if descending else F.col(column)
    return [F.col(column).isNull().alias(f"{column}_missing"), value.alias(f"{column}_order")]
