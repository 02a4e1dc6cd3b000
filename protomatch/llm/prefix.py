"""Places and running sizes inside large groups, without a group in one task.

A row's key is a hexadecimal digest. Its first digits choose one of 256 ranges,
the next ones one of 256 parts of the range. Sizes are summed per part (map-side
first), parts are accumulated inside their range and ranges inside their group;
only the rows of one part are ever sorted together. All three steps are windows
over at most 256 rows or one part, however large the group is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGE_DIGITS = PART_DIGITS = 2


def with_running(rows: DataFrame, group: list[str], key: str, order: list[str], size: str) -> DataFrame:
    """Adds ``rank`` (rows before), ``before`` (their sizes), ``group_rows`` and ``group_size``.

    ``group`` columns must not be null; the order inside a group is ``key``, then
    ``order``; rows equal in all of these are interchangeable.
    """
    rows = rows.withColumns({
        "range_": F.substring(key, 1, RANGE_DIGITS), "part_": F.substring(key, 1 + RANGE_DIGITS, PART_DIGITS),
    })
    parts = rows.groupBy(*group, "range_", "part_").agg(F.count("*").alias("n"), F.sum(size).alias("s"))
    ranges = parts.groupBy(*group, "range_").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    everything = Window.partitionBy(*group)
    earlier = everything.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        *group, "range_",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("range_n"), F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("range_s"),
        F.sum("n").over(everything).alias("group_rows"), F.sum("s").over(everything).alias("group_size"),
    )
    earlier = Window.partitionBy(*group, "range_").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *group, "range_", "part_",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_n"), F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("part_s"),
    ).join(ranges, [*group, "range_"])
    inside = Window.partitionBy(*group, "range_", "part_").orderBy(key, *order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({
        "own_n": F.row_number().over(inside) - 1, "own_s": F.coalesce(F.sum(size).over(before), F.lit(0)),
    }).join(parts, [*group, "range_", "part_"]).withColumns({
        "rank": F.col("range_n") + F.col("part_n") + F.col("own_n"), "before": F.col("range_s") + F.col("part_s") + F.col("own_s"),
    }).drop("range_", "part_", "range_n", "range_s", "part_n", "part_s", "own_n", "own_s")
