"""Lines of text tables that could not be read as they stand.

The readers turn what they cannot read into missing values: a short line lacks its last cells, a long one
loses its further cells, a word in a number column goes. A missing score or completeness later removes all
hits of its spacer, so these lines should be looked at. They are a second output: which file and
line, what is wrong, and the line itself; and counted per file and reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from protomatch.sources import schemas
from protomatch.sources.readers import missing_text

TOO_FEW, TOO_MANY, NO_NUMBER = "too few cells", "too many cells", "no number"


@dataclass(frozen=True)
class Layout:
    """Columns of a tab-separated table, those that hold numbers though they are read as text, and whether a header leads it."""

    schema: str
    numbers: tuple[str, ...] = ()
    header: bool = False

    def columns(self) -> list[tuple[str, str]]:
        """Names, and the type as which a cell has to be readable."""
        fields = [f.strip().rsplit(" ", 1) for f in self.schema.split(",")]
        return [(n, "double" if n in self.numbers else t) for n, t in fields]


LAYOUTS = {
    "hits": Layout(schemas.HITS, ("mismatches", "gaps", "alignment_length")),
    "phage_lengths": Layout(schemas.PHAGE_LENGTHS, header=True),
    "imgvr_metadata": Layout(schemas.IMGVR_METADATA),
    "spacer_details": Layout(schemas.SPACER_DETAILS),
    "strain_names": Layout(schemas.STRAIN_NAMES),
    "taxonomy": Layout(schemas.TAXONOMY),
}


def rejected_cells(lines: DataFrame, layout: Layout, line_col: str = "value") -> DataFrame:
    """Lines that do not fit the layout, with ``cells`` (how many), ``reason`` and ``bad_columns``; empty lines are none.

    Missing cells (empty or ``NA``) fit any column. A line with several faults is listed once, under the first of
    too few cells, too many cells, no number.
    """
    clash = {"cells", "reason", "bad_columns", "cells_"} & set(lines.columns)
    if clash:
        raise ValueError(f"columns of the result are already there: {sorted(clash)}")
    columns = layout.columns()
    # Filters are not moved below a generated column, so a line is made and split once, whatever looks at its cells.
    cut = F.split(F.rtrim(F.col(line_col), F.lit("\r")), "\t", -1)
    split = lines.select("*", F.explode(F.array(cut)).alias("cells_")).filter((F.size("cells_") > 1) | (F.get("cells_", F.lit(0)) != ""))

    def bad(i: int, name: str, kind: str) -> Column:
        cell = missing_text(F.get("cells_", F.lit(i)))
        return F.when(cell.isNotNull() & cell.try_cast(kind).isNull(), F.lit(name))

    words = F.array_compact(F.array(*[bad(i, n, t) for i, (n, t) in enumerate(columns) if t != "string"], F.lit(None).cast("string")))
    n = F.size("cells_")
    reason = (
        F.when(n < len(columns), TOO_FEW).when(n > len(columns), TOO_MANY).when(F.size("bad_columns") > 0, NO_NUMBER)
    )
    return (
        split.withColumn("cells", n).withColumn("bad_columns", words).withColumn("reason", reason)
        .filter(F.col("reason").isNotNull()).drop("cells_")
    )


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of text files as (file, line, value), ``line`` from 1 on in each file.

    A file is read in blocks by many tasks. The lines of a block are numbered as they are
    read, and the lines of the blocks before it are a running sum over the blocks of the file.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value",
        F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return lines.join(blocks, ["file", "block"]).select(
        "file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def rejected_lines(spark: SparkSession, path: str | list[str], reader: str) -> DataFrame:
    """Lines of the files of a reader (``LAYOUTS``) that it cannot read as they stand: file, line, cells, reason, bad_columns, value."""
    layout = LAYOUTS[reader]
    lines = numbered_lines(spark, path)
    if layout.header:
        lines = lines.filter("line > 1")
    return rejected_cells(lines, layout).select("file", "line", "cells", "reason", "bad_columns", "value")


def count_rejected(rejected: DataFrame) -> DataFrame:
    """How many lines of each file were rejected for each reason."""
    return rejected.groupBy("file", "reason").agg(F.count(F.lit(1)).alias("lines"))
