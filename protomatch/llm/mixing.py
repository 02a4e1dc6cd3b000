"""Mix sources to target weights by proportionate-fair scheduling, SQL functions only.

Shares are whole numbers of any size and the schedule keeps them exactly. Sources lie side
by side on the line of all shares; halving the line again and again makes a binary tree
with a source in each leaf. A node passes each of its slots to one of its two halves. Of
the half with ``a`` of the node's ``t`` shares, block k (from 0) is released at slot
floor(k * t / a) and has its deadline at (k + 1) * t / a; the released block with the
earliest deadline runs, on ties that of the left half. Of two halves, the one whose next deadline
is earlier has always been released, so a block's slot is the number of earlier deadlines and
comes out in closed form. Slots follow from arithmetic along the path of a
source, for every block by itself, and no task steps through a schedule.

A node's half is less than one slot away from its part of the node's slots, so a
source with share w is less than the sum of w / (shares of the node) over its path away
from its target. Neighbours on the line fill the larger cells, so shares of the nodes grow
geometrically but for a few steps: the sum stays near 6 at most by this sketch of an argument, not a full
proof, and a search for bad cases found 5 (``tests/llm/test_mixing.py`` has a smaller one). Slots
hold an eighth of a block (``block_bytes``, ``PARTS`` = 8), so at every prefix of the mix a source is less
than one block away from its target.

The mix ends when every source has been read once. Until then shorter sources
start again, so their documents are there more than once and no document is lost.

A document belongs to the part of a block in which its first byte lies, in the order of the
digest of its id. Parts and copies follow from running sizes (see ``prefix``). The table of
sources and their paths is written to the shared folder; Spark broadcasts it only
below its own size limit.

Defined cases: a null source is a source of its own; a null text has no bytes, and
so does an empty one, both are placed like any other; documents without an id come
first in their source; repeated rows are separate documents; other columns are
kept as they are, so the columns added here must not be among them; an empty
table gives an empty mix. Shares must be whole and at least 1 and add up to less than 2**30;
products of shares and slots are checked 64-bit integers. Any number of sources will do.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from protomatch.llm.prefix import with_running
from protomatch.llm.staging import shared_folder, written

BLOCK_BYTES = 1 << 16
# Slots that a block is scheduled in.
PARTS = 8
EXPONENT = 0.8
# Resolution of tempered shares: the least share is 4 in a thousand million.
POINTS = 1 << 28
# Halvings of the line of shares: cells are smaller than one share then.
DEPTH = 30
ADDED = ("mix_slot", "mix_block", "mix_copy")


def _name(source: Column) -> Column:
    """Sources as keys that are never null."""
    return F.when(source.isNull(), "none").otherwise(F.concat(F.lit("source "), source.cast("string")))


def _sizes(text_col: str, size_col: str | None) -> Column:
    """Bytes of the text, or the caller's own sizes; missing ones are 0."""
    size = F.octet_length(F.col(text_col)) if size_col is None else F.col(size_col)
    return F.coalesce(size, F.lit(0)).cast("long")


def tempered_shares(
    docs: DataFrame, *, source_col: str = "source", text_col: str = "text", size_col: str | None = None, exponent: float = EXPONENT, points: int = POINTS,
    least_bytes: int = BLOCK_BYTES // PARTS,
) -> DataFrame:
    """Shares in proportion to bytes raised to ``exponent``, about ``points`` in all and at least 1 each (finer than a block of any mix up to some TB).

    An exponent below 1 raises small sources. A source counts with at least ``least_bytes``, one slot: it takes a whole
    one, and with a smaller share the mix would go on until that slot comes. One row per source: ``mix_source``, ``share``.
    """
    sizes = docs.groupBy(_name(F.col(source_col)).alias("mix_source")).agg(F.sum(_sizes(text_col, size_col)).alias("bytes"))
    total = F.pow(F.greatest(F.col("bytes"), F.lit(least_bytes)).cast("double"), F.lit(exponent))
    whole = sizes.agg(F.sum(total).alias("whole"))
    share = F.greatest(F.lit(1), F.round(F.lit(float(points)) * total / F.greatest(F.col("whole"), F.lit(1.0))).cast("int"))
    return sizes.join(F.broadcast(whole)).select("mix_source", share.alias("share"))  # one row


def given_shares(docs: DataFrame, shares: Mapping[str | None, int], *, default: int = 1, source_col: str = "source") -> DataFrame:
    """The caller's shares for the sources that occur; ``default`` for those not named."""
    if any(int(x) != x or x < 1 for x in (*shares.values(), default)):
        raise ValueError("shares are whole numbers of at least 1")
    share = F.lit(default)
    for source, value in shares.items():
        name = F.lit("none" if source is None else f"source {source}")
        share = F.when(F.col("mix_source") == name, F.lit(int(value))).otherwise(share)
    return docs.select(_name(F.col(source_col)).alias("mix_source")).distinct().select("mix_source", share.alias("share"))


def schedule(shares: DataFrame) -> DataFrame:
    """The tree of halvings: ``mix_source``, ``share`` and ``path``.

    ``path`` lists from the leaf to the root the nodes that share their parent with another one:
    ``own`` shares of ``whole``, and whether they are the ``right`` half.
    """
    line = shares.select("mix_source", F.col("share").cast("long").alias("share"), F.md5("mix_source").alias("key_"), F.lit("all").alias("all_"))
    line = with_running(line, ["all_"], "key_", ["mix_source"], "share")
    # Twice the middle of the source's stretch of the line, so that it is whole.
    middle, ends = F.col("before") * 2 + F.col("share"), F.col("group_size") * 2
    cells = line.withColumn("middle", middle).withColumn("ends", ends).select(
        "mix_source", "share", F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("depth"), "middle", "ends",
    ).select("mix_source", "share", "depth", F.expr("shiftleft(middle, depth) div ends").alias("cell"))
    nodes = cells.groupBy("depth", "cell").agg(F.sum("share").alias("own"))
    levels = cells.join(nodes, ["depth", "cell"]).groupBy("mix_source", "share").agg(
        F.reverse(F.array_sort(F.collect_list(F.struct("depth", "own", (F.col("cell") % 2 == 1).alias("right"))))).alias("up"),  # DEPTH + 1 entries
    )
    path = """filter(transform(slice(up, 1, size(up) - 1), (x, i) -> named_struct('own', x.own, 'whole', up[i + 1].own, 'right', x.right)),
        x -> x.own < x.whole)"""
    return levels.select("mix_source", "share", F.expr(path).alias("path"))


def slot_of(part: str) -> Column:
    """Slot of the source's part number ``part`` (a column, from 0), from the leaf to the root."""
    return F.expr(f"""aggregate(path, cast({part} as bigint), (s, x) ->
        if(x.right, ((s + 1) * x.whole) div x.own - 1, ((s + 1) * x.whole + x.own - 1) div x.own - 2))""")


def parts_before(slot: str) -> Column:
    """How many parts the source has had before slot ``slot`` (a column), from the root to the leaf."""
    return F.expr(f"""aggregate(reverse(path), cast({slot} as bigint), (n, x) ->
        if(x.right, ((n + 1) * x.own + x.whole - 1) div x.whole - 1, ((n + 1) * x.own) div x.whole))""")


def mix_sources(
    docs: DataFrame, shares: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", size_col: str | None = None, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``mix_slot``, ``mix_block`` and ``mix_copy``; a document has a row per copy. ``shares`` must name every source.

    A table that has sizes (``size_col``) needs no texts: a schedule is then made without moving any.
    """
    clash = {c.lower() for c in docs.columns} & set(ADDED)
    if clash:
        raise ValueError(f"columns of the mix are already there: {sorted(clash)}")
    part_bytes = max(block_bytes // PARTS, 1)
    n_parts = F.greatest(F.ceil(F.col("bytes") / F.lit(part_bytes)), F.lit(1)).cast("long")
    totals = docs.groupBy(_name(F.col(source_col)).alias("mix_source")).agg(F.sum(_sizes(text_col, size_col)).alias("bytes"))
    sources = totals.select("mix_source", n_parts.alias("parts_")).join(schedule(shares), "mix_source")
    folder = shared_folder(docs.sparkSession)
    sources = written(sources.withColumn("last_", slot_of("parts_ - 1")), folder, "sources")
    # The slot after every source's last part, where the mix ends, and how many parts each source has had by then.
    end = sources.agg((F.max("last_") + 1).alias("end_"))
    quota = sources.join(F.broadcast(end)).withColumn("quota_", parts_before("end_"))  # end is one row
    quota = written(quota.select("mix_source", "parts_", "path", "quota_"), folder, "quota")
    # Own columns travel in one struct, so no name of the caller's can meet one used here.
    rows = docs.select(
        F.struct("*").alias("row_"), _name(F.col(source_col)).alias("mix_source"), _sizes(text_col, size_col).alias("size_"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("key_"), F.col(id_col).alias("id_"),
    )
    rows = with_running(rows, ["mix_source"], "key_", ["id_", "size_"], "size_").join(quota, "mix_source")
    rows = rows.withColumn("part_", F.least(F.floor(F.col("before") / F.lit(part_bytes)).cast("long"), F.col("parts_") - 1))
    copies = F.expr("(quota_ - 1 - part_) div parts_")
    rows = rows.withColumn("mix_copy", F.explode(F.sequence(F.lit(0).cast("long"), copies)))
    slot, block = slot_of("part_ + mix_copy * parts_"), F.expr(f"part_ div {PARTS}")
    return rows.select("row_.*", slot.alias("mix_slot"), block.alias("mix_block"), "mix_copy")
