"""Shards through a fixed number of virtual slots and a versioned map.

A record's slot is a digest of its id, so it never changes. Bytes are summed per
slot; a map says which shard holds a slot. The first map deals slots out, largest
first, to the shard with the fewest bytes. Later maps are edits of the one before: a
new shard takes slots only into itself, and rebalancing moves slots from shards above
a tolerance until none is. All versions are kept in one table.

The driver handles one number per slot (``n_slots``, a parameter), never records. A
record's place inside its shard follows from counts per slot and per part of a slot,
so neither a shard nor a slot is ever sorted in one task.

Defined cases: a null text counts 8 bytes, like an empty one; records without an id
share one slot; repeated rows are separate records; an empty table gives empty
shards and an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOT_DIGITS = 3
N_SLOTS = 16**SLOT_DIGITS
PART_DIGITS = 2
RECORD_BYTES = 8
TOLERANCE = 0.02


@dataclass(frozen=True)
class SlotMap:
    """Version, shard of each slot, number of shards."""

    version: int
    shard_of: tuple[int, ...]
    shards: int


def _digest(record_id: str) -> Column:
    return F.md5(F.coalesce(F.col(record_id).cast("string"), F.lit("")))


def slot_of(record_id: str) -> Column:
    """The slot of a record: the first digits of the digest of its id."""
    return F.conv(F.substring(_digest(record_id), 1, SLOT_DIGITS), 16, 10).cast("int")


def record_size(text: str) -> Column:
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + F.lit(RECORD_BYTES)).cast("long")


def slot_sizes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """Bytes per slot, over all records."""
    sums = docs.groupBy(slot_of(id_col).alias("slot")).agg(F.sum(record_size(text_col)).alias("bytes"))
    sizes = [0] * N_SLOTS
    for row in sums.collect():
        sizes[row["slot"]] = row["bytes"]
    return sizes


def first_map(sizes: list[int], shards: int) -> SlotMap:
    """Largest slot first, each to the shard with the fewest bytes so far."""
    load, shard_of = [(0, s) for s in range(shards)], [0] * len(sizes)
    for slot in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        held, shard = heapq.heappop(load)
        shard_of[slot] = shard
        heapq.heappush(load, (held + sizes[slot], shard))
    return SlotMap(1, tuple(shard_of), shards)


def _loads(sizes: list[int], held: SlotMap | list[int], shards: int) -> list[int]:
    load = [0] * shards
    for slot, shard in enumerate(held.shard_of if isinstance(held, SlotMap) else held):
        load[shard] += sizes[slot]
    return load


def grow(old: SlotMap, sizes: list[int]) -> SlotMap:
    """One more shard, filled with slots of the fullest shards up to an even share; no other slot moves."""
    shard_of, load, new = list(old.shard_of), [*_loads(sizes, old, old.shards), 0], old.shards
    share = sum(sizes) / (old.shards + 1)
    for slot in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        held = shard_of[slot]
        if load[new] + sizes[slot] <= share and load[held] - sizes[slot] >= share * (1 - TOLERANCE):
            shard_of[slot], load[held], load[new] = new, load[held] - sizes[slot], load[new] + sizes[slot]
    return SlotMap(old.version + 1, tuple(shard_of), old.shards + 1)


def rebalance(old: SlotMap, sizes: list[int], tolerance: float = TOLERANCE) -> SlotMap:
    """Moves slots from the fullest to the emptiest shard while one is above the mean by ``tolerance`` and a move helps."""
    shard_of, load = list(old.shard_of), _loads(sizes, old, old.shards)
    mean = sum(sizes) / old.shards
    for _ in range(len(sizes)):
        full, empty = max(range(old.shards), key=load.__getitem__), min(range(old.shards), key=load.__getitem__)
        gap = load[full] - load[empty]
        fitting = [s for s in range(len(sizes)) if shard_of[s] == full and 0 < sizes[s] < gap]
        if load[full] <= mean * (1 + tolerance) or not fitting:
            break
        slot = min(fitting, key=lambda s: (abs(gap / 2 - sizes[s]), s))
        shard_of[slot], load[full], load[empty] = empty, load[full] - sizes[slot], load[empty] + sizes[slot]
    return SlotMap(old.version + 1, tuple(shard_of), old.shards)


def write_map(spark: SparkSession, slot_map: SlotMap, sizes: list[int], path: str) -> None:
    """Adds a version to the table of maps: ``version``, ``shards``, ``slot``, ``shard``, ``bytes``."""
    rows = [(slot_map.version, slot_map.shards, k, s, sizes[k]) for k, s in enumerate(slot_map.shard_of)]
    frame = spark.createDataFrame(rows, "version int, shards int, slot int, shard int, bytes long")
    frame.coalesce(1).write.mode("append").partitionBy("version").parquet(path)  # one row per slot


def read_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A version of the map; the latest one if none is asked for."""
    table = spark.read.parquet(path)
    version = table.agg(F.max("version")).first()[0] if version is None else version
    rows = table.where(F.col("version") == version).orderBy("slot").collect()
    return SlotMap(version, tuple(r["shard"] for r in rows), rows[0]["shards"])


def place_records(docs: DataFrame, slot_map: SlotMap, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per record: ``doc_id``, ``size``, ``text_crc32``, ``virtual_slot``, ``map_version``, ``shard`` and ``slot``, its place there from 0."""
    digest = _digest(id_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), record_size(text_col).alias("size"),
        F.crc32(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")).alias("text_crc32"), digest.alias("digest"),
    ).withColumns({"virtual_slot": slot_of("doc_id"), "part_": F.substring("digest", 1 + SLOT_DIGITS, PART_DIGITS)})
    keys = docs.select(slot_of(id_col).alias("virtual_slot"), F.substring(digest, 1 + SLOT_DIGITS, PART_DIGITS).alias("part_"))
    spark = docs.sparkSession
    held = spark.createDataFrame(list(enumerate(slot_map.shard_of)), "virtual_slot int, shard int")
    parts = keys.groupBy("virtual_slot", "part_").agg(F.count("*").alias("n"))
    slots = parts.groupBy("virtual_slot").agg(F.sum("n").alias("n")).join(F.broadcast(held), "virtual_slot")
    earlier = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select("virtual_slot", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("slot_n"))
    earlier = Window.partitionBy("virtual_slot").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("virtual_slot", "part_", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_n"))
    own = F.row_number().over(Window.partitionBy("virtual_slot", "part_").orderBy("digest", "doc_id", "size", "text_crc32")) - 1
    placed = rows.withColumn("own_n", own).join(parts, ["virtual_slot", "part_"]).join(F.broadcast(slots), "virtual_slot")  # a row per slot
    return placed.select(
        "doc_id", "size", "text_crc32", "virtual_slot", F.lit(slot_map.version).alias("map_version"), "shard",
        (F.col("slot_n") + F.col("part_n") + F.col("own_n")).cast("long").alias("slot"),
    )
