"""Shuffled control sequences and length classes of targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from protomatch.operators.joins import null_safe_join

SHUFFLED_TAG = "shuffled"
SEARCH_CUT = 150_000
# Sequences of at least this many letters are permuted in buckets, by tiles of letters and leading digits of the hash.
LONG_FROM, TILE, BUCKET_DIGITS = 1_000_000, 4096, 2
# Added to a place, so that its text has ten digits.
_PLACES = 4_000_000_000


def _prefix(id_column: str, seed: int) -> Column:
    """What the md5 texts of one sequence begin with."""
    return F.concat_ws("/", F.lit(str(seed)), F.col(id_column).cast("string"), F.lit("")).alias("__prefix")


def _hash(id_column: str, place: Column, seed: int, key: str) -> Column:
    if key == "md5":
        return F.md5(F.concat(F.col("__prefix"), place.cast("string")))
    if key == "xxhash64":
        return F.lpad(F.hex(F.xxhash64(F.lit(seed), F.col(id_column), place)), 16, "0")
    raise ValueError(f"key must be 'xxhash64' or 'md5', not {key!r}")


def _keyed(id_column: str, letter: Column, place: Column, seed: int, key: str) -> Column:
    """Hash, place and letter in one text: plain text sorts much faster than structs."""
    return F.concat(_hash(id_column, place, seed, key), (place + F.lit(_PLACES).cast("bigint")).cast("string"), letter)


def _letters_in_order(keyed: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(keyed), lambda s: F.right(s, F.lit(1))), "")


def _permuted_by_buckets(sequences: DataFrame, id_column: str, seed: int, key: str) -> DataFrame:
    """The same permutation for long sequences: (id, seq, ``permuted``), one row per distinct pair.

    A sequence is cut into tiles, its letters are grouped by the first digits of
    their hash, sorted within these buckets and the buckets put in order, so no task
    sorts or holds the letters of a whole sequence.
    """
    name = F.xxhash64("seq")
    tiles = sequences.select(
        id_column, name.alias("__name"), _prefix(id_column, seed), F.posexplode(F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{TILE}}}"), F.lit(0))).alias("__tile", "__piece"))
    tiles = tiles.repartition(id_column, "__tile")
    place = (F.col("__tile") * TILE + F.col("__at") + 1).cast("int")
    letters = tiles.select(id_column, "__name", "__prefix", "__tile", F.posexplode(F.split("__piece", "")).alias("__at", "__letter"))
    letters = letters.select(id_column, "__name", _keyed(id_column, F.col("__letter"), place, seed, key).alias("__keyed"))
    buckets = letters.groupBy(id_column, "__name", F.substring("__keyed", 1, BUCKET_DIGITS).alias("__bucket")).agg(
        _letters_in_order(F.collect_list("__keyed")).alias("__text"))
    parts = F.sort_array(F.collect_list(F.struct("__bucket", "__text")))
    return buckets.groupBy(id_column, "__name").agg(F.array_join(F.transform(parts, lambda b: b["__text"]), "").alias("__permuted"))


def shuffle_sequences(sequences: DataFrame, id_column: str, seed: int = 42, key: str = "xxhash64",
                      long_from: int | None = LONG_FROM) -> DataFrame:
    """Permute the letters of each sequence; same composition, same result on every run.

    Letters are sorted by a hash of (seed, id, place), ties by place: within the
    row, or for sequences of at least ``long_from`` letters in buckets over many
    tasks, with the same result. Rows are spread by hash first: hashing and
    sorting every letter costs far more than moving the sequence, and sequences
    come in few large files. ``key="md5"`` is slower but can be recomputed
    outside Spark. ``long_from=None`` says that no sequence is long.
    """
    partitions = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = F.transform(F.split("seq", ""), lambda c, i: _keyed(id_column, c, i + 1, seed, key))
    short = sequences if long_from is None else sequences.filter(F.coalesce(F.length("seq") < long_from, F.lit(True)))
    # The hash needs the original id, so the id gets its tag in a step of its own. What all letters of a
    # sequence share is made before the spreading, hence once.
    spread = short.select("*", _prefix(id_column, seed)).repartition(partitions, id_column)
    done = spread.withColumn("seq", F.when(F.length("seq") > 0, _letters_in_order(keyed)).otherwise(F.col("seq"))).drop("__prefix")
    if long_from is not None:
        long = sequences.filter(F.length("seq") >= long_from)
        permuted = _permuted_by_buckets(long.select(id_column, "seq").distinct(), id_column, seed, key)
        named = long.withColumn("__name", F.xxhash64("seq"))
        joined = null_safe_join(named, permuted, [id_column, "__name"], null_safe=[id_column])
        done = done.unionByName(joined.withColumn("seq", F.col("__permuted")).select(*sequences.columns))
    return done.withColumn(id_column, F.concat(F.col(id_column).cast("string"), F.lit(f"-{SHUFFLED_TAG}")))


def length_class(targets: DataFrame, cut: int = SEARCH_CUT, length: str = "target_length") -> DataFrame:
    """``>150kb`` or ``<150kb`` by target length; at the cut counts as long, a missing length has no class."""
    name = f"{cut // 1000}kb"
    size = F.when(F.col(length) >= cut, F.lit(f">{name}")).when(F.col(length) < cut, F.lit(f"<{name}"))
    return targets.withColumn("size_class", size)
