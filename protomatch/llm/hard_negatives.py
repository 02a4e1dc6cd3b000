"""Hard-negative mining with a secondary sort.

Anchors are scored against all rows, in blocks: rows are packed into chunks, anchors into
blocks of bounded size, and every chunk meets every block once as one matrix product.
Of a chunk, an anchor keeps only the positives that can still be among its first, and
for each of its positives only the negatives that can still be among the first of its window.

What is kept becomes pair keys of (anchor, descending score, positives before negatives, id),
packed into bytes so that their plain order is that order. The keys are partitioned by anchor
and sorted inside their partition, and one pass over the sorted stream does
the mining: a positive opens a window, a negative goes into every open window it is not too weak
for, a window closes when it is full or the scores have fallen below it. No anchor is
ever held as a whole: the stream keeps the windows of the current anchor and nothing else.

Scores are integer inner products: a component x counts as floor(scale * x). They are
computed in doubles where these are exact for the vectors at hand, else in whole numbers.

Defined cases: rows with a null id, label or vector, or with a null or non-finite
component, take no part; vectors of unlike length are never compared, empty ones score 0;
ties go to the smaller id; repeated rows are rows of their own, so the copy of an anchor is one of its
positives, and each copy of an anchor is mined; a score that no long can hold is an
error; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from protomatch.llm.staging import shared_folder, written

SCALE = 256
POSITIVES = NEGATIVES = 5
# Percentage of the positive's score that a negative must reach.
LEAST = 80
CHUNK_ROWS, BLOCK_ANCHORS, STRIP = 8192, 1024, 256
# Packed anchors are broadcast up to this size; beyond it chunks and blocks meet by a shuffle, in parts of about PART_ROWS rows.
BROADCAST_BYTES, PART_ROWS = 32 << 20, 1 << 20
KEY = np.dtype([("slot", ">u8"), ("fall", ">u8"), ("kind", "u1"), ("id", ">u8")])
PACKED = "dim long, first long, ids binary, labels binary, kind string, vectors binary"
SIGN, TOP = np.uint64(1 << 63), np.uint64(2**63 - 1)


def _usable(rows: DataFrame, id_col: str, vector_col: str, label_col: str, anchors: Column) -> DataFrame:
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(anchors, F.lit(False)).alias("anchor"),
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & sound)


def _whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) in the narrowest whole numbers that hold them."""
    scaled = np.floor(scale * values)
    most = float(np.abs(scaled).max(initial=0.0))
    if most >= 2.0**62:
        raise ValueError("a component is too large for whole numbers")
    return scaled.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64)


def _packed(ids: np.ndarray, labels: np.ndarray, values: np.ndarray, lengths: np.ndarray, scale: int) -> Iterator[tuple]:
    """One matrix per vector length, rows in the order of their ids."""
    starts, first = np.cumsum(lengths) - lengths, 0
    for dim in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == dim)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        matrix = _whole(values[starts[rows][:, None] + np.arange(dim)], scale)
        yield dim, first, ids[rows].tobytes(), labels[rows].tobytes(), matrix.dtype.str, matrix.tobytes()
        first += len(rows)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    vector = batch.column("vector")
    return (
        batch.column("id").to_numpy(zero_copy_only=False), batch.column("label").to_numpy(zero_copy_only=False),
        vector.flatten().to_numpy(zero_copy_only=False), vector.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64),
    )


def _chunks(rows: DataFrame, scale: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["dim", "first", "ids", "labels", "kind", "vectors"]
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                packed = list(_packed(*_columns(batch.slice(at, CHUNK_ROWS)), scale))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*packed, strict=True)], names=names)

    return rows.select("id", "label", "vector").mapInArrow(run, PACKED)


def _blocks(anchors: DataFrame, n_blocks: int, scale: int) -> DataFrame:
    """Anchors dealt evenly over ``n_blocks`` blocks; a row per block and vector length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        parts = [_columns(b) for b in batches]
        if sum(len(p[0]) for p in parts):
            packed = list(_packed(*(np.concatenate(x) for x in zip(*parts, strict=True)), scale))
            block = TaskContext.get().partitionId()
            names = ["block", "dim", "first", "ids", "labels", "kind", "vectors"]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*[(block, *p) for p in packed], strict=True)], names=names)

    return anchors.select("id", "label", "vector").repartition(n_blocks).mapInArrow(run, f"block long, {PACKED}")


def _matrix(vectors: bytes, kind: str, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(vectors, kind).reshape(n, dim)


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products."""
    dim = anchors.shape[1]
    bound = dim * int(np.abs(anchors.astype(np.int64)).max(initial=0)) * int(np.abs(rows.astype(np.int64)).max(initial=0))
    if bound < 2**53:
        return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    if bound < 2**63:
        return anchors.astype(np.int64) @ rows.astype(np.int64).T
    exact = anchors.astype(object) @ rows.astype(object).T
    if any(not -(2**63) <= x < 2**63 for x in exact.ravel().tolist()):
        raise ValueError("a score is too large for a long")
    return exact.astype(np.int64)


def _first(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` highest allowed scores of each row; of equal ones the leftmost."""
    n = scores.shape[1]
    if int(np.abs(scores).max(initial=0)) < 2**62 // max(1, n):
        keys = np.where(allowed, scores * n + (n - 1 - np.arange(n)), np.iinfo(np.int64).min)
        best = np.argpartition(keys, n - k, axis=1)[:, n - k:] if n > k else np.broadcast_to(np.arange(n), keys.shape)
    else:
        order = np.lexsort((np.broadcast_to(np.arange(n), scores.shape), ~scores, ~allowed), axis=1)
        best = order[:, :k]
    rows = np.repeat(np.arange(len(scores)), best.shape[1])
    cols = best.ravel()
    kept = allowed[rows, cols]
    return rows[kept], cols[kept]


def _strips(row) -> Iterator[tuple[np.ndarray, ...]]:
    """Of a chunk and a block: anchors' places, ids and labels, the chunk's ids and labels, and the scores, some anchors at a time."""
    ids, labels = np.frombuffer(row.ids, np.int64), np.frombuffer(row.labels, np.int64)
    a_ids, a_labels = np.frombuffer(row.a_ids, np.int64), np.frombuffer(row.a_labels, np.int64)
    rows, anchors = _matrix(row.vectors, row.kind, row.dim, len(ids)), _matrix(row.a_vectors, row.a_kind, row.dim, len(a_ids))
    for at in range(0, len(a_ids), STRIP):
        part = slice(at, at + STRIP)
        own = anchors[part].astype(np.int64)
        yield np.arange(at, at + len(own)) + row.a_first, a_ids[part], a_labels[part], (own * own).sum(1), ids, labels, _scores(anchors[part], rows)


def _positives(frames: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """First ``k`` rows of the anchor's label in a chunk, the anchor itself among them if it is there."""
    for frame in frames:
        for row in frame.itertuples():
            for place, a_ids, a_labels, own, ids, labels, scores in _strips(row):
                r, c = _first(scores, a_labels[:, None] == labels[None, :], k)
                yield pd.DataFrame({
                    "block": row.block, "place": place[r], "anchor_id": a_ids[r], "id": ids[c], "score": scores[r, c],
                    "itself": (ids[c] == a_ids[r]) & (scores[r, c] == own[r]),
                })


def _negatives(frames: Iterator[pd.DataFrame], k: int, least: int) -> Iterator[pd.DataFrame]:
    """Pair keys of the negatives of a chunk that can be among the first ``k`` of a window."""
    for frame in frames:
        for row in frame.itertuples():
            known = np.frombuffer(row.places, np.int64)
            windows = np.frombuffer(row.windows, np.int64).reshape(len(known), -1)
            for place, a_ids, a_labels, _, ids, labels, scores in _strips(row):
                at = np.minimum(np.searchsorted(known, place), len(known) - 1)
                has, other = known[at] == place, a_labels[:, None] != labels[None, :]
                pairs = np.zeros(0, np.int64)
                for w in range(windows.shape[1]):
                    # A window that an anchor does not have is marked by a score below 0, where none can be open.
                    high = np.where(has, windows[at, w], -1)
                    low = least * (high // 100) - (-least * (high % 100)) // 100  # rounded up; 100 * score may exceed a long
                    open_ = other & (scores <= high[:, None]) & (scores >= low[:, None])
                    rows = np.flatnonzero(open_.any(1))
                    r, c = _first(scores[rows], open_[rows], k)
                    pairs = np.union1d(pairs, rows[r] * len(ids) + c)
                r, c = pairs // max(1, len(ids)), pairs % max(1, len(ids))
                yield _pair_rows(row.block, place[r], a_ids[r], scores[r, c], ids[c], 1)


def _pair_rows(block, place: np.ndarray, anchor_id: np.ndarray, score: np.ndarray, ids: np.ndarray, kind: int) -> pd.DataFrame:
    """Keys whose bytes are in the order of anchor, descending score, kind, id."""
    keys = np.empty(len(ids), KEY)
    keys["slot"] = (np.asarray(block, np.int64) << np.int64(32)) + place
    keys["fall"] = TOP - score.astype(np.uint64)
    keys["kind"] = kind
    keys["id"] = ids.astype(np.uint64) ^ SIGN
    data, n = keys.tobytes(), KEY.itemsize
    return pd.DataFrame({
        "slot": keys["slot"].astype(np.int64), "anchor_id": anchor_id, "key": [data[i:i + n] for i in range(0, len(data), n)],
    })


def _mine(batches: Iterator[pa.RecordBatch], negatives: int, least: int) -> Iterator[pa.RecordBatch]:
    """One pass over sorted keys. ``open_`` has [id, score, negatives so far] of the current anchor's windows."""
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    current, open_ = None, []
    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column("key").to_pylist()), KEY)
        scores = (TOP - keys["fall"].astype(np.uint64)).view(np.int64).tolist()
        ids = (keys["id"].astype(np.uint64) ^ SIGN).view(np.int64).tolist()
        found = []
        for slot, anchor, kind, score, own in zip(keys["slot"].tolist(), batch.column("anchor_id").to_pylist(), keys["kind"].tolist(), scores, ids, strict=True):
            if slot != current:
                current, open_ = slot, []
            if kind == 0:
                open_.append([own, score, 0])
                continue
            open_ = [w for w in open_ if w[2] < negatives and 100 * score >= least * w[1]]
            for w in open_:
                w[2] += 1
                found.append((anchor, w[0], w[2], own, w[1], score))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), types, strict=True)], names=names)


def mine_hard_negatives(
    rows: DataFrame, anchors: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, scale: int = SCALE,
) -> DataFrame:
    """Negatives just below the positives of the rows for which ``anchors`` holds.

    A positive is one of the anchor's first ``positives`` other rows of its label; its
    window takes the first ``negatives`` rows of other labels that score at most as high as it
    and at least ``least`` percent of that. Columns: ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``,
    ``positive_score``, ``negative_score``.
    """
    if not 0 < least <= 100:
        raise ValueError("least is a percentage")
    spark = rows.sparkSession
    folder = shared_folder(spark)
    usable = _usable(rows, id_col, vector_col, label_col, anchors)
    n = usable.agg(F.count("*").alias("rows"), F.count_if("anchor").alias("anchors")).first()
    n_blocks = max(1, -(-n["anchors"] // BLOCK_ANCHORS))
    blocks = written(_blocks(usable.where("anchor"), n_blocks, scale), folder, "anchors")
    blocks = blocks.select("block", "dim", *[F.col(c).alias(f"a_{c}") for c in ("first", "ids", "labels", "kind", "vectors")])
    size = blocks.agg(F.coalesce(F.sum(F.octet_length("a_vectors") + F.octet_length("a_ids") * 8), F.lit(0)).alias("n")).first()["n"]
    chunks = _chunks(usable, scale).drop("first").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))

    def met(held: DataFrame) -> DataFrame:
        """Every chunk with every block of its vector length."""
        if size <= BROADCAST_BYTES:
            return chunks.join(F.broadcast(held), ["block", "dim"])
        parts = -(-n["rows"] // PART_ROWS)
        dealt = chunks.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)))
        return dealt.join(held.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))), ["block", "dim", "part"])

    # One row more than asked for, as the anchor itself is the first or tied with others.
    best = met(blocks).mapInPandas(
        lambda frames: _positives(frames, positives + 1), "block long, place long, anchor_id long, id long, score long, itself boolean")
    first = Window.partitionBy("block", "place").orderBy(F.desc("score"), "id", F.desc("itself"))
    best = best.withColumn("n", F.row_number().over(first)).where(F.col("n") <= positives + 1)
    best = best.groupBy("block", "place", "anchor_id").agg(F.sort_array(F.collect_list(F.struct("n", "itself", "id", "score"))).alias("all"))
    own = F.array_position(F.transform("all", lambda x: x["itself"]), True).cast("int")
    others = F.filter("all", lambda x: x["n"] != own)
    best = written(best.withColumn("all", F.slice(others, 1, positives)).where(F.size("all") > 0), folder, "positives")

    def window_rows(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        scores = np.full((len(group), positives), -1, np.int64)
        for k, of_anchor in enumerate(group["scores"]):
            scores[k, :len(of_anchor)] = of_anchor
        return pd.DataFrame([(group["block"].iloc[0], group["place"].to_numpy(np.int64).tobytes(), scores.tobytes())], columns=["block", "places", "windows"])

    windows = best.select("block", "place", F.transform("all", lambda x: x["score"]).alias("scores")).groupBy("block").applyInPandas(
        window_rows, "block long, places binary, windows binary")
    key_rows = "slot long, anchor_id long, key binary"
    opened = best.select("block", "place", "anchor_id", F.explode("all").alias("p")).select("block", "place", "anchor_id", "p.score", "p.id").mapInPandas(
        lambda frames: (_pair_rows(*[f[c].to_numpy(np.int64) for c in ("block", "place", "anchor_id", "score", "id")], 0) for f in frames), key_rows)
    pairs = opened.unionByName(met(blocks.join(windows, "block")).mapInPandas(lambda frames: _negatives(frames, negatives, least), key_rows))
    # The secondary sort: keys go to the partition of their anchor and are sorted there.
    dealt = pairs.repartition("slot").sortWithinPartitions("key")
    return dealt.mapInArrow(
        lambda batches: _mine(batches, negatives, least),
        "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
