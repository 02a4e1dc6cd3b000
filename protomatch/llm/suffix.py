"""Removal of repeated byte strings with a suffix array, bounded at the least length.

A string of ``length`` bytes is repeated if it also starts in a document with a
smaller id. All bytes that such strings cover are removed.

Equal strings have to meet in one task although no task can sort all suffixes. Every
string of ``length`` bytes is therefore owned by an anchor, the ANCHOR bytes in it with the smallest digest;
equal strings have equal anchors. Neighbouring strings with the same anchor
make one segment. First, digests of anchors are counted in buckets, each once per chunk of
documents, and only those of at least two documents go on. Their segments are sent
to the bucket of the anchor, each distinct one once per chunk with the smallest and
largest id that has it.

In a bucket the segments are joined, their suffixes sorted and the Burrows-Wheeler
transform taken. Intervals of suffixes that share a prefix are extended backwards by
one byte, breadth first: an interval of length l that ends before a place whose
common prefix is still open closes it with value l - 1, and only such intervals go on. The
expansion stops at ``length``; suffixes between places still open share at least that
many bytes, and the smallest id among them decides which documents lose the string.

Anchors found in more than ``HOT`` chunks may stand among unlike surroundings without end;
their strings are sent one by one to the bucket of their own digest instead, so
no bucket grows with them. Chunks grow with the square root of the input up to a
bound, buckets in number with the input.

Defined cases: a null text is an empty one; texts shorter than ``length`` lose
nothing; of repeated rows neither removes from the other, as neither id is smaller;
documents without an id come after all others; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH, ANCHOR = 50, 20
BUCKET_BYTES = 4 << 20
CHUNK_BYTES, CHUNK_MOST = 256 << 10, 32 << 20
KEY_BITS = 39
# Parts of a bucket that are sorted one after the other: small arrays stay in the cache.
PARTS, PART_BYTES = 16, 192 << 10
HOT = 20_000
# Symbols of nine bits in a key of 64; the expansion starts from prefixes of that many.
KEY_SYMBOLS = 7
LAST_ID = 2**63 - 1

ODD, MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(31))) * MIX


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a text by their first string, past their last string, and the digest of their anchor (63 bits)."""
    n = len(data) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    h, width = np.frombuffer(data, np.uint8).astype(np.uint64), 1
    while width * 2 <= ANCHOR:
        h = h[:-width] * np.uint64(pow(ODD, width, 2**64)) + h[width:]
        width *= 2
    if width < ANCHOR:
        h = h[:len(h) - (ANCHOR - width)] * np.uint64(pow(ODD, ANCHOR, 2**64)) + h[ANCHOR - width:]
    h = _mix(h) >> np.uint64(1)
    window, low, span = length - ANCHOR + 1, h, 1
    while span * 2 <= window:
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    if span < window:
        low = np.minimum(low[:len(low) - (window - span)], low[window - span:])
    first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    return first, np.r_[first[1:], n], low[first]


def _texts(group: pd.DataFrame) -> list[tuple[int, str | None, bytes]]:
    """The documents of a chunk in a fixed order: place, id, bytes."""
    rows = [(LAST_ID if pd.isna(i) else int(i), None if pd.isna(i) else i, t.encode()) for i, t in zip(group["id"], group["text"], strict=True)]
    return sorted(rows, key=lambda r: (r[0], r[2]))


def _keys(digests: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and KEY_BITS further bits of a digest. Digests that share these are only ever compared needlessly."""
    n = np.uint64(buckets)
    return ((digests % n) << np.uint64(KEY_BITS)) | ((digests // n) & np.uint64(2**KEY_BITS - 1))


def _packed(keys: np.ndarray, marks: np.ndarray) -> bytes:
    """Keys of one bucket without it, each with a mark as its lowest bit, in five bytes."""
    values = ((keys & np.uint64(2**KEY_BITS - 1)) << np.uint64(1)) | marks.astype(np.uint64)
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys without their bucket, and their marks."""
    values = np.zeros((len(data) // 5, 8), np.uint8)
    values[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    values = values.view("<u8").ravel()
    return values >> np.uint64(1), (values & np.uint64(1)).astype(bool)


def _count_anchors(group: pd.DataFrame, length: int, buckets: int) -> pd.DataFrame:
    """Keys of a chunk by bucket, each once; marked if two of its documents have it."""
    per_doc = [np.unique(_keys(anchors(data, length)[2], buckets)) for _, _, data in _texts(group)]
    keys, times = np.unique(np.concatenate(per_doc), return_counts=True)
    bucket, chunk = (keys >> np.uint64(KEY_BITS)).astype(np.int64), int(group["chunk"].iloc[0])
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
    rows = [(int(bucket[lo]), chunk, _packed(keys[lo:hi], times[lo:hi] > 1)) for lo, hi in zip(cuts, [*cuts[1:], len(keys)], strict=True)]
    return pd.DataFrame(rows, columns=["bucket", "chunk", "data"])


def _repeated_anchors(group: pd.DataFrame) -> pd.DataFrame:
    """For each chunk, its keys that at least two documents have; marked if the anchor is hot. Buckets go back as -1 - bucket."""
    parts = [_unpacked(x) for x in group["data"]]
    keys, many = np.concatenate([k for k, _ in parts]), np.concatenate([m for _, m in parts])
    _, inverse, chunks = np.unique(keys, return_inverse=True, return_counts=True)
    repeated, hot = np.bincount(inverse, 1 + many)[inverse] > 1, chunks[inverse] > HOT
    rows, at, bucket = [], 0, -1 - int(group["bucket"].iloc[0])
    for chunk, (part, _) in zip(group["chunk"], parts, strict=True):
        kept = slice(at, at + len(part))
        at += len(part)
        if repeated[kept].any():
            rows.append((chunk, bucket, _packed(part[repeated[kept]], hot[kept][repeated[kept]])))
    return pd.DataFrame(rows, columns=["chunk", "bucket", "data"])


class _Chunk:
    """Distinct segments of a chunk by bucket, and where they stand; the same whenever it is made."""

    def __init__(self, group: pd.DataFrame, repeated: pd.DataFrame, length: int, buckets: int) -> None:
        self.texts, self.places = _texts(group), []
        self.segments: dict[int, dict[bytes, list[int]]] = {}
        parts = [(np.zeros(0, np.uint64), np.zeros(0, bool))]
        for bucket, data in zip(repeated["bucket"], repeated["data"], strict=True):
            part, marks = _unpacked(data)
            parts.append((part | np.uint64((-1 - bucket) << KEY_BITS), marks))
        known, hot = np.concatenate([k for k, _ in parts]), np.concatenate([m for _, m in parts])
        order = np.argsort(known)
        known, hot = known[order], hot[order]
        for k, (place, _, data) in enumerate(self.texts):
            first, past, digest = anchors(data, length)
            if not len(known) or not len(digest):
                continue
            keys = _keys(digest, buckets)
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            found = known[at] == keys
            bucket_of, part_of = (keys[found] >> np.uint64(KEY_BITS)).tolist(), (keys[found] % np.uint64(PARTS)).tolist()
            for lo, hi, bucket, part, single in zip(
                first[found].tolist(), past[found].tolist(), bucket_of, part_of, hot[at[found]].tolist(), strict=True,
            ):
                if single:
                    for s in range(lo, hi):
                        string = data[s:s + length]
                        digest = xxhash.xxh64_intdigest(string)
                        self._add(k, place, s, string, digest % buckets, digest // buckets % PARTS)
                else:
                    self._add(k, place, lo, data[lo:hi + length - 1], bucket, part)

    def _add(self, k: int, place: int, start: int, segment: bytes, bucket: int, part: int) -> None:
        held = self.segments.setdefault(bucket, {})
        entry = held.get(segment)
        if entry is None:
            entry = held[segment] = [len(held), place, place, part]
        elif place > entry[2]:  # Texts come in the order of their ids.
            entry[2] = place
        self.places.append((k, start, bucket, entry[0]))


def _send_segments(group: pd.DataFrame, repeated: pd.DataFrame, length: int, buckets: int) -> pd.DataFrame:
    rows = []
    if len(group):
        for bucket, held in _Chunk(group, repeated, length, buckets).segments.items():
            entries = np.array([e[1:] for e in held.values()], np.int64)
            rows.append((
                bucket, int(group["chunk"].iloc[0]), np.array([len(s) for s in held], np.int32).tobytes(),
                zstandard.compress(b"".join(held), 1), entries.tobytes(),
            ))
    return pd.DataFrame(rows, columns=["bucket", "chunk", "lengths", "data", "ids"])


def open_places(segments: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of the joined segments in order, and which of them share ``length`` bytes with the one before.

    Segments are at least ``length`` bytes long and stand with a separator after each; a
    suffix that reaches a separator within ``length`` bytes shares too little by definition.
    """
    lengths = np.array([len(s) for s in segments], np.int64)
    n, ends = int(lengths.sum()) + len(segments), np.cumsum(lengths + 1) - 1
    separator = np.ones(n + 64, bool)
    separator[:n] = False
    separator[ends] = True
    # Bytes from 1 to 256, separators 0: nine bits each.
    code = np.zeros(n + 64, np.uint64)
    code[:n] = np.frombuffer(b"\0".join([*segments, b""]), np.uint8).astype(np.uint64) + np.uint64(1)
    code[separator] = 0
    depth, key = KEY_SYMBOLS, np.zeros(n, np.uint64)
    for k in range(depth):
        key = (key << np.uint64(9)) | code[k:n + k]
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    first_new = new
    reach = depth
    while reach < length:
        rank = np.zeros(n + 64, np.uint64)
        rank[order] = np.cumsum(new).astype(np.uint64)
        # Only suffixes that are still tied need another key.
        tied = ~(new & np.r_[new[1:], True])
        where = np.flatnonzero(tied)
        if not len(where):
            break
        rows = order[where]
        ahead = rank[np.minimum(rows + reach, n)]
        both = (rank[rows] << np.uint64(32)) | ahead
        again = np.argsort(both, kind="stable")
        order[where], both = rows[again], both[again]
        changed = np.r_[True, both[1:] != both[:-1]]
        new = new.copy()
        new[where] = changed
        reach *= 2
    # The transform: the byte before each suffix, and where the suffix one byte longer stands.
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = order - 1
    has = (before >= 0) & ~separator[np.maximum(before, 0)]
    longer = np.where(has, place[np.maximum(before, 0)], -1)
    initial = code[order]
    closed = np.r_[first_new, True]
    starts = np.flatnonzero(first_new)
    stops = np.r_[starts[1:], n] - 1
    whole = initial[starts] > 0
    lo, hi = starts[whole], stops[whole]
    owner = np.zeros(n, np.int64)
    for depth_now in range(depth, length):
        if not len(lo):
            break
        sizes = hi - lo + 1
        interval = np.repeat(np.arange(len(lo)), sizes)
        rows = np.arange(len(interval)) + np.repeat(lo - np.r_[0, np.cumsum(sizes)[:-1]], sizes)
        to = longer[rows]
        some = to >= 0
        to = to[some]
        owner[to] = interval[some]
        to = np.sort(to)
        if not len(to):
            break
        own, byte = owner[to], initial[to]
        cut = np.r_[True, (own[1:] != own[:-1]) | (byte[1:] != byte[:-1]) | (to[1:] != to[:-1] + 1)]
        begin = np.flatnonzero(cut)
        child_lo, child_hi = to[begin], to[np.r_[begin[1:], len(to)] - 1]
        still_open = ~closed[child_hi + 1]
        lo, hi = child_lo[still_open], child_hi[still_open]
        closed[hi + 1] = True
    # Strings that reach a separator are not strings of a segment.
    left = np.zeros(n, np.int64)
    left[:] = np.repeat(ends, lengths + 1) - np.arange(n)
    short = left[order] < length
    shares = ~closed[:n] & ~short & ~np.r_[True, short[:-1]]
    return order, shares


def _runs(segments: list[bytes], smallest: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with the same smallest id: segment, first string in it, number of strings, id."""
    order, shares = open_places(segments, length)
    lengths = np.array([len(s) for s in segments], np.int64)
    segment_of = np.repeat(np.arange(len(segments)), lengths + 1)
    groups = np.flatnonzero(~shares)
    low = np.minimum.reduceat(smallest[segment_of[order]], groups)
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(low, np.diff(np.r_[groups, len(order)]))
    begins = np.r_[0, np.cumsum(lengths + 1)[:-1]]
    offset = np.arange(len(least)) - np.repeat(begins, lengths + 1)
    at = np.flatnonzero(offset <= np.repeat(lengths, lengths + 1) - length)
    cut = np.flatnonzero(np.r_[True, (offset[at[1:]] == 0) | (least[at[1:]] != least[at[:-1]])])
    return segment_of[at[cut]], offset[at[cut]], np.diff(np.r_[cut, len(at)]), least[at[cut]]


def _expand(group: pd.DataFrame, length: int) -> pd.DataFrame:
    """For each chunk and its segments: runs of strings that start in a smaller document, with the smallest id."""
    known: dict[bytes, int] = {}
    smallest: list[int] = []
    parts: list[int] = []
    chunks, unpack = [], zstandard.ZstdDecompressor().decompress
    for chunk, bucket, lengths, data, ids in zip(group["chunk"], group["bucket"], group["lengths"], group["data"], group["ids"], strict=True):
        data, at, own = unpack(data), 0, []
        sizes, ids = np.frombuffer(lengths, np.int32), np.frombuffer(ids, np.int64).reshape(-1, 3)
        for size, least, part in zip(sizes.tolist(), ids[:, 0].tolist(), ids[:, 2].tolist(), strict=True):
            segment = data[at:at + size]
            at += size
            number = known.setdefault(segment, len(known))
            if number == len(smallest):
                smallest.append(least)
                parts.append(part)
            elif least < smallest[number]:
                smallest[number] = least
            own.append(number)
        chunks.append((chunk, bucket, np.array(own), ids[:, 1]))
    segments, least_of, part_of, runs = list(known), np.array(smallest, np.int64), np.array(parts), []
    n_parts = 1
    while n_parts < PARTS and sum(map(len, segments)) > 2 * n_parts * PART_BYTES:
        n_parts *= 2
    for part in range(n_parts):
        members = np.flatnonzero(part_of % n_parts == part)
        if len(members):
            number, *found = _runs([segments[k] for k in members.tolist()], least_of[members], length)
            runs.append((members[number], *found))
    run_segment, lo, n_strings, run_least = (np.concatenate(x) for x in zip(*runs, strict=True))
    order = np.argsort(run_segment, kind="stable")
    run_segment, lo, n_strings, run_least = run_segment[order], lo[order], n_strings[order], run_least[order]
    run_begin = np.searchsorted(run_segment, np.arange(len(segments) + 1))
    rows = []
    for chunk, bucket, own, most in chunks:
        n_runs = run_begin[own + 1] - run_begin[own]
        k = np.repeat(np.arange(len(own)), n_runs)
        run = np.arange(len(k)) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs) + run_begin[own][k]
        lost = run_least[run] < most[k]
        k, run = k[lost], run[lost]
        if len(k):
            places = np.stack([k, lo[run], lo[run] + n_strings[run]]).astype(np.int32)
            rows.append((chunk, bucket, places.tobytes() + run_least[run].tobytes()))
    return pd.DataFrame(rows, columns=["chunk", "bucket", "data"])


def _cut(group: pd.DataFrame, replies: pd.DataFrame, length: int, buckets: int) -> pd.DataFrame:
    """The documents of a chunk with their removed spans and what is left."""
    chunk = _Chunk(group, replies[replies["bucket"] < 0], length, buckets)
    runs: dict[tuple[int, int], list] = {}
    for bucket, data in zip(replies["bucket"], replies["data"], strict=True):
        if bucket >= 0:
            n = len(data) // 20
            places, least = np.frombuffer(data, np.int32, 3 * n).reshape(3, n), np.frombuffer(data, np.int64, n, 12 * n)
            for k, lo, hi, low in zip(*places.tolist(), least.tolist(), strict=True):
                runs.setdefault((bucket, k), []).append((lo, hi, low))
    covered: dict[int, list[tuple[int, int]]] = {}
    for k, start, bucket, number in chunk.places:
        for lo, hi, least in runs.get((bucket, number), ()):
            if least < chunk.texts[k][0]:
                covered.setdefault(k, []).append((start + lo, start + hi - 1 + length))
    rows = []
    for k, (_, own_id, data) in enumerate(chunk.texts):
        spans: list[list[int]] = []
        for lo, hi in sorted(covered.get(k, ())):
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], hi)
            else:
                spans.append([lo, hi])
        left, at = [], 0
        for lo, hi in spans:
            left.append(data[at:lo])
            at = hi
        rows.append((own_id, len(data), spans, b"".join([*left, data[at:]])))
    return pd.DataFrame(rows, columns=["id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id``, ``n_bytes``, ``spans`` (removed bytes, [start, end) pairs in order) and ``kept`` (the bytes left)."""
    if length < ANCHOR + 8:
        raise ValueError(f"the least length is at least {ANCHOR + 8}")
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(1, -(-total // BUCKET_BYTES))
    chunk_bytes = min(max(CHUNK_BYTES, math.isqrt(400 * total)), CHUNK_MOST)
    chunks = max(1, -(-total // chunk_bytes))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)))
    by_chunk = rows.groupBy("chunk")
    counted = by_chunk.applyInPandas(lambda g: _count_anchors(g, length, buckets), "bucket long, chunk long, data binary")
    repeated = counted.groupBy("bucket").applyInPandas(_repeated_anchors, "chunk long, bucket long, data binary")
    sent = by_chunk.cogroup(repeated.groupBy("chunk")).applyInPandas(
        lambda g, r: _send_segments(g, r, length, buckets), "bucket long, chunk long, lengths binary, data binary, ids binary")
    expanded = sent.groupBy("bucket").applyInPandas(lambda g: _expand(g, length), "chunk long, bucket long, data binary")
    replies = repeated.unionByName(expanded)
    done = by_chunk.cogroup(replies.groupBy("chunk")).applyInPandas(
        lambda g, r: _cut(g, r, length, buckets), "id string, n_bytes long, spans array<array<long>>, kept binary")
    return done.withColumn("id", F.col("id").cast("long"))
