"""Removal of repeated passages by Rabin-Karp hashes of every window of words.

A window is ``length`` consecutive words of one document; it is repeated if the same words
also start in a document with a smaller id. All words that such windows cover are removed;
overlapping windows merge into maximal intervals.

Words become two 64-bit digests each, a window the polynomial of its words' digests, taken from running
sums, so that all windows of a document cost a few steps per word whatever the
length. Documents are dealt into chunks of bounded size by a hash, windows into buckets by theirs.

1. Every chunk sends each bucket 32 further bits of its distinct windows, sorted and as differences.
   The bucket counts them over all chunks and answers one bit for each: seen more than once.
2. Of those, every chunk sends 96 bits of hash and the smallest id it has for the window; the bucket
   answers one bit: some other chunk has a smaller one. What the chunk's own documents
   have in common it decides itself.
3. Every chunk marks the words its lost windows cover and cuts them out.

A window that many documents share, or that a third of all documents hold, goes once per chunk to a
bucket, so no bucket grows with the copies of a text. Chunks and buckets grow with the square root of the input
up to a bound, from where on their number grows.

Windows are told apart by 96 bits besides the bucket; two different ones are taken for equal with a chance below
1 in 100 for all windows of 100 TB together.

Defined cases: a null text has no words; texts shorter than a window lose nothing; a window that only its own document repeats
stays; of repeated rows neither removes from the other, as neither id is smaller;
documents without an id come after all others; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 50
LAST_ID = 2**63 - 1
# Bytes of text in a chunk and, counted by where their windows go, in a bucket: least and most.
CHUNK_BYTES, CHUNK_MOST = 4 << 20, 24 << 20
BUCKET_BYTES, BUCKET_MOST = 8 << 20, 32 << 20
# Odd, hence with an inverse modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
MIX = np.uint64(0xBF58476D1CE4E5B9)
MESSAGE = "bucket long, chunk long, n long, data binary"
ANSWER = "chunk long, bucket long, step int, data binary"


def words_of(data: bytes) -> list[bytes]:
    """Maximal runs of bytes that are not ASCII white space."""
    return data.split()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def window_hashes(numbers: np.ndarray, digests: np.ndarray, starts: np.ndarray, length: int, base: int) -> np.ndarray:
    """Polynomial of the digests of the ``length`` words from each start on, modulo 2**64, with its bits mixed."""
    n = len(numbers)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(digests[numbers] * _powers(base, n), out=sums[1:])
    found = (sums[starts + length] - sums[starts]) * _powers(pow(base, -1, 2**64), n)[starts]
    found ^= found >> np.uint64(32)
    found *= MIX
    return found ^ found >> np.uint64(29)


class _Chunk:
    """The documents of a chunk in a fixed order, and all their windows; the same whenever it is made."""

    def __init__(self, group: pd.DataFrame, length: int, buckets: int) -> None:
        docs = sorted(
            (int(place), bool(none), text.encode()) for place, none, text in zip(group["place"], group["none"], group["text"], strict=True))
        self.chunk = int(group["chunk"].iloc[0])
        self.places, self.none = np.array([d[0] for d in docs], np.int64), [d[1] for d in docs]
        self.words = [words_of(d[2]) for d in docs]
        numbers: defaultdict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        total = int(self.lengths.sum())
        in_order = np.fromiter((numbers[w] for words in self.words for w in words), np.int32, total)
        digests = np.array([divmod(xxhash.xxh3_128_intdigest(w), 1 << 64) for w in numbers], np.uint64).reshape(-1, 2)
        windows = np.maximum(self.lengths - length + 1, 0)
        self.doc = np.repeat(np.arange(len(docs)), windows)
        self.starts = np.arange(len(self.doc)) - (np.cumsum(windows) - windows)[self.doc] + self.begins[self.doc]
        self.first, self.second = (window_hashes(in_order, digests[:, k], self.starts, length, BASES[k]) for k in (0, 1))
        n = np.uint64(buckets)
        self.keys = ((self.first % n) << np.uint64(32)) | ((self.first // n) & np.uint64(2**32 - 1))

    def distinct_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.unique(self.keys, return_inverse=True, return_counts=True)

    def shared(self, answers: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows whose key was seen more than once, the number of each one's group, and the first window of each group.

        Groups are in the order of bucket and hash; windows of a group in the order of ids.
        """
        keys, inverse, _ = self.distinct_keys()
        seen = np.zeros(len(keys), bool)
        for bucket, lo, hi in _by_bucket(keys):
            if bucket in answers:
                seen[lo:hi] = _bits(answers[bucket], hi - lo)
        windows = np.flatnonzero(seen[inverse])
        first, second = self.first[windows], self.second[windows]
        order = np.lexsort((windows, second, first, self.keys[windows] >> np.uint64(32)))
        windows, first, second = windows[order], first[order], second[order]
        new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])][:len(windows)]
        return windows, np.cumsum(new) - 1, windows[new]


def _by_bucket(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """Stretches of the same bucket in sorted keys."""
    bucket = (keys >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    return [(int(bucket[lo]), int(lo), int(hi)) for lo, hi in zip(cuts, np.r_[cuts[1:], len(keys)][:len(cuts)], strict=True)]


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _squeezed(values: np.ndarray) -> bytes:
    """Byte by byte of all values, as high bytes are mostly 0."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), 1)


def _unsqueezed(data: bytes, kind: type, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(-1, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _send_keys(group: pd.DataFrame, length: int, buckets: int) -> pd.DataFrame:
    """The distinct keys of a chunk for each bucket, with a bit for those of several windows."""
    chunk = _Chunk(group, length, buckets)
    keys, _, counts = chunk.distinct_keys()
    rows = []
    for bucket, lo, hi in _by_bucket(keys):
        steps = np.diff(keys[lo:hi].astype(np.uint32), prepend=np.uint32(0))
        rows.append((bucket, chunk.chunk, hi - lo, np.packbits(counts[lo:hi] > 1).tobytes() + _squeezed(steps)))
    return pd.DataFrame(rows, columns=["bucket", "chunk", "n", "data"])


def _count_keys(group: pd.DataFrame) -> pd.DataFrame:
    """For each chunk one bit per key: seen more than once over all chunks."""
    parts, many = [], []
    for n, data in zip(group["n"], group["data"], strict=True):
        marks = -(-n // 8)
        many.append(_bits(data[:marks], n))
        parts.append(np.cumsum(_unsqueezed(data[marks:], np.uint32, n), dtype=np.uint32))
    _, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    seen = np.bincount(inverse, 1 + np.concatenate(many))[inverse] > 1
    return _answers(group, seen, 1)


def _answers(group: pd.DataFrame, bits: np.ndarray, step: int) -> pd.DataFrame:
    rows, at = [], 0
    for bucket, chunk, n in zip(group["bucket"], group["chunk"], group["n"], strict=True):
        own = bits[at:at + n]
        at += n
        if own.any():
            rows.append((chunk, bucket, step, np.packbits(own).tobytes()))
    return pd.DataFrame(rows, columns=["chunk", "bucket", "step", "data"])


def _heard(answers: pd.DataFrame, step: int) -> dict[int, bytes]:
    mine = answers[answers["step"] == step]
    return dict(zip(mine["bucket"], mine["data"], strict=True))


def _send_windows(group: pd.DataFrame, answers: pd.DataFrame, length: int, buckets: int) -> pd.DataFrame:
    """Hashes of a chunk's windows that may be repeated, each once with the chunk's smallest id for it."""
    rows = []
    if len(group) and len(answers):
        chunk = _Chunk(group, length, buckets)
        _, _, firsts = chunk.shared(_heard(answers, 1))
        for bucket, lo, hi in _by_bucket(chunk.keys[firsts]):
            own = firsts[lo:hi]
            ids = _squeezed(chunk.places[chunk.doc[own]])
            rows.append((bucket, chunk.chunk, hi - lo, chunk.first[own].tobytes() + (chunk.second[own] >> np.uint64(32)).astype(np.uint32).tobytes() + ids))
    return pd.DataFrame(rows, columns=["bucket", "chunk", "n", "data"])


def _find_smaller(group: pd.DataFrame) -> pd.DataFrame:
    """For each chunk one bit per window: another chunk has it with a smaller id."""
    first, second, ids = [], [], []
    for n, data in zip(group["n"], group["data"], strict=True):
        first.append(np.frombuffer(data, np.uint64, n))
        second.append(np.frombuffer(data, np.uint32, n, 8 * n))
        ids.append(_unsqueezed(data[12 * n:], np.int64, n))
    first, second, ids = (np.concatenate(x) for x in (first, second, ids))
    order = np.lexsort((second, first))
    cuts = np.flatnonzero(np.r_[True, (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0)])
    least = np.empty(len(ids), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(ids[order], cuts), np.diff(np.r_[cuts, len(ids)]))
    return _answers(group, least < ids, 2)


def _cut(group: pd.DataFrame, answers: pd.DataFrame, length: int, buckets: int) -> pd.DataFrame:
    """The documents of a chunk with their removed intervals and the words left."""
    chunk = _Chunk(group, length, buckets)
    edges = np.zeros(int(chunk.lengths.sum()) + 1, np.int64)
    if len(answers):
        windows, number, firsts = chunk.shared(_heard(answers, 1))
        elsewhere, heard = np.zeros(len(firsts), bool), _heard(answers, 2)
        for bucket, lo, hi in _by_bucket(chunk.keys[firsts]):
            if bucket in heard:
                elsewhere[lo:hi] = _bits(heard[bucket], hi - lo)
        least = chunk.places[chunk.doc[firsts]]
        lost = chunk.starts[windows[elsewhere[number] | (least[number] < chunk.places[chunk.doc[windows]])]]
        np.add.at(edges, lost, 1)
        np.add.at(edges, lost + length, -1)
    covered = np.cumsum(edges)[:-1] > 0
    rows = []
    for k, words in enumerate(chunk.words):
        own = covered[chunk.begins[k]:chunk.begins[k] + len(words)]
        if own.any():
            spans = np.flatnonzero(np.diff(np.r_[0, own.astype(np.int8), 0])).reshape(-1, 2)
            kept = [w for w, gone in zip(words, own.tolist(), strict=True) if not gone]
        else:
            spans, kept = np.zeros((0, 2), np.int64), words
        rows.append((int(chunk.places[k]), chunk.none[k], len(words), spans.tolist(), b" ".join(kept).decode()))
    return pd.DataFrame(rows, columns=["place", "none", "n_words", "spans", "kept"])


def _between(least: int, most: int, total: int) -> int:
    return min(max(least, math.isqrt(4000 * total)), most)


def remove_repeated_windows(docs: DataFrame, *, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id``, ``n_words``, ``spans`` (removed words, [start, end) pairs in order) and ``kept`` (the words left, a space between)."""
    if length < 1:
        raise ValueError("a window has at least one word")
    own = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(own, F.lit(LAST_ID)).alias("place"), own.isNull().alias("none"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    chunks = max(1, -(-total // _between(CHUNK_BYTES, CHUNK_MOST, total)))
    buckets = max(1, -(-total // _between(BUCKET_BYTES, BUCKET_MOST, total)))
    by_chunk = rows.withColumn("chunk", F.pmod(F.xxhash64("place", "text"), F.lit(chunks))).groupBy("chunk")
    keys = by_chunk.applyInPandas(lambda g: _send_keys(g, length, buckets), MESSAGE)
    seen = keys.groupBy("bucket").applyInPandas(_count_keys, ANSWER)
    windows = by_chunk.cogroup(seen.groupBy("chunk")).applyInPandas(lambda g, a: _send_windows(g, a, length, buckets), MESSAGE)
    smaller = windows.groupBy("bucket").applyInPandas(_find_smaller, ANSWER)
    done = by_chunk.cogroup(seen.unionByName(smaller).groupBy("chunk")).applyInPandas(
        lambda g, a: _cut(g, a, length, buckets), "place long, none boolean, n_words long, spans array<array<long>>, kept string")
    return done.select(F.when(~F.col("none"), F.col("place")).alias("id"), "n_words", "spans", "kept")
