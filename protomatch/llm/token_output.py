"""Token ids in training order: fixed-stride shards for sequential, resumable reads.

Texts are cut into tokens of a fixed public vocabulary (its path is a parameter),
each text is followed by the end token, and the tokens of a partition are cut into
sequences of ``length`` tokens, two bytes each, little-endian. Sequences get gapless
numbers; a keyed Feistel network over the next power of four, walked until the value
is below the number of sequences, maps each number to its slot in training order.
Slots are dealt out in ranges, one range of whole shards per partition, so that a
shard is ``per_shard`` slots in order and slot s starts at byte
(s % per_shard) * stride of shard s // per_shard.

Texts are tokenised once: sequences are written to the shared folder before they are
numbered, and a lost executor repeats neither. The driver holds one count per partition.

Defined cases: a null text is an empty one, which gives one end token; the last
sequence of a partition is filled up with end tokens; repeated rows are separate
texts; ids that are null are left out of the lists of ids; other columns are ignored;
an empty table gives no shard.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protomatch.llm.staging import shared_folder, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The expression that cuts texts before merging, and the id that the vocabulary leaves free.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
LENGTH, PER_SHARD, KEY, ROUNDS = 1024, 1024, 0x5EED, 6
DTYPE = np.dtype("<u2")

SEQUENCES = "part int, place long, doc_ids array<long>, payload binary"
SHARDS = "shard int, first_slot long, n_sequences int, stride int, doc_ids array<long>, sha256 string, payload binary"


@dataclass(frozen=True)
class Permutation:
    """A keyed permutation of 0 .. n - 1."""

    n: int
    key: int = KEY

    @property
    def half(self) -> int:
        return max(1, ((max(self.n - 1, 1)).bit_length() + 1) // 2)

    def _round(self, x: np.ndarray, k: int) -> np.ndarray:
        x = (x ^ np.uint64((self.key * 0x9E3779B97F4A7C15 + (k + 1) * 0xD1B54A32D192ED03) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(32))) & np.uint64(2**self.half - 1)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        shift, mask = np.uint64(self.half), np.uint64(2**self.half - 1)
        left, right = x >> shift, x & mask
        for k in range(ROUNDS):
            if back:
                left, right = right ^ self._round(left, ROUNDS - 1 - k), left
            else:
                left, right = right, left ^ self._round(right, k)
        return (left << shift) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = self._once(np.asarray(x, np.uint64), back)
        while (out := x >= np.uint64(self.n)).any():
            x[out] = self._once(x[out], back)
        return x.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, False)

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


def read_encoding(path: str = VOCABULARY) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sequences(docs: DataFrame, *, length: int = LENGTH, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sequences of each partition, numbered inside it."""
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in shared.value.splitlines() if line.strip())}
        encoding = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        part, place = TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, np.ndarray]] = []
        n_held = 0

        def emit(rows: list, last: bool) -> list:
            """Takes whole sequences from the front of what is held."""
            nonlocal held, n_held, place
            while n_held >= length or (last and n_held):
                tokens, ids = np.full(length, END, DTYPE), []
                filled = 0
                while held and filled < length:
                    doc, rest = held[0]
                    take = rest[:length - filled]
                    tokens[filled:filled + len(take)] = take
                    filled += len(take)
                    if doc is not None and doc not in ids[-1:]:
                        ids.append(doc)
                    held[0] = (doc, rest[len(take):])
                    if not len(held[0][1]):
                        held.pop(0)
                n_held -= filled
                rows.append((part, place, ids, tokens.tobytes()))
                place += 1
            return rows

        names = [c.split()[0] for c in SEQUENCES.split(", ")]
        for batch in batches:
            rows: list = []
            for doc, text in zip(batch["id"], batch["text"], strict=True):
                tokens = np.array([*encoding.encode_ordinary(text), END], DTYPE)
                held.append((None if pd.isna(doc) else int(doc), tokens))
                n_held += len(tokens)
                rows = emit(rows, False)
                if len(rows) >= 2048:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)
        yield pd.DataFrame(emit([], True), columns=names)

    # Ids travel as text: a nullable long would reach pandas as a float.
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(cut, SEQUENCES)


def training_shards(
    docs: DataFrame, *, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, vocabulary: str = VOCABULARY,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per shard: its slots in order as one ``payload`` of fixed stride, and the documents that are in it."""
    spark = docs.sparkSession
    sequences = written(
        token_sequences(docs, length=length, vocabulary=vocabulary, id_col=id_col, text_col=text_col), shared_folder(spark), "sequences",
    )
    counts = sorted((r["part"], r["count"]) for r in sequences.groupBy("part").count().collect())
    starts = np.concatenate([[0], np.cumsum([n for _, n in counts])]).astype(int).tolist()
    n = starts[-1]
    order = Permutation(max(n, 1), key)

    @F.pandas_udf("long")
    def slot_of(number: pd.Series) -> pd.Series:
        return pd.Series(order.slot(number.to_numpy()))

    first = spark.createDataFrame([(part, starts[k]) for k, (part, _) in enumerate(counts)], "part int, start long")
    n_shards = -(-n // per_shard)
    ranges = max(1, min(n_shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_shards // 16)))
    placed = sequences.join(F.broadcast(first), "part")  # one row per partition of the input
    placed = placed.select(slot_of(F.col("start") + F.col("place")).alias("slot"), "doc_ids", "payload")
    shard = F.floor(F.col("slot") / per_shard)
    by_range = placed.repartitionById(ranges, F.floor(shard * ranges / max(n_shards, 1)).cast("int")).sortWithinPartitions("slot")
    stride = length * DTYPE.itemsize

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ids, payload = None, set(), []

        def row() -> pd.DataFrame:
            data = b"".join(payload)
            return pd.DataFrame(
                [(now, now * per_shard, len(payload), stride, sorted(ids), hashlib.sha256(data).hexdigest(), data)],
                columns=[c.split()[0] for c in SHARDS.split(", ")],
            )

        for batch in batches:
            for slot, docs_in, data in zip(batch["slot"], batch["doc_ids"], batch["payload"], strict=True):
                if slot // per_shard != now:
                    if now is not None:
                        yield row()
                    now, ids, payload = slot // per_shard, set(), []
                ids.update(map(int, docs_in))
                payload.append(data)
        if now is not None:
            yield row()

    return by_range.mapInPandas(build, SHARDS)


def export_shards(shards: DataFrame, folder: str) -> list[str]:
    """Writes each shard as ``shard-000000.bin`` to a folder that all executors have mounted; a shard that is there whole is kept."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            paths = []
            for shard, payload in zip(batch["shard"], batch["payload"], strict=True):
                path = os.path.join(folder, f"shard-{shard:06d}.bin")
                if not (os.path.exists(path) and os.path.getsize(path) == len(payload)):
                    with open(f"{path}.{TaskContext.get().taskAttemptId()}", "wb") as out:
                        out.write(payload)
                    os.replace(out.name, path)
                paths.append(path)
            yield pd.DataFrame({"path": paths})

    return sorted(r["path"] for r in shards.select("shard", "payload").mapInPandas(write, "path string").collect())


def read_slots(folder: str, first_slot: int, *, length: int = LENGTH, per_shard: int = PER_SHARD) -> Iterator[np.ndarray]:
    """Sequences from a slot on, in training order: one seek, then sequential reads."""
    stride, shard = length * DTYPE.itemsize, first_slot // per_shard
    skip = first_slot % per_shard * stride
    while os.path.exists(path := os.path.join(folder, f"shard-{shard:06d}.bin")):
        with open(path, "rb") as data:
            data.seek(skip)
            while block := data.read(stride):
                yield np.frombuffer(block, DTYPE)
        shard, skip = shard + 1, 0
