"""Quality classifier: a convolutional network over bytes, in numpy.

The first layer slides over the text in overlapping chunks of ``WIDTH`` bytes, one
every ``STEP`` bytes, up to the last byte; a filter adds one learned weight per byte
value and place. A gate and a value are learned per filter (value times sigmoid of the
gate). Over the whole text each filter keeps its largest value, the mean of its
values and the largest negated one; a second layer combines them into one probability.
Texts of any length are read whole, in pieces of bounded size.

The network is fitted on the driver on at most ``FIT_DOCUMENTS`` labelled documents
(a bounded sample, chosen by a digest of the id, with equally many of each label
where there are enough); training texts are read whole and in the same pieces as in
scoring. Scoring covers all documents and is map-only; the weights are broadcast and
have a fixed size.

Defined cases: a null text is an empty one; an empty text is one chunk of padding and
gets a score like any other; repeated rows are scored one by one; other columns are
ignored. Without labelled rows every score is 0.5; with one label only, every score
is that label's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, STEP, FILTERS = 8, 4, 16
FIT_DOCUMENTS, EPOCHS, RATE, SEED = 1500, 10, 0.01, 7
PAD = 256
PIECE = 1 << 16


@dataclass(frozen=True)
class Network:
    """Weights (WIDTH, 257, 2 * FILTERS) and biases of values, then gates; the output layer over pooled features."""

    weights: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def _chunks(data: np.ndarray) -> np.ndarray:
    """Byte values by chunk, (chunks, WIDTH); the end is padded so that every byte is in a chunk."""
    n = max(1, -(-max(len(data) - WIDTH, 0) // STEP) + 1)
    padded = np.full((n - 1) * STEP + WIDTH, PAD, np.int64)
    padded[:len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[::STEP]


def _pieces(text: str) -> Iterator[np.ndarray]:
    """The chunks of a whole text in pieces of bounded size; pieces overlap, so that none is missed or read twice."""
    data = np.frombuffer(text.encode(), np.uint8)
    for start in range(0, max(len(data) - WIDTH + STEP, 1), PIECE):
        yield _chunks(data[start:start + PIECE + WIDTH - STEP])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _layer(net: Network, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = net.weights[0][chunks[:, 0]]
    for k in range(1, WIDTH):
        both += net.weights[k][chunks[:, k]]
    both += net.bias
    return both[:, :FILTERS], _sigmoid(both[:, FILTERS:])


def score_text(net: Network, text: str) -> float:
    """Probability of label 1; the text is read in pieces that overlap, and pooled over all of them."""
    most, least, total, n = np.full(FILTERS, -np.inf), np.full(FILTERS, np.inf), np.zeros(FILTERS), 0
    for chunks in _pieces(text):
        value, gate = _layer(net, chunks)
        h = value * gate
        most, least = np.maximum(most, h.max(0)), np.minimum(least, h.min(0))
        total, n = total + h.sum(0), n + len(h)
    pooled = np.concatenate([most, total / n, -least])
    return float(_sigmoid(pooled @ net.out + net.out_bias)[0])


def _add_by_byte(into: np.ndarray, values: np.ndarray, d: np.ndarray) -> None:
    """Adds the rows of ``d`` to the rows of ``into`` that ``values`` name."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    into[ordered[first]] += np.add.reduceat(d[order], first, axis=0)


def _add_gradient(net: Network, text: str, label: float, g: dict[str, np.ndarray]) -> None:
    """Adds the gradient of one whole text: the pieces are pooled first, then each gives its part."""
    f = np.arange(FILTERS)
    most, least, total, n = np.full(FILTERS, -np.inf, np.float32), np.full(FILTERS, np.inf, np.float32), np.zeros(FILTERS), 0
    top, low, last = np.zeros((2, FILTERS), int), np.zeros((2, FILTERS), int), None
    for k, chunks in enumerate(_pieces(text)):
        value, gate = _layer(net, chunks)
        h = value * gate
        at = h.argmax(0)
        more = h[at, f] > most
        most[more], top[0, more], top[1, more] = h[at, f][more], k, at[more]
        at = h.argmin(0)
        less = h[at, f] < least
        least[less], low[0, less], low[1, less] = h[at, f][less], k, at[less]
        total, n, last = total + h.sum(0), n + len(h), (chunks, value, gate)
    pooled = np.concatenate([most, total / n, -least]).astype(np.float32)
    error = float(_sigmoid(pooled @ net.out + net.out_bias)[0]) - label
    g["out"] += error * pooled
    g["out_bias"] += error
    back, pieces = np.float32(error) * net.out, k + 1
    for k, chunks in enumerate(_pieces(text) if pieces > 1 else [last[0]]):
        value, gate = _layer(net, chunks) if pieces > 1 else last[1:]
        dh = np.tile(back[FILTERS:2 * FILTERS] / np.float32(n), (len(chunks), 1))
        here = top[0] == k
        dh[top[1, here], f[here]] += back[:FILTERS][here]
        here = low[0] == k
        dh[low[1, here], f[here]] -= back[2 * FILTERS:][here]
        d = np.concatenate([dh * gate, dh * value * gate * (1 - gate)], axis=1)
        g["bias"] += d.sum(0)
        for w in range(WIDTH):
            _add_by_byte(g["weights"][w], chunks[:, w], d)


def fit(texts: list[str], labels: list[int]) -> Network:
    """Adam on single documents in small batches; the same input gives the same network."""
    rng = np.random.default_rng(SEED)
    p = {
        "weights": rng.normal(0, 0.1, (WIDTH, PAD + 1, 2 * FILTERS)), "bias": np.zeros(2 * FILTERS),
        "out": rng.normal(0, 0.3, 3 * FILTERS), "out_bias": np.zeros(1),
    }
    p = {k: x.astype(np.float32) for k, x in p.items()}
    known = sorted(set(labels))
    if len(known) < 2:
        p["out"][:] = 0
        p["out_bias"][:] = {(): 0.0, (0,): -30.0, (1,): 30.0}[tuple(known)]
        return Network(**p)
    m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    y = np.array(labels, float)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS) + 1e-4
        order = rng.permutation(len(texts))
        for batch in np.array_split(order, max(1, len(order) // 16)):
            g = {k: np.zeros_like(x) for k, x in p.items()}
            net = Network(**p)
            for i in batch:
                _add_gradient(net, texts[i], y[i], g)
            t += 1
            for k in p:
                step = g[k] / len(batch)
                m[k] = 0.9 * m[k] + 0.1 * step
                v[k] = 0.99 * v[k] + 0.01 * step**2
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return Network(**p)


def fit_on(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", limit: int = FIT_DOCUMENTS,
) -> Network:
    """Fits on about ``limit`` labelled documents, half of each label; rows without a label are ignored.

    The sample is drawn from the labels alone and is broadcast to the documents, so no text is shuffled.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    chance = F.conv(F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("chance", chance)
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    wanted = F.lit(False)
    for label, n in counts.items():
        wanted = wanted | ((F.col("label") == label) & (F.col("chance") < F.lit(int(2**32 * min(1.0, limit / 2 / n)))))
    sample = rows.where(wanted).orderBy("chance", "id").limit(2 * limit)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # At most 2 * limit rows.
    found = texts.join(F.broadcast(sample), "id").collect()
    found.sort(key=lambda r: (r["chance"], r["id"], r["text"]))
    return fit([r["text"] for r in found], [r["label"] for r in found])


def score_documents(docs: DataFrame, net: Network, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id``, ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for texts in batches:
            yield pd.Series([score_text(model, t) for t in texts], dtype="float64")

    scored = F.pandas_udf(run, "double")
    return docs.select(F.col(id_col).alias("id"), scored(F.coalesce(F.col(text_col), F.lit(""))).alias("score"))
