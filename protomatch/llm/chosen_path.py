"""Jaccard join of word n-grams by chosen paths.

Texts are sets of runs of five words. Texts with equal sets are one class. Every
class descends random trees, one per run: at a node it follows one or two (1.25 on
average) sampled min-hash coordinates, and the child is named by the coordinate and
its value there, a token of the set. Classes that share a token with the chance
of their similarity stay together. A node with few classes is a leaf; larger ones are
split again down to ``MAX_DEPTH``; what is still together then is nearly all
alike. Leaves are compared by brute force with exact similarities, in blocks when large, so
no task holds more than two blocks. Runs are repeated until a pair at
the threshold is missed with a chance of at most 1 - ``recall``.

A pair that meets in several leaves is judged only in the one with the smallest name;
a first pass over names alone finds which texts each leaf really needs. Within a
leaf, links are counted per class and joined to trees, so a group of copies never becomes
rows for all its pairs. Linked classes get one id by repeated minima with
shortcuts, over tables of links, none of which the driver sees.

Defined cases: a text without words (null, empty) is linked to texts without words that
are equal to it (null counts as empty) and to nothing else; with fewer than five words, all of them are
one run; repeated rows are documents of their own; a class whose ids are all null has
id null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protomatch.llm.staging import shared_folder, written

RUN_WORDS = 5
# Similarity of at least 4 / 5, in whole numbers.
NUMERATOR, DENOMINATOR = 4, 5
COORDINATES = 96
SECOND_PATH = 0.25
LEAF, BLOCK, MAX_DEPTH = 64, 256, 4
RECALL = 0.9999
WORD = re.compile(r"\w+")
MASK = 2**64 - 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SEEDS = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def runs_of(text: str) -> np.ndarray:
    """Sorted distinct digests of the runs of words."""
    words = np.array([xxhash.xxh64_intdigest(w) for w in WORD.findall(text.lower())], np.uint64)
    if not len(words):
        return words
    n = max(1, len(words) - RUN_WORDS + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(RUN_WORDS, len(words))):
        out = mixed(out + words[k:k + n] + np.uint64(k + 1))
    return np.unique(out)


def signature(runs: np.ndarray) -> np.ndarray:
    """Smallest digest under each of the seeds, 32 bits of it."""
    low = np.full(COORDINATES, MASK, np.uint64)
    for lo in range(0, len(runs), 2048):
        low = np.minimum(low, mixed(runs[lo:lo + 2048, None] ^ SEEDS[None, :]).min(0))
    return (low & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def meeting_chance(similarity: float, depth: int) -> float:
    """Chance that a pair is still together at some node of ``depth`` in one run."""
    p = 1.0
    for _ in range(depth):
        apart = 1 - similarity * p
        p = 1 - ((1 - SECOND_PATH) * apart + SECOND_PATH * apart**2)
    return p


def runs_needed(recall: float = RECALL) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - meeting_chance(NUMERATOR / DENOMINATOR, MAX_DEPTH)))


def _children(signatures: np.ndarray, parents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and names of the nodes that rows go to from their parents."""
    a = mixed(parents + np.uint64(0x51_7C_C1_B7))
    first = (a % np.uint64(COORDINATES)).astype(np.int64)
    second = (mixed(a) % np.uint64(COORDINATES - 1)).astype(np.int64)
    second += second >= first
    rows = np.arange(len(parents))
    twice = rows[mixed(a ^ np.uint64(0xABCDEF)) < np.uint64(int(SECOND_PATH * 2**64))]
    row, coordinate = np.concatenate([rows, twice]), np.concatenate([first, second[twice]])
    value = signatures[row, coordinate].astype(np.uint64)
    return row, mixed(mixed(parents[row] ^ mixed(coordinate.astype(np.uint64) + np.uint64(7))) + value)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def signed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id``, ``h`` (digest of the text), ``node`` (digest of its set), ``sig`` (null without words)."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nodes, sigs = [], []
            for text in batch["text"]:
                runs = runs_of(text)
                nodes.append(xxhash.xxh64_intdigest(runs.tobytes() if len(runs) else b"text " + text.encode(), 11))
                sigs.append(signature(runs).tobytes() if len(runs) else None)
            yield pd.DataFrame({"id": batch["id"], "h": batch["h"], "node": _signed(np.array(nodes, np.uint64)), "sig": sigs})

    # Ids travel as text: a nullable long would reach pandas as a float.
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    return rows.mapInPandas(sign, "id string, h long, node long, sig binary").withColumn("id", F.col("id").cast("long"))


def _descend(rows: DataFrame) -> DataFrame:
    """From (``path``, ``node``, ``sig``) to (``path``, ``node``) one level down; a child has one parent, so no row comes twice."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                sigs = np.frombuffer(b"".join(batch["sig"]), np.uint32).reshape(len(batch), -1)
                row, path = _children(sigs, batch["path"].to_numpy().view(np.uint64))
                yield pd.DataFrame({"path": _signed(path), "node": batch["node"].to_numpy()[row]})

    return rows.select("path", "node", "sig").mapInPandas(step, "path long, node long")


def _sized(rows: DataFrame) -> DataFrame:
    """Rows of nodes with at least two classes, with the number of them."""
    sizes = rows.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
    return rows.join(sizes, "path")


def leaves(classes: DataFrame, folder: str, recall: float = RECALL) -> DataFrame:
    """(``path``, ``node``, ``size``): the classes of every leaf with at least two."""
    signed = classes.where("sig is not null").select("node", "sig")
    roots = F.array(*(F.lit(int(x)) for x in _signed(mixed(np.arange(101, 101 + runs_needed(recall), dtype=np.uint64)))))
    rows, found = signed.withColumn("path", F.explode(roots)), None
    for depth in range(1, MAX_DEPTH + 1):
        level = written(_sized(_descend(rows)), folder, f"level-{depth}")
        large = F.col("size") > (LEAF if depth < MAX_DEPTH else 2**62)
        part = level.where(~large)
        found = part if found is None else found.unionByName(part)
        rest = level.where(large)
        if depth == MAX_DEPTH or rest.isEmpty():
            break
        rows = rest.join(signed, "node")
    return found


def _grouped(batches: Iterator[pd.DataFrame], names: list[str]) -> Iterator[pd.DataFrame]:
    """Rows of equal keys together, from batches sorted by key."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[names].to_numpy()
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and (held[0][names].to_numpy()[0] != keys[lo]).any():
                yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            held.append(batch.iloc[lo:hi])
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


def _own_pairs(path: int, group: pd.DataFrame) -> np.ndarray:
    """Pairs of rows that this leaf has to judge, as a matrix: of unlike blocks if there are two, and in no smaller leaf together."""
    n, blocks = len(group), group["block"].to_numpy()
    mine = np.triu(np.ones((n, n), bool), 1)
    if (group["i"].iloc[0]) != (group["j"].iloc[0]):
        mine &= blocks[:, None] != blocks[None, :]
    names = [np.asarray(x) for x in group["paths"]]
    row, name = np.repeat(np.arange(n), [len(x) for x in names]), np.concatenate(names)
    row, name = row[name < path], name[name < path]
    order = np.argsort(name, kind="stable")
    row, name = row[order], name[order]
    cuts = [0, *(np.flatnonzero(name[1:] != name[:-1]) + 1).tolist(), len(name)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if hi - lo > 1:
            mine[np.ix_(row[lo:hi], row[lo:hi])] = False
    return mine


def _similar(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Which of the pairs reach the threshold, exactly."""
    n = np.array([len(s) for s in sets])
    a, b = np.nonzero(pairs)
    fits = DENOMINATOR * np.minimum(n[a], n[b]) >= NUMERATOR * np.maximum(n[a], n[b])
    a, b = a[fits], b[fits]
    if len(a) <= 200:
        shared = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)], np.int64)
    else:
        token, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        _, token, times = np.unique(token, return_inverse=True, return_counts=True)
        kept = times[token] > 1
        token, owner = token[kept], owner[kept]
        _, token = np.unique(token, return_inverse=True)
        common = np.zeros((len(sets), len(sets)), np.float32)
        for lo in range(0, int(token.max(initial=-1)) + 1, 2048):
            part = np.zeros((len(sets), 2048), np.float32)
            inside = (token >= lo) & (token < lo + 2048)
            part[owner[inside], token[inside] - lo] = 1
            common += part @ part.T
        shared = common[a, b].astype(np.int64)
    linked = DENOMINATOR * shared >= NUMERATOR * (n[a] + n[b] - shared)
    return np.stack([a[linked], b[linked]])


def _roots(n: int, pairs: np.ndarray) -> list[int]:
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs.T.tolist():
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


KEYS = ["path", "i", "j"]


def _in_groups(rows: DataFrame, work: Callable, schema: str) -> DataFrame:
    """Each group of (path, two blocks) as one call; a group has at most about two blocks of rows."""
    dealt = rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "node")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, n = [], 0
        for group in _grouped(batches, KEYS):
            made = work(group)
            if made is not None:
                out.append(made)
                n += len(made)
            if n >= 4096:
                yield pd.concat(out, ignore_index=True)
                out, n = [], 0
        if out:
            yield pd.concat(out, ignore_index=True)

    return dealt.mapInPandas(run, schema)


def _needed(group: pd.DataFrame) -> pd.DataFrame | None:
    mine = _own_pairs(int(group["path"].iloc[0]), group)
    used = mine.any(0) | mine.any(1)
    return group.loc[used, [*KEYS, "block", "node"]] if used.any() else None


def _judged(group: pd.DataFrame) -> pd.DataFrame | None:
    group = group.drop_duplicates("node").reset_index(drop=True)
    if len(group) < 2:
        return None
    mine = _own_pairs(int(group["path"].iloc[0]), group)
    pairs = _similar([runs_of(t) for t in group["text"]], mine)
    if not pairs.shape[1]:
        return None
    copies = group["copies"].to_numpy()
    links = np.bincount(pairs[0], copies[pairs[1]], len(group)) + np.bincount(pairs[1], copies[pairs[0]], len(group))
    node, root = group["node"].to_numpy(), np.array(_roots(len(group), pairs))
    some = links > 0
    return pd.DataFrame({"node": node[some], "root": node[root[some]], "links": links[some].astype(np.int64)})


def connected(edges: DataFrame, folder: str) -> DataFrame:
    """(``node``, ``label``): the smallest node of each component, for nodes with an edge (``node``, ``root``)."""
    both = edges.select("node", "root").where("node <> root")
    both = written(both.unionByName(both.select(F.col("root").alias("node"), F.col("node").alias("root"))).distinct(), folder, "edges")
    labels = written(both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("label")), folder, "labels-0")
    for k in range(1, 64):
        near = both.join(labels.select(F.col("node").alias("root"), "label"), "root").groupBy("node").agg(F.min("label").alias("near"))
        moved = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        far = moved.select(F.col("node").alias("label"), F.col("label").alias("far"))
        moved = moved.join(far, "label").select("node", F.least("label", "far").alias("label"), "old")
        moved = written(moved, folder, f"labels-{k}")
        labels = moved.select("node", "label")
        if moved.where("label <> old").isEmpty():
            break
    return labels


def similar_documents(docs: DataFrame, *, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id``, ``h`` (64-bit digest of the text), ``class_id``, ``class_h`` and ``n_links``.

    A class is all documents linked in any number of steps, named by the smallest id in it and the digest of that text.
    ``n_links`` counts the other documents whose similarity to this one reaches the threshold, copies included.
    """
    folder = shared_folder(docs.sparkSession)
    signed = written(signed_documents(docs, id_col=id_col, text_col=text_col), folder, "signed")
    classes = written(signed.groupBy("node").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h")).alias("rep"), F.count("*").alias("copies"), F.max("sig").alias("sig"),
    ), folder, "classes")
    leaf = written(leaves(classes, folder, recall), folder, "leaves")
    paths = leaf.groupBy("node").agg(F.collect_list("path").alias("paths"))
    rows = leaf.join(paths, "node").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node", "path"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("path", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "paths")
    needed = written(_in_groups(rows, _needed, "path long, i int, j int, block int, node long"), folder, "needed")
    wanted = needed.join(paths, "node").join(classes.select("node", "rep", "copies"), "node")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    held = wanted.join(texts, (F.col("rep.h") == F.col("h")) & F.col("rep.id").eqNullSafe(F.col("id")))
    held = held.select(*KEYS, "block", "node", "paths", "copies", "text")
    judged = written(_in_groups(held, _judged, "node long, root long, links long"), folder, "judged")
    labels = connected(judged, folder)
    links = judged.groupBy("node").agg(F.sum("links").alias("links"))
    per_class = classes.select("node", "rep", "copies").join(labels, "node", "left").join(links, "node", "left")
    per_class = per_class.withColumn("label", F.coalesce("label", "node"))
    ids = per_class.groupBy("label").agg(F.min("rep").alias("first"))
    per_class = per_class.join(ids, "label").select("node", F.col("first.id").alias("class_id"), F.col("first.h").alias("class_h"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return signed.select("id", "h", "node").join(per_class, "node").select("id", "h", "class_id", "class_h", "n_links")
