"""Ranked lexical search: an inverted index in shards, read with Block-Max MaxScore.

``build_index`` reads the documents once, without moving a text. A task cuts its documents
into shards of about ``SHARD_BYTES`` and turns each into posting lists: per term the
documents that hold it with the term's occurrences, in blocks of ``BLOCK`` postings, as gaps in
variable-length bytes. A block carries its last document and, for every power of two of the occurrences,
the most occurrences and the shortest document; the highest impact in the block then follows for
whatever counts the whole corpus turns out to have, without decompressing it.

``search_index`` takes document frequencies and lengths from the whole index and then ranks the
documents of each shard for every query. Bounds of whole lists, in ascending order, split the query's lists: documents
that are only in lists whose bounds together do not beat the k-th best score so far cannot get in, so only
the other, essential, lists are read. Of a document found there, the block maxima of the
non-essential lists say what it can still gain, so most are rejected before a block of those
is decompressed; the rest read only the blocks in which they are, highest bound first. The k best of the shards are merged at the end.

Documents are taken in ranges of their numbers inside the shard, which are in the order of ids;
a range whose block maxima do not beat the k-th score is skipped as a whole.

Scores are whole numbers: a term weighs floor(1000 * ln((2 N + 2) / (2 df + 1))), a
document's length counts as m = 25 + (75 n N) div L, and the score sums
weight * ((10^9 tf) div (1000 tf + 8 m)) over the query's terms with their repeats.

Defined cases: a null or empty text has no terms and is never found, nor are scores of 0; a query
without terms finds nothing; repeated rows are documents of their own, repeated queries each get
their result; equal scores go by ascending id, documents without one last; other columns are
ignored; an empty table of documents or queries gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from protomatch.llm.staging import shared_folder, written

TOP = 10
# Bytes of text in a shard, postings in a block, documents looked at together.
SHARD_BYTES, BLOCK, RANGE = 48 << 20, 64, 1024
# Query terms that one pass hands to every task.
PASS_TERMS = 200_000
# Everything that is not a digit, a letter or beyond ASCII separates terms; only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
NO_ID = np.iinfo(np.int64).max
# A row without a term describes the shard: documents in ``df``, terms in ``places``, ids and lengths in the two cells.
INDEX = "shard long, term string, df int, places long, meta binary, postings binary"


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def _varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits to a byte, lowest first, the last byte below 128; and where each value ends."""
    sizes = 1 + sum((values >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        has = np.flatnonzero(sizes > k)
        if len(has):
            out[ends[has] - sizes[has] + k] = (values[has] >> 7 * k & 127) | np.where(sizes[has] > k + 1, 128, 0)
    return out, ends


def _from_varints(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128) + 1
    sizes = np.diff(ends, prepend=0)
    out = np.zeros(len(ends), np.int64)
    for k in range(int(sizes.max(initial=0))):
        has = np.flatnonzero(sizes > k)
        out[has] |= (data[ends[has] - sizes[has] + k].astype(np.int64) & 127) << 7 * k
    return out


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Cells of bytes that end at ``ends``."""
    offsets = np.r_[0, ends].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


class _Shard:
    """Documents of a task until they are enough for a shard."""

    def __init__(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.ids: list[int | None] = []
        self.docs: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, text: str) -> None:
        terms = terms_of(text)
        if terms:
            self.ids.append(doc_id)
            self.docs.append(np.fromiter(map(self.numbers.__getitem__, terms), np.int32, len(terms)))
            self.size += len(text)

    def rows(self, shard: int) -> pa.RecordBatch:
        missing = np.array([i is None for i in self.ids])
        ids = np.array([NO_ID if i is None else i for i in self.ids], np.int64)
        order = np.lexsort((ids, missing))
        ids, missing, docs = ids[order], missing[order], [self.docs[k] for k in order.tolist()]
        lengths = np.array([len(d) for d in docs], np.int64)
        # Terms by their bytes, documents by id: a posting is one number.
        vocabulary = sorted(self.numbers)
        rank = np.empty(len(vocabulary), np.int64)
        rank[[self.numbers[t] for t in vocabulary]] = np.arange(len(vocabulary))
        keys = rank[np.concatenate(docs)] * len(docs) + np.repeat(np.arange(len(docs)), lengths)
        keys, tf = np.unique(keys, return_counts=True)
        term, doc = keys // len(docs), keys % len(docs)
        n_terms = len(vocabulary)
        df = np.bincount(term, minlength=n_terms)
        places = np.bincount(term, tf, n_terms).astype(np.int64)
        begin = _starts(df)
        # Blocks, each inside one list.
        n_blocks = -(-df // BLOCK)
        of_block = np.repeat(np.arange(n_terms), n_blocks)
        local = np.arange(len(of_block)) - _starts(n_blocks)[of_block]
        first = begin[of_block] + local * BLOCK
        past = np.minimum(first + BLOCK, (begin + df)[of_block])
        gap = np.diff(doc, prepend=-1) - 1
        gap[begin] = doc[begin]
        data, ends = _varints(np.stack([gap, tf - 1], axis=1).ravel())
        ends = ends[1::2]
        list_ends = ends[begin + df - 1]
        list_starts = np.r_[0, list_ends[:-1]]
        # Per block and power of two of the occurrences: most occurrences, shortest document.
        power = np.frexp(tf)[1].astype(np.int64)
        block = np.repeat(np.arange(len(of_block)), past - first)
        by_class = np.argsort(block * 64 + power, kind="stable")
        cut = np.flatnonzero(np.diff((block * 64 + power)[by_class], prepend=-1))
        class_block = block[by_class[cut]]
        class_tf = np.maximum.reduceat(tf[by_class], cut)
        class_n = np.minimum.reduceat(lengths[doc][by_class], cut)
        # Per list: number of blocks, last documents, ends, then (block, occurrences, length) of its classes.
        class_list = of_block[class_block]
        n_classes = np.bincount(class_list, minlength=n_terms)
        sizes = 1 + 2 * n_blocks + 3 * n_classes
        at = _starts(sizes)
        meta = np.empty(int(sizes.sum()), np.int32)
        meta[at] = n_blocks
        meta[at[of_block] + 1 + local] = doc[past - 1]
        meta[at[of_block] + 1 + n_blocks[of_block] + local] = ends[past - 1] - list_starts[of_block]
        here = at[class_list] + 1 + 2 * n_blocks[class_list] + 3 * (np.arange(len(class_list)) - _starts(n_classes)[class_list])
        meta[here], meta[here + 1], meta[here + 2] = local[class_block], class_tf, class_n
        names = b"".join(vocabulary)
        name_ends = np.cumsum([len(t) for t in vocabulary])
        header = [ids.tobytes() + missing.tobytes(), lengths.astype(np.int32).tobytes()]
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(n_terms + 1, shard)),
            pa.concat_arrays([pa.array([None], pa.string()), _binary(np.frombuffer(names, np.uint8), name_ends).cast(pa.string())]),
            pa.array(np.r_[len(docs), df].astype(np.int32)), pa.array(np.r_[lengths.sum(), places]),
            pa.concat_arrays([pa.array(header[:1]), _binary(meta.view(np.uint8), 4 * np.cumsum(sizes))]),
            pa.concat_arrays([pa.array(header[1:]), _binary(data, list_ends)]),
        ], names=["shard", "term", "df", "places", "meta", "postings"])


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Posting lists of the documents, one row per shard and term, and one per shard without a term; to be written as a table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, made, task = _Shard(), 0, TaskContext.get().partitionId()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard.add(doc_id, text)
                if shard.size >= SHARD_BYTES:
                    yield shard.rows((task << 24) + made)
                    shard, made = _Shard(), made + 1
        if shard.ids:
            yield shard.rows((task << 24) + made)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, INDEX)


class _List:
    """A posting list of a shard; blocks are decompressed when they are asked for, and once."""

    def __init__(self, meta: bytes, postings: bytes, norms: np.ndarray, slack: int, stretch: int, whole: int) -> None:
        values = np.frombuffer(meta, np.int32)
        n = int(values[0])
        self.lasts, self.ends, self.data, self.norms = values[1:1 + n], values[1 + n:1 + 2 * n], np.frombuffer(postings, np.uint8), norms
        classes = values[1 + 2 * n:].reshape(-1, 3).astype(np.int64)
        self.maxima = np.zeros(n, np.int64)
        np.maximum.at(self.maxima, classes[:, 0], _impact(classes[:, 1], slack + stretch * classes[:, 2] // whole))
        self.bound = int(self.maxima.max())
        # The highest impact in every range of documents: of all blocks that reach into it.
        firsts = np.r_[0, self.lasts[:-1] + 1] // RANGE
        n_ranges = -(-len(norms) // RANGE)
        spans = self.lasts // RANGE - firsts + 1
        self.range_maxima = np.zeros(n_ranges, np.int64)
        of = np.repeat(np.arange(n), spans)
        np.maximum.at(self.range_maxima, np.arange(len(of)) - _starts(spans)[of] + firsts[of], self.maxima[of])
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block and the term's impact on each."""
        held = self.blocks.get(k)
        if held is None:
            values = _from_varints(self.data[self.ends[k - 1] if k else 0:self.ends[k]])
            docs = np.cumsum(values[::2] + 1) + (int(self.lasts[k - 1]) if k else -1)
            held = self.blocks[k] = docs, _impact(values[1::2] + 1, self.norms[docs])
        return held

    def between(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Postings of documents from ``lo`` up to ``hi``."""
        first, last = np.searchsorted(self.lasts, lo), np.searchsorted(self.lasts, hi - 1)
        parts = [self.block(k) for k in range(first, min(last + 1, len(self.lasts)))]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        docs, impacts = (np.concatenate(x) for x in zip(*parts, strict=True))
        inside = slice(*np.searchsorted(docs, [lo, hi]))
        return docs[inside], impacts[inside]

    def block_maxima(self, docs: np.ndarray) -> np.ndarray:
        """The highest impact of the block in which each document would be."""
        at = np.searchsorted(self.lasts, docs)
        return np.where(at < len(self.lasts), self.maxima[np.minimum(at, len(self.lasts) - 1)], 0)

    def impacts(self, docs: np.ndarray) -> np.ndarray:
        """The term's impact on each of the ascending documents; only their blocks are read."""
        at, out = np.searchsorted(self.lasts, docs), np.zeros(len(docs), np.int64)
        for k in np.unique(at[at < len(self.lasts)]).tolist():
            held, impacts = self.block(k)
            mine = np.flatnonzero(at == k)
            place = np.minimum(np.searchsorted(held, docs[mine]), len(held) - 1)
            out[mine] = np.where(held[place] == docs[mine], impacts[place], 0)
        return out


def _impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * norm)


def best_of_shard(lists: list[tuple[int, _List]], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best documents (by number) for weighted lists, and their scores; best first, equal ones by number."""
    lists = sorted(((w, x) for w, x in lists if w > 0), key=lambda x: x[0] * x[1].bound)
    top_docs, top_scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    if not lists:
        return top_docs, top_scores
    sums = np.cumsum([w * x.bound for w, x in lists])
    ranges = sum(w * x.range_maxima for w, x in lists)
    for r in range(len(ranges)):
        if ranges[r] <= least:
            continue
        lo, hi = r * RANGE, min(n_docs, (r + 1) * RANGE)
        # Lists from here on are essential: those before do not beat the k-th score even together.
        essential = int(np.searchsorted(sums, least, side="right"))
        if essential == len(lists):
            break
        acc = np.zeros(hi - lo, np.int64)
        for w, x in lists[essential:]:
            if x.range_maxima[r]:
                docs, impacts = x.between(lo, hi)
                acc[docs - lo] += w * impacts
        found = np.flatnonzero(acc)
        scores, docs = acc[found], found + lo
        weak = [(w, x) for w, x in lists[:essential] if x.range_maxima[r]]
        gains = [w * x.block_maxima(docs) for w, x in weak]
        ahead = sum(gains, np.zeros(len(docs), np.int64))
        for j in range(len(weak) - 1, -2, -1):
            alive = scores + ahead > least
            if not alive.all():
                docs, scores, ahead = docs[alive], scores[alive], ahead[alive]
                gains = [g[alive] for g in gains[:j + 1]]
            if j < 0 or not len(docs):
                break
            w, x = weak[j]
            ahead = ahead - gains[j]
            scores = scores + w * x.impacts(docs)
        if len(docs):
            top_docs, top_scores = np.r_[top_docs, docs], np.r_[top_scores, scores]
            order = np.lexsort((top_docs, -top_scores))[:k]
            top_docs, top_scores = top_docs[order], top_scores[order]
            least = int(top_scores[-1]) if len(order) == k else 0
    return top_docs, top_scores


def _search_shard(lists: pd.DataFrame, header: pd.DataFrame, queries: list[tuple], k: int, n: int, total: int) -> pd.DataFrame:
    """(query, document, score) of the best of a shard for every query."""
    out = []
    if len(lists) and len(header):
        n_docs = int(header["df"].iloc[0])
        ids, missing = np.frombuffer(header["meta"].iloc[0], np.int64, n_docs), np.frombuffer(header["meta"].iloc[0], bool, n_docs, 8 * n_docs)
        lengths = np.frombuffer(header["postings"].iloc[0], np.int32).astype(np.int64)
        norms = 25 + 75 * n * lengths // total
        held = {t: _List(m, p, norms, 25, 75 * n, total) for t, m, p in zip(lists["term"], lists["meta"], lists["postings"], strict=True)}
        for query, terms in queries:
            docs, scores = best_of_shard([(w, held[t]) for t, w in terms if t in held], n_docs, k)
            out += [(query, None if m else i, s) for i, m, s in zip(ids[docs].tolist(), missing[docs].tolist(), scores.tolist(), strict=True)]
    return pd.DataFrame({
        "query": pd.array([x[0] for x in out], "Int64"), "doc_id": pd.array([x[1] for x in out], "Int64"), "score": pd.array([x[2] for x in out], "Int64"),
    })


def _searcher(shared, k: int, n: int, total: int):
    return lambda lists, header: _search_shard(lists, header, shared.value, k, n, total)


def search_index(
    index: DataFrame, queries: DataFrame, *, query_col: str = "item_id", text_col: str = "text", k: int = TOP, pass_terms: int = PASS_TERMS,
) -> DataFrame:
    """The ``k`` best documents of each row of ``queries``: the query's id, ``rank`` (from 1), ``doc_id``, ``score``.

    ``index`` is a written table. Queries reach the tasks in passes of about ``pass_terms`` terms.
    """
    spark = index.sparkSession
    folder = shared_folder(spark)
    headers, lists = index.where(F.col("term").isNull()), index.where(F.col("term").isNotNull())
    whole = headers.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"), F.coalesce(F.sum("places"), F.lit(0)).alias("total")).first()
    n, total = whole["n"], whole["total"]
    asked = written(queries.select(F.monotonically_increasing_id().alias("query"), F.col(query_col).alias("name"), F.col(text_col).alias("text")), folder, "queries")
    terms = asked.select("query", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))).alias("term"))
    terms = terms.groupBy("query", "term").agg(F.count("*").alias("times"))
    known = lists.select("term", "df").join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * n + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long")
    weighed = written(terms.join(known, "term").select("query", "term", (F.col("times") * weight).alias("weight")).where("weight > 0"), folder, "weights")
    passes = max(1, -(-weighed.count() // pass_terms))
    # Columns of their own, as both sides come from the one table.
    described = headers.select(*[F.col(c).alias(c) for c in ("shard", "df", "meta", "postings")])
    part, found = F.pmod(F.xxhash64("query"), F.lit(passes)), None
    for p in range(passes):
        of_pass = weighed.where(part == p)
        by_query: dict[int, list] = {}
        for r in of_pass.collect():
            by_query.setdefault(r["query"], []).append((r["term"], r["weight"]))
        shared = spark.sparkContext.broadcast(sorted(by_query.items()))
        read = lists.join(F.broadcast(of_pass.select("term").distinct()), "term", "left_semi")  # at most about pass_terms terms
        read = read.select(*[F.col(c).alias(c) for c in ("shard", "term", "meta", "postings")])
        best = read.groupBy("shard").cogroup(described.groupBy("shard")).applyInPandas(
            _searcher(shared, k, n, total), "query long, doc_id long, score long")
        found = best if found is None else found.unionByName(best)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("query", "name"), "query").select(F.col("name").alias(query_col), "rank", "doc_id", "score")


def rank_documents(
    docs: DataFrame, queries: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", query_col: str = "item_id", query_text_col: str = "text", k: int = TOP,
) -> DataFrame:
    """Index ``docs`` in the shared folder and search it."""
    index = written(build_index(docs, id_col=id_col, text_col=text_col), shared_folder(docs.sparkSession), "index")
    return search_index(index, queries, query_col=query_col, text_col=query_text_col, k=k)
