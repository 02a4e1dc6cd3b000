"""Benchmark decontamination: a BM25 index of test items, read with block-max WAND.

Test items are indexed by word. An impact is a BM25 weight divided by what the item scores against
itself, so 1 means that a passage has every word of the item; document frequencies and the mean length
come from all items, however they are dealt over indexes. A training text is read as
overlapping passages, each a query. Items go in classes of like length; the passages of a class are twice
as long as its longest items and step by half, so every item that occurs in one stretch lies wholly in one passage.

In a class every word has a posting list (blocks of items, the highest impact in the block, then items and impacts)
and its maximum. The distinct words of a passage are taken in the order of their maxima. If even all maxima together
stay below the threshold, the passage is done. Otherwise the pivot is the word at which their running sum reaches half of it:
no item is found by the words before the pivot alone, so only the lists from there on are opened, and of these only the
block maxima. A block whose maxima over those words, and the most that any of its items could gain from words before the pivot,
stay below the threshold is skipped; postings are touched only in the others. Items there are
scored exactly, and all at or above the threshold are verified: share of the
item's runs of five words in the passage, and shares of the words of the question
(all but the last sentence; without one, the first three quarters) and of the answer (the rest).

Passages of many texts go through these steps together, as arrays. Impacts are whole billionths, so that no
score depends on the order of its sum. Indexes hold about ``index_items`` items at most and are broadcast; with more items, each
index reads the documents in a pass of its own, made, written and dropped one after the other.

Defined cases: a null or empty text is clean, so is every text if there are no items;
items without words are ignored; items shorter than five words are one run; an item without an id is found like any
other and listed as null; repeated items are all reported, rows equal in id and text once; repeated rows are judged one by one;
words are letters, digits and underscores, lower-cased; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from protomatch.llm.staging import shared_folder, written

RUN = 5
THRESHOLD, COVERAGE, QUESTION, ANSWER = 0.5, 0.8, 0.8, 0.5
K1, B = 1.2, 0.75
# Impacts are whole numbers of this many to 1.
UNIT = 10**9
NEED = int(THRESHOLD * UNIT)
# Where the pivot stands: the sum of maxima that words before it stay below. Any value up to the threshold gives the same result;
# a lower one opens more lists by their block maxima and far fewer blocks.
PIVOT = NEED // 2
BLOCK_ITEMS, INDEX_ITEMS, INDEX_WORDS = 8, 2048, 500_000
SHORTEST_CLASS = 8
# Characters of text whose passages are looked at together.
STEP_CHARS = 4 << 20
WORD = re.compile(r"\w+")
SENTENCE_END = re.compile(r"[.!?]\s+")
FOUND = "items array<long>, score double, coverage double"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def runs_of(words: list) -> set[tuple]:
    return {tuple(words[k:k + RUN]) for k in range(max(1, len(words) - RUN + 1))} if words else set()


def question_and_answer(text: str) -> tuple[set[str], set[str]]:
    """Words of all but the last sentence, and of the last one."""
    ends = [m.end() for m in SENTENCE_END.finditer(text.strip())]
    if ends:
        return set(words_of(text.strip()[:ends[-1]])), set(words_of(text.strip()[ends[-1]:]))
    words = words_of(text)
    cut = max(1, len(words) * 3 // 4)
    return set(words[:cut]), set(words[cut:])


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def _spread(begin: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places begin, begin + 1, ... of every row, and the row each belongs to."""
    row = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(row)) - _starts(counts)[row] + begin[row], row


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.flatnonzero(np.diff(keys, prepend=-1))]


def _summed(keys: np.ndarray, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (below ``size``), ascending, and the sums of their positive values."""
    if size <= 8 * len(keys) + (1 << 16):
        sums = np.bincount(keys, values, size)
        held = np.flatnonzero(sums)
        return held, sums[held].astype(np.int64)
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    cut = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[cut], np.add.reduceat(values, cut) if len(cut) else values


@dataclass
class LengthClass:
    """Items of up to ``step`` words. Words are known by their place in the order of maxima, ``rank_of`` a word's number."""

    step: int
    items: np.ndarray
    rank_of: np.ndarray
    maxima: np.ndarray
    # Per word: its blocks and the highest impact in each.
    block_begin: np.ndarray
    block: np.ndarray
    block_maximum: np.ndarray
    # Per block and word (as one number, ascending): place of an item in the class, and its impact.
    posting_key: np.ndarray
    posting_item: np.ndarray
    posting_impact: np.ndarray
    # Per block and word (ascending): the most that an item of the block gains from its words up to this one.
    gain_key: np.ndarray
    gain: np.ndarray


@dataclass
class Index:
    ids: list[int | None]
    term_ids: dict[str, int]
    classes: list[LengthClass]
    runs: list[set[tuple]]
    questions: list[set[str]]
    answers: list[set[str]]


def _length_class(step: int, members: list[tuple[int, dict[int, int]]], n_terms: int) -> LengthClass:
    """Of (item number, impact of each of its words), in the order in which they are dealt over blocks."""
    maxima = np.zeros(n_terms + 1, np.int64)
    for _, impacts in members:
        for t, x in impacts.items():
            maxima[t] = max(maxima[t], x)
    held = np.flatnonzero(maxima)
    held = held[np.lexsort((held, maxima[held]))]
    rank_of = np.full(n_terms + 1, -1)
    rank_of[held] = np.arange(len(held))
    word, place, impact = (np.array(x, np.int64) for x in zip(
        *[(rank_of[t], k, x) for k, (_, impacts) in enumerate(members) for t, x in impacts.items()], strict=True))
    block = place // BLOCK_ITEMS
    order = np.lexsort((place, word, block))
    word, place, impact, block = word[order], place[order], impact[order], block[order]
    key = block * len(held) + word
    cut = np.flatnonzero(np.diff(key, prepend=-1))
    highest, by_word = np.maximum.reduceat(impact, cut), np.lexsort((block[cut], word[cut]))
    gain_key, gain = [], []
    for b in range(int(block[-1]) + 1):
        words = np.unique(word[block == b])
        most = np.zeros(len(words), np.int64)
        for k in range(b * BLOCK_ITEMS, min(len(members), (b + 1) * BLOCK_ITEMS)):
            own = place == k
            at = np.zeros(len(words), np.int64)
            at[np.searchsorted(words, word[own])] = impact[own]
            most = np.maximum(most, np.cumsum(at))
        gain_key.append(b * len(held) + words)
        gain.append(most)
    return LengthClass(
        step, np.array([k for k, _ in members]), rank_of, maxima[held], np.searchsorted(word[cut][by_word], np.arange(len(held) + 1)),
        block[cut][by_word], highest[by_word], key, place, impact, np.concatenate(gain_key), np.concatenate(gain))


def _class_of(n_words: int) -> int:
    """Longest item of the class: 8, then steps of about a quarter."""
    step = SHORTEST_CLASS
    while step < n_words:
        step = step * 5 // 4
    return step


def build_index(items: list[tuple[int | None, str]], df: dict[str, int] | None = None, n: int | None = None, mean: float | None = None) -> Index:
    """Of (id, text) pairs; those without a word are left out. Counts are those of all items, or else of these."""
    listed = sorted(((len(words_of(t)), i, t) for i, t in items if words_of(t)), key=lambda x: (x[0], x[1] is None, x[1] or 0, x[2]))
    words = [words_of(t) for _, _, t in listed]
    df = Counter(w for ws in words for w in set(ws)) if df is None else df
    n = len(listed) if n is None else n
    mean = sum(map(len, words)) / max(1, len(words)) if mean is None else mean
    term_ids = {w: k for k, w in enumerate(sorted({w for ws in words for w in ws}))}
    classes: dict[int, list] = {}
    for k, ws in enumerate(words):
        weight = {}
        for w, tf in sorted(Counter(ws).items()):
            idf = np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
            weight[term_ids[w]] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ws) / mean))
        own = sum(weight.values())
        step = _class_of(len(ws))
        impacts = {t: max(1, round(x / own * UNIT)) for t, x in weight.items()}
        impacts[max(impacts, key=impacts.get)] += UNIT - sum(impacts.values())
        classes.setdefault(step, []).append((k, impacts))
    parts = [question_and_answer(t) for _, _, t in listed]
    return Index(
        [i for _, i, _ in listed], term_ids, [_length_class(s, m, len(term_ids)) for s, m in classes.items()],
        [runs_of(w) for w in words], [q for q, _ in parts], [a for _, a in parts])


def _passage_words(held: LengthClass, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of the passages whose maxima reach the threshold, as (passage, word) in ascending order; first passage of each text."""
    n_passages = -(-lengths // held.step)
    first = _starts(n_passages)
    words = held.rank_of[ids]
    at = np.flatnonzero(words >= 0)
    text = np.repeat(np.arange(len(lengths)), lengths)[at]
    own = (at - _starts(lengths)[text]) // held.step
    words, passage = words[at], own + first[text]
    # A place belongs to the passage that starts in its own step and to the one before.
    later = own > 0
    passage, words = np.r_[passage, passage[later] - 1], np.r_[words, words[later]]
    for distinct in (False, True):
        most = np.bincount(passage, held.maxima[words], int(n_passages.sum()))
        alive = most[passage] >= NEED
        passage, words = passage[alive], words[alive]
        if not distinct:
            passage, words = np.divmod(_distinct(passage * len(held.maxima) + words), len(held.maxima))
    return passage, words, first


def _open_blocks(held: LengthClass, passage: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks whose postings have to be touched: number of the passage among those left, block; and where the words of each passage begin and end."""
    n_words, maxima = len(held.maxima), held.maxima[words]
    begins = np.flatnonzero(np.diff(passage, prepend=-1))
    ends = np.r_[begins[1:], len(passage)]
    number = np.repeat(np.arange(len(begins)), ends - begins)
    running = np.cumsum(maxima)
    running -= (running[begins] - maxima[begins])[number]
    from_pivot = np.flatnonzero(running >= PIVOT)
    pivot = from_pivot[np.flatnonzero(np.diff(number[from_pivot], prepend=-1))]
    before = running[pivot] - maxima[pivot]
    # Block maxima of the lists from the pivot on.
    n_blocks = int(held.block.max()) + 1
    at, row = _spread(held.block_begin[words[from_pivot]], np.diff(held.block_begin)[words[from_pivot]])
    keys, bound = _summed(number[from_pivot][row] * n_blocks + held.block[at], held.block_maximum[at], len(begins) * n_blocks)
    number_of, block_of = np.divmod(keys, n_blocks)
    # What an item of the block can gain from words before the pivot.
    key = block_of * n_words + words[pivot][number_of] - 1
    place = np.searchsorted(held.gain_key, key, side="right") - 1
    gain = np.where((place >= 0) & (held.gain_key[place] // n_words == block_of), held.gain[place], 0)
    left = bound + np.minimum(before[number_of], gain) >= NEED
    return number_of[left], block_of[left], begins, ends


def retrieve(held: LengthClass, ids: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(item, text, first word, past the last word of the passage, score) for all items at or above the threshold.

    ``ids`` are the word numbers of all texts one after the other, ``lengths`` their words.
    """
    passage, words, first = _passage_words(held, ids, lengths)
    if not len(passage):
        return
    number_of, block_of, begins, ends = _open_blocks(held, passage, words)
    # Postings of all words of the passage in the blocks that are left.
    at, row = _spread(begins[number_of], (ends - begins)[number_of])
    key = block_of[row] * len(held.maxima) + words[at]
    lo = np.searchsorted(held.posting_key, key)
    post, of = _spread(lo, np.searchsorted(held.posting_key, key, side="right") - lo)
    pairs, scores = _summed(number_of[row[of]] * len(held.items) + held.posting_item[post], held.posting_impact[post], len(begins) * len(held.items))
    found = scores >= NEED
    for pair, score in zip(pairs[found].tolist(), scores[found].tolist(), strict=True):
        p, item = divmod(pair, len(held.items))
        of_text = int(np.searchsorted(first, passage[begins[p]], side="right")) - 1
        lo = int(passage[begins[p]] - first[of_text]) * held.step
        yield int(held.items[item]), of_text, lo, min(int(lengths[of_text]), lo + 2 * held.step), score


def _judge(index: Index, texts: list[str]) -> list[tuple[list[int | None], float, float]]:
    words = [words_of(t) for t in texts]
    lengths, unknown, number = np.array([len(w) for w in words], np.int64), len(index.term_ids), index.term_ids.get
    ids = np.array([number(w, unknown) for own in words for w in own], np.int64)
    found, best, covered = [set() for _ in texts], [0] * len(texts), [0.0] * len(texts)
    for held in index.classes:
        for item, k, lo, hi, score in retrieve(held, ids, lengths):
            passage = words[k][lo:hi]
            need = len(next(iter(index.runs[item])))
            runs = {tuple(passage[j:j + need]) for j in range(len(passage) - need + 1)}
            coverage = len(index.runs[item] & runs) / len(index.runs[item])
            covered[k], inside = max(covered[k], coverage), set(passage)
            question, answer = index.questions[item], index.answers[item]
            if coverage >= COVERAGE and len(question & inside) >= QUESTION * len(question) and len(answer & inside) >= ANSWER * len(answer):
                found[k].add(index.ids[item])
                best[k] = max(best[k], score)
    return [
        (sorted(f, key=lambda i: (i is None, i or 0)), min(b, UNIT) / UNIT, c) for f, b, c in zip(found, best, covered, strict=True)
    ]


def judge(index: Index, texts: list[str]) -> list[tuple[list[int | None], float, float]]:
    """Per text: verified items, the best score of a verified one and the best coverage of any; some texts at a time."""
    out, part, size = [], [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= STEP_CHARS:
            out += _judge(index, part)
            part, size = [], 0
    return out + (_judge(index, part) if part else [])


def _verdict(shared: Broadcast, text: Column) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = judge(shared.value, texts.tolist())
            yield pd.DataFrame({"items": [x[0] for x in out], "score": [x[1] for x in out], "coverage": [x[2] for x in out]})

    return F.pandas_udf(run, FOUND)(F.coalesce(text, F.lit("")))


def _item_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Items with their words."""
    for frame in frames:
        yield frame.assign(words=[words_of(t) for t in frame["text"]])


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", index_items: int = INDEX_ITEMS,
) -> DataFrame:
    """``docs`` as ``row`` (a struct of all its columns), with ``items`` (verified, by id), ``score`` and ``coverage``."""
    spark = docs.sparkSession
    rows = docs.select(F.struct("*").alias("row"))
    text = F.col("row")[text_col]
    folder = shared_folder(spark)
    items = benchmark.select(F.col(item_col).cast("long").cast("string").alias("id"), F.col(item_text_col).alias("text")).where("text is not null").distinct()
    items = written(items.mapInPandas(_item_words, "id string, text string, words array<string>").where(F.size("words") > 0), folder, "items")
    whole = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("words")).first()
    n, mean = whole["n"], whole["words"] / max(1, whole["n"])
    df = written(items.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").count(), folder, "frequencies")
    passes = max(1, -(-whole["words"] // INDEX_WORDS), 1 if n <= index_items else -(-n * 2 // index_items))
    part = F.pmod(F.xxhash64("id", "text"), F.lit(passes))

    def index(k: int) -> Index:
        mine = items.where(part == k)
        counts = df.join(mine.select(F.explode("words").alias("word")).distinct(), "word", "left_semi")
        held = [(None if r["id"] is None else int(r["id"]), r["text"]) for r in mine.select("id", "text").collect()]
        return build_index(held, {r["word"]: r["count"] for r in counts.collect()}, n, mean)

    if passes == 1:
        return rows.withColumn("found", _verdict(spark.sparkContext.broadcast(index(0)), text)).select("row", "found.*")
    # Several passes: each writes only texts with something found; equal texts have equal results.
    key = F.struct(F.xxhash64(text).alias("a"), F.md5(text).alias("b"))
    found = None
    for k in range(passes):
        shared = spark.sparkContext.broadcast(index(k))
        one = rows.select(key.alias("key"), _verdict(shared, text).alias("found")).select("key", "found.*").where("score > 0 or coverage > 0")
        one = written(one.distinct(), folder, f"pass-{k}")
        shared.destroy()
        found = one if found is None else found.unionByName(one)
    found = found.groupBy("key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.max("score").alias("score"), F.max("coverage").alias("coverage"),
    )
    joined = rows.withColumn("key", key).join(found, "key", "left")
    return joined.select(
        "row", F.coalesce("items", F.array().cast("array<long>")).alias("items"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
    )
