"""Language identification with unigram pieces, summed over all segmentations.

Pieces are the byte strings of a fixed public vocabulary (its path is a parameter;
the driver reads it and broadcasts it, its size is fixed). Each language has a
probability per piece, fitted by expectation maximisation. The probability of a word
is the sum over all ways to cut it into pieces, by the forward algorithm; that of a
text is the product over its words: runs of letters, lower-cased, each with the blank
before it. As pieces never cross words, a word is summed once per task and reused.

Fitting takes a bounded sample: about ``SAMPLE_DOCS`` whole documents per language,
chosen by a digest of the id. Scoring is map-only, over whole texts.

Defined cases: a text that is null or has no letter is ``und`` with score 0; so is
every text if no language was learned. Equal posteriors go to the first language in
order. Rows without a language are not learned from. Repeated rows are scored one by
one; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SAMPLE_DOCS = 400
LONGEST = 16
ROUNDS, SMOOTHING = 4, 0.05
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
CACHE_WORDS, GROUP_DOCS, GROUP_WORDS = 300_000, 256, 8192
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class PieceModel:
    """Sorted digests of the pieces and their probabilities per language; the last row stands for no piece."""

    languages: tuple[str, ...]
    digests: np.ndarray
    probability: np.ndarray


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Pieces of at most LONGEST bytes, in lines of base64 and rank."""
    with open(path, "rb") as lines:
        pieces = {base64.b64decode(line.split()[0]) for line in lines if line.strip()}
    single = {bytes([b]) for b in range(256)}
    return sorted(p for p in pieces | single if len(p) <= LONGEST)


def _digest_step(h: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return (h + byte.astype(np.uint64) + np.uint64(1)) * MULTIPLIER


def _piece_digests(pieces: list[bytes]) -> np.ndarray:
    out = np.zeros(len(pieces), np.uint64)
    for n in range(1, LONGEST + 1):
        where = [k for k, p in enumerate(pieces) if len(p) == n]
        if where:
            letters = np.frombuffer(b"".join(pieces[k] for k in where), np.uint8).reshape(-1, n)
            h = np.zeros(len(where), np.uint64)
            for k in range(n):
                h = _digest_step(h, letters[:, k])
            out[where] = h
    return out


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def has_letter(words: list[str]) -> bool:
    return any(map(str.isalpha, words)) or any(c.isalpha() for w in words for c in w)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of words of equal length: their places and their bytes, one row each."""
    groups: dict[int, list[int]] = defaultdict(list)
    coded = [b" " + w.encode() for w in words]
    for k, w in enumerate(coded):
        groups[len(w)].append(k)
    for n, all_places in groups.items():
        for lo in range(0, len(all_places), GROUP_WORDS):
            places = all_places[lo:lo + GROUP_WORDS]
            yield np.array(places), np.frombuffer(b"".join(coded[k] for k in places), np.uint8).reshape(-1, n)


def _pieces_from(digests: np.ndarray, letters: np.ndarray, start: int) -> Iterator[tuple[int, np.ndarray]]:
    """For the pieces that start at a place: their end and their number per word (the last one: no piece)."""
    h = np.zeros(len(letters), np.uint64)
    for end in range(start + 1, min(start + LONGEST, letters.shape[1]) + 1):
        h = _digest_step(h, letters[:, end - 1])
        at = np.searchsorted(digests, h)
        at[at == len(digests)] = 0
        yield end, np.where(digests[at] == h, at, len(digests))


def word_log_probability(model: PieceModel, words: list[str]) -> np.ndarray:
    """Natural logarithm of each word's probability in each language, (words, languages)."""
    out = np.zeros((len(words), len(model.languages)))
    for places, letters in _by_length(words):
        n = letters.shape[1]
        alpha = {0: np.ones((len(letters), len(model.languages)))}
        scale = np.zeros((len(letters), 1))
        for start in range(n):
            here = alpha.pop(start)
            if start % 8 == 7:  # All places still ahead take the same factor, so long words do not vanish.
                factor = np.maximum(here.max(1, keepdims=True), 1e-300)
                here, scale = here / factor, scale + np.log(factor)
                alpha = {k: a / factor for k, a in alpha.items()}
            for end, piece in _pieces_from(model.digests, letters, start):
                part = here * model.probability[piece]
                alpha[end] = alpha[end] + part if end in alpha else part
        out[places] = np.log(np.maximum(alpha[n], 1e-300)) + scale
    return out


def fit(counts: dict[tuple[str, str], int], pieces: list[bytes], rounds: int = ROUNDS) -> PieceModel:
    """Expectation maximisation from word counts per (language, word)."""
    languages = tuple(sorted({language for language, _ in counts}))
    words = sorted({w for _, w in counts if len(w.encode()) < 64})
    place = {w: k for k, w in enumerate(words)}
    weight = np.zeros((len(words), len(languages)))
    for (language, word), n in counts.items():
        if word in place:
            weight[place[word], languages.index(language)] += n
    digests = _piece_digests(pieces)
    digests = np.unique(digests)
    v, n_lang = len(digests), len(languages)
    probability = np.full((v + 1, n_lang), 1 / max(v, 1))
    probability[v] = 0
    for _ in range(rounds if n_lang else 0):
        expected = np.zeros((v + 1, n_lang))
        for places, letters in _by_length(words):
            n = letters.shape[1]
            edges = [list(_pieces_from(digests, letters, start)) for start in range(n)]
            alpha, beta = np.zeros((n + 1, len(letters), n_lang)), np.zeros((n + 1, len(letters), n_lang))
            alpha[0], beta[n] = 1, 1
            for start in range(n):
                for end, piece in edges[start]:
                    alpha[end] += alpha[start] * probability[piece]
            for start in range(n - 1, -1, -1):
                for end, piece in edges[start]:
                    beta[start] += probability[piece] * beta[end]
            share = weight[places] / np.maximum(alpha[n], 1e-300)
            for start in range(n):
                for end, piece in edges[start]:
                    use = alpha[start] * probability[piece] * beta[end] * share
                    for k in range(n_lang):
                        expected[:, k] += np.bincount(piece, use[:, k], v + 1)
        expected[v] = 0
        probability = (expected + SMOOTHING) / (expected.sum(0) + SMOOTHING * v)
        probability[v] = 0
    return PieceModel(languages, digests, probability)


def sample_counts(labelled: DataFrame, *, id_col: str, text_col: str, lang_col: str, sample_docs: int = SAMPLE_DOCS) -> dict[tuple[str, str], int]:
    """Words per language in about ``sample_docs`` whole documents of each; counted in tasks."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    chance = F.conv(F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    # One row per language.
    wanted = F.lit(False)
    for row in rows.groupBy("lang").count().collect():
        wanted = wanted | ((F.col("lang") == row["lang"]) & (chance < F.lit(int(2**32 * min(1.0, sample_docs / row["count"])))))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter[tuple[str, str]] = Counter()
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                seen.update((lang, w) for w in words_of(text))
            yield pd.DataFrame({"lang": [k[0] for k in seen], "word": [k[1] for k in seen], "n": list(seen.values())}).astype({"n": "int64"})

    counted = rows.where(wanted).select("lang", "text").mapInPandas(count, "lang string, word string, n long")
    return {(r["lang"], r["word"]): r["n"] for r in counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).collect()}


def fit_on(labelled: DataFrame, *, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> PieceModel:
    return fit(sample_counts(labelled, id_col=id_col, text_col=text_col, lang_col=lang_col), read_vocabulary(vocabulary))


class _Scorer:
    """Predictions of one task; words already summed are kept, up to a bound."""

    def __init__(self, model: PieceModel) -> None:
        self.model, self.known = model, {}
        self.log_p = np.zeros((0, len(model.languages)))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.model.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        words = [words_of(t) if t else [] for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known, self.log_p = {}, self.log_p[:0]
        new = [w for w in set().union(*words) if w not in self.known]
        self.log_p = np.concatenate([self.log_p, word_log_probability(self.model, new)])
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        return [self._best(w) for w in words]

    def _best(self, words: list[str]) -> tuple[str, float]:
        if not has_letter(words):
            return UNKNOWN, 0.0
        known = self.known
        total = self.log_p[[known[w] for w in words]].sum(0)
        posterior = np.exp(total - total.max())
        best = int(total.argmax())
        return self.model.languages[best], float(posterior[best] / posterior.sum())


def identify(docs: DataFrame, model: PieceModel, *, text_col: str = "text") -> DataFrame:
    """``docs`` as ``row`` (a struct of all its columns), with ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(shared.value)
        for texts in batches:
            found, listed = [], [None if t is None or t != t else t for t in texts]
            for lo in range(0, len(listed), GROUP_DOCS):
                found += scorer(listed[lo:lo + GROUP_DOCS])
            yield pd.DataFrame({"lang_pred": [x[0] for x in found], "score": [x[1] for x in found]}).astype({"score": "float64"})

    predict = F.pandas_udf(run, "lang_pred string, score double")
    found = docs.select(F.struct("*").alias("row"), predict(F.col(text_col)).alias("found"))
    return found.select("row", "found.lang_pred", "found.score")
