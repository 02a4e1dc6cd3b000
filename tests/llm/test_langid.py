import itertools
import math
import random

import pytest

from protomatch.llm.langid import LONGEST, UNKNOWN, fit, fit_on, identify, read_vocabulary, word_log_probability, words_of
from tests.llm.helpers import documents, odd_rows, prose


def small_model():
    pieces = [bytes([b]) for b in range(256)] + [b" a", b"ab", b"bc", b"abc", b" ab", "é".encode(), b"the"]
    return fit({("x", "abcab"): 3, ("x", "the"): 2, ("y", "cbé"): 4, ("y", "ab"): 1}, pieces), pieces


def test_sums_over_all_segmentations(spark):
    model, pieces = small_model()
    by_piece = {}
    from protomatch.llm.langid import _piece_digests
    for p, d in zip(pieces, _piece_digests(pieces), strict=True):
        by_piece[p] = model.probability[list(model.digests).index(d)]
    for word in ("abcab", "the", "cbé", "a", "thethe"):
        data = b" " + word.encode()
        total = [0.0, 0.0]
        for cuts in itertools.product([0, 1], repeat=len(data) - 1):
            ends = [k + 1 for k, c in enumerate(cuts) if c] + [len(data)]
            parts = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            if all(p in by_piece for p in parts):
                for lang in range(2):
                    total[lang] += math.prod(by_piece[p][lang] for p in parts)
        assert word_log_probability(model, [word])[0] == pytest.approx([math.log(t) for t in total])
    long = "ab" * 3000
    assert word_log_probability(model, [long])[0][0] > -1e5


def test_probabilities_sum_to_one_and_vocabulary_is_bounded():
    model, _ = small_model()
    assert model.probability.sum(0) == pytest.approx([1, 1])
    pieces = read_vocabulary()
    assert max(map(len, pieces)) <= LONGEST and {bytes([b]) for b in range(256)} <= set(pieces)


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(4)
    rows = [(k, prose(rng, 40, "en" if k % 2 else "fr"), "en" if k % 2 else "fr", None, None) for k in range(300)]
    model = fit_on(documents(spark, rows[:200]))
    got = {r["row"]["doc_id"]: r["lang_pred"] for r in identify(documents(spark, rows[200:]), model).collect()}
    assert sum(got[r[0]] == r[2] for r in rows[200:]) >= 98
    odd = identify(documents(spark, odd_rows(), clashes=True), model).collect()
    assert len(odd) == len(odd_rows())
    for r in odd:
        text = r["row"]["text"]
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == UNKNOWN) == (not any(c.isalpha() for c in text or ""))
    assert identify(documents(spark, []), model).count() == 0


def test_nothing_learned_means_unknown(spark):
    model = fit_on(documents(spark, [(1, "abc", None, None, None), (2, None, "en", None, None)]))
    assert identify(documents(spark, [(1, "abc", None, None, None)]), model).first()["lang_pred"] == UNKNOWN


def test_words_are_runs_of_letters():
    assert words_of("Ab1c é_F ²x") == ["ab", "c", "é", "f", "²x"]
