import random

import numpy as np
import pytest

from protomatch.llm import decontam
from protomatch.llm.decontam import NEED, build_index, find_leaks, judge, retrieve, words_of
from tests.llm.helpers import documents, odd_rows, prose


def items(rng, n=70):
    return [(k, ". ".join(prose(rng, rng.randint(3, 20)).capitalize() for _ in range(rng.randint(1, 4))) + ".") for k in range(n)]


def exhaustive(index, texts):
    """Score of every item on every passage, by plain sums."""
    want = set()
    for held in index.classes:
        word_of = {int(held.rank_of[t]): w for w, t in index.term_ids.items() if held.rank_of[t] >= 0}
        impacts = {}
        for key, item, x in zip(held.posting_key.tolist(), held.posting_item.tolist(), held.posting_impact.tolist(), strict=True):
            impacts.setdefault(int(held.items[item]), {})[word_of[key % len(held.maxima)]] = x
        for k, text in enumerate(texts):
            words = words_of(text)
            for lo in range(0, len(words), held.step):
                passage = set(words[lo:lo + 2 * held.step])
                for item, of_item in impacts.items():
                    score = sum(x for w, x in of_item.items() if w in passage)
                    if score >= NEED:
                        want.add((item, k, lo, score))
    return want


@pytest.mark.parametrize("n", [3, 70, 300])
def test_pruned_retrieval_finds_all_above_the_threshold(n):
    rng = random.Random(1)
    tests = [*items(rng, n), (n, "x"), (n + 1, "one two"), (n + 2, "")]
    index = build_index(tests)
    texts = [prose(rng, 300) + " " + " ".join(t[:len(t) * 2 // 3] for _, t in tests[:20]), "", "x", tests[0][1], prose(rng, 40), " ".join(t for _, t in tests)]
    words = [words_of(t) for t in texts]
    ids = np.array([index.term_ids.get(w, len(index.term_ids)) for own in words for w in own])
    lengths = np.array([len(w) for w in words])
    got = {(item, k, lo, score) for held in index.classes for item, k, lo, _, score in retrieve(held, ids, lengths)}
    assert got == exhaustive(index, texts) and got


def test_postings_of_most_blocks_are_not_touched():
    """Passages that share words with many items but hold none."""
    rng = random.Random(2)

    def speech(n):
        return " ".join(f"c{rng.randrange(30)}" if rng.random() < 0.4 else f"r{rng.randrange(2000)}" for _ in range(n))

    index = build_index([(k, speech(rng.randint(20, 40))) for k in range(800)])
    words = words_of(speech(20_000))
    ids = np.array([index.term_ids.get(w, len(index.term_ids)) for w in words])
    opened = everywhere = 0
    for held in index.classes:
        passage, known, _ = decontam._passage_words(held, ids, np.array([len(words)]))
        opened += len(decontam._open_blocks(held, passage, known)[0])
        everywhere += len(np.unique(passage)) * (int(held.block.max()) + 1)
    assert opened < everywhere / 15


def test_finds_planted_items_and_nothing_else(spark):
    rng = random.Random(3)
    tests = items(rng)
    rows, truth = [], {}
    for k in range(120):
        planted = rng.sample(range(len(tests)), rng.choice([0, 0, 1, 2]))
        parts = [prose(rng, rng.randint(0, 200))]
        for p in planted:
            parts += [tests[p][1], prose(rng, rng.randint(0, 100))]
        rows.append((k, " ".join(parts), None, None, None))
        truth[k] = {p for p in range(len(tests)) if f" {' '.join(words_of(tests[p][1]))} " in f" {' '.join(words_of(rows[-1][1]))} "}
    bench = spark.createDataFrame(tests, "item_id long, text string")
    scores = []
    for limit in (2048, 30):
        found = find_leaks(documents(spark, rows), bench, index_items=limit).collect()
        assert {r["row"]["doc_id"]: set(r["items"]) for r in found} == truth
        scores.append(sorted((r["row"]["doc_id"], r["score"], r["coverage"]) for r in found))
    # Frequencies and the mean length are those of all items, however many indexes there are.
    assert scores[0] == scores[1]


def test_thousands_of_items_in_several_passes(spark):
    rng = random.Random(4)
    tests = [(k, prose(rng, rng.randint(6, 40))) for k in range(5000)]
    bench = spark.createDataFrame(tests, "item_id long, text string")
    rows = [(k, f"{prose(rng, 50)} {tests[k * 50][1]} {prose(rng, 30)}", None, None, None) for k in range(100)]
    got = {r["row"]["doc_id"]: r["items"] for r in find_leaks(documents(spark, rows), bench).collect()}
    assert all(k * 50 in found for k, found in got.items())


def test_items_without_an_id_count(spark):
    bench = spark.createDataFrame([(None, "a test item that has no id at all"), (1, "another item of the same test")], "item_id long, text string")
    rows = [(1, "before a test item that has no id at all after", None, None, None), (2, "nothing of the kind", None, None, None)]
    for limit in (10, 1):
        got = {r["row"]["doc_id"]: (r["items"], r["score"]) for r in find_leaks(documents(spark, rows), bench, index_items=limit).collect()}
        assert got == {1: ([None], 1.0), 2: ([], 0.0)}


def test_edited_question_or_missing_answer(spark):
    rng = random.Random(9)
    question, answer = prose(rng, 30), prose(rng, 12)
    index = build_index([(1, f"{question}. {answer}.")])
    assert judge(index, [f"before {question}. {answer} after"])[0][0] == [1]
    changed = question.split()
    changed[15] = "other"
    texts = [f"{' '.join(changed)}. {answer}", question, " ".join(sorted(f"{question} {answer}".split()))]
    assert [found for found, _, _ in judge(index, texts)] == [[1], [], []]


def test_odd_rows_clashing_columns_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "same text twice over here"), (2, None), (3, ""), (None, "repeated row"), (5, "x")], "item_id long, text string")
    got = find_leaks(documents(spark, odd_rows(), clashes=True), bench).collect()
    assert len(got) == len(odd_rows())
    assert {r["row"]["doc_id"] for r in got if 1 in r["items"]} == {7, 8}
    assert {r["row"]["doc_id"] for r in got if 5 in r["items"]} == {11}
    assert {r["row"]["doc_id"] for r in got if None in r["items"]} == {10}
    assert all(not r["items"] for r in find_leaks(documents(spark, odd_rows()), bench.limit(0)).collect())
    assert find_leaks(documents(spark, []), bench).count() == 0
    assert decontam.runs_of([]) == set()
