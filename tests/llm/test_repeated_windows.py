import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from protomatch.llm import repeated_windows
from protomatch.llm.repeated_windows import BASES, remove_repeated_windows, window_hashes, words_of
from tests.llm.helpers import documents, odd_rows, prose


def brute(rows, length=50):
    held = sorted(((2**63 - 1 if i is None else i, i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows), key=lambda x: x[0])
    first = {}
    for place, _, words in held:
        for k in range(len(words) - length + 1):
            first.setdefault(tuple(words[k:k + length]), place)
    out = []
    for place, i, words in held:
        covered = np.zeros(len(words) + 2, int)
        for k in range(len(words) - length + 1):
            if first[tuple(words[k:k + length])] < place:
                covered[1 + k:1 + k + length] = 1
        spans = np.flatnonzero(np.diff(covered)).reshape(-1, 2).tolist()
        out.append((i, len(words), spans, " ".join(w for w, c in zip(words, covered[1:], strict=False) if not c)))
    return sorted(out, key=repr)


def found(frame):
    return sorted(((r["id"], r["n_words"], [list(s) for s in r["spans"]], r["kept"]) for r in frame.collect()), key=repr)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=4, max_size=60))
def test_equal_windows_have_equal_hashes_and_others_do_not(words):
    digests = np.array([11400714819323198485, 3, 2**63 + 12345], np.uint64)
    starts = np.arange(len(words) - 3)
    for base in BASES:
        hashes = window_hashes(np.array(words, np.int32), digests, starts, 4, base).tolist()
        by_window = {}
        for k in starts.tolist():
            by_window.setdefault(tuple(words[k:k + 4]), set()).add(hashes[k])
        assert all(len(h) == 1 for h in by_window.values())
        assert len({min(h) for h in by_window.values()}) == len(by_window)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_words_are_those_of_the_expression(text):
    assert [w.decode() for w in words_of(text.encode())] == re.findall(r"[^\x20\x09-\x0D]+", text)


def passages(seed, n=60):
    rng = random.Random(seed)
    shared = [prose(rng, 80) for _ in range(4)] + [prose(rng, 49), "word " * 120]
    rows = []
    for k in range(n):
        parts = [prose(rng, rng.randint(1, 40))]
        for _ in range(rng.randint(0, 3)):
            piece = rng.choice(shared).split()
            cut = rng.randrange(len(piece) // 2)
            parts += [" ".join(piece[cut:] if rng.random() < 0.5 else piece), prose(rng, rng.randint(0, 20))]
        rows.append((rng.choice([k, k, k, None]), rng.choice([" ", "\n", "\t \r"]).join(parts)))
    return [*rows, (200, rows[0][1]), (201, rows[0][1]), (201, rows[0][1]), (202, rows[0][1].upper()), (203, "x " * 200), (204, "x " * 49)]


def test_equals_brute_force(spark):
    rows = passages(1)
    want = brute(rows)
    assert sum(bool(r[2]) for r in want) > 10
    assert found(remove_repeated_windows(documents(spark, [(i, t, None, None, None) for i, t in rows]))) == want


@pytest.mark.parametrize("length", [1, 7, 50])
def test_many_chunks_and_buckets_and_other_lengths(spark, monkeypatch, length):
    for name, value in {"CHUNK_BYTES": 900, "CHUNK_MOST": 900, "BUCKET_BYTES": 2500, "BUCKET_MOST": 2500}.items():
        monkeypatch.setattr(repeated_windows, name, value)
    rows = passages(2)
    assert found(remove_repeated_windows(documents(spark, [(i, t, None, None, None) for i, t in rows]), length=length)) == brute(rows, length)


def test_a_third_of_all_documents_are_one_text(spark, monkeypatch):
    monkeypatch.setattr(repeated_windows, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(repeated_windows, "CHUNK_MOST", 4000)
    rng = random.Random(3)
    copied = prose(rng, 90)
    rows = [(k, copied if k % 3 == 1 else prose(rng, 60)) for k in range(120)]
    want = brute(rows)
    assert found(remove_repeated_windows(documents(spark, [(i, t, None, None, None) for i, t in rows]))) == want
    assert sum(r[3] == "" for r in want) == 39


def test_odd_rows_clashing_columns_and_empty_tables(spark):
    rows = odd_rows()
    assert found(remove_repeated_windows(documents(spark, rows, clashes=True))) == brute([(r[0], r[1]) for r in rows])
    assert remove_repeated_windows(documents(spark, [])).count() == 0
    assert found(remove_repeated_windows(documents(spark, [(None, None, None, None, None)]))) == [(None, 0, [], "")]
