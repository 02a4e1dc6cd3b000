import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from protomatch.llm import suffix
from protomatch.llm.suffix import open_places, remove_repeats
from tests.llm.helpers import documents, odd_rows, prose


def brute(rows, length=50):
    """Covered bytes of every row; strings of documents with a smaller id count."""
    first = {}
    order = sorted(((2**63 - 1 if i is None else i, (t or "").encode()) for i, t in rows), key=lambda r: r[0])
    for place, data in order:
        for k in range(len(data) - length + 1):
            first.setdefault(data[k:k + length], place)
    out = []
    for place, data in order:
        covered = np.zeros(len(data), bool)
        for k in range(len(data) - length + 1):
            if first[data[k:k + length]] < place:
                covered[k:k + length] = True
        edges = np.flatnonzero(np.diff(np.r_[0, covered.astype(int), 0]))
        out.append((place, edges.tolist(), bytes(np.frombuffer(data, np.uint8)[~covered])))
    return sorted(out)


def found(frame):
    rows = [(2**63 - 1 if r["id"] is None else r["id"], [x for s in r["spans"] for x in s], bytes(r["kept"])) for r in frame.collect()]
    return sorted(rows)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(min_size=28, max_size=60).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=8, unique=True))
def test_groups_of_equal_strings_are_neighbours(segments):
    order, shares = open_places(segments, 28)
    groups = np.cumsum(~shares)
    group_of = dict(zip(order.tolist(), groups.tolist(), strict=True))
    begin, seen = 0, {}
    for s in segments:
        for k in range(len(s) - 27):
            seen.setdefault(s[k:k + 28], set()).add(group_of[begin + k])
        begin += len(s) + 1
    assert all(len(g) == 1 for g in seen.values())
    assert len({min(g) for g in seen.values()}) == len(seen)


def passages(seed):
    rng = random.Random(seed)
    shared = [prose(rng, 30) for _ in range(4)]
    rows = []
    for k in range(60):
        parts = [prose(rng, rng.randint(1, 40))]
        for _ in range(rng.randint(0, 3)):
            piece = rng.choice(shared)
            cut = rng.randrange(len(piece))
            parts += [piece[cut:] if rng.random() < 0.5 else piece, prose(rng, rng.randint(0, 20))]
        rows.append((rng.choice([k, k, None]), " ".join(parts)))
    return [*rows, (100, "a" * 400), (101, "a" * 300), (102, "ab" * 200), (103, rows[0][1]), (103, rows[0][1]), (99, "é" * 60), (98, "xé" + "é" * 40)]


def test_equals_brute_force(spark):
    rows = passages(1)
    frame = documents(spark, [(i, t, None, None, None) for i, t in rows])
    assert found(remove_repeats(frame)) == brute(rows)


def test_hot_anchors_give_the_same(spark, monkeypatch):
    rows = passages(2)
    monkeypatch.setattr(suffix, "HOT", 0)
    monkeypatch.setattr(suffix, "CHUNK_BYTES", 512)
    monkeypatch.setattr(suffix, "CHUNK_MOST", 512)
    monkeypatch.setattr(suffix, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(suffix, "PART_BYTES", 100)
    frame = documents(spark, [(i, t, None, None, None) for i, t in rows])
    assert found(remove_repeats(frame)) == brute(rows)


def test_odd_rows_clashing_columns_and_empty_tables(spark):
    rows = odd_rows()
    assert found(remove_repeats(documents(spark, rows, clashes=True))) == brute([(r[0], r[1]) for r in rows])
    assert remove_repeats(documents(spark, [])).count() == 0
