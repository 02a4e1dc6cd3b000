"""Candidates of the seed search as arrays, against direct computation."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from helpers import executed_plan, rows_of
from protomatch.operators.search import SearchSettings, search
from protomatch.operators.seeded import QueryTable, Side, Tiles, rolled
from test_search import COLUMNS, brute_force, random_case


def nearest(query, target):
    """Least edit distance of the query to any beginning of the target."""
    row = list(range(len(target) + 1))
    for i, a in enumerate(query):
        above, row = row, [i + 1]
        for j, b in enumerate(target):
            row.append(min(above[j] + (a != b or a not in "0123"), above[j + 1] + 1, row[j] + 1))
    return min(row)


def test_distances_beside_the_seed_are_edit_distances():
    rng = random.Random(4)
    letters = lambda n, more: "".join(rng.choice("0123" * 6 + more) for _ in range(n))
    seed, gaps = 7, 5
    for _ in range(60):
        query, target = letters(rng.randrange(seed, 64), "5"), letters(200, "4")
        at = rng.randrange(90, 110)
        before = rng.randrange(len(query) - seed + 1)
        query = query[:before] + "0123012" + query[before + seed:]
        target = target[:at] + "0123012" + target[at + seed:]
        table = QueryTable.of([query], seed)
        word = np.flatnonzero(table.at - table.starts[0] == before)
        codes = np.frombuffer(target.encode(), np.uint8) - 48
        tiles = Tiles(pa.RecordBatch.from_pydict({"tile": [0]}), codes, rolled(codes), np.array([200]), 0, 200)
        for outwards, q, t in ((-1, query[:before][::-1], target[:at][::-1]), (1, query[before + seed:], target[at + seed:])):
            side = Side.of(table, outwards)
            near = side.near_edits(word, tiles, np.array([at]), seed, 12 + gaps)
            assert near.tolist() == [nearest(q[:12], t[:12 + gaps])]
            assert side.far_edits(word, tiles, np.array([at]), seed, gaps).tolist() == [nearest(q, t[:len(q) + gaps])]


@pytest.mark.parametrize("seed", [1, 11, 12, 21])
def test_seeds_of_any_length(spark, seed):
    queries, targets = random_case(random.Random(8), [22, 32, 43, 64])
    queries, targets = [q for q in queries if len(q[1]) >= seed], targets[:2] if seed == 1 else targets
    q = spark.createDataFrame(queries, "spacer_id string, seq string")
    t = spark.createDataFrame(targets, "target_id string, seq string")
    want = sorted(brute_force(queries, targets, seed, 80), key=lambda r: tuple((v is None, str(v)) for v in r))
    assert want and rows_of(search(q, t, SearchSettings(seed=seed)), *COLUMNS) == want


@pytest.mark.parametrize("gaps", [0, 3])
def test_places_and_candidates_do_not_become_rows(spark, gaps):
    queries, targets = random_case(random.Random(3), [30, 30])
    q = spark.createDataFrame(queries, "spacer_id string, seq string")
    t = spark.createDataFrame(targets, "target_id string, seq string")
    plan = executed_plan(search(q, t, SearchSettings(gaps=gaps)))
    assert "seed_word" not in plan and "MapInArrow" in plan


def test_queries_of_one_id_and_targets_of_one_id_stay_apart(spark):
    q = spark.createDataFrame([("x", "ACGTACGTAC"), ("x", "ACGTACGTAA"), (None, "ACGTACGTAC"), ("x", None)], "spacer_id string, seq string")
    t = spark.createDataFrame([("a", "ACGTACGTAC"), ("a", "TTACGTACGTAA"), (None, "acgtacgtac"), ("b", None), ("c", "")], "target_id string, seq string")
    for gaps in (0, 2):
        one = SearchSettings(gaps=gaps, both_strands=False)
        columns = ["spacer_id", "target_id", "position", "details", "mismatches", "alignment_seq"]
        shuffled = search(q, t, SearchSettings(gaps=gaps, both_strands=False, broadcast_bytes=0))
        assert rows_of(search(q, t, one), *columns) == rows_of(shuffled, *columns) != []
