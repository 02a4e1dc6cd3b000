import math
import random

import pytest
from pyspark.sql import functions as F

from protomatch.llm import hard_negatives
from protomatch.llm.hard_negatives import mine_hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score long, block string"


def brute(rows, every=3, positives=5, negatives=5, least=80, scale=256):
    usable = [
        (k, i, [math.floor(scale * x) for x in v], label) for k, (i, v, label, *_) in enumerate(rows)
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for k, i, v, label in usable:
        if i % every:
            continue
        ranked = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), j, m) for q, j, w, m in usable if q != k and len(w) == len(v)), key=lambda x: x[:2])
        for ps, p, _ in [x for x in ranked if x[2] == label][:positives]:
            taken = [(-s, j) for s, j, m in ranked if m != label and least * -ps <= 100 * -s <= 100 * -ps][:negatives]
            out += [(i, p, r, j, -ps, s) for r, (s, j) in enumerate(taken, 1)]
    return sorted(out)


def vectors(seed, n=150, dim=6, labels=4, spread=1.0):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        centre = k % labels
        # Few distinct values, so that scores tie.
        rows.append((k - 20, [round(rng.gauss(0.4 if d % labels == centre else 0.3, 0.4), 1) * spread for d in range(dim)], centre, 1, "x"))
    return rows


def mined(spark, rows, **options):
    frame = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in mine_hard_negatives(frame, F.col("vec_id") % 3 == 0, **options).collect())


@pytest.mark.parametrize("spread", [1.0, 3e6, 4e6])
def test_equals_brute_force(spark, spread):
    rows = vectors(1, spread=spread)
    want = brute(rows)
    assert want and mined(spark, rows) == want


def test_small_blocks_without_broadcast_and_other_parameters(spark, monkeypatch):
    for name, value in {"CHUNK_ROWS": 16, "BLOCK_ANCHORS": 7, "STRIP": 3, "BROADCAST_BYTES": 0, "PART_ROWS": 40}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors(2)
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows, positives=2, negatives=9, least=50) == brute(rows, positives=2, negatives=9, least=50)


def test_one_label_for_a_third_of_the_rows_and_ties(spark):
    rows = [(i, v, 0 if i % 3 == 0 else label, 1, "x") for i, v, label, *_ in vectors(3)]
    rows += [(1000 + k, [0.5] * 6, k % 2, 1, "x") for k in range(60)]
    assert mined(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = vectors(4, n=60)
    rows += [
        (None, [0.5] * 6, 1, None, None), (3, None, 1, None, None), (6, [0.5] * 6, None, None, None), (9, [0.5, None] * 3, 1, None, None),
        (12, [math.nan] * 6, 1, None, None), (15, [math.inf] + [0.0] * 5, 1, None, None), (18, [], 1, None, None), (300, [], 1, None, None), (301, [], 2, None, None),
        (303, [0.5] * 4, 1, None, None), (304, [0.4] * 4, 1, None, None), (305, [0.45] * 4, 2, None, None), (306, [-0.5] * 6, 9, 1, None), rows[0], rows[5], rows[5], rows[2], rows[2],
    ]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(1, [0.5], 1, None, None)]) == []


def test_scores_no_long_can_hold_are_an_error(spark):
    rows = [(k, [1e16] * 6, k % 2, 1, "x") for k in range(6)]
    with pytest.raises(Exception, match="too large"):
        mined(spark, rows)
