import random

import numpy as np
import pytest

from protomatch.llm import chosen_path
from protomatch.llm.chosen_path import meeting_chance, runs_needed, runs_of, similar_documents
from tests.llm.helpers import documents, odd_rows, prose


def brute(rows):
    """Classes and numbers of links from all pairs."""
    sets = [set(runs_of(t or "").tolist()) for _, t in rows]
    n, links = len(rows), [0] * len(rows)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            equal = (rows[a][1] or "") == (rows[b][1] or "")
            near = sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
            if equal or near:
                links[a], links[b] = links[a] + 1, links[b] + 1
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((str(i), str(least.get(find(k))), links[k]) for k, (i, _) in enumerate(rows))


def found(frame):
    return sorted((str(r["id"]), str(r["class_id"]), r["n_links"]) for r in frame.collect())


def copies(seed, n_groups=25):
    rng, rows = random.Random(seed), []
    for g in range(n_groups):
        words = prose(rng, rng.randint(4, 150)).split()
        for _ in range(rng.choice([1, 1, 2, 3, 12 if g else 90])):
            changed = list(words)
            for _ in range(rng.randint(0, 1 + len(words) // 40)):
                changed[rng.randrange(len(changed))] = prose(rng, 1)
            rows.append((len(rows), " ".join(changed)))
    passage = prose(rng, 60)
    rows += [(len(rows) + k, passage + " " + prose(rng, 70)) for k in range(60)]
    return rows


@pytest.mark.parametrize("leaf, block", [(64, 256), (4, 5)])
def test_equals_all_pairs(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(chosen_path, "LEAF", leaf)
    monkeypatch.setattr(chosen_path, "BLOCK", block)
    rows = copies(leaf)
    frame = documents(spark, [(i, t, None, None, None) for i, t in rows]).repartition(5)
    assert found(similar_documents(frame)) == brute(rows)


def test_odd_rows_clashing_columns_and_empty_tables(spark):
    rows = odd_rows()
    assert found(similar_documents(documents(spark, rows, clashes=True))) == brute([(r[0], r[1]) for r in rows])
    assert similar_documents(documents(spark, [])).count() == 0


def test_recall_of_the_runs():
    assert (1 - meeting_chance(0.8, chosen_path.MAX_DEPTH)) ** runs_needed() <= 1 - chosen_path.RECALL
    rng = np.random.default_rng(0)
    # Two sets that agree in four of five coordinates meet as often as computed.
    a = rng.integers(0, 2**32, (4000, chosen_path.COORDINATES), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < 0.8, a, a + np.uint32(1))
    parents = rng.integers(0, 2**63, 4000).astype(np.uint64)
    (row_a, path_a), (row_b, path_b) = chosen_path._children(a, parents), chosen_path._children(b, parents)
    met = set(zip(row_a.tolist(), path_a.tolist(), strict=True)) & set(zip(row_b.tolist(), path_b.tolist(), strict=True))
    assert abs(len({r for r, _ in met}) / 4000 - meeting_chance(0.8, 1)) < 0.03
