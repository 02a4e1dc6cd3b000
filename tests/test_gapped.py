"""Search with gaps against direct computation."""

from __future__ import annotations

import random
import re
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import rows_of
from protomatch.operators.gapped import nearest_edits
from protomatch.operators.search import SearchSettings, search

COLUMNS = ["spacer_id", "target_id", "strand", "position", "mismatches", "gaps", "alignment_length"]
TURN = str.maketrans("ACGT", "TGCA")


def side(query, target, gaps):
    """Fewest mismatches by (gap letters, shift), for all of ``query`` and a beginning of ``target``."""
    @cache
    def fewest(i, t, k):
        if k < 0:
            return {}
        if i == len(query):
            found = {(k, t - i): 0}
        else:
            found = {}
            if t < len(target):
                unlike = query[i] != target[t] or query[i] not in "ACGT"
                for state, mm in fewest(i + 1, t + 1, k).items():
                    found[state] = min(found.get(state, 999), mm + unlike)
            for state, mm in fewest(i + 1, t, k - 1).items():
                found[state] = min(found.get(state, 999), mm)
        if t < len(target):
            for state, mm in fewest(i, t + 1, k - 1).items():
                found[state] = min(found.get(state, 999), mm)
        return found

    best = {}
    # ``k`` counts the gap letters left over.
    for (k, d), mm in fewest(0, 0, gaps).items():
        used = gaps - k
        if used not in best or (mm, abs(d), -d) < (best[used][0], abs(best[used][1]), -best[used][1]):
            best[used] = (mm, d)
    return best


def brute_force(queries, targets, gaps, seed=7, identity=80):
    placed = {}
    for qid, seq in queries:
        for strand, q in (("+", seq.upper()), ("-", seq.upper().translate(TURN)[::-1])):
            n = len(q)
            for tid, target in targets:
                t = "".join(c if c in "ACGT" else "n" for c in target.upper())
                for i in range(n - seed + 1):
                    word = q[i:i + seed]
                    if set(word) - set("ACGT"):
                        continue
                    for p in (m.start() for m in re.finditer(f"(?={word})", t)):
                        left, right = side(q[:i][::-1], t[:p][::-1][:i + gaps], gaps), side(q[i + seed:], t[p + seed:p + n - i + gaps], gaps)
                        options = [
                            (2 * (a + b) + 3 * (j + k), j + k, j, a + b, da, db)
                            for j, (a, da) in left.items() for k, (b, db) in right.items()
                            if j + k <= gaps and 100 * (a + b + j + k) <= (100 - identity) * n
                        ]
                        if options:
                            penalty, k, _, mm, da, db = min(options)
                            start, span = p - i - da + 1, n + da + db
                            own = (penalty, k, span, mm)
                            place = placed.setdefault((qid, tid, strand), {})
                            place[start] = min(place.get(start, own), own)
    out = []
    for (qid, tid, strand), starts in placed.items():
        for start, (penalty, k, span, mm) in starts.items():
            better = any((starts[s][0], starts[s][1], s) < (penalty, k, start) for s in starts if s != start and abs(s - start) <= gaps)
            if k == 0 or not better:
                out.append((qid, tid, strand, start, float(mm), float(k), float(len_of(k, span, qid, queries))))
    return sorted(out)


def len_of(k, span, qid, queries):
    """Columns of the alignment: query letters and those of the target that stand alone."""
    n = len(dict(queries)[qid])
    return n + (k + span - n) // 2


def edited(rng, text, changes):
    letters = list(text)
    for _ in range(changes):
        at, kind = rng.randrange(1, len(letters) - 1), rng.choice("sid")
        if kind == "s":
            letters[at] = rng.choice("ACGT")
        elif kind == "i":
            letters.insert(at, rng.choice("ACGT"))
        else:
            del letters[at]
    return "".join(letters)


def case(seed, lengths, target_length=300):
    rng = random.Random(seed)
    targets = [(f"t{k}", "".join(rng.choice("ACGT") for _ in range(target_length))) for k in range(3)]
    targets += [("low", "A" * 60 + "N" * 3 + "ACGTR" * 8), ("short", "ACG"), ("end", targets[0][1][:26])]
    queries = []
    for k, n in enumerate(lengths):
        _, t = rng.choice(targets[:3])
        at = rng.randrange(len(t) - n)
        q = edited(rng, t[at:at + n], rng.randrange(0, max(2, n // 8)))
        queries.append((f"q{k}", q.translate(TURN)[::-1] if k % 3 == 2 else q))
    return [*queries, ("tiny", "ACGTA"), ("poly", "a" * 14), ("over", targets[0][1][:30]), ("unknown", "ACGTN" + targets[1][1][40:60])], targets


def frames(spark, queries, targets):
    return spark.createDataFrame(queries, "spacer_id string, seq string"), spark.createDataFrame(targets, "target_id string, seq string")


@pytest.mark.parametrize("gaps, options", [(1, {}), (2, {"tile": 16}), (5, {}), (3, {"identity": 90}), (5, {"broadcast_bytes": 0, "seed": 6})])
def test_equals_brute_force(spark, gaps, options):
    queries, targets = case(gaps, [20, 24, 30, 32, 33, 47, 60, 62])
    found = search(*frames(spark, queries, targets), SearchSettings(gaps=gaps, **options))
    want = brute_force(queries, targets, gaps, options.get("seed", 7), options.get("identity", 80))
    assert any(r[5] > 0 for r in want)
    assert rows_of(found, *COLUMNS) == sorted(want, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_queries_of_two_hundred_letters(spark):
    queries, targets = case(11, [100, 150, 200, 200], target_length=600)
    found = search(*frames(spark, queries, targets[:3]), SearchSettings(gaps=5, seed=11))
    want = brute_force(queries, targets[:3], 5, seed=11)
    assert any(r[5] > 0 for r in want)
    assert rows_of(found, *COLUMNS) == sorted(want, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_details_spell_the_alignment(spark):
    queries, targets = case(5, [30, 31, 40, 50, 60, 61, 62, 63])
    texts, sequences = dict(targets), dict(queries)
    rows = search(*frames(spark, queries, targets), SearchSettings(gaps=5)).collect()
    assert any(r["gaps"] for r in rows)
    for r in rows:
        q = sequences[r["spacer_id"]].upper()
        q = q if r["strand"] == "+" else q.translate(TURN)[::-1]
        t = "".join(c if c in "ACGT" else "N" for c in texts[r["target_id"]].upper())
        i, p, mismatches, gaps, letters = 0, r["position"] - 1, 0, 0, ""
        for n, kind in ((int(n), kind) for n, kind in re.findall(r"(\d+)([MID])", r["details"])):
            for _ in range(n):
                if kind != "D":
                    i += 1
                if kind != "I":
                    p += 1
                letters += "-" if kind == "I" else t[p - 1]
                mismatches += kind == "M" and (q[i - 1] != t[p - 1] or t[p - 1] == "N")
                gaps += kind != "M"
        assert (i, mismatches, gaps, letters, len(letters)) == (len(q), r["mismatches"], r["gaps"], r["alignment_seq"], r["alignment_length"])


def test_without_gaps_nothing_changes(spark):
    queries, targets = case(6, [30, 32, 40])
    q, t = frames(spark, queries, targets)
    ungapped = rows_of(search(q, t), *COLUMNS)
    with_gaps = rows_of(search(q, t, SearchSettings(gaps=5)), *COLUMNS)
    starts = {r[:4] for r in with_gaps}
    assert all(r[:4] in starts for r in ungapped)
    with pytest.raises(ValueError):
        SearchSettings(gaps=10)


@settings(max_examples=200, deadline=None)
@given(st.text("ACGT", max_size=12), st.text("ACGTN", max_size=17))
def test_bit_parallel_distance_is_the_edit_distance(query, target):
    """Row by row: least distance of the query to any beginning of the target."""
    row = list(range(len(target) + 1))
    for i, a in enumerate(query):
        above, row = row, [i + 1]
        for j, b in enumerate(target):
            row.append(min(above[j] + (a != b), above[j + 1] + 1, row[j] + 1))
    digits = lambda text, width: np.array([["ACGTN".index(c) for c in text] + [7] * (width - len(text))], np.uint8)
    found = nearest_edits(digits(query, 12)[:, :12], np.array([len(query)]), digits(target, len(target)))
    assert found.tolist() == [min(row)]
