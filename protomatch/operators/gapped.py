"""Alignments with gaps through a shared seed word.

A placement aligns the whole query with the target and keeps the seed word unbroken. On either
side of it the query's letters are matched, mismatched or skipped (insertion), and target letters may be
skipped (deletion). Skipped letters are gap letters; both sides together have at most ``gaps`` of
them. Of all such alignments through a seed word that reach the asked identity,
100 * (mismatches + gap letters) <= (100 - identity) * query length, the one with the least penalty
2 * mismatches + 3 * gap letters is taken, then the fewest gap letters, then the fewest on the left; a side with given gap letters takes the
fewest mismatches, then the least and then the greater shift between query and target.

Candidates come as Arrow batches and are handled as arrays. First, bit-parallel edit distances of the
letters next to the seed leave out nearly all of them; both sides of the rest go through a banded dynamic
programme over (gap letters so far, shift), one step per query letter for all candidates at once.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Tasks get the alignment helpers with their work, not by import.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MISMATCH_PENALTY, GAP_PENALTY = 2, 3
# Letters next to the seed, on either side, that the first filter looks at; with the gaps they fit a packed word.
NEAR = 12
# Candidates whose alignments are computed together, at most and at least, and the bytes of their steps.
STEP, _LEAST_STEP, _STEPS_BYTES = 8192, 64, 1 << 24
_FAR = 10_000
_DIAGONAL, _INSERTION, _DELETION = 1, 2, 3
PLACED = (
    "spacer_id string, target_id string, strand string, position long, details string, mismatches long, gaps long, "
    "alignment_seq string, alignment_length long"
)


def _letters(words: list[np.ndarray], per_word: int, outwards: bool) -> np.ndarray:
    """Digits of packed words, nearest to the seed first; words left of it are turned round."""
    shifts = 3 * (per_word - 1 - np.arange(per_word))
    parts = [(w[:, None] >> shifts & 7).astype(np.uint8) for w in words]
    return np.concatenate(parts if outwards else [p[:, ::-1] for p in parts], axis=1)


def nearest_edits(query: np.ndarray, lengths: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Least edit distance of the first ``lengths`` letters of each query to any beginning of its target.

    All distances of a column are held as differences in the bits of one number (Myers 1999).
    """
    n, one = len(query), np.uint64(1)
    masks = np.zeros((4, n), np.uint64)
    for i in range(query.shape[1]):
        inside = i < lengths
        for letter in range(4):
            masks[letter] |= ((query[:, i] == letter) & inside).astype(np.uint64) << np.uint64(i)
    last = np.maximum(lengths - 1, 0).astype(np.uint64)
    up = (one << lengths.astype(np.uint64)) - one
    down = np.zeros(n, np.uint64)
    score = lengths.astype(np.int64)
    best = score.copy()
    rows = np.arange(n)
    for j in range(target.shape[1]):
        letter = target[:, j]
        equal = np.where(letter < 4, masks[np.minimum(letter, 3), rows], np.uint64(0))
        vertical = equal | down
        horizontal = (((equal & up) + up) ^ up) | equal
        rise, fall = down | ~(horizontal | up), up & horizontal
        score += (rise >> last & one).astype(np.int64) - (fall >> last & one).astype(np.int64)
        rise, fall = rise << one | one, fall << one
        up, down = fall | ~(vertical | rise), rise & vertical
        best = np.minimum(best, score)
    return np.where(lengths > 0, best, 0)


def states(gaps: int) -> list[tuple[int, int]]:
    """(gap letters so far, target letters used less query letters used)."""
    return [(k, d) for k in range(gaps + 1) for d in range(-k, k + 1, 2)]


def align_sides(query: np.ndarray, lengths: np.ndarray, target: np.ndarray, room: np.ndarray, gaps: int) -> tuple[np.ndarray, np.ndarray]:
    """Fewest mismatches in each state once all query letters are used, and the steps that lead there.

    ``room`` is how many target letters there are before the target ends.
    """
    n, known, far = len(query), states(gaps), np.int16(_FAR)
    at = {s: k for k, s in enumerate(known)}
    most = int(lengths.max(initial=0))
    now = np.full((len(known), n), _FAR, np.int16)
    now[0] = 0
    steps = np.zeros((most + 1, len(known), n), np.uint8)
    final = np.full((len(known), n), _FAR, np.int16)
    for j in range(most + 1):
        for s, (k, d) in enumerate(known):
            source = at.get((k - 1, d - 1))
            if source is not None and j + d - 1 >= 0:
                cost = np.where(j + d - 1 < room, now[source], far)
                better = cost < now[s]
                now[s][better] = cost[better]
                steps[j, s][better] = _DELETION
        ends = lengths == j
        final[:, ends] = now[:, ends]
        if j == most:
            break
        after = np.full_like(now, _FAR)
        for s, (k, d) in enumerate(known):
            if 0 <= j + d < target.shape[1]:
                unlike = (query[:, j] != target[:, j + d]).astype(np.int16)
                after[s] = np.where(j + d < room, now[s] + unlike, far)
                steps[j + 1, s] = _DIAGONAL
            source = at.get((k - 1, d + 1))
            if source is not None:
                better = now[source] < after[s]
                after[s][better] = now[source][better]
                steps[j + 1, s][better] = _INSERTION
        now = np.minimum(after, far)
    return final, steps


def _choose(left: np.ndarray, right: np.ndarray, allowed: np.ndarray, gaps: int) -> tuple[np.ndarray, ...]:
    """Best pair of states of the two sides: penalty (or _FAR), state on the left, state on the right."""
    known = states(gaps)

    def of_gaps(final: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        own = sorted((s for s, (j, _) in enumerate(known) if j == k), key=lambda s: (abs(known[s][1]), -known[s][1]))
        place = np.argmin(final[own], axis=0)
        return final[own].min(0).astype(np.int64), np.array(own)[place]

    sides = [[of_gaps(final, k) for k in range(gaps + 1)] for final in (left, right)]
    n = left.shape[1]
    penalty, states_left, states_right = np.full(n, _FAR), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for total in range(gaps + 1):
        for k in range(total + 1):
            (a, state_a), (b, state_b) = sides[0][k], sides[1][total - k]
            cost = np.where(a + b + total <= allowed, MISMATCH_PENALTY * (a + b) + GAP_PENALTY * total, _FAR)
            better = cost < penalty
            penalty[better], states_left[better], states_right[better] = cost[better], state_a[better], state_b[better]
    return penalty, states_left, states_right


def _path(steps: np.ndarray, row: int, n: int, state: int, target: np.ndarray, gaps: int) -> list[tuple[str, str]]:
    """(kind, target letter or gap) of the alignment's columns, from the far end to the seed."""
    known = states(gaps)
    at = {s: k for k, s in enumerate(known)}
    (k, d), j, out = known[state], n, []
    while j > 0 or k > 0:
        step = steps[j, at[k, d], row]
        if step == _DIAGONAL:
            j -= 1
            out.append(("M", "ACGTN"[min(target[row, j + d], 4)]))
        elif step == _INSERTION:
            j, k, d = j - 1, k - 1, d + 1
            out.append(("I", "-"))
        else:
            k, d = k - 1, d - 1
            out.append(("D", "ACGTN"[min(target[row, j + d], 4)]))
    return out


def _details(columns: list[tuple[str, str]]) -> str:
    """Runs of the same kind of column with their lengths."""
    out, run, kind = [], 0, None
    for own, _ in [*columns, (None, "")]:
        if own != kind:
            if run:
                out.append(f"{run}{kind}")
            kind, run = own, 0
        run += 1
    return "".join(out)


def place_candidates(batches: Iterator[pa.RecordBatch], seed: int, flanks: int, per_word: int, gaps: int, identity: int) -> Iterator[pa.RecordBatch]:
    """The best alignment through each candidate's seed word, where one is good enough."""
    names = [x.split()[0] for x in PLACED.split(", ")]
    for batch in batches:
        for start in range(0, batch.num_rows, 1 << 16):
            found = _placed_batch(batch.slice(start, 1 << 16), seed, flanks, per_word, gaps, identity)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], names=names)


def _placed_batch(batch: pa.RecordBatch, seed: int, flanks: int, per_word: int, gaps: int, identity: int) -> list[tuple]:
    number = lambda name, rows=None: batch.column(name).to_numpy(zero_copy_only=False) if rows is None else batch.column(name).to_numpy(zero_copy_only=False)[rows]
    length, before = number("query_length").astype(np.int64), number("offset").astype(np.int64) - 1
    allowed = (100 - identity) * length // 100
    after = length - before - seed
    edits = np.zeros(batch.num_rows, np.int64)
    for side, own, outwards in ((0, before, False), (flanks, after, True)):
        query, target = (_letters([number(f"{kind}{side}")], per_word, outwards) for kind in "qt")
        edits += nearest_edits(query[:, :NEAR], np.minimum(own, NEAR), target[:, :NEAR + gaps])
    rows = np.flatnonzero(edits <= allowed)
    step = step_of(int(length.max(initial=1)), gaps)
    out = []
    for at in range(0, len(rows), step):
        part = rows[at:at + step]
        sides = []
        place, target_length = number("place", part).astype(np.int64), number("target_length", part).astype(np.int64)
        for first, own, outwards, room in (
            (0, before[part], False, place - 1), (flanks, after[part], True, target_length - (place + seed - 1)),
        ):
            query, target = (_letters([number(f"{kind}{first + j}", part) for j in range(flanks)], per_word, outwards) for kind in "qt")
            sides.append((query, own, target, room))
        words = (number("seed_word", part)[:, None] >> (3 * (seed - 1 - np.arange(seed))) & 7).astype(np.uint8)
        good, columns = placed(sides, words, place, allowed[part], gaps)
        texts = [batch.column(name).take(pa.array(part[good])).to_pylist() for name in ("spacer_id", "target_id", "strand")]
        out += zip(*texts, *columns, strict=True)
    return out


def step_of(longest: int, gaps: int) -> int:
    """How many candidates are aligned together, so that their steps stay within a bound."""
    return max(_LEAST_STEP, min(STEP, _STEPS_BYTES // (longest * len(states(gaps)))))


def placed(sides: list[tuple[np.ndarray, ...]], words: np.ndarray, place: np.ndarray, allowed: np.ndarray, gaps: int) -> tuple[np.ndarray, list[list]]:
    """Which candidates have an alignment that is good enough, and its position, details, mismatches, gap letters, letters and columns.

    ``sides`` has the query's and the target's letters left and right of the seed, outwards, the number of the former
    and the room; ``words`` the letters of the seed.
    """
    (_, before, target_left, _), (_, after, target_right, _) = sides
    (left_final, left_steps), (right_final, right_steps) = (align_sides(q, own, t, room, gaps) for q, own, t, room in sides)
    penalty, state_left, state_right = _choose(left_final, right_final, allowed, gaps)
    good = np.flatnonzero(penalty < _FAR)
    known = states(gaps)
    out = []
    for row in good.tolist():
        left = _path(left_steps, row, int(before[row]), state_left[row], target_left, gaps)
        right = _path(right_steps, row, int(after[row]), state_right[row], target_right, gaps)
        columns = [*left, *[("M", "ACGTN"[x]) for x in words[row].tolist()], *reversed(right)]
        total = known[state_left[row]][0] + known[state_right[row]][0]
        mismatches = int(left_final[state_left[row], row]) + int(right_final[state_right[row], row])
        position = int(place[row] - before[row]) - known[state_left[row]][1]
        out.append((position, _details(columns), mismatches, total, "".join(x for _, x in columns), len(columns)))
    return good, [list(c) for c in zip(*out, strict=True)] if out else [[] for _ in range(6)]
