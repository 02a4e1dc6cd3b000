"""Candidates of the seed search found and checked as arrays, in tasks that hold all query words.

Tiles of target digits come as Arrow batches, the queries with the function. Rolling packed words give the seed
word at every place of a run of tiles; a table of the query words by seed gives the candidates, which are
checked some thousands at a time and become rows only if they pass. Without gaps whole queries are
compared by exclusive-or and bit count. With gaps bit-parallel edit distances of the letters next to the seed
leave out nearly all, and ``gapped`` aligns the rest.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from protomatch.operators import gapped

# Tasks get the kernel with their work, not by import.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Letters per packed word, of three bits each.
WORD = 21
# Letters of target tiles held as arrays at once, and candidates checked together.
_LETTERS, _CANDIDATES = 1 << 19, 1 << 14
# Candidates whose whole sides are compared together.
_TOGETHER = 4096
# A digit that fills the room between queries; like unknown letters it equals nothing.
_PAD = 6
# Seed words up to this length find their queries in a table of all words.
_TABLE_SEED = 11
_NEAR = gapped.NEAR
# Letters on either side of a seed whose distance is held in one number.
_FAR = 64
VERIFIED = "query long, target_id string, position long, mismatches int, offset int, context array<long>"
ALIGNED = "query long, target_id string, position long, details string, mismatches long, gaps long, alignment_seq string, alignment_length long"


def rolled(codes: np.ndarray) -> np.ndarray:
    """The packed word that starts at each place; letters past the end read as filling."""
    n = len(codes)
    one = np.concatenate([codes, np.full(WORD, _PAD, np.uint8)]).astype(np.int64)
    two = one[:-1] << 3 | one[1:]
    four = two[:-2] << 6 | two[2:]
    eight = four[:-4] << 12 | four[4:]
    sixteen = eight[:-8] << 24 | eight[8:]
    return sixteen[:n] << 15 | four[16:16 + n] << 3 | one[20:20 + n]


def _keys(words: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Seed word of two bits a letter at each place, and whether all its letters are known."""
    unknown = int("4" * seed + "0" * (WORD - seed), 8)
    known = words & unknown == 0
    key = np.zeros(len(words), np.int64)
    for k in range(seed):
        key = key << 2 | (words >> 3 * (WORD - 1 - k) & 3)
    return key, known


@dataclass
class QueryTable:
    """Queries of one class by their seed words; built in each task from their digits."""

    seed: int
    codes: np.ndarray
    words: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    query: np.ndarray
    at: np.ndarray
    keys: np.ndarray
    firsts: np.ndarray

    @classmethod
    def of(cls, digits: list[str], seed: int) -> QueryTable:
        lengths = np.array([len(d) for d in digits], np.int64)
        room = "6" * WORD
        codes = np.frombuffer((room + "".join(d + room for d in digits) + room).encode(), np.uint8) - 48
        starts = WORD + np.concatenate([[0], np.cumsum(lengths + WORD)[:-1]]).astype(np.int64) if len(digits) else np.zeros(0, np.int64)
        words = rolled(codes)
        key, known = _keys(words, seed)
        query = np.repeat(np.arange(len(digits)), np.maximum(lengths - (seed - 1), 0))
        counts = np.maximum(lengths - (seed - 1), 0)
        before = np.arange(len(query)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = starts[query] + before
        kept = known[at]
        query, at = query[kept], at[kept]
        order = np.argsort(key[at], kind="stable")
        query, at = query[order], at[order]
        if seed <= _TABLE_SEED:
            firsts = np.searchsorted(key[at], np.arange(4 ** seed + 1))
            return cls(seed, codes, words, starts, lengths, query, at, np.zeros(0, np.int64), firsts)
        keys, first = np.unique(key[at], return_index=True)
        return cls(seed, codes, words, starts, lengths, query, at, keys, np.append(first, len(at)))

    def found(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First query word and their number for each seed word."""
        if len(self.at) == 0:
            return np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        if self.seed <= _TABLE_SEED:
            first = self.firsts[key]
            return first, self.firsts[key + 1] - first
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        first = self.firsts[place]
        return first, np.where(self.keys[place] == key, self.firsts[place + 1] - first, 0)


@dataclass
class Tiles:
    """A run of tiles as one array of letters."""

    batch: pa.RecordBatch
    codes: np.ndarray
    words: np.ndarray
    ends: np.ndarray
    flank: int
    tile: int

    def rows(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="right")

    def place(self, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Place on the target, from 1 on, of letters of the tiles or their context."""
        begin = np.concatenate([[0], self.ends[:-1]])[rows]
        number = self.batch.column("tile").to_numpy(zero_copy_only=False).astype(np.int64)[rows]
        return number * self.tile + (at - begin - self.flank) + 1

    def target_length(self, rows: np.ndarray) -> np.ndarray:
        return self.batch.column("target_length").to_numpy(zero_copy_only=False).astype(np.int64)[rows]

    def candidates(self, table: QueryTable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the letters and the query words that share the seed word there, some thousands at a time."""
        key, inside = _keys(self.words, table.seed)
        widths = np.diff(self.ends, prepend=0)
        own = np.ones(len(self.codes), np.int8)
        # Letters of the context belong to other tiles; a tile without letters has nothing but its context.
        for begin, width in zip((self.ends - widths).tolist(), widths.tolist(), strict=True):
            own[begin:begin + self.flank] = 0
            own[begin + max(width - self.flank, 0):begin + width] = 0
        places = np.flatnonzero(inside & (own == 1))
        first, count = table.found(key[places])
        some = count > 0
        places, first, count = places[some], first[some], count[some]
        total = np.cumsum(count)
        at = 0
        while at < len(places):
            done = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, done + _CANDIDATES, side="right")))
            n = count[at:end]
            within = np.arange(int(n.sum())) - np.repeat(total[at:end] - n - done, n)
            yield np.repeat(places[at:end], n), np.repeat(first[at:end], n) + within
            at = end


def _runs(batches: Iterator[pa.RecordBatch], flank: int, tile: int) -> Iterator[Tiles]:
    """Tiles of each batch, in runs of about ``_LETTERS`` letters."""
    for batch in batches:
        if not batch.num_rows:
            continue
        widths = np.array([len(d) for d in batch.column("digits").to_pylist()], np.int64)
        run = np.cumsum(widths) // _LETTERS
        edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(edges, edges[1:], strict=False):
            part = batch.slice(begin, end - begin)
            codes = np.frombuffer("".join(part.column("digits").to_pylist()).encode(), np.uint8) - 48
            yield Tiles(part, codes, rolled(codes), np.cumsum(widths[begin:end]), flank, tile)


def _spread(letters: int) -> int:
    """The lowest bit of each of the first letters of a packed word."""
    return int("1" * letters + "0" * (WORD - letters), 8)


def verify(batches: Iterator[pa.RecordBatch], digits: list[str], seed: int, flanks: int, flank: int, tile: int, identity: int) -> Iterator[pa.RecordBatch]:
    """Placements without gaps that reach the identity, once for every shared seed word."""
    table = QueryTable.of(digits, seed)
    masks = np.array([_spread(n) for n in range(WORD + 1)], np.int64)
    allowed = (100 - identity) * table.lengths // 100
    names = [c.split()[0] for c in VERIFIED.split(", ")]
    for tiles in _runs(batches, flank, tile):
        out = []
        for at, word in tiles.candidates(table):
            query = table.query[word]
            wrong = np.zeros(len(at), np.int64)
            k = 0
            while len(at):
                left = np.clip(table.lengths[query] - WORD * k, 0, WORD)
                if not left.any():
                    break
                # Queries shorter than others of the class have no letters left; their words need not exist.
                here = np.minimum(at - (table.at[word] - table.starts[query]) + WORD * k, len(tiles.words) - 1)
                there = np.minimum(table.starts[query] + WORD * k, len(table.words) - 1)
                x = tiles.words[here] ^ table.words[there]
                wrong += np.bitwise_count((x | x >> 1 | x >> 2) & masks[left])
                good = wrong <= allowed[query]
                at, word, query, wrong = at[good], word[good], query[good], wrong[good]
                k += 1
            before = table.at[word] - table.starts[query]
            rows = tiles.rows(at)
            start = tiles.place(at, rows) - before
            whole = (start >= 1) & (start + table.lengths[query] - 1 <= tiles.target_length(rows))
            if whole.any():
                out.append([x[whole] for x in (at, query, before, rows, start, wrong)])
        if out:
            at, query, before, rows, start, wrong = (np.concatenate(x) for x in zip(*out, strict=True))
            seen = [at] + [at - WORD * (j + 1) for j in range(flanks)] + [at + seed + WORD * j for j in range(flanks)]
            context = np.stack([tiles.words[x] for x in seen], axis=1)
            context[:, 0] >>= 3 * (WORD - seed)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * context.shape[1]), pa.array(context.ravel()))
            target = tiles.batch.column("target_id").take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([
                pa.array(query.astype(np.int64)), target, pa.array(start.astype(np.int64)), pa.array(wrong.astype(np.int32)),
                pa.array((before + 1).astype(np.int32)), lists], names=names)


@dataclass
class Side:
    """Letters of all query words on one side of the seed: how many, and the places of each letter of the alphabet as bits.

    ``near`` has those of the ``NEAR`` nearest in one number, ``far`` a row of numbers with those of up to ``_FAR`` letters.
    """

    outwards: int
    own: np.ndarray
    near: np.ndarray
    far: np.ndarray

    @classmethod
    def of(cls, table: QueryTable, outwards: int) -> Side:
        before = table.at - table.starts[table.query]
        own = before if outwards < 0 else table.lengths[table.query] - before - table.seed
        nearest = table.at - 1 if outwards < 0 else table.at + table.seed
        # The last column is for letters that equal nothing.
        far = np.zeros((len(table.at), _PAD + 1), np.uint64)
        for i in range(min(_FAR, int(own.max(initial=0)))):
            rows = np.flatnonzero(i < own)
            letter = table.codes[nearest[rows] + outwards * i]
            far[rows, letter] |= np.uint64(1) << np.uint64(i)
        far[:, 4:] = 0
        near = np.zeros(len(table.at), np.uint64)
        for letter in range(4):
            near |= (far[:, letter] & np.uint64(2 ** _NEAR - 1)) << np.uint64(letter * _NEAR)
        return cls(outwards, own, near, far)

    def near_edits(self, word: np.ndarray, tiles: Tiles, at: np.ndarray, seed: int, letters: int) -> np.ndarray:
        """``gapped.nearest_edits`` of the nearest letters, in short numbers."""
        distance = _Distance(np.minimum(self.own[word], _NEAR), np.uint16, np.int8)
        masks = self.near[word]
        target = tiles.words[at + seed if self.outwards > 0 else at - WORD].view(np.uint64)
        for j in range(letters):
            shift = (target >> np.uint64(3 * (WORD - 1 - j) if self.outwards > 0 else 3 * j)) & np.uint64(7)
            shift *= np.uint64(_NEAR)
            equal = (masks >> shift).astype(np.uint16)
            equal &= np.uint16(2 ** _NEAR - 1)
            distance.add(equal)
        return distance.best

    def far_edits(self, word: np.ndarray, tiles: Tiles, at: np.ndarray, seed: int, gaps: int) -> np.ndarray:
        """The same of up to ``_FAR`` letters; candidates with like numbers of letters go together."""
        own = np.minimum(self.own[word], _FAR)
        best = np.zeros(len(word), np.int16)
        order = np.argsort(own, kind="stable")
        masks = self.far.ravel()
        for begin in range(0, len(order), _TOGETHER):
            part = order[begin:begin + _TOGETHER]
            distance = _Distance(own[part], np.uint64, np.int16)
            row, place = word[part] * (_PAD + 1), at[part] - 1 if self.outwards < 0 else at[part] + seed
            # Columns past a query's own ones can but lower its bound.
            for _ in range(int(own[part[-1]]) + gaps):
                distance.add(masks[row + tiles.codes.take(place, mode="clip")])
                place = place + self.outwards
            best[part] = distance.best
        return best


class _Distance:
    """Least edit distance of each query to any beginning of its target, a column of the target at a time.

    All distances of a column are held as differences in the bits of one number (Myers 1999).
    """

    def __init__(self, lengths: np.ndarray, bits: type, numbers: type) -> None:
        one = bits(1)
        size = lengths.astype(bits)
        self.one = one
        self.last = np.where(size > 0, one << (np.maximum(size, one) - one), bits(0))
        self.up = self.last | (self.last - one) * (size > 0)
        self.down = np.zeros(len(lengths), bits)
        self.score = lengths.astype(numbers)
        self.best = self.score.copy()

    def add(self, equal: np.ndarray) -> None:
        one, up, down, last = self.one, self.up, self.down, self.last
        vertical = equal | down
        rise = equal & up
        rise += up
        rise ^= up
        rise |= equal
        fall = up & rise
        rise |= up
        np.invert(rise, out=rise)
        rise |= down
        self.score += ((rise & last) != 0).view(np.int8)
        self.score -= ((fall & last) != 0).view(np.int8)
        np.minimum(self.best, self.score, out=self.best)
        rise <<= one
        rise |= one
        fall <<= one
        np.bitwise_and(rise, vertical, out=down)
        vertical |= rise
        np.invert(vertical, out=up)
        up |= fall


def _letters_beside(codes: np.ndarray, nearest: np.ndarray, outwards: int, most: int) -> np.ndarray:
    """Letters from the seed outwards; past the ends of the array filling."""
    index = nearest[:, None] + outwards * np.arange(most)
    inside = (index >= 0) & (index < len(codes))
    return np.where(inside, codes[np.clip(index, 0, len(codes) - 1)], _PAD)


def align(batches: Iterator[pa.RecordBatch], digits: list[str], seed: int, flank: int, tile: int, gaps: int, identity: int) -> Iterator[pa.RecordBatch]:
    """The best alignment with gaps through each shared seed word, where one is good enough."""
    table = QueryTable.of(digits, seed)
    allowed = (100 - identity) * table.lengths // 100
    sides = [Side.of(table, -1), Side.of(table, 1)]
    names = [c.split()[0] for c in ALIGNED.split(", ")]
    for tiles in _runs(batches, flank, tile):
        near = (_with_few(allowed[table.query[word]], at, word, lambda s, at, word: s.near_edits(word, tiles, at, seed, _NEAR + gaps), sides)
                for at, word in tiles.candidates(table))
        far = (_with_few(allowed[table.query[word]], at, word, lambda s, at, word: s.far_edits(word, tiles, at, seed, gaps), sides)
               for at, word in _gathered(near, 4 * _CANDIDATES))
        for at, word in _gathered(far, gapped.STEP):
            yield from _aligned(at, word, tiles, table, allowed, gaps, names)


def _with_few(room: np.ndarray, at: np.ndarray, word: np.ndarray, edits: Callable, sides: list[Side]) -> tuple[np.ndarray, np.ndarray]:
    """Candidates whose edits on both sides together do not exceed ``room``."""
    for side in sides:
        room = room - edits(side, at, word)
        good = room >= 0
        at, word, room = at[good], word[good], room[good]
    return at, word


def _gathered(found: Iterator[tuple[np.ndarray, np.ndarray]], least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates put together until there are at least so many."""
    waiting, n = [], 0
    for pair in found:
        waiting.append(pair)
        n += len(pair[0])
        if n >= least:
            yield tuple(np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*waiting, strict=True))


def _aligned(all_at: np.ndarray, all_word: np.ndarray, tiles: Tiles, table: QueryTable, allowed: np.ndarray, gaps: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    step = gapped.step_of(int(table.lengths.max(initial=1)), gaps)
    for begin in range(0, len(all_at), step):
        at, word = all_at[begin:begin + step], all_word[begin:begin + step]
        query = table.query[word]
        before = table.at[word] - table.starts[query]
        after = table.lengths[query] - before - table.seed
        rows = tiles.rows(at)
        place, target_length = tiles.place(at, rows), tiles.target_length(rows)
        both = []
        for own, outwards, room in ((before, -1, place - 1), (after, 1, target_length - (place + table.seed - 1))):
            most = int(own.max(initial=0))
            letters = _letters_beside(table.codes, table.at[word] - 1 if outwards < 0 else table.at[word] + table.seed, outwards, most)
            target = _letters_beside(tiles.codes, at - 1 if outwards < 0 else at + table.seed, outwards, most + gaps)
            both.append((letters, own, target, room))
        words = tiles.codes[at[:, None] + np.arange(table.seed)]
        good, columns = gapped.placed(both, words, place, allowed[query], gaps)
        if len(good):
            target = tiles.batch.column("target_id").take(pa.array(rows[good]))
            yield pa.RecordBatch.from_arrays([pa.array(query[good].astype(np.int64)), target, *[pa.array(c) for c in columns]], names=names)
