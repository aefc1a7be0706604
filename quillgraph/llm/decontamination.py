"""Benchmark decontamination: which documents hold a benchmark item, with edits.

An item is held where a substring of the text is within PERCENT edits of
characters (A-Z as a-z, white space as one space) for its length.

Candidates come from CGK walks, which map edit distance to Hamming distance.  A walk
reads characters from where a window begins; coins for the step and the character
decide whether its pointer goes on or stays, and at each step it writes down the GRAM
characters at its pointer.  Two windows a few edits apart come in step again soon
after each edit, so that they agree at many steps: at PERCENT edits still at about
every sixth.  Windows begin at all words and are as long as the item: a walk crosses
it from its first character to its last, in about twice as many steps.

The steps that are compared, the LSH's samples, lie evenly over the whole walk; WALKS
walks are the repetitions.  An item and a window that agree in NEED parts of the item,
at alignments that the edits allow, are a candidate.  The exact edit distance (Myers'
bit vectors) between the item and the best substring around decides, so that nothing is
found that isn't there.

Recall, against the exact distance of all substrings: 0.99 or more for random edits of 5,
10 and 15 percent of the characters, for other words at both ends or at 10 percent of
places, and for other characters in the first 15 percent, with items of 4 to 900 words
(tests hold it at RECALL).  Lower where the most edits lie evenly, as then few samples
stay whole: with one edit every eight characters 0.93 or more, every seven 0.8 to 0.9.

Coins are the same every STEP steps, so that a block of steps is one lookup by the
classes of the characters ahead, and 2, 4, 8 blocks are lookups of lookups: a sample
costs one step, however far in the walk it is.

Items go to the tasks in blocks of bounded size, each against all documents; what a block
finds is written before the block after the next is read, so that the driver holds two at most.

Cases: null and blank texts and items hold and match nothing; rows that repeat
a doc_id give the smallest distance; repeated item_ids likewise; null ids are
returned as they are; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored
from .textkernel import SPACE, U64, Texts, numbered, pick, slices, windows

#: Edits allowed, in percent of the item's characters.
PERCENT = 15
#: Target: the share of copies within PERCENT random edits that must be found.
RECALL = 0.95
#: Walks over items of LONG characters or more; shorter ones, which give few samples, are walked over twice and four times as often.
WALKS = 2
LONG = 64
#: Characters of a sample, and blocks of a walk between samples of an item of LONG characters; twice as many for twice the length.
GRAM = 5
DENSE = 2
#: Parts of an item, and how many of them must have samples that agree.
PARTS = 8
NEED = 2
#: Steps with coins of their own; a walk is made of blocks of so many steps.
STEP = 8
#: Samples after which windows that have left their text are let go.
TOGETHER = 8
#: Words of an item at which its walks begin.
STARTS = 4
#: Windows begin at every character of a word from this one on, so that texts without spaces are looked through too.
LONG_WORD = 12
#: Characters of the pieces that are looked for around candidates before the exact distance.
SHORT = 4
#: Such pieces that are looked for in one step, characters of a cell of the text, and cells that a piece is looked for in.
AT_ONCE = 8
CELL, CELLS = 64, 3
#: Cells whose pieces are put down at once, and the most entries of a table of samples by step and value.
PACK, TABLE = 1024, 1 << 22
#: Items, and characters of items, that are sent to the tasks at once.
BLOCK, BLOCK_CHARS = 20_000, 32_000_000
#: Characters of texts that are walked over at once, so that tables of jumps stay in a core's cache; more where items are long.
PART = 1 << 17

_FACTOR, _CLASS = 0x9E3779B97F4A7C15, np.uint32(0x9E3779B1)


def plain(text: str) -> str:
    """Words joined by one space, A-Z as a-z."""
    return b" ".join((text or "").encode().lower().split()).decode()


def characters(t: Texts) -> tuple[str, np.ndarray]:
    """All texts one after another, each made plain, and where each begins, and the end."""
    data = t.data + ((t.data >= 65) & (t.data <= 90)).astype(np.uint8) * 32
    kept = ~SPACE[data]
    last = np.zeros(len(t.end), bool)
    last[t.first[1:][np.diff(t.first) > 0] - 1] = True
    gaps = t.end[~last]  # the byte after a word that isn't its text's last
    kept[gaps], data[gaps] = True, 32
    begins = kept & ((data & 0xC0) != 0x80)
    off = np.concatenate(([0], np.cumsum(begins)))[t.off]
    return data[kept].tobytes().decode(), off


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


# -- walks ---------------------------------------------------------------------


@functools.lru_cache(maxsize=None)
def moves(walk: int) -> np.ndarray:
    """How far a block of a walk goes, by the classes (two bits each) of the STEP characters ahead.

    In each step two of the four classes go on by one and two stay; each class goes on in half of the steps.
    """
    rng = np.random.Generator(np.random.PCG64(7919 + walk))
    coins = np.zeros((STEP, 4), np.int64)
    while (coins.sum(axis=0) != STEP // 2).any():
        coins = np.array([rng.permutation([0, 0, 1, 1]) for _ in range(STEP)])
    ahead = np.arange(1 << (2 * STEP))
    place = np.zeros(len(ahead), np.int64)
    for coin in coins:
        place += coin[(ahead >> (2 * place)) & 3]
    return place.astype(np.int32)


class Walks:
    """Walks over the characters of texts, from any of them."""

    def __init__(self, points: np.ndarray):
        self.points, self.n = points, len(points)
        self.jumps: tuple[int, list[np.ndarray]] = (-1, [])  # of the walk that was asked for last
        code = ((points * _CLASS) >> np.uint32(30)).astype(np.uint16)
        width = 1
        while width < STEP:
            code[:-width] |= code[width:] << np.uint16(2 * width)
            width *= 2
        self.ahead = code

    def grams(self, q: int) -> np.ndarray:
        """Hashes of all runs of q characters."""
        return windows(self.points.astype(U64), q, _FACTOR)

    def along(self, walk: int, start: np.ndarray, blocks: list[int]) -> Iterator[np.ndarray]:
        """Where the walk's pointer is after so many blocks (ascending), from each start."""
        if self.jumps[0] != walk:
            self.jumps = walk, [np.minimum(np.arange(self.n) + moves(walk)[self.ahead], self.n - 1)]
        jumps = self.jumps[1]
        at, done = start, 0
        for upto in blocks:
            rest, k = upto - done, 0
            while rest:
                if rest & 1:
                    at = jumps[k].take(at, mode="clip")  # all are inside; this is numpy's fastest way
                rest, k = rest >> 1, k + 1
                if rest and k == len(jumps):
                    jumps.append(jumps[-1].take(jumps[-1], mode="clip"))
            done = upto
            yield at


def starts_of(points: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where windows begin; texts: where texts begin."""
    ink = points != 32
    first = np.concatenate((ink[:1], ink[1:] & ~ink[:-1]))
    first[texts] = ink[texts]
    begin = np.flatnonzero(first)
    if not len(begin):
        return begin
    since = np.arange(len(points)) - begin[np.maximum(np.cumsum(first) - 1, 0)]
    return np.flatnonzero(first | (ink & (since >= LONG_WORD)))


@dataclass(frozen=True)
class Plan:
    """How items of some length are sampled: characters of a sample, blocks between samples, walks, and samples that must agree."""

    gram: int
    blocks: int
    walks: int
    need: int


def plan_of(size: int) -> Plan:
    if size >= LONG:
        return Plan(GRAM, DENSE << ((size // LONG).bit_length() - 1), WALKS, NEED)
    if 2 * size >= LONG:
        return Plan(GRAM, 1, 2 * WALKS, NEED)
    return Plan(max(1, min(5, size // (size * PERCENT // 100 + 1))), 1, 4 * WALKS, 1)


class Samples:
    """Samples of items by length of gram: which items have which gram at which step of which walk."""

    def __init__(self, gram: int, rows: list[tuple[np.ndarray, ...]]):
        self.gram = gram
        value, walk, block, item, offset = (np.concatenate(x) for x in zip(*rows))
        self.values = np.unique(value)
        self.steps = {int(w): np.unique(block[walk == w]).tolist() for w in np.unique(walk)}
        self.width = int(block.max()) + 1
        self.depth = int(walk.max()) + 1
        key = (walk * self.width + block) * len(self.values) + np.searchsorted(self.values, value)
        key, self.item, self.offset = np.unique(np.stack((key, item, offset)), axis=1)  # walks from two words of an item often meet
        self.keys, first = np.unique(key, return_index=True)
        self.first = np.append(first, len(key))
        bits = min(22, len(self.values).bit_length() + 3)
        self.shift = U64(64 - bits)
        self.first_of = np.searchsorted((self.values >> self.shift).astype(np.int64), np.arange((1 << bits) + 1)).astype(np.int32)  # values by their leading bits
        self.alike = int(np.diff(self.first_of).max())
        self.marks = {}  # by walk and value, and none for the last value: at which of the walk's steps it is somewhere, modulo 64
        step, value = np.divmod(self.keys, len(self.values))
        begin = np.searchsorted(step, np.arange(self.depth * self.width + 1))
        self.at_step, self.number_of = begin, value.astype(np.int32)  # a step's keys by value are few, and stay in a core's cache
        self.table = None  # of keys by step and value, where it isn't too large
        if self.depth * self.width * len(self.values) <= TABLE:
            self.table = np.zeros(self.depth * self.width * len(self.values), np.int32)
            self.table[self.keys] = np.arange(1, len(self.keys) + 1)
        for walk, blocks in self.steps.items():
            of = step // self.width == walk
            nth = np.searchsorted(blocks, step[of] % self.width) & 63
            self.marks[walk] = np.zeros(len(self.values) + 1, U64)
            np.bitwise_or.at(self.marks[walk], value[of], U64(1) << nth.astype(U64))

    def number(self, walks: Walks) -> np.ndarray:
        """Which of the values is at each character; -1: none."""
        out = np.full(walks.n, -1, np.int32)
        h = walks.grams(self.gram)
        lead = (h >> self.shift).astype(np.int64)
        begin, many = self.first_of[lead], self.first_of[lead + 1]
        many -= begin
        at = np.flatnonzero(many > 0)
        for k in range(self.alike):
            found = begin[at] + np.int32(k)
            same = self.values[found] == h[at]
            out[at[same]] = found[same]
            at = at[~same & (many[at] > k + 1)]
        return out

    def _keys(self, step: int, value: np.ndarray) -> np.ndarray:
        """Which key has the step and each value; -1: none."""
        if self.table is not None:
            return self.table[step * len(self.values):(step + 1) * len(self.values)].take(value) - 1
        begin, of_step = self.at_step[step], self.number_of[self.at_step[step]:self.at_step[step + 1]]
        found = np.minimum(np.searchsorted(of_step, value), len(of_step) - 1)
        return np.where(of_step[found] == value, found + begin, -1)

    def agreeing(self, walks: Walks, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(window, entry, place) of the samples that windows from start, in texts up to end, share with items."""
        number = self.number(walks)
        for walk, blocks in self.steps.items():
            marks = self.marks[walk][number]
            window, at, upto, done, eight = np.arange(len(start)), start, end, 0, -1
            for first in range(0, len(blocks), TOGETHER):
                part = blocks[first:first + TOGETHER]
                for nth, (block, at) in enumerate(zip(part, walks.along(walk, at, [b - done for b in part])), first):
                    step = walk * self.width + block
                    if (nth & 63) >> 3 != eight:
                        eight = (nth & 63) >> 3
                        some = (marks >> U64(8 * eight)).astype(np.uint8)
                    w = np.flatnonzero((some.take(at, mode="clip") & np.uint8(1 << (nth & 7))) != 0)
                    there = at[w]
                    inside = there + self.gram <= upto[w]
                    w, there = w[inside], there[inside]
                    found = self._keys(step, number[there])
                    same = found >= 0
                    w, there, found = w[same], there[same], found[same]
                    many = self.first[found + 1] - self.first[found]
                    entry = np.arange(int(many.sum())) + np.repeat(self.first[found] - np.cumsum(many) + many, many)
                    yield np.repeat(window[w], many), entry, np.repeat(there, many)
                done = part[-1]
                live = np.flatnonzero(at + self.gram <= upto)  # pointers never go back
                window, at, upto = window[live], at[live], upto[live]


class Items:
    """Benchmark items and the samples of their walks."""

    def __init__(self, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        self.texts = [plain(r[1]) for r in rows]
        self.limit = [len(t) * PERCENT // 100 for t in self.texts]
        self.size, self.most = np.array([len(t) for t in self.texts], np.int64), np.array(self.limit, np.int64)
        plans = [plan_of(len(t)) for t in self.texts]
        self.need = np.array([p.need for p in plans], np.int64)
        self.longest = int(self.size.max(initial=0))
        by: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for plan in sorted({p for p, t in zip(plans, self.texts) if t}, key=lambda p: (p.gram, p.blocks)):
            by.setdefault(plan.gram, []).extend(self._walked(plan, [k for k, p in enumerate(plans) if p == plan and self.texts[k]]))
        self.samples = [Samples(q, got) for q, got in by.items()]
        self.first = np.concatenate(([0], np.cumsum(self.size)))  # pieces by item and place
        self.pieces, self.piece = np.unique(windows(code_points("".join(self.texts) + " " * SHORT).astype(U64), SHORT, _FACTOR), return_inverse=True)

    def _walked(self, plan: Plan, which: list[int]) -> Iterator[tuple[np.ndarray, ...]]:
        gap = " " * (STEP * 2)
        walks = Walks(code_points(gap.join(self.texts[k] for k in which) + gap))
        begin = np.cumsum([0] + [len(self.texts[k]) + len(gap) for k in which[:-1]])
        value = walks.grams(plan.gram)
        blocks = list(range(0, 3 * self.longest // STEP + 1, plan.blocks))
        for nth in range(STARTS):
            offset = np.array([_word(self.texts[k], nth) for k in which])
            for walk in range(plan.walks):
                live, steps = np.flatnonzero(offset >= 0), blocks[walk > 0:]  # where they begin all walks have the same sample
                for block, at in zip(steps, walks.along(walk, (begin + offset)[live], steps)):
                    place = at - begin[live]
                    inside = place + plan.gram <= self.size[which][live]
                    if not inside.any():
                        break
                    n = int(inside.sum())
                    yield value[at[inside]], np.full(n, walk), np.full(n, block), np.array(which)[live[inside]], place[inside]

    def candidates(self, points: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Rows of text, item, first and last place: all regions in which an item may be held, in order."""
        out = [np.zeros((0, 4), np.int64)]
        reach = 4 * self.longest + 64
        size = max(PART, 4 * reach)
        for begin in range(0, len(points), size):
            walks = Walks(points[begin:begin + size + reach])
            texts = off[np.searchsorted(off, begin):np.searchsorted(off, begin + walks.n)] - begin
            start = starts_of(walks.points, texts)
            start = start[start < size]
            doc = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(start + begin, off)))
            for samples in self.samples:
                out.append(self._regions(samples, walks, start, doc, off[doc + 1] - begin, begin))
        return _merged(np.concatenate(out))

    def _regions(self, samples: Samples, walks: Walks, start: np.ndarray, doc: np.ndarray, end: np.ndarray, begin: int) -> np.ndarray:
        got = list(samples.agreeing(walks, start, end))
        if not got:
            return np.zeros((0, 4), np.int64)
        window, entry, place = (np.concatenate(x) for x in zip(*got))
        item = samples.item[entry]
        slot = (window * len(self.ids) + item) & ((1 << min(22, (4 * len(item)).bit_length())) - 1)
        enough = np.bincount(slot)[slot] >= self.need[item]  # others agree with their item in too few samples
        window, item, offset, place = window[enough], item[enough], samples.offset[entry[enough]], place[enough]
        width = 8 * self.longest + 128
        key = (window * len(self.ids) + item) * width + (place - offset - start[window] + width // 2)  # last: where the item would begin
        part = offset * PARTS // self.size[item]
        _, one = np.unique((key // width * PARTS + part) * 2 + (key % width - width // 2 < 0), return_index=True)
        key = np.sort(key[one])
        pair = key // width
        item = pair % len(self.ids)
        last = np.arange(len(key)) + self.need[item] - 1
        some = np.flatnonzero(last < len(key))
        some = some[(pair[last[some]] == pair[some]) & (key[last[some]] - key[some] <= self.most[item[some]])]
        item, w = item[some], pair[some] // len(self.ids)
        lo = key[last[some]] % width - width // 2 + start[w] + begin - self.most[item]
        hi = key[some] % width - width // 2 + start[w] + begin + 2 * self.most[item] + self.size[item]
        return np.stack((doc[w], item, lo, hi), axis=1)

    def plausible(self, points: np.ndarray, off: np.ndarray, regions: np.ndarray) -> np.ndarray:
        """The regions that have enough of their item's pieces near where they belong.

        Pieces are looked for by cells of the text first, which may show one that isn't
        there, then by their exact places around the regions that are left.
        """
        value = windows(points.astype(U64), SHORT, _FACTOR)
        for look, remainders in ((self._by_cell, 1), (self._by_place, SHORT)):
            if len(regions):
                text, _, lo, hi = regions.T
                near = np.zeros(len(points) + 1, np.int32)
                np.add.at(near, np.maximum(lo, off[text]), 1)
                np.add.at(near, np.minimum(hi, off[text + 1]), -1)
                at = np.flatnonzero(np.cumsum(near)[:len(value)] > 0)
                regions = regions[self._enough(regions, off, look(at, value[at], len(points)), remainders)]
        return regions

    def _by_cell(self, at: np.ndarray, value: np.ndarray, size: int) -> Callable[..., np.ndarray]:
        """Whether a piece begins in a range of places, by CELL characters and ten bits of its hash; ranges over more than CELLS cells always have it."""
        table = np.zeros((size // (CELL * PACK) + 1) * PACK * 128, np.uint8)
        slot = (value & U64(1023)).astype(np.int64) + (at // CELL << 10)
        ends = np.searchsorted(at, np.arange(0, size + CELL * PACK, CELL * PACK)).tolist()
        for k, (a, b) in enumerate(zip(ends, ends[1:])):
            there = np.zeros(PACK << 10, bool)
            there[slot[a:b] - (k * PACK << 10)] = True
            table[k * PACK * 128:(k + 1) * PACK * 128] = np.packbits(there, bitorder="little")
        slots = (self.pieces & U64(1023)).astype(np.int64)

        def found(piece: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            slot, cell, last = slots[piece], np.maximum(lo, 0) // CELL, np.maximum(hi, 0) // CELL
            byte, bit = slot >> 3, np.uint8(1) << (slot & 7).astype(np.uint8)
            out = last - cell >= CELLS
            for k in range(CELLS):
                out |= (table[np.minimum(cell + k, last) * 128 + byte] & bit) != 0
            return out

        return found

    def _by_place(self, at: np.ndarray, value: np.ndarray, size: int) -> Callable[..., np.ndarray]:
        """The same, exactly."""
        known = np.minimum(np.searchsorted(self.pieces, value), len(self.pieces) - 1)
        same = self.pieces[known] == value
        places = np.append(np.sort(known[same] * (size + 1) + at[same]), np.iinfo(np.int64).max)
        return lambda piece, lo, hi: places[np.searchsorted(places, piece * (size + 1) + lo)] <= piece * (size + 1) + hi

    def _enough(self, regions: np.ndarray, off: np.ndarray, found: Callable[..., np.ndarray], remainders: int) -> np.ndarray:
        """Which regions have enough pieces; found: whether pieces begin in a range of places, both ends included.

        An edit spoils one piece at most of those that begin at the same remainder by
        SHORT, so that all but the limit of them must be there, for each remainder (the first few are looked at).
        """
        text, item, lo, hi = regions.T
        most, size = self.most[item], self.size[item]
        lowest, highest = off[text], np.minimum(hi, off[text + 1]) - SHORT
        alive, longest = np.arange(len(regions)), int(size.max())
        for remainder in range(remainders):
            bad = np.zeros(len(regions), np.int64)
            for begin in range(remainder, longest, SHORT * AT_ONCE):
                at = begin + SHORT * np.arange(AT_ONCE)
                there = at + SHORT <= size[alive, None]
                piece = self.piece[np.where(there, self.first[item[alive], None] + at, 0)]
                earliest = np.maximum(lo[alive, None] + at, lowest[alive, None])
                latest = np.minimum((hi - size - most)[alive, None] + at, highest[alive, None])
                bad[alive] += (there & ~found(piece, earliest, latest)).sum(axis=1)
                alive = alive[bad[alive] <= most[alive]]
                if not len(alive):
                    return alive
        return alive


def _word(text: str, nth: int) -> int:
    """Where the item's nth word begins, in the first quarter of it; -1: nowhere."""
    at = 0
    for _ in range(nth):
        at = text.find(" ", at) + 1
        if not at or 4 * at > len(text):
            return -1
    return at


def _merged(regions: np.ndarray) -> np.ndarray:
    """Regions of one text and item that overlap as one, in order."""
    if not len(regions):
        return regions
    text, item, lo, hi = regions = regions[np.lexsort(regions.T[::-1])].T
    new = np.append(True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]))
    group, base = np.cumsum(new), int(lo.min())
    far = int(hi.max()) - base + 1
    reach = np.maximum.accumulate(hi - base + group * far) - group * far + base
    begins = np.flatnonzero(new | np.append(True, lo[1:] > reach[:-1]))
    return np.stack((text[begins], item[begins], lo[begins], reach[np.append(begins[1:], len(lo)) - 1]), axis=1)


def best_substring(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance between the pattern and a substring of the text, and the end of the first such substring."""
    m = len(pattern)
    where: dict[str, int] = {}
    for k, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for at, eq in enumerate(map(where.get, text, itertools.repeat(0)), 1):
        x = eq | down
        diagonal = (((x & up) + up) ^ up) | x
        plus, minus = down | ~(diagonal | up), up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            if score < best:
                best, end = score, at
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | ~(diagonal | plus) & full, plus & diagonal
    return best, end


def substring_distance(pattern: str, text: str, most: int) -> int:
    """Least edit distance between the pattern and a substring of the text; most + 1 if it is above `most`."""
    if pattern in text:
        return 0
    return min(best_substring(pattern, text)[0], most + 1)


def _found(items: Items, t: Texts) -> dict[tuple[int, int], tuple[int, int]]:
    """Least distance and first word of each item in each text (row of the slice) that holds it."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    texts, off = characters(t)
    points = code_points(texts)
    regions = items.candidates(points, off)
    for d, item, lo, hi in items.plausible(points, off, regions).tolist():
        known, pattern = best.get((d, item), (items.limit[item] + 1, 0))[0], items.texts[item]
        if not known:
            continue
        lo, hi = max(lo, int(off[d])), min(hi, int(off[d + 1]))
        region = texts[lo:hi]
        at = region.find(pattern)
        found, end = (0, at + len(pattern)) if at >= 0 else best_substring(pattern, region)
        if found < known:
            if at < 0:
                last = region[max(0, end - len(pattern) - found):end]  # no better substring ends before, so that all of the best end here
                end, at = lo + end, best_substring(pattern[::-1], last[::-1])[1]
                at = end - at - lo
            best[d, item] = (found, texts.count(" ", int(off[d]), lo + at))
    return best


@functools.lru_cache(maxsize=1)
def items_of_worker(rows: tuple[tuple, ...]) -> Items:
    """The same for all tasks that a Python worker runs."""
    return Items(list(rows))


def _matches(batches: Iterator[pa.RecordBatch], rows: tuple[tuple, ...]) -> Iterator[pa.RecordBatch]:
    items = items_of_worker(rows)
    for batch in slices(batches):
        best = _found(items, Texts(batch.column("text")).split())
        keys = batch.column("doc_id").to_pylist()
        got = [(keys[d], items.ids[i], dist, len(items.texts[i]), at) for (d, i), (dist, at) in sorted(best.items())]
        if got:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], kind) for k, kind in enumerate(kinds)], ["doc_id", "item_id", "distance", "item_chars", "at_word"])


def _blocks(benchmark: DataFrame) -> Iterator[tuple[tuple, ...]]:
    """The distinct items, BLOCK or so at a time."""
    items = pick(benchmark, "item_id", "text").where("text IS NOT NULL").distinct()
    count, size = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(count / BLOCK), math.ceil(size / BLOCK_CHARS))
    if blocks > 1:
        items = stored(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))).repartitionByRange("block").sortWithinPartitions("block"), "benchmark-items")
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.col("block") == k).drop("block")
        yield tuple(sorted((tuple(r) for r in part.collect()), key=repr))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document (doc_id, text) and benchmark item (item_id, text) that it holds: doc_id, item_id, distance, item_chars, at_word."""
    texts, out = pick(docs, "doc_id", "text"), []
    for rows in _blocks(benchmark):
        if out:
            out[-1] = stored(out[-1], "leaks")
        out.append(texts.mapInArrow(lambda it, rows=rows: _matches(it, rows), "doc_id long, item_id long, distance int, item_chars int, at_word int"))
    found = functools.reduce(DataFrame.unionByName, out)
    return found.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.min("item_chars").alias("item_chars"), F.min_by("at_word", F.struct("distance", "at_word")).alias("at_word"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns."""

    left, name = numbered(docs)
    text = name("text")

    def clean(batches: Iterator[pa.RecordBatch], rows: tuple[tuple, ...]) -> Iterator[pa.RecordBatch]:
        items = items_of_worker(rows)
        for batch in slices(batches, text):
            hit = np.zeros(batch.num_rows, bool)
            hit[[d for d, _ in _found(items, Texts(batch.column(text)).split())]] = True
            yield batch.filter(pa.array(~hit))

    for nth, rows in enumerate(_blocks(benchmark)):
        if nth:
            left = stored(left, "decontaminated")
        left = left.mapInArrow(lambda it, rows=rows: clean(it, rows), left.schema)
    return left.toDF(*docs.columns)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
