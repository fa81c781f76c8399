"""Suffix order of a text of many strings by induced sorting, with common-prefix values carried along.

Suffixes are of type L (larger than their successor) or S. The S suffixes that follow an L one are sorted first;
scanning the sorted suffixes upwards, each hands its left neighbour, if of type L, to the queue of that neighbour's
first byte, and scanning downwards likewise for type S. A queue receives its entries in order, so a scan takes whole
queues at a time. Queues longer than SPILL_ROWS keep their entries in an unnamed scratch file. With every entry goes
the common prefix with the entry before it in its queue: one more than the least value passed between the two sources.

The starting suffixes are sorted by pieces of eight bytes, ties alone going on to the next piece: what lies
beyond the depth doesn't matter to the caller, so the reduced problem needs no deeper recursion."""

from __future__ import annotations

import tempfile

import numpy as np

SPILL_ROWS = 500_000


class Queue:
    """Batches of (position, common prefix) in order; long ones on disk."""

    def __init__(self):
        self.batches: list[tuple[np.ndarray, np.ndarray]] = []
        self.file, self.held, self.lengths = None, 0, []

    def put(self, at: np.ndarray, lcp: np.ndarray) -> None:
        self.batches.append((at, lcp))
        self.held += len(at)
        if self.held >= SPILL_ROWS:
            self.file = self.file or tempfile.TemporaryFile()
            for x, y in self.batches:
                self.file.write(x.astype(np.int64).tobytes() + y.astype(np.int32).tobytes())
                self.lengths.append(len(x))
            self.batches, self.held = [], 0

    def take(self):
        """All entries put so far, in order and in batches of some size, as they are read back."""
        held, size = [], 0
        for batch in self._drain():
            held.append(batch)
            size += len(batch[0])
            if size >= SPILL_ROWS:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, size = [], 0
        if held:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))

    def _drain(self):
        file, lengths, batches = self.file, self.lengths, self.batches
        self.file, self.lengths, self.batches, self.held = None, [], [], 0  # what is put from now on waits for the next call
        if file:
            file.seek(0)
            for n in lengths:
                yield np.frombuffer(file.read(8 * n), np.int64), np.frombuffer(file.read(4 * n), np.int32)
            file.close()
        yield from batches


def types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is of type S; the last position, which must hold the least value, is."""
    step = np.sign(np.diff(text.astype(np.int32)))
    n = len(text)
    follow = np.where(step != 0, np.arange(n - 1), n)  # a tie takes the type of the next difference
    follow = np.minimum.accumulate(follow[::-1])[::-1]
    out = np.ones(n, bool)
    out[:-1] = step[np.minimum(follow, n - 2)] > 0
    return out


def _eights(text: np.ndarray, depth: int) -> np.ndarray:
    """A view of the eight bytes from each position on as one number; zeros follow the text."""
    padded = np.concatenate((text, np.zeros(depth + 16, np.uint8)))
    return np.ndarray(len(padded) - 7, ">u8", padded, strides=(1,))


def _start_order(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The starting suffixes in order of their first depth values at least (ties in any order).

    Eight values make a key; suffixes that tie in it are ordered by the next eight, and so on."""
    eights = _eights(text, depth)
    order = starts.copy()
    group = np.zeros(len(order), np.int64)  # entries of one number tie so far
    open_ = np.arange(len(order))
    for at in range(0, depth, 8):
        key = eights[order[open_] + at].astype(np.uint64)
        rank = np.lexsort((key, group[open_])) if at else np.argsort(key, kind="stable")
        order[open_], key = order[open_][rank], key[rank]
        own = group[open_]
        change = np.concatenate(([True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])))
        number = np.cumsum(change) - 1
        size = np.bincount(number)
        group[open_] = open_[np.flatnonzero(change)][number]
        open_ = open_[size[number] > 1]
        if not len(open_):
            break
    return order


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of suffix pairs, at most depth."""
    if len(a) == 1:
        x, y = text[a[0] : a[0] + depth], text[b[0] : b[0] + depth]
        n = min(len(x), len(y))
        other = x[:n] != y[:n]
        return np.array([int(other.argmax()) if other.any() else n], np.int32)
    out = np.full(len(a), depth, np.int32)
    open_ = np.arange(len(a))
    eights = _eights(text, depth)
    for at in range(0, depth, 8):
        x, y = (eights[p[open_] + at].astype(np.uint64) for p in (a, b))
        differ = np.flatnonzero(x != y)
        rest = (x ^ y)[differ]
        own = np.zeros(len(differ), np.int32)  # equal bytes in front of the first other one
        for k in range(7, 0, -1):
            own += rest < np.uint64(1 << 8 * k)
        out[open_[differ]] = at + own
        open_ = open_[x == y]
        if not len(open_):
            break
    return np.minimum(out, np.minimum(depth, len(text) - np.maximum(a, b))).astype(np.int32)


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in suffix order to the depth, and each one's common prefix (at most depth) with the one before.

    text: bytes, of which the last must be 0 and occur nowhere else."""
    s_type = types(text)
    starts = _start_order(text, np.flatnonzero(s_type & np.concatenate(([False], ~s_type[:-1]))), depth)
    lcp = common_prefix(text, starts[:-1], starts[1:], depth)
    values = np.unique(text)
    larger = _scan(text, values, starts, np.concatenate(([0], lcp)).astype(np.int32), s_type, depth, up=True)
    held = [larger[v] for v in values.tolist() if v in larger]
    smaller = _scan(text, values, np.concatenate([x for x, _ in held])[::-1], _turned(np.concatenate([y for _, y in held])), s_type, depth, up=False) if held else {}
    order, lcps = [np.array([len(text) - 1])], [np.zeros(1, np.int32)]
    for v in values.tolist():
        parts = [larger[v]] if v in larger else []
        if v in smaller:
            parts.append((smaller[v][0][::-1], _turned(smaller[v][1])))
        for at, own in parts:  # the seam between two runs is compared directly
            order.append(at)
            lcps.append(np.concatenate((common_prefix(text, order[-2][-1:], at[:1], depth), own[1:])))
    return np.concatenate(order), np.concatenate(lcps)


def _turned(lcp: np.ndarray) -> np.ndarray:
    """Common prefixes of the same entries in the opposite order."""
    return np.concatenate(([0], lcp[:0:-1])).astype(np.int32)


def _scan(text, values, seeds, seed_lcp, s_type, depth: int, up: bool) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By first value, the induced suffixes in scan order with common prefixes.

    up: type L from the sorted starts, smallest first; else type S from the sorted L, largest first."""
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    queues = {v: Queue() for v in values.tolist()}
    least = np.full(int(values[-1]) + 1, depth, np.int32)  # least common prefix passed since a queue's last entry
    fresh = np.ones(int(values[-1]) + 1, bool)
    last = np.zeros(0, np.int64)

    def hand_on(at: np.ndarray, lcp: np.ndarray) -> None:
        """Pass entries: put left neighbours of the wanted type into their queues."""
        before = at - 1
        first = np.where((before >= 0) & (s_type[before] != up), text[before], np.uint8(0))  # 0 is no left neighbour's
        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 1) :]
        kinds, begins = np.unique(first[order], return_index=True)
        passed = np.append(lcp, np.int32(depth))
        before_least = least.copy()
        np.minimum(least, lcp.min(), out=least)
        if not len(order):
            return
        early = np.minimum.accumulate(lcp)
        late = np.minimum.accumulate(passed[::-1])[::-1]
        for v, where in zip(kinds.tolist(), np.split(order, begins[1:]), strict=True):
            own = np.zeros(len(where), np.int32)
            if not fresh[v]:
                own[0] = min(int(before_least[v]), int(early[where[0]])) + 1
            if len(where) > 1:
                own[1:] = np.minimum.reduceat(passed, np.stack((where[:-1] + 1, where[1:] + 1), axis=1).ravel())[::2] + 1
            queues[v].put(before[where], np.minimum(own, depth))
            least[v], fresh[v] = late[where[-1] + 1], False

    seed_value = text[seeds] if up else -text[seeds].astype(np.int64)
    for v in (values if up else values[::-1]).tolist():
        low, high = np.searchsorted(seed_value, [v if up else -v, (v if up else -v) + 1])
        got = []
        more = True
        while more:  # entries of the queue may put more into it
            more = False
            for at, lcp in queues[v].take():
                more = True
                got.append((at, lcp))
                lcp = np.concatenate((common_prefix(text, last, at[:1], depth) if len(last) else lcp[:1] * 0, lcp[1:])) if len(got) == 1 else lcp
                hand_on(at, lcp)
                last = at[-1:]
        if high > low:
            at = seeds[low:high]
            lcp = np.concatenate((common_prefix(text, last, at[:1], depth) if len(last) else seed_lcp[:1] * 0, seed_lcp[low + 1 : high]))
            hand_on(at, lcp)
            last = at[-1:]
        if got:
            out[v] = np.concatenate([x for x, _ in got]), np.concatenate([y for _, y in got])
    return out
