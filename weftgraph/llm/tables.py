"""Array-backed tables of a worker: an integer hash table, a two-generation cache of lists, and pair merging over rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Odd multiplier of the hash (fixed value, 2**64 divided by the golden ratio).
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class KeyTable:
    """Non-negative 64-bit keys to 32-bit values by open addressing; all operations take arrays."""

    def __init__(self, room: int = 1 << 12):
        self._empty(max(8, int(room - 1).bit_length()))

    def _empty(self, bits: int) -> None:
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values, self.n = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where it is absent."""
        out = np.full(len(keys), -1, np.int32)
        left, slots = np.arange(len(keys)), self._slots(keys)
        while len(left):
            there = self.keys[slots]
            hit = there == keys[left]
            out[left[hit]] = self.values[slots[hit]]
            go = ~hit & (there >= 0)
            left, slots = left[go], (slots[go] + 1) & self.mask
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that are absent."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            used = self.keys >= 0
            old_keys, old_values = self.keys[used], self.values[used]
            self._empty(int(2 * (self.n + len(keys))).bit_length() + 1)
            self.put(old_keys, old_values)
        self.n += len(keys)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[free]  # of several keys for one slot the last stays
            done = self.keys[slots] == keys
            self.values[slots[done]] = values[done]
            keys, values, slots = keys[~done], values[~done], (slots[~done] + 1) & self.mask


class Grown:
    """An array that grows at its end."""

    def __init__(self, dtype: type, room: int = 1024):
        self.data, self.n = np.zeros(room, dtype), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(max(len(self.data), len(more)), self.data.dtype)])
        self.data[self.n : self.n + len(more)] = more
        self.n += len(more)


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices values[start : start + length], one after another."""
    total = np.cumsum(lengths)
    n = int(total[-1]) if len(total) else 0
    return values[np.repeat(starts - total + lengths, lengths) + np.arange(n)]


class _Generation:
    """Words as code points, found by their hash and compared in full, and the list of each."""

    def __init__(self) -> None:
        self.n, self.place = 0, KeyTable()
        self.points, self.point_start, self.point_length = Grown(np.uint16), Grown(np.int64), Grown(np.int64)
        self.values, self.start, self.length = Grown(np.int32), Grown(np.int64), Grown(np.int64)

    def find(self, cps: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Row of each slice, -1 if it is not held."""
        at = self.place.get(hashes).astype(np.int64)
        same = at >= 0
        same[same] = self.point_length.data[at[same]] == lengths[same]
        there, n = at[same], lengths[same]
        off = gather(cps, starts[same], n) != gather(self.points.data, self.point_start.data[there], n)
        if off.any():
            same[np.flatnonzero(same)[np.unique(np.repeat(np.arange(len(n)), n)[off])]] = False
        return np.where(same, at, -1)

    def add(self, cps: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Rows of the added slices; one whose hash is taken is held but never found again."""
        self.point_start.add(self.points.n + np.cumsum(lengths) - lengths)
        self.point_length.add(lengths)
        points = gather(cps, starts, lengths)
        if self.points.data.dtype == np.uint16 and points.max(initial=0) > 0xFFFF:
            self.points.data = self.points.data.astype(np.int32)
        self.points.add(points)
        self.start.add(self.values.n + np.cumsum(counts) - counts)
        self.length.add(counts)
        self.values.add(values)
        rows = self.n + np.arange(len(starts))
        self.n += len(starts)
        keys, first = np.unique(hashes, return_index=True)
        free = self.place.get(keys) < 0
        self.place.put(keys[free], rows[first[free]].astype(np.int32))
        return rows


class ListCache:
    """Integer lists by word, made by `make` (words -> flat values, lengths) when first seen.

    Words are kept in two generations of `most` words or 16 times as many code points: a full young one becomes the old one, and what is asked for
    again moves from the old to the young, so words in use are never made twice in a row of steps.
    Results do not depend on it.
    """

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int):
        self.make, self.most = make, most
        self.young, self.old = _Generation(), _Generation()

    def take(self, joined: str, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(values, start of each slice's list in them, its length) of slices of the text `joined`."""
        if self.young.n > self.most or self.young.points.n > 16 * self.most:
            self.old, self.young = self.young, _Generation()
        young, old, lengths = self.young, self.old, ends - starts
        at = young.find(cps, starts, lengths, hashes)
        left = np.flatnonzero(at < 0)
        if len(left):
            there = old.find(cps, starts[left], lengths[left], hashes[left])
            held = there >= 0
            some, there = left[held], there[held]
            if len(some):
                counts = old.length.data[there]
                at[some] = young.add(cps, starts[some], lengths[some], hashes[some], gather(old.values.data, old.start.data[there], counts), counts)
            new = left[~held]
            if len(new):
                made = self.make([joined[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())])
                at[new] = young.add(cps, starts[new], lengths[new], hashes[new], *made)
        return young.values.data, young.start.data[at], young.length.data[at]


def by_length(lengths: np.ndarray, cells: int = 1 << 17) -> list[np.ndarray]:
    """Row numbers in chunks of like lengths, each of about `cells` cells in a padded matrix."""
    order = np.argsort(lengths, kind="stable")
    out, at = [], 0
    while at < len(order):
        # rows are ascending, so the widest of a chunk is its last: shrink until it fits
        take = max(1, cells // max(1, int(lengths[order[at]])))
        chunk = order[at : at + take]
        fit = max(1, cells // max(1, int(lengths[chunk[-1]])))
        out.append(chunk[:fit])
        at += len(out[-1])
    return out


def padded(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, fill: int) -> np.ndarray:
    """Matrix of the slices values[start : start + length], one in a row."""
    width = int(lengths.max(initial=0))
    inside = np.arange(width) < lengths[:, None]
    out = np.full(inside.shape, fill, values.dtype)
    out[inside] = gather(values, starts, lengths)
    return out


def merge_rows(symbols: np.ndarray, lengths: np.ndarray, joins: KeyTable, size: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows, number of each row's) after byte-pair merging of every row at once.

    symbols: padded matrix of ids below `size`; joins: a * size + b -> id of the joined pair; rank: the
    merge order of an id. Each round joins, in every row, the adjacent pair of lowest rank (leftmost first).
    """
    rows, width = symbols.shape
    ids = symbols.astype(np.int64)
    none = np.iinfo(np.int32).max
    order = np.full((rows, width), none, np.int32)
    joined = np.zeros((rows, width), np.int32)
    column = np.arange(width)
    alive = column < lengths[:, None]
    after, before = np.tile(column + 1, (rows, 1)), np.tile(column - 1, (rows, 1))

    def offer(r: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        found = joins.get(ids[r, i] * size + ids[r, j])
        joined[r, i] = found
        order[r, i] = np.where(found < 0, none, rank[found])

    offer(*(lambda r, i: (r, i, i + 1))(*np.nonzero(alive[:, 1:])))
    active = np.arange(rows)
    while len(active):
        work = order if len(active) == rows else order[active]
        i = work.argmin(axis=1)
        go = work[np.arange(len(active)), i] != none
        active, i = active[go], i[go]
        if not len(active):
            break
        j = after[active, i]
        k = after[active, j]
        ids[active, i] = joined[active, i]
        alive[active, j] = False
        order[active, j] = none
        order[active, i] = none
        after[active, i] = k
        inner = k < lengths[active]
        before[active[inner], k[inner]] = i[inner]
        offer(active[inner], i[inner], k[inner])
        h = before[active, i]
        left = h >= 0
        offer(active[left], h[left], i[left])
    return ids[alive].astype(np.int32), alive.sum(axis=1)
