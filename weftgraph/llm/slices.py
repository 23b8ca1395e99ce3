"""Equal slices of one code-point array, found with array operations."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Odd, so it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def distinct_slices(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class number of each slice, a slice of each class, its hash); slices of a class are equal.

    Rolling hashes group the slices; every slice is then compared in full with the first of
    its class, and those that differ (a hash collision) become classes of their own, so two
    classes may be equal but unequal slices never share one.
    """
    room = 1 << max(10, int(len(cps)).bit_length())
    powers, inverse = _powers(_BASE, room), _powers(_INVERSE, room)
    sums = np.zeros(len(cps) + 1, np.uint64)
    mixed = (cps.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    np.cumsum(mixed * powers[: len(cps)], out=sums[1:])
    length = ends - starts
    key = (sums[ends] - sums[starts]) * inverse[starts] + length.astype(np.uint64)
    encoded = pa.array(key).dictionary_encode()  # by hashing, in the order of first places
    which = np.asarray(encoded.indices).astype(np.int64)
    first = np.zeros(len(encoded.dictionary), np.int64)
    first[which[::-1]] = np.arange(len(starts) - 1, -1, -1)
    rep = first[which]
    bad = length != length[rep]
    # compare every code point of a slice with the one at its place in the class's first slice
    shift = np.where(bad, 0, starts[rep] - starts).astype(np.int32)
    covered = np.where(bad, 0, length)
    if len(starts) and int(covered.sum()) == int(ends[-1] - starts[0]) and (starts[1:] == ends[:-1]).all():
        inside = np.arange(starts[0], ends[-1], dtype=np.int32)  # the slices cover the array without gaps
        mine = cps[starts[0] : ends[-1]]
    else:
        inside = np.repeat((starts - (np.cumsum(covered) - covered)).astype(np.int32), covered) + np.arange(int(covered.sum()), dtype=np.int32)
        mine = cps[inside]
    off = mine != cps[inside + np.repeat(shift, covered)]
    if off.any():
        bad |= np.bincount(np.repeat(np.arange(len(starts)), covered)[off], minlength=len(starts)) > 0
    odd = np.flatnonzero(bad)
    which[odd] = len(first) + np.arange(len(odd))
    first = np.concatenate([first, odd])
    return which, first, (key[first] >> np.uint64(1)).astype(np.int64)
