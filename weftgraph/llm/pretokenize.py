"""Vectorised pre-tokenisation: piece boundaries of a byte-level BPE pattern without a regex.

Every code point has a class (letter, number, other, space ...). A piece automaton reads one
symbol per code point; each symbol is a *transition function* on the automaton's states.
Composition of such functions is associative, so the state before every code point of a
whole batch comes from one blocked prefix scan over small function ids, and a boundary is a
lookup on (state, symbol).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import tiktoken

#: The pattern whose matches this automaton finds (fixed value of the public tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Not a code point: ends each document in a batch.
END = 0x110000

LETTER, NUMBER, OTHER, SPACE, BLANK, STOP = range(6)
# symbols: the first three as above, then
CONTRACT1, CONTRACT2 = 3, 4  # an apostrophe before s t m d / re ve ll
JOIN, LONE, RUN, HALT = 5, 6, 7, 8  # last space of a run, last other blank, inner blank, document end
SYMBOLS = 9
# states: nothing open, in letters, in numbers, in others, in blanks, after a joining space, contraction letters to come
FREE, IN_L, IN_N, IN_O, IN_W, JOINED, LEFT1, LEFT2 = range(8)
STATES = 8
#: Room for the ids of composed functions (there are a few dozen).
WIDTH = 64

#: symbol -> (default next state, {state: next state} exceptions, states that the symbol continues)
_MOVES = {
    LETTER: (IN_L, {LEFT2: LEFT1, LEFT1: FREE}, {IN_L, JOINED, LEFT1, LEFT2}),
    NUMBER: (IN_N, {}, {IN_N, JOINED}),
    OTHER: (IN_O, {}, {IN_O, JOINED}),
    CONTRACT1: (LEFT1, {IN_O: IN_O, JOINED: IN_O}, {IN_O, JOINED}),
    CONTRACT2: (LEFT2, {IN_O: IN_O, JOINED: IN_O}, {IN_O, JOINED}),
    JOIN: (JOINED, {}, set()),
    LONE: (FREE, {}, set()),
    RUN: (IN_W, {}, {IN_W}),
    HALT: (FREE, {}, set()),
}


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point, and STOP at END.

    The library to match defines the classes by its own Unicode tables, so each class is
    asked of it once: an encoder whose pattern is the class returns only its members' bytes.
    """
    out = np.full(END + 1, OTHER, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, END))))
    single = {bytes([i]): i for i in range(256)}
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        own = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        members = bytes(own.encode_ordinary(every)).decode("utf-8")
        out[np.frombuffer(members.encode("utf-32-le"), np.uint32)] = kind
    out[0x20] = SPACE
    out[END] = STOP
    return out


@lru_cache(maxsize=1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(function id of each symbol, flat composition table, flat function-by-state table, boundary table)."""
    gens = []
    bound = np.ones((STATES, SYMBOLS), bool)
    for sym in range(SYMBOLS):
        to, odd, on = _MOVES[sym]
        gens.append(tuple(odd.get(s, to) for s in range(STATES)))
        for s in on:
            bound[s, sym] = False
    known = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(STATES)), *gens]))}
    todo = list(known)
    while todo:  # closure under composition: a few dozen functions
        f = todo.pop()
        for g in gens:
            h = tuple(g[x] for x in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    fs = list(known)
    assert len(fs) <= WIDTH
    comp = np.zeros((WIDTH, WIDTH), np.uint16)
    for i, f in enumerate(fs):
        for j, g in enumerate(fs):
            comp[i, j] = known[tuple(g[x] for x in f)]
    return (np.array([known[g] for g in gens], np.uint16), comp.ravel(), np.array(fs, np.uint8).ravel(), bound.ravel())


def _scan(f: np.ndarray, comp: np.ndarray, block: int = 32) -> np.ndarray:
    """Inclusive prefix composition of function ids."""
    if len(f) <= block:
        out = f.copy()
        for i in range(1, len(f)):
            out[i] = comp[int(out[i - 1]) * WIDTH + int(f[i])]
        return out
    rows = -(-len(f) // block)
    padded = np.zeros(rows * block, f.dtype)  # id 0 is the identity
    padded[: len(f)] = f
    cols = np.ascontiguousarray(padded.reshape(rows, block).T)
    for j in range(1, block):
        cols[j] = comp[cols[j - 1] * np.uint16(WIDTH) + cols[j]]
    before = np.zeros(rows, f.dtype)
    before[1:] = _scan(cols[-1], comp, block)[:-1]
    before = before * np.uint16(WIDTH)
    for j in range(block):
        cols[j] = comp[before + cols[j]]
    return cols.T.ravel()[: len(f)]


def symbols(cps: np.ndarray) -> np.ndarray:
    """One automaton symbol per code point of a batch whose documents each end in END."""
    kind = classes()[cps]
    nxt = np.empty_like(kind)
    nxt[:-1], nxt[-1] = kind[1:], STOP
    last = nxt < SPACE  # the next code point is no blank and no end
    sym = kind.copy()
    sym[kind == SPACE] = JOIN
    sym[kind == BLANK] = LONE
    sym[(kind >= SPACE) & ~last] = RUN
    sym[kind == STOP] = HALT
    at = np.flatnonzero(cps == 0x27)
    if len(at):
        a = cps[np.minimum(at + 1, len(cps) - 1)]
        b = cps[np.minimum(at + 2, len(cps) - 1)]
        sym[at[np.isin(a, [ord(x) for x in "stmd"])]] = CONTRACT1
        two = np.zeros(len(at), bool)
        for x, y in ("re", "ve", "ll"):
            two |= (a == ord(x)) & (b == ord(y))
        sym[at[two]] = CONTRACT2
    return sym


def code_points(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """(all texts in one string, its code points with END after each text, positions of END)."""
    joined = "\n".join(texts) + "\n"
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    cps[stops] = END
    return joined, cps, stops


def pieces(cps: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece starts, piece ends, number of pieces of each text) of `code_points`."""
    gen, comp, by_state, bound = _monoid()
    sym = symbols(cps)
    after = by_state[_scan(gen[sym], comp) * np.uint16(STATES) + np.uint16(FREE)]
    before = np.empty_like(after)
    before[0], before[1:] = FREE, after[:-1]
    starts = np.flatnonzero(bound[before * np.uint8(SYMBOLS) + sym])
    ends = np.append(starts[1:], len(cps))
    real = sym[starts] != HALT
    per = np.diff(np.searchsorted(starts[real], stops), prepend=0)
    return starts[real], ends[real], per
