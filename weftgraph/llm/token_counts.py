"""Operator 7: exact token counts at every prefix of a text, by dynamic programming.

For BPE, the encoding of a prefix ends in exactly one token t such that t is compatible with
the last token of the encoding of the shorter prefix before t (their concatenation encodes to
just these two). So last(p) and count(p) of every prefix p follow from shorter prefixes:
count(p) = count(p without t) + 1. No prefix is encoded again, and truncation or budget
questions are lookups in the stored counts.

The vocabulary has no piece that goes on from a word into a blank (checked when a model is
loaded), so merges never cross the start of a run of blanks; counts of such segments add up,
and each distinct segment's table is kept by the worker (bounded cache). The tables of all
unseen segments of a step are computed together: a trie walk finds the pieces that start at every
place, and each prefix takes its longest last piece whose seam with the one before is stable.

Cases: a null text counts as empty: its only prefix has 0 tokens; texts of any length are
taken whole; repeated rows stay; an empty table gives an empty table; other columns pass
through, but an input column named like the output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.bpe import appended, int_lists
from weftgraph.llm.common import bounded_batches, fresh, steps, with_fields
from weftgraph.llm.pretokenize import END, code_points
from weftgraph.llm.slices import distinct_slices
from weftgraph.llm.tables import KeyTable, ListCache, by_length, gather, merge_rows, padded

#: The library's mark for a blank (fixed value).
MARK = "▁"
#: Segments of one of a worker's two cache generations, and pairs of pieces whose seam is remembered (results depend on neither).
CACHE_SEGMENTS, CACHE_PAIRS = 200_000, 2_000_000
#: Code points of the segments that are computed many at a time (longer ones are computed alone), and cells of such a matrix.
JOINT_POINTS, JOINT_CELLS = 64, 1 << 18


class PieceModel:
    """Merges and prefix counts of one BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score = {
            library.id_to_piece(i): library.get_score(i)
            for i in range(library.get_piece_size())
            if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))
        }
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("this model merges across blanks")
        self.pieces = list(self.score)
        self.longest = max(map(len, self.pieces))
        self.pairs: dict[tuple[str, str], bool] = {}
        self._tables()
        self.cache = ListCache(self.prefix_tables, CACHE_SEGMENTS)

    def _tables(self) -> None:
        """The vocabulary as arrays: code points, a trie of the pieces, and the joins of two symbols to a piece."""
        symbols = list(dict.fromkeys([*self.pieces, *(ch for p in self.pieces for ch in p)]))
        number = {x: i for i, x in enumerate(symbols)}
        self.size = len(symbols)
        chars = [x for x in symbols if len(x) == 1]
        self.char_of = np.full(END + 1, -1, np.int32)  # code point -> number of a code point of the vocabulary
        self.char_of[list(map(ord, chars))] = np.arange(len(chars))
        self.char_symbol = np.array([number[x] for x in chars], np.int64)
        self.is_piece = np.array([x in self.score for x in chars] + [False])  # by char number; the last is for none
        self.order = np.zeros(self.size, np.int32)  # merge order: equal scores are equal
        scores = sorted({-v for v in self.score.values()})
        at = {v: i for i, v in enumerate(scores)}
        self.order[: len(self.pieces)] = [at[-self.score[p]] for p in self.pieces]
        found = [(number[a] * self.size + number[b], i) for i, p in enumerate(self.pieces) for k in range(1, len(p)) if (a := p[:k]) in number and (b := p[k:]) in number]
        self.joins = KeyTable(2 * len(found))
        self.joins.put(np.array([k for k, _ in found], np.int64), np.array([i for _, i in found], np.int32))
        nodes: dict[tuple[int, str], int] = {}
        piece_at = [-1]
        for i, p in enumerate(self.pieces):
            node = 0
            for ch in p:
                if (node, ch) not in nodes:
                    nodes[node, ch] = len(piece_at)
                    piece_at.append(-1)
                node = nodes[node, ch]
            piece_at[node] = i
        self.width, char = len(chars), {x: i for i, x in enumerate(chars)}
        self.piece_at = np.array(piece_at, np.int32)
        self.steps = KeyTable(2 * len(nodes))
        self.steps.put(np.array([n * self.width + char[c] for n, c in nodes], np.int64), np.array(list(nodes.values()), np.int32))
        points = [[char[ch] for ch in p] for p in self.pieces]
        self.piece_length = np.array(list(map(len, points)), np.int64)
        self.piece_start = np.cumsum(self.piece_length) - self.piece_length
        self.piece_chars = np.array([x for y in points for x in y], np.int64)
        self.known = KeyTable(1 << 16)

    def parts(self, symbols: list[str]) -> list[str]:
        """Join the adjacent pair of highest score (leftmost first) until none is left."""
        get, none = self.score.get, -float("inf")
        pairs = [get(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while pairs:
            best = max(pairs)
            if best == none:
                break
            i = pairs.index(best)
            symbols[i] += symbols.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = get(symbols[i - 1] + symbols[i], none)
            if i < len(pairs):
                pairs[i] = get(symbols[i] + symbols[i + 1], none)
        return symbols

    def compatible(self, a: str, b: str) -> bool:
        key = (a, b)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            # both are vocabulary pieces that encode to themselves, so the seam decides
            known = self.pairs[key] = self.parts([*a, *b]) == [a, b]
        return known

    def compatibles(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`compatible` of many pairs of pieces: seams that are not known yet are merged all at once."""
        keys = a * self.size + b
        got = self.known.get(keys)
        new = np.unique(keys[got < 0])
        if len(new):
            if self.known.n > CACHE_PAIRS:
                self.known = KeyTable(1 << 16)
            x, y = new // self.size, new % self.size
            lengths = self.piece_length[x] + self.piece_length[y]
            good = np.zeros(len(new), np.int32)
            for rows in by_length(lengths):
                u, v = x[rows], y[rows]
                both = np.stack([self.piece_length[u], self.piece_length[v]], axis=1).ravel()
                chars = gather(self.piece_chars, np.stack([self.piece_start[u], self.piece_start[v]], axis=1).ravel(), both)
                ends = np.cumsum(lengths[rows])
                ids, per = merge_rows(padded(self.char_symbol[chars], ends - lengths[rows], lengths[rows], 0), lengths[rows], self.joins, self.size, self.order)
                two = per == 2
                at = (np.cumsum(per) - per)[two]
                good[rows[two]] = (ids[at] == u[two]) & (ids[at + 1] == v[two])
            self.known.put(new, good)
            got = self.known.get(keys) if len(new) < len(keys) else good[np.searchsorted(new, keys)]
        return got > 0

    def prefix_counts(self, segment: str) -> list[int]:
        """Token counts of the prefixes of 1, 2, ... code points of a segment, one prefix after another."""
        score, longest, pairs = self.score, self.longest, self.pairs
        last: list[str] = [""]
        count = [0]
        for end in range(1, len(segment) + 1):
            ch = segment[end - 1]
            if ch not in score:  # bytes instead of a piece; they merge with nothing
                last.append("")
                count.append(count[-1] + len(ch.encode("utf-8")))
                continue
            for begin in range(end - longest if end > longest else 0, end):
                piece = segment[begin:end]
                if piece in score:
                    before = last[begin]
                    if not before or (pairs[before, piece] if (before, piece) in pairs else self.compatible(before, piece)):
                        last.append(piece)
                        count.append(count[begin] + 1)
                        break
            else:
                raise AssertionError("no last token")
        return count[1:]

    def _joint_counts(self, points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The same for a padded matrix of code points, all rows at once: prefixes of 1, 2, ... points."""
        rows, width = points.shape
        chars = self.char_of[points]
        inside = np.arange(width) < lengths[:, None]
        chars[~inside] = -1
        # pieces that start at each place, by their length: walk the trie from all places together
        piece = np.full((min(self.longest, width), rows, width), -1, np.int32)
        row, col = np.nonzero(chars >= 0)
        node = np.zeros(len(row), np.int64)
        for k in range(len(piece)):
            at = col + k
            fit = at < width
            row, col, node, at = row[fit], col[fit], node[fit], at[fit]
            ch = chars[row, at]
            node = self.steps.get(node * self.width + ch)
            go = (node >= 0) & (ch >= 0)
            row, col, node = row[go], col[go], node[go].astype(np.int64)
            piece[k, row, col] = self.piece_at[node]
        size = np.where(points < 0x80, 1, np.where(points < 0x800, 2, np.where(points < 0x10000, 3, 4)))
        single = self.is_piece[chars]
        last = np.full((rows, width + 1), -1, np.int64)
        count = np.zeros((rows, width + 1), np.int32)
        for end in range(1, width + 1):
            here = inside[:, end - 1]
            alone = np.flatnonzero(here & ~single[:, end - 1])  # bytes instead of a piece; they merge with nothing
            count[alone, end] = count[alone, end - 1] + size[alone, end - 1]
            left = np.flatnonzero(here & single[:, end - 1])
            # the pieces that end here, longest first: every row tries its next one until one fits
            begins = np.arange(max(0, end - len(piece)), end)
            own = piece[end - begins - 1, left[:, None], begins]
            while len(left):
                first = (own >= 0).argmax(axis=1)
                p = own[np.arange(len(left)), first].astype(np.int64)
                if p.min() < 0:
                    raise AssertionError("no last token")
                begin = begins[first]
                before = last[left, begin]
                fits = before < 0
                seam = np.flatnonzero(~fits)
                fits[seam] = self.compatibles(before[seam], p[seam])
                r = left[fits]
                last[r, end] = p[fits]
                count[r, end] = count[r, begin[fits]] + 1
                own[np.arange(len(left)), first] = -1
                left, own = left[~fits], own[~fits]
        return count[:, 1:][inside]

    def prefix_tables(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(prefix counts of all segments, one after another; length of each). Blanks stand for the mark."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int32)
        points[points == 0x20] = ord(MARK)
        starts = np.cumsum(lengths) - lengths
        out = np.zeros(len(points), np.int32)
        short = np.flatnonzero(lengths <= JOINT_POINTS)
        for chunk in by_length(lengths[short], JOINT_CELLS):
            rows = short[chunk]
            counts = self._joint_counts(padded(points, starts[rows], lengths[rows], 0), lengths[rows])
            out[np.repeat(starts[rows] - (np.cumsum(lengths[rows]) - lengths[rows]), lengths[rows]) + np.arange(len(counts))] = counts
        for r in np.flatnonzero(lengths > JOINT_POINTS).tolist():
            out[starts[r] : starts[r] + lengths[r]] = self.prefix_counts(words[r].replace(" ", MARK))
        return out, lengths

    def _segments(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """(prefix counts, start and length of each segment's table in them, first segment and entries of each text, text of each segment)."""
        joined, cps, stops = code_points([" " + t for t in texts])
        mark = (cps == 0x20) | (cps == ord(MARK))
        begins = mark.copy()
        begins[1:] &= ~mark[:-1]
        begins[0] = True
        begins[stops] = True
        heads = np.append(0, stops[:-1] + 1)
        begins[heads] = True
        bounds = np.flatnonzero(begins)
        ends = np.append(bounds[1:], len(cps))
        real = cps[bounds] != END
        starts, ends = bounds[real], ends[real]
        which, one, hashes = distinct_slices(cps, starts, ends)
        values, start, length = self.cache.take(joined, cps, starts[one], ends[one], hashes)
        return values, start[which], length[which], np.searchsorted(starts, heads), np.diff(stops, prepend=-1) - 1, np.searchsorted(stops, starts)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(counts of the prefixes of 0, 1, 2, ... code points of every text, entries of each text)."""
        values, start, length, first, entries, text_of = self._segments(texts)
        whole = np.cumsum(values[start + length - 1])
        before = whole - values[start + length - 1]
        counts = gather(values, start, length) + np.repeat(before - before[first][text_of], length).astype(np.int32)
        counts[np.cumsum(entries) - entries] = 0  # the prefix of no code points, instead of the leading mark
        return counts, entries

    def totals(self, texts: list[str]) -> np.ndarray:
        """The last entry of each text's prefix counts."""
        values, start, length, _, entries, text_of = self._segments(texts)
        total = np.bincount(text_of, values[start + length - 1], minlength=len(texts)).astype(np.int64)
        return np.where(entries > 1, total, 0)


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def prefix_token_counts(df: DataFrame, path: str, text: str = "text", counts: str = "prefix_tokens", keep: list[str] | None = None) -> DataFrame:
    """Adds `counts` (array<int>): element k is the token count of the first k code points."""
    kept = df.columns if keep is None else keep
    schema = with_fields(df.select(*kept).schema, T.StructField(counts, T.ArrayType(T.IntegerType())))
    names = schema.names
    source = fresh(df, "text")
    bounded_batches(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(source).to_pylist()]
            for a, b in steps([len(x) for x in texts]):
                got, per = model.encode(texts[a:b])
                yield appended(batch.slice(a, b - a), names, **{counts: int_lists(got, per)})

    return df.select(*[c for c in kept if c in names and c != counts], df[text].cast("string").alias(source)).mapInArrow(run, schema)


def token_totals(df: DataFrame, path: str, text: str = "text", total: str = "n_tokens", keep: list[str] | None = None) -> DataFrame:
    """Adds `total` (long): the last prefix count of each text; the prefix tables stay in the workers."""
    kept = df.columns if keep is None else keep
    schema = with_fields(df.select(*kept).schema, T.StructField(total, T.LongType()))
    names = schema.names
    source = fresh(df, "text")
    bounded_batches(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(source).to_pylist()]
            for a, b in steps([len(x) for x in texts]):
                yield appended(batch.slice(a, b - a), names, **{total: pa.array(model.totals(texts[a:b]))})

    return df.select(*[c for c in kept if c in names and c != total], df[text].cast("string").alias(source)).mapInArrow(run, schema)


def total_tokens(counts: str) -> Column:
    return F.element_at(counts, -1).cast("long")


def longest_prefix(counts: str, budget: int) -> Column:
    """Code points of the longest prefix of at most `budget` tokens (a longer prefix may have fewer tokens than a shorter one)."""
    return F.array_size(counts) - 1 - F.array_position(F.reverse(F.transform(counts, lambda n: n <= F.lit(budget))), True) + 1
