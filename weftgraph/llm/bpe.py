"""Operator 1: byte-level BPE encoding and decoding.

Boundaries come from `pretokenize`; each piece's ids come from a bounded per-worker cache
filled by lowest-rank pair merging. Ids of a batch are gathered from the cache with array
operations; byte offsets of every token are kept, and decoding is the reverse gather.

Cases: a null text counts as empty (no ids, decoded to no bytes); texts of any length are
taken whole; repeated rows stay; an empty table gives an empty table; other columns pass
through, but input columns named like an output column are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weftgraph.llm.common import bounded_batches, fresh, steps, with_fields
from weftgraph.llm.pretokenize import code_points, pieces
from weftgraph.llm.slices import distinct_slices
from weftgraph.llm.tables import KeyTable, ListCache, by_length, gather, merge_rows, padded

#: Pieces a generation of a worker's cache holds (results do not depend on it).
CACHE_PIECES = 200_000
#: Bytes of the pieces that are merged many at a time; longer ones are merged alone.
JOINT_BYTES = 64


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token, blank, rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: join the adjacent pair of lowest rank (leftmost first) until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > 200:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    get = ranks.get
    none = len(ranks) + 1_000_000
    pairs = [get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pairs:
        best = min(pairs)
        if best == none:
            break
        i = pairs.index(best)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap over a linked list: n log n for pieces of any length."""
    import heapq

    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that starts here; 0: joined to the left
    prev = list(range(-1, n - 1))
    heap = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, j, end[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if end[i] != j or end[j] != k:
            continue
        end[i], end[j] = k, 0
        if k < n:
            prev[k] = i
            offer(i)
        if prev[i] >= 0:
            offer(prev[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class PieceEncoder:
    """Ids of texts from the ids of their pieces; `make` (unseen pieces -> flat ids, numbers of ids) fills a bounded cache."""

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = CACHE_PIECES):
        self.cache = ListCache(make, most)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        joined, cps, stops = code_points(texts)
        starts, ends, per = pieces(cps, stops)
        which, first, hashes = distinct_slices(cps, starts, ends)
        values, start, length = self.cache.take(joined, cps, starts[first], ends[first], hashes)
        lengths = length[which]
        flat = gather(values, start[which], lengths)
        until = np.concatenate([[0], np.cumsum(lengths)])
        return flat, np.diff(until[np.cumsum(per)], prepend=0)


class ByteBPE:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str):
        self.ranks = ranks = load_ranks(path)
        size = max(ranks.values(), default=-1) + 1
        self.size = np.zeros(size, np.int64)
        tokens = [b""] * size
        for token, i in ranks.items():
            tokens[i] = token
            self.size[i] = len(token)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.at = np.cumsum(self.size) - self.size
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.order = np.arange(size, dtype=np.int32)  # an id is its rank
        self.cache = PieceEncoder(self.merged)

    @cached_property
    def joins(self) -> KeyTable:
        """a * size + b -> id of two joined tokens; made when a worker first encodes."""
        size, ranks = len(self.size), self.ranks
        found = ((ranks[a] * size + ranks[b], i) for t, i in ranks.items() for k in range(1, len(t)) if (a := t[:k]) in ranks and (b := t[k:]) in ranks)
        both = np.fromiter(found, "i8,i4")
        table = KeyTable(2 * len(both))
        table.put(both["f0"], both["f1"])
        return table

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces, number of each): whole tokens, the rest by pair merging."""
        raw = [w.encode("utf-8") for w in words]
        get = self.ranks.get
        whole = [get(x) for x in raw]
        parts: list[np.ndarray | list[int] | None] = [None if i is None else [i] for i in whole]
        joint = [k for k, i in enumerate(whole) if i is None and len(raw[k]) <= JOINT_BYTES]
        lengths = np.fromiter((len(raw[k]) for k in joint), np.int64, len(joint))
        symbols = self.byte_id[np.frombuffer(b"".join([raw[k] for k in joint]), np.uint8)]
        starts = np.cumsum(lengths) - lengths
        for rows in by_length(lengths):
            ids, per = merge_rows(padded(symbols, starts[rows], lengths[rows], 0), lengths[rows], self.joins, len(self.size), self.order)
            for k, one in zip(rows.tolist(), np.split(ids, np.cumsum(per)[:-1])):
                parts[joint[k]] = one
        parts = [merge(raw[k], self.ranks) if x is None else x for k, x in enumerate(parts)]
        return np.concatenate(parts).astype(np.int32, copy=False), np.fromiter(map(len, parts), np.int64, len(parts))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, byte offset of each in its text, number of ids of each text)."""
        ids, per = self.cache.encode(texts)
        size = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        offset = ends[:-1] - np.repeat(ends[np.cumsum(per) - per], per)
        return ids, offset.astype(np.int32), per

    def decode(self, ids: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all rows, number of bytes of each); an id outside the vocabulary raises."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size) or not self.size[ids].all()):
            raise ValueError("id outside the vocabulary")
        size = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        return gather(self.bytes, self.at[ids], size), np.diff(ends[np.cumsum(per)], prepend=0)


@lru_cache(maxsize=4)
def codec(path: str) -> ByteBPE:
    return ByteBPE(path)


def int_lists(values: np.ndarray, per: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), pa.array(values.astype(np.int32, copy=False)))


def appended(batch: pa.RecordBatch, names: list[str], **columns: pa.Array) -> pa.RecordBatch:
    """`batch` with `columns` put in by name, in the order of `names`."""
    return pa.RecordBatch.from_arrays([columns[n] if n in columns else batch.column(n) for n in names], names)


def bpe_encode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, ids: str = "ids", offsets: str = "token_offsets") -> DataFrame:
    """Adds `ids` (array<int>) and `offsets` (byte offset of each token in the UTF-8 text).

    `keep`: the input columns to carry (default all).
    """
    kept = df.columns if keep is None else keep
    schema = with_fields(df.select(*kept).schema, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(offsets, T.ArrayType(T.IntegerType())))
    names = schema.names
    source = fresh(df, "text")
    bounded_batches(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(source).to_pylist()]
            for a, b in steps([len(x) for x in texts]):
                got, offset, per = bpe.encode(texts[a:b])
                yield appended(batch.slice(a, b - a), names, **{ids: int_lists(got, per), offsets: int_lists(offset, per)})

    return df.select(*[c for c in kept if c in names and c not in (ids, offsets)], df[text].cast("string").alias(source)).mapInArrow(run, schema)


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Adds `decoded` (binary), the bytes of the tokens of `ids`; null ids decode to no bytes."""
    kept = df.columns if keep is None else keep
    schema = with_fields(df.select(*kept).schema, T.StructField(decoded, T.BinaryType()))
    names = schema.names
    source = fresh(df, "ids")
    bounded_batches(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            column = batch.column(source)
            per = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
            for a, b in steps(per.tolist()):
                part = column.slice(a, b - a)
                values, sizes = bpe.decode(np.asarray(part.flatten()), per[a:b])
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                out = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(values)])
                yield appended(batch.slice(a, b - a), names, **{decoded: out})

    return df.select(*[c for c in kept if c in names and c != decoded], df[ids].alias(source)).mapInArrow(run, schema)
