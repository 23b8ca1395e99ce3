"""Operator 9: SimHash near-duplicates, linked through pigeonhole blocks.

Fingerprints are computed per document with array operations. Documents with equal
fingerprints collapse to one row before anything is joined. Fingerprints within `radius` bits
differ in at most `radius` of `blocks` bit blocks, so they agree on some choice of
blocks - radius of them: each fingerprint is keyed once per choice, and only fingerprints of a
key are compared. Small groups of a key are compared in full, many at once. In larger ones leaders
absorb what lies within the radius of them, and members of different leaders are compared except pairs
that are connected already or too far apart by the triangle inequality. A key of more than `HEAVY`
fingerprints is not held by one task: its members are dealt to buckets, and every pair of buckets
is a group of its own. A task gives no link between what it has connected already, so links
are at most as many as its rows, and components come from distributed star contraction.

Cases: null and empty texts and texts without words have fingerprint zero and are linked like
any other; texts of any length are taken whole; rows that repeat an id stay; a null id never
names a component unless all its ids are null; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import bounded_batches, cut
from weftgraph.llm.components import connected_components

SEED = 42


def fingerprint(text: str, words: int) -> int:
    """Bits set in over half of the shingle hashes."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and blank and 9 to 13 only
    n = len(parts)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    if n <= words:
        return digest(b" ".join(parts), SEED)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(df: DataFrame, words: int = 3, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, fp (the 64 bits as a signed long) of each row."""
    kind = df.schema[id].dataType.simpleString()
    bounded_batches(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x or "", words) for x in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps.view(np.int64))], ["id", "fp"])

    return df.select(df[id].alias("id"), df[text].cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def block_choices(radius: int, blocks: int, bits: int = 64) -> list[tuple[tuple[int, int], ...]]:
    """(first bit, number of bits) of the blocks of each choice of blocks - radius blocks."""
    edges = [bits * i // blocks for i in range(blocks + 1)]
    each = [(a, b - a) for a, b in zip(edges, edges[1:])]
    return list(combinations(each, blocks - radius))


def block_masks(radius: int, blocks: int) -> list[int]:
    """One mask of bits for each choice of blocks."""
    return [sum(((1 << n) - 1) << a for a, n in chosen) for chosen in block_choices(radius, blocks)]


#: Bits of a block key below the number of its choice.
KEY_BITS = 48


def block_keys(fp: Column, radius: int, blocks: int) -> Column:
    """Array of the keys of a fingerprint: the number of the choice, then the bits of its blocks."""
    out = []
    for i, chosen in enumerate(block_choices(radius, blocks)):
        key, at = F.lit(i << KEY_BITS).cast("long"), 0
        for a, n in chosen:
            part = F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << n) - 1).cast("long"))
            key, at = key.bitwiseOR(F.shiftleft(part, at)), at + n
        if at > KEY_BITS:
            raise ValueError("a choice of blocks has too many bits for a key")
        out.append(key)
    return F.array(*out)


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.top(i), self.top(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


class Near:
    """Whether fingerprints of one or more 64-bit words are within `radius` bits."""

    def __init__(self, radius: int):
        self.radius = radius

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of arrays whose last axis has a fingerprint's words; the other axes are broadcast."""
        gap = np.bitwise_count(x[..., 0] ^ y[..., 0]).astype(np.int64)
        for k in range(1, x.shape[-1]):
            gap += np.bitwise_count(x[..., k] ^ y[..., k])
        return gap <= self.radius


def links(fps: np.ndarray, near: Near) -> list[tuple[int, int]]:
    """Spanning forest of the graph that links close fingerprints (positions in an array of rows of words)."""
    out: list[tuple[int, int]] = []
    forest = Forest(len(fps))
    left = np.arange(len(fps))
    cells: list[tuple[int, np.ndarray]] = []
    while len(left):
        leader = int(left[0])
        close = near(fps[left], fps[leader])
        close[0] = True
        members = left[close]
        for m in members[1:].tolist():
            forest.join(leader, m)
            out.append((leader, m))
        cells.append((leader, members))
        left = left[~close]
    heads, reach = fps[[c[0] for c in cells]], Near(3 * near.radius)
    for k, (leader, members) in enumerate(cells[:-1]):
        for j in (k + 1 + np.flatnonzero(reach(heads[k + 1 :], fps[leader]))).tolist():
            if forest.top(leader) == forest.top(cells[j][0]):
                continue
            hit = _first_link(fps, members, cells[j][1], near)
            if hit and forest.join(*hit):
                out.append(hit)
    return out


def _first_link(fps: np.ndarray, a: np.ndarray, b: np.ndarray, near: Near, room: int = 1 << 20) -> tuple[int, int] | None:
    """A pair of the two sets that is close, compared in blocks of bounded size."""
    step = max(1, room // len(b))
    for i in range(0, len(a), step):
        rows = a[i : i + step]
        close = near(fps[rows][:, None], fps[b][None, :])
        if close.any():
            x, y = divmod(int(np.argmax(close)), len(b))
            return int(rows[x]), int(b[y])
    return None


#: Rows of a key that are compared in full with others; rows of a key above which it is dealt to buckets of `BUCKET` rows.
SMALL, HEAVY, BUCKET = 32, 16_384, 4_096


class Linker:
    """Links of the keys of one task, each key's rows one after another."""

    def __init__(self, near: Near):
        self.near, self.up = near, {}

    def _top(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    def _joined(self, pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
        """Pairs that connect what this task had not connected yet."""
        out = []
        for x, y in pairs:
            a, b = self._top(x), self._top(y)
            if a != b:
                self.up[max(a, b)] = min(a, b)
                out.append((x, y))
        return out

    def of_keys(self, keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
        """Links of whole keys; keys are sorted."""
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts, ends = np.append(0, cuts), np.append(cuts, len(keys))
        size = ends - starts
        out: list[tuple[int, int]] = []
        few = np.repeat((size > 1) & (size <= SMALL), size)
        k, n, f = keys[few], nodes[few], fps[few]
        for shift in range(1, SMALL):
            same = np.flatnonzero(k[shift:] == k[:-shift])
            if not len(same):
                break
            close = same[self.near(f[same], f[same + shift])]
            out += self._joined(zip(n[close].tolist(), n[close + shift].tolist()))
        for s, e in zip(starts[size > SMALL].tolist(), ends[size > SMALL].tolist()):
            found = links(fps[s:e], self.near)
            out += self._joined((int(nodes[s + i]), int(nodes[s + j])) for i, j in found)
        return out


def _pass(rows: DataFrame, words: int, near: Near, heavy: int) -> DataFrame:
    """a, b, key, fps of rows grouped by key: links (key null), or the rows of keys of more than `heavy` rows (b null)."""
    names = [f"f{i}" for i in range(words)]
    schema = "a long, b long, key long, " + ", ".join(f"{c} long" for c in names)

    def given(a: np.ndarray, b: np.ndarray | None, k: np.ndarray | None, f: np.ndarray | None) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        last = [none] * words if f is None else [pa.array(f[:, i].view(np.int64)) for i in range(words)]
        return pa.RecordBatch.from_arrays([pa.array(a), none if b is None else pa.array(b), none if k is None else pa.array(k), *last], ["a", "b", "key", *names])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linker, held, large = Linker(near), [], None  # held: parts of the last key's rows; large: a key beyond `heavy`

        def settled(parts: list) -> Iterator[pa.RecordBatch]:
            if parts:
                found = linker.of_keys(*(np.concatenate(x) for x in zip(*parts)))
                if found:
                    both = np.array(found, np.int64)
                    yield given(both[:, 0], both[:, 1], None, None)

        for batch in batches:
            k, n = np.asarray(batch.column("key")), np.asarray(batch.column("node"))
            f = np.stack([np.asarray(batch.column(c)).view(np.uint64) for c in names], axis=1)
            if large is not None:  # it goes on in this batch
                until = int(np.searchsorted(k, large, "right"))
                if until:
                    yield given(n[:until], None, k[:until], f[:until])
                k, n, f = k[until:], n[until:], f[until:]
                large = large if not len(k) else None
            if not len(k):
                continue
            first = int(np.searchsorted(k, held[0][0][0], "right")) if held else 0  # the held key's rows in this batch
            if first:
                held.append((k[:first], n[:first], f[:first]))
            if first < len(k):
                yield from settled(held)
                at = int(np.searchsorted(k, k[-1]))  # the last key may go on in the next batch
                if at > first:
                    yield from settled([(k[first:at], n[first:at], f[first:at])])
                held = [(k[at:], n[at:], f[at:])]
            if sum(len(x[0]) for x in held) > heavy:
                large = int(held[0][0][0])
                for x in held:
                    yield given(x[1], None, x[0], x[2])
                held = []
        yield from settled(held)

    return rows.select("key", "node", *names).repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def block_links(nodes: DataFrame, keys: Column, radius: int, words: list[Column], node: str = "node", heavy: int = HEAVY, bucket: int = BUCKET) -> DataFrame:
    """a, b: links that connect the nodes (distinct longs) like all pairs within `radius` bits that share a key.

    keys: array of a node's block keys; words: the 64-bit words whose bits are compared.
    """
    names = [f"f{i}" for i in range(len(words))]
    near = Near(radius)
    keyed = nodes.select(F.explode(keys).alias("key"), F.col(node).alias("node"), *(w.alias(c) for w, c in zip(words, names)))
    found = cut(_pass(keyed, len(words), near, heavy).hint("rebalance"))  # few rows: few files
    out = found.where("key IS NULL").select("a", "b")
    rest = found.where("key IS NOT NULL").select("key", F.col("a").alias("node"), *names)
    if rest.isEmpty():
        return out
    sizes = rest.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / bucket).cast("int").alias("buckets"))
    # every pair of buckets of a large key, and so every pair of its rows, meets in a group
    own = rest.join(sizes, "key").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("buckets")).cast("int"))
    tiles = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
    tiled = tiles.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "node", *names)
    return out.unionByName(_pass(tiled, len(words), near, 1 << 62).select("a", "b"))


def near_groups(df: DataFrame, words: int = 3, radius: int = 3, blocks: int = 6, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, fp, component_id (smallest id reachable through links) of each row."""
    rows = cut(fingerprints(df, words, id, text))
    groups = cut(rows.groupBy("fp").agg(F.min("id").alias("low")))
    parts = cut(connected_components(block_links(groups, block_keys(F.col("fp"), radius, blocks), radius, [F.col("fp")], node="fp")))
    named = groups.join(parts, groups["fp"] == parts["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    return rows.join(named.join(lowest, "component").select("fp", "component_id"), "fp").select("id", "fp", "component_id")
