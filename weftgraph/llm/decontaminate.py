"""Operator 10: benchmark decontamination, in DataFrame functions only.

A document is contaminated by an item if a window of the item's size in it has a
weighted-shingle similarity (Jaccard over shingle counts) of at least `least` with the item.

1. Windows. Moving a window right until its first shingle is one of the item's never lowers its
   similarity, so windows start where a shingle of an item of their size does (or end with the
   document); this loses none. What is known of a shingle here is only the sizes of its items.
2. Fingerprints. Every window and item gets a 64-bit SimHash of its words, repeats included: one
   changed word changes one feature but five shingles, so word features vary least.
3. Multi-index blocks. A pair within `radius` bits has one of `blocks` bit blocks within
   radius // blocks bits. Items are listed under all block values within that of theirs, windows
   look up their own, so the join finds all fingerprints within the radius among items of
   the window's size, and of these only the first block that qualifies counts a pair.
4. Candidates are verified by the exact similarity of their word shingles.

Cases: words are runs of letters and digits, lower-cased; a null or empty text has none and
is clean, and so is an item without words; an item of fewer than five words is one
shingle of all its words; items that repeat an id are judged each and the best counts; rows that share
an id are judged as one; a null id of a document or item is reported as null; texts of any length are taken
whole; ties of a window's similarity go to the first; empty tables give an empty table; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import BROADCAST_BYTES, cut, small

WORDS, LEAST, RADIUS, BLOCKS = 5, 0.8, 17, 6


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(words: Column, width: Column) -> Column:
    """Word shingles in order; `width` is at most the number of words."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.array_join(F.slice(words, i, width), " "))


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def simhash(features: Column, most: int) -> Column:
    """64 bits as a signed long: bits set in over half of the hashes of an array of up to `most` strings.

    The 64 counters are lanes of `lane` bits in `lane` longs: long k counts the bits k, k + lane, ...
    The top bit of a lane stays free, so sums never carry over or reach the sign.
    """
    lane = next(x for x in (8, 16, 32) if most < 1 << (x - 1))
    ones = sum(1 << i for i in range(0, 64, lane))
    hashes = F.transform(features, lambda s: F.xxhash64(s))
    zero = F.struct(*(_long(0).alias(f"c{k}") for k in range(lane)))
    counts = F.aggregate(hashes, zero, lambda acc, h: F.struct(*((acc[f"c{k}"] + F.shiftrightunsigned(h, k).bitwiseAND(_long(ones))).alias(f"c{k}") for k in range(lane))))
    # with this much more, a lane reaches its second highest bit if its count is over half
    lift = ((1 << (lane - 2)) - 1 - F.floor(F.size(features) / 2)).cast("long") * _long(ones)

    def bits(acc: Column) -> Column:
        each = (F.shiftleft(F.shiftrightunsigned(acc[f"c{k}"] + lift, lane - 2).bitwiseAND(_long(ones)), k) for k in range(lane))
        return reduce(lambda a, b: a.bitwiseOR(b), each)

    return bound(counts, bits)


def block_edges(blocks: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of each block."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _part(fp: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(_long((1 << bits) - 1))


def own_blocks(fp: Column, blocks: int) -> Column:
    """Array of (block, bits): the values of a fingerprint's blocks."""
    return F.array(*(F.struct(F.lit(i).alias("block"), _part(fp, a, n).alias("bits")) for i, (a, n) in enumerate(block_edges(blocks))))


def near_blocks(fp: Column, radius: int, blocks: int) -> Column:
    """Array of (block, bits): all values within radius // blocks bits of a fingerprint's blocks."""
    near = radius // blocks

    def around(i: int, a: int, n: int) -> Column:
        if n > 24:
            raise ValueError("more blocks are needed: all values of a block are listed")
        changes = F.filter(F.sequence(_long(0), _long((1 << n) - 1)), lambda m: F.bit_count(m) <= near)
        return F.transform(changes, lambda m: F.struct(F.lit(i).alias("block"), _part(fp, a, n).bitwiseXOR(m).alias("bits")))

    return F.concat(*(around(i, a, n) for i, (a, n) in enumerate(block_edges(blocks))))


def first_block(x: Column, y: Column, radius: int, blocks: int) -> Column:
    """The first block in which two fingerprints are within radius // blocks bits."""
    out = F.lit(None).cast("int")
    for i, (a, n) in reversed(list(enumerate(block_edges(blocks)))):
        out = F.when(F.bit_count(_part(x.bitwiseXOR(y), a, n)) <= radius // blocks, F.lit(i)).otherwise(out)
    return out


def bound(value: Column, use) -> Column:
    """use(value), with `value` computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of shingles by their counts."""

    def count(x: Column, s: Column) -> Column:
        return F.size(F.filter(x, lambda y: y == s))

    def of(p: Column) -> Column:
        x, y = p["x"], p["y"]
        return F.aggregate(F.array_intersect(x, y), F.lit(0), lambda acc, s: acc + F.least(count(x, s), count(y, s)), lambda both: both / (F.size(x) + F.size(y) - both))

    return bound(F.struct(a.alias("x"), b.alias("y")), of)


def item_table(benchmark: DataFrame, item: str, item_text: str) -> DataFrame:
    """item (row number), item_id, n (words), width, item_words, item_shingles of the items with words."""
    return cut(
        benchmark.select(benchmark[item].alias("item_id"), words_of(benchmark[item_text].cast("string")).alias("item_words"))
        .where(F.size("item_words") > 0)
        .select("item_id", F.size("item_words").alias("n"), F.least(F.size("item_words"), F.lit(WORDS)).alias("width"), "item_words")
        .withColumn("item_shingles", shingles(F.col("item_words"), F.col("width")))
        .withColumn("item", F.monotonically_increasing_id())
    )


def windows(docs: DataFrame, items: DataFrame, id: str, text: str, most: int) -> DataFrame:
    """doc_id, start (first word, from 0), n, width, words of the windows that can be similar to an item of n words."""
    split = F.split("s", " ")
    sizes = (
        items.select("n", "width", F.explode(F.array_distinct("item_shingles")).alias("s"))
        # the hash of a shingle's words, as the documents' pass computes it
        .withColumn("h", F.coalesce(*(F.when(F.col("width") == k, F.xxhash64(*(split[j] for j in range(k)))) for k in range(1, WORDS + 1))))
        .groupBy("width", "h")
        .agg(F.collect_set("n").alias("sizes"))
    )
    sizes = cut(sizes)
    worded = docs.select(docs[id].alias("doc_id"), words_of(docs[text].cast("string")).alias("w"))
    side = small(sizes, most)
    few = side is not sizes

    def starting(width: int) -> DataFrame:
        at = worded.select("doc_id", "w", F.explode(F.when(F.size("w") >= width, F.sequence(F.lit(0), F.size("w") - width))).alias("p"))
        hashed = at.select("doc_id", "p", *(["w"] if few else []), F.size("w").alias("m"), F.xxhash64(*(F.col("w")[F.col("p") + j] for j in range(width))).alias("h"))
        found = hashed.join(side.where(F.col("width") == width).select("h", "sizes"), "h").withColumn("n", F.explode("sizes"))
        start = F.least("p", F.greatest(F.lit(0), F.col("m") - F.col("n"))).alias("start")
        return found.select("doc_id", start, "n", F.lit(width).alias("width"), *([F.slice("w", start + 1, F.col("n")).alias("words")] if few else []))

    found = reduce(DataFrame.unionByName, (starting(r["width"]) for r in items.select("width").distinct().collect()))
    if few:  # the words of a window are cut out in the same pass
        return found
    # with a large benchmark, places are joined to the documents once more, so that no text is shuffled with each place
    places = found.distinct().withColumnRenamed("doc_id", "at")
    cut_out = worded.join(places, F.col("doc_id").eqNullSafe(F.col("at"))).select("doc_id", "start", "n", "width", F.slice("w", F.col("start") + 1, F.col("n")).alias("words"))
    return cut_out.where(F.size("words") >= F.col("width"))


def near_pairs(cuts: DataFrame, items: DataFrame, radius: int, blocks: int, most: int) -> DataFrame:
    """The columns of `cuts` (with n and words), and the item, of the pairs whose fingerprints are within the radius."""
    longest = items.agg(F.max("n")).first()[0] or 0
    own = items.select("item", "n", simhash(F.col("item_words"), longest).alias("item_fp"))
    listed = cut(own.select("item", "n", "item_fp", F.explode(near_blocks(F.col("item_fp"), radius, blocks)).alias("k")).select("item", "n", "item_fp", "k.block", "k.bits"))
    keyed = cuts.withColumn("fp", simhash(F.col("words"), longest)).withColumn("k", F.explode(own_blocks(F.col("fp"), blocks))).select(*cuts.columns, "fp", "k.block", "k.bits")
    near = (F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius) & (F.col("block") == first_block(F.col("fp"), F.col("item_fp"), radius, blocks))
    return keyed.join(small(listed, most), ["n", "block", "bits"]).where(near).select(*cuts.columns, "item")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    least: float = LEAST, radius: int = RADIUS, blocks: int = BLOCKS, most: int = BROADCAST_BYTES,
) -> DataFrame:
    """doc_id, item_id, similarity (the best window's), window_start (its first word, from 0) of each contaminated pair.

    `most`: bytes of the items' shingles and of their blocks that are broadcast; larger ones are shuffled.
    """
    items = item_table(benchmark, item, item_text)
    if items.isEmpty():
        kinds = {"doc_id": docs.schema[id].dataType.simpleString(), "item_id": benchmark.schema[item].dataType.simpleString()}
        return docs.sparkSession.createDataFrame([], f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, similarity double, window_start int")
    cuts = windows(docs, items, id, text, most)
    near = near_pairs(cuts, items, radius, blocks, most).join(small(items.select("item", "item_id", "item_shingles"), most), "item")
    judged = near.select("doc_id", "item_id", "start", similarity(shingles(F.col("words"), F.col("width")), F.col("item_shingles")).alias("similarity"))
    best = judged.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", -F.col("start"))).alias("best")).where(F.col("best.similarity") >= least)
    return best.select("doc_id", "item_id", "best.similarity", (-F.col("best.col2")).alias("window_start"))
