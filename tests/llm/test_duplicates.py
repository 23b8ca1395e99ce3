"""Operators 2, 9 and 10 against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from cases import make
from pyspark.sql import functions as F

from weftgraph.llm.components import connected_components
from weftgraph.llm.decontaminate import contaminated
from weftgraph.llm.exact_dedup import exact_dedup, exact_groups
from weftgraph.llm.simhash import Forest, Near, block_keys, block_links, block_masks, fingerprint, links, near_groups


def lower_ascii(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


@pytest.mark.parametrize("digest", [None, lambda c: F.length(c) % 3])
def test_exact_groups(odd, odd_rows, digest):
    """Also with a digest that collides all the time."""
    rows = exact_groups(odd, **({"digest": digest} if digest else {})).collect()
    assert len(rows) == len(odd_rows)
    groups = {}
    for i, t in odd_rows:
        groups.setdefault(lower_ascii(t), []).append(i)
    want = Counter((i, max((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g)
    assert Counter((r.id, r.keep, r.n) for r in rows) == want


@pytest.mark.parametrize("most", [0, 1 << 25])
def test_exact_groups_joined_or_broadcast(spark, most):
    """Hot and cold groups and single rows, with all sides broadcast or shuffled."""
    rng = random.Random(21)
    rows = [(i, rng.choice(["Hot", "hot", "HOT"]) if rng.random() < 0.4 else f"t{rng.randrange(1500)}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    groups = {}
    for i, t in rows:
        groups.setdefault(t.lower(), []).append(i)
    got = sorted((r.id, r.keep, r.n) for r in exact_groups(df, most=most).collect())
    assert got == sorted((i, max(g), len(g)) for g in groups.values() for i in g)
    assert sorted(r.doc_id for r in exact_dedup(df, most=most).collect()) == sorted(max(g) for g in groups.values())


def test_a_repeated_id_loses_only_its_own_text(spark):
    df = spark.createDataFrame([(1, "a"), (1, "only here"), (2, "A")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in exact_dedup(df).collect()) == [(1, "only here"), (2, "A")]


def test_exact_dedup(odd, none):
    kept = exact_dedup(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 3, 5, 7, 8, 9, 10, 11]
    assert exact_dedup(none).count() == 0 and exact_groups(none).count() == 0


def test_hot_group(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Same").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text")).repartition(16)
    rows = exact_groups(df).groupBy("keep", "n").count().where("n > 1").collect()
    assert [tuple(r) for r in rows] == [(2997, 1000, 1000)]


def plain_fingerprint(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", lower_ascii(text)) if x]
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(odd_rows):
    for t in [t for _, t in odd_rows] + ["one", "one two", "A b C", "x y z", "a\x0bb\x0cc d", "É é"]:
        assert fingerprint(t or "", 3) == plain_fingerprint(t)


def test_fingerprint_is_the_engines_hash(spark):
    h = spark.sql("SELECT xxhash64('a b c') AS h").first().h
    assert h & (1 << 64) - 1 == fingerprint("A b C", 3)


def test_blocks_cover_the_radius():
    masks, rng = block_masks(3, 6), random.Random(2)
    assert len(masks) == 20
    for _ in range(500):
        d = 0
        for _ in range(rng.randint(0, 3)):
            d |= 1 << rng.randrange(64)
        assert any(not d & m for m in masks)


def top_of(n, pairs):
    f = Forest(n)
    for i, j in pairs:
        f.join(i, j)
    return [f.top(i) for i in range(n)]


def test_links_connect_like_all_pairs():
    rng = random.Random(7)
    for size in (2, 30, 120):
        for _ in range(20):
            base = rng.getrandbits(64)
            fps = {base ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 5))}) if rng.random() < 0.8 else rng.getrandbits(64) for _ in range(size)}
            f = np.array(sorted(fps), np.uint64)
            if len(f) < 2:
                continue
            every = [(i, j) for i in range(len(f)) for j in range(i) if int(np.bitwise_count(f[i] ^ f[j])) <= 3]
            some = links(f[:, None], Near(3))
            assert len(some) < len(f) and set(map(frozenset, some)) <= set(map(frozenset, every))
            assert top_of(len(f), some) == top_of(len(f), every)


def test_near_groups(spark, odd, odd_rows, none):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = list(odd_rows)
    for g in range(6):
        base = [rng.choice(words) for _ in range(300)]
        for k in range(5):
            copy = list(base)
            if k:
                copy[rng.randrange(300)] = "edit"
            rows.append((100 + 10 * g + k, " ".join(copy)))
    df = make(spark, rows)
    got = sorted(((r.id or -1), r.component_id) for r in near_groups(df).collect())
    fps = [plain_fingerprint(t) for _, t in rows]
    tops = top_of(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    low = {}
    for (i, _), t in zip(rows, tops):
        low[t] = min(low.get(t, i), i, key=lambda x: (x is None, x or 0))
    assert got == sorted(((i or -1), low[t]) for (i, _), t in zip(rows, tops))
    assert near_groups(none).count() == 0


@pytest.mark.parametrize("heavy,bucket", [(16384, 4096), (20, 7)])
def test_block_links_connect_like_all_pairs(spark, heavy, bucket):
    """Dense balls, repeats of a key over batches, keys that are dealt to buckets, two words with a reach."""
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(3)]
    rows = []
    for i in range(500):
        base = rng.choice(centres) if rng.random() < 0.8 else rng.getrandbits(64)
        f0 = base ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 6))})
        rows.append((i, f0, f0 ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 6))})))
    signed = [(i, *(x - (1 << 64) if x >> 63 else x for x in f)) for i, *f in rows]
    df = spark.createDataFrame(signed, "node long, f0 long, f1 long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    d = lambda x, y, k: (x[k] ^ y[k]).bit_count()
    for radius, words, keys in ((3, 1, block_keys(F.col("f0"), 3, 6)), (9, 2, F.concat(block_keys(F.col("f0"), 4, 7), F.transform(block_keys(F.col("f1"), 4, 7), lambda k: -k - 1)))):
        got = [tuple(r) for r in block_links(df, keys, radius, [F.col("f0"), F.col("f1")][:words], heavy=heavy, bucket=bucket).collect()]
        every = [(x[0], y[0]) for x in rows for y in rows[: x[0]] if sum(d(x, y, k + 1) for k in range(words)) <= radius]
        assert {frozenset(p) for p in got} <= {frozenset(p) for p in every}
        assert top_of(500, got) == top_of(500, every) and len(every) > 1000
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_components(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(200, 200 + i) for i in range(1, 30)] + [(5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    tops = top_of(240, pairs)
    named = {x for p in pairs for x in p if p[0] != p[1]}
    assert got == {x: tops[x] for x in named}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    odd = spark.createDataFrame([(None, 1), (2, None), (None, None), (3, 3), (5, 4), (5, 4)], "a long, b long")
    assert sorted(map(tuple, connected_components(odd).collect())) == [(4, 4), (5, 4)]


def brute_leaks(docs, items, least=0.8):
    def words(t):
        return [w for w in re.split(r"[^\w]|_", (t or "").lower()) if w]

    def bag(w, k):
        return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))

    out = {}
    for d, t in docs:
        w = words(t)
        for i, q in items:
            v = words(q)
            if not v:
                continue
            k, n = min(5, len(v)), len(v)
            want = bag(v, k)
            for s in range(max(1, len(w) - n + 1)):
                have = bag(w[s : s + n], k)
                both = sum((have & want).values())
                sim = both / max(1, sum(have.values()) + sum(want.values()) - both)
                if sim >= least:
                    out[d, i] = max(out.get((d, i), 0), sim)
    return out


def test_contaminated(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(50)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate((60, 40, 14, 5, 3, 1))] + [(7, ""), (8, None), (9, "same same same same same same same same")]
    items[5] = (5, "unique")
    docs = [(0, None), (1, ""), (2, items[0][1]), (3, items[4][1].upper() + "!"), (4, "unique"), (5, "same " * 30)]
    for d in range(10, 40):
        body = [rng.choice(words) for _ in range(rng.randint(0, 150))]
        leak = items[rng.randrange(4)][1].split()
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(leak))
            leak[at : at + 1] = rng.choice([[], ["edit"], [leak[at], "extra"]])
        at = rng.randint(0, len(body))
        docs.append((d, " ".join(body[:at] + leak + body[at:])))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("w", F.lit(1)).withColumn("h", F.lit(2))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit(0))
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in contaminated(df, bench).collect()}
    want = {k: round(v, 9) for k, v in brute_leaks(docs, items).items()}
    assert got == want and len(want) > 20
    assert contaminated(df, bench.limit(0)).count() == 0 and contaminated(df.limit(0), bench).count() == 0


def edited_passages(rng, vocabulary, most):
    """(items, documents): each document has an item with up to `most` words changed, dropped, added or cut off its ends."""
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(15, 60)))) for i in range(40)]
    docs = []
    for d in range(160):
        leak = items[d % 40][1].split()
        for _ in range(rng.randint(0, most)):
            at = rng.choice([0, -1, rng.randrange(len(leak))])
            leak[at:at + 1 or None] = rng.choice([[], ["edit"], [leak[at], "extra"]])
        body = [rng.choice(vocabulary) for _ in range(rng.randint(0, 200))]
        at = rng.randint(0, len(body))
        docs.append((d, " ".join(body[:at] + leak + body[at:])))
    return items, docs


def test_recall_depends_on_the_radius(spark):
    """All of brute force at the default radius, fewer at small ones; nothing else at any."""
    rng = random.Random(12)
    items, docs = edited_passages(rng, [f"w{i}" for i in range(3000)], 6)
    want = set(brute_leaks(docs, items))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {r: {(x.doc_id, x.item_id) for x in contaminated(df, bench, radius=r, blocks=b).collect()} for r, b in ((0, 4), (4, 4), (17, 6))}
    assert found[0] < found[4] < found[17] == want and len(found[0]) < 0.9 * len(want) and 60 < len(want) < 160


def test_large_benchmarks_are_shuffled(spark):
    rng = random.Random(13)
    items, docs = edited_passages(rng, [f"w{i}" for i in range(500)], 3)
    df, bench = spark.createDataFrame(docs[:60], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, contaminated(df, bench, most=0).collect())) == sorted(map(tuple, contaminated(df, bench).collect()))


def test_contaminated_on_odd_rows(spark, odd):
    """Null and repeated ids, very long texts, columns named like the operator's."""
    long_item = "deep " * 40 + " ".join(f"v{i}" for i in range(30))
    docs = odd.select("doc_id", "text", F.lit("x").alias("words"), F.lit(1).alias("n"), F.lit(2).alias("block")).unionByName(
        spark.createDataFrame([(None, long_item), (50, "a " * 60000 + long_item), (50, "other"), (51, long_item)], "doc_id long, text string").select("doc_id", "text", F.lit("x").alias("words"), F.lit(1).alias("n"), F.lit(2).alias("block"))
    )
    bench = spark.createDataFrame([(1, long_item), (1, long_item), (2, None), (3, "Hello World its"), (None, "hello world it s 42 naïve cafés")], "item_id long, text string").withColumn("fp", F.lit(1))
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    assert got == {(None, 1), (50, 1), (51, 1), (4, None), (5, None)}


def test_simhash_lanes(spark):
    """Every lane width gives the plain majority of the words' hashes."""
    from weftgraph.llm.decontaminate import simhash

    texts = [["a"], ["a", "b"], ["a"] * 3 + ["b"] * 2, [f"w{i}" for i in range(127)], ["z"] * 127]
    df = spark.createDataFrame([(t,) for t in texts], "w array<string>")
    for most in (127, 1000, 40000):
        for r in df.select("w", simhash(F.col("w"), most).alias("fp")).collect():
            h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in r.w]
            assert r.fp & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
