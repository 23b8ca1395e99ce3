"""Operators 3, 5, 6 and 8, and the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import make
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from weftgraph.llm.language import UNKNOWN, fit_languages, fold, identify
from weftgraph.llm.pii import KINDS, find_pii, reliabilities, span_text
from weftgraph.llm.queries import RULES, queries
from weftgraph.llm.sharding import pack, pack_shards
from weftgraph.llm.url_filter import Rule, filter_urls

DATA = "/root/testdata/sf0.001"

# op 3


def plain_rule(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]+", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


def test_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.COM", "http://A.COM/x?y#z", "http://com/", "http://xcom/", "http://www.example.com/en/1", "http://m.example.com/en/1?q", "http://example.com/enx", "https://a.net/es/2", "https://a.net/es", "ftp://É.NET/fr/#a", "a://b://c/d"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("segs", F.lit(1))
    rows = {r.page_id: r for r in filter_urls(df, RULES).collect()}
    for i, u in enumerate(urls):
        host, path, rule, verdict = plain_rule(u)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule)
        assert rows[i].verdict == (verdict or "allow")
    assert filter_urls(df.limit(0), RULES).count() == 0


def test_templates(spark):
    pages = [(f"http://h.org/spam/{i}.html", 1) for i in range(30)] + [(f"http://h.org/good/{i}", 0) for i in range(30)]
    pages += [(f"http://h.org/{x}/{i}", int(i % 2)) for x in ("aa", "bb") for i in range(20)]  # alike: they merge
    pages += [(f"http://h.org/u/name{chr(97 + i // 26)}{chr(97 + i % 26)}x/pics", None) for i in range(200)]  # rare among many
    pages += [("http://h.org/spam/999.html", None), ("http://h.org/good/999", None), ("http://other.org/spam/1.html", None)]
    df = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(pages)], "page_id long, url string, bad int")
    rows = {r.page_id: r for r in filter_urls(df, [], bad=F.col("bad")).collect()}
    n = len(pages)
    assert rows[n - 3].verdict == "block" and rows[n - 3].template == "/spam/*.html"
    assert rows[n - 2].verdict == "allow" and rows[n - 1].verdict == "allow"
    assert {rows[i].template for i in range(60, 100)} == {"/*/*"}
    assert {rows[i].template for i in range(100, 300)} == {"/u/*/pics"}
    assert filter_urls(df, [Rule("allow", "h.org", "/spam/")], bad=F.col("bad")).where("verdict = 'block'").count() == 0


def test_branches_without_labels(spark):
    """Merged where what follows is alike, else apart; purity comes from siblings and hosts as far as they agree."""
    pages = [(f"http://a.net/{x}/{i}.html", 1) for x in ("es", "fr", "it") for i in range(9)]
    pages += [(f"http://a.net/{x}/{i}.html", None) for x in ("en", "de") for i in range(9)]
    pages += [(f"http://a.net/pt/{'abc'[i % 3]}/{i}", None) for i in range(9)]
    pages += [(f"http://h{k}.b.net/{i}", 1) for k in range(6) for i in range(4)] + [("http://new.b.net/1", None), ("http://new.org/1", None)]
    pages += [(f"http://c.com/{i}", 0) for i in range(60)]
    df = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(pages)], "page_id long, url string, bad int")
    rows = {r.page_id: r for r in filter_urls(df, [], bad=F.col("bad")).collect()}
    assert {rows[i].template for i in range(27)} == {"/*/*.html"} and {rows[i].template for i in range(27, 45)} == {"/*~/*.html"}
    assert {rows[i].template for i in range(45, 54)} <= {"/pt/a/*", "/pt/b/*", "/pt/c/*", "/pt/*~/*"}
    n = len(pages)
    fresh, other = rows[n - 62].purity, rows[n - 61].purity
    assert fresh > 0.85 > other > 0.3 and rows[27].purity > 0.85


def plain_tree(pages, many=20, rare=0.02, labels=5, z=1.64, weight=5.0, caution=2.0):
    """[(template, purity)] of (url, bad) pages, node by node."""
    from math import log, sqrt

    def segs(path):
        out = []
        for s in path.split("/")[1:]:
            m = re.fullmatch(r"[0-9a-f_-]*[0-9][0-9a-f_-]*(\.[A-Za-z0-9]{1,5})?", s)
            out.append("*" + (m[1] or "") if m else s or "/")
        return tuple(out)

    rows = [((m := re.search(r"://([^/?#]*)([^?#]*)", u))[1], segs(m[2]), b) for u, b in pages]
    all_ = [b for *_, b in rows if b is not None]
    share = sum(all_) / len(all_)

    def p(bs, q):
        known = [b for b in bs if b is not None]
        return (sum(known) + weight * q) / (len(known) + weight)

    def q(bs, k, above):
        return (k * p(bs, above) + caution * above) / (k + caution)

    def prior(host):
        parts, at = host.split("."), share
        for i in range(len(parts) - 1, 0, -1):
            suffix = ".".join(parts[i:])
            below = [(h, b) for h, _, b in rows if h.endswith("." + suffix)]
            own = [b for h, _, b in rows if h == suffix] + [b for _, b in below]
            kids = {h[: -len(suffix) - 1].split(".")[-1] for h, b in below if b is not None}
            at = q(own, len(kids), at)
        return at

    out = {}

    def grow(host, done, level, node, above):
        paths = {s for s, _ in node}
        bs = [b for _, b in node]
        if len(paths) == 1:
            rest = next(iter(paths))[level:]
            for s in paths:
                out[host, s] = (done + ("/" + "/".join(rest) if rest else ""), above)
            return
        kids = {}
        for s, b in node:
            kids.setdefault(s[level] if len(s) > level else "", []).append((s, b))
        lab = {c: [b for _, b in v if b is not None] for c, v in kids.items()}
        k = sum(bool(v) for v in lab.values())
        below = q(bs, k, above)
        bare = [c for c in kids if len(lab[c]) < labels]
        # the shape test leaves out paths that stop here; their rows still count as without labels
        shape = {c: Counter(s[level + 1] if len(s) > level + 1 else "" for s, _ in kids[c]) for c in bare if c != ""}
        among = sum(shape.values(), Counter())
        total, pooled = sum(among.values()), [b for v in lab.values() for b in v]
        bare_rows = sum(len(kids[c]) for c in bare)
        groups = {}
        for c, v in kids.items():
            own, rest = len(lab[c]), len(pooled) - len(lab[c])
            bad, pbad = sum(lab[c]), sum(pooled)
            mean = pbad / max(1, len(pooled))
            gap = abs(bad / max(1, own) - (pbad - bad) / max(1, rest))
            noise = sqrt(mean * (1 - mean) * (1 / max(1, own) + 1 / max(1, rest)))
            if c == "":
                branch = ""
            elif (len(kids) > many and len(v) < rare * len(node)) or (own >= labels and rest >= labels and gap <= z * noise):
                branch = "*"
            elif c in shape and len(v) >= labels and bare_rows - len(v) >= labels:
                g = 2 * sum(x * log(x * total / (len(v) * among[t])) for t, x in shape[c].items())
                d = max(1, len(among) - 1)
                branch = "*~" if g <= d * (1 - 2 / (9 * d) + z * sqrt(2 / (9 * d))) ** 3 else c
            else:
                branch = c
            groups.setdefault(branch, []).extend(v)
        for branch, v in groups.items():
            if branch == "":
                for s, _ in v:
                    out[host, s] = (done, below)
            else:
                grow(host, f"{done}/{branch}", level + 1, v, below)

    for host in {h for h, *_ in rows}:
        grow(host, "", 0, [(s, b) for h, s, b in rows if h == host], prior(host))
    names = [(h, *out[h, s], b) for h, s, b in rows]
    by, top = {}, {}
    for h, t, above, b in names:
        by.setdefault((h, t), []).append(b)
        top[h, t] = max(above, top.get((h, t), 0))
    return [(t, p(by[h, t], top[h, t])) for h, t, _, _ in names]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_tree_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["en", "de", "shop", "blog", "a", "b", "", "tag"]
    pages = []
    for _ in range(400):
        host = rng.choice(["x.a.com", "y.a.com", "a.com", "b.net", "c.b.net", "d.org"])
        path = "".join("/" + (rng.choice(words) if rng.random() < 0.6 else f"{rng.randint(0, 99)}{rng.choice(['', '.html'])}") for _ in range(rng.randint(0, 5)))
        pages.append((f"http://{host}{path}", rng.choice([None, None, int("shop" in path or rng.random() < 0.2)])))
    pages += [(f"http://d.org/u/{chr(97 + i % 26)}{chr(97 + i // 26)}{'/x' * (i % 3)}", rng.choice([None, 0, 1])) for i in range(120)]
    df = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(pages)], "page_id long, url string, bad int")
    rows = sorted(filter_urls(df, [], bad=F.col("bad")).collect(), key=lambda r: r.page_id)
    want = plain_tree(pages)
    assert [r.template for r in rows] == [t for t, _ in want]
    assert max(abs(r.purity - x) for r, (_, x) in zip(rows, want)) < 1e-9


def test_held_out_labels_are_predicted(spark):
    """Rule verdicts that are hidden from the tree are told from it better than by their most frequent value."""
    pages = spark.read.parquet(f"{DATA.replace('0.001', '0.1')}/pages.parquet").select("page_id", "url")
    ruled = filter_urls(pages, RULES).where("rule IS NOT NULL").select("page_id", F.when(F.col("verdict") == "block", 1).otherwise(0).alias("bad"))
    hidden = F.crc32(F.col("page_id").cast("string").cast("binary")) % 5 == 0
    known = pages.join(ruled, "page_id", "left").withColumn("shown", F.when(~hidden, F.col("bad")))
    out = filter_urls(known, [], bad=F.col("shown"), purity=0.5).join(known.where(hidden & F.col("bad").isNotNull()).select("page_id", "bad"), "page_id").collect()
    right = np.mean([(r.verdict == "block") == bool(r.bad) for r in out])
    constant = max(np.mean([r.bad for r in out]), 1 - np.mean([r.bad for r in out]))
    assert len(out) > 150 and right > 0.95 > 0.75 > constant


def test_purity_varies_without_rules(spark):
    rows = queries()["op3_url_templates"](spark, DATA.replace("0.001", "0.1")).where("rule IS NULL").select("purity", "verdict").distinct().collect()
    assert len({round(r.purity, 3) for r in rows}) > 5 and {r.verdict for r in rows} == {"allow", "block"}


def test_odd_urls(spark):
    """Null and repeated rows, null ids, very long and very deep paths, columns named like the operator's."""
    deep, long = "http://h.org" + "/d" * 300, "http://h.org/" + "x" * 50000
    urls = [None, None, "", deep, deep, long, long + "y", "http://h.org", "http://h.org/", "http://h.org//"]
    df = spark.createDataFrame([(None if i == 1 else i // 2, u) for i, u in enumerate(urls)], "page_id long, url string")
    for name in ("host", "segs", "bad", "done", "prior", "n", "template"):
        df = df.withColumn(name, F.lit(1))
    rows = filter_urls(df, RULES).collect()
    assert len(rows) == len(urls) and all(r.verdict == "allow" for r in rows)
    by = {r.path: r.template for r in rows if r.host}
    assert by[deep[12:]] == deep[12:] and by[""] == "" and by["/"] == "//" and by["//"] == "////"


# op 5

BASE = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain_spans(text):
    out = []
    for k, p in enumerate(BASE):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (True, k != 1 or all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(d) <= 19 and luhn(d), 10 <= len(d) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans(spark, odd, none):
    texts = [None, "", "a@b.c@d.e.f a@b..c a@b. x.y+z@q-1.io_x@y.zz", "🙂 1.2.3.4 1.2.3.4.5 256.1.1.1 001.002.003.0255 1.2.3", "+1 (736) 555-2678 +12 +1234567890123456 +1.234.567.890.", "é 4111 1111-1111 1111 4111111111111111 4111  1111 1234567890123456 0 0", "1 2 3 " * 3000, "a." * 4000 + "@b.c", "x@" + "a." * 4000 + "b", "9" * 20000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("t", F.lit(1)).withColumn("b", F.lit(1))
    for r in find_pii(df).collect():
        assert [tuple(x) for x in r.base] == plain_spans(texts[r.id]), texts[r.id]
        assert set(map(tuple, r.base)) <= set(map(tuple, r.spans))
    assert find_pii(odd).count() == odd.count() and find_pii(none).count() == 0


PIECE = st.sampled_from(["a", "@", ".", "b.c", "1", "12", "255", "+1", " ", "-", "(", ")", "_", "4111111111111111", "é", "🙂", "@x.y"])


def test_base_spans_random(spark):
    texts = []

    @settings(max_examples=150, deadline=None, database=None)
    @given(st.lists(PIECE, max_size=16).map("".join))
    def gather(t):
        texts.append(t)

    gather()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in find_pii(df).collect():
        assert [tuple(x) for x in r.base] == plain_spans(texts[r.id]), texts[r.id]


def test_method_adds_likely_spans(spark):
    good = [f"Please call me, phone (4{i % 10}5) 555-0{100 + i} today, mail ann.{i}@mail.com or phone +1 415 555 0{100 + i}" for i in range(40)]
    bad = [f"order no 111-111 1111, part id 000-000-0000 and version {i}" for i in range(20)]
    df = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    rows = {r.id: r for r in find_pii(df).select("id", "base", "spans", span_text("spans").alias("s")).collect()}
    assert all(len(rows[i].spans) == 3 and len(rows[i].base) == 2 for i in range(40))
    assert all(not rows[i].spans for i in range(40, 60))
    assert rows[0].s.split(",")[0] == "phone:22:36" and KINDS == ("email", "ip", "card", "phone")


def test_em_separates():
    belief = reliabilities({(1, 1, 1): 50, (1, 1, 0): 40, (-1, -1, 0): 60, (0, -1, -1): 20})
    assert belief[1, 1, 1] > 0.9 and belief[1, 1, 0] > 0.9 and belief[-1, -1, 0] < 0.1 and belief[0, -1, -1] < 0.2
    assert reliabilities({}) == {}


# op 6


def plain_pack(vectors, shards):
    """Greedy placement by dot product, item by item."""
    left = [[1 / shards] * len(vectors[0]) for _ in range(shards)]
    out = [0] * len(vectors)
    for i in sorted(range(len(vectors)), key=lambda i: (-max(vectors[i]), i)):
        out[i] = max(range(shards), key=lambda s: (round(sum(a * b for a, b in zip(left[s], vectors[i])), 15), -s))
        left[out[i]] = [a - b for a, b in zip(left[out[i]], vectors[i])]
    return out


def test_pack_is_even():
    rng = np.random.default_rng(3)
    v = rng.pareto(2, (3000, 3)) + 0.1
    s = pack(v / v.sum(axis=0), np.full((10, 3), 0.1))
    load = np.stack([np.bincount(s, v[:, k], 10) for k in range(3)])
    assert (load.max(axis=1) / load.mean(axis=1)).max() < 1.05
    some = v[:200] / v[:200].sum(axis=0)
    assert pack(some, np.full((7, 3), 1 / 7)).tolist() == plain_pack(some.tolist(), 7)


@pytest.mark.parametrize("large,part_groups,cell_rows", [(8, 2, 1), (4096, 50_000, 50_000), (1 << 30, 3, 2)])
def test_pack_shards(spark, odd, odd_rows, none, large, part_groups, cell_rows):
    rows = pack_shards(odd, 3, large=large, part_groups=part_groups, cell_rows=cell_rows).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in odd_rows)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert pack_shards(none, 3).count() == 0


def test_groups_are_placed_by_dot_product(spark):
    """Where one partition holds all groups, the shards are those of the plain rule."""
    rng = random.Random(6)
    texts = [f"{i} " + "w " * rng.randint(0, 40) + "x" * rng.randint(0, 300) for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("key", F.xxhash64("text", F.lit(False)))
    rows = sorted(pack_shards(df, 6, large=1, weights=(1.0, 1.0, 1.0)).join(df, "doc_id").collect(), key=lambda r: r.key)
    v = np.array([[len(r.text) + 16, r.text.count(" ") + 1, 1] for r in rows], float)
    assert [r.shard for r in rows] == plain_pack((v / v.sum(axis=0)).tolist(), 6)


def test_hot_group_is_cut_and_others_are_not(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot " * 10)).otherwise(F.concat(F.lit("t" * 30), F.floor(F.col("id") / 4))).alias("text"))
    rows = pack_shards(df, 8, large=256, part_groups=200, cell_rows=100).join(df, "doc_id").toPandas()
    load = rows.groupby("shard")["size"].sum()
    assert load.max() / load.mean() < 1.03 and len(load) == 8
    assert (rows[~rows.text.str.startswith("hot")].groupby("text").shard.nunique() == 1).all()
    assert (rows.groupby("shard").slot.max() + 1 == rows.groupby("shard").size()).all()


# op 8


def test_language(spark, odd, none):
    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet").withColumn("out", fold(F.col("doc_id")) == 0)
    assert {r.doc_id for r in docs.where("out").collect()} == {i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 == 0}
    model = fit_languages(docs.where("NOT out"))
    assert model.languages == ["de", "en", "es", "fr"]
    judged = identify(docs.where("out"), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in judged]) > 0.98 and all(0 <= r.lang_score <= 1 for r in judged)
    rows = {r.doc_id: (r.lang_pred, r.lang_score) for r in identify(odd, model).collect()}
    assert rows[1] == rows[2] == rows[3] == (UNKNOWN, 0.0)
    assert rows[8][0] in model.languages
    assert identify(none, model).count() == 0
    assert model.predict(["der die das nicht", "12", "zzqqy"])[0][:2] == ["de", UNKNOWN]
    empty = fit_languages(none)
    assert empty.predict(["some words", ""])[0] == [UNKNOWN, UNKNOWN]


def plain_language(model, text):
    """(language, score) word by word, with Python's letters and the model's tables."""
    from weftgraph.llm.language import GRAM_WEIGHT, GRAMS

    words = re.findall(r"[^\W\d_]+", text or "")
    if not words:
        return UNKNOWN, 0.0
    total = np.zeros(len(model.languages))
    for w in (x.lower() for x in words):
        if w in model.words:
            total += model.rows[model.words[w]].astype(float)
            continue
        for n in GRAMS:
            known = [model.grams[g] for i in range(len(w) + 3 - n) if (g := f"^{w}$"[i : i + n]) in model.grams]
            if known:
                total += GRAM_WEIGHT * np.mean([model.rows[k].astype(float) for k in known], axis=0)
                break
    odds = np.exp((total - total.max()) / (model.temperature * np.sqrt(len(words))))
    return model.languages[int(total.argmax())], odds.max() / odds.sum()


def test_language_equals_plain_scoring(spark):
    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet")
    model = fit_languages(docs.where(fold(F.col("doc_id")) != 0), rows=60)
    rows = identify(docs, model).collect()
    for r in rows[:150]:
        lang, score = plain_language(model, r.text)
        assert (r.lang_pred, pytest.approx(r.lang_score, abs=1e-4)) == (lang, score)
    sure = np.array([r.lang_score for r in rows if r.lang_pred != UNKNOWN])
    assert len(set(np.round(sure, 4))) > 50 and np.mean(sure > 0.7) > 0.9  # sure, and not all equally so


def test_every_language_has_its_rows(spark):
    """A rare language is learnt as well as a frequent one; frequencies and the sample are bounded by rows of a language."""
    common = [(i, "the cat and the dog went home", "en") for i in range(3000)]
    rare = [(10_000 + i, f"kissa ja koira menivät kotiin{' taas' if i % 2 else ''}", "fi") for i in range(12)]
    model = fit_languages(spark.createDataFrame(common + rare, "doc_id long, text string, lang string"), rows=40)
    assert model.languages == ["en", "fi"] and model.predict(["koira meni kotiin", "the dogs"])[0] == ["fi", "en"]
    assert 0 < len(model.words) < 30


def test_unseen_words_back_off():
    from weftgraph.llm.language import LanguageModel

    rows = np.array([[2, -2], [-2, 2], [1, -1]], np.float32)
    m = LanguageModel(["a", "b"], {"known": 0, "other": 1}, {"un": 2, "u": 1}, rows)
    assert m.predict(["known", "unx", "u"])[0] == ["a", "a", "b"]


# the pipeline


def test_pipeline(spark):
    rows = [(i, t, "en" if i % 2 else None, "s", 0) for i, t in enumerate([None, "12 34", "The the of and that with this from", "the THE of and that with this from", "  "])]
    base = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = base.unionByName(spark.createDataFrame(rows, base.schema).withColumn("doc_id", F.col("doc_id") + 10**6))
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, stage(spark, kept, DATA).cache()
        ids, old = {r.doc_id for r in kept.select("doc_id").collect()}, {r.doc_id for r in before.select("doc_id").collect()}
        assert ids <= old
        if name != "encode":
            assert kept.columns == docs.columns
        if name == "language_id":
            assert not {10**6, 10**6 + 1, 10**6 + 4} & ids and len(old - ids) < 8
        if name == "exact_dedup":
            texts = [re.sub("[A-Z]+", lambda m: m[0].lower(), r.text) for r in kept.collect()]
            assert len(set(texts)) == len(texts) and 10**6 + 3 in ids and 10**6 + 2 not in ids
    assert kept.count() > 150 and kept.where("size(ids) <> n_tokens").count() == 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_registered():
    assert [n for n in queries() if n.startswith("op")] and {int(re.match(r"op(\d+)_", n)[1]) for n in queries()} == set(range(1, 11))


def test_base_digest(spark):
    r = queries()["op5_pii"](spark, DATA).where("n_email + n_ip + n_card + n_phone > 0").first()
    text = spark.read.parquet(f"{DATA}/documents.parquet").where(f"doc_id = {r.doc_id}").first().text
    assert r.base_sha256 == hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in plain_spans(text)).encode()).hexdigest()
