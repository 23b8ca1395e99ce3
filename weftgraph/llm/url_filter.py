"""Operator 3: URL filtering by a path-template tree, in DataFrame functions only.

Explicit rules come first (longest fitting rule). For the other urls, a tree per host is
grown over path segments: variable segments (numbers, hex, dates) become wildcards at once; level
by level, children that are rare among many siblings become wildcards, labelled children whose
share does not differ from their labelled siblings' (two-proportion z-test) merge into one branch,
and children with too few labels to test merge with each other where what follows them is
distributed alike (G-test over the next segments). A node of one distinct path is not split further;
there is no depth limit.

A template's purity, the share of bad pages, is smoothed towards its parent branch, that towards
its own, up to the host, the host's suffixes and all pages:

    p(node) = (bad + weight * q(parent)) / (labelled + weight)
    q(node) = (k * p(node) + caution * q(parent)) / (k + caution),  k: children with labels

so a branch without labels takes after its siblings as far as several of them agree. A url's
verdict is `block` if its template's purity reaches `purity`.

The tree is grown over distinct (host, segments) with counts, so a hot host with a third of
all pages shrinks to its distinct generalised paths in the first partial aggregation.

Cases: a null url, or one without "://", has an empty host and path; an empty path is a
template of its own; a segment that is spelled like a wildcard counts as one; repeated rows are judged
each; a null id stays; without labels nothing is blocked beyond the rules; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import cut, small
from weftgraph.llm.exact_dedup import UPPER

#: Shape of the tree and of the tests: children that count as many, share of a rare one, rows that a test needs, its
#: normal quantile; weight of a parent, caution against it, purity of a blocked template.
MANY, RARE, LABELS, Z, WEIGHT, CAUTION, PURITY = 20, 0.02, 5, 1.64, 5.0, 2.0, 0.9
#: Branches: merged by labels or for being rare, merged by what follows, and the end of a path.
ANY, ALIKE, STOP = "*", "*~", ""
#: A variable segment: numbers, hex or dates with an optional extension.
VARIABLE = r"^[0-9a-f_-]*[0-9][0-9a-f_-]*(\.[A-Za-z0-9]{1,5})?$"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, else null."""
    name = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        name = F.when(fits, r.name) if name is None else name.when(fits, r.name)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if name is None else (name, verdict)


def segments(path: Column) -> Column:
    """Array of the generalised segments of a path; an empty segment is written "/"."""
    parts = F.split(path, "/")
    return F.transform(
        F.slice(parts, F.lit(2), F.size(parts)),
        lambda s: F.when(s.rlike(VARIABLE), F.concat(F.lit(ANY), F.regexp_extract(s, r"(\.[A-Za-z0-9]{1,5})$", 1))).when(s == "", "/").otherwise(s),
    )


def suffixes(host: Column) -> Column:
    """The host and what is left of it after each dot: a.b.c, b.c, c."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def _sums(*more: str) -> list[Column]:
    return [F.sum(c).alias(c) for c in ("n", "bad", "good", *more)]


def _smoothed(bad: Column, good: Column, prior: Column, weight: float) -> Column:
    return (bad + weight * prior) / (bad + good + weight)


def host_priors(leaves: DataFrame, share: float, weight: float, caution: float) -> DataFrame:
    """host, prior: what a host's suffixes and all pages say of it."""
    hosts = leaves.groupBy("host").agg(*_sums())
    chained = hosts.select("host", "bad", "good", suffixes(F.col("host")).alias("chain"))
    steps = chained.select("bad", "good", F.posexplode("chain").alias("i", "suffix"), F.get("chain", F.col("i") + 1).alias("above"))
    own = cut(steps.groupBy("suffix", "above").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    kids = own.where("bad + good > 0").groupBy(F.col("above").alias("suffix")).agg(F.count(F.lit(1)).alias("k"))
    stats = own.join(kids, "suffix", "left").select("suffix", "bad", "good", F.coalesce("k", F.lit(0)).alias("k"))
    # a host's chain has as many links as its name has dots
    above = chained.select("host", F.posexplode("chain").alias("i", "suffix")).where("i > 0").join(stats, "suffix")
    line = above.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("i", "bad", "good", "k")), asc=False).alias("line"))

    def down(q: Column, x: Column) -> Column:
        return (x["k"] * _smoothed(x["bad"], x["good"], q, weight) + caution * q) / (x["k"] + caution)

    return hosts.select("host").join(line, "host", "left").select("host", F.coalesce(F.aggregate("line", F.lit(float(share)), down), F.lit(float(share))).alias("prior"))


def _likeness(open_: DataFrame, level: int) -> DataFrame:
    """host, done, seg, g, df: G statistic of what follows a child without enough labels against all such siblings."""
    after = open_.groupBy("host", "done", "seg", F.coalesce(F.get("segs", F.lit(level + 1)), F.lit(STOP)).alias("next")).agg(F.sum("n").alias("n"))
    child = after.groupBy("host", "done", "seg").agg(F.sum("n").alias("cn"))
    among = after.groupBy("host", "done", "next").agg(F.sum("n").alias("an"))
    whole = child.groupBy("host", "done").agg(F.sum("cn").alias("wn"))
    kinds = among.groupBy("host", "done").agg(F.count(F.lit(1)).alias("kinds"))
    cells = after.join(child, ["host", "done", "seg"]).join(among, ["host", "done", "next"]).join(whole, ["host", "done"])
    g = cells.groupBy("host", "done", "seg").agg((2 * F.sum(F.col("n") * F.log(F.col("n") * F.col("wn") / (F.col("cn") * F.col("an"))))).alias("g"))
    return g.join(kinds, ["host", "done"]).select("host", "done", "seg", "g", (F.col("kinds") - 1).alias("df"))


def chi_square(df: Column, z: float) -> Column:
    """About the quantile of chi-square that has the normal quantile z (Wilson and Hilferty)."""
    d = F.greatest(df, F.lit(1)).cast("double")
    return d * F.pow(1 - 2 / (9 * d) + z * F.sqrt(2 / (9 * d)), F.lit(3))


def templates(pages: DataFrame, many: int = MANY, rare: float = RARE, labels: int = LABELS, z: float = Z, weight: float = WEIGHT, caution: float = CAUTION) -> DataFrame:
    """host, segs, template, bad, good, purity of every distinct (host, segs).

    `pages` has host, path and bad (1, 0, or null: not labelled). bad and good are counts of the template.
    """
    bad = F.col("bad").cast("long")
    leaves = cut(
        pages.select("host", segments(F.col("path")).alias("segs"), F.lit(1).cast("long").alias("n"), F.coalesce(bad, F.lit(0)).alias("bad"), F.coalesce(1 - bad, F.lit(0)).alias("good"))
        .groupBy("host", "segs")
        .agg(*_sums())
    )
    known = leaves.agg(F.sum("bad"), F.sum("good")).first()
    share = known[0] / max(1, known[0] + known[1]) if known[0] else 0.0
    open_ = leaves.join(host_priors(leaves, share, weight, caution), "host").withColumn("done", F.lit(""))
    closed, level = [], 0
    while True:
        node = ["host", "done"]
        open_ = cut(open_.withColumn("seg", F.coalesce(F.get("segs", F.lit(level)), F.lit(STOP))))
        children = open_.groupBy(*node, "seg").agg(*_sums(), F.count(F.lit(1)).alias("leaves"))
        own = F.col("bad") + F.col("good")
        parents = children.groupBy(*node).agg(
            F.sum("n").alias("pn"), F.sum("bad").alias("pbad"), F.sum("good").alias("pgood"), F.sum("leaves").alias("pleaves"), F.count(F.lit(1)).alias("children"),
            F.sum((own > 0).cast("int")).alias("k"), F.sum(F.when(own < labels, F.col("n")).otherwise(0)).alias("bare"),
        )
        rest = F.col("pbad") + F.col("pgood") - own
        pooled = F.col("pbad") / F.greatest(F.col("pbad") + F.col("pgood"), F.lit(1))
        gap = F.abs(F.col("bad") / F.greatest(own, F.lit(1)) - (F.col("pbad") - F.col("bad")) / F.greatest(rest, F.lit(1)))
        noise = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest(own, F.lit(1)) + 1 / F.greatest(rest, F.lit(1))))
        told = (own >= labels) & (rest >= labels) & (gap <= z * noise)
        scarce = (F.col("children") > many) & (F.col("n") < rare * F.col("pn"))
        enough = (F.col("n") >= labels) & (F.col("bare") - F.col("n") >= labels)
        same = (own < labels) & enough & (F.col("g") <= chi_square(F.col("df"), z))
        branch = F.when(F.col("seg") == STOP, STOP).when(scarce | told, ANY).when(F.coalesce(same, F.lit(False)), ALIKE).otherwise(F.col("seg"))
        untold = children.where((own < labels) & (F.col("seg") != STOP)).select(*node, "seg")
        shape = _likeness(open_.join(untold, [*node, "seg"], "left_semi"), level)
        moved = children.join(parents, node).join(shape, [*node, "seg"], "left").select(*node, "seg", branch.alias("branch"), "pbad", "pgood", "k", "pleaves")
        p = _smoothed(F.col("pbad"), F.col("pgood"), F.col("prior"), weight)
        below = open_.join(moved, [*node, "seg"]).withColumn("p", p).withColumn("below", (F.col("k") * p + caution * F.col("prior")) / (F.col("k") + caution))
        below = cut(below.select("host", "segs", "n", "bad", "good", "prior", "done", "branch", "below", "pleaves"))
        # a node of one distinct path ends here, with all its segments; so does a path that stops
        alone, stops = F.col("pleaves") == 1, F.col("branch") == STOP
        left = F.slice("segs", level + 1, F.greatest(F.size("segs") - level, F.lit(0)))
        rest_of = F.when(F.size("segs") > level, F.concat(F.lit("/"), F.array_join(left, "/"))).otherwise("")
        # where a path stops at a node with branches, its template is a child of that node
        ended = below.where(alone | stops)
        prior = F.when(alone, F.col("prior")).otherwise(F.col("below"))
        closed.append(ended.select("host", "segs", "n", "bad", "good", prior.alias("prior"), F.when(alone, F.concat("done", rest_of)).otherwise(F.col("done")).alias("template")))
        open_ = below.where(~(alone | stops)).select("host", "segs", "n", "bad", "good", F.col("below").alias("prior"), F.concat("done", F.lit("/"), "branch").alias("done"))
        level += 1
        if open_.isEmpty():
            break
    named = closed[0]
    for one in closed[1:]:
        named = named.unionByName(one)
    totals = named.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.max("prior").alias("prior"))
    judged = totals.select("host", "template", "bad", "good", _smoothed(F.col("bad"), F.col("good"), F.col("prior"), weight).alias("purity"))
    return named.select("host", "segs", "template").join(judged, ["host", "template"])


def filter_urls(df: DataFrame, rules: list[Rule], bad: Column | None = None, id: str = "page_id", url: str = "url", purity: float = PURITY, **shape) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of each row.

    `bad`: 1 or 0 where a row is labelled, else null (default: the verdicts of the rules are the labels).
    """
    address = df[url].cast("string")
    split = df.select(df[id].alias("page_id"), host_of(address).alias("host"), path_of(address).alias("path"), (F.lit(None).cast("int") if bad is None else bad.cast("int")).alias("label"))
    rule, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    judged = split.withColumn("rule", rule).withColumn("ruled", verdict)
    judged = judged.withColumn("bad", F.coalesce("label", F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0)))
    known = cut(templates(judged, **shape).select("host", "segs", "template", "purity"))
    return (
        judged.drop("bad")
        .withColumn("segs", segments(F.col("path")))
        .join(small(known), ["host", "segs"])
        .select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("purity") >= purity, "block").otherwise("allow")).alias("verdict"), "template", "purity")
    )
