"""Operator 5: personal data by weak supervision, in DataFrame functions only.

Base spans are the four kinds' patterns with their checks. Candidates are the base spans and
what looser patterns find besides. Three labelers vote on every candidate (1 yes, -1 no,
0 abstain): *regex* (form), *gazetteer* (lists of endings, prefixes, reserved ranges) and
*context* (words before the span). Expectation-maximisation over the counts of vote patterns, of
which there are at most 27 for each kind, estimates how each labeler votes on true and false
candidates. The resulting probabilities, as soft labels, train the final span classifier (naive
Bayes over a bounded set of features of the span and its neighbourhood, not of the votes), which decides
on the looser candidates; base spans stay in any case.

Offsets count code points: the text between matches and the matches themselves are measured in
turn. All patterns run in time linear in the text (possessive loops, starts only where a run
of their characters begins or the previous match ended).

Cases: a null or empty text has no spans; texts are taken whole; repeated rows are judged
each; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import cut

KINDS = ("email", "ip", "card", "phone")

#: The base patterns, written so that they need no backtracking; they match what the plain forms match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?=\.[A-Za-z0-9-])(?:(?!\.(?![A-Za-z0-9-]))[A-Za-z0-9.-])++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:(?![ -](?![0-9]))[0-9 -])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}

#: Looser forms: spelled-out signs, full IPv6, unusual separators, numbers without a country code.
_AT, _DOT = r" ?(?:\(at\)|\[at\]|\{at\}) ?", r"(?: ?(?:\(dot\)|\[dot\]|\{dot\}) ?|\.)"
LOOSE = {
    "email": rf"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++){{1,5}}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9./_])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9./_])",
    "phone": r"(?<![0-9+()-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
}
#: A text without this cannot match the pattern; tested first as it costs less.
NEEDS = {
    ("base", "email"): "@", ("base", "ip"): r"[0-9]\.[0-9]", ("base", "card"): "[0-9][ -]?[0-9]", ("base", "phone"): r"\+[0-9]",
    ("loose", "email"): r"[(\[{]at[)\]}]", ("loose", "ip"): "[0-9A-Fa-f]:[0-9A-Fa-f]", ("loose", "card"): "[0-9][./_][0-9]", ("loose", "phone"): "[0-9][ .-][0-9]",
}

#: Gazetteers and context words (fixed values): name endings; first digits and lengths of card issuers; addresses
#: that name no one's machine; country calling codes; first digits that no area code has.
ENDINGS = (
    "com org net edu gov mil int info biz name pro io co me tv cc app dev ai example "
    "ac ae ar at au be bg br by ca ch cl cn cz de dk ee eg es eu fi fr gb gr hk hr hu id ie il in ir is it jp ke kr lt lu lv ma mx my ng nl no nz pe ph pk pl pt ro rs ru sa se sg si sk th tn tr tw ua uk us uy ve vn za"
).split()
ISSUERS = (
    "^(?:4(?:[0-9]{15}|[0-9]{18})|(?:5[1-5][0-9]{2}|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]{12}"
    "|3[47][0-9]{13}|(?:6011|64[4-9][0-9]|65[0-9]{2})[0-9]{12,15}|3(?:0[0-5]|[689][0-9])[0-9]{11,16}|35(?:2[89]|[3-8][0-9])[0-9]{12,15}|62[0-9]{14,17})$"
)
NO_ONES = r"^(?:0|127|169\.254|2(?:2[4-9]|[3-5][0-9]))\.|^(?:0+:){7}|^(?i:fe[89ab][0-9a-f]|ff[0-9a-f]{2}):"
PUBLIC = r"^(?:[1-9]|1[1-9]|[2-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.|^[23][0-9A-Fa-f]{3}:"
CALLING = (
    "^(?:1[2-9]|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
    "|21[1-368]|22[0-9]|23[0-9]|24[0-9]|25[0-8]|26[0-9]|29[0-9]|35[0-9]|37[0-9]|38[0-9]|42[0-3]|50[0-9]|59[0-9]|67[0-9]|68[0-9]|69[0-2]|85[0-6]|88[06]|96[0-8]|97[0-7]|99[2-8])"
)
CONTEXT = {
    "email": r"(?i)(?:e-?mail|contact|correo|courriel|write|schreib|adresse?)\P{L}{0,8}$",
    "ip": r"(?i)(?:\bip\b|host|server|address|client|adresse|direcci)\P{L}{0,8}$",
    "card": r"(?i)(?:card|visa|master|credit|karte|carte|tarjeta|payment)\P{L}{0,8}$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|cell|telefon|appele|llame|anruf|contact)\P{L}{0,8}$",
}
AGAINST = r"(?i)(?:version|release|section|chapter|order|part|model|figure|isbn|no|nr|id|#)\P{L}{0,4}$"
#: Code points before a span that the context labeler reads.
NEAR = 30


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda acc, d: acc + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    """Whether a match of the base pattern passes its check."""
    if kind == "ip":
        short = F.transform(F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(short, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    n = F.length(_digits(s))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(_digits(s))).otherwise(False)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def _check(kind: str):
    return lambda x: _valid(kind, x["span"])


def of_kind(kind: str):
    """A test of a span for `filter`."""
    return lambda c: c["kind"] == KINDS.index(kind)


def matches(text: Column, pattern: str, needs: str, kind: int, base: bool) -> Column:
    """Array of (start, kind, end, base, span) of the pattern's leftmost non-overlapping matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    # fold the gaps and matches into positions
    steps = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("span")))
    item = "struct<start:int,kind:int,end:int,base:boolean,span:string>"
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{item}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["gap"]
        end = start + F.length(x["span"])
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.lit(base).alias("base"), x["span"].alias("span"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.when(text.rlike(needs), F.aggregate(steps, zero, step, lambda acc: acc["out"])).otherwise(F.array().cast(f"array<{item}>"))


def _regex_vote(kind: Column, base: Column, s: Column) -> Column:
    """Form: checked base matches and complete loose ones; not a repeated digit."""
    digits = _digits(s)
    flat = digits.rlike(r"^([0-9])\1*$")
    return (
        F.when(F.length(digits).isin(0) & (kind != 0), -1)
        .when(flat & (kind != 1), -1)
        .when(base, 1)
        .when(kind == 2, F.when(luhn(digits), 1).otherwise(-1))
        .when(kind == 3, F.when(s.rlike(r"^\(|^[0-9]{3}([ .-])[0-9]{3}\1"), 1).otherwise(0))
        .otherwise(1)
    )


def _gazetteer_vote(kind: Column, s: Column) -> Column:
    digits = _digits(s)
    ending = F.lower(F.regexp_extract(s, r"([A-Za-z0-9-]+)$", 1))
    return (
        F.when(kind == 0, F.when(ending.isin(ENDINGS), 1).otherwise(-1))
        .when(kind == 1, F.when(s.rlike(NO_ONES), -1).when(s.rlike(PUBLIC), 1).otherwise(0))
        .when(kind == 2, F.when(digits.rlike(ISSUERS), 1).otherwise(-1))
        .when(s.startswith("+"), F.when(digits.rlike(CALLING), 1).otherwise(-1))
        .otherwise(F.when(digits.rlike("^1?[2-9][0-8][0-9][2-9]"), 1).when(digits.rlike("^1?[01]|^1?[2-9][0-9]{2}[01]"), -1).otherwise(0))
    )


def _context_vote(kind: Column, before: Column) -> Column:
    vote = F.when(before.rlike(AGAINST), -1)
    for i, k in enumerate(KINDS):
        vote = vote.when((kind == i) & before.rlike(CONTEXT[k]), 1)
    return vote.otherwise(0)


def _near(c: Column) -> Column:
    """Class of a character beside a span."""
    return F.when(c == "", "e").when(c.rlike(r"\p{L}"), "l").when(c.rlike("[0-9]"), "d").when(c.rlike(r"\s"), "s").when(c.rlike(r"[.,;:!?]"), "p").when(c.rlike(r"[()\[\]{}<>\"']"), "q").otherwise("o")


def _features(kind: Column, s: Column, before: Column, after: Column) -> Column:
    """Features of a span itself and what stands beside it; of no kind more than a hundred. Votes are not among them."""
    shape = F.regexp_replace(F.regexp_replace(s, "[0-9]", "9"), r"\p{L}+", "a")
    word = F.lower(F.regexp_extract(before, r"(\p{L}{1,12})\P{L}{0,3}$", 1))
    digits = _digits(s)
    return F.array(
        F.concat(F.lit("n"), F.least(F.length(s), F.lit(40)).cast("string")),
        F.concat(F.lit("s"), F.when(s.rlike(r"[()]"), "p").when(s.rlike("-"), "h").when(s.rlike(" "), "b").when(s.rlike(r"\."), "d").when(s.rlike("_|/"), "u").otherwise("o")),
        F.concat(F.lit("b"), _near(F.substring(before, -1, 1))),
        F.concat(F.lit("a"), _near(after)),
        F.concat(F.lit("f"), F.substring(digits, 1, 1)),
        F.concat(F.lit("k"), F.length(F.regexp_replace(digits, r"(.)(?=.*\1)", "")).cast("string")),  # different digits
        F.concat(F.lit("h"), F.pmod(F.xxhash64(shape), F.lit(97)).cast("string")),
        F.concat(F.lit("w"), F.when(word == "", "none").otherwise(F.pmod(F.xxhash64(word), F.lit(97)).cast("string"))),
    )


def spans(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, candidates: array of (start, kind, end, base, votes, features)."""
    whole = df.select(df[id].alias("id"), F.coalesce(df[text].cast("string"), F.lit("")).alias("t"))
    t = F.col("t")
    base = [F.filter(matches(t, BASE[k], NEEDS["base", k], i, True), _check(k)) for i, k in enumerate(KINDS)]
    loose = [matches(t, LOOSE[k], NEEDS["loose", k], i, False) for i, k in enumerate(KINDS)]
    found = whole.select("id", "t", F.concat(*base).alias("b"), F.concat(*loose).alias("l"))
    apart = F.filter("l", lambda x: ~F.exists("b", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))

    def judged(x: Column) -> Column:
        before = F.substring(F.col("t"), F.greatest(x["start"] - NEAR, F.lit(0)) + 1, F.least(x["start"], F.lit(NEAR)))
        after = F.substring(F.col("t"), x["end"] + 1, F.lit(1))
        votes = F.concat_ws(",", *(v.cast("string") for v in (_regex_vote(x["kind"], x["base"], x["span"]), _gazetteer_vote(x["kind"], x["span"]), _context_vote(x["kind"], before))))
        return F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["base"].alias("base"), votes.alias("votes"), _features(x["kind"], x["span"], before, after).alias("features"))

    both = F.concat("b", apart)
    return found.select("id", F.when(F.size("b") + F.size("l") > 0, F.transform(both, judged)).alias("candidates"))


def reliabilities(counts: dict[tuple[int, int, int], float], rounds: int = 50) -> dict[tuple[int, int, int], float]:
    """Expectation-maximisation over counted vote patterns: probability that a candidate is true, by pattern."""
    prior = 0.5
    say = [{True: {1: 0.7, 0: 0.25, -1: 0.05}, False: {1: 0.2, 0: 0.3, -1: 0.5}} for _ in range(3)]
    belief: dict[tuple[int, int, int], float] = {}
    for _ in range(rounds):
        for votes in counts:
            yes = prior * math.prod(say[i][True][v] for i, v in enumerate(votes))
            no = (1 - prior) * math.prod(say[i][False][v] for i, v in enumerate(votes))
            belief[votes] = yes / (yes + no)
        total = sum(counts.values())
        prior = min(0.99, max(0.01, (sum(n * belief[v] for v, n in counts.items()) + 1) / (total + 2)))
        for i in range(3):
            for truth in (True, False):
                mass = {v: 1.0 for v in (1, 0, -1)}
                for votes, n in counts.items():
                    mass[votes[i]] += n * (belief[votes] if truth else 1 - belief[votes])
                say[i][truth] = {v: m / sum(mass.values()) for v, m in mass.items()}
    return belief


def classifier(candidates: DataFrame) -> dict[tuple[int, str], float]:
    """Log-odds of each (kind, feature), and of each kind under feature '', from exploded candidates.

    The driver gets one row per kind and vote pattern and one per kind and feature: at most some two thousand.
    """
    one = candidates.select("c.kind", "c.votes", "c.features")
    by: dict[int, dict[tuple[int, int, int], float]] = defaultdict(dict)
    for r in one.groupBy("kind", "votes").count().collect():
        by[r["kind"]][tuple(map(int, r["votes"].split(",")))] = float(r["count"])
    belief = {(k, ",".join(map(str, v))): p for k, counts in by.items() for v, p in reliabilities(counts).items()}
    if not belief:
        return {}
    table = F.create_map(*(x for (k, v), p in belief.items() for x in (F.lit(f"{k}|{v}"), F.lit(p))))
    soft = one.withColumn("p", table[F.concat_ws("|", F.col("kind").cast("string"), "votes")])
    sums = soft.select("kind", "p", F.explode(F.concat(F.array(F.lit("")), "features")).alias("f")).groupBy("kind", "f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    size = defaultdict(lambda: [0.0, 0.0])
    for r in sums:
        if r["f"] == "":
            size[r["kind"]] = [r["yes"], r["no"]]
    out = {}
    for r in sums:
        yes, no = size[r["kind"]]
        if r["f"] == "":
            out[r["kind"], ""] = math.log((yes + 1) / (no + 1))
        else:
            out[r["kind"], r["f"]] = math.log((r["yes"] + 0.5) / (yes + 1)) - math.log((r["no"] + 0.5) / (no + 1))
    return out


def find_pii(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, base and spans: arrays of (start, kind, end), ordered; kind is an index into KINDS."""
    judged = cut(spans(df, id, text))
    weights = classifier(judged.select(F.explode("candidates").alias("c")))
    kinds = judged.select("id", "candidates")
    if weights:
        table = F.create_map(*(x for (k, f), w in weights.items() for x in (F.lit(f"{k}|{f}"), F.lit(w))))

        def odds(c: Column) -> Column:
            return F.aggregate(F.concat(F.array(F.lit("")), c["features"]), F.lit(0.0), lambda acc, f: acc + F.coalesce(table[F.concat_ws("|", c["kind"].cast("string"), f)], F.lit(0.0)))
    else:

        def odds(c: Column) -> Column:
            return F.lit(-1.0)

    plain = F.coalesce("candidates", F.array().cast(judged.schema["candidates"].dataType))
    place = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    return kinds.select(
        "id",
        F.sort_array(F.transform(F.filter(plain, lambda c: c["base"]), place)).alias("base"),
        F.sort_array(F.transform(F.filter(plain, lambda c: c["base"] | (odds(c) > 0)), place)).alias("spans"),
    )


def span_text(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["start"].cast("string"), c["end"].cast("string"))), ",")
