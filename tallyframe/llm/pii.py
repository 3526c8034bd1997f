"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose spans. Three labelers vote on each (1 for, -1 against, 0 no opinion): the pattern's
own rule (checksums, ranges, digit counts), a gazetteer (known suffixes, prefixes, ranges), and the
words before the span. Expectation-maximisation over the vote patterns' counts estimates how reliable
each labeler is and how likely each pattern is personal data; a logistic span classifier is trained on
these. Counting runs on Spark over all spans; what is fitted is a table of vote patterns, whose
size does not depend on the data.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.scratch import materialize

#: Kinds in the order of ties, and their patterns. The look-behinds and possessive
#: repeats only spare the matcher starts that cannot succeed; what matches stays the same.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{20,}+(?![A-Za-z0-9_])",
}
BASE = ("email", "ip", "card", "phone")
#: What a text must hold for a pattern to be worth a search.
NEEDS = {"email": "@", "phone": "+", "ip": "."}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Words that speak for a kind within the characters before a span.
CUES = {
    "email": "mail|contact|write|from|to:", "ip": r"\bip\b|host|server|address|addr", "card": "card|visa|master|amex|credit|pay",
    "phone": "phone|tel|call|mobile|fax|dial", "secret": "token|secret|key|passw|auth|credential",
}
AGAINST = r"version|release|isbn|issn|order|invoice|page|build|commit|sha|\bv$|#$"
CONTEXT_CHARS = 24
LABELERS = ("rule", "gazetteer", "context")


def bound(value: Column, then) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` uses it."""
    return F.transform(F.array(value), then)[0]


def found(text: Column, kind: str) -> Column:
    """Matches of a kind's pattern from left to right: array of (start, end, match, before), in code points.

    Places are lengths added up. Every step of a fold copies what it has gathered, so the fold goes
    over as many stretches as the square root of all matches: first within each, then from stretch to stretch."""
    pattern = F.lit(PATTERNS[kind])
    spans = F.call_function("split", text, pattern, F.lit(-1))
    zipped = F.arrays_zip(spans.alias("gap"), F.regexp_extract_all(text, pattern, 0).alias("match"))
    empty = F.array().cast("array<struct<start:int,end:int,match:string,before:string>>")

    def step(acc, z):
        start = acc["pos"] + F.length(z["gap"])
        end = start + F.length(F.coalesce(z["match"], F.lit("")))
        one = F.struct(start.alias("start"), end.alias("end"), z["match"].alias("match"), F.lower(F.right(z["gap"], F.lit(CONTEXT_CHARS))).alias("before"))
        return F.struct(end.alias("pos"), F.when(z["match"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(one))).alias("out"))

    def moved(stretch, by):
        place = lambda m: F.struct((m["start"] + by).alias("start"), (m["end"] + by).alias("end"), m["match"].alias("match"), m["before"].alias("before"))
        return F.transform(stretch["out"], place)

    def joined(acc, stretch):
        more = F.concat(acc["out"], F.array(moved(stretch, acc["pos"])))
        return F.struct((acc["pos"] + stretch["pos"]).alias("pos"), more.alias("out"))

    def folded(z):
        width = F.ceil(F.sqrt(F.size(z))).cast("int")
        one = lambda at: F.aggregate(F.slice(z, at, width), F.struct(F.lit(0).alias("pos"), empty.alias("out")), step)
        stretches = F.transform(F.sequence(F.lit(1), F.size(z), width), one)
        none = F.array().cast("array<array<struct<start:int,end:int,match:string,before:string>>>")
        return F.aggregate(stretches, F.struct(F.lit(0).alias("pos"), none.alias("out")), joined, lambda acc: F.flatten(acc["out"]))

    every = bound(zipped, folded)
    worth = text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike("[0-9]")
    return F.when(worth, every).otherwise(empty)


def luhn(digits: Column) -> Column:
    """The checksum of a string of digits holds."""
    back = F.reverse(digits)

    def add(acc, i):
        d = F.substr(back, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def holds(kind: str, match: Column) -> Column:
    """A match of the pattern is one of the kind."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return match.rlike("[0-9]") & match.rlike("[A-Za-z]")


def gazetteer(kind: str, match: Column) -> Column:
    low = F.lower(match)
    known = {
        "email": low.rlike(r"\.(?:com|net|org|edu|gov|info|io|de|fr|es|uk|eu|it|nl|ch|at|us|ca|au|jp|cn|in|br|ru)$"),
        "ip": ~low.rlike(r"^(?:0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.|^192\.168\.|^172\.(?:1[6-9]|2[0-9]|3[01])\."),
        "card": low.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|62)"),
        "phone": low.rlike(r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"),
        "secret": low.rlike("^(?:[0-9a-f]{32,}|sk_|pk_|ghp_|akia)"),
    }[kind]
    return F.when(known, 1).otherwise(-1 if kind in ("ip", "email") else 0)


def context(kind: str, before: Column) -> Column:
    return F.when(before.rlike(CUES[kind]), 1).when(before.rlike(AGAINST), -1).otherwise(0)


def candidates(text: Column) -> Column:
    """All proposed spans with votes: array of (start, kind number, end, kind, base, rule, gazetteer, context)."""
    def voter(number: int, kind: str):
        def vote(m):
            good = holds(kind, m["match"])
            return F.struct(
                m["start"].alias("start"), F.lit(number).alias("number"), m["end"].alias("end"), F.lit(kind).alias("kind"),
                (good if kind in BASE else F.lit(False)).alias("base"), F.when(good, 1).otherwise(-1).alias("rule"),
                gazetteer(kind, m["match"]).alias("gazetteer"), context(kind, m["before"]).alias("context"),
            )

        return vote

    return F.concat(*[F.transform(found(text, kind), voter(number, kind)) for number, kind in enumerate(PATTERNS)])


def expectation_maximisation(counts: dict[tuple, float], rounds: int = 100) -> dict[tuple, float]:
    """Probability that each (kind, votes...) is personal data, from how often each occurs.

    Votes are independent given the truth; a labeler has one reliability table for all kinds, a kind
    its own share of true spans. Starts from the majority of the votes.
    """
    kinds = sorted({k[0] for k in counts})
    truth = {k: min(0.95, max(0.05, 0.5 + 0.3 * sum(k[1:]))) for k in counts}
    for _ in range(rounds):
        share = {}
        for kind in kinds:
            own = [(n, truth[k]) for k, n in counts.items() if k[0] == kind]
            share[kind] = (sum(n * t for n, t in own) + 1) / (sum(n for n, _ in own) + 2)
        table = {}
        for labeler, vote, side in product(range(len(LABELERS)), (-1, 0, 1), (0, 1)):
            weight = sum(n * (truth[k] if side else 1 - truth[k]) for k, n in counts.items() if k[1 + labeler] == vote)
            # pseudo-counts: votes for are likelier where it is true, so that the sides keep their meaning
            table[labeler, vote, side] = weight + (2 if vote == (1 if side else -1) else 1)
        for labeler, side in product(range(len(LABELERS)), (0, 1)):
            total = sum(table[labeler, v, side] for v in (-1, 0, 1))
            for v in (-1, 0, 1):
                table[labeler, v, side] /= total
        change = 0.0
        for k in counts:
            odds = math.log(share[k[0]] / (1 - share[k[0]]))
            odds += sum(math.log(table[i, v, 1] / table[i, v, 0]) for i, v in enumerate(k[1:]))
            now = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
            change, truth[k] = max(change, abs(now - truth[k])), now
        if change < 1e-9:
            break
    return truth


def features(kind: str, votes: tuple[int, ...]) -> list[tuple]:
    """Names of the classifier's indicators for a span."""
    return [("kind", kind)] + [(name, v) for name, v in zip(LABELERS, votes)] + [(kind, name, v) for name, v in zip(LABELERS, votes)]


def train(counts: dict[tuple, float], truth: dict[tuple, float], rounds: int = 400) -> dict[tuple, float]:
    """Weights of a logistic classifier on the patterns' probabilities, each pattern weighted by its count."""
    total = sum(counts.values()) or 1
    weights: dict[tuple, float] = {f: 0.0 for k in counts for f in features(k[0], k[1:])}
    squares = dict.fromkeys(weights, 1e-6)
    for _ in range(rounds):
        slope = {f: 1e-4 * w for f, w in weights.items()}
        for k, n in counts.items():
            own = features(k[0], k[1:])
            p = 1 / (1 + math.exp(-max(-50.0, min(50.0, sum(weights[f] for f in own)))))
            for f in own:
                slope[f] += n / total * (p - truth[k])
        for f, g in slope.items():  # steps shrink with the slopes met
            squares[f] += g * g
            weights[f] -= 0.5 * g / math.sqrt(squares[f])
    return weights


def accepted(weights: dict[tuple, float], threshold: float):
    """A column function from a candidate to whether the classifier takes it."""
    def logit(c: Column) -> Column:
        total = F.lit(0.0)
        for f, w in sorted(weights.items(), key=str):
            if f[0] == "kind":
                hit = c["kind"] == f[1]
            elif len(f) == 2:
                hit = c[f[0]] == f[1]
            else:
                hit = (c["kind"] == f[0]) & (c[f[1]] == f[2])
            total = total + F.when(hit, w).otherwise(0.0)
        return total

    return lambda c: logit(c) >= math.log(threshold / (1 - threshold))


def find(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id and ``spans``: start, end (code points, end exclusive), kind, base, by start, then kind.

    ``base`` spans match a kind's pattern and rule and always stay; the classifier adds others. Texts
    are searched whole; null is empty and has none. Rows come out as they went in: repeated rows
    repeat, a null doc_id stays null, no rows give no rows. Other columns are not read.
    """
    every = docs.select("doc_id", candidates(F.coalesce("text", F.lit(""))).alias("proposed"))
    every = materialize(every, "pii-candidates")
    votes = every.select(F.explode("proposed").alias("c")).groupBy("c.kind", *[f"c.{v}" for v in LABELERS]).agg(F.count("*").alias("n"))
    counts = {(r["kind"], *(r[v] for v in LABELERS)): float(r["n"]) for r in votes.collect()}  # 27 patterns a kind at most
    weights = train(counts, expectation_maximisation(counts))
    takes = accepted(weights, threshold)
    kept = F.array_sort(F.filter("proposed", lambda c: c["base"] | takes(c)))
    return every.select("doc_id", F.transform(kept, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["base"].alias("base"))).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """The columns of a report, from ``find``."""
    told = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda kind: lambda s: s["kind"] == kind
    return scanned.select(
        "doc_id", *[F.size(F.filter(base, of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(told(base), 256).alias("base_sha256"), told("spans").alias("spans"),
    )
