"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from tallyframe.llm import periodic_runs, queries


def brute_runs(words, least, periods):
    """Every maximal stretch with its smallest period, by comparing words q apart for each q."""
    n, out = len(words), []
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            part = words[s : i + q]
            if len(part) >= max(least, periods * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((s, len(part), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words, 24, 3)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


@pytest.mark.parametrize("least, periods", [(4, 2), (6, 3), (24, 3)])
def test_runs_of_random_words(least, periods):
    rng = random.Random(least)
    for _ in range(1_500):
        n = rng.randint(0, 70)
        words = [rng.randint(0, rng.choice([1, 2, 9])) for _ in range(n)]
        if n > 4 and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, n // 2)
            words = [w if i < a else words[a + (i - a) % p] if a + (i - a) % p < n else 0 for i, w in enumerate(words)]
        assert [tuple(r) for r in sorted(periodic_runs.runs_of(words, least, periods).tolist(), key=lambda r: (r[0], r[2]))] == brute_runs(words, least, periods)


def test_extensions():
    rng = random.Random(3)
    s = [rng.randint(1, 2) for _ in range(60)]
    longest = periodic_runs.Extensions(s)
    import numpy as np

    pairs = [(i, j) for i in range(60) for j in range(61) if i != j]
    got = longest.of(*(np.array(x) for x in zip(*pairs))).tolist()
    for (i, j), k in zip(pairs, got):
        assert s[i : i + k] == s[j : j + k] and (max(i, j) + k == 60 or s[i + k] != s[j + k])


def digests(df):
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_query(spark, sf, texts):
    assert digests(queries.op13_periodic_runs(spark, sf)) == sorted((brute_digest(i, t) for i, t in texts.items()), key=repr)


def test_odd_rows(spark, odd, empty):
    """Nulls and empty texts, repeated rows, hot words, very long texts, other spaces, tables without rows."""
    rng = random.Random(8)
    extra = [
        (20, "a " * 100 + "b " * 30), (21, "A a " * 30), (22, "x y " * 40), (23, " ".join("é😀ü"[rng.randint(0, 2)] for _ in range(900))),
        (24, "p q r s t u v w " * 3 + "z " + "p q r s t u v w " * 3), (25, "k " * 23), (26, "k\n" * 24), (27, "\t".join("one two".split() * 12)),
    ]
    docs = odd.unionByName(spark.createDataFrame([(i, t, None, None, None, "clash", "clash") for i, t in extra], odd.schema)).withColumnRenamed("n", "runs")
    rows = [(r.doc_id, r.text) for r in docs.collect()]

    def digest(df):
        return digests(periodic_runs.digest(periodic_runs.find_runs(periodic_runs.planted(df))))

    assert digest(docs) == sorted((brute_digest(i, t) for i, t in rows), key=repr)
    assert digest(empty) == []


def test_long_text(spark, sf):
    """A text of 60,000 words in one period of 15,000 takes the trees, not a comparison of all periods."""
    cycle = [str(i) for i in range(15_000)]
    found = periodic_runs.find_runs(spark.createDataFrame([(1, "head " + " ".join(cycle * 4))], "doc_id long, text string")).first()
    assert [tuple(r) for r in found.runs] == [(1, 60_000, 15_000)] and found.collapsed == "head " + " ".join(cycle)
