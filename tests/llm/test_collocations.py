"""Phrase mining against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tallyframe.llm import collocations


def brute(rows, min_count, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 6):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, seen in counts.items():
        n = totals[lang]
        found = {p: a for p, a in seen.items() if a >= min_count and len(p) > 1}
        inside = {q[i : i + k] for q, a in found.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if found.get(q[i : i + k]) == a}
        rows_ = []
        for p, a in found.items():
            if p not in inside:
                score, k = min((1000 * a * n // (seen[p[:k]] * seen[p[k:]]), k) for k in range(1, len(p)))
                rows_.append((score, a, " ".join(p), seen[p[:k]], seen[p[k:]]))
        rows_.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i + 1, p, a, l, r, n, s) for i, (s, a, p, l, r) in enumerate(rows_[:top])]
    return sorted(out)


def mined(spark, rows, min_count, top):
    docs = spark.createDataFrame([(l, t, "clash", 7) for l, t in rows], "lang string, text string, phrase string, a int")
    return sorted(tuple(r) for r in collocations.mine(docs, min_count, top).collect())


def texts(seed, n, vocabulary, languages=("x", "y", None)):
    rng = random.Random(seed)
    names = ["W%d" % i for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    fixed = [rng.choices(names, weights, k=rng.randint(3, 7)) for _ in range(6)]
    rows = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 12)):
            words += rng.choice(fixed) if rng.random() < 0.3 else rng.choices(names, weights, k=3)
            words[-1:] = [words[-1] + rng.choice(["", "", ".", ",\n", "\t", " \x0b"])]
        rows.append((rng.choice(languages), rng.choice([" ", "  ", "\t"]).join(words)))
    return rows


@pytest.mark.parametrize("seed, n, vocabulary, min_count, top", [(1, 300, 12, 5, 2_000), (2, 400, 60, 4, 10), (3, 300, 300, 3, 3), (4, 200, 4, 2, 40)])
def test_brute_force(spark, sf, seed, n, vocabulary, min_count, top):
    """Few and many words, and tops that are settled in the first, second and last band."""
    rows = texts(seed, n, vocabulary)
    assert mined(spark, rows, min_count, top) == brute(rows, min_count, top)


def test_odd_rows(spark, sf):
    """Nulls, empty and very long texts, repeated rows, ties, one language or word with most rows, other spaces and marks."""
    rows = [(None, None), ("x", None), ("x", ""), ("x", "\x0b.\x0c"), ("und", "a b a b a b"), (None, "A B"), ("", "é😀 ü é😀 ü é😀 ü")]
    rows += [("x", "p q r s t u v")] * 9 + [("x", "a " * 20_000), ("x", "k\tl m,k  l m;k l!m")] + [("y", "b c d. c d b. d b c")] * 4
    assert mined(spark, rows, 3, 2_000) == brute(rows, 3, 2_000)
    assert mined(spark, rows, 3, 2) == brute(rows, 3, 2)
    assert mined(spark, rows[:4], 1, 9) == []
    assert mined(spark, [], 1, 9) == []


def test_wide_products(spark, sf):
    """1000 * a * n passes 64 bits."""
    words = spark.createDataFrame([("x", "a", 4 * 10**9), ("x", "b", 3 * 10**9)], "lang string, phrase string, a long")
    phrases = spark.createDataFrame([("x", "a b", 2, 2_999_999_999, False, False)], "lang string, phrase string, size int, a long, led boolean, followed boolean")
    totals = spark.createDataFrame([("x", 9 * 10**12)], "lang string, n long")
    row = collocations.scored(phrases, words, totals).first()
    assert row.score == 1000 * 2_999_999_999 * 9 * 10**12 // (12 * 10**18)
