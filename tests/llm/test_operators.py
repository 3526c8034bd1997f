"""Operators against brute force, and on odd and empty tables."""

import hashlib
import os
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from check_oracles import compare, connect
from tallyframe.llm import (
    common,
    decontaminate, licenses, line_dedup, ngram_join, packing, pii, quality, queries, substring_dedup, topk, url_filter,
)


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


def test_queries_are_registered():
    assert set(queries.QUERIES) <= set(entry.queries())
    assert len([n for n in queries.QUERIES if re.match(r"op\d+_", n)]) == len({n.split("_")[0] for n in queries.QUERIES if n != "pipeline"}) and "pipeline" in queries.QUERIES


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_sql(spark, sf, name):
    assert compare(spark, connect(sf), queries.QUERIES[name], queries.ORACLES[name], sf) is None


# licenses
def base_license(text):
    words = alnum(text)
    found = [(i, label) for p, label in licenses.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    places = [i for i, _ in found]
    return len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def test_license_base(spark, sf):
    mit = licenses.TEMPLATES[0][1]
    rows = [
        (1, "The MIT License. mit-license; MIT  License"), (2, "cc by cc by GNU General\nPublic, License apache license 2"), (3, mit.upper()),
        (4, "general public license gnu"), (5, None), (6, ""), (7, "gnu gnu general public license " * 50),
    ]
    got = {r.doc_id: r for r in licenses.digest(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for i, text in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_license(text)
        assert 0 <= r.score <= 1
    assert got[3].labels == "mit" and got[3].score == pytest.approx(1)


def test_license_documents(documents, texts):
    for r in licenses.digest(licenses.scan(documents)).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_license(texts[r.doc_id])


# n-gram join
def components_of(texts, k, percent):
    sets = {}
    for i, t in texts.items():
        w = spaced(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(spark, documents, texts, k, percent):
    rng = np.random.default_rng(5)
    more = dict(texts)
    base = [f"w{i}" for i in range(120)]
    for i in range(60):  # a chain of near copies: neighbours link, ends do not
        base[int(rng.integers(120))] = f"n{i}"
        more[10_000 + i] = " ".join(base)
    docs = spark.createDataFrame(list(more.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, k, percent).collect()}
    assert got == components_of(more, k, percent)


def test_ngram_join_ends_on_keys_of_many_unlike_classes(spark):
    rng = np.random.default_rng(8)
    pool = [f"w{i}" for i in range(40)]
    sets = [rng.choice(40, 20, replace=False) for _ in range(2100)]  # the rarest words stand in about 1,000 unlike texts each
    for i in range(60):  # near copies among them
        near = sets[i].copy()
        near[i % 20] = next(w for w in range(40) if w not in near)
        sets.append(near)
    texts = {i: " ".join(pool[w] for w in s) for i, s in enumerate(sets)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, 1, 80).collect()}
    assert got == components_of(texts, 1, 80)
    assert len({c for _, c in got.values()}) <= 2100


def test_ngram_join_stores_no_shingles(spark, monkeypatch):
    rng = np.random.default_rng(11)
    texts = [" ".join(map(str, rng.integers(0, 10**5, 3000))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored, store = {}, ngram_join.materialize

    def kept(df, label):
        out = store(df, label)
        stored[label] = sum(os.path.getsize(f.removeprefix("file:").replace("//", "/")) for f in out.inputFiles())
        return out

    monkeypatch.setattr(ngram_join, "materialize", kept)
    assert ngram_join.near_duplicates(docs, 3, 90).count() == 60
    assert max(stored.values()) < 0.6 * sum(map(len, texts))


def test_ngram_join_looks_once_at_keys_in_a_row(spark):
    words = [f"w{i}" for i in range(400)]
    texts = {}
    for i in range(12):  # one word differs, so that nearly all keys are shared, one after the other
        texts[i] = " ".join(words[: 30 * i] + [f"x{i}"] + words[30 * i + 1 :])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    ranks = ngram_join.bucket_ranks(docs, 1)
    first = ngram_join.prefixes(docs, 1, ranks, 90).withColumn("comp", F.col("sid"))
    a, b = first.alias("a"), first.alias("b")
    every = a.join(b, F.expr(f"a.sid < b.sid and {ngram_join.fits(90)}")).select("a.sid", "b.sid").toDF("a", "b")
    some = a.join(b, F.expr(f"a.sid < b.sid and {ngram_join.FIRST_OF_RUN} and {ngram_join.fits(90)}")).select("a.sid", "b.sid").toDF("a", "b")
    assert set(every.collect()) == set(some.collect()) and 3 * some.count() < every.count()


def test_ngram_join_all_turns(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PAIRS_A_ROW", 0)  # rounds to the end
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(9)
    texts = {i: " ".join(f"w{w}" for w in rng.choice(26, 20, replace=False)) for i in range(300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, 1, 90).collect()}
    assert got == components_of(texts, 1, 90)


def test_prefix_tree_walk():
    rng = np.random.default_rng(3)
    probe = np.sort(rng.choice(1000, 200, replace=False)).astype(np.uint64)
    members = []
    for i in range(200):
        keep = rng.random(200) > i / 800
        members.append((i, np.union1d(probe[keep], rng.choice(1000, i // 20)).astype(">u8").tobytes()))
    sets = {i: set(np.frombuffer(m, ">u8").tolist()) for i, m in members}
    own = set(probe.tolist())
    for percent in (80, 90):
        assert set(ngram_join.walk(probe, members, percent)) == {
            i for i, s in sets.items() if 100 * len(s & own) >= percent * len(s | own)
        }


def test_keep_one(odd):
    kept = ngram_join.keep_one(odd, 5, 80).collect()
    assert len(kept) == len({(r.doc_id, r.text) for r in kept}) and {3} == {r.doc_id for r in kept if r.text and r.text.endswith("ten") and r.doc_id and r.doc_id < 5}


def test_keep_one_tells_texts_of_one_id_apart(spark):
    rng = np.random.default_rng(4)
    a, b, c = (" ".join(f"{p}{w}" for w in rng.integers(0, 400, 80)) for p in "abc")
    near = lambda t, n: t + f" and {n} more"
    rows = [
        (5, a), (7, near(a, 1)), (7, b), (7, b), (9, near(b, 1)),  # 7 goes as a copy of 5, its other text stays
        (3, c), (3, near(c, 1)), (None, near(c, 2)), (None, "alone " * 9), (None, "alone " * 9), (4, None), (4, None), (4, ""),
    ]
    docs = spark.createDataFrame([(d, t, "k", "t") for d, t in rows], "doc_id long, text string, text_key string, comp string")
    kept = ngram_join.keep_one(docs, 5, 80)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(set(got)) == 6
    assert {(5, a), (7, b), (None, "alone " * 9), (4, None), (4, "")} <= set(got)
    assert len({(3, c), (3, near(c, 1))} & set(got)) == 1 and not {(7, near(a, 1)), (9, near(b, 1)), (None, near(c, 2))} & set(got)


# pii
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def personal(text):
    out = []
    for n, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0,
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(out))


def test_pii(spark, documents, texts):
    more = texts | {
        -1: "a@b.c_d@e.f x@y 1.2.3.4.5 300.1.1.1 é+1 (2) 34-567 89012+4 4111 1111-1111 1111 " + "9" * 40 + " a@b..c " + "é😀" * 5 + "q@r.com",
        -2: "", -3: "1 " * 3000, -4: "a@b.co " * 300, -5: "001.002.003.255 0.0.0.256",
    }
    docs = spark.createDataFrame(list(more.items()), "doc_id long, text string")
    for r in pii.digest(pii.find(docs)).collect():
        told = personal(more[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert set(told.split(",")) <= set(r.spans.split(","))


def test_long_secrets_are_proposed(spark):
    keys = {n: ("a1B2c3" * 200)[:n] for n in (19, 20, 80, 128, 129, 140, 1_000)}
    docs = spark.createDataFrame([(n, f"the secret token {k} here") for n, k in keys.items()], "doc_id long, text string")
    proposed = docs.select("doc_id", F.explode(pii.found(F.col("text"), "secret")).alias("m"))
    assert {r.doc_id: (r.start, r.end) for r in proposed.select("doc_id", "m.*").collect()} == {n: (17, 17 + n) for n in keys if n >= 20}
    spans = {r.doc_id: r.spans for r in pii.digest(pii.find(docs)).collect()}
    assert all(("secret" in spans[n]) == ("secret" in spans[80]) for n in keys if n >= 20)


def test_many_spans_in_one_text(spark):
    """A table of figures in one text: every number is a match of a pattern."""
    texts = {n: " ".join(f"{i}.7," for i in range(n)) for n in (1, 2, 3, 5, 50, 40_000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    start = time.time()
    got = {r.doc_id: r.out for r in docs.select("doc_id", pii.found(F.col("text"), "card").alias("out")).collect()}
    assert time.time() - start < 20
    for n, text in texts.items():
        want = [(m.start(), m.end(), m[0]) for m in re.finditer(PII["card"], text)]
        assert [(m.start, m.end, m.match) for m in got[n]] == want


def test_expectation_maximisation_trusts_good_labelers():
    counts = {("x", 1, 1, 0): 900.0, ("x", -1, -1, 0): 900.0, ("x", 1, -1, 0): 20.0, ("x", -1, -1, 1): 10.0}
    truth = pii.expectation_maximisation(counts)
    assert truth["x", 1, 1, 0] > 0.9 and truth["x", -1, -1, 0] < 0.1


# packing
def test_packing(spark, documents, texts):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    more = texts | {-1: "", -2: "Σ ΑΣ İ é e\u0301 a\x1cb c\u00a0d <|endoftext|> x<|ENDOFTEXT|> it's 1234 ½²", -3: "x" * 20_000, -4: "don't we'LL ... a.b. ,, ß.", -5: "fl\ufb01 ǆ K ſ"}
    docs = spark.createDataFrame(list(more.items()), "doc_id long, text string")
    rows = packing.pack(docs, path, 2).collect()
    tokenizer, by, sequences = Tokenizer.from_file(path), defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text in more.items():
        ids, at = tokenizer.encode(text, add_special_tokens=False).ids + [2], 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == pieces[0].window <= 4096 and at & (at - 1) == 0  # no padding
    steps = Counter(r.step_group for s in sequences.values() for r in s[:1])
    assert max(steps[g] * 2 ** (g % 64 - 1) for g in steps) <= 32_768


# substring dedup
def test_repeated_passage(spark, sf):
    rng = np.random.default_rng(1)
    def words(n):
        return " ".join("".join(rng.choice(list("abcdefgh"), 6)) + ("," if i % 7 == 6 else "") for i in range(n))

    passage = words(60) + "."
    rows = [(i, words(80) + (f" {passage} " if i % 5 == 2 else " ") + words(40)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = substring_dedup.repeated_spans(docs)
    got = spans.collect()
    assert {r.doc_id for r in got} == {i for i in range(40) if i % 5 == 2 and i > 2} and {r.kept_doc_id for r in got} == {2}
    texts = dict(rows)
    for r in got:
        assert texts[r.doc_id][r.start : r.end] in passage and r.n_words >= 40
        assert texts[2][r.kept_start :].startswith(texts[r.doc_id][r.start : r.end][:20])
    for r in substring_dedup.remove(docs, spans).where("removed is not null").collect():
        (cut,) = r.removed
        assert r.text == texts[r.doc_id][: cut.start] + texts[r.doc_id][cut.end :]


def test_passages_without_marks_are_found_whole(spark):
    rng = np.random.default_rng(4)
    def words(n):
        return " ".join("".join(rng.choice(list("abcdefgh"), 7)) for _ in range(n))

    passages = [words(n) for n in range(51, 81)]
    rows = [(i, f"{words(30)} {passages[i % 30]} {words(30)}") for i in range(60)]
    got = {r.doc_id: r for r in substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == set(range(30, 60))
    for i, r in got.items():
        assert rows[i][1][r.start : r.end] == passages[i - 30] and r.n_words == i + 21
        assert r.kept_doc_id == i - 30 and rows[i - 30][1][r.kept_start :].startswith(passages[i - 30])


def test_whole_lines_go_whatever_their_length(spark):
    rows = [
        (1, "alpha one\nShare this page\nbeta two"), (2, "gamma three\nshare THIS page.\ndelta four"), (3, "share this page now\nwe share this page\nalpha\nShare this page"),
        (4, "Menu\nepsilon five\nMenu"), (5, "-\n\n-"),
    ]
    got = substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    assert sorted((r.doc_id, texts[r.doc_id][r.start : r.end], r.n_words, r.kept_doc_id, r.kept_start) for r in got) == [
        (2, "share THIS page", 3, 1, 10), (3, "Share this page", 3, 1, 10), (4, "Menu", 1, 4, 0),
    ]


def test_stored_are_blocks_that_repeat_and_words_at_first_places(spark, monkeypatch):
    stored, write = {}, substring_dedup.materialize

    def counted(df, label):
        out = write(df, label)
        stored[label] = out.count()
        return out

    monkeypatch.setattr(substring_dedup, "materialize", counted)
    rng = np.random.default_rng(7)
    def words(n):
        return " ".join("".join(rng.choice(list("abcdefgh"), 7)) for _ in range(n))

    once, again, short = words(300), words(60), words(11)
    rows = [(1, f"{once}. {again} {'tick ' * 80}"), (2, f"{words(300)}. {again}. {short}. {words(9)}"), (3, f"{'tick ' * 200}. {short}. {words(20)}")]
    got = {r.doc_id: r for r in substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    assert {k: texts[k][r.start : r.end] for k, r in got.items() if k != 1} == {2: again, 3: f"{'tick ' * 200}. {short}"}
    assert stored["units"] < 420  # 300 of constant text, blocks of what stands twice
    assert stored["sides"] < 20 < stored["runs"]  # each place of the constant text is a run, all from one first place


# line dedup
def test_line_dedup(documents, texts):
    lines, expected, index, seen = [], set(), defaultdict(list), set()
    for i in sorted(texts):
        for j, line in enumerate(texts[i].split("\n")):
            s = frozenset(spaced(line))
            if len(s) < 5:
                continue
            common = Counter(k for w in s for k in index[w])
            if s in seen or any(5 * n >= 4 * (len(s) + len(lines[k]) - n) for k, n in common.items()):
                expected.add((i, j))
            seen.add(s)
            for w in s:
                index[w].append(len(lines))
            lines.append(s)
    got = line_dedup.duplicate_lines(documents).collect()
    assert {(r.doc_id, r.line) for r in got} == expected and all(r.similarity >= 0.8 for r in got)
    for r in line_dedup.without_duplicate_lines(documents).collect():
        assert r.text == "\n".join(x for j, x in enumerate(texts[r.doc_id].split("\n")) if (r.doc_id, j) not in expected)


def test_line_copies_do_not_meet_pairwise(spark, monkeypatch):
    rng = np.random.default_rng(12)
    base = [f"c{i}" for i in range(60)]
    texts = {}
    for i in range(400):  # near copies of one line; the three rarest words of each stand nowhere else
        line = list(base)
        for at in rng.choice(60, 3, replace=False):
            line[at] = f"u{i}x{at}"
        texts[i] = " ".join(line)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    pairs, verify = [], line_dedup.verified

    def counted(some, *more):
        pairs.append(some.count())
        return verify(some, *more)

    monkeypatch.setattr(line_dedup, "verified", counted)
    got = {r.doc_id: r.kept_doc_id for r in line_dedup.duplicate_lines(docs).collect()}
    assert got == dict.fromkeys(range(1, 400), 0)
    assert sum(pairs) < 40 * len(texts)


def test_short_lines_are_compared_too(spark, sf, documents, texts):
    lines, expected = {}, set()
    for i in sorted(texts):
        for j, line in enumerate(texts[i].split("\n")):
            s = frozenset(spaced(line))
            if not 1 <= len(s) < 5:  # sets of up to 4 words meet no other set at 0.8 but one of 5 words around them
                continue
            if s in lines:
                expected.add((i, j))
            lines.setdefault(s, (i, j))
    fives = {frozenset(spaced(x)) for t in texts.values() for x in t.split("\n")}
    near = {s - {w} for s in fives if len(s) == 5 for w in s}
    met = {(i, j) for i in texts for j, x in enumerate(texts[i].split("\n")) if frozenset(spaced(x)) in near}
    short = {(i, j) for i in texts for j, x in enumerate(texts[i].split("\n")) if 1 <= len(set(spaced(x))) < 5}
    got = {(r.doc_id, r.line) for r in queries.op6_line_dedup(spark, sf).collect()}
    assert expected and (got & short) - met == expected - met
    docs = spark.createDataFrame([(1, "Menu\nAll rights reserved."), (2, "x\nall RIGHTS reserved.\n\n \nmenu"), (3, "a b c d e"), (4, "d c b a")], "doc_id long, text string")
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    got = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, docs, sf).collect()}
    assert got == {1: "Menu\nAll rights reserved.", 2: "x\n\n ", 3: "a b c d e", 4: ""}


# decontamination
def smith_waterman(a, b):
    best, before = 0, [0] * (len(a) + 1)
    for y in b:
        row = [0]
        for j, x in enumerate(a):
            row.append(max(0, before[j] + (2 if x == y else -1), before[j + 1] - 1, row[j] - 1))
        best, before = max(best, *row), row
    return best


def test_alignment():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = rng.integers(0, 4, 30).astype(np.uint64), rng.integers(0, 4, 12).astype(np.uint64)
        assert decontaminate.align(a, b)[0] == smith_waterman(a.tolist(), b.tolist())


def test_decontamination(spark, documents, texts):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = {r.item_id: alnum(r.text) for r in benchmark.collect()}
    edited = {}
    for n, (i, words) in enumerate(items.items()):
        copy = [f"edit{k}" if k % 7 == 3 else w for k, w in enumerate(words)]
        edited[50_000 + n] = ("some words before it " + " ".join(copy) + " and after", i)
    docs = documents.select("doc_id", "text").union(spark.createDataFrame([(d, t) for d, (t, _) in edited.items()], "doc_id long, text string"))
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert all((d, i) in got for d, (_, i) in edited.items() if len(items[i]) >= 8)
    every = texts | {d: t for d, (t, _) in edited.items()}
    for (d, i), score in got.items():
        assert score == pytest.approx(smith_waterman(alnum(every[d]), items[i]) / (2 * len(items[i])))
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0


def test_short_items_and_long_runs(spark):
    rng = np.random.default_rng(6)
    word = lambda n: [f"w{w}" for w in rng.integers(0, 10_000, n)]
    short, long, few = word(4), word(300), word(2)
    benchmark = spark.createDataFrame([(1, " ".join(short)), (2, " ".join(long)), (3, " ".join(few)), (4, None)], "item_id long, text string")
    docs = {
        10: word(50) + short + word(50), 11: word(50) + short[:2] + ["else"] + short[2:] + word(9), 12: word(20) + short[:3] + word(20),
        20: word(40) + long[100:240] + word(40), 21: word(40) + long[10:34] + word(40), 22: word(9) + long[50:81],
        30: word(30) + few + word(30),
    }
    rows = [(d, " ".join(w)) for d, w in docs.items()]
    found = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(10, 1), (20, 2), (22, 2)}
    places = {r.doc_id: (r.first_word, r.last_word) for r in found}
    assert places == {10: (50, 53), 20: (40, 179), 22: (9, 39)}


# quality
def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op8_quality(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50 and sum(r.predicted == r.quality for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


# urls
def test_url_rules(spark, sf):
    urls = [
        "http://Example.COM/en/1", "https://www.example.com/en/x?y", "http://a.b.net/es/1#t", "http://net/fr/", "http://example.org/en/",
        "no scheme", None, "http://badexample.com/en/", "x://example.com?en/", "http://sub.www.example.com/en/", "://com/", "http://com",
    ]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [got[i].rule for i in range(12)] == [
        "example.com/en/", "www.example.com/en/", "net/es/", "net/fr/", None, None, None, "com/", None, "www.example.com/en/", "com/", None,
    ]
    assert [got[i].verdict for i in (0, 1, 2, 3, 7)] == ["block", "allow", "block", "block", "allow"]
    assert (got[0].host, got[0].path, got[8].host, got[8].path, got[5].host, got[6].path) == ("example.com", "/en/1", "example.com", "", "", "")
    assert all(got[i].verdict in ("allow", "block") for i in got)


# top k
def test_top_k_ties_and_nulls(spark, sf):
    rows = [(i, [float(i % 3), 1.0]) for i in range(40)] + [(100, None), (200, [float("nan"), 1.0]), (300, [None, 1.0]), (None, [1.0, 1.0])]
    v = topk.whole_numbers(spark.createDataFrame(rows, "vec_id long, e array<double>"), "vec_id", "e")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(v.where("id % 20 = 0"), v, 5).collect())
    own = {r.id: r.v for r in v.where("id is not null").collect()}
    for q in (0, 20):
        best = sorted((-sum(a * b for a, b in zip(own[q], own[c])), c) for c in own if c != q)[:5]
        assert [g for g in got if g[0] == q] == [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert {g[0] for g in got} == {0, 20}


# odd and empty tables
def run_all(spark, docs, sf):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return {
        "licenses": licenses.digest(licenses.scan(docs)), "near": ngram_join.near_duplicates(docs), "pii": pii.digest(pii.find(docs)),
        "packing": packing.pack(docs, queries.tokenizer_path()), "substrings": substring_dedup.repeated_spans(docs),
        "lines": line_dedup.duplicate_lines(docs), "leaks": decontaminate.contaminated(docs, benchmark), "quality": quality.classify(docs, labels),
    }


def test_odd_tables(spark, odd, sf):
    got = {k: df.collect() for k, df in run_all(spark, odd, sf).items()}
    n = odd.count()
    assert len(got["licenses"]) == len(got["near"]) == len(got["pii"]) == len(got["quality"]) == n
    near = Counter((r.doc_id, r.n_shingles, r.component_id) for r in got["near"])
    assert near[4, 8, 3] == 2 and near[None, 8, 3] == 1 and near[1, 0, 1] == near[2, 0, 2] == 1 and near[None, 0, None] == 1
    assert {(r.doc_id, r.line) for r in got["lines"]} == {(4, 0), (10, 0), (10, 1), (None, 0)}
    assert not got["leaks"] and {r.doc_id for r in got["packing"]} == {r.doc_id for r in odd.collect()}
    assert line_dedup.without_duplicate_lines(odd).count() == n


def test_empty_tables(spark, empty, sf):
    assert all(df.count() == 0 for df in run_all(spark, empty, sf).values())
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    none = topk.whole_numbers(spark.createDataFrame([], "vec_id long, e array<double>"), "vec_id", "e")
    assert topk.top_k(none, none).count() == 0


# pipeline
def test_pipeline(spark, sf, documents, texts):
    docs, names = documents, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    from tallyframe.scratch import materialize

    kept, read = [], []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), "test-stage")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != "packing":
            assert docs.columns == documents.columns
            read.append({r.doc_id: r.text for r in docs.collect()})
    # line dedup: what stays has lines of its own, what goes has none that is not in an earlier document
    lines = [(i, t) for i in sorted(read[0]) for t in (read[0][i] or "").split("\n") if t.strip()]
    first = {}
    for i, line in lines:
        first.setdefault(tuple(sorted(set(spaced(line)))), i)
    assert kept[1] < kept[0]
    for i in kept[0]:
        own = {t for t, f in first.items() if f == i}
        if i in kept[1]:
            assert not (texts[i] or "").strip() or read[1][i].strip()
        else:  # each of its lines equals or nearly equals one of an earlier document
            assert all(any(f < i and 100 * len(set(t) & set(o)) >= 80 * len(set(t) | set(o)) for o, f in first.items()) for t in own)
    # n-gram join: one document of each group of its own input
    assert kept[2] == {root for _, root in components_of(read[1], 5, 80).values()}
    assert kept[2] >= kept[3] == kept[4]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = [i for i in texts if labels.get(i) == 1]
    assert sum(i in kept[0] for i in clean) >= 0.97 * len(clean)


def test_stages_hand_few_rows_to_python(spark, sf):
    """A stage's result is written in small Arrow batches: workers keep the memory of the largest one through later stages."""
    size = F.pandas_udf(lambda x: x * 0 + len(x), "long")
    rows = spark.range(0, 5_000, 1, 1).select(size("id").alias("n"))
    assert corpus_pipeline.materialize(rows, "sizes").agg(F.max("n")).first()[0] <= common.BATCH_ROWS
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
