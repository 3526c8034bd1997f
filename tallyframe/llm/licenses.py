"""License scans with a positional index of rare words over license templates.

Words of the templates get an inverse document frequency from the whole corpus. A template is
anchored at its rarest words. Every anchor met in a text votes for (template, place of its first
word); where enough anchors agree, the template's mandatory phrase is compared word by word.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import Words, slices

#: Phrases and the labels they stand for.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Wording of further licenses: label, template, mandatory part of it.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms with or without modification"),
    ("gpl-3.0", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu general public license as published by"),
    ("gpl-2.0", "gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license", "gnu affero general public license"),
    ("mpl", "mozilla public license", "mozilla public license"),
    ("epl", "eclipse public license", "eclipse public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("cc-by-sa", "cc by sa", "cc by sa"),
    ("cc-by-nc", "cc by nc", "cc by nc"),
    ("cc-by", "creative commons attribution", "creative commons attribution"),
    ("cc0", "creative commons zero", "creative commons zero"),
    ("bsl", "boost software license", "boost software license"),
    ("spdx", "spdx license identifier", "spdx license identifier"),
    ("proprietary", "all rights reserved", "all rights reserved"),
)
ANCHORS = 3


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    phrase: tuple[int, int]  # the mandatory part, as places of the template
    base: bool


def templates() -> list[Template]:
    out = [Template(label, tuple(p.split()), (0, len(p.split())), True) for p, label in BASE_PHRASES.items()]
    for label, text, phrase in TEMPLATES:
        words, key = text.split(), phrase.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        out.append(Template(label, tuple(words), (at, at + len(key)), False))
    return out


class Index:
    """Postings of anchor words; bounded by the templates, whatever the corpus."""

    def __init__(self, known: list[Template], idf: dict[str, float]):
        self.known = known
        self.words = sorted({w for t in known for w in t.words})
        number = {w: i for i, w in enumerate(self.words)}
        self.ids = [tuple(number[w] for w in t.words) for t in known]
        self.weight = [tuple(idf.get(w, 0.0) + 1e-9 for w in t.words) for t in known]
        self.postings, self.need = defaultdict(list), []
        for t, one in enumerate(known):
            a, b = one.phrase
            # anchors lie in the mandatory part, so that every true place is voted for by all of them
            rare = sorted(range(a, b), key=lambda p: (-idf.get(one.words[p], 0.0), p))[:ANCHORS]
            for p in rare:
                self.postings[self.ids[t][p]].append((t, p))
            self.need.append(len(rare))
        self.hashes = Words(pa.array([" ".join(self.words)]), "alnum").hash
        self.order = np.argsort(self.hashes)
        self.sorted = self.hashes[self.order]
        self.raw = [w.encode() for w in self.words]

    def known_words(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Places of template words among all words of a slice, and which they are."""
        at = np.minimum(np.searchsorted(self.sorted, words.hash), len(self.sorted) - 1)
        hit = np.flatnonzero(self.sorted[at] == words.hash)
        which = self.order[at[hit]]
        data = words.data
        same = [data[words.start[h] : words.end[h]].tobytes().lower() == self.raw[w] for h, w in zip(hit.tolist(), which.tolist())]
        same = np.array(same, bool)
        return (hit[same], which[same]) if len(hit) else (hit, which)

    def places(self, tokens: dict[int, int]) -> list[tuple[int, int, float]]:
        """(template, first word, score) of each verified place, from template words by place."""
        votes = Counter((t, at - p) for at, w in tokens.items() for t, p in self.postings.get(w, ()))
        out = []
        for (t, first), n in votes.items():
            ids, (a, b) = self.ids[t], self.known[t].phrase
            if n >= self.need[t] and all(tokens.get(first + p) == ids[p] for p in range(a, b)):
                weight = self.weight[t]
                met = sum(weight[p] for p in range(len(ids)) if tokens.get(first + p) == ids[p])
                out.append((t, first, min(1.0, met / sum(weight))))
        return out


def inverse_frequencies(docs: DataFrame, known: list[Template]) -> dict[str, float]:
    """log((rows + 1) / (rows with the word + 1)) of every template word, over all rows."""
    plain = Index(known, {})

    def count(batches):
        total, rows = Counter(), 0
        for part in slices(batches):
            words = Words(part.column("text"), "alnum")
            hit, which = plain.known_words(words)
            doc = np.searchsorted(words.at, hit, "right")
            total.update(w for _, w in set(zip(doc.tolist(), which.tolist())))
            rows += part.num_rows
        names = [plain.words[w] for w in total] + [""]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([*total.values(), rows], pa.int64())], names=["word", "n"])

    found = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {r["word"]: r["n"] for r in found}  # one row per template word at most
    return {w: math.log((n.get("", 0) + 1) / (n.get(w, 0) + 1)) for w in plain.words}


def scan(docs: DataFrame, known: list[Template] | None = None) -> DataFrame:
    """doc_id, n_words, and ``matches``: label, base, first (its first word), last, score, by place.

    Words are runs of a-z, 0-9 and anything beyond ASCII, after lower-casing A-Z. Texts are read
    whole; null is empty and has no words. Rows come out as they went in: repeated rows repeat,
    a null doc_id stays null, no rows give no rows. Other columns are not read. ``score`` is the
    share of the template's weight found in place (1 for a bare phrase).
    """
    known = templates() if known is None else known
    index = Index(known, inverse_frequencies(docs, known))

    def look(batches):
        match = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())])
        for part in slices(batches):
            words = Words(part.column("text"), "alnum")
            hit, which = index.known_words(words)
            doc = np.searchsorted(words.at, hit, "right") - 1
            found = [[] for _ in range(len(words))]
            cuts = np.flatnonzero(np.diff(doc)) + 1
            for places, ids, d in zip(np.split(hit, cuts), np.split(which, cuts), doc[np.concatenate(([0], cuts)).astype(int)] if len(doc) else []):
                own = dict(zip((places - words.at[d]).tolist(), ids.tolist()))
                for t, first, score in sorted(index.places(own), key=lambda m: (m[1], m[0])):
                    one = known[t]
                    found[d].append({"label": one.label, "base": one.base, "first": first + one.phrase[0], "last": first + one.phrase[1] - 1, "score": score})
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(np.diff(words.at), pa.int64()), pa.array(found, pa.list_(match))],
                names=["doc_id", "n_words", "matches"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        look, "doc_id long, n_words long, matches array<struct<label:string,base:boolean,first:long,last:long,score:double>>"
    )


def digest(scanned: DataFrame) -> DataFrame:
    """The columns of a report, from ``scan``."""
    base = F.filter("matches", lambda m: m["base"])
    names = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: m["label"]))), ",")
    starts = F.transform(base, lambda m: m["first"])
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )
