"""Hierarchical multi-length packing of documents into training sequences.

Documents are routed to the smallest context window that holds them (longer ones to the longest
window). The documents of an input partition (a lane) form one stream, long windows first: each
window size is filled by its own documents, its last window by documents of the next shorter size,
and what the shortest leaves over is cut into powers of two, so no sequence needs padding. Windows
of one size are numbered into step groups of equal token counts.

Token ids are written once to the shared scratch folder; positions, lane totals and window
boundaries are data, so a lost executor repeats single tasks with the same result.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import materialize, slices

WINDOWS = (4096, 2048, 1024, 512)
#: Bytes of words and ids that a task remembers in each of two generations.
REMEMBER = 40 << 20
#: Bytes a remembered word costs beyond its letters and ids: two objects and its place in a table.
PER_WORD = 160
#: Lanes whose layout is sent to every task; that of more lanes is joined by a shuffle.
BROADCAST_LANES = 50_000
_ODD_SPACE = re.compile("[\x1c-\x1f]")  # split() parts words here, the tokenizer does not
#: Unicode white space.
_SPACES = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_SPACE = re.compile("[^" + "".join(map(chr, _SPACES)) + "]+")


#: Words of one token run that every Unicode version classes alike: lower-case Latin letters.
_PLAIN = re.compile("[a-z\xdf-\xf6\xf8-\u024f]+")
PLAIN_AT_ONCE = 2_000


class WordTokenizer:
    """Ids of whole texts from a tokenizer that drops white space and never joins words across it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.inner = Tokenizer.from_file(path)
        self.forget()
        # The same merges without normalising, for many plain words in one call; their ends are told by the ids.
        self.bare = Tokenizer(self.inner.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary, suffix = self.inner.get_vocab(), self.inner.model.end_of_word_suffix
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            for token, number in vocabulary.items():
                self.closes[number] = token.endswith(suffix)

    def encode(self, words: list[str]) -> list[bytes]:
        out: dict[str, bytes] = {}
        plain = [w for w in words if _PLAIN.fullmatch(w) and w == w.lower()]
        for first in range(0, len(plain), PLAIN_AT_ONCE):
            some = plain[first : first + PLAIN_AT_ONCE]
            ids = np.array(self.bare.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.closes[ids]) + 1) * 4
            if len(ends) == len(some):
                raw, ends = ids.tobytes(), ends.tolist()
                out.update(zip(some, (raw[a:b] for a, b in zip([0, *ends], ends))))
        rest = [w for w in words if w not in out]
        if rest:
            got = self.inner.encode_batch_fast(rest, add_special_tokens=False)
            out.update(zip(rest, (np.array(e.ids, "<u4").tobytes() for e in got)))
        return [out[w] for w in words]

    def forget(self) -> None:
        self.known, self.older, self.held = {}, {}, 0

    def learn(self, words: set[str]) -> None:
        """Ids of words not met lately; a trailing full stop or comma is a token run of its own."""
        known, older, before = self.known, self.older, len(self.known)
        if older:
            kept = {w: older[w] for w in words if w in older}
            known.update(kept)
            words = words.difference(kept)
        todo, cut = set(), {}
        for w in words:
            stem = w[:-1]
            if w[-1] in ".," and stem and stem[-1].isalpha():
                cut[w] = stem
                todo.update((stem, w[-1]))
            else:
                todo.add(w)
        todo = [w for w in todo if w not in known]
        got = self.encode(todo)
        known.update(zip(todo, got))
        known.update((w, known[stem] + known[w[-1]]) for w, stem in cut.items())
        self.held += PER_WORD * (len(known) - before) + sum(map(len, words)) + sum(map(len, got))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = []
        for t in texts:
            # lower case first where that commutes with the tokenizer's own steps
            if "<|" not in t and "Σ" not in t and unicodedata.is_normalized("NFC", t):
                t = t.lower()
            split.append(_SPACE.findall(t) if _ODD_SPACE.search(t) else t.split())
        if self.held > REMEMBER:  # words in use move on to the new generation
            self.known, self.older, self.held = {}, self.known, 0
        new = set().union(*split).difference(self.known)
        if new:
            self.learn(new)
        return [b"".join(map(self.known.__getitem__, words)) for words in split]


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def tokens(docs: DataFrame, path: str, end_id: int, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Per document: ``doc_id``, ``lane``, ``tier`` (its window), ``before`` (tokens of earlier
    documents of that lane and tier), ``n`` and ``ids`` (with the closing id)."""
    close = np.array([end_id], "<u4").tobytes()
    sizes = sorted(windows)

    def encode(batches):
        lane, filled = TaskContext.get().partitionId(), dict.fromkeys(sizes, 0)
        tokenizer = word_tokenizer(path)
        # A worker outlives its task: words of an interrupted one go here, those of this one at its end.
        tokenizer.forget()
        for part in slices(batches, limit=1 << 20):
            texts = [t or "" for t in part.column("text").to_pylist()]
            ids = [x + close for x in tokenizer.ids(texts)]
            tier, before = [], []
            for x in ids:
                n = len(x) // 4
                tier.append(next((w for w in sizes if n <= w), sizes[-1]))
                before.append(filled[tier[-1]])
                filled[tier[-1]] += n
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array([lane] * len(ids), pa.int64()), pa.array(tier, pa.int32()),
                 pa.array(before, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "lane", "tier", "before", "n", "ids"],
            )
        tokenizer.forget()

    return docs.select("doc_id", "text").mapInArrow(
        encode, "doc_id long, lane long, tier int, before long, n long, ids binary"
    )


def layout(encoded: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Per lane: ``total``, and by window size, longest first, where its documents (``starts``) and
    its windows (``regions``) begin."""
    sizes = sorted(windows, reverse=True)
    sums = encoded.groupBy("lane").agg(
        F.sum("n").alias("total"), *[F.sum(F.when(F.col("tier") == w, F.col("n")).otherwise(0)).alias(f"t{w}") for w in sizes]
    )
    start, region = F.lit(0).cast("long"), F.lit(0).cast("long")
    starts, regions = [], []
    for w in sizes:
        starts.append(start)
        regions.append(region)
        start = start + F.col(f"t{w}")
        gap = F.greatest(start - region, F.lit(0).cast("long"))
        region = region + F.ceil(gap / w).cast("long") * w
    return sums.select("lane", "total", F.array(*starts).alias("starts"), F.array(*regions).alias("regions"))


def place(pos: int, total: int, regions: list[int], sizes: list[int]) -> tuple[int, int, int]:
    """Window around a position of a lane's stream: where it begins, its length, its number."""
    number = 0
    for k, w in enumerate(sizes):
        after = regions[k + 1] if k + 1 < len(sizes) else None
        if after is None or pos < after:
            index = (pos - regions[k]) // w
            begin = regions[k] + index * w
            number += index
            if begin + w <= total:
                return begin, w, number
            break
        number += (after - regions[k]) // w
    rest = total - begin  # cut into powers of two, largest first
    while True:
        size = 1 << (rest.bit_length() - 1)
        if pos < begin + size:
            return begin, size, number
        begin, rest, number = begin + size, rest - size, number + 1


def pack(
    docs: DataFrame, path: str, end_id: int = 2, windows: tuple[int, ...] = WINDOWS, step_tokens: int = 32_768
) -> DataFrame:
    """Pieces of all ``docs`` in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, window (tokens of the sequence), step_group and ids.

    ``windows`` are powers of two. Null or empty text is the closing id alone; a null doc_id stays
    null; repeated rows are packed once each; no rows give no pieces. Other columns are not read.
    ``step_group`` numbers sequences of one lane and window size by ``step_tokens`` tokens.
    """
    sizes = sorted(windows, reverse=True)
    encoded = materialize(tokens(docs, path, end_id, windows), "tokens")
    lanes = materialize(layout(encoded, windows), "lanes")
    # one row of about 150 bytes per input partition
    placed = encoded.join(F.broadcast(lanes) if lanes.count() <= BROADCAST_LANES else lanes, "lane")

    def cut(batches):
        for part in batches:
            rows = {k: [] for k in SCHEMA}
            blob = part.column("ids")
            ends = np.frombuffer(blob.buffers()[1], "<i4")[blob.offset : blob.offset + len(blob) + 1].tolist()
            data = memoryview(blob.buffers()[2] or b"")
            plain = [part.column(c).to_pylist() for c in COLUMNS if c != "ids"]
            for r, (doc, lane, tier, before, n, total, starts, regions) in enumerate(zip(*plain)):
                pos = first = starts[sizes.index(tier)] + before
                view = data[ends[r] : ends[r + 1]]
                while pos < first + n:
                    begin, size, number = place(pos, total, regions, sizes)
                    end = min(begin + size, first + n)
                    piece = view[(pos - first) * 4 : (end - first) * 4]
                    per = max(1, step_tokens // size)
                    for k, v in zip(SCHEMA, (doc, pos - first, end - pos, zlib.crc32(piece), n, lane << 32 | number, pos - begin, size,
                                             (lane << 32 | number // per) * 64 + size.bit_length(), bytes(piece))):
                        rows[k].append(v)
                    pos = end
            yield pa.RecordBatch.from_arrays([pa.array(rows[k], t) for k, t in TYPES.items()], names=list(TYPES))

    return placed.select(*COLUMNS).mapInArrow(cut, SQL_TYPES)


COLUMNS = ("doc_id", "lane", "tier", "before", "n", "ids", "total", "starts", "regions")
SCHEMA = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group", "ids")
TYPES = {k: pa.binary() if k == "ids" else pa.int64() for k in SCHEMA}
SQL_TYPES = ", ".join(f"`{k}` {'binary' if k == 'ids' else 'long'}" for k in SCHEMA)
