"""Runs of repeated words: maximal periodic stretches, from suffix trees and Lyndon roots.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends. Every
run holds a Lyndon root: a place i from which the longest Lyndon word, for the order of words or for its
reverse, is one period long. That word ends where the next smaller suffix starts, so both orders give at
most one candidate a place. How far a candidate's period holds to the right is the longest common
extension of its two ends, to the left that of the reversed text; both are depths of lowest common
ancestors in a suffix tree (Ukkonen), read as range minima over its Euler tour in constant time.

Before trees are built, places go that cannot lie in a run: in a run of at least LEAST = 24 words and
three periods, every 8 words in a row occur once more in the text. Repeats are found by hash, so that an
equal hash of unlike words only leaves more to the trees, which compare words themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import Words, mix, rolling, slices

#: Words and periods that a run has at least.
LEAST, PERIODS = 24, 3
#: Words in a row that occur once more within every such run: no more than LEAST / PERIODS.
GRAM = 8


def suffix_tree(s: list[int]) -> tuple[np.ndarray, np.ndarray, list[int], list[int], int]:
    """Ukkonen's tree of ``s`` (numbers from 1) ended by 0: edges as (parent, first number), children, depths, leaves, base.

    ``depths[v]`` is the length of the text that node v spells; ``leaves[i]`` is the leaf of suffix i.
    """
    s = s + [0]
    n, base = len(s), max(s) + 1
    start, end, link, depth, leaves, child = [0], [0], [0], [0], [], {}
    node = edge = length = 0
    for i, c in enumerate(s):
        last = 0
        while len(leaves) <= i:
            if not length:
                edge = i
            key = node * base + s[edge]
            below = child.get(key)
            if below is not None:
                span = end[below] - start[below]
                if length >= span:
                    edge += span
                    length -= span
                    node = below
                    continue
                if s[start[below] + length] == c:
                    length += 1
                    if last:
                        link[last] = node
                    break
                split = len(start)
                first = start[below]
                start.append(first)
                end.append(first + length)
                link.append(0)
                depth.append(i - len(leaves))
                child[key] = split
                start[below] = first + length
                child[split * base + s[first + length]] = below
                child[split * base + c] = split + 1
                if last:
                    link[last] = split
                last = split
            else:
                child[key] = len(start)
                if last:
                    link[last] = node
                    last = 0
            depth.append(n - len(leaves))
            leaves.append(len(start))
            start.append(i)
            end.append(n)
            link.append(0)
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = len(leaves)
    keys = np.fromiter(child.keys(), np.int64, len(child))
    return keys, np.fromiter(child.values(), np.int64, len(child)), depth, leaves, base


def children(keys: np.ndarray, nodes: np.ndarray, base: int, count: int, reverse: bool) -> tuple[list[int], list[int]]:
    """Children of every node one after the other, last one first, and where each node's begin.

    The end of the text comes first in either order of numbers.
    """
    parent, first = keys // base, keys % base
    order = np.lexsort((np.where(first == 0, 0, base - first) if reverse else first, parent))[::-1]
    at = np.zeros(count + 1, np.int64)
    np.add.at(at, parent + 1, 1)
    return nodes[order].tolist(), (len(nodes) - np.cumsum(at)).tolist()


def leaf_order(kids: list[int], at: list[int]) -> np.ndarray:
    """The turn of every node in a walk that takes children in order."""
    turn, stack, step = [0] * (len(at) - 1), [0], 0
    while stack:
        v = stack.pop()
        turn[v] = step
        step += 1
        stack += kids[at[v + 1] : at[v]]
    return np.array(turn, np.int64)


class Extensions:
    """Longest common extensions of suffixes: least depth on the Euler tour between two leaves, by sparse table."""

    def __init__(self, s: list[int]):
        self.tree = keys, nodes, depth, self.leaves, base = suffix_tree(s)
        kids, at = children(keys, nodes, base, len(depth), False)
        tour, first, stack = [], [0] * len(depth), [0]
        while stack:
            v = stack.pop()
            if v < 0:
                tour.append(depth[~v])
                continue
            first[v] = len(tour)
            tour.append(depth[v])
            for c in kids[at[v + 1] : at[v]]:
                stack += (~v, c)
        self.place = np.array(first, np.int64)[self.leaves]
        rows = [np.array(tour, np.int32)]
        while 2 << len(rows) - 1 <= len(tour):
            half = 1 << len(rows) - 1
            rows.append(np.minimum(rows[-1][:-half], rows[-1][half:]))
        self.rows = rows

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Numbers in common from places ``i`` and ``j`` on; the two differ."""
        p, q = self.place[i], self.place[j]
        low, high = np.minimum(p, q), np.maximum(p, q) + 1
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.zeros(len(i), np.int64)
        for k in np.unique(level):
            at = level == k
            row = self.rows[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << int(k))])
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """The next place with a smaller rank, or the place after the last."""
    ranks, n = rank.tolist(), len(rank)
    out, stack = [n] * n, []
    for i in range(n - 1, -1, -1):
        r = ranks[i]
        while stack and ranks[stack[-1]] > r:
            stack.pop()
        if stack:
            out[i] = stack[-1]
        stack.append(i)
    return np.array(out, np.int64)


def runs_of(words: list, least: int = LEAST, periods: int = PERIODS) -> np.ndarray:
    """All runs of ``words`` with at least ``least`` words and ``periods`` (2 or more) periods: start, length, period a row."""
    n = len(words)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    number = {}
    s = [number.setdefault(w, len(number) + 1) for w in words]
    ahead = Extensions(s)
    keys, nodes, depth, leaves, base = ahead.tree
    other = leaf_order(*children(keys, nodes, base, len(depth), True))[leaves]
    ahead.tree = None
    i = np.tile(np.arange(n), 2)
    j = np.concatenate((next_smaller(ahead.place[:n]), next_smaller(other[:n])))
    right = ahead.of(i, j)  # place n is the end, which has nothing in common
    del ahead, keys, nodes, depth, leaves, other
    # what the period needs to the left is asked only where the candidate may be long enough
    period = j - i
    may = period * periods <= n
    i, j, right, period = i[may], j[may], right[may], period[may]
    left = np.zeros(len(i), np.int64)
    inner = np.flatnonzero(i > 0)
    if len(inner):
        back = Extensions(s[::-1])
        left[inner] = back.of(n - i[inner], n - j[inner])
    found = np.stack((i - left, j + right - (i - left), period), 1)
    found = found[found[:, 1] >= np.maximum(least, periods * period)]
    return np.unique(found, axis=0)


def suspects(column: pa.Array, least: int, gram: int) -> tuple[Words, list[tuple[int, int, int]]]:
    """Words of some texts, and stretches (row, first word, word after) outside of which no run can lie."""
    words = Words(column)
    grams = rolling(words.hash, gram)
    if not len(grams):
        return words, []
    place = np.arange(len(grams))
    row = np.searchsorted(words.at, place, "right") - 1
    whole = place + gram <= words.at[row + 1]
    place, row = place[whole], row[whole]
    key = mix(grams[whole] ^ mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    place, row = place[twice], row[twice]
    if not len(place):
        return words, []
    cut = np.flatnonzero((place[1:] != place[:-1] + 1) | (row[1:] != row[:-1])) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(place)])) - 1
    long = place[last] + gram - place[first] >= least
    at = words.at[row[first]]
    return words, list(zip(row[first][long].tolist(), (place[first] - at)[long].tolist(), (place[last] + gram - at)[long].tolist()))


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame, least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, runs (array of start, length, period by start, then period), strongest, collapsed.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0, and compared as they stand. ``strongest`` is the run
    with the greatest length / period, compared exactly (ties: smallest start, then period), null without
    runs. ``collapsed`` is the text's words joined by one space, without what runs repeat: a word goes if
    some run holds it after the run's first period. Null and empty texts have no words and no runs.
    Repeated rows and null ids each give their own row; other columns are not read; no rows give no rows.
    A text is the unit of work: memory is some 400 bytes a word for the texts' longest suspect stretch.
    """
    if periods < 2 or least < 2 * periods:
        raise ValueError("a run has two periods at least, and least must be twice as much")
    gram = min(GRAM, least // 3) if periods > 2 else 1

    def scan(batches):
        for part in slices(batches):
            column = part.column("text")
            words, stretches = suspects(column, least, gram)
            by_row = {}
            for row, first, after in stretches:
                by_row.setdefault(row, []).append((first, after))
            n_words = np.diff(words.at).tolist()
            all_runs, strongest, collapsed = [], [], []
            data, at = words.data.tobytes(), words.offsets.tolist()
            for row in range(len(words)):
                tokens = data[at[row] : at[row + 1]].split()  # of bytes: at \x20 and \x09-\x0D only
                runs = []
                for first, after in by_row.get(row, ()):
                    runs += [(first + s, m, q) for s, m, q in runs_of(tokens[first:after], least, periods).tolist()]
                runs.sort(key=lambda r: (r[0], r[2]))
                best = None
                for r in runs:  # in order of start and period, so that the first of equals stays
                    if best is None or r[1] * best[2] > best[1] * r[2]:
                        best = r
                if runs:
                    gone = np.zeros(len(tokens) + 1, np.int64)
                    for s, m, q in runs:
                        gone[s + q] += 1
                        gone[s + m] -= 1
                    keep = np.cumsum(gone)[:-1] == 0
                    tokens = [t for t, k in zip(tokens, keep.tolist()) if k]
                all_runs.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                strongest.append(best and dict(zip(("start", "length", "period"), best)))
                collapsed.append(b" ".join(tokens))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(all_runs, pa.list_(RUN)),
                 pa.array(strongest, RUN), pa.array(collapsed, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "strongest", "collapsed"],
            )

    run = "struct<start:long,length:long,period:long>"
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id long, n_words long, runs array<{run}>, strongest {run}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with a tenth of the texts made periodic, by the checksum of doc_id.

    With h = crc32(decimal doc_id), g = h div 10 and n words: where h mod 10 is 0, each word i >= a becomes
    word a + (i - a) mod p, for a = g mod n and p = 1 + (n - a) div (3 + g mod 8). Other texts, and those
    under a null id, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))

    def turn(batches):
        for part in slices(batches):
            texts = []
            for text, g in zip(part.column("text").to_pylist(), part.column("g").to_pylist()):
                tokens = (text or "").encode().split() if g is not None else ()
                n = len(tokens)
                if n:
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    cycle = tokens[a : a + p]
                    text = b" ".join(tokens[:a] + (cycle * (-(-(n - a) // p)))[: n - a]).decode()
                texts.append(text)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, F.floor(h / 10)).alias("g"))
    return chosen.mapInArrow(turn, "doc_id long, text string")


def digest(found: DataFrame) -> DataFrame:
    """Per row of ``find_runs``: doc_id, n_runs, the strongest run, and digests of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.expr("(1000 * strongest.length) div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )
