"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators.

A text's n-grams are its distinct runs of three bytes and of up to four word shapes (how a word is
written, and whether it repeats the word before). Indicators are scaled by the classes' log-count
ratio, each text to unit length, and a linear hinge loss is minimised by dual coordinate descent.
A logistic curve over held-back rows turns margins into scores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import Words, mix, slices, small_batches

#: Labelled rows that a model is fitted on at most: those with the smallest hash of their id.
FIT_ROWS = 8_000
BYTE_BITS, SHAPE_BITS = 16, 12
WIDTH = (1 << BYTE_BITS) + (1 << SHAPE_BITS)
#: Bytes of text whose n-grams a scoring task takes at a time; their arrays need some fifty times that.
SCORE_BYTES = 1 << 18


def grams(column: pa.Array) -> list[np.ndarray]:
    """Distinct n-gram numbers of each text; an empty text has none."""
    words = Words(column)
    data, offsets, n = words.data, words.offsets, len(words)
    wide = data.astype(np.uint64)
    tri = np.zeros(len(data), np.int64)
    if len(data) > 2:
        code = wide[:-2] << np.uint64(16) | wide[1:-1] << np.uint64(8) | wide[2:]
        tri[:-2] = (mix(code + np.uint64(1)) >> np.uint64(64 - BYTE_BITS)).astype(np.int64)
    shapes = np.zeros((4, len(words.start)), np.int64)
    if len(words.start):
        upper, lower = ((data >= a) & (data <= b) for a, b in ((65, 90), (97, 122)))
        digit, high = (data >= 48) & (data <= 57), data >= 128
        other = ~(upper | lower | digit | high) & (data > 32)
        kinds = np.zeros(len(words.start), np.uint64)
        edge = np.column_stack((words.start, words.end)).ravel()
        edge = edge[:-1] if edge[-1] == len(data) else edge
        for k, flag in enumerate((upper, lower | high, digit, other)):
            count = np.add.reduceat(flag.astype(np.int64), edge)[::2]
            kinds |= np.minimum(count, 2).astype(np.uint64) << np.uint64(2 * k)
        again = np.zeros(len(words.start), bool)
        again[1:] = words.hash[1:] == words.hash[:-1]
        again[words.at[:-1][words.at[:-1] < len(again)]] = False
        kinds |= again.astype(np.uint64) << np.uint64(8)
        acc = np.zeros(len(kinds), np.uint64)
        for k in range(4):
            acc[: len(kinds) - k] = acc[: len(kinds) - k] * np.uint64(521) + kinds[k:] + np.uint64(1)
            shapes[k] = (mix(acc + np.uint64(k << 40)) >> np.uint64(64 - SHAPE_BITS)).astype(np.int64) + (1 << BYTE_BITS)
    seen, out = np.zeros(WIDTH, bool), []
    for i in range(n):
        a, b = int(offsets[i]), int(offsets[i + 1])
        seen[tri[a : max(a, b - 2)]] = True
        a, b = int(words.at[i]), int(words.at[i + 1])
        for k in range(4):
            seen[shapes[k, a : max(a, b - k)]] = True
        hit = np.flatnonzero(seen)
        seen[hit] = False
        out.append(hit.astype(np.int32))
    return out


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float, rounds: int, seed: int = 7):
    """Dual coordinate descent for the linear hinge loss; the bias is a feature that is always 1."""
    w, b = np.zeros(len(ratio)), 0.0
    x = [(r, ratio[r] / max(1e-9, float(np.linalg.norm(ratio[r])))) for r in rows]
    norm = np.array([float(v @ v) + 1 for _, v in x])
    alpha = np.zeros(len(x))
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(x)):
            r, v = x[i]
            slope = y[i] * (w[r] @ v + b) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * v
                b += step
                moved, alpha[i] = max(moved, abs(new - alpha[i])), new
        if moved < 1e-3 * cost:
            break
    return w, b


def margins(rows: list[np.ndarray], weights: np.ndarray, ratio_norm: np.ndarray, bias: float) -> np.ndarray:
    return np.array([weights[r].sum() / max(1e-9, float(np.sqrt(ratio_norm[r].sum()))) + bias for r in rows])


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, rounds: int = 20):
    """A model for 0/1 labels: (weights, squared ratios, bias, slope, shift).

    With one class only, every score is that class's share smoothed by one row each; without rows 0.5.
    """
    labels = np.asarray(labels)
    good, n = int((labels == 1).sum()), len(labels)
    if good == 0 or good == n:
        p = (good + 1) / (n + 2)
        return np.zeros(WIDTH), np.ones(WIDTH), 0.0, 0.0, float(np.log(p / (1 - p)))
    y = np.where(labels == 1, 1.0, -1.0)
    back = np.arange(n) % 5 == 4  # calibrates
    if len(set(labels[back])) < 2 or len(set(labels[~back])) < 2:
        back = np.zeros(n, bool)
    counts = np.ones((2, WIDTH))
    for i in np.flatnonzero(~back):
        counts[int(labels[i] == 1)][rows[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    own = [rows[i] for i in np.flatnonzero(~back)]
    w, b = descend(own, y[~back], ratio, cost, rounds)
    weights, squares = w * ratio, ratio**2
    use = back if back.any() else np.ones(n, bool)
    m = margins([rows[i] for i in np.flatnonzero(use)], weights, squares, b)
    t = np.where(y[use] > 0, ((y[use] > 0).sum() + 1) / ((y[use] > 0).sum() + 2), 1 / ((y[use] < 0).sum() + 2))
    theta = np.array([1.0, 0.0])
    design = np.column_stack((m, np.ones(len(m))))
    for _ in range(50):  # Newton steps on the logistic loss, slightly damped
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -50, 50)))
        grad = design.T @ (p - t) + np.array([1e-3, 0]) * theta
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2) + np.diag([1e-3, 0])
        theta = theta - np.clip(np.linalg.solve(hess, grad), -5, 5)
    return weights, squares, b, float(theta[0]), float(theta[1])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = FIT_ROWS):
    """Fit on at most ``limit`` labelled rows of ``docs``; rows with other labels than 0 and 1 are not used.

    The bound covers labelled rows only: the sample is taken by the hash of the id, so it does not
    depend on order or partitions. Several labels of one document count as several rows.
    """
    marks = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id"), F.col(label).cast("int").alias("mark")
    )
    some = marks.orderBy(F.xxhash64("doc_id"), "doc_id", "mark").limit(limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")

    def features(batches):
        for part in slices(batches):
            got = [g.tobytes() for g in grams(part.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), part.column("mark").cast(pa.int32()), pa.array(got, pa.binary())],
                names=["doc_id", "mark", "grams"],
            )

    with small_batches(docs.sparkSession):
        found = rows.mapInArrow(features, "doc_id long, mark int, grams binary").toArrow()
    ids, marks = found["doc_id"].to_numpy(), found["mark"].to_numpy()
    raw = found["grams"].to_pylist()
    order = sorted(range(len(raw)), key=lambda i: (hash_of(int(ids[i])), int(marks[i]), raw[i]))
    return fit_rows([np.frombuffer(raw[i], np.int32) for i in order], marks[order] if order else np.zeros(0, int))


def hash_of(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], np.uint64))[0])


def scorer(model):
    """A column function from text to a score between 0 and 1; null counts as empty."""
    weights, squares, bias, slope, shift = model
    narrow = weights.astype(np.float32), squares.astype(np.float32)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        out = []
        batch = pa.RecordBatch.from_arrays([pa.Array.from_pandas(text, type=pa.large_string())], names=["text"])
        for part in slices([batch], limit=SCORE_BYTES):
            m = margins(grams(part.column("text")), narrow[0], narrow[1], bias)
            out.append(1 / (1 + np.exp(-np.clip(slope * m + shift, -50, 50))))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return score


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text, modulo 5, is 0; null is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, limit: int = FIT_ROWS) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1, higher is better) and ``predicted`` (score >= threshold).

    Only ``text`` enters a score. Columns of ``docs`` with the same names are replaced; nulls and
    empty texts get the score of a text without n-grams; repeated rows get equal scores.
    """
    allowed = labels.where(~held_out(F.col("doc_id")))
    model = train(docs, allowed, limit=limit)
    return docs.withColumns({"held_out": held_out(F.col("doc_id")), "score": scorer(model)(F.col("text"))}).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
