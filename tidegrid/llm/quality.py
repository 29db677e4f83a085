"""Quality classifier: Bradley-Terry ranking. Document scores are learned from preference pairs and cut at a quantile.

Each pair sets a document of label 1 above one of label 0; the chance that the first is preferred is the logistic
function of the difference of their scores, which are linear in text features, so the loss is a logistic one on
feature differences. The cut is the quantile of the scores that leaves the share of label 0 below it; a score in 0..1
is the logistic function of the distance from the cut, with 0.3 at the cut itself.

`fit_all` learns from every labelled row: each row of the larger label is set against rows of the other one, taken in
turn by their places in the order of a hash of doc_id, so that all rows of both are in pairs; Newton steps add up
gradients and curvature over the tasks, and the cut is the exact quantile of all labelled rows' scores. Only sums, and
counts by partition, reach the driver. `fit` does it on a given list, with drawn pairs and gradient steps, and so does
`fit_all` where there are LISTED rows at most, all of them again.

A null text counts as empty; empty texts have all features 0 but length. Without both labels among the rows every
document scores the share of label 1. Ties and repeated rows get equal scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, stage

CUT = 0.3
#: Labelled rows up to which their features are fitted as one list.
LISTED = 3000
#: Pairs that `fit_all` makes at least, where the rows have so many different ones.
PAIRS = 20_000
NAMES = (
    "log_words", "word_length", "upper", "digits", "signs", "odd_signs", "distinct", "top_word", "repeated_threes", "line_copies",
    "odd_signs_up_to_one", "capitals_a_word", "stops", "sentence_words", "longest_word",
)
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_STOP = re.compile(r"[.?](?=\s|$)")
#: Printing signs that prose rarely has.
_ODD = bytes(b"#$%&*|!<>{}[]\\^~=+@_")
_SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_DIGITS = b"0123456789"


def describe(text: str) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    raw = text.encode()
    size = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    signs = int(counts[list(_SIGNS)].sum())
    odd = int(counts[list(_ODD)].sum())
    capitals = len(_UPPER.findall(text))
    told = Counter(words)
    threes = len(set(zip(words, words[1:], words[2:]))) if n > 2 else 0
    lines = [x for x in text.split("\n") if x]
    stops = len(_STOP.findall(text))
    return [
        math.log(n), sum(map(len, told)) / len(told), capitals / size, int(counts[list(_DIGITS)].sum()) / size, signs / size, odd / n,
        math.log(len(told) / n), max(told.values()) / n, 1 - threes / (n - 2) if n > 2 else 0.0, 1 - len(set(lines)) / len(lines) if lines else 0.0,
        min(1.0, odd / n), min(1.0, capitals / n), stops / n, min(100.0, n / (stops + 1)), max(map(len, told)) / 100,
    ]


@dataclass
class Ranking:
    mean: np.ndarray
    sd: np.ndarray
    weights: np.ndarray
    cut: float
    flat: float | None = None

    def inputs(self, rows: np.ndarray) -> np.ndarray:
        x = np.clip((rows - self.mean) / self.sd, -6, 6)
        return np.hstack((x, x * x))

    def strength(self, rows: np.ndarray) -> np.ndarray:
        return self.inputs(rows) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(rows), self.flat)
        return 1 / (1 + np.exp(-np.clip(self.strength(rows) - self.cut + math.log(CUT / (1 - CUT)), -500, 500)))


def fit(rows: list[tuple[str, int]], share: float, pairs: int = 20_000, steps: int = 200, decay: float = 1e-3, seed: int = 1) -> Ranking:
    """Fit on (text, label) rows; `share`: of label 1 among all labelled rows, which sets the quantile of the cut."""
    return _fit(np.array([describe(s) for s, _ in rows] or [[0.0] * len(NAMES)]), np.array([v for _, v in rows] or [0]), share, pairs, steps, decay, seed)


def _fit(x: np.ndarray, y: np.ndarray, share: float, pairs: int = 20_000, steps: int = 200, decay: float = 1e-3, seed: int = 1) -> Ranking:
    it = Ranking(x.mean(0), x.std(0) + 1e-6, np.zeros(2 * len(NAMES)), 0.0, share if len(set(y.tolist())) < 2 else None)
    if it.flat is not None:
        return it
    z = it.inputs(x)
    random = np.random.default_rng(seed)
    d = z[random.choice(np.flatnonzero(y == 1), pairs)] - z[random.choice(np.flatnonzero(y == 0), pairs)]
    mean, square = np.zeros_like(it.weights), np.zeros_like(it.weights)
    for k in range(1, steps + 1):
        grad = -d.T @ (1 / (1 + np.exp(np.clip(d @ it.weights, -500, 500)))) / pairs + decay * it.weights
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        it.weights -= 0.1 * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.999**k)) + 1e-8)
    s = it.strength(x)
    weight = np.where(y == 1, share / (y == 1).mean(), (1 - share) / (y == 0).mean())
    order = np.argsort(s, kind="stable")
    below = np.searchsorted(np.cumsum(weight[order]) / weight.sum(), 1 - share)
    it.cut = float(s[order[min(below, len(s) - 1)]])
    return it


def described(docs: DataFrame) -> DataFrame:
    """doc_id, x (the text's features) for each row, staged."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = np.array([describe(s or "") for s in batch.column(1).to_pylist()]).reshape(-1)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(NAMES), pa.int32()), pa.array(rows))], ["doc_id", "x"])

        return work

    return stage(map_batches(docs.select("doc_id", "text"), make, "doc_id long, x array<double>"), "described")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def _placed(rows: DataFrame, by: list, name: str, weight=None) -> tuple[DataFrame, list[tuple[int, int]]]:
    """`rows` in the order of `by`, dealt by ranges and staged, with part and k (place in the part); and each part's number with its rows (or sum of weights)."""
    told = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("k", F.monotonically_increasing_id())
    told = stage(told.withColumn("part", F.shiftright("k", 33)).withColumn("k", F.col("k").bitwiseAND((1 << 33) - 1)), name)
    sizes = told.groupBy("part").agg(F.count("*") if weight is None else F.sum(weight)).collect()  # a row a partition
    return told, sorted(map(tuple, sizes))


def _pairs(rows: DataFrame, n0: int, n1: int) -> DataFrame:
    """won, lost: features of pairs, staged. Each row is in a pair, each of the larger label in the same number of different ones."""
    told, sizes = _placed(rows.withColumn("h", F.xxhash64("doc_id")), ["y", "h", "doc_id", "x"], "labelled")
    before = np.cumsum([0] + [n for _, n in sizes]).tolist()
    offsets = rows.sparkSession.createDataFrame([(part, b) for (part, _), b in zip(sizes, before)], "part long, before long")
    told = told.join(F.broadcast(offsets), "part").select("y", "x", (F.col("before") + F.col("k") - F.when(F.col("y") == 1, n0).otherwise(0)).alias("place"))
    larger, few, many = (1, n0, n1) if n1 >= n0 else (0, n1, n0)
    turns = F.explode(F.sequence(F.lit(0), F.lit(min(few, -(-PAIRS // many)) - 1)))
    one = told.filter(F.col("y") == larger).select(F.col("x").alias("a"), "place", turns.alias("turn")).select("a", ((F.col("place") + F.col("turn")) % few).alias("place"))
    both = one.join(told.filter(F.col("y") != larger).select(F.col("x").alias("b"), "place"), "place")
    return stage(both.select(*([F.col("a").alias("won"), F.col("b").alias("lost")] if larger else [F.col("b").alias("won"), F.col("a").alias("lost")])), "pairs")


def _sums(pairs: DataFrame, it: Ranking) -> tuple[float, np.ndarray, np.ndarray]:
    """Sums over all pairs: losses, gradients and curvatures at `it`."""
    m = len(it.weights)

    def work(batches):
        told = np.zeros(1 + m + m * m)
        for batch in batches:
            d = it.inputs(_matrix(batch.column(0))) - it.inputs(_matrix(batch.column(1)))
            s = d @ it.weights
            wrong = 1 / (1 + np.exp(np.clip(s, -500, 500)))
            told += np.concatenate(([np.logaddexp(0, -s).sum()], -d.T @ wrong, (d.T @ (d * (wrong * (1 - wrong))[:, None])).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(told)), pa.int32()), pa.array(told)], ["i", "v"])

    sums = np.zeros(1 + m + m * m)
    for i, v in pairs.mapInArrow(work, "i int, v double").groupBy("i").agg(F.sum("v")).collect():  # one row a place of the sums
        sums[i] = v
    return float(sums[0]), sums[1 : 1 + m], sums[1 + m :].reshape(m, m)


def _place(scores: DataFrame, n: int) -> float:
    """The n-th least (from 1) of the column s."""
    told, sizes = _placed(scores.groupBy("s").agg(F.count("*").alias("n")), ["s"], "scores", "n")
    for part, size in sizes:
        if n <= size:
            break
        n -= size
    so_far = F.sum("n").over(Window.partitionBy("part").orderBy("s"))
    return told.filter(F.col("part") == part).withColumn("so_far", so_far).filter(F.col("so_far") >= n).agg(F.min("s")).first()[0]


def fit_all(rows: DataFrame, decay: float = 1e-3, steps: int = 40) -> Ranking:
    """Fit on all of `rows`: doc_id, x (of `described`), y."""
    listed = rows.select("doc_id", "x", "y").limit(LISTED + 1).collect()
    if 0 < len(listed) <= LISTED:
        listed.sort()
        y = np.array([r["y"] for r in listed])
        return _fit(np.array([r["x"] for r in listed]), y, float(y.mean()))
    n, ones, *told = rows.agg(F.count("*"), F.sum("y"), *[f(F.col("x")[j]) for f in (F.avg, F.stddev_pop) for j in range(len(NAMES))]).first()
    n1 = ones or 0
    m = len(NAMES)
    it = Ranking(np.array(told[:m], float), np.array(told[m:], float) + 1e-6, np.zeros(2 * m), 0.0, n1 / max(1, n) if n1 in (0, n) else None)
    if it.flat is not None:
        return it
    pairs = _pairs(rows.select("doc_id", "x", "y"), n - n1, n1)
    count = pairs.count()
    best, step = None, np.zeros_like(it.weights)
    for _ in range(steps):
        loss, grad, curve = _sums(pairs, it)
        loss = loss / count + decay / 2 * float(it.weights @ it.weights)
        if best is not None and loss > best + 1e-12:
            step /= 2  # too far
            it.weights = it.weights - step
            continue
        best = loss
        grad, curve = grad / count + decay * it.weights, curve / count + decay * np.eye(2 * m)
        step = -np.linalg.solve(curve, grad)
        if -float(grad @ step) < 1e-10:
            break
        it.weights = it.weights + step

    def strengths(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(it.strength(_matrix(batch.column(0))))], ["s"])

    it.cut = _place(rows.select("x").mapInArrow(strengths, "s double"), n - n1)
    return it


def scored(rows: DataFrame, it: Ranking) -> DataFrame:
    """doc_id, score for each row of `described`."""

    def work(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(it.score(_matrix(batch.column(1))), pa.float64())], ["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(work, "doc_id long, score double")


def rank(docs: DataFrame, it: Ranking) -> DataFrame:
    """doc_id, score for each row."""
    told = docs.sparkSession.sparkContext.broadcast(it)

    def make():
        own = told.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = np.array([describe(s or "") for s in batch.column(1).to_pylist()]).reshape(-1, len(NAMES))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.score(rows), pa.float64())], ["doc_id", "score"])

        return work

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, score double")
