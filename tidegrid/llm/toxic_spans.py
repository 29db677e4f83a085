"""Toxicity: a linear-chain conditional random field tags toxic tokens; its marginals give document scores and offsets.

Only documents are labelled, so tokens get their labels first: a token of a toxic document is labelled toxic if its
word or a beginning of it is found in toxic documents of the sample almost alone. The field has two tags, a weight for
each pair of adjacent tags, and weights of the token's word and beginnings; it is fitted by gradient steps on its
conditional likelihood (forward-backward over windows of tokens). Most tokens carry no weighted feature, and a stretch
of them is one power of a matrix, which holds the sum of their marginals, too; so all tokens count exactly, and steps
are needed at the others alone.

A document's score is a logistic function, fitted on the sample, of the expected number of toxic tokens among all of it
and of the largest marginal of a token with features. The offending offsets are runs of adjacent tokens, with features
or not, whose marginals reach a level. A text that is null or has no token has neither, and gets the score of such
documents. Without both labels in the sample every score is the share of label 1. Ties and repeated rows get equal
scores; an empty table gives an empty result, and columns but doc_id and text are never looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

TOKEN = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings that are features.
STARTS = (4, 5)
#: A labelling feature is in clean documents at most this often by comparison.
CLEAN_SHARE = 0.02
WINDOW = 21
STEPS, RATE, DECAY = 120, 0.15, 1e-4


def features(word: str) -> list[str]:
    return [f"={word}", *(f"{n}{word[:n]}" for n in STARTS if len(word) > n)]


@dataclass
class Field:
    """Weights: `pair[a, b]` of tag b after tag a, `bias` of tag 1, `own` of features for tag 1; `doc` of the document score."""

    pair: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    bias: float = 0.0
    own: dict[str, float] = field(default_factory=dict)
    doc: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def __post_init__(self):
        self.words = {f[1:] for f in self.own if f[0] == "="}
        self.starts = {n: {f[1:] for f in self.own if f[0] == str(n)} for n in STARTS}
        self.powers: dict[int, np.ndarray] = {}
        plain = np.exp(self.pair) * np.exp([0.0, self.bias])
        self.step = plain / np.abs(np.linalg.eigvals(plain)).max()
        #: Its g-th power has step^g twice, and above them the sum over k of 1..g of step^k E step^(g-k), E marking tag 1.
        self.block = np.block([[self.step, self.step @ np.diag([0.0, 1.0])], [np.zeros((2, 2)), self.step]])

    def active(self, word: str) -> bool:
        return word in self.words or any(word[:n] in s for n, s in self.starts.items() if len(word) > n)

    def weight(self, word: str) -> float:
        return self.bias + sum(self.own.get(f, 0.0) for f in features(word))

    def over(self, gap: int) -> tuple[np.ndarray, np.ndarray]:
        """The product of steps over `gap` tokens without features, and the matrix that gives the sum of their marginals."""
        if gap not in self.powers:
            if len(self.powers) > 50_000:
                self.powers.clear()
            told = np.linalg.matrix_power(self.block, gap)
            self.powers[gap] = told[:2, :2].copy(), told[:2, 2:].copy()
        return self.powers[gap]

    def _tokens(self, text: str) -> tuple[str, list[str], set[str]]:
        """The lower-cased text, its tokens, and those of them with features."""
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        words = TOKEN.findall(low)
        return low, words, {w for w in set(words) if self.active(w)}

    def _passes(self, words: list[str], at: list[int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The forward vectors after each token of `at` (and at the start), and the backward vectors there (and before the first)."""
        emit = np.exp(self.pair)
        alphas, last = [np.array([1.0, 0.0])], -1  # before the text the tag is 0
        own = [np.exp([0.0, min(self.weight(words[k]), 500.0)]) for k in at]
        for k, e in zip(at, own):
            a = (alphas[-1] @ self.over(k - last - 1)[0]) @ emit * e
            alphas.append(a / a.sum())
            last = k
        betas, after = [], len(words)
        ahead = np.ones(2)  # what follows a stretch without features
        for k, e in zip(at[::-1], own[::-1]):
            b = self.over(after - k - 1)[0] @ ahead
            betas.append(b / b.sum())
            ahead = emit @ (e * betas[-1])
            after = k
        betas.append(self.over(after)[0] @ ahead)
        return alphas, betas[::-1]

    def marginals(self, text: str) -> list[tuple[int, int, float]]:
        """(start, stop, probability of tag 1) of each token with features, by exact forward-backward over all tokens."""
        return [x for x, _ in self._marked(text)[0]]

    def _marked(self, text: str):
        """Tokens with features as of `marginals` and their numbers; the tokens, and forward and backward vectors."""
        low, words, hot = self._tokens(text)
        at = [k for k, w in enumerate(words) if w in hot]
        alphas, betas = self._passes(words, at)
        spans = [m.span() for m in TOKEN.finditer(low) if m[0] in hot] if hot else []
        told = []
        for (start, stop), k, a, b in zip(spans, at, alphas[1:], betas[1:]):
            p = a * b
            told.append(((start, stop, float(p[1] / p.sum())), k))
        return told, low, words, alphas, betas

    def read(self, text: str, least: float) -> tuple[list[tuple[int, int, float]], float, float]:
        """Runs of adjacent tokens with marginals of `least` or more (start, stop, the largest), the sum of all tokens' marginals, and the largest of those with features."""
        told, low, words, alphas, betas = self._marked(text)
        n, total, most = len(words), sum(p for (_, _, p), _ in told), max((p for (_, _, p), _ in told), default=0.0)
        at = [-1, *(k for _, k in told), n]
        over: dict[int, float] = {k: p for (_, _, p), k in told if p >= least}
        for j, (left, right) in enumerate(zip(at, at[1:])):
            gap = right - left - 1
            if not gap:
                continue
            # The vector behind the stretch is the next token's share of the backward pass.
            behind = np.ones(2) if right == n else np.exp(self.pair) @ (np.exp([0.0, min(self.weight(words[right]), 500.0)]) * betas[j + 1])
            power, sums = self.over(gap)
            total += float(alphas[j] @ sums @ behind / (alphas[j] @ power @ behind))
            # Inside a stretch marginals fall from one end and rise to the other, so the search goes inward from both.
            for inward in ((range(gap) if left >= 0 else ()), (range(gap - 1, -1, -1) if right < n else ())):
                for k in inward:
                    x = (alphas[j] @ self.over(k + 1)[0]) * (self.over(gap - k - 1)[0] @ behind)
                    p = float(x[1] / x.sum())
                    if p < least:
                        break
                    over[left + 1 + k] = p
        if not over:
            return [], total, most
        places = [m.span() for m in TOKEN.finditer(low)]
        runs: list[list] = []
        for k in sorted(over):
            if runs and runs[-1][3] == k - 1:
                runs[-1][1:] = [places[k][1], max(runs[-1][2], over[k]), k]
            else:
                runs.append([*places[k], over[k], k])
        return [(a, b, p) for a, b, p, _ in runs], total, most

    def score(self, text: str | None) -> float:
        _, total, most = self.read(text or "", 2.0)
        return self.of(total, most)

    def of(self, total: float, most: float) -> float:
        a, b, c = self.doc
        z = a + b * math.log1p(total) + c * most
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _weigh(rows: list[tuple[str, int]]) -> tuple[set[str], set[str]]:
    """Features worth a weight, and those that label tokens of toxic documents.

    A feature needs a number of toxic documents and of different words before it (so that copies of a document count once).
    """
    found = {0: Counter(), 1: Counter()}
    sizes = Counter(y for _, y in rows)
    after: dict[str, set[str]] = {}
    for text, y in rows:
        words = TOKEN.findall(text.lower())
        found[y].update({f for w in set(words) for f in features(w)})
        if y:
            for before, w in zip(["", *words], words):
                for f in features(w):
                    after.setdefault(f, set()).add(before)
    keep, labelling = set(), set()
    least = max(3, min(8, sizes[1] // 30))
    sure = 4 + 2 * min(1.0, sizes[1] / 500)
    for f, a in found[1].items():
        if a < least or len(after[f]) < least:
            continue
        p1, p0 = a / sizes[1], found[0][f] / sizes[0]
        p = (a + found[0][f]) / len(rows)
        if (p1 - p0) / math.sqrt(max(p * (1 - p), 1e-9) * (1 / sizes[1] + 1 / sizes[0])) > sure:
            keep.add(f)
            if p0 <= CLEAN_SHARE * p1:
                labelling.add(f)
    return keep, labelling


def fit(rows: list[tuple[str, int]], share: float) -> Field:
    """Fit on (text, label) rows; `share`: of label 1 among all labelled rows, for the level of the document scores."""
    if len({y for _, y in rows}) < 2:
        return Field(doc=(math.log((share + 1e-3) / (1 - share + 1e-3)), 0.0, 0.0))
    keep, labelling = _weigh(rows)
    names = sorted(keep)
    place = {f: k for k, f in enumerate(names)}
    windows, tags = [], []
    for text, y in rows:
        words = TOKEN.findall(text.lower())
        mine = [[place[f] for f in features(w) if f in keep] for w in words]
        hot = [k for k, m in enumerate(mine) if m]
        upto = 0
        for k in [*hot, len(words) // 2]:
            if k < upto or not words:
                continue
            lo = max(0, min(k - WINDOW // 2, len(words) - WINDOW))
            upto = lo + WINDOW
            part = mine[lo:upto] + [[]] * (WINDOW - len(mine[lo:upto]))
            windows.append(part)
            tags.append([int(y and any(names[f] in labelling for f in m)) for m in part])
    n = len(windows)
    y = np.array(tags)
    seq, pos, feat = (np.array(x) for x in zip(*[(s, t, f) for s, w in enumerate(windows) for t, m in enumerate(w) for f in m])) if any(m for w in windows for m in w) else (np.zeros(0, int),) * 3
    w = np.zeros(len(names) + 5)  # own weights, bias, pairs
    mean, square = np.zeros_like(w), np.zeros_like(w)
    seen = np.zeros_like(w)
    np.add.at(seen, feat, y[seq, pos])
    seen[len(names)] = y.sum()
    before = np.concatenate((np.zeros((n, 1), int), y[:, :-1]), 1)
    seen[len(names) + 1 :] = [((before == a) & (y == b)).sum() for a in (0, 1) for b in (0, 1)]
    for k in range(1, STEPS + 1):
        score = np.full((n, WINDOW), w[len(names)])
        np.add.at(score, (seq, pos), w[feat])
        pair = np.exp(w[len(names) + 1 :].reshape(2, 2))
        emit = np.stack((np.ones_like(score), np.exp(np.minimum(score, 50))), 2)
        a = np.zeros((WINDOW + 1, n, 2))
        a[0, :, 0] = 1
        for t in range(WINDOW):
            x = (a[t] @ pair) * emit[:, t]
            a[t + 1] = x / x.sum(1, keepdims=True)
        b = np.ones((n, 2))
        p = np.zeros((n, WINDOW))
        pairs = np.zeros((2, 2))
        for t in range(WINDOW - 1, -1, -1):
            x = a[t + 1] * b
            p[:, t] = x[:, 1] / x.sum(1)
            both = a[t][:, :, None] * pair[None] * (emit[:, t] * b)[:, None, :]
            pairs += (both / both.sum((1, 2), keepdims=True)).sum(0)
            b = (emit[:, t] * b) @ pair.T
            b /= b.sum(1, keepdims=True)
        told = np.zeros_like(w)
        np.add.at(told, feat, p[seq, pos])
        told[len(names)] = p.sum()
        told[len(names) + 1 :] = pairs.ravel()
        grad = (told - seen) / n + DECAY * w
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        w -= RATE * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    it = Field(w[len(names) + 1 :].reshape(2, 2).copy(), float(w[len(names)]), {f: float(v) for f, v in zip(names, w) if abs(v) > 1e-3})
    found = [it.read(text, 2.0) for text, _ in rows]
    x = np.array([[1.0, math.log1p(total), most] for _, total, most in found])
    label = np.array([v for _, v in rows], float)
    weight = np.where(label == 1, share / label.mean(), (1 - share) / (1 - label.mean()))
    v = np.zeros(3)
    for _ in range(50):  # Newton's steps with a little decay
        q = 1 / (1 + np.exp(-x @ v))
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + np.diag([1e-3, 1e-1, 1e-1])
        v -= np.linalg.solve(h, x.T @ (weight * (q - label)) + np.array([1e-3, 1e-1, 1e-1]) * v)
    it.doc = tuple(map(float, v))
    return it


def tag(docs: DataFrame, it: Field, least: float = 0.5) -> DataFrame:
    """doc_id, score and the offending spans (start, stop, p: the largest): runs of adjacent tokens with marginals of `least` or more."""
    told = docs.sparkSession.sparkContext.broadcast((it.pair, it.bias, it.own, it.doc))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("p", pa.float64())]))

    def make():
        own = Field(*told.value)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [own.read(s or "", least) for s in batch.column(1).to_pylist()]
            scores = [own.of(total, most) for _, total, most in found]
            spans = [[{"start": a, "stop": b, "p": p} for a, b, p in x] for x, _, _ in found]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "spans"])

        return work

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, score double, spans array<struct<start:int,stop:int,p:double>>")
