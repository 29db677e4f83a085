"""Language ID by rank-order profiles: a document's most frequent n-grams against each language's, by out-of-place distance.

Texts are lower-cased; a run of characters that are no letters counts as one blank. n-grams of one to three characters
are ranked by their counts (ties: by their code). The distance of a document to a language sums, over the document's
`top` first n-grams, how far each is out of place in the language's profile; one that the profile lacks costs the
largest distance. The score is the share of the distance to the runner-up that the winner saves, in 0..1.

The CODES most frequent letters of the taught texts have codes of their own and all others share one, so the method
tells languages apart by those; scripts with more letters than that in common use would need wider codes.

A text that is null or has no letter is `und` with score 0. Languages at equal distance: the first by name. Repeated
rows get equal results and an empty table an empty one; columns but those named are never looked at. Profiles
come from labelled rows; rows without text or lang teach nothing. Without any taught row every text is `und`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

UNDEFINED = "und"
#: Letters that have codes of their own; all others share one.
CODES = 61
BLANK, OTHER = 0, 62
GRAMS = 64 + 64**2 + 64**3


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, 0 for what is no letter, runs of 0 as one, one at either end."""
    points = np.frombuffer(("\n" + text.lower() + "\n").encode("utf-32-le"), "<u4")
    kind = _kinds()
    letters = np.where(kind[np.minimum(points, len(kind) - 1)], points, 0)
    keep = np.ones(len(letters), bool)
    keep[1:] = (letters[1:] != 0) | (letters[:-1] != 0)
    return letters[keep]


_table: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    if not _table:
        _table.append(np.array([chr(p).isalpha() for p in range(0x30000)] + [False]))
    return _table[0]


class Profiles:
    """Ranks of the languages' n-grams over an alphabet of their most frequent letters."""

    def __init__(self, texts: dict[str, list[str]], top: int):
        self.top = top
        self.names = sorted(texts)
        letters: dict[int, int] = {}
        for rows in texts.values():
            for s in rows:
                for p, n in zip(*np.unique(_letters(s), return_counts=True)):
                    letters[int(p)] = letters.get(int(p), 0) + int(n)
        letters.pop(0, None)
        self.alphabet = sorted(letters, key=lambda p: (-letters[p], p))[:CODES]
        self._map()
        self.ranks = np.full((len(self.names), GRAMS), top, np.int16)
        for k, name in enumerate(self.names):
            counts = np.zeros(GRAMS, np.int64)
            for s in texts[name]:
                grams, n = self._grams(s)
                counts[grams] += n
            first = np.lexsort((np.arange(GRAMS), -counts))[:top]
            first = first[counts[first] > 0]
            self.ranks[k, first] = np.arange(len(first))

    def _map(self) -> None:
        self.code = np.full(0x30001, OTHER, np.uint32)
        self.code[0] = BLANK
        self.code[self.alphabet] = np.arange(1, len(self.alphabet) + 1)

    def _grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        c = self.code[np.minimum(_letters(text), 0x30000)]
        two = 64 + c[:-1] * 64 + c[1:]
        three = (64 + 64**2) + (two[:-1] - 64) * 64 + c[2:]
        one = np.bincount(c, minlength=64)
        own = np.flatnonzero(one[1:]) + 1  # a lone blank is no n-gram
        grams = np.sort(np.concatenate((two, three)).astype(np.uint32))
        edge = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
        n = np.diff(np.append(edge, len(grams)))
        return np.concatenate((own, grams[edge].astype(np.int64))), np.concatenate((one[own], n))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.names or len(_letters(text)) < 2:
            return UNDEFINED, 0.0
        grams, counts = self._grams(text)
        if len(grams) > self.top:
            least = np.partition(counts, len(counts) - self.top)[len(counts) - self.top]
            keep = counts >= least
            grams, counts = grams[keep], counts[keep]
        first = grams[np.lexsort((grams, -counts))][: self.top]
        far = np.abs(self.ranks[:, first].astype(np.int32) - np.arange(len(first), dtype=np.int32)).sum(1)
        order = np.argsort(far, kind="stable")
        best = int(far[order[0]])
        second = int(far[order[1]]) if len(far) > 1 else self.top * len(first)
        return self.names[order[0]], 1 - best / second if second else 0.0


def fit(docs: DataFrame, teaches: Column, per_language: int, top: int) -> Profiles:
    """Profiles from at most about `per_language` texts of each language that `teaches` marks (a bounded sample by a hash of doc_id)."""
    taught = docs.filter(teaches & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in taught.groupBy("lang").count().collect()}  # a row a language
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    shares = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, per_language / n)]) if sizes else F.lit(None).cast("map<string,double>")
    chosen = taught.filter(place < F.try_element_at(shares, F.col("lang")))
    texts: dict[str, list[str]] = {}
    for r in chosen.select("lang", "text").collect():
        texts.setdefault(r["lang"], []).append(r["text"])
    return Profiles(texts, top)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred, score for each row."""
    told = docs.sparkSession.sparkContext.broadcast((profiles.names, profiles.alphabet, profiles.top, [(np.flatnonzero(r < profiles.top), r[r < profiles.top]) for r in profiles.ranks]))

    def make():
        names, alphabet, top, ranks = told.value
        it = Profiles.__new__(Profiles)
        it.names, it.alphabet, it.top = names, alphabet, top
        it._map()
        it.ranks = np.full((len(names), GRAMS), top, np.int16)
        for k, (at, r) in enumerate(ranks):
            it.ranks[k, at] = r

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [it.predict(s) for s in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], ["doc_id", "lang_pred", "score"])

        return work

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, lang_pred string, score double")
