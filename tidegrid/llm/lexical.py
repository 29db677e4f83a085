"""Ranked lexical search by Fagin's threshold algorithm, over an index that is dealt by documents.

A text's terms are its maximal runs of letters and digits (all signs but ASCII's others), of which only A-Z are lower-cased.
Each document's row of the forward index holds its number of terms and, for the terms that the items ask for, how often
they occur. Documents holding a term are counted over all rows, and so are the sums that scores need.

Then each task searches its own documents. For each term that is asked for it has a list of its documents, sorted by
impact (what the term adds to a score). An item's lists are read round-robin, STEP entries of each at first and twice as
many in each round after; each new document gets its full score at once by looking up its row of the forward index. The
sum of the impacts last read is the threshold: no document unseen so far can score more. When it falls strictly below
the k-th best score, the task's best are certain, equal scores too, and reading stops. The best of each task are merged
by score and doc_id, first in groups of tasks. A task's lists hold its own documents only, so a term that every document
has makes no task larger than another.

Items go in blocks of about ITEMS; a block's terms and their counts are what goes through the driver and into closures.

Null and blank texts have no terms; such documents count for nothing, such items find nothing. Items of one id are one
item with the terms of all its texts; items without an id are one, too. Each row of documents counts as a document, also
repeated ones; equal scores stand by ascending doc_id, rows without one last. Empty tables give empty results; other
columns are never looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, stage

TOP = 50
#: Items that are searched for at one time, about.
ITEMS = 1000
#: Entries of each list that are read in the first round.
STEP = 32
#: Documents that a task searches at one time.
SHARD = 1 << 14
#: The weights' and scores' fixed numbers.
SCALE, K1, FLAT, LENGTH = 1_000_000_000, 1000, 50, 20
#: Signs that part terms, as the pattern's class has them.
PATTERN = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
INDEX = "doc_id long, n long, codes array<int>, often array<int>"


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLDED).split()


def items_of(benchmark: DataFrame, block: int, blocks: int) -> list[tuple[int | None, set[bytes]]]:
    """(item_id, terms) of the items of a block."""
    rows = benchmark.select("item_id", "text").filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).distinct().collect()
    out: dict[int | None, set[bytes]] = {}
    for r in rows:
        out.setdefault(r["item_id"], set()).update(terms(r["text"]))
    return list(out.items())


def index(docs: DataFrame, codes: dict[bytes, int]) -> DataFrame:
    """The forward index: number of terms, and codes and counts of those in `codes`."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, found, often = [], [], []
            for text in batch.column("text").to_pylist():
                own = terms(text)
                sizes.append(len(own))
                told = [(codes[t], k) for t, k in Counter(own).items() if t in codes]
                found.append([c for c, _ in told])
                often.append([k for _, k in told])
            arrays = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "codes", "often"])

        return work

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, INDEX)


class Shard:
    """Some documents' forward index and impact-sorted lists."""

    def __init__(self, n: np.ndarray, starts: np.ndarray, codes: np.ndarray, often: np.ndarray, weights: np.ndarray, documents: int, length: int):
        m = 100 - FLAT + FLAT * n * documents // max(1, length)
        doc = np.repeat(np.arange(len(n)), np.diff(starts))
        self.starts, self.codes = starts, codes
        self.impact = weights[codes] * (SCALE * often // (K1 * often + LENGTH * m[doc]))
        order = np.lexsort((-self.impact, codes))
        self.list_docs, self.list_impacts = doc[order], self.impact[order]
        self.ends = np.searchsorted(codes[order], np.arange(len(weights) + 1))
        self.asked = np.zeros(len(weights), bool)
        self.seen = np.zeros(len(n), bool)

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Full scores of `docs` for the terms asked for: random lookups in the forward index."""
        sizes = self.starts[docs + 1] - self.starts[docs]  # at least 1: they come from a list
        first = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) - np.repeat(first - self.starts[docs], sizes)
        return np.add.reduceat(np.where(self.asked[self.codes[at]], self.impact[at], 0), first)

    def best(self, item: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the item's `top` documents by score and id (`ids`: ranks of the ids)."""
        lists = [(a, b) for a, b in zip(self.ends[item].tolist(), self.ends[item + 1].tolist()) if a < b]
        self.asked[item] = True
        docs, scores, at, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, STEP
        while lists:
            read = np.unique(np.concatenate([self.list_docs[a + at : min(a + at + step, b)] for a, b in lists]))
            new = read[~self.seen[read]]
            if len(new):
                self.seen[new] = True
                docs, scores = np.concatenate((docs, new)), np.concatenate((scores, self.scores(new)))
                keep = np.lexsort((ids[docs], -scores))[:top]
                docs, scores = docs[keep], scores[keep]
            at, step = at + step, 2 * step
            lists = [(a, b) for a, b in lists if a + at < b]
            threshold = sum(int(self.list_impacts[a + at - 1]) for a, _ in lists)
            if len(docs) == top and threshold < scores[-1]:
                break
        self.asked[item] = False
        self.seen[:] = False
        some = scores > 0
        return docs[some], scores[some]


def searched(items: list[np.ndarray], weights: np.ndarray, documents: int, length: int, top: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Turns a task's rows of the index into its best documents of each item: item (its place), doc_id, score."""

    def merged(best: dict[int, pa.Table], found: dict[int, pa.Table]) -> None:
        for k, told in found.items():
            both = pa.concat_tables([best[k], told]) if k in best else told
            best[k] = both.sort_by([("score", "descending"), ("doc_id", "ascending")]).slice(0, top)

    def search(rows: pa.Table) -> dict[int, pa.Table]:
        lists = rows.column("codes").combine_chunks()
        starts = lists.offsets.to_numpy().astype(np.int64)
        codes, often = (rows.column(c).combine_chunks().values.to_numpy() for c in ("codes", "often"))
        shard = Shard(rows.column("n").to_numpy(), starts - starts[0], codes, often.astype(np.int64), weights, documents, length)
        ids = rows.column("doc_id").combine_chunks()
        ranks = np.empty(len(ids), np.int64)
        ranks[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        out = {}
        for k, item in enumerate(items):
            docs, scores = shard.best(item, ranks, top)
            if len(docs):
                out[k] = pa.table({"doc_id": ids.take(pa.array(docs)), "score": scores})
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, best = [], 0, {}
        for batch in (b.slice(k, SHARD) for b in batches for k in range(0, b.num_rows, SHARD)):
            held.append(batch)
            n += batch.num_rows
            if n >= SHARD:
                merged(best, search(pa.Table.from_batches(held)))
                held, n = [], 0
        if n:
            merged(best, search(pa.Table.from_batches(held)))
        for k, told in best.items():
            told = told.combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(told), pa.int32()), *[told.column(c).chunk(0) for c in ("doc_id", "score")]], ["item", "doc_id", "score"])

    return run


def _ranked(found: DataFrame, top: int, *key: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def rank(docs: DataFrame, benchmark: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score of each item's `top` documents."""
    spark = docs.sparkSession
    blocks = max(1, -(-benchmark.count() // ITEMS))
    out = None
    for block in range(blocks):
        items = items_of(benchmark, block, blocks)
        codes = {t: k for k, t in enumerate(sorted(set().union(*(own for _, own in items))))}
        rows = stage(index(docs, codes), "index")
        sums = rows.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.sum("n").alias("length")).first()
        holding = np.zeros(len(codes), np.int64)
        for r in rows.select(F.explode("codes").alias("code")).groupBy("code").count().collect():  # a row for each term of the block
            holding[r["code"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * sums["documents"] + 2) / (2 * df + 1))) for df in holding.tolist()], np.int64)
        asked = [np.array(sorted(codes[t] for t in own), np.int64) for _, own in items]
        search = searched(asked, weights, sums["documents"], sums["length"] or 0, top)
        found = rows.filter(F.size("codes") > 0).mapInArrow(search, "item int, doc_id long, score long").withColumn("part", F.spark_partition_id() % 32)
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(items)], "item int, item_id long")
        told = _ranked(_ranked(found, top, "item", "part").drop("rank"), top, "item").join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # one row for each item of the block
        out = told if out is None else out.unionByName(told)
    return out


def sql(top: int = TOP) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = f"unnest(regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '{PATTERN}')) AS term"
    return f"""
WITH f AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {words} FROM documents) GROUP BY ALL),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM f GROUP BY 1),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM d),
q AS (SELECT DISTINCT item_id, {words} FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM f, c GROUP BY term, docs),
m AS (SELECT doc_id, {100 - FLAT} + ({FLAT} * n * docs) // length AS m FROM d, c),
s AS (SELECT q.item_id, f.doc_id, CAST(sum(w.w * (({SCALE} * f.tf) // ({K1} * f.tf + {LENGTH} * m.m))) AS BIGINT) AS score FROM q JOIN f ON f.term = q.term JOIN w ON w.term = q.term JOIN m ON m.doc_id = f.doc_id GROUP BY 1, 2)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM s WHERE score > 0) WHERE k <= {top}"""
