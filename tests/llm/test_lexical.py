import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidegrid.llm import lexical


def cut(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top):
    rows = [(d, cut(t)) for d, t in docs]
    n_docs, length = sum(bool(t) for _, t in rows), sum(len(t) for _, t in rows)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(cut(t))
    out = []
    for i, own in asked.items():
        scored = []
        for d, words in rows:
            m = 50 + 50 * len(words) * n_docs // length if length else 0
            score = 0
            for t in own & set(words):
                df = sum(t in w for _, w in rows)
                tf = words.count(t)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (10**9 * tf // (1000 * tf + 20 * m))
            if score > 0:
                scored.append((score, d))
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(i, k + 1, d, s) for k, (s, d) in enumerate(scored[:top])]
    return sorted(out, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def told(df):
    return sorted([tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()], key=lambda x: (x[0] is None, x[0] or 0, x[1]))


@pytest.mark.parametrize("step, shard, items", [(32, 1 << 14, 1000), (1, 9, 4)])
def test_equals_brute_force(spark, monkeypatch, step, shard, items):
    """Zipf-like words with many equal scores, over several partitions, shards and blocks of items."""
    for name, value in (("STEP", step), ("SHARD", shard), ("ITEMS", items)):
        monkeypatch.setattr(lexical, name, value)
    r = random.Random(7)
    words = [f"{'Wé'[r.random() < 0.3]}{k}" for k in range(60)]
    text = lambda n: "".join(words[min(59, int(r.paretovariate(0.6)))] + r.choice(" -\n_\x1c") for _ in range(n))
    docs = [(k, text(r.randint(0, 40))) for k in range(150)]
    docs += [(200, docs[3][1]), (201, docs[3][1]), (202, None), (203, ""), (None, docs[3][1]), (204, "W1 " * 3000)]
    asked = [(k, text(r.randint(1, 12))) for k in range(9)] + [(3, text(4)), (3, text(4)), (9, None), (10, "nowhere"), (None, text(5))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("score", F.lit("x")).withColumn("rank", F.lit(1)).repartition(5)
    bench = spark.createDataFrame(asked, "item_id bigint, text string").withColumn("codes", F.lit(1))
    assert told(lexical.rank(df, bench, 7)) == brute(docs, asked, 7)


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "one two five"), (2, "ÜNÏCÖDÉ 日本 A")], "item_id bigint, text string")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    asked = [(1, "one two five"), (2, "ÜNÏCÖDÉ 日本 A")]
    assert told(lexical.rank(odd, bench)) == brute(rows, asked, 50)
    assert told(lexical.rank(none, bench)) == told(lexical.rank(odd, bench.limit(0))) == []


def test_reading_stops_early():
    """A rare term's list ends the search before the frequent term's list is read."""
    import numpy as np

    n = 5000
    often = np.concatenate((np.ones(n, np.int64), np.ones(60, np.int64)))
    codes, doc = np.concatenate((np.zeros(n, np.int64), np.ones(60, np.int64))), np.concatenate((np.arange(n), np.arange(60)))
    order = np.lexsort((codes, doc))
    starts = np.searchsorted(doc[order], np.arange(n + 1))
    shard = lexical.Shard(np.full(n, 10), starts, codes[order], often[order], np.array([5, 4000]), n, 10 * n)
    looked, scores = [], shard.scores
    shard.scores = lambda docs: looked.append(len(docs)) or scores(docs)
    docs, _ = shard.best(np.array([0, 1]), np.arange(n), 50)
    assert sorted(docs.tolist()) == list(range(50)) and sum(looked) < 300
