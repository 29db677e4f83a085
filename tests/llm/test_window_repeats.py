import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import registry, window_repeats


def brute(rows, size):
    """By (doc_id, text): n_words, n_removed, kept words joined."""
    split = {(k, t): re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in rows}
    first = {}
    order = sorted(split, key=lambda x: x[0])
    for doc in order:
        for i in range(len(split[doc]) - size + 1):
            first.setdefault(tuple(split[doc][i : i + size]), (doc, i))
    out = {}
    for doc, words in split.items():
        gone = set()
        for i in range(len(words) - size + 1):
            if first[tuple(words[i : i + size])] != (doc, i):
                gone.update(range(i, i + size))
        out[doc] = (len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
    return out


def texts(seed, n=80):
    r = random.Random(seed)
    parts = [" ".join(r.choice(("a", "b", "çé", "dd")) for _ in range(r.randint(5, 60))) for _ in range(6)]
    return ["\t".join(r.choice(parts) if r.random() < 0.6 else " ".join(r.choice("xyzuvw") for _ in range(9)) for _ in range(r.randint(0, 7))) for _ in range(n)]


@pytest.mark.parametrize("cells, held, piece", [(1 << 29, 1 << 22, 1 << 20), (1 << 4, 50, 7)])
def test_equals_brute_force(spark, monkeypatch, cells, held, piece):
    """The same with a sketch that lets all pass, small flushes and pieces."""
    monkeypatch.setattr(window_repeats, "HELD", held)
    monkeypatch.setattr(window_repeats, "PIECE", piece)
    rows = list(enumerate([*texts(1), None, "", " ", "word " * 300, "word\n" * 300, "x" * 4000]))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("id", F.lit("clash")).withColumn("bucket", F.lit(1)).repartition(7)
    for size in (1, 5, 20):
        want = {k[0]: v for k, v in brute(rows, size).items()}
        got = {r["doc_id"]: tuple(r)[1:] for r in window_repeats.remove(df, size, cells).collect()}
        assert got == want


def test_given_documents(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = {k[0]: (v[0], v[1], hashlib.sha256(v[2].encode()).hexdigest()) for k, v in brute(rows, 20).items()}
    got = {r["doc_id"]: tuple(r)[1:] for r in registry.op11_window_repeats(spark, "/root/testdata/sf0.001").collect()}
    assert got == want and sum(v[1] for v in want.values()) > 1000


def test_odd_rows(spark, odd, none):
    """Repeated rows are one document; rows without an id come last; texts of one id are different documents; nothing from nothing."""
    line = " ".join(f"w{k}" for k in range(25))
    df = spark.createDataFrame([(1, line), (1, line), (None, line), (2, "new " + line), (3, "one"), (3, line + " x")], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"], r["kept"]) for r in window_repeats.remove(df, 20).collect())
    assert got == [(-1, 25, 25, ""), (1, 25, 0, line), (1, 25, 0, line), (2, 26, 25, "new"), (3, 1, 0, "one"), (3, 26, 25, "x")]
    assert window_repeats.digests(none).count() == 0
    assert window_repeats.digests(odd).count() == odd.count()


def test_sketch_never_counts_too_low():
    r = np.random.default_rng(3)
    h = r.integers(0, 1 << 63, 5000, dtype=np.uint64)
    bits = np.zeros((window_repeats.ROWS, 1 << 10), np.uint8)
    for row in range(window_repeats.ROWS):
        for c in window_repeats._cell(h[::2], row, 1 << 13):
            bits[row, c >> 3] |= 1 << (c & 7)
    assert window_repeats.estimated(h, bits)[::2].all() and not window_repeats.estimated(h, bits).all()


def test_packed_places():
    r = np.random.default_rng(4)
    for n, top in ((0, 1), (1, 1 << 20), (300, 400), (500, 1 << 20)):
        places = np.sort(r.choice(top, n, replace=False)).astype(np.uint32)
        assert window_repeats.unpacked(window_repeats.packed(places)).tolist() == places.tolist()
