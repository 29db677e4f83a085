import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidegrid.llm import graph, repeats, set_join, templates


def brute_removal(texts, length):
    raws = [(t or "").encode() for t in texts]
    met = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        marks = [False] * len(r)
        for i in range(len(r) - length + 1):
            if met[r[i : i + length]] > 1:
                marks[i : i + length] = [True] * length
        kept = bytes(b for b, m in zip(r, marks) if not m)
        out.append((len(r), sum(marks), sum(m and (not k or not marks[k - 1]) for k, m in enumerate(marks)), hashlib.sha256(kept).hexdigest()))
    return out


def test_refinement_classes():
    r = random.Random(1)
    for length in (3, 8, 9, 16, 37, 400):
        text = np.frombuffer(bytes(r.choice(b"ab") for _ in range(900)) * 2, np.uint8)
        starts = np.arange(len(text) - length + 1)
        kinds, strings = repeats.refine(text, starts, length), [text[s : s + length].tobytes() for s in starts]
        assert len(set(zip(kinds.tolist(), strings))) == len(set(strings)) == len(set(kinds.tolist()))
    assert repeats.refine(np.frombuffer(b"abcdefghijklmnop", np.uint8), np.arange(5), 12).tolist() == [0, 1, 2, 3, 4]


def test_refinement_keeps_to_columns_and_segments():
    """Equal bytes in other columns are other classes, and places whose strings leave their segment make none."""
    r = random.Random(3)
    parts = [bytes(r.choice(b"ab") for _ in range(30)) for _ in range(3)]
    segments = [b"".join(r.choice(parts) for _ in range(3)) for _ in range(12)]
    text, place = np.frombuffer(b"".join(segments), np.uint8), np.arange(12 * 90)
    starts = place[place % 90 <= 40]
    kinds = repeats.refine(text, starts, 50, place % 90 + 90 * (place // 540), 90 - place % 90)
    strings = [(s // 540, s % 90, text[s : s + 50].tobytes()) for s in starts.tolist()]
    assert len(set(zip(kinds.tolist(), strings))) == len(set(strings)) == len(set(kinds.tolist()))


@pytest.mark.parametrize("hot", [1024, 2])
def test_removal_equals_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "PIECE", 500)
    r = random.Random(2)
    parts = ["".join(r.choice("abcdé ") for _ in range(r.randint(40, 200))) for _ in range(5)]
    texts = ["".join(r.choice(parts) if r.random() < 0.5 else "".join(r.choice("xyz") for _ in range(60)) for _ in range(r.randint(0, 8))) for _ in range(60)] + [None, "", "ab" * 400, "ab" * 400]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id bigint, text string, spans int")
    got = [tuple(x)[1:] for x in repeats.digests(df, 50).orderBy("doc_id").collect()]
    assert got == brute_removal(texts, 50)


def test_near_copies_over_the_limit(spark, monkeypatch):
    """One passage with other words put in: its anchors have more segments than HOT, and pieces of them, too."""
    monkeypatch.setattr(repeats, "HOT", 3)
    r = random.Random(5)
    base = "".join(r.choice("abcdefgh ") for _ in range(300))
    texts = [base[: (k := r.randrange(300))] + "".join(r.choice("xyz") for _ in range(4)) + base[k + 4 :] for _ in range(60)] + [base]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [tuple(x)[1:] for x in repeats.digests(df, 50).orderBy("doc_id").collect()] == brute_removal(texts, 50)


def test_short_passages_are_told(spark):
    """51 words of under 400 bytes in two documents are told of both; 31 words, and what one document repeats alone, of none."""
    r = random.Random(8)
    own = lambda n: ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    long, short, alone = ["".join(r.choice("abc") for _ in range(4)) for _ in range(51)], own(31), own(60)
    texts = [own(30) + long + own(9), own(3) + long, own(80) + short, short + own(70), alone + own(5) + alone, own(51), None, []]
    df = spark.createDataFrame([(k, None if t is None else " \n".join(t)) for k, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    told = {x["doc_id"]: (x["passages"] > 0, x["n_removed"]) for x in repeats.digests(df, 400, 51).collect()}
    assert [told[k][0] for k in range(8)] == [True, True] + [False] * 6 and told[0][1] == told[1][1] == 0


def test_pieces_share_an_anchor():
    r = random.Random(6)
    base = bytes(r.choice(b"abcdefgh") for _ in range(300))
    for width in repeats.WIDTHS:
        of_string = {}
        for _ in range(40):
            k = r.randrange(300)
            raw = base[:k] + b"xyz" + base[k + 3 :]
            for anchor, first, starts, _ in repeats.runs(np.frombuffer(raw, np.uint8), 60):
                segment = raw[first : first + starts + 59]
                told = repeats.pieces(segment, anchor, 60, width)
                assert sum(n for _, _, n in told) == starts and all(n <= width for _, _, n in told)
                for new, lo, n in told:
                    for i in range(lo, lo + n):
                        of_string.setdefault(segment[i : i + 60], set()).add(new)
        assert all(len(x) == 1 for x in of_string.values())


def test_an_id_with_several_texts(spark):
    r = random.Random(7)
    a, b = ("".join(r.choice("abcdefgh ") for _ in range(900)) for _ in range(2))
    df = spark.createDataFrame([(1, a), (1, b), (2, b)], "doc_id bigint, text string")
    assert sorted((x["doc_id"], x["n_removed"]) for x in repeats.digests(df, 400).collect()) == [(1, 0), (1, 900), (2, 900)]
    c = " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    d = " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    df = spark.createDataFrame([(1, c), (5, c + " x"), (5, d), (7, d + " y")], "doc_id bigint, text string")
    assert sorted((x["doc_id"], x["component_id"]) for x in set_join.classes(df, 4, 85).collect()) == [(1, 1), (5, 1), (5, 5), (7, 5)]
    assert sorted((x["doc_id"], x["text"] == d) for x in set_join.one_of_each(df, 4, 85).collect()) == [(1, False), (5, True)]


def test_removal_of_odd_rows(odd, none):
    got = [tuple(x)[1:] for x in repeats.digests(odd, 400).orderBy("doc_id").collect()]
    assert got == brute_removal([x["text"] for x in odd.orderBy("doc_id").collect()], 400)
    assert repeats.digests(none, 400).count() == 0


def brute_classes(texts, words, percent):
    sets = []
    for t in texts:
        told = (t or "").encode().lower().split()
        sets.append({tuple(told)} if 0 < len(told) < words else {tuple(told[i : i + words]) for i in range(len(told) - words + 1)})
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(s), find(k)) for k, s in enumerate(sets)]


@pytest.mark.parametrize(("short", "hot", "list_block", "block"), [(8, 512, 4096, 1_000_000), (2, 2, 4096, 90), (1, 3, 2, 400), (3, 6, 5, 1500)])
def test_join_equals_brute_force(spark, short, hot, list_block, block, monkeypatch):
    for name, value in (("SHORT", short), ("HOT", hot), ("LIST_BLOCK", list_block), ("BLOCK", block)):
        monkeypatch.setattr(set_join, name, value)
    r = random.Random(3)
    word = lambda: "".join(r.choice("abc") for _ in range(3))
    base = [[word() for _ in range(r.choice((3, 30, 120)))] for _ in range(8)]
    texts = []
    for _ in range(120):
        w = list(r.choice(base))
        for _ in range(r.choice((0, 0, 1, 2, 5))):
            w[r.randrange(len(w))] = word()
        texts.append(r.choice((" ", "\n", "  ")).join(w))
    texts += [None, "", " \t", "One", "one", "x" * 100_000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    for words, percent in ((4, 85), (5, 80)):
        got = [tuple(x)[1:] for x in set_join.classes(df, words, percent).orderBy("doc_id").collect()]
        assert got == brute_classes(texts, words, percent)


def test_join_of_odd_rows(odd, none):
    assert set_join.classes(none).count() == 0
    kept = set_join.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(x["doc_id"] for x in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 12]


def test_repeated_rows_and_rows_without_id(spark):
    r = random.Random(4)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    a, b, c = text(60), text(60), text(60)
    rows = [(1, a), (1, a), (2, a + " more"), (3, b), (None, b), (None, c), (4, c + " x y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    key = lambda x: (x is None, x)
    told = sorted(((x["doc_id"], x["component_id"]) for x in set_join.classes(df, 4, 85).collect()), key=lambda x: (key(x[0]), key(x[1])))
    assert told == [(1, 1), (1, 1), (2, 1), (3, 3), (4, 4), (None, 3), (None, None)]
    assert sorted((x["doc_id"] for x in set_join.one_of_each(df).collect()), key=key) == [1, 1, 3, 4, None, None]
    gone = sorted(((x["doc_id"], x["n_removed"] == x["n_bytes"], x["n_removed"] > 0) for x in repeats.digests(df, 50).collect()), key=lambda x: key(x[0]))
    assert gone == [(1, True, True), (1, True, True), (2, False, True), (3, False, False), (4, False, False), (None, False, False), (None, False, False)]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (7, 4), (3, 1), (None, 1)]
    assert sorted(map(tuple, graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (7, 4), (8, 4), (9, 4)]
    chain = spark.createDataFrame([(k, k + 1) for k in range(60)], "a bigint, b bigint")
    assert {x["label"] for x in graph.components(chain).collect()} == {0}


ITEM = "a train leaves Lyon at 9 and goes 300 km in 2 hours while Marie waits with 12 apples in the hall of the station"


def test_templates(spark, odd, none):
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, "too short"), (1, ITEM)], "item_id bigint, text string")
    other = ITEM.replace("9", "7").replace("300", "450").replace("12", "31").replace("Lyon", "Nantes").replace("2 hours", "5 hours")
    mixed = ITEM.replace("9 and", "12 and")  # 9 and 12 of the item would both stand against 12
    rows = [(1, f"some words before {ITEM} and after"), (2, f"well, {other}"), (3, mixed), (4, "a clean text of its own about trains that leave at 9 for nowhere in the hall"), (5, None), (6, ""), (7, ITEM.upper())]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, item_id string")
    told = {r["doc_id"]: r for r in templates.leaks(docs, bench).collect()}
    assert {1, 2} <= set(told) <= {1, 2, 7} and told[1]["exact"] and not told[2]["exact"] and told[1]["coverage"] > 0.9
    assert sorted(r["doc_id"] for r in templates.clean(docs, bench).collect()) == sorted({1, 2, 3, 4, 5, 6, 7} - set(told))
    assert templates.leaks(none, bench).count() == 0 and templates.leaks(docs, bench.limit(0)).count() == 0
    assert templates.clean(odd, bench).columns == odd.columns and templates.clean(odd, bench).count() == odd.count()


def test_short_items_and_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(templates, "BROADCAST_WINDOWS", 0)
    bench = spark.createDataFrame([(1, "what is the capital of France")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "tell me, what is the capital of Spain"), (2, "nothing of that kind here at all today")], "doc_id bigint, text string")
    assert [r["doc_id"] for r in templates.leaks(docs, bench).collect()] == [1]


def test_sql_of_templates(spark):
    import duckdb

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = sorted(con.execute(templates.sql()).fetchall())
    got = templates.leaks(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet"))
    assert sorted(map(tuple, got.collect())) == want
