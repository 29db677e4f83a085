import hashlib
import random
import re
import zlib

import pytest

from tidegrid.llm import language, labels, ogg, quality, secret_scan, toxic_spans
from tidegrid.llm.common import fold


def brute_base(text):
    out = []
    kinds = [("assign", r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", 6, 1), ("access", "AKIA[A-Z0-9]+", 20, 0), ("hex", "[0-9a-f]+", 24, 0)]
    for k, (kind, pattern, least, group) in enumerate(kinds):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return [x for _, _, x in sorted(out)]


def test_base_findings(spark):
    r = random.Random(5)
    bits = ["password", "Token", "api_key", "APIKEY", "=", ": ", '"', "'", "abc123", "deadbeef" * 3, "AKIA", "ABCD1234EFGH5678", " ", "é", ".", "secret:", "AKIAAKIA"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(400)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for f in secret_scan.digests(df).collect():
        want = brute_base(texts[f["doc_id"]] or "")
        assert f["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (f["n_assign"], f["n_access"], f["n_hex"]) == tuple(sum(x.startswith(k) for x in want) for k in ("assign", "access", "hex"))
        assert [x for x in f["spans"].split(",") if x and not x.startswith("random")] == want


def test_battery_tells_keys_from_words():
    r = random.Random(6)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = [secret_scan.battery("".join(r.choice(alphabet) for _ in range(40))) for _ in range(300)]
    assert sum(p is not None and p < 1e-4 for p in keys) > 280
    for word in ("internationalisationFrameworks", "a1" * 20, "0123456789abcdefghijklmnopqrstuvwxyz", "thequickbrownfoxjumps_over_dog", "1234567890123456"):
        p = secret_scan.battery(word)
        assert p is None or p > 1e-6


def test_discoveries_and_redaction(spark, odd, none):
    r = random.Random(7)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = "".join(r.choice(alphabet) for _ in range(40))
    df = spark.createDataFrame([(1, f"see {key} here", 50, "x"), (2, "password=hunter22 and words", 27, None), (3, None, None, None), (4, "clean words only", 16, "y")], "doc_id bigint, text string, n_chars bigint, spans string")
    told = {x["doc_id"]: x["spans"] for x in secret_scan.digests(df).collect()}
    assert told == {1: "random:4:44", 2: "assign:0:17", 3: "", 4: ""}
    new = {x["doc_id"]: (x["text"], x["n_chars"]) for x in secret_scan.redact(df).collect()}
    assert new == {1: ("see <random> here", 17), 2: ("<assign> and words", 18), 3: (None, 0), 4: ("clean words only", 16)}
    assert secret_scan.redact(odd).count() == odd.count() and secret_scan.redact(odd).columns == odd.columns
    assert secret_scan.digests(none).count() == 0


def crc(page):
    c = 0
    for b in page:
        c ^= b << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


def test_ogg_checksum():
    for s in (b"", b"OggS", bytes(range(256)) * 3):
        assert ogg.checksum(s) == crc(s)


@pytest.mark.parametrize("n", [0, 1, 191, 192, 254, 255, 4079, 4080, 4081, 65025, 65026, 255 * 255 * 2 + 7])
def test_ogg_round_trip(n):
    payload = random.Random(n).randbytes(n)
    media = ogg.encode(payload)
    back, told = ogg.decode(media)
    assert back == payload and told["streams"] == 2 and told["seconds"] == n / ogg.RATE
    assert ogg.pages([(payload, n)], 1) and ogg.encode(payload) == media


def test_ogg_packets_over_pages():
    packets = [(bytes([k]) * size, k) for k, size in enumerate((10, 70_000, 0, 255, 510, 65_025))]
    stream = ogg.demultiplex(b"".join(ogg.pages(packets, 7)))[7]
    assert stream.packets == [p for p, _ in packets] and stream.granules[-1] == 5


def test_ogg_damage(spark):
    media = bytearray(ogg.encode(b"x" * 9000))
    for at in (0, 5, 30, 200, len(media) - 1):
        bad = bytearray(media)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            ogg.decode(bytes(bad))
    with pytest.raises(ValueError):
        ogg.decode(bytes(media[:-40]))
    df = spark.createDataFrame([(1, bytearray(b"abc")), (2, None)], "id int, payload binary")
    got = {r["id"]: r["info"] for r in ogg.read_column(ogg.write_column(df)).collect()}
    assert bytes(got[1]["payload"]) == b"abc" and got[1]["fault"] is None and got[2]["payload"] is None


def test_ogg_digests(odd, none):
    for r, f in zip(odd.orderBy("doc_id").collect(), ogg.digests(odd).orderBy("doc_id").collect()):
        n, payload = ogg.padded(r["text"])
        assert (f["n_bytes"], f["payload_bytes"], f["payload_sha256"], f["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert len(payload) % 192 == 0 and len(payload) > 0
    assert ogg.digests(none).count() == 0


def brute_profile(texts, top):
    from collections import Counter

    c = Counter()
    for s in texts:
        s = re.sub(r"[^a-z]+", " ", f" {s.lower()} ")
        for n in (1, 2, 3):
            c.update(g for g in (s[i : i + n] for i in range(len(s) - n + 1)) if g != " ")
    return c


def test_grams_equal_plain_counting():
    texts = ["the cat, the hat", "a bat 12 sat"]
    it = language.Profiles({"en": texts}, 50)
    names = {k + 1: chr(p) for k, p in enumerate(it.alphabet)} | {0: " "}
    for s in texts:
        grams, n = it._grams(s)
        got = {}
        for g, m in zip(grams.tolist(), n.tolist()):
            digits = (g,) if g < 64 else divmod(g - 64, 64) if g < 64 + 4096 else ((g - 64 - 4096) // 4096, (g - 64 - 4096) // 64 % 64, g % 64)
            got["".join(names[x] for x in digits)] = m
        assert got == dict(brute_profile([s], 50))


def test_language(spark, docs, odd, none):
    profiles = language.fit(docs, fold("doc_id", 4) != 2, 100, 300)
    rows = language.identify(docs, profiles).join(docs.select("doc_id", "lang"), "doc_id").filter(fold("doc_id", 4) == 2).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.9 * len(rows)
    told = {r["doc_id"]: r for r in language.identify(odd, profiles).collect()}
    assert told[0]["lang_pred"] == told[1]["lang_pred"] == told[3]["lang_pred"] == "und" and all(0 <= r["score"] <= 1 for r in told.values())
    assert language.identify(none, profiles).count() == 0
    assert language.identify(odd, language.fit(none, fold("doc_id", 4) != 2, 9, 9)).filter("lang_pred <> 'und'").isEmpty()


def brute_marginals(it, words):
    from itertools import product
    from math import exp

    weight = {}
    for tags in product((0, 1), repeat=len(words)):
        s, before = 0.0, 0
        for w, t in zip(words, tags):
            s += it.pair[before, t] + t * it.weight(w)
            before = t
        weight[tags] = exp(s)
    z = sum(weight.values())
    return [sum(v for t, v in weight.items() if t[k]) / z for k in range(len(words))]


def test_crf_marginals_equal_enumeration():
    import numpy as np

    it = toxic_spans.Field(np.array([[0.5, -1.0], [-0.2, 0.7]]), -1.3, {"=bad": 3.0, "4uglx": 2.0, "=meh": -0.5})
    text = "a bad day uglxyz b c bad meh d e"
    words = text.split()
    want = brute_marginals(it, words)
    got = it.marginals(text)
    assert [text[a:b] for a, b, _ in got] == ["bad", "uglxyz", "bad", "meh"]
    assert all(abs(p - want[words.index(text[a:b]) if text[a:b] != "bad" else (1 if a < 5 else 6)]) < 1e-9 for a, b, p in got)


def test_toxicity_learns(spark, odd, none):
    r = random.Random(8)
    words = ["red", "blue", "tree", "house", "water", "stone", "cloud"]
    rows = [(k, " ".join(r.choice(words) for _ in range(40)) + (" vileness" + r.choice("abc") + " " + r.choice(words)) * (k % 3 == 0), int(k % 3 == 0)) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    taught, share = labels.sample(df.drop("toxic"), df.select("doc_id", "toxic"), "toxic", fold("doc_id", 4) != 2, 500)
    it = toxic_spans.fit(taught, share)
    told = toxic_spans.tag(df, it).join(df, "doc_id").filter(fold("doc_id", 4) == 2).collect()
    assert sum((x["score"] >= 0.3) == bool(x["toxic"]) for x in told) >= 0.95 * len(told)
    assert any(x["spans"] for x in told)
    assert toxic_spans.tag(odd, it).count() == odd.count() and toxic_spans.tag(none, it).count() == 0
    flat = toxic_spans.fit([("a b", 0)], 0.0)
    assert 0 <= flat.score("x y") <= 1


def test_quality_learns(spark, docs, odd, none):
    table = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    taught, share = labels.sample(docs, table, "quality", fold("doc_id", 5) != 0, 500)
    it = quality.fit(taught, share, pairs=3000, steps=100)
    told = quality.rank(docs, it).join(table, "doc_id").collect()
    assert sum((r["score"] >= 0.3) == bool(r["quality"]) for r in told) >= 0.9 * len(told)
    assert all(0 <= r["score"] <= 1 for r in quality.rank(odd, it).collect()) and quality.rank(none, it).count() == 0
    assert set(quality.fit([("a", 1)], 0.8).score(__import__("numpy").zeros((2, len(quality.NAMES))))) == {0.8}
