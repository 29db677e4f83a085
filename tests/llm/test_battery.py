import math
import random
from collections import Counter

from pyspark.sql import functions as F

from tidegrid.llm import secret_scan

BASE62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
WORDS = "the of house reading station under morning water seven people after light garden window letter river".split()


def test_random_strings_get_even_p_values():
    """Under randomness each test's p-values, and those joined, are about uniform (never much too small)."""
    r = random.Random(1)
    for name, alphabet in secret_scan.ENCODINGS[1:]:
        for n in (24, 64, 200):
            told = [secret_scan.randomness("".join(r.choices(alphabet, k=n)), name, len(alphabet)) for _ in range(400)]
            for p in (*zip(*told), [secret_scan.fisher(list(x)) for x in told]):
                assert sum(x < 0.1 for x in p) < 75 and sum(x < 0.001 for x in p) < 12


def test_statistics_equal_plain_formulas():
    r = random.Random(2)
    for _ in range(50):
        name, alphabet = r.choice(secret_scan.ENCODINGS[1:])
        run = "".join(r.choices(alphabet, k=r.randint(16, 80)))
        n, k = len(run), len(alphabet)
        v = [alphabet.index(c) for c in run]
        tail = lambda z: min(1.0, math.erfc(z / math.sqrt(2)))
        mean = sum(v) / n
        serial = sum((x - mean) * (y - mean) for x, y in zip(v, v[1:])) / sum((x - mean) ** 2 for x in v)
        high = [2 * x >= k for x in v]
        a, runs = sum(high), 1 + sum(x != y for x, y in zip(high, high[1:]))
        mu = 1 + 2 * a * (n - a) / n
        squares = sum(c * c for c in Counter(run).values())
        sd = math.sqrt(2 * n * (n - 1) * (1 / k - 1 / k**2))
        want = (tail(max(0, abs(squares - n - n * (n - 1) / k) - 1) / sd), tail(max(0, abs(runs - mu) - 1) / math.sqrt((mu - 1) * (mu - 2) / (n - 1))), tail(abs(serial + 1 / n) * math.sqrt(n)))
        assert all(math.isclose(x, y, rel_tol=1e-6) for x, y in zip(secret_scan.randomness(run, name, k), want))
    assert math.isclose(secret_scan.fisher([0.3]), 0.3) and math.isclose(secret_scan.fisher([0.2, 0.5]), 0.1 * (1 - math.log(0.1)))


def stepped_up(p_values, level):
    """The step-up rule on the grid's upper ends, plainly."""
    told = sorted(2.0 ** (-secret_scan_cell(p) / 4) for p in p_values)
    n = len(told)
    least = max((p for k, p in enumerate(told, 1) if p * n <= level * k), default=-1.0)
    return [2.0 ** (-secret_scan_cell(p) / 4) <= least for p in p_values]


def secret_scan_cell(p):
    return min(secret_scan.GRID - 1, math.floor(-math.log2(max(p, 1e-300)) * 4))


def test_planted_keys_are_found_and_ordinary_runs_are_not(spark):
    """Keys without a keyword among identifiers, paths and dates: recall, false discoveries, and the rule in full."""
    r = random.Random(3)
    rows, keys = [], {}
    for k in range(400):
        words = r.choices(WORDS, k=30)
        ordinary = r.choice([
            "".join(w.title() for w in r.choices(WORDS, k=3)) + "Value", "/".join(r.choices(WORDS, k=4)), "_".join(r.choices(WORDS, k=4)) + "_v2",
            f"2024-{r.randint(10, 12)}-{r.randint(10, 28)}T10-{r.randint(10, 59)}-00Z", "".join(r.choices("0123456789", k=18)), r.choice(WORDS) * 4 + "1",
        ])
        words[10] = ordinary
        if k % 4 == 0:
            name, alphabet = r.choice([x for x in secret_scan.ENCODINGS if x[0] in ("base62", "base64", "base64url", "lower36", "base32")])
            keys[k] = "Z9" + "".join(r.choices(alphabet, k=r.choice((30, 38, 46, 62)))) if name != "lower36" else "z9" + "".join(r.choices(alphabet, k=38))
            words[20] = keys[k]
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {x["doc_id"]: [tuple(map(int, s.split(":")[1:])) for s in x["spans"].split(",") if s.startswith("random")] for x in secret_scan.digests(df).collect()}
    texts = dict(rows)
    hit = sum(any(a <= texts[k].index(key) + 3 and b >= texts[k].index(key) + len(key) - 3 for a, b in found[k]) for k, key in keys.items())
    wrong = sum(texts[k][a:b] not in keys.get(k, "") and keys.get(k, "?") not in texts[k][a:b] for k, spans in found.items() for a, b in spans)
    assert hit >= 0.9 * len(keys) and wrong <= 0.05 * (hit + wrong)
    one = [(k, *s) for k, t in rows for s in secret_scan.spans(t) if s[0] == "random"]
    classes = {}
    for x in one:
        classes.setdefault(sum(x[3] - x[2] >= n for n in secret_scan.LENGTHS), []).append(x)
    want = {(x[0], x[2], x[3]) for group in classes.values() for x, yes in zip(group, stepped_up([x[4] for x in group], 0.01)) if yes}
    assert want == {(k, a, b) for k, spans in found.items() for a, b in spans}


def test_what_base_findings_leave_of_a_run():
    r = random.Random(4)
    key = "a7Z" + "".join(r.choices(BASE62, k=60)) + "G3k"
    text = f"x {'0123456789abcdef' * 2}/{key} and token=abcdef12/" + "é"
    told = secret_scan.spans(text)
    assert [k for k, *_ in told] == ["assign", "hex", "random"] and key in text[told[2][1] : told[2][2]]
    many = " ".join(["token=abcdef12"] * 20_000)  # the work grows with the text, not with its square
    assert len(secret_scan.spans(many)) == 20_000


def test_only_ascii_letters_in_either_case():
    assert secret_scan.spans("ſecret=abcdef12 toKen=abcdef12".replace("K", "K")) == []
    assert [x[:3] for x in secret_scan.spans("SeCrEt=abcdef12")] == [("assign", 0, 15)]


def test_ties_and_repeated_rows(spark):
    r = random.Random(8)
    key = "Q7" + "".join(r.choices(BASE62, k=50))
    df = spark.createDataFrame([(1, f"a {key} b"), (1, f"a {key} b"), (2, f"a {key} b")], "doc_id bigint, text string").withColumn("spans", F.lit("x"))
    assert {tuple(x) for x in secret_scan.digests(df).select("doc_id", "spans").collect()} == {(1, "random:2:54"), (2, "random:2:54")}


def test_columns_of_any_name_go_through(spark):
    df = spark.createDataFrame([("x", "token=abcdef12 y", 1), (None, None, None)], "`a.b` string, text string, spans int").withColumn("doc_id", F.lit(1).cast("long"))
    assert [(r["a.b"], r["text"], r["spans"]) for r in secret_scan.redact(df).collect()] == [("x", "<assign> y", 1), (None, None, None)]


def test_narrow_encodings_are_found_and_paths_are_not(spark):
    """Of keys in one case and digits, at 32 signs, nine in ten; none of the paths and names of words."""
    r, up = random.Random(9), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = ["lib64/python3/site-packages/numpy/core", "src/main/java/com/example/App2", "HTTP_STATUS_CODE_404_NOT_FOUND", "release-candidate-2024-05-17", "utf8_general_ci_v2_extended", "someVariableNameThatIsLong1"]
    keys = ["".join(r.choices(a, k=32)) for a in (up + "234567", "0123456789ABCDEF") for _ in range(30)]
    rows = list(enumerate([f"see {x} there" for x in [*keys, *plain * 5]]))
    told = {x["doc_id"] for x in secret_scan.digests(spark.createDataFrame(rows, "doc_id bigint, text string")).filter("spans <> ''").collect()}
    for first in (0, 30):
        assert len(told & set(range(first, first + 30))) >= 27
    assert not told & set(range(60, 90))
