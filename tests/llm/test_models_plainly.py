"""Language distances, quality features, ranking and cut against plain formulas."""

import math
import random
from collections import Counter

import numpy as np

from tidegrid.llm import language, quality

TEXTS = {
    "en": ["the cat and the hat sat on the mat", "a thing that the other one thought of"],
    "de": ["die katze und der hund sassen auf der matte", "ein ding an das der andere dachte"],
    "fr": ["le chat et le chien sont sur le tapis", "une chose que les autres ont en tete"],
}


def ranked(texts, top, alphabet):
    """n-grams of one to three letters by count, ties in the order of the alphabet."""
    c = Counter()
    for s in texts:
        s = " " + "".join(x if x.isalpha() else " " for x in s.lower()) + " "
        while "  " in s:
            s = s.replace("  ", " ")
        for n in (1, 2, 3):
            c.update(s[i : i + n] for i in range(len(s) - n + 1) if s[i : i + n] != " ")
    place = {" ": 0, **{x: k + 1 for k, x in enumerate(alphabet)}}
    return sorted(c, key=lambda g: (-c[g], len(g), [place[x] for x in g]))[:top]


def test_out_of_place_distance():
    for top in (12, 40, 400):
        it = language.Profiles(TEXTS, top)
        alphabet = [chr(p) for p in it.alphabet]
        known = {k: ranked(rows, top, alphabet) for k, rows in TEXTS.items()}
        for s in ("the dog and the cat", "der hund und die katze", "le chien est la", "Tea!", "e"):
            own = ranked([s], top, alphabet)
            far = sorted((sum(abs(known[k].index(g) - i) if g in known[k] else top - i for i, g in enumerate(own)), k) for k in known)
            name, score = it.predict(s)
            assert name == far[0][1] and math.isclose(score, 1 - far[0][0] / far[1][0])


def test_features_by_plain_formulas():
    text = "Die Katze, die Katze, die Katze! Sie & er. Wo?\nZeile 12\nZeile 12"
    words = text.split()
    told = dict(zip(quality.NAMES, quality.describe(text)))
    raw = text.encode()
    assert math.isclose(told["log_words"], math.log(len(words))) and math.isclose(told["word_length"], sum(map(len, set(words))) / len(set(words)))
    assert math.isclose(told["upper"], sum(c.isupper() for c in text) / len(raw)) and math.isclose(told["digits"], 4 / len(raw))
    assert math.isclose(told["top_word"], max(Counter(words).values()) / len(words)) and math.isclose(told["distinct"], math.log(len(set(words)) / len(words)))
    threes = list(zip(words, words[1:], words[2:]))
    assert math.isclose(told["repeated_threes"], 1 - len(set(threes)) / len(threes)) and math.isclose(told["line_copies"], 1 / 3)
    assert math.isclose(told["odd_signs"], 2 / len(words)) and math.isclose(told["capitals_a_word"], sum(c.isupper() for c in text) / len(words))
    assert quality.describe("") == quality.describe(" \n") == [0.0] * len(quality.NAMES)


def test_ranking_equals_plain_logistic_steps_and_the_cut_a_plain_quantile():
    r = random.Random(1)
    rows = [("Ein Satz mit Worten. " * r.randint(1, 9) + r.choice(("gut", "so")), 1) for _ in range(40)] + [("spam $$ " * r.randint(1, 30) + r.choice(("a", "b")), 0) for _ in range(20)]
    r.shuffle(rows)
    share, pairs, steps, decay = 0.7, 50, 30, 1e-3
    it = quality.fit(rows, share, pairs, steps, decay, seed=3)
    x = [quality.describe(t) for t, _ in rows]
    m = len(quality.NAMES)
    mean = [sum(v[j] for v in x) / len(x) for j in range(m)]
    sd = [math.sqrt(sum((v[j] - mean[j]) ** 2 for v in x) / len(x)) + 1e-6 for j in range(m)]
    z = [[max(-6.0, min(6.0, (v[j] - mean[j]) / sd[j])) for j in range(m)] for v in x]
    z = [v + [a * a for a in v] for v in z]
    rng = np.random.default_rng(3)
    good, bad = [k for k, (_, y) in enumerate(rows) if y], [k for k, (_, y) in enumerate(rows) if not y]
    won, lost = rng.choice(good, pairs), rng.choice(bad, pairs)
    d = [[a - b for a, b in zip(z[i], z[j])] for i, j in zip(won, lost)]
    w, m1, m2 = [0.0] * (2 * m), [0.0] * (2 * m), [0.0] * (2 * m)
    for k in range(1, steps + 1):
        p = [1 / (1 + math.exp(sum(a * b for a, b in zip(v, w)))) for v in d]  # the chance that the pair is ranked wrongly
        for j in range(2 * m):
            g = -sum(v[j] * q for v, q in zip(d, p)) / pairs + decay * w[j]
            m1[j], m2[j] = 0.9 * m1[j] + 0.1 * g, 0.999 * m2[j] + 0.001 * g * g
            w[j] -= 0.1 * (m1[j] / (1 - 0.9**k)) / (math.sqrt(m2[j] / (1 - 0.999**k)) + 1e-8)
    assert np.allclose(it.weights, w, atol=1e-6)
    strength = [sum(a * b for a, b in zip(v, w)) for v in z]
    weight = [share / (len(good) / len(rows)) if y else (1 - share) / (len(bad) / len(rows)) for _, y in rows]
    so_far = 0.0
    for s, q in sorted(zip(strength, weight)):
        so_far += q
        if so_far / sum(weight) >= 1 - share - 1e-12:
            break
    assert math.isclose(it.cut, s, rel_tol=1e-6, abs_tol=1e-6)
    assert sum((it.score(np.array([v]))[0] >= quality.CUT) == bool(y) for v, (_, y) in zip(x, rows)) >= 0.95 * len(rows)


def test_ties_and_repeated_rows(spark):
    it = quality.fit([("Ein Satz mit Worten.", 1), ("$$ x", 0)] * 20, 0.5, 100, 20)
    df = spark.createDataFrame([(1, "Ein Satz."), (1, "Ein Satz."), (2, "Ein Satz."), (3, None), (4, "")], "doc_id bigint, text string")
    told = [(r["doc_id"], r["score"]) for r in quality.rank(df, it).collect()]
    assert len({s for k, s in told if k < 3}) == 1 and len({s for k, s in told if k > 2}) == 1 and len(told) == 5
