import itertools
import math
import random

import numpy as np
import pytest

from tidegrid.llm import toxic_spans


def every_marginal(it, words):
    """Each token's probability of tag 1, by enumerating all tag sequences."""
    mass, ones = 0.0, [0.0] * len(words)
    for tags in itertools.product((0, 1), repeat=len(words)):
        before, z = 0, 0.0
        for w, t in zip(words, tags):
            z += it.pair[before, t] + t * it.weight(w)
            before = t
        p = math.exp(z)
        mass += p
        for k, t in enumerate(tags):
            ones[k] += p * t
    return [x / mass for x in ones]


@pytest.mark.parametrize("seed", range(6))
def test_sums_and_runs_equal_enumeration(seed):
    r = random.Random(seed)
    pair = np.array([[0.6, -1.0 - r.random()], [-0.4, 1.5 * r.random() + 0.5]])
    it = toxic_spans.Field(pair, -1.0 - r.random(), {"=bad": 3.5, "4uglx": 2.0, "=meh": -0.5})
    for n in (1, 2, 5, 11):
        words = [r.choice(("a", "bc", "def", "bad", "uglxyz", "meh", "day", "night")) for _ in range(n)]
        text = " - ".join(words)
        want = every_marginal(it, words)
        for least in (0.1, 0.3, 0.5):
            runs, total, most = it.read(text, least)
            assert math.isclose(total, sum(want), rel_tol=1e-9)
            assert math.isclose(most, max([p for w, p in zip(words, want) if it.active(w)], default=0.0), abs_tol=1e-9)
            told, k = [], 0
            while k < n:  # runs of tokens that reach the level; ones without features count where they lie next to others with features
                if want[k] >= least:
                    stop = k
                    while stop + 1 < n and want[stop + 1] >= least:
                        stop += 1
                    if any(it.active(w) for w in words[k : stop + 1]):
                        told.append((k, stop, max(want[k : stop + 1])))
                    k = stop
                k += 1
            places, at = [], 0
            for w in words:
                places.append((at, at + len(w)))
                at += len(w) + 3
            assert [(a, b) for a, b, _ in runs] == [(places[a][0], places[b][1]) for a, b, _ in told]
            assert all(math.isclose(p, x, rel_tol=1e-9) for (_, _, p), (_, _, x) in zip(runs, told))


def test_long_and_empty_texts():
    it = toxic_spans.Field(np.array([[1.0, -3.0], [-1.0, 0.5]]), -2.0, {"=bad": 10.0}, (-3.0, 2.0, 4.0))
    assert it.read("", 0.5) == ([], 0.0, 0.0) and it.read("1 2 _", 0.5) == ([], 0.0, 0.0) and it.score(None) == it.score("")
    runs, total, most = it.read("word " * 50_000 + "bad " + "word " * 50_000, 0.5)
    assert len(runs) == 1 and runs[0][:2] == (250_000, 250_003) and most > 0.5 and math.isfinite(total)
    assert it.read("İ bad", 0.5)[0][0][:2] == (2, 5)  # lower-casing that changes lengths
