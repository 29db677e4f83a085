"""Large groups of near copies: what is passed over, and the same groups as pair by pair."""

import random

import numpy as np
import pytest

from tidegrid.llm import set_join


@pytest.fixture(scope="module")
def crowd():
    """Near copies of two sets, and sets that are a little too far from them."""
    r, fresh = random.Random(8), iter(range(10**6, 10**7))
    hashed = lambda told: np.unique(np.array([set_join.xxhash.xxh3_64_intdigest(str(x)) for x in told], np.uint64))
    out = []
    for k in range(600):
        told = list(range(100 * (k % 2), 100 * (k % 2) + 100))
        for _ in range(r.choice((0, 1, 2, 3, 4, 12, 30))):
            told[r.randrange(100)] = next(fresh)
        out.append(hashed(told))
    return out


def linked(a, b, percent):
    both = len(np.intersect1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)


def test_connected_sets_of_a_crowd_are_passed_over(crowd, monkeypatch):
    """Most sets need no index list; the groups are those of all pairs."""
    ids, plain, lists = list(range(len(crowd))), np.searchsorted, []

    def spy(a, *rest, **how):
        lists.append(len(a) > 10_000)
        return plain(a, *rest, **how)

    monkeypatch.setattr(set_join.np, "searchsorted", spy)
    roots, _ = set_join.exact_roots(ids, crowd, 85)
    monkeypatch.undo()
    want = list(ids)
    for i in ids:
        for j in ids[:i]:
            if want[i] != want[j] and linked(crowd[i], crowd[j], 85):
                a, b = sorted((want[i], want[j]))
                want = [a if x == b else x for x in want]
    assert roots == want and 2 < len(set(roots)) < 400
    assert sum(lists) < len(crowd) / 4


def test_visitors_meet_one_of_each_group(crowd):
    there, guests = crowd[:400], crowd[400:]
    roots = [k % 2 for k in range(400)]
    told = set_join.exact_between(guests, there, roots, 85)
    assert all(linked(guests[i], there[j], 85) for i, j in told)
    assert sorted((i, roots[j]) for i, j in told) == sorted({(i, roots[j]) for i in range(200) for j in range(400) if linked(guests[i], there[j], 85)})


def test_long_lists_give_what_pairs_give(crowd, monkeypatch):
    r = random.Random(1)
    sets = crowd + [np.unique(np.array([r.getrandbits(60) for _ in range(r.choice((5, 70, 300, 1100)))], np.uint64)) for _ in range(200)]
    ids, n, bits = [7 * k % 10007 for k in range(800)], [len(s) for s in sets], [set_join.sketch(s, set_join.LIST_BITS) for s in sets]
    told = set_join.list_roots(ids, n, bits, 85)
    between = set_join.list_between(n[:50], bits[:50], n[50:], bits[50:], list(range(750)), 85)
    assert between == [(i, j) for i in range(50) for j, met in enumerate(set_join.list_against((n[i], bits[i]), n[50:], bits[50:], 85)) if met]
    monkeypatch.setattr(set_join, "MANY", 10**9)
    assert told == set_join.list_roots(ids, n, bits, 85)
