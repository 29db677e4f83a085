import random

import pytest

from tidegrid.llm import secret_scan

R = random.Random(11)
BASE62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def key(alphabet=BASE62, n=40):
    while True:
        k = "".join(R.choice(alphabet) for _ in range(n))
        if (p := secret_scan.battery(k)) is not None and p < 1e-4:
            return k


@pytest.mark.parametrize("before, after", [("AWS_ACCESS_KEY=", ""), ("https://x.org/a?sig=", "&v=1"), ("client='", "'"), ('"', '"'), ("a=b=", " x")])
def test_keys_next_to_names(before, after):
    k = key()
    found = [(a, b) for kind, a, b, _ in secret_scan.spans(f"see {before}{k}{after} there") if kind == "random"]
    assert found == [(4 + len(before), 4 + len(before) + 40)]


@pytest.mark.parametrize("before, after, least", [("path/ab-cd/", " x", 12), ("name_of/", "/x-y", 9)])
def test_keys_joined_by_signs_of_both_alphabets(before, after, least):
    k = key()
    found = [(a, b) for kind, a, b, _ in secret_scan.spans(f"see {before}{k}{after} there") if kind == "random"]
    at = 4 + len(before)  # a part between the signs of one alphabet may keep a neighbour; the whole key lies in it
    assert len(found) == 1 and least <= found[0][0] <= at and found[0][1] >= at + 40


def test_padding_stays_in_the_run(spark):
    k = key() + "=="
    assert [(a, b) for kind, a, b, _ in secret_scan.spans(f"sig={k} x") if kind == "random"] == [(4, 46)]
    df = spark.createDataFrame([(1, f"AWS_ACCESS_KEY={key()} x")], "doc_id bigint, text string")
    assert [r["text"] for r in secret_scan.redact(df).collect()] == ["AWS_ACCESS_KEY=<random> x"]
