"""Streams over larger tables go in more batches or files, with the same results."""

from tidegrid.plans import demo
from tidegrid.sources import topic

SMALL = "/root/testdata/sf0.001"


def test_topic_in_more_batches_has_the_same_order(spark, monkeypatch):
    n, whole = [], topic.produce
    monkeypatch.setattr(demo, "BATCH_ROWS", 150)
    monkeypatch.setattr(topic, "produce", lambda *a, **k: n.append(1) or whole(*a, **k))
    told = demo.topic_messages(spark, SMALL).collect()
    assert len(n) == 8 and len(told) == demo.events(spark, SMALL).count() and all(r["in_order"] for r in told)


def test_gauges_over_several_files_a_quarter(spark, monkeypatch):
    monkeypatch.setattr(demo, "FILE_ROWS", 100)
    n = demo.events(spark, SMALL).count()
    assert tuple(demo.stream_gauges(spark, SMALL).first()) == (n, 4, 0, True)
