"""The keyed topic and the logged feed: failed batches, batches that come again, offsets, restarts."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidegrid.sources import feeds, topic


def stream(spark, path, n, first):
    spark.range(first, first + n).select(F.col("id").cast("string").cast("binary").alias("key"), F.concat(F.lit("v"), "id").cast("binary").alias("value"), F.lit(datetime(2026, 1, 1)).cast("timestamp").alias("timestamp")).write.mode("append").parquet(path)
    return spark.readStream.schema("key binary, value binary, timestamp timestamp").parquet(path)


def told(spark, path):
    return sorted((r["partition"], r["offset"], bytes(r["key"]).decode()) for r in topic.messages(spark, path).collect())


def test_failed_batches_leave_nothing_and_batches_come_once(spark, tmp_path, monkeypatch):
    src, path = f"{tmp_path}/in", f"file://{tmp_path}/topic"
    topic.produce(stream(spark, src, 20, 0), path, f"{tmp_path}/c", trigger={"availableNow": True}).awaitTermination()
    first = told(spark, path)
    assert {k for _, _, k in first} == set(map(str, range(20))) and {p for p, _, _ in first} == {0, 1, 2}
    rows = stream(spark, src, 20, 20)
    broken = rows.withColumn("value", F.when(F.col("key") == b"33", F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="broken"):
        topic.produce(broken, path, f"{tmp_path}/c", trigger={"availableNow": True}).awaitTermination()
    assert told(spark, path) == first and len(topic.lists(path)) == 1
    topic.produce(rows, path, f"{tmp_path}/c", trigger={"availableNow": True}).awaitTermination()
    both = told(spark, path)
    assert set(first) < set(both) and len(both) == 40 and len({(p, o) for p, o, _ in both}) == 40
    partition = {k: p for p, _, k in both}
    assert all(partition[k] == p for p, _, k in both)
    # the same batches again, as after a restart that lost their commits in the checkpoint
    topic.produce(rows, path, f"{tmp_path}/again", trigger={"availableNow": True}).awaitTermination()
    assert told(spark, path) == both
    files = {f["file"] for x in topic.lists(path) for f in x["files"]}
    assert {p.name for p in (tmp_path / "topic/files").iterdir() if p.suffix == ".parquet"} >= files


def test_commit_and_abort(tmp_path):
    at, columns = datetime(2026, 1, 1), ["key", "value", "timestamp", "partition"]
    writer = topic._Writer({"path": str(tmp_path), "query": "q"}, columns)
    one, two = (writer.write(iter([(b"a", b"1", at, 0), (None, None, at, 2)])) for _ in range(2))
    writer.abort([one, None], 0)
    assert len(list((tmp_path / "files").iterdir())) == 2 and topic.lists(str(tmp_path)) == []
    writer.commit([two], 0)
    three = writer.write(iter([(b"a", b"1", at, 0)]))
    writer.commit([three], 0)
    assert len(topic.lists(str(tmp_path))) == 1 and topic.ends(topic.lists(str(tmp_path)), 3) == [1, 0, 1]


def test_ranges_open_their_files_only(spark, tmp_path):
    at, writer = datetime(2026, 1, 1), topic._Writer({"path": str(tmp_path), "query": "q"}, ["key", "value", "timestamp", "partition"])
    for batch in range(4):
        writer.commit([writer.write(iter([(b"k", str(10 * batch + k).encode(), at, 1) for k in range(10)]))], batch)
    own = topic._Reader({"path": str(tmp_path), "starts": '{"1": 12}', "stops": '{"1": 21}'}).partitions()
    assert [(r.partition, r.start, r.stop, len(r.files)) for r in own] == [(0, 0, 0, 0), (1, 12, 21, 2), (2, 0, 0, 0)]
    got = topic.messages(spark, f"file://{tmp_path}", starts='{"1": 12}', stops='{"1": 21}').collect()
    assert [int(bytes(r["value"])) for r in sorted(got, key=lambda r: r["offset"])] == list(range(12, 21))
    last = topic._Reader({"path": str(tmp_path), "newest": "1"}).partitions()[1]
    assert (last.start, last.stop, len(last.files)) == (39, 40, 1)
    rows = {r["partition"]: (r["high"], r["newest_at"]) for r in topic.newest(spark, f"file://{tmp_path}").collect()}
    assert rows[0] == (0, None) and rows[1][0] == 40 and rows[1][1] is not None


def test_a_planned_poll_comes_again(tmp_path):
    """The document is logged before the offset is told, so a new reader gives the same rows for it; done ones go."""
    for k in range(3):
        (tmp_path / f"doc{k}").write_text(json.dumps({"last_updated": k, "data": {"stations": [{"station_id": k, "n": 1}, {"n": 2}]}}))
    options = {"url": f"file://{tmp_path}/doc{{poll}}", "log": f"{tmp_path}/log"}
    reader = feeds._Logged(options)
    assert [reader.latestOffset()["polls"] for _ in range(5)] == [1, 2, 3, 3, 3]
    (tmp_path / "doc1").unlink()
    again = feeds._Logged(options)
    rows = [r for p in again.partitions({"polls": 1}, {"polls": 3}) for r in again.read(p)]
    assert rows == [r for p in reader.partitions({"polls": 1}, {"polls": 3}) for r in reader.read(p)] and [(r[0], r[2]) for r in rows] == [("1", 1), ("2", 2)]
    again.commit({"polls": 3})
    assert [p.name for p in (tmp_path / "log").iterdir()] == ["000000000002.json"] and feeds._Logged(options).latestOffset() == {"polls": 3}


def test_broken_documents_are_told(tmp_path):
    (tmp_path / "doc").write_text('{"data": {}}')
    with pytest.raises(feeds.FeedError):
        feeds._Logged({"url": f"file://{tmp_path}/doc", "log": f"{tmp_path}/log"}).latestOffset()
