from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidegrid.operators import refine
from tidegrid.operators.tables import Conflict, Table

NOW = datetime(2026, 3, 1, 12, tzinfo=timezone.utc)
EPOCH = int(NOW.timestamp())


def body(station=1, bikes=3, docks=4, epoch=EPOCH - 60, **more):
    import json

    return json.dumps({"feed_last_updated": EPOCH, "station": {"station_id": station, "stationCode": 16107, "num_bikes_available": bikes, "num_bikes_available_types": [{"mechanical": 1}, {"ebike": 2}], "num_docks_available": docks, "is_installed": 1, "is_renting": 1, "is_returning": 0, "last_reported": epoch, **more}})


def bronze(spark, texts, at=NOW):
    rows = [("k", t, "topic", 0, k, at.replace(tzinfo=None), at.replace(tzinfo=None), at.date()) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "kafka_key string, raw_json string, topic string, kafka_partition int, kafka_offset bigint, kafka_timestamp timestamp, ingested_at timestamp, ingest_date date")


CASES = [
    (body(), None), ("garbage", refine.NO_STATION), (body()[:30], refine.NO_STATION), (None, refine.NO_STATION), (body(station="x"), refine.NO_STATION), (body(epoch=None), refine.NO_TIME), (body(epoch=refine.LEAST_EPOCH - 1), refine.DEFAULT_TIME),
    (body(epoch=refine.LEAST_EPOCH), None), (body(epoch=EPOCH + 3601), refine.FUTURE_TIME), (body(epoch=EPOCH + 3600), None), (body(bikes=-1), refine.BAD_BIKES), (body(bikes=3.5), refine.BAD_BIKES), (body(bikes=2**40), refine.BAD_BIKES), (body(docks=None), refine.BAD_DOCKS),
    (body(docks=-2), refine.BAD_DOCKS), (body(station=99), refine.UNKNOWN), (body(num_bikes_available_types=None), None),
]


def test_reasons(spark):
    known = spark.createDataFrame([(1,), (1,)], "station_id bigint")
    found = refine.with_reason(refine.parse(bronze(spark, [t for t, _ in CASES])), EPOCH, known).orderBy("kafka_offset").collect()
    assert [r["rejection_reason"] for r in found] == [x for _, x in CASES]
    assert found[0]["station_code"] == "16107" and found[0]["num_mechanical"] == 1 and found[0]["num_ebike"] == 2 and found[0]["is_returning"] is False
    assert found[-1]["num_mechanical"] == 0


def test_no_reference_switches_the_rule_off(spark):
    empty = spark.createDataFrame([], "station_id bigint")
    for known in (None, empty):
        assert refine.with_reason(refine.parse(bronze(spark, [body(station=99)])), EPOCH, known).first()["rejection_reason"] is None


def test_time_zero_is_a_time(spark):
    assert refine.with_reason(refine.parse(bronze(spark, [body()])), 0).first()["rejection_reason"] == refine.FUTURE_TIME


def test_window_is_half_open(spark):
    rows = bronze(spark, [body()], datetime(2026, 3, 1, 12, tzinfo=timezone.utc))
    start, end = datetime(2026, 3, 1, 12, 30), datetime(2026, 3, 1, 13)
    assert refine.in_window(rows, start, end, 30).count() == 1
    assert refine.in_window(rows, start, end, 29).count() == 0
    assert refine.in_window(rows, datetime(2026, 3, 1, 11), datetime(2026, 3, 1, 12), 30).count() == 0


def test_refine_twice_changes_nothing(spark, tmp_path):
    silver, quarantine, landing = Table(spark, f"{tmp_path}/s", ("report_date",)), Table(spark, f"{tmp_path}/q", ("quarantine_date",)), Table(spark, f"{tmp_path}/l")
    rows = bronze(spark, [body(bikes=1), body(bikes=2), "garbage", body(station=2)])
    start, end = datetime(2026, 3, 1, 11, 30, tzinfo=timezone.utc), datetime(2026, 3, 1, 12, 30, tzinfo=timezone.utc)
    for _ in range(2):
        told = refine.refine(rows, silver, quarantine, landing, None, start, end)
        assert (told.bronze_rows, told.rejected_rows, told.valid_rows) == (4, 1, 2)
    assert sorted((r["station_id"], r["num_bikes_available"]) for r in silver.read().collect()) == [(1, 2), (2, 3)]
    assert quarantine.read().count() == 1 and landing.read().count() == 2
    assert refine.refine(None, silver, quarantine, landing, None, start, end).bronze_rows == 0


def test_first_writer_wins_over_batches(spark, tmp_path):
    t = Table(spark, f"{tmp_path}/t", ("d",))
    rows = lambda v: spark.createDataFrame([(date(2026, 1, 1), 1, v)], "d date, k int, v string")
    t.insert_absent(rows("a"), ("d", "k"))
    t.insert_absent(rows("b"), ("d", "k"))
    assert [r["v"] for r in t.read().collect()] == ["a"]


def test_table_changes(spark, tmp_path):
    t = Table(spark, f"{tmp_path}/t", ("p",))
    df = lambda rows: spark.createDataFrame(rows, "p string, k int, v string")
    assert t.read() is None and not t.exists()
    t.append(df([("a", 1, "x"), ("b", 2, "x")]))
    t.append(df([("a", 3, "x")]))
    before = t.version()
    t.delete_insert(df([("a", 1, "y")]), ("k",))
    assert sorted(map(tuple, t.read().collect())) == [("a", 1, "y"), ("a", 3, "x"), ("b", 2, "x")]
    t.upsert(df([("a", 3, None), ("a", 4, "z")]), ("k",), prefer_new=("v",))
    assert sorted(map(tuple, t.read().collect())) == [("a", 1, "y"), ("a", 3, "x"), ("a", 4, "z"), ("b", 2, "x")]
    assert t.read(before).count() == 3
    t.overwrite_partitions(df([("b", 9, "n")]))
    assert sorted(r["k"] for r in t.read().collect()) == [1, 3, 4, 9]
    t.append(df([("b", 10, "n")]))
    assert t.compact()["removed"] >= 2
    rows = sorted(map(tuple, t.read().collect()))
    assert t.vacuum(0) > 0
    assert sorted(map(tuple, t.read().collect())) == rows
    t.overwrite(df([]))
    assert t.read().count() == 0


def test_second_writer_is_told(spark, tmp_path):
    t = Table(spark, f"{tmp_path}/t")
    t.append(spark.range(1).select(F.col("id")))
    with pytest.raises(Conflict):
        t._commit(t.version() - 1, spark.range(1).schema, [])


def test_replay_over_midnight_adds_nothing(spark, tmp_path):
    """B1: a message is rejected on one day and read again on the next, and much later."""
    rows = spark.createDataFrame([("{", 0, k, datetime(2026, 3, 1, 23, 58)) for k in range(4)], "raw_json string, kafka_partition int, kafka_offset bigint, kafka_timestamp timestamp").withColumn("rejection_reason", F.lit("x"))
    for hint in ("kafka_timestamp", None):
        t = Table(spark, f"{tmp_path}/{hint}", ("quarantine_date",))
        for at, some in ((datetime(2026, 3, 1, 23, 59), "kafka_offset < 3"), (datetime(2026, 3, 2, 0, 10), "true"), (datetime(2026, 4, 1), "true")):
            t.insert_absent(refine.to_quarantine(rows.filter(some), at), ("kafka_partition", "kafka_offset"), not_before=hint)
        assert sorted((r["kafka_offset"], str(r["quarantine_date"])) for r in t.read().collect()) == [(0, "2026-03-01"), (1, "2026-03-01"), (2, "2026-03-01"), (3, "2026-03-02")]


def test_bronze_replayed_on_another_day(spark, tmp_path):
    messages = spark.createDataFrame([(b"1", b"{}", "t", 0, k, datetime(2026, 3, 1, 12)) for k in range(3)], "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp")
    t = Table(spark, f"{tmp_path}/b", ("ingest_date",))
    bronze = refine.to_bronze(messages)
    for day, some in ((date(2026, 3, 1), "kafka_offset < 2"), (date(2026, 3, 5), "true"), (date(2026, 3, 6), "true")):
        t.insert_absent(bronze.filter(some).withColumn("ingest_date", F.lit(day)), ("kafka_partition", "kafka_offset"), not_before="kafka_timestamp")
    assert sorted((r["kafka_offset"], r["ingest_date"].day) for r in t.read().collect()) == [(0, 1), (1, 1), (2, 5)]


def test_newest_message_of_a_key(spark):
    at = datetime(2026, 3, 1)
    rows = spark.createDataFrame([(1, at, None, 9, {"a": 1}), (1, at, at, 3, {"a": 2}), (1, at, at, 4, {"a": 3}), (None, None, None, None, None), (2, at, None, None, {"a": 4})], "station_id int, last_reported timestamp, kafka_timestamp timestamp, kafka_offset int, m map<string,int>")
    told = refine.latest_message(rows)
    assert told.columns == rows.columns and sorted(str(r["m"]) for r in told.collect()) == ["None", "{'a': 3}", "{'a': 4}"]


@pytest.mark.parametrize("gaps", [1, 2, 24])
def test_alerts_go_out_again_after_the_gap(spark, monkeypatch, gaps):
    import random
    from datetime import timedelta

    from tidegrid.operators import quality

    monkeypatch.setattr(quality, "GAPS", gaps)
    r, start = random.Random(gaps), datetime(2026, 3, 1)
    rows = [(r.choice(("a", "b", None)), r.choice(("x", None)), start + timedelta(minutes=r.randrange(3000))) for _ in range(400)] + [("a", "x", None)]
    rows += [("hot", "x", start + timedelta(seconds=r.randrange(400_000))) for _ in range(2000)]  # one key with most rows, over blocks
    rows += [("even", "x", datetime(1969, 12, 30) + timedelta(minutes=20 * k)) for k in range(300)] * 2  # exact gaps, before and after 1970, repeated
    want, last = set(), {}
    for kind, title, at in sorted((x for x in rows if x[2]), key=lambda x: x[2]):
        if (kind, title) not in last or at - last[kind, title] >= timedelta(minutes=60):
            last[kind, title] = at
            want.add((kind, title, at))
    df = spark.createDataFrame(rows, "alert_type string, title string, created_at timestamp")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # keys over several batches
    try:
        got = [tuple(x) for x in quality.alerts_to_send(df, 60).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want) and set(got) == want
    if gaps == 1:
        assert quality.alerts_to_send(df, 0).count() == len(rows) - 1  # no gap: all with a time
        assert quality.alerts_to_send(df.limit(0), 60).count() == 0


def test_quantiles_equal_the_built_in_ones(spark):
    from tidegrid.plans import features

    rows = spark.range(5000).select(F.expr("case when id % 3 = 0 then 'a' when id % 3 = 1 then 'b' else 'c' end").alias("feature"), F.expr("case when id % 3 = 0 then cast(id % 7 as double) when id % 3 = 1 then pow(id, 1.5) else 4.5 end").alias("value"))
    points = [k / 10 for k in range(11)]
    want = {r["feature"]: r["e"] for r in rows.groupBy("feature").agg(F.percentile("value", F.array(*map(F.lit, points))).alias("e")).collect()}
    for parts in (1, 3, 1024):
        got = {r["feature"]: r["e"] for r in features.quantiles(rows, points, parts).collect()}
        assert all(abs(x - y) <= 1e-9 * max(1, abs(y)) for f in want for x, y in zip(got[f], want[f], strict=True))
