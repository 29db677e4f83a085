from datetime import datetime

from tidegrid.schemas import MESSAGE
from tidegrid.streaming import ingest

ROWS = [(1, 100, 1), (2, 200, 2), (1, 100, 3), (2, 260, 4), (3, None, 5), (3, 7, 6), (3, None, 7)]


def test_changes_of_a_table(spark):
    df = spark.createDataFrame([(*r, "v") for r in ROWS] + [(None, 1, 8, "v")], "station_id bigint, last_reported bigint, seq bigint, value string")
    assert sorted(r["seq"] for r in ingest.changed(df).collect()) == [1, 2, 4, 6, 7]
    assert ingest.changed_stream(df, only_changed=False).count() == 7


def test_bronze_survives_a_restart(spark, tmp_path):
    gauges = ingest.Gauges()
    spark.streams.addListener(gauges)
    for k in range(2):
        rows = [(b"1", b"{}", "t", 0, k, datetime(2026, 1, 1))]
        spark.createDataFrame(rows, MESSAGE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = ingest.write_bronze(ingest.source(spark, "files", f"{tmp_path}/in", per_trigger=1), f"{tmp_path}/bronze", f"{tmp_path}/checkpoint", {"availableNow": True}, "restart")
        q.awaitTermination()
    assert sorted(r["kafka_offset"] for r in spark.read.parquet(f"{tmp_path}/bronze").collect()) == [0, 1]
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    spark.streams.removeListener(gauges)
    assert gauges.rows.get("restart", 0) == 2


def test_bronze_table_takes_a_message_once(spark, tmp_path):
    from tidegrid.operators.tables import Table
    from tidegrid.plans import jobs

    table = Table(spark, f"{tmp_path}/bronze", ("ingest_date",), ("kafka_partition", "kafka_offset"))
    rows = [(b"1", b"{}", "t", 0, k, datetime(2026, 1, 1)) for k in (1, 2)]
    spark.createDataFrame(rows, MESSAGE).write.parquet(f"{tmp_path}/in")
    for k in range(2):  # a new checkpoint reads everything again
        ingest.write_bronze_table(ingest.source(spark, "files", f"{tmp_path}/in"), table, f"{tmp_path}/checkpoint{k}", {"availableNow": True}, f"again{k}").awaitTermination()
    assert sorted(r["kafka_offset"] for r in table.read().collect()) == [1, 2]
    assert jobs.maintain({"bronze": table, "none": Table(spark, f"{tmp_path}/none")}, 0).keys() == {"bronze"}
    assert table.read().count() == 2
