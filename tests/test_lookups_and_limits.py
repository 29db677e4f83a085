"""Files that stay closed, figures of one pass, ranges of a database, places asked once, and a limit that holds."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidegrid.operators import refine, serving
from tidegrid.operators.tables import Table
from tidegrid.plans import demo
from tidegrid.sources import feeds, jdbc

DATA = "/root/testdata/sf0.001"


def test_lookups_open_counted_files(spark, tmp_path):
    """By ends of sorted files, by bits where ends overlap, and through compaction; rows without an index are read as before."""
    table = Table(spark, f"file://{tmp_path}/t", sort_by=("a",), index=("a", "b"))
    rows = spark.range(8000).select((F.col("id") % 4000).alias("a"), F.concat(F.lit("k"), (F.col("id") * 7 % 1000).cast("string")).alias("b"), "id")
    for k in range(2):
        table.append(rows.filter(F.col("id") % 2 == k).repartitionByRange(5, "a"))
    assert len(table.files_for({})) == 10
    assert len(table.files_for({"a": 1234})) <= 2 and table.files_for({"a": 9999}) == []
    assert sorted(r["id"] for r in table.lookup(a=1234).collect()) == [1234, 5234]
    one = rows.filter("id = 1234").first()
    assert len(table.files_for({"a": 1234, "b": one["b"]})) == 1  # the other batch has odd numbers only
    assert [r["id"] for r in table.lookup(a=1234, b=one["b"]).collect()] == [1234, 5234][: 1 + (one["b"] == rows.filter("id = 5234").first()["b"])]
    assert table.files_for({"a": 1234, "b": "nowhere"}) == [] and table.lookup(a=1234, b="nowhere").count() == 0
    table.compact()
    assert sorted(r["id"] for r in table.lookup(a=17).collect()) == [17, 4017]
    plain = Table(spark, f"file://{tmp_path}/t")
    plain.append(rows.filter("id = 17"))
    assert sorted(r["id"] for r in table.lookup(a=17).collect()) == [17, 17, 4017]


def test_refine_reads_the_raw_rows_once(spark, tmp_path):
    """The figures equal those of separate counts; one scan of the raw folder; an empty window has zero counts."""
    path = f"{tmp_path}/bronze"
    refine.to_bronze(demo.messages(spark, DATA)).withColumn("ingest_date", F.to_date("kafka_timestamp")).write.parquet(path)
    bronze, first, last = spark.read.parquet(path), datetime(2024, 1, 3), datetime(2024, 1, 9)
    made = lambda name: [Table(spark, f"file://{tmp_path}/{name}/{t}", p) for t, p in (("silver", ("report_date",)), ("quarantine", ("quarantine_date",)), ("landing", ()))]
    reads, listener = [], spark._jsparkSession.sharedState().statusStore()
    before = listener.executionsCount()
    told = refine.refine(bronze, *made("a"), None, first, last)
    for e in serving._each(listener.executionsList(int(before), 1000)):
        reads += [line for line in e.physicalPlanDescription().split("\n") if "Location" in line and path in line]
    checked = refine.with_reason(refine.parse(refine.in_window(bronze, first, last)), int(last.timestamp()))
    want = {r["rejection_reason"]: r["count"] for r in checked.groupBy("rejection_reason").count().collect()}
    assert told.bronze_rows == sum(want.values()) and told.rejections_by_reason == {k: v for k, v in want.items() if k} and told.rejected_rows == sum(told.rejections_by_reason.values())
    assert told.valid_rows == refine.to_silver(checked.filter("rejection_reason is null"), last).count()
    assert len(reads) == 1
    none = refine.refine(bronze, *made("b"), None, datetime(2030, 1, 1), datetime(2030, 1, 2))
    assert (none.bronze_rows, none.rejected_rows, none.valid_rows, none.rejections_by_reason) == (0, 0, 0, {})


def test_ranges_of_a_database(spark):
    url, properties = jdbc.embedded()
    rows = spark.range(1000).select(F.col("id").alias("n"), (F.col("id") % 7).alias("k"))
    jdbc.append(rows.filter("k < 6"), url, "things", properties, batch=100, parts=3)
    jdbc.append(rows.filter("k = 6"), url, "things", properties)
    told = jdbc.scan(spark, url, 'SELECT * FROM things WHERE "k" > 2', "n", 5, properties)
    assert told.rdd.getNumPartitions() == 5 and sorted(r["n"] for r in told.collect()) == [n for n in range(1000) if n % 7 > 2]
    assert all(n > 100 for n in told.groupBy(F.spark_partition_id()).count().toPandas()["count"])
    assert jdbc.scan(spark, url, 'SELECT * FROM things WHERE "k" > 9', "n", 5, properties).count() == 0
    assert jdbc.known_stations(spark, url, "things", properties, "n").count() == 1000
    jdbc.append(rows.limit(0), url, "empty", properties)
    assert jdbc.known_stations(spark, url, "empty", properties, "n") is None


def test_each_place_is_asked_once(spark, tmp_path):
    calls, broken = tmp_path / "calls", tmp_path / "broken"
    calls.mkdir()
    broken.touch()

    def resolve(lat, lon):
        (calls / f"{lat}_{lon}_{time.time_ns()}").touch()
        if lat == 9 and broken.exists():
            raise TimeoutError
        return (None, None) if lat == 5 else (f"C{lat:.0f}", "92000")

    rows = [(k, float(k % 10), 2.0) for k in range(40)] + [(99, None, 2.0)]
    stations, answers = spark.createDataFrame(rows, "station_id bigint, lat double, lon double").repartition(5), Table(spark, f"file://{tmp_path}/answers")
    told = {r["station_id"]: r["commune"] for r in feeds.geocode_pooled(stations, answers, resolve).collect()}
    assert len(told) == 41 and told[3] == told[13] == "C3" and told[5] is None and told[9] is None and told[99] is None
    assert len(list(calls.iterdir())) == 10
    broken.unlink()
    told = {r["station_id"]: r["commune"] for r in feeds.geocode_pooled(stations, answers, resolve).collect()}
    assert told[9] == told[39] == "C9" and len(list(calls.iterdir())) == 11


@pytest.mark.parametrize("sql", ["SELECT size(sequence(1, 150000000))", "SELECT length(rpad('x', 300000000, 'y'))", "SELECT lpad('x', n, 'y') FROM numbers", "SELECT sequence(1, id) FROM numbers", "SELECT format_number(1.5, 100000000)", "SELECT 1 " + " " * 30_000])
def test_results_are_bounded(spark, sql):
    reader = serving.Reader(spark, {"numbers": lambda s: s.range(10)}, timeout_s=5)
    with pytest.raises(ValueError, match="bounded|long"):
        reader.run(sql)
    assert reader.run("SELECT size(sequence(-5, 5)), rpad('x', 3, 'y'), lpad('7', 3, '0')")["rows"] == [[11, "xyy", "007"]]


def test_the_limit_holds_for_tasks_and_constants(spark):
    reader = serving.Reader(spark, {"numbers": lambda s: s.range(3000)}, timeout_s=2)
    for sql in ("SELECT count(*) FROM numbers a JOIN numbers b ON a.id <> b.id JOIN numbers c ON c.id + b.id <> a.id WHERE sqrt(a.id * b.id + c.id) > 1e9", "SELECT max(a.id * b.id % 7) FROM numbers a JOIN numbers b ON a.id <> b.id JOIN numbers c ON c.id <> b.id"):
        began = time.perf_counter()
        with pytest.raises(TimeoutError):
            reader.run(sql)
        assert time.perf_counter() - began < 6
    assert serving.Reader(spark, {"numbers": lambda s: s.range(3)}, timeout_s=60).run("SELECT count(*) FROM numbers")["rows"] == [[3]]


def test_predictions_of_versions_and_drift_of_models(spark, tmp_path):
    from tidegrid.plans import model_jobs

    store = model_jobs.Store(spark, f"file://{tmp_path}")
    told = lambda version, n: spark.createDataFrame([(k, datetime(2024, 1, 5), datetime(2024, 1, 5, 1), float(n), "m", version, datetime(2024, 1, 5)) for k in range(3)], "station_id bigint, feature_time timestamp, target_time timestamp, predicted_bikes double, model_name string, model_version string, predicted_at timestamp")
    for version, n in (("1", 4), ("2", 5), ("1", 6)):
        model_jobs.store_predictions(store, told(version, n))
    assert sorted((r["model_version"], r["predicted_bikes"]) for r in store.predictions.read().collect()) == [("1", 6.0)] * 3 + [("2", 5.0)] * 3
    later = told("2", 7).withColumn("target_time", F.col("target_time") + F.lit(timedelta(days=1)))
    old = store.predictions._list()["folders"]
    model_jobs.store_predictions(store, later)
    assert set(old) < set(store.predictions._list()["folders"])  # the other day's partition stays as it is
