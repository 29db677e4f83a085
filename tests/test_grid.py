"""Grids of stations and hours: their results, and what their plans don't do."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidegrid.operators import asof
from tidegrid.plans import demo

SMALL = "/root/testdata/sf0.001"


def test_grid_query_tells_no_stations_apart_by_hour(spark):
    told = demo.hourly_grid(spark, SMALL)
    n, whole = demo.dims(spark, SMALL).agg(F.count("*"), F.sum("station_id")).first()
    assert {(r["n_stations"], r["n_rows"], r["sum_ids"]) for r in told.collect()} == {(n, n, whole)}
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert not any("hashpartitioning(heure_debut" in x and "station_id" in x for x in plan.splitlines())


def test_fill_by_grid_makes_no_hours_of_stations_without_readings(spark):
    at = datetime(2024, 1, 1)
    readings = spark.createDataFrame([(1, at, 5), (None, at, 7)], "station_id bigint, t timestamp, n int")
    stations = spark.createDataFrame([(1,), (1,), (2,), (None,)], "station_id bigint")
    hours = spark.createDataFrame([(at + timedelta(hours=h),) for h in range(3)], "heure_debut timestamp")
    told = asof.by_grid(readings, "station_id", "t", stations, hours)
    assert sorted((r["station_id"] or 0, r["n"]) for r in told.collect()) == [(0, 7)] * 3 + [(1, 5)] * 6
    assert "LeftSemi" in told._jdf.queryExecution().optimizedPlan().toString()
