import math
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidegrid.functions import calendar, numbers
from tidegrid.operators import asof, quality, serving
from tidegrid.plans import features, forecast, gold, jobs
from tidegrid.sources import feeds


def test_holidays_of_2025_to_2028(spark):
    rows = {r["date_ferie"]: r["nom_ferie"] for r in calendar.holidays(spark).collect()}
    assert len(rows) == 44
    assert rows[date(2027, 3, 29)] == "Lundi de Pâques" and rows[date(2028, 5, 25)] == "Ascension" and rows[date(2026, 5, 25)] == "Lundi de Pentecôte"


def test_bins_and_psi(spark):
    """Values on an edge belong to the bin above it, those outside to the first and last; scores as worked out by hand."""
    values = spark.createDataFrame([("t", v) for v in (1.0, 2.0, 2.0, 3.9, 4.0, 8.0, -100.0, 7.5)], "feature string, value double")
    bins = spark.createDataFrame([("t", [1.0, 2.0, 4.0, 8.0])], "feature string, bin_edges array<double>")
    told = features.shares(values, bins).first()
    assert told["bin_shares"] == [2 / 8, 3 / 8, 3 / 8] and told["n"] == 8
    vectors = [([0.2, 0.8], [0.8, 0.2]), ([0.1, 0.9], [0.1, 0.9]), ([1.0, 0.0], [0.5, 0.5])]
    got = [r[0] for r in spark.createDataFrame(vectors, "e array<double>, a array<double>").select(numbers.psi(F.col("e"), F.col("a"))).collect()]
    # 2 * 0.6 * ln 4; nothing; -0.5 * ln 0.5 + (0.5 - 1e-4) * ln(0.5 / 1e-4)
    assert got == pytest.approx([1.2 * math.log(4), 0.0, 0.5 * math.log(2) + 0.4999 * math.log(5000)])


def test_constant_and_empty_features(spark):
    values = spark.createDataFrame([("c", 3.0)] * 5, "feature string, value double")
    told = {r["feature"]: r["bin_edges"] for r in features.edges(values, names=("c", "e")).collect()}
    assert told == {"c": [2.5, 3.5], "e": [0.0, 1.0]}
    ref = features.shares(values, features.edges(values, names=("c", "e"))).drop("n")
    got = {r["feature"]: r for r in features.drift(ref, values).collect()}
    assert got["e"]["psi"] is None and not got["e"]["is_drift"] and got["c"]["psi"] == 0


def test_exact_rounding(spark):
    df = spark.createDataFrame([(285, 1000), (1005, 1000), (1, 0), (-5, 1000)], "a bigint, b bigint").select(numbers.exact_ratio(F.col("a"), F.col("b"), 2))
    assert [None if r[0] is None else float(r[0]) for r in df.collect()] == [0.29, 1.01, None, -0.01]


def readings(spark, rows):
    return spark.createDataFrame([(s, t, b) for s, t, b in rows], "station_id bigint, releve_at timestamp, velos_disponibles int")


def test_fill_on_hour_boundary_and_before_first_hour(spark):
    r = readings(spark, [(1, datetime(2020, 1, 1), 1), (1, datetime(2026, 1, 1, 10), 2), (1, datetime(2026, 1, 1, 10, 59, 59), 3), (2, datetime(2026, 1, 1, 11), 9)])
    h0, h1 = datetime(2026, 1, 1, 9), datetime(2026, 1, 1, 11)
    stations = spark.createDataFrame([(1,), (2,), (3,)], "station_id bigint")
    hours = spark.createDataFrame([(h0 + timedelta(hours=k),) for k in range(3)], "heure_debut timestamp")
    want = [(1, 9, 1), (1, 10, 3), (1, 11, 3), (2, 11, 9)]
    for df in (asof.by_intervals(r, "station_id", "releve_at", F.lit(h0), F.lit(h1)), asof.by_grid(r, "station_id", "releve_at", stations, hours)):
        assert sorted((x["station_id"], x["heure_debut"].hour, x["velos_disponibles"]) for x in df.collect()) == want


def test_time_shift_equals_self_joins(spark):
    rows = [(s, datetime(2026, 1, 1) + timedelta(hours=h), h * s) for s in (1, 2) for h in range(200) if h % 7]
    df = readings(spark, rows)
    names = {"a": 1, "b": 23, "c": 167, "d": -1}
    one, two = asof.time_shift(df, "station_id", "releve_at", "velos_disponibles", names), asof.time_shift_join(df, "station_id", "releve_at", "velos_disponibles", names)
    assert one.exceptAll(two.select(one.columns)).isEmpty() and two.select(one.columns).exceptAll(one).isEmpty()


def test_local_time_over_clock_change(spark):
    rows = spark.createDataFrame([(1, datetime(2026, 10, 25, 0, 30)), (1, datetime(2026, 10, 25, 1, 30))], "station_id bigint, t timestamp").select(F.hour(F.from_utc_timestamp("t", calendar.TIMEZONE)))
    assert [r[0] for r in rows.collect()] == [2, 2]


def test_status_order(spark):
    base = dict(releve_at=datetime(2026, 1, 1), velos_disponibles=0, velos_mecaniques=0, velos_electriques=0, bornes_libres=0, taux_remplissage=None, est_vide=True, est_pleine=True, est_installee=True, location_active=True)
    rows = [{"station_id": k, **base, **x} for k, x in enumerate(({}, {"location_active": False}, {"est_vide": False}, {"est_vide": False, "est_pleine": False, "taux_remplissage": 0.1}, {"est_vide": False, "est_pleine": False, "taux_remplissage": 0.9}, {"est_vide": False, "est_pleine": False, "taux_remplissage": 0.5}))]
    kinds = "station_id bigint, releve_at timestamp, velos_disponibles int, velos_mecaniques int, velos_electriques int, bornes_libres int, taux_remplissage double, est_vide boolean, est_pleine boolean, est_installee boolean, location_active boolean"
    facts = spark.createDataFrame(rows, kinds)
    dims = spark.range(6).select(F.col("id").alias("station_id"), *[F.lit("x").alias(c) for c in ("nom_station", "zone", "commune")], F.lit(1).alias("arrondissement"), F.lit(True).alias("est_paris"), F.lit(48.0 + 0).alias("latitude"), F.lit(2.0).alias("longitude"), F.lit(9).alias("capacite"))
    state = gold.current_state(facts, dims, datetime(2026, 1, 1, 1))
    assert [r["statut"] for r in state.orderBy("station_id").collect()] == ["vide", "hors service", "pleine", "presque vide", "presque pleine", "disponible"]
    near = serving.nearest(state, 48, 2, 50, "tout").collect()
    assert [r["station_id"] for r in near] == [0, 2, 3, 4, 5]


def test_reader_sees_its_views_only(spark):
    spark.range(3).createOrReplaceTempView("hidden")
    reader = serving.Reader(spark, {"numbers": lambda s: s.range(100).selectExpr("id", "id / 3 AS third")})
    told = reader.run("select * from numbers order by id")
    assert told["row_count"] == 40 and told["truncated"] and told["rows"][1] == [1, 0.333]
    assert reader.schema_text() == "numbers(id, third)"
    with pytest.raises(Exception, match="hidden"):
        reader.run("select * from hidden")


def test_documents_without_a_list_of_stations():
    """One for each way out of the parser."""
    for document in (None, 7, {}, {"data": None}, {"data": [1, 2]}, {"data": {"stations": None}}, {"data": {"stations": {"station_id": 4}}}):
        with pytest.raises(feeds.FeedError, match="no list"):
            feeds.parse_status(document)


def test_time_of_a_document():
    for times, want in (({"last_updated": 9}, 9), ({"lastUpdatedOther": 3, "last_updated": 9}, 3), ({"lastUpdatedOther": None, "last_updated": 9}, 9), ({}, None)):
        assert feeds.parse_status({**times, "data": {"stations": [{"station_id": 5}, {}]}}) == (want, [{"station_id": 5}, {}])
    assert feeds.serialize([{"name": "Saint-Éloi"}, None]) == '[{"name":"Saint-Éloi"},null]'.encode()


def test_fetch_tries_again():
    answers = iter([(503, b""), (429, b""), (200, b'{"last_updated": 5, "data": {"stations": []}}')])
    assert feeds.fetch("x", get=lambda *_: next(answers), sleep=lambda s: None) == (5, [])
    with pytest.raises(feeds.FeedError):
        feeds.fetch("x", get=lambda *_: (404, b""), sleep=lambda s: None)


def test_status_documents_as_rows(spark):
    docs = spark.createDataFrame([('{"last_updated": 5, "data": {"stations": [{"station_id": 1, "num_bikes_available": 2}, {"last_reported": 1}]}}',)], "value string")
    rows = feeds.messages(feeds.status_rows(docs), "t0").collect()
    assert [r["key"] for r in rows] == ["1"] and '"num_bikes_available":2' in rows[0]["value"]
    with pytest.raises(Exception, match="no list of stations"):
        feeds.status_rows(spark.createDataFrame([('{"data": {}}',)], "value string")).collect()


def test_stations_and_geocoding(spark, tmp_path):
    path = feeds.keep_snapshot(spark, '{"data": {"stations": [{"station_id": 1, "name": " A ", "lat": 1.0, "lon": 2.0, "capacity": 9}, {"station_id": 2, "name": " ", "lat": 1.0, "lon": 2.0}, {"station_id": 3, "lat": null, "lon": 1.0}]}}', f"file://{tmp_path}", datetime(2026, 1, 2, 3, 4, 5))
    assert path.endswith("snapshot_date=2026-01-02/station_information_030405.json")
    rows = feeds.parse_stations(feeds.read_snapshot(spark, path))
    assert sorted(r["station_name"] for r in rows.collect()) == ["A", "Station 2"]
    known = spark.createDataFrame([(1, "75101")], "station_id bigint, code_insee string")
    found = {r["station_id"]: r["code_insee"] for r in feeds.geocode(rows, known, lambda lat, lon: ("Ville", "92001")).collect()}
    assert found == {1: None, 2: "92001"}


def test_suite_and_constraints(spark):
    rows = spark.createDataFrame([(1, 5, True), (1, 200, False), (None, -1, True)], "station_id bigint, n int, ok boolean")
    suite = (quality.Check("not_null", ("station_id",), mostly=0.6), quality.Check("unique", ("station_id",)), quality.Check("between", ("n",), 0, 150), quality.Check("between", ("n",), 0, 150, 0.5, "ok"), quality.Check("row_count", low=4, severity="warning"))
    told = [(r["success"], r["unexpected_count"], r["element_count"]) for r in quality.run_suite(rows, suite).collect()]
    assert told == [(True, 1, 3), (False, 2, 3), (False, 2, 3), (True, 1, 2), (False, 0, 3)]
    assert not quality.passes(quality.run_suite(rows, suite)) and quality.passes(quality.run_suite(rows, suite[:1]))
    assert quality.freshness(rows.limit(0).withColumn("t", F.current_timestamp()), "t", datetime(2026, 1, 1), 30, 120).first()["status"] == "error"


def test_alert_log(spark, tmp_path):
    from tidegrid.operators.tables import Table

    log, at = Table(spark, f"{tmp_path}/log"), datetime(2026, 1, 1, 12)
    alert = {"alert_type": "drift", "severity": "warning", "title": "t"}
    assert [quality.notify(log, spark, alert, at + timedelta(minutes=m), 60) for m in (0, 30, 61)] == [True, False, True]


def test_steps_run_in_order():
    seen = []
    steps = {"b": (("a",), lambda: seen.append("b")), "a": ((), lambda: seen.append("a")), "c": (("d",), lambda: seen.append("c")), "d": ((), lambda: jobs.SKIPPED)}
    assert jobs.run_in_order(steps)["c"] == jobs.SKIPPED and seen == ["a", "b"]
    with pytest.raises(ValueError):
        jobs.run_in_order({"a": (("b",), lambda: 1), "b": (("a",), lambda: 1)})


def test_promotion_and_clipping(spark):
    assert forecast.promote(1.0, None) and forecast.promote(1.0, 1.0) and not forecast.promote(1.1, 1.0)
    df = spark.createDataFrame([(-1.0, 5.0), (9.0, 5.0), (9.0, None)], "p double, c double").select(forecast.clipped(F.col("p"), F.col("c")))
    assert [r[0] for r in df.collect()] == [0.0, 5.0, 9.0]


def test_gold_by_increments_equals_full(spark, tmp_path):
    from tidegrid.operators.tables import Table
    from tidegrid.plans import demo

    d = "/root/testdata/sf0.001"
    house = jobs.Warehouse(Table(spark, f"{tmp_path}/s"), Table(spark, f"{tmp_path}/d"), Table(spark, f"{tmp_path}/f"), Table(spark, f"{tmp_path}/h"))
    house.stations.overwrite(demo.stations(spark, d))
    rows = demo.status(spark, d).drop("loaded_at")
    for until in (datetime(2024, 1, 15), datetime(2024, 1, 31)):
        told, ok = jobs.merge_landing(rows.filter(F.col("last_reported") < F.lit(until).cast("timestamp")), house, until, until)
        assert ok and told.count() == 12
        models = jobs.build_gold(spark, house, until)
    whole = demo.critical_stations(spark, d)
    assert demo.plain(models["agg_stations_critiques"]).exceptAll(whole.select(models["agg_stations_critiques"].columns)).isEmpty()
    assert house.hours.read().groupBy("station_id", "heure_debut").count().filter("count > 1").isEmpty()
    assert spark.table("dim_heure").count() == 24
