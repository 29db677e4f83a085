"""The pipeline's relations made from the driver's tables (star schema and events), and a query for each operator.

Readings come from `events` (k in props: bikes, the rest of 99: docks), stations from `customer`, known ones from
`supplier`, duplicates from `lineitem`. All times are UTC and in January 2024, so local time is one hour ahead.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import dim_date, dim_hour, holidays
from ..operators import asof, quality, refine, serving
from ..operators.tables import Table
from ..schemas import MESSAGE
from ..session import kept, work_dir
from ..sources import feeds, jdbc, topic
from ..streaming import ingest
from . import boosting, features, forecast, gold, jobs, model_jobs

AS_OF = datetime(2024, 1, 31)
NOW_EPOCH = 1_706_659_200  # AS_OF


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and instants without zone, as the other engine's files have them."""
    kinds = {f.name: f.dataType for f in df.schema}
    return df.select(*[F.col(c).cast("double" if isinstance(t, T.DecimalType) else "timestamp_ntz" if isinstance(t, T.TimestampType) else t).alias(c) for c, t in kinds.items()])


def events(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k INT").getField("k")
    return load(spark, d, "events").select("event_id", F.col("user_id").alias("station_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", k.alias("k"))


def status(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    return events(spark, d).select(
        "station_id", F.col("station_id").cast("string").alias("station_code"), F.col("ts").alias("last_reported"), k.alias("num_bikes_available"), (k % 10).alias("num_mechanical"), (k - k % 10).alias("num_ebike"), (99 - k).alias("num_docks_available"),
        (F.col("event_type") != "error").alias("is_installed"), (F.col("event_type") != "signup").alias("is_renting"), F.lit(True).alias("is_returning"), F.col("ts").alias("kafka_timestamp"), F.col("ts").alias("ingested_at"), F.col("ts").alias("loaded_at"),
    )


def stations(spark: SparkSession, d: str) -> DataFrame:
    id_, nation = F.col("c_custkey"), F.col("c_nationkey")
    code = F.when(nation % 2 == 0, F.concat(F.lit("751"), F.lpad((id_ % 20 + 1).cast("string"), 2, "0"))).when(nation > 1, (92000 + nation).cast("string"))
    return load(spark, d, "customer").join(load(spark, d, "nation"), nation == F.col("n_nationkey")).select(
        id_.alias("station_id"), id_.cast("string").alias("station_code"), F.col("c_name").alias("station_name"), (48.0 + id_ % 1000 / 1000.0).alias("lat"), (2.0 + id_ * 7 % 1000 / 1000.0).alias("lon"), F.lit(99).alias("capacity"),
        F.col("n_name").alias("commune"), code.alias("code_insee"), F.lit(date(2024, 1, 1)).alias("first_seen"), F.lit(date(2024, 1, 31)).alias("last_seen"),
    )


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Broker rows whose small k have defects: cut text, no station, no time, default time, future time, bad counts."""
    k, sid = F.col("k"), F.col("station_id")
    text = lambda c: c.cast("string")
    epoch = F.when(k == 6, "null").when(k == 7, "0").when(k == 8, "4102444800").otherwise(text(F.unix_seconds("ts")))
    raw = F.concat(
        F.lit('{"station": {"station_id": '), F.when(k == 5, "null").otherwise(text(sid)), F.lit(', "stationCode": "'), text(sid), F.lit('", "num_bikes_available": '), F.when(k == 9, "-1").otherwise(text(k)),
        F.lit(', "num_bikes_available_types": [{"mechanical": '), text(k % 10), F.lit('}, {"ebike": '), text(k - k % 10), F.lit('}], "num_docks_available": '), F.when(k == 10, "-1").otherwise(text(99 - k)),
        F.lit(', "is_installed": 1, "is_renting": '), F.when(F.col("event_type") == "signup", "0").otherwise("1"), F.lit(', "is_returning": 1, "last_reported": '), epoch, F.lit("}}"),
    )
    return events(spark, d).select(text(sid).cast("binary").alias("key"), F.when(k < 5, F.substring(raw, 1, 20)).otherwise(raw).cast("binary").alias("value"), F.lit("station_status").alias("topic"), (sid % 3).cast("int").alias("partition"), F.col("event_id").alias("offset"), F.col("ts").alias("timestamp"))


def facts(spark: SparkSession, d: str) -> DataFrame:
    return gold.fact(gold.stg_status(status(spark, d)), dims(spark, d))


def dims(spark: SparkSession, d: str) -> DataFrame:
    return gold.dim_station(gold.stg_stations(stations(spark, d)))


def hours(spark: SparkSession, d: str) -> DataFrame:
    return gold.hourly(facts(spark, d), dims(spark, d))


def dates(spark: SparkSession) -> DataFrame:
    return dim_date(spark, date(2023, 12, 25), date(2026, 1, 5), holidays(spark))


def checked(spark: SparkSession, d: str) -> DataFrame:
    known = load(spark, d, "supplier").select(F.col("s_suppkey").alias("station_id"))
    return refine.with_reason(refine.parse(refine.to_bronze(messages(spark, d))), NOW_EPOCH, known)


def feature_rows(spark: SparkSession, d: str, with_target: bool = True) -> DataFrame:
    return features.build(features.load_hourly(hours(spark, d), dims(spark, d), datetime(2024, 1, 1), AS_OF), holidays(spark), with_target)


def critical_stations(spark, d):
    return plain(gold.critical_stations(gold.intervals(facts(spark, d), AS_OF), dims(spark, d), AS_OF))


def rank_empty_full(spark, d):
    return critical_stations(spark, d).select("station_id", "part_temps_vide", "rang_vide", "part_temps_pleine", "rang_pleine")


def bronze_projection(spark, d):
    return plain(refine.to_bronze(messages(spark, d)).drop("ingested_at", "ingest_date"))


def parse_json(spark, d):
    return plain(refine.parse(refine.to_bronze(messages(spark, d))).drop("ingested_at", "raw_json", "kafka_timestamp"))


def reject_reason(spark, d):
    return checked(spark, d).select("kafka_offset", "rejection_reason")


def reject_counts(spark, d):
    return refine.reason_counts(checked(spark, d)).withColumnRenamed("count", "n")


def known_flag_join(spark, d):
    return refine.with_known_flag(events(spark, d).select("event_id", "station_id"), load(spark, d, "supplier").select(F.col("s_suppkey").alias("station_id")))


def silver(spark, d):
    return plain(refine.to_silver(checked(spark, d).filter("rejection_reason is null"), AS_OF).select("station_id", "last_reported", "num_bikes_available", "num_mechanical", "num_ebike", "num_docks_available", "is_renting", "kafka_offset", "report_date"))


def dedup_latest(spark, d):
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return refine.latest_message(rows, ("l_orderkey", "l_linenumber"), tuple(rows.columns[2:]))


def map_array_sum(spark, d):
    k = F.col("k")
    types = F.array(F.create_map(F.lit("mechanical"), k % 10), F.create_map(F.lit("ebike"), k - k % 10), F.create_map(F.lit("mechanical"), F.lit(1)))
    return events(spark, d).select("event_id", refine.count_of(types, "mechanical").alias("mechanical"), refine.count_of(types, "ebike").alias("ebike"), refine.count_of(types, "cargo").alias("cargo"))


def _readings(spark, d, *key: str) -> DataFrame:
    return facts(spark, d).groupBy(*key).agg(F.count("*").alias("n_readings"))


def dim_hour_query(spark, d):
    """Each hour of the day, with its readings."""
    return dim_hour(spark).join(_readings(spark, d, "heure"), "heure", "left").withColumn("n_readings", F.coalesce("n_readings", F.lit(0)).cast("long"))


def dim_date_query(spark, d):
    """Each day, with its readings."""
    return dates(spark).join(_readings(spark, d, "date_id"), "date_id", "left").withColumn("n_readings", F.coalesce("n_readings", F.lit(0)).cast("long"))


def dim_station_zone(spark, d):
    return dims(spark, d)


def holiday_left_join(spark, d):
    told = dates(spark).join(_readings(spark, d, "date_id"), "date_id", "left")
    return told.groupBy("annee", "type_jour").agg(F.count("*").alias("n_days"), F.count("nom_ferie").alias("n_holidays"), F.coalesce(F.sum("n_readings"), F.lit(0)).cast("long").alias("n_readings"))


def fact_availability(spark, d):
    return plain(facts(spark, d).drop("ingested_at", "loaded_at"))


def reading_intervals(spark, d):
    return plain(gold.intervals(facts(spark, d), AS_OF).drop("duree_minutes"))


def latest_state(spark, d):
    return plain(gold.latest_state(facts(spark, d)).select("station_id", "releve_at", "velos_disponibles", "est_installee"))


def state_classification(spark, d):
    return plain(gold.current_state(facts(spark, d), dims(spark, d), AS_OF))


def hourly_forward_fill(spark, d):
    return plain(hours(spark, d))


def hourly_fill_by_grid(spark, d):
    f, s = facts(spark, d).select("station_id", "releve_at", "velos_disponibles"), dims(spark, d)
    edges = gold.grid_bounds(facts(spark, d))
    all_hours = edges.select(F.explode(F.sequence("h0", "h1", asof.one_hour())).alias("heure_debut"))
    return plain(asof.by_grid(f, "station_id", "releve_at", s, all_hours).select("station_id", "heure_debut", F.col("releve_at").alias("dernier_releve_at"), "velos_disponibles"))


def hourly_grid(spark, d):
    """The whole grid of stations and hours, told by hour."""
    all_hours = gold.grid_bounds(facts(spark, d)).select(F.explode(F.sequence("h0", "h1", asof.one_hour())).alias("heure_debut"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = dims(spark, d).repartition(parts, "station_id").groupBy("station_id").agg(F.count("*").alias("n"))  # before the hours, so that no hour's stations are told apart again
    told = asof.grid(each, all_hours, "station_id", "n").groupBy("heure_debut").agg(F.count("station_id").alias("n_stations"), F.sum("n").alias("n_rows"), F.sum(F.col("station_id") * F.col("n")).alias("sum_ids"))
    return plain(told)


def hourly_incremental(spark, d):
    have = spark.createDataFrame([(datetime(2024, 1, 20),)], "heure_debut timestamp")
    return plain(gold.hourly(facts(spark, d), dims(spark, d), have).select("station_id", "heure_debut", "velos_disponibles", "minutes_depuis_releve"))


def zone_hourly(spark, d):
    return plain(gold.zone_hourly(hours(spark, d), dims(spark, d)))


def hourly_profile(spark, d):
    return plain(gold.hourly_profile(hours(spark, d), dates(spark), dims(spark, d)))


def time_shift_lags(spark, d):
    rows = hours(spark, d).select("station_id", "heure_fin", "velos_disponibles")
    return plain(asof.time_shift(rows, "station_id", "heure_fin", "velos_disponibles", {"lag_1": 1, "lag_2": 2, "lag_23": 23, "lag_167": 167, "next_1": -1}))


def feature_matrix(spark, d):
    rows = feature_rows(spark, d)
    return plain(rows.select(*[F.round(c, 6).alias(c) if c in ("moyenne_3h", "part_electriques", "latitude", "longitude") else c for c in rows.columns]))


def temporal_split(spark, d):
    learn, test = features.temporal_split(hours(spark, d))
    return plain(learn.agg(F.count("*").alias("n"), F.max("heure_fin").alias("newest")).withColumn("part", F.lit("train")).unionByName(test.agg(F.count("*").alias("n"), F.max("heure_fin").alias("newest")).withColumn("part", F.lit("test"))))


def _order_values(spark, d, part: str) -> DataFrame:
    rows = load(spark, d, "orders").filter(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz") if part == "old" else F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    return rows.select(F.lit("o_totalprice").alias("feature"), F.col("o_totalprice").alias("value"))


def decile_edges(spark, d):
    told = features.edges(_order_values(spark, d, "old"), names=("o_totalprice",))
    return told.select("feature", F.posexplode("bin_edges").alias("k", "e")).select("feature", "k", F.round("e", 4).alias("edge"))


def _fixed_edges(spark) -> DataFrame:
    return spark.createDataFrame([("o_totalprice", [0.0, 50000.0, 100000.0, 200000.0, 300000.0, 500000.0])], "feature string, bin_edges array<double>")


def bin_shares(spark, d):
    told = features.shares(_order_values(spark, d, "old"), _fixed_edges(spark))
    return told.select("feature", "n", F.posexplode("bin_shares").alias("k", "s")).select("feature", "n", "k", F.round("s", 9).alias("share"))


def psi(spark, d):
    ref = features.shares(_order_values(spark, d, "old"), _fixed_edges(spark)).drop("n")
    return features.drift(ref, _order_values(spark, d, "new")).withColumn("psi", F.round("psi", 9))


def drift_features(spark, d):
    """The last week against the weeks before it."""
    rows, week = feature_rows(spark, d, False), F.lit(AS_OF - timedelta(days=7)).cast("timestamp")
    values = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in features.MONITORED]
    told = rows.select((F.col("heure_fin") < week).alias("is_old"), F.inline(F.array(*values))).filter("value is not null")
    counts = kept(spark, told.groupBy("is_old", "feature", "value").agg(F.count("*").alias("n")))
    old, new = (counts.filter(c).drop("is_old") for c in ("is_old", "not is_old"))
    told = features.drift(features.shares(old, features.edges(old)).drop("n"), new, 0.001)
    return told.select("feature", F.round("psi", 6).alias("psi"), "is_drift", "n_current")


def prediction_vs_actual(spark, d):
    h = kept(spark, hours(spark, d).select("station_id", "heure_fin", "velos_disponibles"))
    told = forecast.persistence(h, "1", AS_OF).unionByName(forecast.persistence(h, "2", datetime(2024, 2, 1)).filter("station_id % 2 = 0").withColumn("predicted_bikes", F.col("predicted_bikes") + 1))
    return plain(gold.predictions_vs_actual(told, dims(spark, d), h))


def baseline_metrics(spark, d):
    return forecast.baseline_metrics(feature_rows(spark, d).dropna(subset=[features.TARGET])).select(F.round("mae", 9).alias("mae"), F.round("rmse", 9).alias("rmse"))


def forecast_latest(spark, d):
    rows = kept(spark, feature_rows(spark, d))
    trained = forecast.train(rows)
    return plain(forecast.predict(trained.model, rows.drop(features.TARGET), "trees", "1", AS_OF).drop("predicted_at"))


def forecast_search(spark, d):
    """M7 with its whole search: the newest hour's predictions, and how the model did on the test part against persistence."""
    rows = kept(spark, feature_rows(spark, d))
    trained = boosting.train(rows, stored=True)
    told = forecast.predict(trained.model, rows.drop(features.TARGET), "boosted", "1", AS_OF)
    figures = [F.lit(trained.point["trials"]).alias("trials"), F.lit(round(trained.baseline_mae, 6)).alias("baseline_mae"), F.lit(trained.test_mae <= trained.baseline_mae + 1e-9).alias("not_worse")]
    return plain(told.select("station_id", "feature_time", "target_time", F.col("predicted_bikes").between(0, 99).alias("in_range"), *figures))


class _Half:
    """Stands for a model: half as many again as now, which capacities cut off."""

    def transform(self, df):
        return df.withColumn("prediction", F.col("velos_t0") * 1.5 - 10)


def stored_predictions(spark, d):
    """Predictions of two hours, the first by two versions, of which one is stored twice."""
    store, h, s = model_jobs.Store(spark, work_dir(spark)), kept(spark, hours(spark, d)), dims(spark, d)
    for at, version in ((datetime(2024, 1, 20), "1"), (datetime(2024, 1, 25), "1"), (datetime(2024, 1, 20), "2"), (datetime(2024, 1, 20), "1")):
        model_jobs.predict_run(h, s, store, at, model=_Half(), version=version)
    return plain(store.predictions.read().drop("predicted_at", "target_date"))


def stored_bins(spark, d):
    """Bins of two versions, one of them stored twice."""
    store = model_jobs.Store(spark, work_dir(spark))
    rows = kept(spark, feature_rows(spark, d, False).select("heure_fin", *features.MONITORED))
    for day, version in ((10, "1"), (10, "2"), (24, "1")):
        model_jobs.store_bins(store, rows.filter(F.col("heure_fin") < F.lit(datetime(2024, 1, day)).cast("timestamp")), "m", version)
    told = store.bins.read().filter("feature = 'velos_t0'").select("model_version", F.posexplode("bin_shares").alias("k", "s"), F.col("bin_edges").alias("e"))
    return told.select("model_version", "k", F.round(F.col("e")[F.col("k")], 6).alias("edge"), F.round("s", 6).alias("share"))


def stored_drift(spark, d):
    """Drift against stored bins at two times, at the second by two models, one of which runs twice; and each run's own summary."""
    store, h, s = model_jobs.Store(spark, work_dir(spark)), kept(spark, hours(spark, d)), dims(spark, d)
    rows = kept(spark, model_jobs.rows_of(h, s, AS_OF, False))
    for name, days in (("m", 7), ("other", 21)):
        model_jobs.store_bins(store, rows.filter(F.col("heure_fin") < F.lit(AS_OF - timedelta(days=days)).cast("timestamp")), name, "1")
    runs = ((AS_OF - timedelta(days=4), "m"), (AS_OF, "m"), (AS_OF, "other"), (AS_OF, "m"))
    told = {(at, name): model_jobs.drift_job(h, s, store, at, name, "1", 72, 0.001)["max_psi"] for at, name in runs}
    largest = spark.createDataFrame([(*k, v) for k, v in told.items()], "computed_at timestamp, model_name string, max_psi double")
    stored = store.drift.read()
    most = stored.groupBy("computed_at", "model_name").agg(F.max("psi").alias("most"))
    rows = stored.filter("feature = 'velos_t0'").join(largest, ["computed_at", "model_name"]).join(most, ["computed_at", "model_name"])
    return plain(rows.select("computed_at", "model_name", "feature", F.round("psi", 6).alias("psi"), "is_drift", "n_current", (F.col("max_psi") == F.col("most")).alias("max_is_own")))


def window_lookback(spark, d):
    rows = refine.to_bronze(messages(spark, d)).withColumn("ingest_date", F.to_date("kafka_timestamp"))
    return refine.in_window(rows, datetime(2024, 1, 10, 12), datetime(2024, 1, 12), 30).select("kafka_offset")


def overwrite_table(spark, d):
    table, rows = Table(spark, work_dir(spark)), load(spark, d, "nation")
    table.overwrite(rows)
    table.overwrite(rows.filter("n_regionkey > 1"))
    return table.read()


def merge_landing(spark, d):
    """Two landings of which the second holds other values for the first's readings, and comes twice; each passes the gate, and its checks are kept once."""
    store, house = model_jobs.Store(spark, work_dir(spark)), jobs.Warehouse(Table(spark, work_dir(spark), ("report_date",)), None, None, None)
    rows = kept(spark, status(spark, d).dropDuplicates(["station_id", "last_reported"]))
    parts = (rows.filter("num_bikes_available < 50"), AS_OF), *[(rows.withColumn("num_bikes_available", F.col("num_bikes_available") + 1), AS_OF + timedelta(hours=1))] * 2
    landed = [model_jobs.quality_job(part, house, store, at) for part, at in parts]
    n = store.quality.read().count()
    return plain(house.status.read().select("station_id", "last_reported", "num_bikes_available", F.lit(n).cast("long").alias("n_checks"), F.lit(all(landed)).alias("all_merged")))


def table_columns(spark, d):
    return spark.createDataFrame(serving.describe({t: load(spark, d, t) for t in ("region", "orders")}), "name string, columns string")


def merge_insert_absent(spark, d):
    rows = status(spark, d).withColumn("report_date", F.to_date("last_reported")).select("station_id", "last_reported", "report_date", "num_bikes_available")
    table = Table(spark, work_dir(spark), ("report_date",))
    table.insert_absent(rows.filter("num_bikes_available % 3 <> 0"), ("report_date", "station_id", "last_reported"))
    table.insert_absent(rows.withColumn("num_bikes_available", F.col("num_bikes_available") + 1000), ("report_date", "station_id", "last_reported"))
    table.insert_absent(rows, ("report_date", "station_id", "last_reported"))
    return plain(table.read())


def upsert_scd1(spark, d):
    rows = load(spark, d, "customer").select(F.col("c_custkey").alias("station_id"), F.col("c_name").alias("station_name"), F.col("c_mktsegment").alias("commune"))
    table = Table(spark, work_dir(spark))
    feeds.upsert_stations(table, rows.filter("station_id % 3 <> 0"), date(2024, 1, 1))
    later = rows.filter("station_id % 2 = 0").select("station_id", F.concat("station_name", F.lit(" new")).alias("station_name"), F.when(F.col("station_id") % 4 == 0, F.lit("moved")).alias("commune"))
    for _ in range(2):
        table.upsert(later.withColumns({"first_seen": F.lit(date(2024, 2, 1)), "last_seen": F.lit(date(2024, 2, 1)), "updated_at": F.lit(AS_OF).cast("timestamp")}), ("station_id",), keep=("first_seen",), prefer_new=("commune",))
    return table.read().drop("updated_at")


def delete_insert(spark, d):
    rows = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    table = Table(spark, work_dir(spark), ("o_orderstatus",))
    table.delete_insert(rows, ("o_orderkey",))
    changed = rows.filter("o_orderkey % 5 = 0").withColumn("o_totalprice", F.lit(0.0))
    table.delete_insert(changed, ("o_orderkey",))
    table.delete_insert(changed, ("o_orderkey",))
    table.compact()
    return table.read()


def lookup_skipping(spark, d):
    """The last reading of the first station, in a table of four batches sorted by station and time."""
    rows = status(spark, d).dropDuplicates(["station_id", "last_reported"]).select("station_id", "last_reported", "num_bikes_available")
    table = Table(spark, work_dir(spark), sort_by=("station_id", "last_reported"), index=("station_id", "last_reported"))
    for k in range(4):
        table.append(rows.filter(F.dayofmonth("last_reported") % 4 == k).repartitionByRange(4, "station_id"))
    asked = rows.groupBy("station_id").agg(F.max("last_reported").alias("last_reported")).orderBy("station_id").first()
    told = table.lookup(station_id=asked["station_id"], last_reported=asked["last_reported"])
    return plain(told.withColumn("few_files", F.lit(len(table.files_for(asked.asDict())) <= 2)))


def quality_suite(spark, d):
    """Over messages as they are parsed: with missing ids and times, counts below 0, and late ones."""
    rows = refine.parse(refine.to_bronze(messages(spark, d)))
    late = F.timestamp_micros(F.unix_micros("kafka_timestamp") + F.col("kafka_offset") % 100 * 60_000_000)
    return quality.run_suite(quality.with_derived(rows.withColumn("ingested_at", late), AS_OF), quality.READINGS_SUITE)


def quarantine_replay(spark, d):
    """Rejected messages, stored on two days: the second time nothing comes to it but what is new."""
    rejected = refine.with_reason(refine.parse(refine.to_bronze(messages(spark, d))), NOW_EPOCH).filter("rejection_reason is not null")
    table = Table(spark, work_dir(spark), ("quarantine_date",))
    for part, at in (("kafka_offset % 3 <> 0", datetime(2024, 2, 1, 23, 59)), ("true", datetime(2024, 2, 2, 0, 10)), ("true", datetime(2024, 2, 9))):
        table.insert_absent(refine.to_quarantine(rejected.filter(part), at), ("kafka_partition", "kafka_offset"), not_before="kafka_timestamp")
    return table.read().select("kafka_partition", "kafka_offset", "rejection_reason", "quarantine_date")


def constraint_tests(spark, d):
    li, orders, customer = (load(spark, d, t) for t in ("lineitem", "orders", "customer"))
    tests = {
        "not_null": quality.not_null(orders, "o_orderdate"), "unique": quality.unique(li, "l_orderkey", "l_linenumber"), "accepted_values": quality.accepted_values(orders, "o_orderstatus", ("O", "F")),
        "accepted_range": quality.accepted_range(li, "l_quantity", 5, 45), "accepted_range_open": quality.accepted_range(li, "l_quantity", 5, 45, inclusive=False), "relationships": quality.relationships(events(spark, d), "station_id", load(spark, d, "supplier"), "s_suppkey"),
        "relationships_ok": quality.relationships(orders, "o_custkey", customer, "c_custkey"),
    }
    out = None
    for name, df in tests.items():
        one = df.agg(F.count("*").alias("n_broken")).withColumn("test", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def source_freshness(spark, d):
    return plain(quality.freshness(status(spark, d), "loaded_at", AS_OF, 30, 120)).withColumn("age_minutes", F.round("age_minutes", 6))


def alerts(spark, d):
    rows = events(spark, d).select(F.col("event_type").alias("alert_type"), (F.col("station_id") % 5).cast("string").alias("title"), F.col("ts").alias("created_at"))
    return plain(quality.alerts_to_send(rows, 720))


def nearest_stations(spark, d):
    return serving.nearest(gold.current_state(facts(spark, d), dims(spark, d), AS_OF), 48.05, 2.3, 5, "velo")


def guarded_sql(spark, d):
    reader = serving.Reader(spark, {"etat_actuel_stations": lambda s: gold.current_state(facts(s, d), dims(s, d), AS_OF)}, timeout_s=600)
    told = reader.run("SELECT statut, count(*) AS n, sum(velos_disponibles) AS velos FROM etat_actuel_stations GROUP BY statut ORDER BY statut -- by status\n;")
    return spark.createDataFrame([tuple(r) for r in told["rows"]], "statut string, n long, velos long")


def parse_stations(spark, d):
    rows = load(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "c_name")).alias("name"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("lat"))
    return feeds.parse_stations(rows.select(F.col("c_custkey").alias("station_id"), F.lit("x").alias("stationCode"), "name", "lat", F.lit(2.0).alias("lon"), F.lit(30).alias("capacity")))


def _seen(spark, d):
    return events(spark, d).select("station_id", F.col("k").cast("long").alias("last_reported"), F.unix_micros("ts").alias("seq"), F.col("event_type").alias("value"))


def changed_batch(spark, d):
    return ingest.changed(_seen(spark, d))


def _stream_files(spark, df: DataFrame) -> str:
    path = work_dir(spark)
    df.write.parquet(path)
    return path


def stream_bronze(spark, d):
    where, out = _stream_files(spark, messages(spark, d)), work_dir(spark)
    q = ingest.write_bronze(ingest.source(spark, "files", where), f"{out}/bronze", f"{out}/checkpoint", {"availableNow": True}, name=f"bronze_{abs(hash(out))}")
    q.awaitTermination()
    return plain(spark.read.parquet(f"{out}/bronze").drop("ingested_at", "ingest_date"))


def stream_cdc(spark, d):
    rows = _seen(spark, d)
    where, out = _stream_files(spark, rows), work_dir(spark)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = ingest.changed_stream(spark.readStream.schema(rows.schema).parquet(where)).writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start(f"{out}/changes")
        q.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema("station_id bigint, last_reported bigint, seq bigint, value string").parquet(f"{out}/changes")


#: Messages that a batch of the topic, or a file of the gauges, has at most, about.
BATCH_ROWS, FILE_ROWS = 1_000_000, 250_000


def _topic(spark, d) -> str:
    """Messages by time in two halves, each in batches of BATCH_ROWS, in four partitions of which the last gets none."""
    rows = messages(spark, d)
    half = datetime(2024, 1, 16)
    where, out = work_dir(spark), work_dir(spark)
    time = F.unix_micros("timestamp")
    first, last, n = rows.agg(F.min(time), F.max(time), F.count("*")).first()
    middle = int(half.replace(tzinfo=timezone.utc).timestamp()) * 1_000_000
    batches = max(1, -(-n // (2 * BATCH_ROWS)))
    starts = lambda a, b: [a + (b - a) * k // batches for k in range(batches)]
    cuts = sorted({*starts(min(first, middle), middle)[1:], *starts(middle, max(last, middle))}) if n else [middle]
    for k, (low, high) in enumerate(zip([None, *cuts], [*cuts, None])):
        part = (F.lit(True) if low is None else time >= low) & (F.lit(True) if high is None else time < high)
        rows.filter(part).repartition(3, "partition").sortWithinPartitions("timestamp", "offset").write.parquet(f"{where}/{k}")
        stream = spark.readStream.schema(MESSAGE).option("recursiveFileLookup", True).parquet(where)
        topic.produce(stream.select("key", "value", "timestamp", "partition"), f"{out}/station_status", f"{out}/checkpoint", 4, "producer", {"availableNow": True}).awaitTermination()
    return f"{out}/station_status"


def topic_newest(spark, d):
    """S12 on a topic that K1 wrote."""
    return plain(topic.newest(spark, _topic(spark, d), 4))


def topic_messages(spark, d):
    """All of the topic's messages, and their offsets: each partition's are the numbers from 0 on, in the order of time."""
    rows = topic.messages(spark, _topic(spark, d), 4).withColumn("raw", F.col("value").cast("string"))
    rows = rows.withColumn("minute", F.date_trunc("minute", "timestamp"))
    counts = rows.groupBy(F.col("partition").alias("p"), F.col("minute").alias("m")).agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("p").orderBy("m")) - F.col("n")).drop("n")  # a row for each minute
    placed = rows.join(before, (F.col("partition") == F.col("p")) & F.col("minute").eqNullSafe(F.col("m")))
    by_time = F.col("before") + F.row_number().over(Window.partitionBy("partition", "minute").orderBy("timestamp", "offset")) - 1
    told = placed.withColumn("in_order", by_time == F.col("offset"))
    return plain(told.select(F.col("key").cast("string").alias("key"), "raw", "partition", "timestamp", "topic", "in_order"))


def feed_log(spark, d):
    """A document for each day, polled by a query that is stopped in the middle and started again."""
    rows = events(spark, d).withColumn("n", F.datediff("ts", F.lit("2024-01-01")))
    station = F.struct("station_id", F.col("k").alias("num_bikes_available"))
    documents = rows.groupBy("n").agg(F.to_json(F.struct(F.lit(5).alias("last_updated"), F.struct(F.collect_list(station).alias("stations")).alias("data"))).alias("value"))
    docs, out = work_dir(spark), work_dir(spark)
    documents.repartitionByRange("n").write.partitionBy("n").text(docs)
    spark.dataSource.register(feeds.LoggedFeed)
    for polls in (4, 1000):
        feed = spark.readStream.format("station_status_log").options(url=f"{docs}/n={{poll}}", log=f"{out}/log", polls=str(polls)).load()
        query = feed.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").start(f"{out}/rows")
        query.processAllAvailable()
        query.stop()
    told = spark.read.schema("key string, value string, polled bigint").parquet(f"{out}/rows")
    return told.select("key", "polled", F.from_json("value", "station STRUCT<num_bikes_available: INT>").getField("station").getField("num_bikes_available").alias("bikes"))


def jdbc_round_trip(spark, d):
    """Stations go to a database and come back by ranges, and their ids say which events are known. The database lies in this JVM."""
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("the embedded database serves one JVM only")
    url, properties = jdbc.embedded()
    rows = load(spark, d, "customer").select(F.col("c_custkey").alias("station_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    for part in ("station_id % 3 = 0", "station_id % 3 = 1"):
        jdbc.append(rows.filter(part), url, "stations", properties, parts=4, types="name VARCHAR(100), segment VARCHAR(100)")
    known = jdbc.known_stations(spark, url, "stations", properties)
    told = jdbc.scan(spark, url, 'SELECT * FROM stations WHERE "segment" <> \'BUILDING\'', "station_id", 6, properties)
    flagged = refine.with_known_flag(events(spark, d).select("event_id", "station_id"), known)
    return flagged.join(told, "station_id", "left").select("event_id", "is_known_station", "name", "segment")


def stream_unique(spark, d):
    """T3 in a stream of daily files: readings come again ten minutes later (once), three days later with a new time (twice), or with the old one (too late)."""
    rows = events(spark, d).select("station_id", F.col("ts").alias("last_reported"), F.col("ts").alias("kafka_timestamp"), "k")
    later = lambda when, **by: rows.filter(when).withColumn("kafka_timestamp", F.col("kafka_timestamp") + F.make_dt_interval(**by))
    day = F.to_date("kafka_timestamp")
    sent = rows.withColumn("day", day).unionByName(later("k % 2 = 0", mins=F.lit(10)).withColumn("day", day)).unionByName(later("k % 5 = 0", days=F.lit(3)).withColumn("day", day))
    sent = sent.unionByName(rows.filter("k % 7 = 0").withColumn("day", F.date_add(day, 3)))
    sent, where, out = kept(spark, sent), work_dir(spark), work_dir(spark)
    days = [r[0] for r in sent.select("day").distinct().orderBy("day").collect()]  # a row for each day
    for one in days:
        sent.filter(F.col("day") == F.lit(one)).drop("day").coalesce(1).write.parquet(f"{where}/{one}")
    stream = spark.readStream.schema("station_id bigint, last_reported timestamp, kafka_timestamp timestamp, k int").options(recursiveFileLookup=True, maxFilesPerTrigger=1).parquet(where)
    unique = ingest.unique_readings(stream).select("station_id", "last_reported")
    unique.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    return plain(spark.read.schema("station_id bigint, last_reported timestamp").parquet(f"{out}/rows"))


def stream_gauges(spark, d):
    """T4: figures of a query over four quarters, one a batch, each a file or some of FILE_ROWS."""
    rows, where, out = messages(spark, d), work_dir(spark), work_dir(spark)
    files = max(1, -(-load(spark, d, "events").count() // (4 * FILE_ROWS)))
    for k in range(4):
        quarter = rows.filter(F.col("offset") % 4 == k)
        (quarter.coalesce(1) if files == 1 else quarter.repartition(files)).write.mode("append").parquet(where)
    gauges, name = ingest.Gauges(), f"gauges_{abs(hash(out))}"
    spark.streams.addListener(gauges)
    try:
        ingest.write_bronze(ingest.source(spark, "files", where, per_trigger=files), f"{out}/bronze", f"{out}/checkpoint", {"availableNow": True}, name=name).awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    finally:
        spark.streams.removeListener(gauges)
    last = gauges.of[name]
    told = (gauges.rows[name], gauges.batches[name], last["behind"], last["batch_ms"] >= 0 and last["out_per_s"] >= 0)
    return spark.createDataFrame([told], "n_rows long, n_batches int, n_behind int, has_rates boolean")


def _commune(lat: float, lon: float) -> tuple[str | None, str | None]:
    n = round((lat - 48) * 1000)
    return (None, None) if n % 10 == 0 else (f"Commune {n % 90}", str(92000 + n % 90))


def geocode_places(spark, d):
    """Each place once, and the second time none."""
    answers, rows = Table(spark, work_dir(spark)), stations(spark, d).select("station_id", "lat", "lon").filter("station_id % 11 <> 0")
    feeds.geocode_pooled(rows.filter("station_id % 2 = 0"), answers, _commune)
    told = feeds.geocode_pooled(rows, answers, _commune)
    return told.select("station_id", "commune", "code_insee", F.lit(answers.read().count()).cast("long").alias("n_asked"))


def station_reference(spark, d):
    """Two days' documents of stations: some come on the second day only, some are moved then, some have no name or place."""
    k = F.col("c_custkey")
    table, answers, docs = Table(spark, work_dir(spark)), Table(spark, work_dir(spark)), work_dir(spark)
    for day, here, moved in ((1, k % 3 != 0, F.lit(0)), (2, k % 4 != 1, F.when(k % 8 == 0, 7).otherwise(0))):
        name = F.when(k % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), "c_name"))
        lat = F.when(k % 7 != 0, 48.0 + (k % 1000 + moved) / 1000.0)
        one = F.struct(k.alias("station_id"), k.cast("string").alias("stationCode"), name.alias("name"), lat.alias("lat"), F.lit(2.0).alias("lon"), (F.lit(30) + day).alias("capacity"))
        load(spark, d, "customer").filter(here).agg(F.to_json(F.struct(F.struct(F.collect_list(one).alias("stations")).alias("data"))).alias("value")).write.text(f"{docs}/{day}")
        for _ in range(day):
            jobs.station_reference(spark, f"{docs}/{day}", table, answers, _commune, date(2024, 1, day))
    return table.read().select("station_id", "station_name", "capacity", "commune", "code_insee", "first_seen", "last_seen")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__.removesuffix("_query"): f
    for f in (
        critical_stations, rank_empty_full, bronze_projection, parse_json, reject_reason, reject_counts, known_flag_join, silver, dedup_latest, map_array_sum, dim_hour_query, dim_date_query, dim_station_zone, holiday_left_join,
        fact_availability, reading_intervals, latest_state, state_classification, hourly_forward_fill, hourly_fill_by_grid, hourly_grid, hourly_incremental, zone_hourly, hourly_profile, time_shift_lags, feature_matrix, temporal_split,
        decile_edges, bin_shares, psi, drift_features, prediction_vs_actual, baseline_metrics, forecast_latest, forecast_search, stored_predictions, stored_bins, stored_drift, window_lookback, overwrite_table, merge_landing, table_columns, merge_insert_absent, upsert_scd1, delete_insert, lookup_skipping, quality_suite, quarantine_replay, constraint_tests, source_freshness, alerts, nearest_stations,
        guarded_sql, parse_stations, changed_batch, stream_bronze, stream_cdc, topic_newest, topic_messages, feed_log, jdbc_round_trip, stream_unique, stream_gauges, geocode_places, station_reference,
    )
}
