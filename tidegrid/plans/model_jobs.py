"""Forecast and drift jobs from hours to stored results."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import holidays
from ..operators.tables import Table
from ..session import kept
from . import boosting, features, forecast, jobs

RUNS = "model_name string, model_version string, trained_at timestamp, depth int, rounds int, rate double, params string, test_mae double, test_rmse double, baseline_mae double, gain_pct double, champion_mae double, promoted boolean"
#: Days of history that a model learns from.
HISTORY_DAYS = 60


class Store:
    """Tables below one shared folder: runs, champion, bins (by model and version), predictions, drift and quality (by day); and the models."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.runs, self.champion = Table(spark, f"{path}/runs"), Table(spark, f"{path}/champion")
        self.bins = Table(spark, f"{path}/bins", ("model_name", "model_version"))
        self.predictions = Table(spark, f"{path}/predictions", ("target_date",))
        self.drift, self.quality = Table(spark, f"{path}/drift", ("computed_date",)), Table(spark, f"{path}/quality", ("checked_date",))

    def champion_of(self, name: str) -> str | None:
        """M8: the version that holds the alias."""
        rows = self.champion.read()
        told = None if rows is None else rows.filter(F.col("model_name") == name).first()
        return told and told["model_version"]

    def model_path(self, name: str, version: str) -> str:
        return f"{self.path}/models/{name}/{version}"

    def save_model(self, model, name: str, version: str) -> None:
        path = self.model_path(name, version)
        boosting.save(self.spark, model, f"{path}.json") if isinstance(model, boosting.Forest) else model.write().overwrite().save(path)

    def model(self, name: str, version: str):
        from pyspark.ml import PipelineModel

        path = self.model_path(name, version)
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}.json")
        boosted = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)
        return boosting.load(self.spark, f"{path}.json") if boosted else PipelineModel.load(path)


def rows_of(hours: DataFrame, stations: DataFrame, as_of: datetime, with_target: bool, days: float = HISTORY_DAYS) -> DataFrame:
    told = features.load_hourly(hours, stations, as_of - timedelta(days=days), as_of)
    return features.build(told, holidays(hours.sparkSession), with_target)


@dataclass
class TrainRun:
    version: str
    promoted: bool
    gain_pct: float


def store_bins(store: Store, learn: DataFrame, name: str, version: str) -> None:
    """Edges and shares of the monitored features, in place of those of the same version."""
    values = kept(store.spark, features.counted(features.long_form(learn)))
    told = features.shares(values, features.edges(values))
    store.bins.overwrite_partitions(told.select("feature", "bin_edges", "bin_shares", F.lit(name).alias("model_name"), F.lit(version).alias("model_version")))


def train_run(hours: DataFrame, stations: DataFrame, store: Store, as_of: datetime, name: str = "availability", version: str = "1", grid=None, trials: int = boosting.TRIALS) -> TrainRun | None:
    """M7, M8: search and fit, hold the new model against the champion on the same test part, store model, run and bins.

    Ties go to the new model, which then is the champion. None if there are too few hours. Without a grid (depth, rounds
    and rate of `forecast.train`) the parameters are searched by `boosting.train`.
    """
    data = rows_of(hours, stations, as_of, True).persist()
    try:
        trained = forecast.train(data, grid) if grid else boosting.train(data, trials)
        if trained is None:
            return None
        rows = data.dropna(subset=[features.TARGET, "velos_t0"])
        learn, test = features.temporal_split(rows)
        old = store.champion_of(name)
        champion = None
        if old is not None:
            told = forecast.applied(store.model(name, old), test).withColumn("prediction", F.greatest("prediction", F.lit(0.0)))
            champion = forecast.metrics(told, features.TARGET, "prediction").first()["mae"]
        promoted = forecast.promote(trained.test_mae, champion)
        store.save_model(trained.model, name, version)
        store_bins(store, learn, name, version)
        depth, rounds, rate = trained.point if grid else (None, trained.point["rounds"], trained.point["learning_rate"])
        row = (name, version, as_of, depth, rounds, float(rate), None if grid else json.dumps(trained.point), trained.test_mae, trained.test_rmse, trained.baseline_mae, float(trained.gain_pct), champion, promoted)
        store.runs.append(store.spark.createDataFrame([row], RUNS))
        if promoted:
            store.champion.upsert(store.spark.createDataFrame([(name, version)], "model_name string, model_version string"), ("model_name",))
        return TrainRun(version, promoted, trained.gain_pct)
    finally:
        data.unpersist()


def store_predictions(store: Store, told: DataFrame) -> dict[str, float | int]:
    """Predictions by station, target hour, model and version in place of older ones; how many, and their mean. Versions stay beside each other, to be compared."""
    store.predictions.upsert(told.withColumn("target_date", F.to_date("target_time")), ("station_id", "target_time", "model_name", "model_version"))
    one = told.agg(F.count("*").alias("n"), F.avg("predicted_bikes").alias("mean")).first()
    return {"rows": one["n"], "mean_prediction": one["mean"]}


def predict_run(hours: DataFrame, stations: DataFrame, store: Store, at: datetime, name: str = "availability", model=None, version: str | None = None) -> dict[str, float | int] | None:
    """M9: predictions of the champion (or of a given model) for the newest hour. None without a champion."""
    version = version or store.champion_of(name)
    if version is None:
        return None
    data = rows_of(hours, stations, at, False, days=8)  # the longest lag is a week
    return store_predictions(store, forecast.predict(model or store.model(name, version), data, name, version, at))


def drift_job(hours: DataFrame, stations: DataFrame, store: Store, at: datetime, name: str = "availability", version: str | None = None, hours_back: int = 24, threshold: float = 0.2) -> dict[str, object] | None:
    """Drift of the last hours against the stored bins, a run's rows in place of those of the same model, version and time; that run's largest score and the features that drift. None without bins."""
    version, bins = version or store.champion_of(name), store.bins.read()
    if version is None or bins is None:
        return None
    own = bins.filter((F.col("model_name") == name) & (F.col("model_version") == version)).select("feature", "bin_edges", "bin_shares")
    told = jobs.drift_run(hours, stations, own, at, hours_back, threshold)
    when = F.lit(at).cast("timestamp")
    told = told.withColumns({"model_name": F.lit(name), "model_version": F.lit(version), "computed_at": when, "computed_date": F.to_date(when)})
    store.drift.upsert(told, ("model_name", "model_version", "computed_at", "feature"))
    now = store.drift.read().filter((F.col("computed_date") == F.to_date(when)) & (F.col("computed_at") == when) & (F.col("model_name") == name) & (F.col("model_version") == version))
    one = now.agg(F.max("psi").alias("most"), F.sort_array(F.collect_set(F.when(F.col("is_drift"), F.col("feature")))).alias("which")).first()  # one row a monitored feature
    return {"max_psi": one["most"], "drifting": one["which"]}


def quality_job(landing: DataFrame, warehouse: jobs.Warehouse, store: Store, now: datetime) -> bool:
    """Q-6, K14, K7: run the suite, store its results (a run again at the same time stores them once), merge if no critical check fails; says whether it merged."""
    results, ok = jobs.merge_landing(landing, warehouse, now)
    when = F.lit(now).cast("timestamp")
    numbered = results.withColumns({"n": F.row_number().over(Window.partitionBy("expectation", "column_name").orderBy("severity", "element_count")), "checked_at": when, "checked_date": F.to_date(when)})  # a dozen checks
    store.quality.upsert(numbered, ("checked_at", "expectation", "column_name", "n"))
    return ok
