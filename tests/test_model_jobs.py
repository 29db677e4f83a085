"""The forecast job from hours to stored predictions, and the drift job on its bins."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidegrid.plans import demo, model_jobs

DATA = "/root/testdata/sf0.001"


def test_from_hours_to_stored_results(spark, tmp_path):
    hours, stations = demo.kept(spark, demo.hours(spark, DATA)), demo.kept(spark, demo.dims(spark, DATA))
    store = model_jobs.Store(spark, f"file://{tmp_path}")
    assert model_jobs.predict_run(hours, stations, store, demo.AS_OF) is None and model_jobs.drift_job(hours, stations, store, demo.AS_OF) is None
    assert model_jobs.train_run(hours.limit(0), stations, store, demo.AS_OF) is None
    first = model_jobs.train_run(hours, stations, store, demo.AS_OF, version="1", grid=((3, 4, 1.0),))
    assert first.promoted and store.champion_of("availability") == "1"
    second = model_jobs.train_run(hours, stations, store, demo.AS_OF, version="2", grid=((3, 4, 1.0),))
    assert second.promoted and store.champion_of("availability") == "2"  # as good: ties go to the new one
    third = model_jobs.train_run(hours, stations, store, demo.AS_OF, version="3", grid=((1, 1, 0.01),))
    runs = {r["model_version"]: r for r in store.runs.read().collect()}
    assert runs["3"]["promoted"] == third.promoted == (runs["3"]["test_mae"] <= runs["2"]["test_mae"]) and runs["2"]["champion_mae"] == runs["1"]["test_mae"]
    assert {(r["model_version"], r["n"]) for r in store.bins.read().groupBy("model_version").agg(F.count("*").alias("n")).collect()} == {(v, 5) for v in "123"}
    for _ in range(2):
        told = model_jobs.predict_run(hours, stations, store, demo.AS_OF)
        rows = store.predictions.read()
        assert told["rows"] == rows.count() > 0 and rows.filter("predicted_bikes < 0 or predicted_bikes > 99").isEmpty()
        assert abs(rows.agg(F.avg("predicted_bikes")).first()[0] - told["mean_prediction"]) < 1e-9
    for k, at in enumerate((demo.AS_OF - timedelta(days=2), demo.AS_OF)):
        told = model_jobs.drift_job(hours, stations, store, at)
        assert store.drift.read().count() == 5 * (k + 1) and told["max_psi"] >= 0
    assert model_jobs.drift_job(hours, stations, store, datetime(2030, 1, 1))["max_psi"] is None  # no values, no score
