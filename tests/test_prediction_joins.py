from tidegrid.plans import gold


def test_newest_predictions_are_dealt_by_hour_once(spark):
    """One exchange for predictions, hours and stations each, and one of the joined rows by station."""
    told = spark.createDataFrame([], "station_id long, target_time timestamp, feature_time timestamp, predicted_bikes double, model_version string, predicted_at timestamp")
    stations = spark.createDataFrame([], "station_id long, nom_station string, zone string")
    hours = spark.createDataFrame([], "station_id long, heure_fin timestamp, velos_disponibles int")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.optimizer.excludedRules") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        as_rdd = [spark.createDataFrame(df.rdd, df.schema) for df in (told, stations, hours)]  # not known to be empty
        plan = gold.predictions_vs_actual(as_rdd[0], as_rdd[1], as_rdd[2])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for k, v in old.items():
            spark.conf.set(k, v)
    assert plan.count("Exchange hashpartitioning") == 4
