"""The star schema and its aggregates as functions of DataFrames and an explicit time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import TIMEZONE, date_key
from ..functions.numbers import MICROS_PER_MINUTE, exact_mean, exact_ratio, micros_between, minutes_between
from ..operators.asof import by_intervals, one_hour

MAX_GAP_MINUTES = 120
LOOKBACK_HOURS = 3


def _at(t: datetime) -> Column:
    return F.lit(t).cast("timestamp")


def _local(t: str | Column, tz: str) -> Column:
    return F.from_utc_timestamp(t, tz)


def stg_status(status: DataFrame, tz: str = TIMEZONE) -> DataFrame:
    """P6."""
    names = {"num_bikes_available": "velos_disponibles", "num_mechanical": "velos_mecaniques", "num_ebike": "velos_electriques", "num_docks_available": "bornes_libres", "is_installed": "est_installee", "is_renting": "location_active", "is_returning": "retour_actif"}
    return status.select("station_id", "station_code", F.col("last_reported").alias("releve_at"), _local("last_reported", tz).cast("timestamp_ntz").alias("releve_local"), *[F.col(a).alias(b) for a, b in names.items()], "ingested_at", "loaded_at")


def stg_stations(stations: DataFrame) -> DataFrame:
    """Readable zones from INSEE codes."""
    code, paris = F.col("code_insee"), F.coalesce(F.col("code_insee").startswith("751"), F.lit(False))
    district = F.when(paris, F.try_to_number(F.substring(code, 4, 2), F.lit("99")).cast("int"))
    other = F.coalesce("commune", F.lit("Inconnue"))
    return stations.select(
        "station_id", "station_code", F.col("station_name").alias("nom_station"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("capacity").alias("capacite"), "code_insee",
        F.when(paris, F.lit("Paris")).otherwise(other).alias("commune"), district.alias("arrondissement"),
        F.when(code == "75101", F.lit("Paris 1er")).when(paris, F.concat(F.lit("Paris "), district.cast("string"), F.lit("e"))).otherwise(other).alias("zone"),
        F.left(code, F.lit(2)).alias("departement"), paris.alias("est_paris"), F.col("first_seen").alias("premiere_apparition"), F.col("last_seen").alias("derniere_apparition"),
    )


def dim_station(staged: DataFrame) -> DataFrame:
    """P9."""
    return staged.drop("code_insee")


def fact(readings: DataFrame, stations: DataFrame, since: Column | None = None) -> DataFrame:
    """A row for each reading of a known station; `since` keeps readings loaded after it."""
    rows = readings if since is None else readings.filter(F.col("loaded_at") > since)
    bikes, docks = F.col("velos_disponibles"), F.col("bornes_libres")
    whole = bikes + docks
    return rows.join(stations.select("station_id").distinct(), "station_id", "left_semi").select(
        "station_id", "releve_at", date_key(F.col("releve_local")).alias("date_id"), F.hour("releve_local").alias("heure"), "velos_disponibles", "velos_mecaniques", "velos_electriques", "bornes_libres",
        whole.alias("capacite_effective"), F.when(whole > 0, exact_ratio(bikes, whole, 4)).alias("taux_remplissage"), (bikes == 0).alias("est_vide"), (docks == 0).alias("est_pleine"),
        "est_installee", "location_active", "retour_actif", "ingested_at", "loaded_at",
    )


def intervals(facts: DataFrame, as_of: datetime, max_gap_minutes: int = MAX_GAP_MINUTES) -> DataFrame:
    """How long each reading holds, in whole microseconds and minutes, cut at max_gap_minutes; the last one until as_of."""
    following = F.lead("releve_at", 1).over(Window.partitionBy("station_id").orderBy("releve_at"))
    micros = F.least(micros_between(F.col("releve_at"), F.coalesce(following, _at(as_of))), F.lit(max_gap_minutes * MICROS_PER_MINUTE).cast("long"))
    return facts.select("station_id", "releve_at", "date_id", "heure", "est_vide", "est_pleine", micros.alias("duree_us"), (micros / float(MICROS_PER_MINUTE)).alias("duree_minutes"))


def critical_stations(spans: DataFrame, stations: DataFrame, as_of: datetime) -> DataFrame:
    """Time spent empty and full, whole period and last 7 days, with ranks over all stations."""
    recent = F.col("releve_at") >= _at(as_of) - F.expr("interval 7 days")
    total = lambda p: F.sum(F.when(p, F.col("duree_us")))
    sums = spans.groupBy("station_id").agg(
        F.sum("duree_us").alias("seen"), total(F.col("est_vide")).alias("empty"), total(F.col("est_pleine")).alias("full"),
        total(recent).alias("seen_7"), total(recent & F.col("est_vide")).alias("empty_7"), total(recent & F.col("est_pleine")).alias("full_7"),
    )
    hours = lambda c: exact_ratio(F.coalesce(c, F.lit(0)), F.lit(60 * MICROS_PER_MINUTE), 1)
    share = lambda a, b: exact_ratio(F.coalesce(a, F.lit(0)), b, 4)
    told = sums.select(
        "station_id", hours(F.col("seen")).alias("heures_observees"), hours(F.col("empty")).alias("heures_vide"), hours(F.col("full")).alias("heures_pleine"),
        share(F.col("empty"), F.col("seen")).alias("part_temps_vide"), share(F.col("full"), F.col("seen")).alias("part_temps_pleine"),
        share(F.col("empty_7"), F.col("seen_7")).alias("part_temps_vide_7j"), share(F.col("full_7"), F.col("seen_7")).alias("part_temps_pleine_7j"),
    )
    rank = lambda c: F.rank().over(Window.orderBy(F.col(c).desc_nulls_last()))  # noqa: E731  one row a station
    both = told.join(stations.select("station_id", "nom_station", "zone", "commune", "capacite"), "station_id")
    return both.withColumns({"rang_vide": rank("part_temps_vide"), "rang_pleine": rank("part_temps_pleine")})


def grid_bounds(facts: DataFrame, existing: DataFrame | None = None, lookback_hours: int = LOOKBACK_HOURS) -> DataFrame:
    """h0 and h1 of the hours to compute; from `lookback_hours` before the newest hour that exists, else from the first ingestion."""
    edges = facts.agg(F.date_trunc("hour", F.min("ingested_at")).alias("h0"), F.date_trunc("hour", F.max("releve_at")).alias("h1"))
    if existing is None:
        return edges
    newest = existing.agg((F.max("heure_debut") - F.make_dt_interval(hours=F.lit(lookback_hours))).alias("again"))
    return edges.crossJoin(newest).select(F.coalesce("again", "h0").alias("h0"), "h1")


def hourly(facts: DataFrame, stations: DataFrame, existing: DataFrame | None = None, tz: str = TIMEZONE, lookback_hours: int = LOOKBACK_HOURS) -> DataFrame:
    """M1: a row for each station and hour with its last reading before the hour's end."""
    state = facts.join(stations.select("station_id").distinct(), "station_id", "left_semi").select("station_id", "releve_at", "velos_disponibles", "velos_mecaniques", "velos_electriques", "bornes_libres", "capacite_effective", "taux_remplissage")
    bounds = F.broadcast(grid_bounds(facts, existing, lookback_hours))  # one row
    filled = by_intervals(state.crossJoin(bounds), "station_id", "releve_at", F.col("h0"), F.col("h1"))
    end, local = F.col("heure_debut") + one_hour(), _local("heure_debut", tz)
    return filled.select(
        "station_id", "heure_debut", end.alias("heure_fin"), date_key(local).alias("date_id"), F.hour(local).alias("heure_locale"), "velos_disponibles", "velos_mecaniques", "velos_electriques", "bornes_libres", "capacite_effective", "taux_remplissage",
        F.col("releve_at").alias("dernier_releve_at"), minutes_between(F.col("releve_at"), end, 1).alias("minutes_depuis_releve"),
    )


def latest_state(facts: DataFrame) -> DataFrame:
    """The last reading of each station, without a sort."""
    return facts.groupBy("station_id").agg(F.max_by(F.struct(*[c for c in facts.columns if c != "station_id"]), "releve_at").alias("r")).select("station_id", "r.*")


def current_state(facts: DataFrame, stations: DataFrame, as_of: datetime) -> DataFrame:
    """P10: the last reading with a status; the first that holds of out of service, empty, full, nearly empty, nearly full, available."""
    rate = F.col("taux_remplissage")
    status = F.when(~F.col("est_installee") | ~F.col("location_active"), "hors service").when(F.col("est_vide"), "vide").when(F.col("est_pleine"), "pleine").when(rate < 0.2, "presque vide").when(rate > 0.8, "presque pleine").otherwise("disponible")
    return latest_state(facts).join(stations, "station_id").select(
        "station_id", "nom_station", "zone", "commune", "arrondissement", "est_paris", "latitude", "longitude", "capacite", F.col("releve_at").alias("dernier_releve_at"), minutes_between(F.col("releve_at"), _at(as_of), 1).alias("minutes_depuis_releve"),
        "velos_disponibles", "velos_mecaniques", "velos_electriques", "bornes_libres", "taux_remplissage", status.alias("statut"),
    )


def hourly_profile(hours: DataFrame, dates: DataFrame, stations: DataFrame) -> DataFrame:
    """A6, J3."""
    rows = hours.join(dates.select("date_id", "type_jour"), "date_id").join(stations.select("station_id", "nom_station", "zone"), "station_id")
    means = {f"{c}_moyen": exact_mean(F.col(c), 4 if c == "taux_remplissage" else 2) for c in ("taux_remplissage", "velos_disponibles", "velos_mecaniques", "velos_electriques")}
    return rows.groupBy("station_id", "nom_station", "zone", "type_jour", F.col("heure_locale").alias("heure")).agg(*[v.alias(k) for k, v in means.items()], F.count("*").alias("nb_heures_observees"))


def zone_hourly(hours: DataFrame, stations: DataFrame) -> DataFrame:
    """A5."""
    rows = hours.join(stations.select("station_id", "zone", "commune", "est_paris"), "station_id")
    sums = [F.sum(c).alias(c) for c in ("velos_disponibles", "velos_mecaniques", "velos_electriques", "bornes_libres")]
    return rows.groupBy("heure_debut", "date_id", F.col("heure_locale").alias("heure"), "zone", "commune", "est_paris").agg(
        F.count("*").alias("nb_stations"), *sums, exact_mean(F.col("taux_remplissage"), 4).alias("taux_remplissage_moyen"), F.count_if(F.col("velos_disponibles") == 0).alias("nb_stations_vides"), F.count_if(F.col("bornes_libres") == 0).alias("nb_stations_pleines")
    )


def predictions_vs_actual(predictions: DataFrame, stations: DataFrame, hours: DataFrame) -> DataFrame:
    """The newest prediction for each station and hour beside what came."""
    newest = predictions.groupBy("station_id", "target_time").agg(F.max_by(F.struct("feature_time", "predicted_bikes", "model_version"), "predicted_at").alias("p")).select("station_id", "target_time", "p.*")
    real = hours.select("station_id", F.col("heure_fin").alias("target_time"), F.col("velos_disponibles").alias("velos_reels"))
    rows = newest.join(real, ["station_id", "target_time"], "left").join(stations.select("station_id", "nom_station", "zone"), "station_id")  # in this order the newest are dealt by their hours once
    two = lambda c: F.round(c.cast("decimal(20,6)"), 2)
    return rows.select("station_id", "nom_station", "zone", F.col("target_time").alias("heure_cible"), F.col("feature_time").alias("heure_donnees"), F.col("model_version").alias("version_modele"), two(F.col("predicted_bikes")).alias("velos_predits"), "velos_reels", two(F.abs(F.col("predicted_bikes") - F.col("velos_reels"))).alias("erreur_absolue"), F.col("velos_reels").isNotNull().alias("est_evaluee"))
