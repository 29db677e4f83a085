"""The steps of the pipeline as functions with explicit dependencies (K10, K11, K18, Q-15)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import dim_date, dim_hour, holidays
from ..operators import quality
from ..sources import feeds
from . import features, gold

#: Result of a step that had nothing to do.
SKIPPED = "skipped"


@dataclass
class Warehouse:
    """Tables (operators.tables) of the layers; `status` may be partitioned by report_date, so that a landing meets its own days only."""

    status: object
    stations: object
    facts: object
    hours: object


def merge_landing(landing: DataFrame, warehouse: Warehouse, now: datetime, loaded_at: datetime | None = None) -> tuple[DataFrame, bool]:
    """Gate and K7: run the suite; unless a critical check fails, insert readings that the warehouse lacks. Returns results and whether it merged."""
    told = quality.run_suite(quality.with_derived(landing, now), quality.READINGS_SUITE)
    results = landing.sparkSession.createDataFrame(told.collect(), told.schema)  # a row a check: else each use would read the landing again
    ok = quality.passes(results)
    if ok:
        dated = landing.withColumns({"loaded_at": F.lit(loaded_at or now).cast("timestamp"), "report_date": F.to_date("last_reported")})
        warehouse.status.insert_absent(dated, ("report_date", "station_id", "last_reported"))
    return results, ok


def build_gold(spark: SparkSession, warehouse: Warehouse, as_of: datetime, full: bool = False) -> dict[str, DataFrame]:
    """All models in order; facts and hours grow by increments (K12, P13, M2), the rest is made anew. Views of all are registered."""
    staged = gold.stg_status(warehouse.status.read())
    stations = gold.dim_station(gold.stg_stations(warehouse.stations.read()))
    old = None if full else warehouse.facts.read()
    since = None if old is None else F.lit(old.agg(F.max("loaded_at")).first()[0])
    new = gold.fact(staged, stations, since)
    warehouse.facts.overwrite(new) if old is None else warehouse.facts.delete_insert(new, ("station_id", "releve_at"))
    facts = warehouse.facts.read()
    have = None if full else warehouse.hours.read()
    grid = gold.hourly(facts, stations, have)
    warehouse.hours.overwrite(grid) if have is None else warehouse.hours.delete_insert(grid, ("station_id", "heure_debut"))
    hours = warehouse.hours.read()
    first = staged.agg(F.min(F.to_date("releve_local"))).first()[0]
    first = min(date(2025, 1, 1), first or date(2025, 1, 1))
    dates = dim_date(spark, first, (as_of + timedelta(days=365)).date(), holidays(spark))
    models = {
        "dim_station": stations, "dim_date": dates, "dim_heure": dim_hour(spark), "fact_disponibilite": facts, "fct_station_horaire": hours,
        "int_releves_intervalles": gold.intervals(facts, as_of), "etat_actuel_stations": gold.current_state(facts, stations, as_of),
        "agg_remplissage_horaire": gold.hourly_profile(hours, dates, stations), "agg_disponibilite_zone_horaire": gold.zone_hourly(hours, stations),
    }
    models["agg_stations_critiques"] = gold.critical_stations(models["int_releves_intervalles"], stations, as_of)
    for name, df in models.items():
        df.createOrReplaceTempView(name)
    return models


def station_reference(spark: SparkSession, snapshot: str, stations, answers, resolve: Callable[[float, float], tuple[str | None, str | None]], today: date) -> int:
    """S6, S7, S8, J11, K8 as one run: a kept document's stations get their communes, of places not asked yet, and go to the table `stations`.

    Stations that the document lacks stay as they are; names, places and capacities are the newest, a commune once known stays
    until another is found, and first_seen is the first day. The same document again changes last_seen alone.
    """
    rows = feeds.parse_stations(feeds.read_snapshot(spark, snapshot))
    return feeds.upsert_stations(stations, feeds.geocode_pooled(rows, answers, resolve), today)


def drift_run(hours: DataFrame, stations: DataFrame, reference: DataFrame, as_of: datetime, hours_back: int = 24, threshold: float = 0.2) -> DataFrame:
    """M6: drift of the last `hours_back` hours (two more are read for the lags)."""
    start = as_of - timedelta(hours=hours_back)
    rows = features.load_hourly(hours, stations, start - timedelta(hours=2), as_of)
    current = features.build(rows, holidays(hours.sparkSession), with_target=False).filter(F.col("heure_fin") >= start)
    return features.drift(reference, features.long_form(current), threshold)


def maintain(tables: dict[str, object], hours: float = 168.0, files: int = 1) -> dict[str, dict[str, int]]:
    """Compact and vacuum each table that exists; how many files and folders came and went."""
    return {name: {**t.compact(files), "vacuumed": t.vacuum(hours)} for name, t in tables.items() if t.exists()}


def run_in_order(steps: dict[str, tuple[tuple[str, ...], Callable[[], object]]]) -> dict[str, object]:
    """Q-15: each step after those it names; a step is skipped if one of those was, or returned SKIPPED or False."""
    done: dict[str, object] = {}
    left = dict(steps)
    while left:
        ready = [k for k, (needs, _) in left.items() if all(n in done for n in needs)]
        if not ready:
            raise ValueError(f"steps wait for each other: {sorted(left)}")
        for k in ready:
            needs, f = left.pop(k)
            done[k] = SKIPPED if any(done[n] in (SKIPPED, False) for n in needs) else f()
    return done
