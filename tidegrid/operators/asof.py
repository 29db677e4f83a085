"""Hourly as-of forward fill (M1, J5, J6): the last reading strictly before the end of each hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def one_hour() -> Column:
    return F.expr("interval 1 hour")


def _hour(t: Column | str) -> Column:
    return F.date_trunc("hour", t)


def by_intervals(readings: DataFrame, key: str, at: str, first: Column, last: Column) -> DataFrame:
    """Each reading is repeated for the hours that it is the last one of: one shuffle, no grid. heure_debut is added.

    first, last: hours between which rows come out. Times of a key must be unique. A reading on the hour belongs to the
    hour that it starts; readings before `first` fill from `first` on.
    """
    following = F.lead(at).over(Window.partitionBy(key).orderBy(at))
    lo = F.greatest(_hour(at), first)
    hi = F.least(F.coalesce(_hour(following) - one_hour(), last), last)
    spread = readings.withColumns({"_lo": lo, "_hi": hi}).withColumn("heure_debut", F.explode(F.when(F.col("_lo") <= F.col("_hi"), F.sequence("_lo", "_hi", one_hour()))))
    return spread.drop("_lo", "_hi")


def by_grid(readings: DataFrame, key: str, at: str, stations: DataFrame, hours: DataFrame) -> DataFrame:
    """The same by a station x hour grid and a running last value; the cross-check of `by_intervals`."""
    columns = [c for c in readings.columns if c != key]
    read = readings.select(F.col(key).alias("_read")).distinct()  # hours of other stations would be dropped at the end
    grid = stations.select(key).join(read, F.col(key).eqNullSafe(F.col("_read")), "left_semi").crossJoin(F.broadcast(hours.select("heure_debut")))  # hours of the asked period
    events = readings.select(key, F.col(at).alias("_t"), F.lit(1).alias("_k"), F.struct(*columns).alias("_r"), F.lit(None).cast("timestamp").alias("heure_debut"))
    marks = grid.select(key, (F.col("heure_debut") + one_hour()).alias("_t"), F.lit(0).alias("_k"), F.lit(None).cast(events.schema["_r"].dataType).alias("_r"), "heure_debut")
    w = Window.partitionBy(key).orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    filled = events.unionByName(marks).withColumn("_r", F.last("_r", True).over(w)).filter("_k = 0 and _r is not null")
    return filled.select(key, "_r.*", "heure_debut")


def grid(stations: DataFrame, hours: DataFrame, key: str = "station_id", *more: str) -> DataFrame:
    """Every station, with its columns `more`, with every hour."""
    return stations.select(key, *more).crossJoin(F.broadcast(hours.select("heure_debut")))  # hours of the asked period


def time_shift(df: DataFrame, key: str, at: str, value: str, hours: dict[str, int]) -> DataFrame:
    """For each name, `value` of the same key exactly so many hours earlier (negative: later); null in a gap. One exchange for all."""
    seconds = F.unix_seconds(at)
    w = lambda h: Window.partitionBy(key).orderBy(seconds).rangeBetween(-3600 * h, -3600 * h)
    return df.withColumns({name: F.last(value).over(w(h)) for name, h in hours.items()})


def time_shift_join(df: DataFrame, key: str, at: str, value: str, hours: dict[str, int]) -> DataFrame:
    """The same by self-joins; the cross-check of `time_shift`."""
    out = df
    for name, h in hours.items():
        moved = df.select(key, (F.col(at) + F.make_dt_interval(hours=F.lit(h))).alias(at), F.col(value).alias(name))
        out = out.join(moved, [key, at], "left")
    return out
