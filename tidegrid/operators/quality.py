"""Declarative quality suites, constraint checks, freshness and alert de-duplication (Q-1..Q-7, Q-13, T5, T6, P14)."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import kept

#: Gaps between alerts that one block of alerts spans, and a time before all others.
GAPS, NEVER = 24, -(1 << 63)


@dataclass(frozen=True)
class Check:
    """kind: row_count, not_null, unique, between, min_between. Bounds are inclusive; nulls pass `between`; `mostly`: least share that must pass; where: condition that rows must meet to be looked at."""

    kind: str
    columns: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    mostly: float = 1.0
    where: str | None = None
    severity: str = "critical"


#: Checks of a refined batch before it goes on.
READINGS_SUITE = (
    Check("row_count", low=1), Check("not_null", ("station_id",)), Check("not_null", ("last_reported",)), Check("unique", ("station_id", "last_reported")),
    Check("between", ("num_bikes_available",), 0, 150), Check("between", ("num_docks_available",), 0, 150, where="is_renting"), Check("between", ("num_mechanical",), 0), Check("between", ("num_ebike",), 0),
    Check("between", ("bikes_type_gap",), 0, 0, 0.99, severity="warning"), Check("not_null", ("station_code",), mostly=0.99, severity="warning"),
    Check("min_between", ("minutes_since_report",), high=180, severity="warning"), Check("between", ("ingestion_delay_minutes",), high=90, mostly=0.95, severity="warning"),
)


def with_derived(readings: DataFrame, now: datetime) -> DataFrame:
    """P14."""
    minutes = lambda a, b: (F.unix_micros(b) - F.unix_micros(a)) / 60e6
    return readings.withColumns({
        "bikes_type_gap": F.abs(F.col("num_bikes_available") - F.col("num_mechanical") - F.col("num_ebike")),
        "minutes_since_report": minutes(F.col("last_reported"), F.lit(now).cast("timestamp")), "ingestion_delay_minutes": minutes(F.col("last_reported"), F.col("ingested_at")),
    })


def _outside(c: Column, low, high) -> Column:
    return F.coalesce(((c < low) if low is not None else F.lit(False)) | ((c > high) if high is not None else F.lit(False)), F.lit(False))


def run_suite(df: DataFrame, suite: tuple[Check, ...]) -> DataFrame:
    """Q-6: expectation, column_name, severity, success, unexpected_count, element_count; one row a check, all from one aggregate.

    Uniqueness needs the rows of a key together, so its counts are added to the rows by a window over the key first.
    """
    for k, c in enumerate(suite):
        if c.kind == "unique":
            df = df.withColumn(f"_met{k}", F.count("*").over(Window.partitionBy(*c.columns)))
    found = []
    for k, c in enumerate(suite):
        seen = F.coalesce(F.expr(c.where), F.lit(False)) if c.where else F.lit(True)
        one = F.col(c.columns[0]) if c.columns else F.lit(None)
        total = F.count_if(seen)
        if c.kind == "row_count":
            bad, base = F.lit(0), total
            ok = ~_outside(total, c.low, c.high)
        elif c.kind == "min_between":
            bad, base, ok = F.lit(0), total, ~_outside(F.min(F.when(seen, one)), c.low, c.high) & F.min(F.when(seen, one)).isNotNull()
        else:
            wrong = {"not_null": one.isNull(), "unique": F.col(f"_met{k}") > 1 if c.kind == "unique" else None, "between": _outside(one, c.low, c.high)}[c.kind]
            bad = F.count_if(seen & wrong)
            base = total if c.kind != "between" else F.count_if(seen & one.isNotNull())
            ok = F.when(base == 0, True).otherwise(bad <= base * (1 - c.mostly) + 1e-9)
        found.append(F.struct(F.lit(c.kind).alias("expectation"), F.lit(",".join(c.columns) or None).cast("string").alias("column_name"), F.lit(c.severity).alias("severity"), F.coalesce(ok, F.lit(False)).alias("success"), bad.cast("long").alias("unexpected_count"), total.cast("long").alias("element_count")))
    return df.agg(F.array(*found).alias("r")).select(F.inline("r"))


def passes(results: DataFrame) -> bool:
    """Whether no critical check failed."""
    return results.filter("severity = 'critical' and not success").isEmpty()


# -- Q-7: each returns the rows that break the constraint.


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def unique(df: DataFrame, *columns: str) -> DataFrame:
    """A15."""
    return df.groupBy(*columns).agg(F.count("*").alias("nb")).filter("nb > 1")


def accepted_values(df: DataFrame, column: str, values) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("nb")).filter(~F.col(column).isin(*values))


def accepted_range(df: DataFrame, column: str, low=None, high=None, inclusive: bool = True) -> DataFrame:
    c = F.col(column)
    broken = F.lit(False)
    if low is not None:
        broken = broken | ((c < low) if inclusive else (c <= low))
    if high is not None:
        broken = broken | ((c > high) if inclusive else (c >= high))
    return df.select(column).filter(c.isNotNull() & broken)


def relationships(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Values of `column` that no row of `parent` has; the planner picks the join by the parent's size."""
    keys = parent.select(F.col(parent_column).alias(column)).distinct()
    return df.select(column).filter(F.col(column).isNotNull()).join(keys, column, "left_anti")


def freshness(df: DataFrame, column: str, as_of: datetime, warn_minutes: float, error_minutes: float) -> DataFrame:
    """Newest value, its age in minutes, and pass, warn or error (error too for an empty table)."""
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("newest")) / 60e6
    told = F.when(F.col("age_minutes") <= warn_minutes, "pass").when(F.col("age_minutes") <= error_minutes, "warn").otherwise("error")
    return df.agg(F.max(column).alias("newest")).withColumn("age_minutes", age).withColumn("status", told)


def alerts_to_send(events: DataFrame, minutes: float = 60) -> DataFrame:
    """Q-13 in batch form: an alert goes out unless one of its type and title *went out* less than `minutes` before.

    Which go out depends on those before, but only by one time, from when the next may. So each (type, title) is cut into
    blocks of GAPS times `minutes`, and each block tells by itself at what time the next may go out after it for every
    time of entry: entries that end alike are one, so that this takes a few numbers a block. One pass in order over these
    gives each block its entry, and the blocks are passed by themselves again. A (type, title) with most of the alerts is
    so spread over tasks; one task holds the distinct times of a block. A null type or title is a value like others, an
    alert without time is none, and of alerts of one time one goes out (all, if `minutes` is 0).
    """
    gap = int(minutes * 60e6)
    named = events.filter("created_at is not null").select("alert_type", "title", F.unix_micros("created_at").alias("t"))
    if gap <= 0:
        return named.select("alert_type", "title", F.timestamp_micros("t").alias("created_at"))

    @F.pandas_udf("struct<upto:array<bigint>,next:array<bigint>>")
    def ways(blocks: pd.Series, times: pd.Series) -> pd.DataFrame:
        upto, following = [], []
        for block, own in zip(blocks, times):
            to = np.searchsorted(own, own + gap)
            to = np.where(to < len(own), to, np.arange(len(own)))  # the one sent next; the last one sent stays where it is
            while not np.array_equal(further := to[to], to):
                to = further
            n = np.searchsorted(own, (block * GAPS + 1) * gap) + 1  # an entry is less than a gap after the block's start
            ends = own[to][:n] + gap
            last = np.flatnonzero(np.append(ends[1:] != ends[:-1], True))
            upto.append(own[last])
            following.append(ends[last])
        return pd.DataFrame({"upto": upto, "next": following})

    def enter(frames):
        key, least = None, NEVER
        for frame in frames:
            entries = []
            for kind, title, upto, following in zip(frame["alert_type"], frame["title"], frame["upto"], frame["next"]):
                own = tuple(None if pd.isna(x) else x for x in (kind, title))
                key, least = own, least if own == key else NEVER
                entries.append(least)
                at = np.searchsorted(upto, least)
                least = int(following[at]) if at < len(upto) else least
            yield frame[["alert_type", "title", "block"]].assign(least=entries)

    block = ((F.col("t") - F.pmod("t", F.lit(GAPS * gap))) / F.lit(GAPS * gap)).cast("long")
    blocks = named.groupBy("alert_type", "title", block.alias("block")).agg(F.sort_array(F.collect_set("t")).alias("times"))  # the times of GAPS gaps
    blocks = kept(events.sparkSession, blocks.withColumn("way", ways("block", "times")))
    ordered = blocks.select("alert_type", "title", "block", "way.*").repartition("alert_type", "title").sortWithinPartitions("alert_type", "title", "block")
    entries = ordered.mapInPandas(enter, "alert_type string, title string, block long, least long")
    same = F.col("a.alert_type").eqNullSafe(F.col("b.alert_type")) & F.col("a.title").eqNullSafe(F.col("b.title")) & (F.col("a.block") == F.col("b.block"))
    none = F.struct(F.col("least"), F.array().cast("array<bigint>").alias("sent"))
    send = lambda so_far, t: F.when(t < so_far["least"], so_far).otherwise(F.struct((t + gap).alias("least"), F.array_append(so_far["sent"], t).alias("sent")))
    sent = blocks.alias("a").join(entries.alias("b"), same).select("a.alert_type", "a.title", F.explode(F.aggregate("times", none, send)["sent"]).alias("t"))
    return sent.select("alert_type", "title", F.timestamp_micros("t").alias("created_at"))


def notify(log, spark: SparkSession, alert: dict, now: datetime, minutes: int = 60) -> bool:
    """Q-13: append an alert to the table `log`, unless one of its type and title is younger than `minutes`; says whether it went out."""
    import uuid

    from ..schemas import ALERTS

    old = log.read()
    if minutes and old is not None:
        recent = old.filter((F.col("alert_type") == alert["alert_type"]) & (F.col("title") == alert["title"]) & (F.col("created_at") > now - timedelta(minutes=minutes)))
        if not recent.isEmpty():
            return False
    row = {"alert_id": uuid.uuid4().hex, "created_at": now, "message": "", "source": None, "delivered_to": ["database"], **alert}
    log.append(spark.createDataFrame([row], ALERTS))
    return True
