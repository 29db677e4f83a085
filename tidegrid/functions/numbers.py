"""Exact rounding, guarded ratios and great-circle distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_MINUTE = 60_000_000
EARTH_RADIUS_M = 6_371_000


def exact_ratio(part: Column, whole: Column, digits: int) -> Column:
    """part / whole of whole numbers, rounded half away from zero on exact decimals; null where whole is 0 or null."""
    top, bottom = part.cast("decimal(19,0)"), F.nullif(whole.cast("decimal(19,0)"), F.lit(0).cast("decimal(19,0)"))
    return F.round(top / bottom, digits).cast(f"decimal(20,{digits})")


def exact_mean(value: Column, digits: int) -> Column:
    """Aggregate: mean of whole or decimal numbers, rounded half away from zero on exact decimals."""
    return F.round(F.sum(value).cast("decimal(25,4)") / F.nullif(F.count(value), F.lit(0)).cast("decimal(12,0)"), digits).cast(f"decimal(20,{digits})")


def mean_of_present(*columns: Column) -> Column:
    """Row-wise mean that skips nulls; null if all are."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0))
    return total / F.nullif(sum((c.isNotNull().cast("int") for c in columns), F.lit(0)), F.lit(0))


def micros_between(start: Column, stop: Column) -> Column:
    return F.unix_micros(stop) - F.unix_micros(start)


def minutes_between(start: Column, stop: Column, digits: int) -> Column:
    return exact_ratio(micros_between(start, stop), F.lit(MICROS_PER_MINUTE), digits)


def distance_m(lat: Column, lon: Column, to_lat: Column, to_lon: Column) -> Column:
    """Haversine distance in metres."""
    a = F.pow(F.sin(F.radians(lat - to_lat) / 2), 2) + F.cos(F.radians(to_lat)) * F.cos(F.radians(lat)) * F.pow(F.sin(F.radians(lon - to_lon) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(a))


def psi(expected: Column, actual: Column, least: float = 1e-4) -> Column:
    """Population stability index of two arrays of shares; shares under `least` count as `least`."""
    terms = F.zip_with(expected, actual, lambda e, a: (F.greatest(a, F.lit(least)) - F.greatest(e, F.lit(least))) * F.ln(F.greatest(a, F.lit(least)) / F.greatest(e, F.lit(least))))
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)


def bin_of(value: Column, edges: Column) -> Column:
    """Number of the bin of `value` among `edges`; values beyond the outer edges go to the outer bins."""
    return F.size(F.filter(F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0))), lambda e: e <= value))
