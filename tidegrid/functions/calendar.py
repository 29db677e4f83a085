"""Calendar and hour-of-day attributes, and French public holidays."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIMEZONE = "Europe/Paris"
# Names that results must carry.
DAYS = ("lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche")
MONTHS = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")
FIXED_HOLIDAYS = {(1, 1): "Jour de l'an", (5, 1): "Fête du Travail", (5, 8): "Fête de la Victoire", (7, 14): "Fête nationale", (8, 15): "Assomption", (11, 1): "Toussaint", (11, 11): "Armistice", (12, 25): "Noël"}
EASTER_HOLIDAYS = {1: "Lundi de Pâques", 39: "Ascension", 50: "Lundi de Pentecôte"}
HOLIDAY_YEARS = range(2025, 2029)
PEAK_HOURS = (7, 8, 9, 17, 18, 19)


def easter(year: int) -> date:
    """Easter Sunday by the anonymous Gregorian computus."""
    a, (b, c) = year % 19, divmod(year, 100)
    d, e = divmod(b, 4)
    h = (19 * a + b - d - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    i, k = divmod(c, 4)
    m = (32 + 2 * e + 2 * i - h - k) % 7
    n = h + m - 7 * ((a + 11 * h + 22 * m) // 451) + 114
    return date(year, n // 31, n % 31 + 1)


def holidays(spark: SparkSession, years=HOLIDAY_YEARS) -> DataFrame:
    """date_ferie, nom_ferie. Years outside the range have no holidays."""
    rows = [(date(y, *d), name) for y in years for d, name in FIXED_HOLIDAYS.items()]
    rows += [(easter(y) + timedelta(k), name) for y in years for k, name in EASTER_HOLIDAYS.items()]
    return spark.createDataFrame(sorted(rows), "date_ferie date, nom_ferie string")


def read_holidays(spark: SparkSession, path: str) -> DataFrame:
    """S9 from a CSV file with a header."""
    return spark.read.schema("date_ferie date, nom_ferie string").csv(path, header=True)


def date_key(day) -> F.Column:
    return F.date_format(day, "yyyyMMdd").cast("int")


def dim_date(spark: SparkSession, first: date, last: date, holiday: DataFrame | None = None) -> DataFrame:
    """A row for each day from first to last."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("date_jour"))
    holiday = holidays(spark) if holiday is None else holiday
    dow = F.weekday("date_jour") + 1
    weekend = dow.isin(6, 7)
    named = F.col("nom_ferie").isNotNull()
    return days.join(F.broadcast(holiday.withColumnRenamed("date_ferie", "date_jour")), "date_jour", "left").select(  # a few rows a year
        date_key(F.col("date_jour")).alias("date_id"), "date_jour", dow.cast("int").alias("jour_semaine_num"), F.element_at(F.array(*map(F.lit, DAYS)), dow).alias("jour_semaine"),
        weekend.alias("est_weekend"), named.alias("est_ferie"), "nom_ferie", F.when(weekend | named, "week-end / férié").otherwise("semaine").alias("type_jour"),
        F.dayofmonth("date_jour").alias("jour"), F.month("date_jour").alias("mois"), F.element_at(F.array(*map(F.lit, MONTHS)), F.month("date_jour")).alias("nom_mois"),
        F.year("date_jour").alias("annee"), F.weekofyear("date_jour").alias("semaine_iso"),
    )


def dim_hour(spark: SparkSession) -> DataFrame:
    """The 24 hours with label, part of the day and peak flag."""
    h = F.col("heure")
    part = F.when(h <= 5, "nuit").when(h <= 9, "matin").when(h <= 13, "midi").when(h <= 16, "après-midi").when(h <= 20, "soir").otherwise("nuit")
    return spark.range(24).select(F.col("id").cast("int").alias("heure")).select("heure", F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit("h")).alias("libelle_heure"), part.alias("tranche_horaire"), h.isin(*PEAK_HOURS).alias("est_heure_pointe"))
