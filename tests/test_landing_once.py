from datetime import datetime

from pyspark.sql import functions as F

from tidegrid.operators.tables import Table
from tidegrid.plans import jobs


def test_a_landing_is_checked_once(spark, tmp_path):
    """Its results are told by one reading of the landing, however often they are used."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    at = datetime(2024, 1, 2)
    rows = spark.range(100).select(F.col("id").alias("station_id"), F.col("id").cast("string").alias("station_code"), F.lit(at).cast("timestamp").alias("last_reported"), F.lit(5).alias("num_bikes_available"), F.lit(2).alias("num_mechanical"), F.lit(3).alias("num_ebike"), F.lit(7).alias("num_docks_available"), F.lit(True).alias("is_renting"), F.lit(at).cast("timestamp").alias("ingested_at"))
    landing = rows.mapInArrow(count, rows.schema)
    house = jobs.Warehouse(Table(spark, f"file://{tmp_path}/status", ("report_date",)), None, None, None)
    results, ok = jobs.merge_landing(landing, house, at)
    before = seen.value
    assert ok and house.status.read().count() == 100
    assert results.count() == 12 and results.filter("success").count() == 12 and seen.value == before <= 200
