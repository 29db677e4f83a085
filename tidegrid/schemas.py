"""Explicit schemas of every layer; nothing is inferred."""

from __future__ import annotations

# Names and order of columns, as the feed has them and as the layers are specified.
_STATION = "STRUCT<station_id: BIGINT, stationCode: STRING, num_bikes_available: INT, num_bikes_available_types: ARRAY<MAP<STRING, INT>>, num_docks_available: INT, is_installed: INT, is_renting: INT, is_returning: INT, last_reported: BIGINT>"
ENVELOPE = f"feed_last_updated BIGINT, fetched_at STRING, source STRING, station {_STATION}"
STATUS_FEED = f"last_updated BIGINT, lastUpdatedOther BIGINT, data STRUCT<stations: ARRAY<{_STATION}>>"
MESSAGE = "key BINARY, value BINARY, topic STRING, partition INT, offset BIGINT, timestamp TIMESTAMP"
BRONZE = "kafka_key STRING, raw_json STRING, topic STRING, kafka_partition INT, kafka_offset BIGINT, kafka_timestamp TIMESTAMP, ingested_at TIMESTAMP, ingest_date DATE"
STATION_FEED = "data STRUCT<stations: ARRAY<STRUCT<station_id: BIGINT, stationCode: STRING, name: STRING, lat: DOUBLE, lon: DOUBLE, capacity: INT>>>"
STATIONS = "station_id BIGINT, station_code STRING, station_name STRING, lat DOUBLE, lon DOUBLE, capacity INT, commune STRING, code_insee STRING, first_seen DATE, last_seen DATE, updated_at TIMESTAMP"
PREDICTIONS = "station_id BIGINT, feature_time TIMESTAMP, target_time TIMESTAMP, predicted_bikes DOUBLE, model_name STRING, model_version STRING, predicted_at TIMESTAMP"
ALERTS = "alert_id STRING, created_at TIMESTAMP, alert_type STRING, severity STRING, title STRING, message STRING, source STRING, delivered_to ARRAY<STRING>"
#: Columns of a batch on its way from the refined layer to the warehouse.
LANDING = ("station_id", "station_code", "last_reported", "num_bikes_available", "num_mechanical", "num_ebike", "num_docks_available", "is_installed", "is_renting", "is_returning", "kafka_timestamp", "ingested_at")
