"""Structured Streaming: raw ingestion, change capture and progress gauges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.refine import to_bronze
from ..schemas import MESSAGE


def source(spark: SparkSession, kind: str, where: str, topic: str = "", per_trigger: int = 200_000) -> DataFrame:
    """Rows of MESSAGE. kind "kafka": where is the brokers; "files": where is a folder of Parquet files of MESSAGE, `per_trigger` counts files."""
    if kind == "kafka":
        options = {"kafka.bootstrap.servers": where, "subscribe": topic, "startingOffsets": "earliest", "maxOffsetsPerTrigger": str(per_trigger), "failOnDataLoss": "false"}
        return spark.readStream.format("kafka").options(**options).load()
    if kind == "files":
        return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", per_trigger).option("ignoreMissingFiles", True).parquet(where)
    raise ValueError(f"unknown source {kind!r}")


def write_bronze(messages: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, name: str = "bronze") -> StreamingQuery:
    """Append to date folders, each batch once. trigger: {"processingTime": "60 seconds"} (usual) or {"availableNow": True}."""
    writer = to_bronze(messages).writeStream.format("parquet").outputMode("append").partitionBy("ingest_date").option("checkpointLocation", checkpoint).queryName(name)
    return writer.trigger(**(trigger or {"processingTime": "60 seconds"})).start(path)


def write_bronze_table(messages: DataFrame, table, checkpoint: str, trigger: dict | None = None, name: str = "bronze_table") -> StreamingQuery:
    """K2 into a table of operators.tables, which can be compacted: a message that comes again adds nothing, by broker position, on whatever day."""

    def add(batch: DataFrame, number: int) -> None:
        table.insert_absent(to_bronze(batch), ("kafka_partition", "kafka_offset"), not_before="kafka_timestamp")

    return messages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).queryName(name).trigger(**(trigger or {"processingTime": "60 seconds"})).start()


class _LastSeen(StatefulProcessor):
    """Keeps each station's last time; a row goes on if its time differs from it (no state yet counts as null)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "last_reported bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        whole = pd.concat(list(rows)).sort_values("seq", kind="stable")  # a key's rows of one batch, whose size the source's setting bounds
        keep = []
        for now in whole["last_reported"]:
            now = None if pd.isna(now) else int(now)
            keep.append(now != last)
            last = now
        if last is not None:
            self.last.update((last,))
        yield whole[keep]

    def close(self) -> None:
        pass


def changed_stream(rows: DataFrame, only_changed: bool = True) -> DataFrame:
    """Rows (station_id, last_reported, seq, value) whose time differs from their station's one before, in order of seq; without `only_changed` all. State survives restarts."""
    rows = rows.filter("station_id is not null").select("station_id", "last_reported", "seq", "value")
    if not only_changed:
        return rows
    return rows.groupBy("station_id").transformWithStateInPandas(_LastSeen(), outputStructType="station_id bigint, last_reported bigint, seq bigint, value string", outputMode="append", timeMode="none")


def changed(rows: DataFrame, key: str = "station_id", value: str = "last_reported", order: str = "seq") -> DataFrame:
    """W5, T2 for a table: rows whose value differs from their key's one before; a first null counts as no change."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return rows.filter(F.col(key).isNotNull()).withColumn("_before", before).filter(~F.col("_before").eqNullSafe(F.col(value))).drop("_before")


def unique_readings(parsed: DataFrame, late: str = "30 minutes") -> DataFrame:
    """T3 in streaming form: a reading once, however late it comes again within `late`."""
    return parsed.withWatermark("kafka_timestamp", late).dropDuplicatesWithinWatermark(["station_id", "last_reported"])


class Gauges(StreamingQueryListener):
    """T4: the newest figures of each query, by name."""

    def __init__(self) -> None:
        self.of: dict[str, dict] = {}
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.rows.setdefault(str(event.name or event.id), 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        name = str(p.name or p.id)
        self.rows[name] = self.rows.get(name, 0) + p.numInputRows
        self.batches[name] = self.batches.get(name, 0) + (p.numInputRows > 0)
        behind = sum(int(float((s.metrics or {}).get("maxOffsetsBehindLatest", 0))) for s in p.sources)
        self.of[name] = {"rows": self.rows[name], "batch_rows": p.numInputRows, "in_per_s": p.inputRowsPerSecond, "out_per_s": p.processedRowsPerSecond, "batch_ms": p.durationMs.get("triggerExecution", 0) if p.durationMs else 0, "behind": behind, "at": p.timestamp}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
