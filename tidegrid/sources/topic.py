"""A keyed log of messages in a shared folder: sink, offset ranges and newest messages.

A topic is a folder with a fixed number of partitions. Tasks of a streaming query write a file for each partition that their
rows fall into; nobody sees it. When all tasks of a batch are done, its commit gives the files their offsets and puts
them into a list of its own, by an atomic move; a batch that fails deletes what its tasks have told of. Readers open the
files of lists alone. A list names its query and batch, so a batch that comes again after a restart adds nothing.

A key always goes to the same partition (crc32), or rows say theirs in a column `partition`; in a partition rows stand in
the order of their task. One query at a time writes a topic. Files are read and written by pyarrow's file systems, so the
folder may be local, or in HDFS or an object store.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

from ..schemas import MESSAGE

PARTITIONS = 3
_FIELDS = pa.schema([("key", pa.binary()), ("value", pa.binary()), ("timestamp", pa.timestamp("us", "UTC"))])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


def put(system: fs.FileSystem, path: str, text: str) -> None:
    """The whole file or none."""
    system.create_dir(path.rpartition("/")[0], recursive=True)
    new = f"{path}.{uuid.uuid4().hex}.new"
    with system.open_output_stream(new) as out:
        out.write(text.encode())
    system.move(new, path)


def names(system: fs.FileSystem, folder: str, end: str = ".json") -> list[str]:
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(x.path for x in found if x.type == fs.FileType.File and x.path.endswith(end))


def lists(path: str) -> list[dict]:
    """The topic's lists in order."""
    system, root = opened(path)
    out = []
    for name in names(system, f"{root}/lists"):
        with system.open_input_stream(name) as f:
            out.append(json.loads(f.read()))
    return out


def ends(told: list[dict], partitions: int) -> list[int]:
    """High watermarks: the offset that each partition's next message gets."""
    return [max((f["from"] + f["n"] for x in told for f in x["files"] if f["partition"] == p), default=0) for p in range(partitions)]


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[int, str, int]]


class _Writer(DataSourceStreamWriter):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.n, self.query, self.columns = options["path"], int(options.get("partitions", PARTITIONS)), options.get("query", "query"), columns

    def write(self, rows: Iterator) -> Written:
        held: list[list[tuple]] = [[] for _ in range(self.n)]
        system, root = opened(self.path)
        system.create_dir(f"{root}/files", recursive=True)
        mark, writers, counts = uuid.uuid4().hex, {}, [0] * self.n

        def flush(p: int) -> None:
            if held[p]:
                if p not in writers:
                    writers[p] = pq.ParquetWriter(f"{root}/files/{mark}-{p}.parquet", _FIELDS, filesystem=system)
                writers[p].write_table(pa.table([pa.array(c, f.type) for c, f in zip(zip(*held[p]), _FIELDS)], schema=_FIELDS))
                counts[p] += len(held[p])
                held[p].clear()

        at = {c: k for k, c in enumerate(self.columns)}
        for row in rows:
            key = row[at["key"]]
            p = row[at["partition"]] if "partition" in at else None
            p = zlib.crc32(bytes(key or b"")) % self.n if p is None else p % self.n
            held[p].append((None if key is None else bytes(key), None if row[at["value"]] is None else bytes(row[at["value"]]), row[at["timestamp"]]))
            if len(held[p]) >= 10_000:
                flush(p)
        for p in range(self.n):
            flush(p)
        for w in writers.values():
            w.close()
        return Written([(p, f"{mark}-{p}.parquet", counts[p]) for p in writers])

    def commit(self, messages: list[Written | None], batch: int) -> None:
        told = lists(self.path)
        if any((x["query"], x["batch"]) == (self.query, batch) for x in told):
            return self.abort(messages, batch)
        high, files = ends(told, self.n), []
        for p, name, n in (f for m in messages if m for f in m.files):
            files.append({"partition": p, "file": name, "from": high[p], "n": n})
            high[p] += n
        system, root = opened(self.path)
        put(system, f"{root}/lists/{len(told):012d}.json", json.dumps({"query": self.query, "batch": batch, "files": files}))

    def abort(self, messages: list[Written | None], batch: int) -> None:
        system, root = opened(self.path)
        for _, name, _ in (f for m in messages if m for f in m.files):
            system.delete_file(f"{root}/files/{name}")


@dataclass
class Range(InputPartition):
    """Messages of a partition with offsets from `start` up to `stop`, and the files that have some: name and first offset."""

    partition: int
    start: int
    stop: int
    files: list[tuple[str, int]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.n = options["path"], int(options.get("partitions", PARTITIONS))
        self.starts, self.stops, self.newest = (json.loads(options.get(k, "{}")) for k in ("starts", "stops", "newest"))

    def partitions(self) -> list[Range]:
        told = lists(self.path)
        out = []
        for p, high in enumerate(ends(told, self.n)):
            start, stop = int(self.starts.get(str(p), 0)), min(high, int(self.stops.get(str(p), high)))
            start = max(start, stop - 1) if self.newest else start
            out.append(Range(p, start, stop, [(f["file"], f["from"]) for x in told for f in x["files"] if f["partition"] == p and f["from"] < stop and f["from"] + f["n"] > start]))
        return out

    def read(self, own: Range) -> Iterator[pa.RecordBatch]:
        system, root = opened(self.path)
        for name, at in own.files:
            for batch in pq.ParquetFile(f"{root}/files/{name}", filesystem=system).iter_batches():
                a, b = max(0, own.start - at), min(batch.num_rows, own.stop - at)
                if a < b:
                    part = batch.slice(a, b - a)
                    fixed = [pa.array([self.path.rstrip("/").rpartition("/")[2]] * (b - a)), pa.array([own.partition] * (b - a), pa.int32()), pa.array(range(at + a, at + b), pa.int64())]
                    yield pa.RecordBatch.from_arrays([part.column("key"), part.column("value"), *fixed, part.column("timestamp")], ["key", "value", "topic", "partition", "offset", "timestamp"])
                at += batch.num_rows


class Topic(DataSource):
    """`readStream`'s rows (key, value, timestamp, perhaps partition) by `writeStream.format("topic")`, and batch reads of MESSAGE rows. Options: path, partitions, query; starts, stops (JSON by partition), newest."""

    @classmethod
    def name(cls) -> str:
        return "topic"

    def schema(self) -> str:
        return MESSAGE

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def streamWriter(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options, list(schema.names))


def produce(rows: DataFrame, path: str, checkpoint: str, partitions: int = PARTITIONS, query: str = "query", trigger: dict | None = None):
    """K1: rows (key, value, timestamp, perhaps partition) of a stream go to the topic, each batch once."""
    rows.sparkSession.dataSource.register(Topic)
    sink = rows.writeStream.format("topic").options(path=path, partitions=str(partitions), query=query)
    return sink.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "60 seconds"})).start()


def messages(spark: SparkSession, path: str, partitions: int = PARTITIONS, **options: str) -> DataFrame:
    """Rows of MESSAGE in offset ranges, one input partition for each partition of the topic."""
    spark.dataSource.register(Topic)
    return spark.read.format("topic").options(path=path, partitions=str(partitions), **options).load()


def newest(spark: SparkSession, path: str, partitions: int = PARTITIONS) -> DataFrame:
    """Partition, high (the next offset), newest_at (time of the message before it; null for an empty partition). Only the last message of each partition is read."""
    told = messages(spark, path, partitions, newest="1").select("partition", (F.col("offset") + 1).alias("high"), F.col("timestamp").alias("newest_at"))
    every = spark.range(partitions).select(F.col("id").cast("int").alias("partition"))
    return every.join(told, "partition", "left").select("partition", F.coalesce("high", F.lit(0)).cast("long").alias("high"), "newest_at")
