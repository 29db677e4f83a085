"""Station feeds: status documents, reference snapshots, geocoding."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

from ..schemas import STATION_FEED, STATUS_FEED
from . import topic


class FeedError(ValueError):
    """A feed document without a list of stations."""


def parse_status(payload: object) -> tuple[int | None, list[dict]]:
    """Time of the last update (the other field where the first is missing or 0) and the stations."""
    data = payload.get("data") if isinstance(payload, dict) else None
    stations = data.get("stations") if isinstance(data, dict) else None
    if not isinstance(stations, list):
        raise FeedError("no list of stations in data.stations")
    return payload.get("lastUpdatedOther") or payload.get("last_updated"), stations


def status_rows(documents: DataFrame, text: str = "value") -> DataFrame:
    """S2 for a table of documents: a row for each station with an id (P17); a document without stations fails the query."""
    told = documents.withColumn("_d", F.from_json(text, STATUS_FEED))
    found = F.when(F.col("_d.data.stations").isNull(), F.raise_error(F.lit("no list of stations in data.stations")).cast("array<void>")).otherwise(F.lit(None))
    stations = F.coalesce(F.col("_d.data.stations"), found.cast(told.select("_d.data.stations").schema[0].dataType))
    updated = F.coalesce(F.nullif(F.col("_d.lastUpdatedOther"), F.lit(0)), F.col("_d.last_updated"))
    return told.select(updated.alias("feed_last_updated"), F.explode(stations).alias("station")).filter("station.station_id is not null")


def messages(rows: DataFrame, fetched_at: str, source: str = "station_status") -> DataFrame:
    """K1: key and compact JSON value of each station row."""
    value = F.struct("feed_last_updated", F.lit(fetched_at).alias("fetched_at"), F.lit(source).alias("source"), "station")
    return rows.select(F.col("station.station_id").cast("string").alias("key"), F.to_json(value).alias("value"))


def serialize(value: object) -> bytes:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False).encode()


def fetch(url: str, timeout: float = 15, tries: int = 5, backoff: float = 2, get: Callable[[str, float], tuple[int, bytes]] | None = None, sleep: Callable[[float], None] = time.sleep) -> tuple[int | None, list[dict]]:
    """One poll, tried again on 429 and 5xx with growing pauses. `get` returns status and body."""
    return parse_status(json.loads(answered(url, timeout, tries, backoff, get, sleep)))


def answered(url: str, timeout: float = 15, tries: int = 5, backoff: float = 2, get: Callable[[str, float], tuple[int, bytes]] | None = None, sleep: Callable[[float], None] = time.sleep) -> bytes:
    get = get or _get
    for k in range(tries + 1):
        status, body = get(url, timeout)
        if status == 200:
            return body
        if status != 429 and status < 500 or k == tries:
            raise FeedError(f"status {status}")
        sleep(backoff * 2**k)
    raise FeedError("no answer")


def _get(url: str, timeout: float) -> tuple[int, bytes]:
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer:
            return answer.status, answer.read()
    except urllib.error.HTTPError as e:
        return e.code, b""


class StatusFeed(DataSource):
    """S1 as a streaming source: `spark.readStream.format("station_status").option("url", ...)`; each batch is one poll.

    At most once: the feed can't be asked for the past, so a poll that was planned and not done before a restart is lost
    (the next one has the stations' state by then). For more, keep the documents (`keep_snapshot`) and read those.
    """

    @classmethod
    def name(cls) -> str:
        return "station_status"

    def schema(self) -> str:
        return "key string, value string, polled bigint"

    def simpleStreamReader(self, schema):
        return _Poll(self.options)


class _Poll(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.url, self.timeout, self.seen = options["url"], float(options.get("timeout", 15)), {}

    def initialOffset(self) -> dict:
        return {"polls": 0}

    def read(self, start: dict):
        updated, stations = fetch(self.url, self.timeout)
        at = datetime.now().astimezone().isoformat()
        rows = [(str(s["station_id"]), serialize({"feed_last_updated": updated, "fetched_at": at, "source": "station_status", "station": s}).decode(), start["polls"]) for s in stations if s.get("station_id") is not None]
        self.seen[start["polls"]] = rows
        return iter(rows), {"polls": start["polls"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([r for k in range(start["polls"], end["polls"]) for r in self.seen.get(k, [])])

    def commit(self, end: dict) -> None:
        self.seen = {k: v for k, v in self.seen.items() if k >= end["polls"]}


class LoggedFeed(DataSource):
    """S1 as a source that survives: `format("station_status_log")` with `url` and `log`, a shared folder.

    A poll's document is in the log before its offset is told. So a batch that was planned and not done comes again after a
    restart, with the same rows, and no poll is lost. `url` may have {poll}, the poll's number, and may be a file or folder
    of any file system; one that isn't there is no poll.
    """

    @classmethod
    def name(cls) -> str:
        return "station_status_log"

    def schema(self) -> str:
        return "key string, value string, polled bigint"

    def streamReader(self, schema):
        return _Logged(self.options)


@dataclass
class _PolledDocument(InputPartition):
    number: int


class _Logged(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.url, self.log, self.timeout, self.most = options["url"], options["log"], float(options.get("timeout", 15)), int(options.get("polls", 1 << 62))

    def _next(self) -> int:
        system, root = topic.opened(self.log)
        told = topic.names(system, root)
        return 1 + max((int(x.rpartition("/")[2].removesuffix(".json")) for x in told), default=-1)

    def initialOffset(self) -> dict:
        return {"polls": 0}

    def latestOffset(self) -> dict:
        n = self._next()
        url = self.url.replace("{poll}", str(n))
        if n >= self.most or (body := _document(url, self.timeout)) is None:
            return {"polls": n}
        updated, stations = parse_status(json.loads(body))
        system, root = topic.opened(self.log)
        told = {"feed_last_updated": updated, "fetched_at": datetime.now().astimezone().isoformat(), "stations": stations}
        topic.put(system, f"{root}/{n:012d}.json", json.dumps(told))
        return {"polls": n + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_PolledDocument(k) for k in range(start["polls"], end["polls"])]

    def read(self, own: _PolledDocument):
        system, root = topic.opened(self.log)
        with system.open_input_stream(f"{root}/{own.number:012d}.json") as f:
            told = json.loads(f.read())
        for s in told["stations"]:
            if s.get("station_id") is not None:
                value = {"feed_last_updated": told["feed_last_updated"], "fetched_at": told["fetched_at"], "source": "station_status", "station": s}
                yield str(s["station_id"]), serialize(value).decode(), own.number

    def commit(self, end: dict) -> None:
        """Documents of done batches go, but for the last: the next number comes from it."""
        system, root = topic.opened(self.log)
        for x in topic.names(system, root)[:-1]:
            if int(x.rpartition("/")[2].removesuffix(".json")) < end["polls"] - 1:
                system.delete_file(x)


def _document(url: str, timeout: float) -> bytes | None:
    """A feed's document: tried again as `fetch` does; or a file, or a folder's files, None if there is none."""
    if url.startswith("http"):
        return answered(url, timeout)
    system, path = topic.opened(url)
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        return None
    files = [path] if info.type == fs.FileType.File else [x for x in topic.names(system, path, "") if not x.rpartition("/")[2].startswith(("_", "."))]
    out = []
    for x in files:
        with system.open_input_stream(x) as f:
            out.append(f.read())
    return b"".join(out)


def keep_snapshot(spark: SparkSession, body: str, root: str, at: datetime) -> str:
    """The document as it came, in a dated folder. Returns its path."""
    path = f"{root}/snapshot_date={at:%Y-%m-%d}/station_information_{at:%H%M%S}.json"
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    stream.write(bytearray(body.encode()))
    stream.close()
    return path


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """S6."""
    return spark.read.schema(STATION_FEED).option("multiLine", True).json(path).select(F.explode("data.stations").alias("s")).select("s.*")


def parse_stations(snapshot: DataFrame) -> DataFrame:
    """Stations with an id and a place; a blank name becomes `Station <id>`."""
    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.concat(F.lit("Station "), F.col("station_id").cast("string")))
    return snapshot.filter("station_id is not null and lat is not null and lon is not null").select(F.col("station_id").cast("long").alias("station_id"), F.col("stationCode").alias("station_code"), name.alias("station_name"), "lat", "lon", "capacity")


def geocode(stations: DataFrame, known: DataFrame | None, resolve: Callable[[float, float], tuple[str | None, str | None]]) -> DataFrame:
    """Commune and code_insee of the stations that `known` has no code for; nulls for the others (an upsert keeps the old values) and where `resolve` fails.

    `resolve` asks one place at a time and runs on the executors.
    """
    rows = stations.withColumn("_old", F.lit(None).cast("string")) if known is None else stations.join(known.select("station_id", F.col("code_insee").alias("_old")), "station_id", "left")

    def run(batches):
        for pdf in batches:
            found = []
            for lat, lon, old in zip(pdf["lat"], pdf["lon"], pdf["_old"]):
                try:
                    found.append((None, None) if old else resolve(lat, lon))
                except OSError:
                    found.append((None, None))
            yield pdf.drop(columns="_old").assign(commune=[a for a, _ in found], code_insee=[b for _, b in found])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stations.select("station_id", *[c for c in stations.columns if c != "station_id"]).schema)
    return rows.select("station_id", *[c for c in stations.columns if c != "station_id"], "_old").mapInPandas(run, f"{schema}, commune string, code_insee string")


def geocode_pooled(stations: DataFrame, answers, resolve: Callable[[float, float], tuple[str | None, str | None]], at_once: int = 8) -> DataFrame:
    """S8, J11 for many stations: each place (lat, lon) is asked once, ever.

    Places that `answers` (a table of operators.tables) lacks are dealt out; each task asks up to `at_once` of them at a time.
    What is found is kept in the table, also that nothing was; where `resolve` fails with OSError nothing is kept, and the place is
    asked again next time. Adds commune and code_insee; nulls where nothing is known, and for stations without a place.
    """
    places = stations.select("lat", "lon").filter("lat is not null and lon is not null").distinct()
    known = answers.read()
    new = places if known is None else places.join(known.select("lat", "lon"), ["lat", "lon"], "left_anti")

    def ask(place: tuple[float, float]) -> tuple[float, float, str | None, str | None] | None:
        try:
            return (*place, *resolve(*place))
        except OSError:
            return None

    def run(batches):
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                for k in range(0, batch.num_rows, 64 * at_once):
                    part = batch.slice(k, 64 * at_once)
                    found = [x for x in pool.map(ask, zip(*(c.to_pylist() for c in part.columns))) if x]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 4, (pa.float64(), pa.float64(), pa.string(), pa.string()))], ["lat", "lon", "commune", "code_insee"])

    answers.append(new.select(F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).mapInArrow(run, "lat double, lon double, commune string, code_insee string"))
    return stations.join(answers.read(), ["lat", "lon"], "left").select(*stations.columns, "commune", "code_insee")


def geocode_by_table(stations: DataFrame, places: DataFrame) -> DataFrame:
    """S8 offline: commune and code_insee by station_id from a table."""
    return stations.join(places.select("station_id", "commune", "code_insee"), "station_id", "left")


def upsert_stations(table, rows: DataFrame, today) -> int:
    """K8: a station's newest attributes; commune and code_insee only where they are known now; first_seen stays."""
    dated = rows.withColumns({"first_seen": F.lit(today), "last_seen": F.lit(today), "updated_at": F.current_timestamp()})
    return table.upsert(dated, ("station_id",), keep=("first_seen",), prefer_new=("commune", "code_insee"))
