"""What the text operators share: tables, folds, staged tables and bounded memos."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that go to Python at one time while a table is staged; its rows may be some kilobytes each.
STAGED_ROWS = 2000
_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none (tests)."""
    if told := spark.conf.get("spark.checkpoint.dir", None):
        return told
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="stages-"))
    return _own_dir[0]


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors.

    Tables lie below `<shared folder>/stages/<application id>/`, so an application's leftovers can be dropped together.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stages/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    rows = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(min(int(rows), STAGED_ROWS) if int(rows) > 0 else STAGED_ROWS))
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, rows)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function that `make` builds once for each task; its attribute `end`, if any, is called after the last row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                yield work(batch.slice(k, ROWS_AT_ONCE))
        getattr(work, "end", lambda: None)()

    return df.mapInArrow(run, schema)


def numbered(df: DataFrame) -> DataFrame:
    """`df` with its columns named by their places: Arrow functions can't take columns whose names have dots."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


#: Rows that a Python task holds as objects at one time.
ROWS_AT_ONCE = 1024


class Memo(dict):
    """A mapping made on demand, of at most two generations of `limit` keys; forgetting costs time and never changes a result."""

    def __init__(self, make: Callable[[str], object], limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: str) -> object:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found

    def all(self, keys: list) -> list:
        return list(map(self.__getitem__, keys))


_kept: dict = {}


def once(key: tuple, make: Callable[[], object]) -> object:
    """One object for each key and Python worker, reused by later tasks of that worker."""
    if key not in _kept:
        if len(_kept) > 8:
            _kept.clear()
        _kept[key] = make()
    return _kept[key]


def grouped(batches: Iterable[pa.RecordBatch], key: str, rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups of `key` from batches in which equal keys are adjacent; each holds many groups, `rows` rows or more."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    n, least = 0, rows
    for batch in (b.slice(k, rows) for b in batches for k in range(0, b.num_rows, rows)):
        held.append(batch)
        n += batch.num_rows
        if n < least:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        keys = whole.column(key).to_numpy()
        change = np.flatnonzero(keys[1:] != keys[:-1])
        if not len(change):
            held = whole.to_batches()
            least = 2 * n  # a large group: look again when it has doubled
            continue
        cut = int(change[-1]) + 1
        yield whole.slice(0, cut)
        held = whole.slice(cut).to_batches()
        n, least = n - cut, rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def file_of(path: str) -> str:
    """A vocabulary file's place; fails early if the driver doesn't have it."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return path
