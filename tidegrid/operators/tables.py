"""Tables of plain Parquet with atomic changes.

A table is a folder of immutable batches and a list of the folders that are live. A change writes a new batch, then
the next list, which must not exist yet: of two writers one wins and the other is told. Readers see one list's
folders, so nothing that is read is ever overwritten. A change of a partitioned table rewrites the partitions that it
touches and no others.

That only one writer makes a list rests on the file system's create-without-overwrite, which is atomic on HDFS and local
disks. On an object store without it, let one writer at a time change a table.
"""

from __future__ import annotations

import json
import time
import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer changed the table meanwhile."""


#: Bits of each of the two maps that the index keeps of a file's keys: as many as the built-in aggregate has.
BITS = 32_768


def _bits(key: list[F.Column]) -> list[F.Column]:
    h = F.xxhash64(*key)
    return [F.pmod(h, F.lit(BITS)), F.pmod(F.shiftright(h, 24), F.lit(BITS))]


class Table:
    """sort_by (K17): files are sorted by these columns, so that row groups' statistics serve look-ups by them.

    index (K17): for each file written, the least and greatest value of each of these columns and BITS bits of the whole
    keys are kept in a table beside the batch; `lookup` asks that before it opens files.
    """

    def __init__(self, spark: SparkSession, path: str, partition_by: tuple[str, ...] = (), sort_by: tuple[str, ...] = (), index: tuple[str, ...] = ()):
        self.spark, self.path, self.partition_by, self.sort_by, self.index = spark, path.rstrip("/"), tuple(partition_by), tuple(sort_by), tuple(index)
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- lists of live folders

    def _versions(self) -> list[int]:
        at = self._path(f"{self.path}/_lists")
        if not self._fs.exists(at):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in self._fs.listStatus(at) if s.getPath().getName().endswith(".json"))

    def version(self) -> int:
        return max(self._versions(), default=-1)

    def exists(self) -> bool:
        """S4."""
        return self.version() >= 0

    def _list(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version < 0:
            return {"schema": None, "folders": []}
        stream = self._fs.open(self._path(f"{self.path}/_lists/{version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, based_on: int, schema: T.StructType, folders: list[str]) -> int:
        at = self._path(f"{self.path}/_lists/{based_on + 1}.json")
        self._fs.mkdirs(at.getParent())
        try:
            stream = self._fs.create(at, False)
        except Exception as e:
            raise Conflict(self.path) from e
        stream.write(bytearray(json.dumps({"schema": schema.jsonValue(), "folders": folders, "at": time.time()}).encode()))
        stream.close()
        return based_on + 1

    def _write(self, df: DataFrame) -> list[str]:
        batch = f"batch={uuid.uuid4().hex}"
        writer = (df.sortWithinPartitions(*self.partition_by, *self.sort_by) if self.sort_by else df).write
        (writer.partitionBy(*self.partition_by) if self.partition_by else writer).parquet(f"{self.path}/{batch}")
        return self._written(batch, df.schema)

    def _write_each(self, schema: T.StructType, parts: dict[str, list[str]], files: int) -> list[str]:
        """Each partition's folders as `files` files, without the sort by partition that a task with several would need."""
        batch = f"batch={uuid.uuid4().hex}"
        for partition, folders in sorted(parts.items()):
            rows = self._frame(schema, folders).drop(*self.partition_by).coalesce(files)
            (rows.sortWithinPartitions(*self.sort_by) if self.sort_by else rows).write.parquet(f"{self.path}/{batch}/{partition}")
        return self._written(batch, schema)

    def _written(self, batch: str, schema: T.StructType) -> list[str]:
        """The folders of a batch, which are put into the index."""
        if self.index:
            rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{batch}").parquet(f"{self.path}/{batch}")
            ends = [f(c).alias(f"{name}_{k}") for k, c in enumerate(self.index) for name, f in (("least", F.min), ("most", F.max))]
            bits = [F.bitmap_construct_agg(b).alias(f"bits_{k}") for k, b in enumerate(_bits([F.col(c) for c in self.index]))]
            rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(*ends, *bits).write.parquet(f"{self.path}/_index/{batch}")
        found = [batch]
        for _ in self.partition_by:
            found = [f"{p}/{s.getPath().getName()}" for p in found for s in self._fs.listStatus(self._path(f"{self.path}/{p}")) if s.isDirectory()]
        return sorted(found)

    # -- reading

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table (at a version), None if it doesn't exist."""
        told = self._list(version)
        if told["schema"] is None:
            return None
        return self._frame(T.StructType.fromJson(told["schema"]), told["folders"])

    def _frame(self, schema: T.StructType, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        whole = T.StructType([*schema.fields, T.StructField("batch", T.StringType())])
        return self.spark.read.schema(whole).option("basePath", self.path).parquet(*[f"{self.path}/{f}" for f in folders]).select(*schema.names)

    def _partitions(self, folder: str) -> str:
        return folder.partition("/")[2]

    def files_for(self, values: dict[str, object]) -> list[str]:
        """The live files that may have rows with these values of index columns; bits are asked if all of them are given."""
        folders = self._list()["folders"]
        there = {f: self._path(f"{self.path}/_index/{f.partition('/')[0]}") for f in folders}
        known = [f for f in folders if self._fs.exists(there[f])]
        found = [s.getPath().toString() for f in folders if f not in known for s in self._fs.listStatus(self._path(f"{self.path}/{f}")) if s.getPath().getName().endswith(".parquet")]
        if not known:
            return found
        may = F.lit(True)
        for k, c in enumerate(self.index):
            if c in values:
                may = may & (F.col(f"least_{k}") <= F.lit(values[c])) & (F.col(f"most_{k}") >= F.lit(values[c]))
        if set(self.index) <= set(values):
            kinds = {f["name"]: f for f in self._list()["schema"]["fields"]}
            key = [F.lit(values[c]).cast(T.StructField.fromJson(kinds[c]).dataType) for c in self.index]
            for k, bit in enumerate(self.spark.range(1).select(*_bits(key)).first()):
                byte = F.conv(F.hex(F.substring(f"bits_{k}", bit // 8 + 1, 1)), 16, 10).cast("int")
                may = may & (byte.bitwiseAND(F.lit(1 << bit % 8)) != 0)
        told = self.spark.read.parquet(*sorted({there[f].toString() for f in known})).filter(may).select("file")
        live = tuple(f"/{f}/" for f in known)
        return found + sorted(r["file"] for r in told.collect() if any(f in r["file"] for f in live))

    def lookup(self, **values) -> DataFrame | None:
        """The rows with these values; files that can't have any stay closed."""
        told = self._list()
        if told["schema"] is None:
            return None
        schema, files = T.StructType.fromJson(told["schema"]), self.files_for(values)
        rows = self.spark.createDataFrame([], schema)
        if files:
            whole = T.StructType([*schema.fields, T.StructField("batch", T.StringType())])
            rows = self.spark.read.schema(whole).option("basePath", self.path).parquet(*files).select(*schema.names)
        for c, v in values.items():
            rows = rows.filter(F.col(c) == F.lit(v))
        return rows

    # -- changes

    def _ordered(self, df: DataFrame, schema: T.StructType | None) -> DataFrame:
        return df if schema is None else df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])

    def append(self, df: DataFrame) -> int:
        """K4, K5, K14."""
        at, told = self.version(), self._list()
        schema = df.schema if told["schema"] is None else T.StructType.fromJson(told["schema"])
        return self._commit(at, schema, told["folders"] + self._write(self._ordered(df, schema)))

    def overwrite(self, df: DataFrame) -> int:
        """All rows anew."""
        at = self.version()
        return self._commit(at, df.schema, self._write(df))

    def overwrite_partitions(self, df: DataFrame) -> int:
        """The partitions that `df` has rows of, anew."""
        at, told = self.version(), self._list()
        new = self._write(self._ordered(df, T.StructType.fromJson(told["schema"]) if told["schema"] else None))
        gone = set(map(self._partitions, new))
        return self._commit(at, df.schema if told["schema"] is None else T.StructType.fromJson(told["schema"]), [f for f in told["folders"] if self._partitions(f) not in gone or not self.partition_by] * bool(self.partition_by) + new)

    def insert_absent(self, df: DataFrame, keys: tuple[str, ...], not_before: str | None = None) -> int:
        """K3, K7: rows whose keys the table lacks; of rows with equal keys in `df` one. First writer wins, replays change nothing.

        Where the keys hold the partition columns, only the partitions of the new rows can have them. Else all
        partitions are asked for the keys, or, for a table that is partitioned by a date, those from the first date of
        `not_before` on (a column of `df`; no row is ever stored under an earlier date than its own, up to a day).
        """
        new = df.dropDuplicates(list(keys))
        at, told = self.version(), self._list()
        if told["schema"] is None:
            return self._commit(at, df.schema, self._write(new))
        schema = T.StructType.fromJson(told["schema"])
        if set(self.partition_by) <= set(keys):
            have = self._touched(df, told["folders"], schema)  # repeats touch the same partitions
        else:
            have = self._since(df, not_before, told["folders"], schema)
        if have is not None:
            new = new.join(have.select(*keys), list(keys), "left_anti")
        return self._commit(at, schema, told["folders"] + self._write(self._ordered(new, schema)))

    def _since(self, df: DataFrame, not_before: str | None, folders: list[str], schema: T.StructType) -> DataFrame | None:
        """The table's rows under dates from the first of `not_before` on (a day less, for clocks and zones); all rows without that."""
        if not folders:
            return None
        have = self._frame(schema, folders)
        least = df.agg(F.min(F.to_date(not_before))).first()[0] if not_before and len(self.partition_by) == 1 else None
        return have if least is None else have.filter(F.col(self.partition_by[0]) >= F.lit(least - timedelta(days=1)))

    def _touched(self, df: DataFrame, folders: list[str], schema: T.StructType) -> DataFrame | None:
        """The table's rows in the partitions that `df` touches."""
        if not folders:
            return None
        have = self._frame(schema, folders)
        if not self.partition_by:
            return have
        values = df.select(*self.partition_by).distinct()
        return have.join(F.broadcast(values), list(self.partition_by), "left_semi")  # one row a partition

    def _replace(self, df: DataFrame, merge) -> int:
        """Rewrite the touched partitions (all of an unpartitioned table) with merge(old rows or None, df)."""
        at, told = self.version(), self._list()
        if told["schema"] is None:
            return self._commit(at, df.schema, self._write(merge(None, df)))
        schema = T.StructType.fromJson(told["schema"])
        new = self._write(self._ordered(merge(self._touched(df, told["folders"], schema), df), schema))
        if not self.partition_by:
            return self._commit(at, schema, new)
        gone = set(map(self._partitions, new))
        return self._commit(at, schema, [f for f in told["folders"] if self._partitions(f) not in gone] + new)

    def delete_insert(self, df: DataFrame, keys: tuple[str, ...]) -> int:
        """Rows with the keys of `df` go, the rows of `df` come. Keys must not move between partitions."""
        return self._replace(df, lambda old, new: new if old is None else old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new))

    def upsert(self, df: DataFrame, keys: tuple[str, ...], keep: tuple[str, ...] = (), prefer_new: tuple[str, ...] = ()) -> int:
        """K8, K9: new rows replace old ones by key. `keep`: columns that keep the old value; `prefer_new`: the new value unless it is null."""

        def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
            if old is None:
                return new
            o, n = old.withColumn("_o", F.lit(True)).alias("o"), new.withColumn("_n", F.lit(True)).alias("n")
            both = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")

            def value(c: str) -> F.Column:
                a, b, is_new, is_old = F.col(f"o.{c}"), F.col(f"n.{c}"), F.col("n._n").isNotNull(), F.col("o._o").isNotNull()
                if c in keep:
                    return F.when(is_old, a).otherwise(b)
                return F.coalesce(b, a) if c in prefer_new else F.when(is_new, b).otherwise(a)

            return both.select(*[value(c).alias(c) for c in new.columns])

        return self._replace(df, merge)

    # -- maintenance

    def compact(self, target_files: int = 1) -> dict[str, int]:
        """Partitions that lie in more than `target_files` folders or files become that many files."""
        at, told = self.version(), self._list()
        if told["schema"] is None:
            return {"removed": 0, "added": 0}
        schema = T.StructType.fromJson(told["schema"])
        files = {f: sum(s.getPath().getName().endswith(".parquet") for s in self._fs.listStatus(self._path(f"{self.path}/{f}"))) for f in told["folders"]}
        by: dict[str, list[str]] = {}
        for f in told["folders"]:
            by.setdefault(self._partitions(f), []).append(f)
        parts = {p: own for p, own in by.items() if sum(files[f] for f in own) > target_files}
        many = [f for own in parts.values() for f in own]
        if not many:
            return {"removed": 0, "added": 0}
        new = self._write_each(schema, parts, target_files) if self.partition_by else self._write(self._frame(schema, many).coalesce(target_files))
        self._commit(at, schema, [f for f in told["folders"] if f not in set(many)] + new)
        return {"removed": sum(files[f] for f in many), "added": len(new)}

    def vacuum(self, hours: float = 168.0) -> int:
        """Folders that no list of the last `hours` names go, and so do older lists. Returns how many folders went."""
        versions, now = self._versions(), time.time()
        if not versions:
            return 0
        lists = {v: self._list(v) for v in versions}
        current = versions[-1]
        # A list is in use until the one after it has been there for `hours`.
        live = {v for v in versions if v == current or now - lists[min(w for w in versions if w > v)]["at"] < hours * 3600}
        used = {f for v in live for f in lists[v]["folders"]}
        gone = 0
        for s in self._fs.listStatus(self._path(self.path)):
            name = s.getPath().getName()
            if not name.startswith("batch="):
                continue
            old = now - s.getModificationTime() / 1000 >= hours * 3600
            mine = {f for v in versions for f in lists[v]["folders"] if f.partition("/")[0] == name}
            for f in mine - used:
                gone += bool(self._fs.delete(self._path(f"{self.path}/{f}"), True))
            if not mine & used and (mine or old):
                self._fs.delete(s.getPath(), True)
        for v in set(versions) - live:
            self._fs.delete(self._path(f"{self.path}/_lists/{v}.json"), False)
        return gone
