"""Time-ordered target encoding: what was returned before a line was sold, by the lines of other folds.

Lines are pre-aggregated by sale, item and vendor and get their sale's time, client and fold. Times are cut into chunks
of about equal numbers of lines. A chunk's lines of one value of a column make a vector of fixed width: FOLDS counts of
lines and FOLDS of returned ones. A prefix scan over the chunks gives each value its vector of all earlier chunks; inside
a chunk the vectors of each key and time are scanned in memory. Both together are the latest strictly earlier vector, and
the probe takes its total minus its own fold's part. Attributes (kind, nation, segment) and all history are scanned in
the same way, their vectors summed up from those of the ids that have them.

A value's rows in the scan over chunks are as many as the chunks that have it, however hot it is. A time of more lines than
a chunk should have (a hot sale) is a chunk of its own, and as its lines don't precede each other, they are dealt into
as many parts as it would fill. So no task gets more than about a chunk of lines and the vectors of what they hold; only
the chunks' bounds, some numbers for each partition, go through the driver.

Null item_id and client_id become -1; null vendor_id is one value of its own. Lines without a sale (null sale_id, too) or
whose sale has no time are dropped. Repeated lines count as often as they are there; so do lines of a repeated sale, once
for each of its rows. Of an id with several attributes the least counts; null and unknown ones are one value. Lines
without a flag aren't returned. Empty tables give empty results (an empty attribute table: all unknown); other columns
are never looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, map_batches, stage

FOLDS = 5
#: Rows of history that a prior counts for, and the first prior, of a million.
WEIGHT = 50
FIRST = 500_000
#: Chunks for each of the session's shuffle partitions, so that tasks are even; and lines of a chunk at most, about.
CHUNKS = 4
LINES = 250_000
VECTOR = [f"{c}{k}" for c in ("n", "s") for k in range(FOLDS)]
KINDS = ITEM, VENDOR, CLIENT = range(3)
NAMES = ("item", "vendor", "client")
#: What a vector is of: all history, an attribute's value, an id.
ALL, GROUP, ID = range(3)
LINE = "sale_id long, item_id long, vendor_id long, client_id long, at long, fold int, n long, s long"
OUT = "sale_id long, item_id long, vendor_id long, n_lines long, n_returned long, item_n long, item_rate long, vendor_n long, vendor_rate long, client_n long, client_rate long"


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds of a time; of one without a zone in no zone at all."""
    if dict(df.dtypes)[name] == "timestamp":
        return F.unix_micros(name)
    seconds = F.unix_date(F.to_date(name)) * F.lit(86_400).cast("long") + F.hour(name) * 3600 + F.minute(name) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), name) * 1_000_000).cast("long")


def own_lines(lines: DataFrame, sales: DataFrame) -> DataFrame:
    """sale_id, item_id, vendor_id, client_id, at, fold, n, s of each distinct line of a sale."""
    returned = F.count(F.when(F.col("flag") == "returned", 1))
    item = F.coalesce("item_id", F.lit(-1)).cast("long").alias("item_id")
    told = lines.filter("sale_id is not null").groupBy("sale_id", item, F.col("vendor_id").cast("long").alias("vendor_id")).agg(F.count("*").alias("n"), returned.alias("s"))
    sold = sales.filter("sold_at is not null").select("sale_id", F.coalesce("client_id", F.lit(-1)).cast("long").alias("client_id"), micros(sales, "sold_at").alias("at"), fold("sale_id", FOLDS).cast("int").alias("fold"))
    return told.join(sold, "sale_id").select(*[c.split()[0] for c in LINE.split(", ")])


def _attributes(items: DataFrame, vendors: DataFrame, clients: DataFrame) -> DataFrame:
    told = None
    for kind, df, key, value in ((ITEM, items, "item_id", "kind"), (VENDOR, vendors, "vendor_id", "nation_id"), (CLIENT, clients, "client_id", "segment")):
        one = df.filter(F.col(key).isNotNull()).select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), F.col(value).cast("string").alias("grp"))
        told = one if told is None else told.unionByName(one)
    return told.groupBy("kind", "id").agg(F.min("grp").alias("grp"))


def bounds(own: DataFrame, chunks: int) -> list[int]:
    """Upper bounds of the chunks: quantiles of the lines' times. A time that fills several chunks is told as often."""
    if chunks < 2:
        return []
    told = own.agg(F.percentile_approx("at", [k / chunks for k in range(1, chunks)], max(10_000, 20 * chunks))).first()[0]
    return told or []


def chunked(own: DataFrame, upper: list[int]) -> DataFrame:
    """`own` with chunk and part: chunks are in the order of time; only a chunk of one time has more than one part."""
    schema = LINE + ", chunk int, part int"

    def make():
        times, often = np.unique(np.array(upper, np.int64), return_counts=True)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            at = batch.column("at").to_numpy()
            k = np.searchsorted(times, at)
            near = np.minimum(k, max(0, len(times) - 1))
            parts = np.where((k < len(times)) & (times[near] == at), often[near], 1) if len(times) else np.ones(len(at), np.int64)
            mixed = batch.column("item_id").to_numpy() * 7919 + batch.column("vendor_id").fill_null(-1).to_numpy() * 104_729 + batch.column("sale_id").to_numpy()
            own = [pa.array((2 * k + (parts > 1)).astype(np.int32)), pa.array(((mixed ^ (mixed >> 7)) % parts).astype(np.int32))]
            return pa.RecordBatch.from_arrays([*batch.columns, *own], [c.split()[0] for c in schema.split(", ")])

        return work

    return map_batches(own, make, schema)


def carried(dealt: DataFrame, attributes: DataFrame) -> DataFrame:
    """chunk, part, level, kind, grp, id, and the vector of all earlier chunks, of all that the lines of that part hold."""
    ways = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{name}_id").alias("id")) for k, name in enumerate(NAMES)])
    pivoted = [F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for c in ("n", "s") for k in range(FOLDS)]
    ids = dealt.select(F.inline(ways), "chunk", "part", "fold", "n", "s").groupBy("kind", "id", "chunk", "part").agg(*pivoted)
    ids = stage(ids.join(attributes, ["kind", "id"], "left").select("kind", "grp", "id", "chunk", "part", *VECTOR), "vectors")
    sums = [F.sum(c).alias(c) for c in VECTOR]
    groups = stage(ids.groupBy("kind", "grp", "chunk", "part").agg(*sums), "groups")
    whole = groups.filter(F.col("kind") == ITEM).groupBy("chunk", "part").agg(*sums)

    def before(df: DataFrame, level: int, *key: str) -> DataFrame:
        w = Window.partitionBy(*key).orderBy("chunk").rangeBetween(Window.unboundedPreceding, -1)
        there = [F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in (("kind", "int"), ("grp", "string"), ("id", "long"))]
        return df.select("chunk", "part", F.lit(level).alias("level"), *there, *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in VECTOR])

    return before(ids, ID, "kind", "id").unionByName(before(groups, GROUP, "kind", "grp")).unionByName(before(whole, ALL))


def _history(code: np.ndarray, at: np.ndarray, fold_of: np.ndarray, n: np.ndarray, s: np.ndarray, carry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n and s of other folds' lines of the same code, strictly earlier: the carry and the scan of the chunk's own vectors."""
    rows = np.arange(len(code))
    order = np.lexsort((at, code))
    c, t, f = code[order], at[order], fold_of[order]
    own = np.zeros((len(code), 2 * FOLDS), np.int64)
    own[rows, f], own[rows, FOLDS + f] = n[order], s[order]
    before = np.cumsum(own, axis=0) - own
    new = np.concatenate(([True], c[1:] != c[:-1]))
    later = new | np.concatenate(([True], t[1:] != t[:-1]))
    first, key = (np.maximum.accumulate(np.where(x, rows, 0)) for x in (later, new))
    told = carry[c] + before[first] - before[key]
    out = np.empty((2, len(code)), np.int64)
    out[0, order] = told[:, :FOLDS].sum(axis=1) - told[rows, f]
    out[1, order] = told[:, FOLDS:].sum(axis=1) - told[rows, FOLDS + f]
    return out[0], out[1]


def _rate(n: np.ndarray, s: np.ndarray, prior: np.ndarray) -> np.ndarray:
    return np.where(n < 1, prior, (1_000_000 * s + WEIGHT * prior) // (n + WEIGHT))


def _codes(values: pa.ChunkedArray, among: pa.ChunkedArray) -> np.ndarray:
    """Places of `values` in `among`, nulls too."""
    null = pa.compute.index(among.is_null(), True).as_py()
    return pa.compute.index_in(values, value_set=among).fill_null(max(0, null)).to_numpy()


def solved(lines: pa.Table, earlier: pa.Table) -> pa.Table:
    """The result for a part's lines from the vectors that are carried to it."""
    at, fold_of, n, s = (lines.column(c).to_numpy() for c in ("at", "fold", "n", "s"))
    level, kind = earlier.column("level").to_numpy(), earlier.column("kind").fill_null(-1).to_numpy()
    pick = lambda rows: earlier.filter(pa.array(rows))
    vectors = lambda t: np.column_stack([t.column(c).to_numpy() for c in VECTOR])
    whole = _rate(*_history(np.zeros(len(at), np.int64), at, fold_of, n, s, vectors(pick(level == ALL))), np.full(len(at), FIRST))
    out = [lines.column(c) for c in ("sale_id", "item_id", "vendor_id", "n", "s")]
    for k, name in enumerate(NAMES):
        ids, groups = pick((level == ID) & (kind == k)), pick((level == GROUP) & (kind == k))
        code = _codes(lines.column(f"{name}_id"), ids.column("id"))
        group = _codes(ids.column("grp"), groups.column("grp"))[code]
        prior = _rate(*_history(group, at, fold_of, n, s, vectors(groups)), whole)
        its_n, its_s = _history(code, at, fold_of, n, s, vectors(ids))
        out += [pa.array(its_n), pa.array(_rate(its_n, its_s, prior))]
    return pa.table(out, names=[c.split()[0] for c in OUT.split(", ")])


def encode(lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame, chunks: int | None = None) -> DataFrame:
    """sale_id, item_id, vendor_id, n_lines, n_returned, and n and rate of the history of item, vendor and client. chunks: by default CHUNKS for each shuffle partition, or as many as LINES asks for."""
    own = stage(own_lines(lines, sales), "lines")
    attributes = stage(_attributes(items, vendors, clients), "attributes")
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = chunks or max(CHUNKS * parts, own.count() // LINES)
    dealt = stage(chunked(own, bounds(own, chunks)).repartition(parts, "chunk", "part"), "dealt")
    earlier = stage(carried(dealt, attributes), "carried")
    return dealt.groupBy("chunk", "part").cogroup(earlier.groupBy("chunk", "part")).applyInArrow(solved, OUT)


def sql() -> str:
    """The same by window sums over key and time. crc32 is linear: the digits' parts by their distance from the end, and zeros of that length."""
    zeros = lambda n: zlib.crc32(bytes(n))
    parts = ", ".join(f"({k}, '{d}', {zlib.crc32(str(d).encode() + bytes(k)) ^ zeros(k + 1)})" for k in range(19) for d in range(10))
    lengths = ", ".join(f"({n}, {zeros(n)})" for n in range(1, 20))
    columns = {"item": ("item_id", "kind"), "vendor": ("vendor_id", "nation"), "client": ("client_id", "segment")}

    def scan(name: str, key: str) -> str:
        return f"""{name}_f AS (SELECT {key} AS k, t, fold, sum(n) AS n, sum(s) AS s FROM base GROUP BY ALL),
{name}_t AS (SELECT k, t, sum(n) AS n, sum(s) AS s FROM {name}_f GROUP BY ALL),
{name}_a AS (SELECT k, t, coalesce(sum(n) OVER w, 0) AS n, coalesce(sum(s) OVER w, 0) AS s FROM {name}_t WINDOW w AS (PARTITION BY k ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_b AS (SELECT k, t, fold, coalesce(sum(n) OVER w, 0) AS n, coalesce(sum(s) OVER w, 0) AS s FROM {name}_f WINDOW w AS (PARTITION BY k, fold ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_h AS (SELECT b.k, b.t, b.fold, CAST(a.n - b.n AS BIGINT) AS n, CAST(a.s - b.s AS BIGINT) AS s FROM {name}_b b JOIN {name}_a a ON a.k IS NOT DISTINCT FROM b.k AND a.t = b.t)"""

    def rate(n: str, s: str, p: str) -> str:
        return f"CASE WHEN {n} < 1 THEN {p} ELSE (1000000 * {s} + {WEIGHT} * {p}) // ({n} + {WEIGHT}) END"

    joins, rates, chosen = [], [], []
    for name, (key, group) in columns.items():
        joins.append(f"JOIN {name}_h {name} ON {name}.k IS NOT DISTINCT FROM b.{key} AND {name}.t = b.t AND {name}.fold = b.fold JOIN {group}_h {group} ON {group}.k IS NOT DISTINCT FROM b.{group} AND {group}.t = b.t AND {group}.fold = b.fold")
        rates.append(f"{name}.n AS {name}_n, {name}.s AS {name}_s, {rate(f'{group}.n', f'{group}.s', 'p')} AS {name}_p")
        chosen.append(f"{name}_n, CAST({rate(f'{name}_n', f'{name}_s', f'{name}_p')} AS BIGINT) AS {name}_rate")
    scans = ",\n".join(scan(name, key) for name, key in [("whole", "1"), *[(n, k) for n, (k, _) in columns.items()], *[(g, g) for _, g in columns.values()]])
    return f"""
WITH digits AS (SELECT sale_id, CAST(sale_id AS VARCHAR) AS d, unnest(range(length(CAST(sale_id AS VARCHAR)))) AS i FROM (SELECT DISTINCT sale_id FROM sales WHERE sold_at IS NOT NULL)),
crcs AS (SELECT sale_id, bit_xor(v) AS v, max(length(d)) AS n FROM digits JOIN (VALUES {parts}) AS p(k, c, v) ON k = length(d) - 1 - i AND c = d[i + 1] GROUP BY 1),
folds AS (SELECT sale_id, CAST(xor(crcs.v, z.v) % {FOLDS} AS INTEGER) AS fold FROM crcs JOIN (VALUES {lengths}) AS z(n, v) ON z.n = crcs.n),
sold AS (SELECT s.sale_id, coalesce(client_id, -1) AS client_id, sold_at AS t, fold FROM sales s JOIN folds ON folds.sale_id = s.sale_id WHERE sold_at IS NOT NULL),
base AS MATERIALIZED (SELECT l.sale_id, l.item_id, l.vendor_id, s.client_id, s.t, s.fold, l.n, l.s, i.kind, v.nation, c.segment
FROM (SELECT sale_id, coalesce(item_id, -1) AS item_id, vendor_id, count(*) AS n, count(*) FILTER (WHERE flag = 'returned') AS s FROM sale_lines GROUP BY ALL) l JOIN sold s ON s.sale_id = l.sale_id
LEFT JOIN (SELECT item_id, min(kind) AS kind FROM items GROUP BY 1) i ON i.item_id = l.item_id LEFT JOIN (SELECT vendor_id, min(nation_id) AS nation FROM vendors GROUP BY 1) v ON v.vendor_id = l.vendor_id LEFT JOIN (SELECT client_id, min(segment) AS segment FROM clients GROUP BY 1) c ON c.client_id = s.client_id),
{scans},
told AS (SELECT b.sale_id, b.item_id, b.vendor_id, b.n, b.s, {", ".join(rates)}
FROM (SELECT b.*, {rate("w.n", "w.s", str(FIRST))} AS p FROM base b JOIN whole_h w ON w.t = b.t AND w.fold = b.fold) b {" ".join(joins)})
SELECT sale_id, item_id, vendor_id, n AS n_lines, s AS n_returned, {", ".join(chosen)} FROM told"""
