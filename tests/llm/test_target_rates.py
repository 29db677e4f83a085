import random
import zlib
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import registry, target_rates

SCHEMAS = ("sale_id bigint, item_id bigint, vendor_id bigint, flag string", "sale_id bigint, client_id bigint, sold_at timestamp_ntz", "item_id bigint, kind string", "vendor_id bigint, nation_id int", "client_id bigint, segment string")


def brute(lines, sales, items, vendors, clients):
    least = lambda rows: {k: min((v for i, v in rows if i == k and v is not None), default=None) for k, _ in rows if k is not None}
    kind, nation, segment = least(items), least(vendors), least(clients)
    rows = []
    for sale, item, vendor, flag in lines:
        for s, client, at in sales:
            if sale is not None and s == sale and at is not None:
                i, c = (-1 if x is None else x for x in (item, client))
                rows.append(((sale, i, vendor), at, zlib.crc32(str(sale).encode()) % 5, flag == "returned", (i, vendor, c), (kind.get(i), nation.get(vendor), segment.get(c))))
    rate = lambda n, s, p: p if n < 1 else (1_000_000 * s + 50 * p) // (n + 50)
    out = {}
    for key, at, fold, returned, ids, groups in rows:
        if key in out:
            out[key][0] += 1
            out[key][1] += returned
            continue
        before = [r for r in rows if r[1] < at and r[2] != fold]
        sums = lambda rows: (len(rows), sum(r[3] for r in rows))
        first, figures = rate(*sums(before), 500_000), []
        for k in range(3):
            prior = rate(*sums([r for r in before if r[5][k] == groups[k]]), first)
            n, s = sums([r for r in before if r[4][k] == ids[k]])
            figures += [n, rate(n, s, prior)]
        out[key] = [1, int(returned), *figures]
    return sorted(((*k, *v) for k, v in out.items()), key=str)


def tables(spark, *rows):
    return [spark.createDataFrame(r, s).withColumn("chunk", F.lit("x")).withColumn("grp", F.lit(1)) for r, s in zip(rows, SCHEMAS)]


def made(seed, hot):
    r = random.Random(seed)
    maybe = lambda x: None if r.random() < 0.1 else x
    at = lambda: datetime(2024, 1, 1) + timedelta(minutes=r.randrange(40), microseconds=r.randrange(2))
    sales = [(k, maybe(r.randrange(6)), maybe(at())) for k in range(60)] + [(None, 1, at())]
    lines = [(None if r.random() < 0.03 else 7 if hot and r.random() < 0.5 else r.randrange(64), maybe(r.randrange(8)), maybe(r.randrange(4)), maybe(r.choice(("returned", "kept")))) for _ in range(300)]
    lines += lines[:40]
    items, vendors = [(k, maybe("abc"[k % 3])) for k in range(7)] + [(2, "a"), (None, "b")], [(k, maybe(k % 2)) for k in range(3)]
    return lines, sales, items, vendors, [(k, maybe("xy"[k % 2])) for k in range(4)] + [(-1, "y")]


@pytest.mark.parametrize("hot, chunks", [(False, 1), (False, 7), (True, 12)])
def test_equals_brute_force(spark, hot, chunks):
    """Ties in time, nulls everywhere, ids without attributes, a sale with half of all lines."""
    rows = made(3, hot)
    got = target_rates.encode(*tables(spark, *rows), chunks=chunks)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(*rows)


def test_hot_times_are_parted(spark):
    """Lines of one time are dealt into as many parts as they would fill, all with the same chunk."""
    rows = made(3, True)
    own = target_rates.own_lines(*tables(spark, *rows)[:2])
    told = target_rates.chunked(own, target_rates.bounds(own, 12)).groupBy("at", "chunk").agg(F.countDistinct("part").alias("parts")).collect()
    assert len({r["at"] for r in told}) == len(told) and max(r["parts"] for r in told) > 2
    assert [r["chunk"] for r in sorted(told, key=lambda r: r["at"])] == sorted(r["chunk"] for r in told)


def test_empty_tables(spark):
    rows = made(4, False)
    empty = [[]] * 5
    assert target_rates.encode(*tables(spark, *empty)).count() == target_rates.encode(*tables(spark, rows[0], *empty[1:])).count() == 0
    unknown = (rows[0], rows[1], [], [], [])
    assert sorted((tuple(r) for r in target_rates.encode(*tables(spark, *unknown)).collect()), key=str) == brute(*unknown)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("sale_lines", "sales", "items", "vendors", "clients"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    df = registry.op13_target_rates(spark, "/root/testdata/sf0.001")
    assert sorted(tuple(r) for r in df.collect()) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLE_SQL['op13_target_rates']})").fetchall())
