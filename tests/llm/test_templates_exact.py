"""Items that repeat themselves: the queries find them with other values, as their SQL does."""

import random
import time

import duckdb

import corpus_pipeline
from tidegrid.llm import registry, templates


def tables(spark, path, docs, items):
    spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")


def rows_of(n):
    return " ".join(f"row {a} has {b} points" for a, b in n)


def test_tables_with_other_values_equal_sql(spark, tmp_path):
    item = rows_of([(k, k + 50) for k in range(20)])
    other = rows_of([(k + 100, k + 250) for k in range(20)])
    mixed = rows_of([(k % 2, 7) for k in range(20)])  # values that don't stand one to one
    r = random.Random(1)
    numbers, long = ([str(x) for x in r.sample(range(1000, 99_999), n)] for n in (60, 500))
    docs = [f"so {item} .", other, mixed, " ".join(numbers), " ".join(long), "the seven of them went home and had tea"]
    items = [item, " ".join(numbers)]
    tables(spark, tmp_path, docs, items)
    told = sorted(tuple(x) for x in registry.op10_templates(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert [x[:2] for x in told] == [(0, 0), (1, 0), (3, 1), (4, 1)]
    assert told == sorted(con.sql(templates.sql()).fetchall())
    kept = corpus_pipeline.keep_clean(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    assert sorted(x["doc_id"] for x in kept) == [2, 5]


def test_exact_way_ends_on_long_tables(spark, tmp_path):
    r = random.Random(1)
    item = " ".join(str(r.randrange(1000, 9999)) for _ in range(60))
    tables(spark, tmp_path, [" ".join(str(r.randrange(1000, 9999)) for _ in range(5000))], [item])
    began = time.perf_counter()
    assert [(x["doc_id"], x["exact"]) for x in registry.op10_templates(spark, str(tmp_path)).collect()] == [(0, False)]
    print("seconds", time.perf_counter() - began)


def test_short_items_are_found_in_longer_documents(spark, tmp_path):
    tables(spark, tmp_path, ["Yes", "he said yes and yes", "yesterday", None, "so in 1999 it was"], ["yes", "In 1987", None, "it was"])
    told = sorted((x["doc_id"], x["item_id"], x["exact"]) for x in registry.op10_templates(spark, str(tmp_path)).collect())
    assert told == [(0, 0, True), (1, 0, True), (4, 1, False), (4, 3, True)]
