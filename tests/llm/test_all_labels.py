import random
import zlib

from tidegrid.llm import quality, registry


def test_quality_cut_is_the_quantile_of_all_labelled_rows(spark, tmp_path):
    """More labelled rows than a sample would take, noisy labels: as many rows lie below the cut as have label 0, less the one at it."""
    r = random.Random(2)
    docs, labels = [], []
    for k in range(6000):
        good = r.random() < 0.3
        words = [r.choice(("tree", "water", "stone", "red", "blue")) for _ in range(r.randint(5, 40))]
        words += ["$$"] * r.randint(0, 6 if good else 12)
        docs.append((k, " ".join(words) + f" {k}"))
        labels.append((k, int(good)))
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    told = {x["doc_id"]: x["score"] for x in registry.op8_quality(spark, str(tmp_path)).collect()}
    taught = [(told[k], y) for k, y in labels if zlib.crc32(str(k).encode()) % 5 != 0]
    zeros = sum(1 - y for _, y in taught)
    cut = sorted(s for s, _ in taught)[zeros - 1]
    assert abs(cut - quality.CUT) < 1e-9


def test_every_labelled_row_is_in_pairs(spark):
    rows = spark.createDataFrame([(k, [float(k)] * len(quality.NAMES), int(k % 4 == 0)) for k in range(400)], "doc_id bigint, x array<double>, y int")
    for flip in (False, True):
        told = quality._pairs(rows.withColumn("y", 1 - rows["y"]) if flip else rows, *((100, 300) if flip else (300, 100))).collect()
        won, lost = [int(x["won"][0]) for x in told], [int(x["lost"][0]) for x in told]
        assert {k % 4 == 0 for k in won} == {not flip} and {k % 4 == 0 for k in lost} == {flip}
        assert set(won) | set(lost) == set(range(400)) and len(set(zip(won, lost))) == len(told) == 300 * 67


def test_one_label_or_none_is_flat(spark):
    rows = spark.createDataFrame([(1, [1.0] * len(quality.NAMES), 1), (2, [2.0] * len(quality.NAMES), 1)], "doc_id bigint, x array<double>, y int")
    assert quality.fit_all(rows).flat == 1 and quality.fit_all(rows.limit(0)).flat == 0
