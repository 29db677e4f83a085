"""Values counted once give the same edges and shares, and compaction takes each partition by itself."""

from tidegrid.operators.tables import Table
from tidegrid.plans import features
from tidegrid.session import work_dir


def test_counted_values_give_the_same_edges_and_shares(spark):
    values = spark.createDataFrame([("a", float(k * k % 17)) for k in range(200)] + [("b", 1.0)] * 3, "feature string, value double")
    told = []
    for v in (values, features.counted(values), features.counted(features.counted(values))):
        edges = features.edges(v, names=("a", "b"))
        told.append(sorted(map(tuple, features.shares(v, edges).collect())))
    assert told[0] == told[1] == told[2]


def test_compaction_doesnt_send_all_partitions_to_one_task(spark, monkeypatch):
    table = Table(spark, work_dir(spark), ("p",))
    for k in range(2):
        table.append(spark.createDataFrame([(k, "x y"), (k + 10, "z=1"), (k + 20, None)], "id long, p string"))
    want = sorted(map(str, table.read().collect()))
    monkeypatch.setattr(table, "_write", None)  # it sorts all partitions of a task
    assert table.compact() == {"removed": 6, "added": 3} and sorted(map(str, table.read().collect())) == want
    assert table.compact() == {"removed": 0, "added": 0}
