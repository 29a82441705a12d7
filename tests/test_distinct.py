"""``distinct`` over columns keeps the first row, however rows are dealt."""

import pytest
from pyspark.sql import functions as F

import semloom as sl
from semloom.operators.relational import with_places



class Falling(sl.IterDataset):
    def __init__(self):
        super().__init__("falling", [{"name": "id", "type": int, "desc": ""}, {"name": "k", "type": int, "desc": ""}])

    def __len__(self):
        return 2000

    def __getitem__(self, i):
        return {"id": 1999 - i, "k": i % 5}


PLAIN = sl.QueryProcessorConfig(optimizer_strategy="none")


def kept(data):
    return sorted((r["k"], r["id"]) for r in data.distinct("k").run(PLAIN).df.collect())


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_first_rows(spark, tmp_path, partitions):
    df = spark.range(2000).select("id", (F.col("id") % 5).alias("k"))
    assert kept(sl.FrameDataset(df.repartition(partitions), f"f{partitions}")) == [(i, i) for i in range(5)]
    falling = [{"id": 1999 - i, "k": i % 5} for i in range(2000)]
    assert kept(sl.MemoryDataset("m", falling)) == [(i, 1999 - i) for i in range(5)]
    assert kept(Falling()) == [(i, 1999 - i) for i in range(5)]
    path = f"{tmp_path}/t"
    spark.createDataFrame([(r["id"], r["k"]) for r in falling], "id long, k long").coalesce(1).write.parquet(path)
    filed = spark.read.parquet(path)
    for frame in (filed, filed.repartition(partitions), filed.repartition(partitions, "k")):
        assert kept(sl.FrameDataset(frame)) == [(i, 1999 - i) for i in range(5)]
    chained = sl.FrameDataset(filed.repartition(partitions)).filter(lambda r: r["id"] < 1990).map(lambda r: {"twice": 2 * r["id"]}, [{"name": "twice", "type": int, "desc": ""}]).project(["k", "twice"])
    rows = chained.distinct("k").run(PLAIN).df
    assert sorted(rows.columns) == ["k", "twice"]
    assert sorted((r["k"], r["twice"]) for r in rows.collect()) == [(i, 2 * (1989 - i)) for i in range(5)]


def test_maps_and_nulls_have_an_order(spark):
    df = spark.createDataFrame([(1, None, {"a": 2}), (1, None, {"a": 1}), (None, 3, None), (None, 2, None)], "k long, v long, m map<string,long>")
    rows = sl.FrameDataset(df.repartition(4), "x").distinct("k").run(PLAIN).df.collect()
    assert sorted([(r["k"], r["v"], r["m"]) for r in rows], key=repr) == sorted([(1, None, {"a": 1}), (None, 2, None)], key=repr)


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_places_count_all_rows(spark, partitions):
    df = spark.range(100).repartition(partitions)
    assert sorted(r["at"] for r in with_places(df, "at").collect()) == list(range(100))
    assert with_places(df.limit(0), "at").count() == 0
