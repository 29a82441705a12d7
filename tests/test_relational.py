import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import semloom as sl
from semloom.operators import relational

PEOPLE = pd.DataFrame({"person_id": [1, 1, 2, 3, 4], "name": ["Alice", "Alice", "Bob", "Bob", "Charlie"], "age": [25, 25, 30, 30, 35]})
ORDERS = [
    {"order_id": 1, "customer_id": 101, "items": ["a", "b"], "item_amounts": [100.0, 150.0]},
    {"order_id": 2, "customer_id": 102, "items": ["c", "d"], "item_amounts": [175.0, 200.0]},
    {"order_id": 3, "customer_id": 101, "items": ["e", "f"], "item_amounts": [100.0, 200.0]},
    {"order_id": 4, "customer_id": 103, "items": ["g", "h"], "item_amounts": [50.0, 60.0]},
    {"order_id": 5, "customer_id": 104, "items": ["i", "j"], "item_amounts": [80.0, 90.0]},
]


def rows(data, **kwargs):
    return [tuple(r) for r in data.run(**kwargs).df.collect()]


def test_distinct_limit_filter(spark):
    people = sl.MemoryDataset("people", PEOPLE)
    assert len(people.distinct().run()) == 4
    assert len(people.distinct(["name", "age"]).run()) == 3
    assert len(people.distinct(["name", "age"]).limit(2).run()) == 2
    assert rows(people.distinct(["name", "age"]).filter(lambda r: r["age"] > 30)) == [(4, "Charlie", 35)]
    assert (2, "Bob", 30) in rows(people.distinct(["name", "age"]))  # the first of its rows
    with pytest.raises(AssertionError):
        people.distinct(["nobody"])


def test_map_and_flat_map(spark):
    orders = sl.MemoryDataset("orders", ORDERS)
    total = orders.map(lambda r: {"total": sum(r["item_amounts"])}, [{"name": "total", "type": float, "desc": ""}])
    assert dict(rows(total.project(["order_id", "total"]))) == {1: 250, 2: 375, 3: 300, 4: 110, 5: 170}
    each = orders.flat_map(lambda r: [{"item": i, "amount": a} for i, a in zip(r["items"], r["item_amounts"], strict=True)], [{"name": "item", "type": str, "desc": ""}, {"name": "amount", "type": float, "desc": ""}])
    assert len(each.run()) == 10
    none = orders.flat_map(lambda r: [], [{"name": "x", "type": int, "desc": ""}])
    assert [r["x"] for r in none.run()] == [None] * 5
    kept = orders.map(lambda r: {"order_id": -1, "y": 1}, [{"name": "order_id", "type": int, "desc": ""}, {"name": "y", "type": int, "desc": ""}])
    assert sorted(r["order_id"] for r in kept.run()) == [1, 2, 3, 4, 5]  # existing values stay
    assert len(orders.map(lambda r: {}).run()) == 5  # for the side effect
    with pytest.raises(Exception, match="KeyError"):
        orders.map(lambda r: {"z": 1}, [{"name": "y", "type": int, "desc": ""}]).run().df.collect()
    missing = orders.flat_map(lambda r: [{}], [{"name": "y", "type": int, "desc": ""}])
    assert {r["y"] for r in missing.run()} == {None}


def test_results_are_fitted_to_their_types(spark):
    rows = sl.MemoryDataset("r", [{"v": 1}, {"v": 2}])
    cols = [{"name": "i", "type": int, "desc": ""}, {"name": "s", "type": str, "desc": ""}, {"name": "l", "type": list[int], "desc": ""}]
    got = rows.map(lambda r: {"i": 2.0 if r["v"] == 1 else "many", "s": r["v"], "l": [r["v"], 2.0]}, cols).run()
    assert sorted(map(tuple, got.df.collect())) == [(1, 2, "1", [1, 2]), (2, None, "2", [2, 2])]
    nested = spark.createDataFrame([(1, {"a": 1}, [("x", 2)])], "k long, m map<string,int>, s array<struct<n:string,c:int>>")
    seen = sl.FrameDataset(nested).map(lambda r: {"i": r["m"]["a"] + r["s"][0]["c"], "s": "", "l": []}, cols).run().df.first()
    assert seen["i"] == 3


def test_joins(spark):
    orders = sl.MemoryDataset("orders", ORDERS).project(["order_id", "customer_id"])
    customers = sl.MemoryDataset("customers", [{"customer_id": c, "name": n} for c, n in ((101, "A"), (102, "B"), (103, "C"), (104, "D"), (105, "E"))])
    assert len(orders.join(customers, "customer_id").run()) == 5
    outer = rows(orders.join(customers, on="customer_id", how="outer"))
    assert len(outer) == 6 and (None, 105, "E") in outer
    with pytest.raises(ValueError, match="how"):
        orders.join(customers, "customer_id", how="sideways")
    assert len(customers.join(customers, "customer_id").run()) == 5


def test_join_nulls_nan_and_names(spark):
    a, b = spark.createDataFrame([(1,), (None,)], "k long"), spark.createDataFrame([(1,), (None,), (3,)], "k long")
    assert relational.join(a, b, ["k"]).count() == 2
    assert relational.join(a, b, ["k"], "outer").count() == 3
    nan = spark.createDataFrame([(float("nan"),), (1.0,)], "k double")
    assert relational.join(nan, nan, ["k"]).count() == 1
    left, right = spark.createDataFrame([(1, "l")], "k long, x string"), spark.createDataFrame([(2, "r")], "k long, x string")
    assert relational.join(left, right, ["k"], "outer").columns == ["k", "x", "x_right"]
    assert sorted(map(tuple, relational.join(left, right, ["k"], "outer").collect())) == [(1, "l", None), (2, None, "r")]
    assert "SortMergeJoin" in relational.join(a, b.hint("merge"), ["k"])._jdf.queryExecution().executedPlan().toString()


def test_group_by(spark):
    orders = sl.MemoryDataset("orders", ORDERS)
    assert dict(rows(orders.groupby(sl.GroupBySig(["customer_id"], ["sum"], ["item_amounts"])))) == {101: 550, 102: 375, 103: 110, 104: 170}
    df = spark.createDataFrame([("g", "a"), ("g", None), (None, "b")], "k string, x string")
    found = {r[0]: r for r in relational.group_by(df, sl.GroupBySig(["k"], ["list", "COUNT", "set"], ["x", "x", "x"])).collect()}
    assert sorted(found["g"][1], key=str) == [None, "a"] and found["g"]["COUNT(x)"] == 2 and found[None]["COUNT(x)"] == 1
    nothing = spark.createDataFrame([("g", None)], "k string, v long")
    assert tuple(relational.group_by(nothing, sl.GroupBySig(["k"], ["sum", "min", "average"], ["v", "v", "v"])).first()) == ("g", 0, None, None)
    assert relational.group_by(nothing.limit(0), sl.GroupBySig([], ["count"], ["v"])).count() == 0
    with pytest.raises(TypeError):
        sl.MemoryDataset("o", ORDERS).groupby(sl.GroupBySig(["nokey"], ["count"], ["order_id"]))
    with pytest.raises(TypeError):
        relational.group_by(spark.createDataFrame([(1, [1])], "k long, l array<long>"), sl.GroupBySig(["k"], ["average"], ["l"]))


def test_global_aggregates(spark):
    loose = spark.createDataFrame([("1",), ("x",), (None,)], "v string")
    assert relational.aggregate(loose, "average").first()[0] == 1.0
    assert relational.aggregate(loose, "sum").first()[0] == 1.0
    numbers = sl.MemoryDataset("n", [1, 2, 3])
    assert [rows(getattr(numbers, f)())[0][0] for f in ("count", "sum", "average", "min", "max")] == [3, 6, 2.0, 1, 3]
    empty = spark.createDataFrame([], "v long")
    assert [relational.aggregate(empty, f).first()[0] for f in ("count", "average", "sum")] == [0, None, None]
    with pytest.raises(AssertionError):
        sl.MemoryDataset("s", ["a"]).sum()
    with pytest.raises(AssertionError):
        sl.MemoryDataset("p", PEOPLE).min()


def test_filter_is_pushed_to_the_scan(spark, sf):
    orders = sl.FrameDataset(spark.read.parquet(f"{sf}/orders.parquet"))
    plan = orders.filter(F.col("o_orderkey") > 5, "o_orderkey").project(["o_orderkey"]).run().df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_orderkey,5)" in plan and "ReadSchema: struct<o_orderkey:bigint>" in plan


def test_project_keeps_schema_order_and_scan_slices(spark):
    people = sl.MemoryDataset("people", PEOPLE)
    assert people.project(["age", "x.name"]).schema.names == ["name", "age"]
    assert len(people.run(num_samples=2, scan_start_idx=1)) == 2
    with pytest.raises(TypeError):
        people.filter("text")
    assert isinstance(people.schema["age"].dataType, T.LongType)
    with pytest.warns(DeprecationWarning):
        people.add_columns(lambda r: {"z": 1}, [{"name": "z", "type": int, "desc": ""}])


def test_ids_are_stable(spark):
    a = sl.MemoryDataset("p", PEOPLE).filter(len).limit(3)
    b = sl.MemoryDataset("p", PEOPLE).filter(len).limit(3)
    assert a.id == b.id and a.get_limit() == 3
    assert len(a.get_upstream_datasets()) == 2
    assert len(a.node.unique_ids()) == 3
