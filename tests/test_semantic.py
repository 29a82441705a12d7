import pytest
from hypothesis import given
from hypothesis import strategies as st

import semloom as sl
from semloom.operators.provider import Completion, LocalProvider, ModelProvider, Request
from semloom.operators.semantic import sem_agg, sem_join, thresholds
from semloom.operators.strategies import extracted, judged
from semloom.plans.physical import Implementation
from semloom.types import field

ANIMALS = [{"text": t, "age": i} for i, t in enumerate(("an elephant", "a lion", "a lion", "a bear"))]
OTHERS = [{"animal": t} for t in ("an elephant", "a giraffe", "a lion", "a zebra")]
SAME = LocalProvider({"same animal": lambda r: r["text"] == r["animal"]})
SINGLE = Implementation("single", ("local-large",))


def config(provider, **changes):
    return sl.QueryProcessorConfig(optimizer_strategy="none", provider=provider, **changes)


class Failing(ModelProvider):
    """Fails on some inputs, and counts its calls in a file."""

    def __init__(self, path):
        self.path = path

    def complete(self, requests):
        out = []
        for r in requests:
            if "bear" in str(r.inputs) and len(requests) > 1:
                raise RuntimeError("batch refused")
            with open(self.path, "a") as f:
                f.write("x\n")
            if "bear" in str(r.inputs):
                raise RuntimeError("no")
            out.append(Completion('ANSWER: {"kind": "cat"}\n---' if r.verb == "map" else "ANSWER: TRUE\n---", 10, 2, 0.1))
        return out


def test_failure_is_false_or_null(spark, tmp_path):
    failing = Failing(str(tmp_path / "calls"))
    data = sl.MemoryDataset("a", ANIMALS)
    assert len(data.sem_filter("x").run(config(failing))) == 3
    made = data.sem_map([{"name": "kind", "type": str, "desc": "k"}]).run(config(failing)).to_df()
    assert sorted(made.kind.fillna("-")) == ["-", "cat", "cat", "cat"]


def test_each_row_is_asked_once(spark, tmp_path):
    path = tmp_path / "calls"
    data = sl.MemoryDataset("a", [{"text": f"t{i}"} for i in range(20)])
    done = data.sem_filter("x", depends_on="text").map(lambda r: {"n": len(r["text"])}, [{"name": "n", "type": int, "desc": ""}]).filter(lambda r: r["n"] > 2, "n").run(config(Failing(str(path))))
    assert len(done) == 10 and len(done) == 10
    assert done.execution_stats.total_calls == 20
    assert len(path.read_text().split()) == 20
    assert done.execution_stats.plan_execution_cost > 0


def test_types_are_cast_or_null(spark):
    rules = LocalProvider({"n": lambda r: r["age"] if r["age"] < 2 else "many", "l": lambda r: "one", "b": lambda r: True})
    cols = [{"name": "n", "type": int, "desc": "n"}, {"name": "l", "type": list[str], "desc": "l"}, {"name": "b", "type": bool, "desc": "b"}]
    got = sl.MemoryDataset("a", ANIMALS).sem_map(cols).run(config(rules)).to_df().sort_values("age")
    assert got.n.fillna(-1).tolist() == [0, 1, -1, -1]
    assert got.b.tolist() == [True] * 4


def test_flat_map_without_answers_keeps_the_row(spark):
    rules = LocalProvider({"parts": lambda r: [{"p": x} for x in r["text"].split()] if r["age"] else []})
    got = sl.MemoryDataset("a", ANIMALS).sem_flat_map([{"name": "p", "type": str, "desc": ""}], desc="parts").run(config(rules))
    assert len(got) == 7
    assert sum(r["p"] is None for r in got) == 1
    assert got.execution_stats.total_calls == 4


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_nested_join(spark, how):
    got = [tuple(r) for r in sl.MemoryDataset("l", ANIMALS).sem_join(sl.MemoryDataset("r", OTHERS), "same animal", how=how).run(config(SAME)).df.collect()]
    assert sum(a is not None and b is not None for a, _, b in got) == 3
    assert len(got) == {"inner": 3, "left": 4, "right": 5, "outer": 6}[how]


def test_embedding_join_judges_fewer_pairs(spark):
    left, right = spark.createDataFrame(ANIMALS, "text string, age long"), spark.createDataFrame(OTHERS, "animal string")
    impl = Implementation("embedding", ("local-large",), (("embedder", "local-embed"), ("samples", 8)))
    out, pairs = sem_join(left, right, "same animal", "inner", SAME, impl, ["text", "animal"])
    assert out.count() == 3
    assert 8 <= pairs.count() <= 12 and pairs.agg({"calls": "max"}).first()[0] == 1  # three different texts on the left, four on the right


@given(st.lists(st.tuples(st.floats(-1, 1), st.booleans()), max_size=12))
def test_thresholds(sample):
    low, high = thresholds(sample)
    assert all(not m for s, m in sample if s < low)
    assert all(m for s, m in sample if s > high)


def test_strategies():
    requests = [Request("filter", "has 'lion'", {"text": "x" * 10 + " lion " + "grass " * 6}), Request("filter", "has 'lion'", {"text": "short"})]
    for impl in (SINGLE, Implementation("rag", ("local-large",), (("embedder", "local-embed"), ("keep", 1), ("size", 40))), Implementation("split", ("local-large",), (("chunks", 2), ("least", 20))), Implementation("mixture", ("local-large", "local-small", "local-large"), (("temperature", 0.0),)), Implementation("critique", ("local-large", "local-small", "local-large"))):
        answers, spent = judged(LocalProvider(), impl, requests)
        assert answers == [True, False], impl
        assert all(s.calls >= 1 for s in spent)
    assert judged(LocalProvider(), Implementation("mixture", ("local-large", "local-small", "local-large")), requests)[1][0].calls == 3


def test_missing_fields_are_asked_again():
    class Partial(ModelProvider):
        def complete(self, requests):
            return [Completion('{"a": 1}' if len(r.fields) > 1 else '{"b": 2}') for r in requests]

    found, spent = extracted(Partial(), SINGLE, [Request("map", "x", {}, (("a", ""), ("b", "")))])
    assert found == [{"a": 1, "b": 2}] and spent[0].calls == 2


def test_sem_agg_merges_calls(spark):
    rules = LocalProvider({"total": lambda r: sum(x["v"] for x in r["records"]) if "records" in r else sum(int(x) for x in r["partial"])})
    df = spark.createDataFrame([(i,) for i in range(100)], "v long").repartition(4)
    out, spent = sem_agg(df, field("total", int, "total"), "sum", rules, SINGLE, per_call=7)
    assert out.first()["total"] == 4950 and spent.where("calls = 1").count() >= 15 + 3 + 1
    assert sem_agg(df.limit(0), field("total", int, "total"), "sum", rules, SINGLE)[0].count() == 0
    with pytest.raises(ValueError, match="one field"):
        sl.MemoryDataset("n", [1]).sem_agg(field("a", int) and sl.MemoryDataset("m", [{"a": 1, "b": 2}]).schema, "x")


def test_topk(spark):
    docs = spark.createDataFrame([(1, "red apple"), (2, "blue sky"), (3, "red car")], "id long, v string")
    from semloom.operators.semantic import embedded

    index = sl.VectorIndex(embedded(docs, ["v"], LocalProvider(), "local-embed", "vec"), "id", "v", "vec")
    one = sl.MemoryDataset("q", [{"q": "red apple"}]).sem_topk(index, "q", [{"name": "near", "type": list[str], "desc": ""}], k=1)
    assert one.run(config(LocalProvider())).df.first()["near"] == ["red apple"]
    many = sl.MemoryDataset("q", [{"q": ["blue", "car"]}]).sem_topk(index, "q", [{"name": "near", "type": list[str], "desc": ""}], k=1)
    assert many.run(config(LocalProvider())).df.first()["near"] == [["blue sky"], ["red car"]]
    own = sl.MemoryDataset("q", [{"q": "x"}]).sem_topk(index, "q", [{"name": "near", "type": list[str], "desc": ""}], search_func=lambda rows, q, k: 1 / 0, k=1)
    assert own.run(config(LocalProvider())).df.first()["near"] == []
    wrong = sl.MemoryDataset("q", [{"q": "x"}]).sem_topk(index, "q", [{"name": "near", "type": list[str], "desc": ""}], search_func=lambda rows, q, k: rows.no_such_thing(q), k=1)
    with pytest.raises(Exception, match="no_such_thing"):
        wrong.run(config(LocalProvider())).df.collect()


def test_large_index_gives_the_same(spark, sf, monkeypatch):
    from semloom.operators import topk

    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("concat('v', vec_id) as vec_id", "embedding")
    index = sl.VectorIndex(vectors, "vec_id", "vec_id", "embedding")
    near = sl.FrameDataset(vectors).sem_topk(index, "embedding", [{"name": "near", "type": list[str], "desc": ""}], k=3)
    small = {r["vec_id"]: r["near"] for r in near.run(config(LocalProvider())).df.collect()}
    monkeypatch.setattr(topk, "BROADCAST_BYTES", 0)
    assert {r["vec_id"]: r["near"] for r in near.run(config(LocalProvider())).df.collect()} == small


def test_context_trim_and_cache():
    r = Request("filter", "x", {"a": "y" * 40_000, "b": "z"}, model="local-short")
    assert len(r.prompt()) < 25_000
    prompts = {Request(v, "x", {"a": 1}, stage=s).prompt() for v in ("filter", "join", "map", "flat_map", "agg") for s in ("answer", "propose", "critique", "refine", "merge", "aggregate")}
    assert len(prompts) == 30
    asked = []

    class Counting(ModelProvider):
        def complete(self, requests):
            asked.extend(requests)
            return [Completion("ANSWER: TRUE") for _ in requests]

    cached = sl.CachedProvider(Counting())
    cached.complete([Request("filter", "x", {"a": 1})])
    cached.complete([Request("filter", "x", {"a": 1}), Request("filter", "x", {"a": 2})])
    assert len(asked) == 2


def test_a_shared_branch_makes_each_call_once(spark, tmp_path):
    path = tmp_path / "calls"
    made = sl.MemoryDataset("a", [{"text": f"t{i}"} for i in range(6)]).sem_map([{"name": "kind", "type": str, "desc": "k"}], depends_on="text")
    done = made.join(made, "text").run(config(Failing(str(path))))
    assert len(done) == 6 and done.execution_stats.total_calls == 6
    assert len(path.read_text().split()) == 6


def test_relaxed_types_keep_values_that_do_not_fit(spark):
    rules = LocalProvider({"n": lambda r: r["age"] if r["age"] < 2 else "many"})
    data = sl.MemoryDataset("a", ANIMALS).sem_map([{"name": "n", "type": int, "desc": "a number"}]).map(lambda r: {"m": [r["age"]] if r["age"] else 7}, [{"name": "m", "type": int, "desc": ""}], "age").filter(lambda r: r["age"] != 1, "age")
    strict, loose = (d.run(config(rules)).df for d in (data, data.relax_types()))
    assert sorted((r["age"], r["n"], r["m"]) for r in strict.collect()) == [(0, 0, 7), (2, None, None), (3, None, None)]
    assert sorted((r["age"], r["n"], r["m"]) for r in loose.collect()) == [(0, "0", "7"), (2, "many", "[2]"), (3, "many", "[3]")]
    assert data.relax_types().schema["n"].dataType.simpleString() == "string" and data.schema["n"].dataType.simpleString() == "bigint"
    joined = data.join(data, "text").relax_types()
    assert joined.schema["n_right"].dataType.simpleString() == "string"
