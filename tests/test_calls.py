"""How many calls semantic verbs make: none for what a limit drops, an equal input or an earlier run makes needless."""

import collections

import pytest
from pyspark.sql import functions as F

import semloom as sl
from semloom.operators.ledger import AllCallsFailed, RequestLog, content_key
from semloom.operators.provider import Completion, LocalProvider, ModelProvider
from semloom.operators.semantic import sem_agg
from semloom.plans.physical import Implementation
from semloom.types import field

SINGLE = Implementation("single", ("local-large",))


class Counted(ModelProvider):
    """Says TRUE to what ``rule`` holds for, and writes each request into a file of its process."""

    def __init__(self, folder, rule=lambda r: True, stop=None, fail=None):
        self.folder, self.rule, self.stop, self.fail = str(folder), rule, stop, fail

    def complete(self, requests):
        out = []
        for r in requests:
            import os

            with open(f"{self.folder}/{os.getpid()}", "a") as f:
                f.write(f"{sorted(r.inputs.items())}\n")
            if self.stop and self.stop(r.inputs):
                raise SystemExit("the worker goes down")
            if self.fail and self.fail(r.inputs):
                raise RuntimeError("refused")
            good = self.rule(r.inputs)
            out.append(Completion('ANSWER: {"kind": "x"}\n---' if r.verb == "map" else f"ANSWER: {'TRUE' if good else 'FALSE'}\n---", 10, 2, 0.1))
        return out


def made(folder):
    return [line for f in folder.iterdir() for line in f.read_text().splitlines()]


def config(provider, **changes):
    return sl.QueryProcessorConfig(optimizer_strategy="none", provider=provider, **changes)


@pytest.fixture
def numbers(spark):
    return sl.FrameDataset(spark.range(8000).select(F.col("id"), F.concat(F.lit("t"), "id").alias("text")).repartition(8), "numbers")


def test_a_limit_stops_the_calls(numbers, tmp_path):
    done = numbers.sem_filter("even", depends_on="id").limit(5).run(config(Counted(tmp_path, lambda r: r["id"] % 2 == 0)))
    rows = done.df.collect()
    assert len(rows) == 5 and all(r["id"] % 2 == 0 for r in rows)
    assert len(made(tmp_path)) == done.execution_stats.total_calls <= 64
    assert len(done.df.collect()) == 5 and len(made(tmp_path)) <= 64


def test_a_limit_over_rare_rows_grows_until_it_is_met(numbers, tmp_path):
    rare = Counted(tmp_path, lambda r: r["id"] % 400 == 7)
    data = numbers.filter(F.col("id") >= 0, "id").sem_filter("rare", depends_on="id").map({"double": F.col("id") * 2}, [{"name": "double", "type": int, "desc": ""}])
    done = data.limit(4).run(config(rare))
    assert len(done.df.collect()) == 4 and all(r["double"] % 800 == 14 for r in done.df.collect())
    asked = made(tmp_path)
    assert len(asked) == len(set(asked)) < 8000  # rounds overlap, but nothing is asked twice
    assert sorted(r["id"] for r in data.limit(100).run(config(LocalProvider({"rare": lambda r: r["id"] % 400 == 7}))).df.collect()) == list(range(7, 8000, 400))


def test_limits_go_below_maps(numbers, tmp_path):
    done = numbers.sem_map([{"name": "kind", "type": str, "desc": "k"}], depends_on="id").project(["id", "kind"]).limit(7).run(config(Counted(tmp_path)))
    assert [r["kind"] for r in done.df.collect()] == ["x"] * 7 and len(made(tmp_path)) == 7
    lines = LocalProvider({"l": lambda r: [{"part": i} for i in range(3)]})
    out = numbers.sem_flat_map([{"name": "part", "type": int, "desc": ""}], desc="l", depends_on="id").limit(4).run(config(lines))
    assert len(out.df.collect()) == 4 and out.execution_stats.total_calls == 4


def test_a_limit_feeds_both_sides_of_a_join_step_by_step(spark, numbers, tmp_path):
    other = sl.FrameDataset(spark.range(3000).select(F.col("id").alias("n")), "other")
    pairs = numbers.project(["id"]).sem_join(other, "same rest", depends_on=["id", "n"]).limit(6)
    done = pairs.run(config(Counted(tmp_path, lambda r: r["id"] % 5 == r["n"] % 5)))
    rows = done.df.collect()
    assert len(rows) == 6 and all(r["id"] % 5 == r["n"] % 5 for r in rows)
    assert len(made(tmp_path)) == done.execution_stats.total_calls <= 1024  # of 24 million pairs


def test_equal_inputs_are_asked_once_and_kept(spark, tmp_path):
    calls, log = tmp_path / "calls", str(tmp_path / "log")
    calls.mkdir()
    data = sl.FrameDataset(spark.range(8000).select("id", (F.col("id") % 3).alias("kind")).repartition(8), "kinds")
    provider = Counted(calls, lambda r: r["kind"] == 1)
    done = data.sem_filter("one", depends_on="kind").run(config(provider, request_log=log))
    assert len(done) == 2667 and len(made(calls)) == 3
    spark.catalog.clearCache()  # nothing hangs on blocks of executors
    assert len(done) == 2667 and len(made(calls)) == 3
    again = data.sem_filter("one", depends_on="kind").run(config(provider, request_log=log))
    assert len(again) == 2667 and len(made(calls)) == 3 and again.execution_stats.total_calls == 0
    other = data.sem_filter("another", depends_on="kind").run(config(provider, request_log=log))
    assert len(other) == 2667 and len(made(calls)) == 6


def test_one_failure_repeats_no_other_request(spark, tmp_path):
    data = sl.FrameDataset(spark.range(64).select("id").coalesce(1), "few")
    done = data.sem_filter("x", depends_on="id").run(config(Counted(tmp_path, fail=lambda r: r["id"] == 30), max_workers=1))
    assert len(done) == 63 and sorted(collections.Counter(made(tmp_path)).values()) == [1] * 64
    assert done.execution_stats.total_calls == 63 and done.execution_stats.operators[0].failures == 1


def test_failed_requests_are_asked_again_by_the_next_run(spark, tmp_path):
    calls, log = tmp_path / "calls", str(tmp_path / "log")
    calls.mkdir()
    data = sl.FrameDataset(spark.range(20).select("id"), "few").sem_map([{"name": "kind", "type": str, "desc": "k"}], depends_on="id")
    first = data.run(config(Counted(calls, fail=lambda r: r["id"] < 4), request_log=log))
    assert sum(r["kind"] is None for r in first.df.collect()) == 4
    second = data.run(config(Counted(calls), request_log=log))
    assert all(r["kind"] == "x" for r in second.df.collect()) and second.execution_stats.total_calls == 4


def test_a_stage_whose_calls_all_fail_raises(spark, tmp_path):
    data = sl.FrameDataset(spark.range(20).select("id"), "few")
    with pytest.raises(AllCallsFailed, match="20 requests failed.*refused"):
        data.sem_filter("x").run(config(Counted(tmp_path, fail=lambda r: True)))


def test_finished_tasks_of_a_failed_job_keep_their_answers(spark, tmp_path):
    calls, log = tmp_path / "calls", str(tmp_path / "log")
    calls.mkdir()
    data = sl.FrameDataset(spark.range(200).select("id"), "some").sem_filter("x", depends_on="id")
    with pytest.raises(Exception, match="the worker goes down|SystemExit|Python worker"):
        data.run(config(Counted(calls, stop=lambda r: r["id"] == 77), request_log=log, max_workers=40))
    kept = RequestLog(spark, log)
    stages = list((tmp_path / "log").iterdir())
    answered = kept.answers(str(stages[0])).count() if stages else 0
    before = len(made(calls))
    done = data.run(config(Counted(calls), request_log=log, max_workers=40))
    assert len(done) == 200 and len(made(calls)) - before == 200 - answered
    assert answered > 0


def test_keys_tell_values_apart(spark):
    df = spark.createDataFrame([("a", None, b"x"), ("a", "", b"x"), (None, "a", b"x"), ("a", None, b"y"), ("a", None, None)], "p string, q string, b binary")
    keys = [r[0] for r in df.select(content_key(df, df.columns)).collect()]
    assert len({bytes(k) for k in keys}) == 5


def test_merge_tree_bounds_every_call(spark):
    def total(r):
        given = r["records"] if "records" in r else r["partial"]
        assert 0 < len(given) <= 10
        return sum(x["id"] for x in given) if "records" in r else sum(int(x) for x in given)

    out, spent = sem_agg(spark.range(100_000), field("total", int, "total"), "sum", LocalProvider({"total": total}), SINGLE, per_call=10)
    assert out.first()["total"] == 99_999 * 50_000
    assert spent.count() >= 10_000 + 1_000 + 100 + 10 + 1


def test_semantic_verbs_on_a_stream(spark, tmp_path):
    from semloom.streaming import streamed

    rows = [(i, f"text {i} {'lion' if i % 3 == 0 else 'bear'}") for i in range(60)]
    spark.createDataFrame(rows, "id long, text string").repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    def build(data):
        return data.sem_filter("names a 'lion'", depends_on="text").sem_map([{"name": "no", "type": int, "desc": r"regex: text (\d+)"}], depends_on="text").project(["id", "no"])

    options = config(LocalProvider())
    query = streamed(build(sl.FrameDataset(stream, "s")), options).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = sorted(tuple(r) for r in build(sl.FrameDataset(spark.createDataFrame(rows, "id long, text string"), "b")).run(options).df.collect())
    assert got == want == [(i, i) for i in range(0, 60, 3)]
    seen = [m for p in query.recentProgress for n, m in (p["observedMetrics"] or {}).items() if n.startswith("sem_filter")]
    assert sum(m["rows"] for m in seen) == 60 and sum(m["calls"] or 0 for m in seen) == 60
