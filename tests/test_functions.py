import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semloom import types as S
from semloom.functions import chunk_column, cosine, fixed_chunks, parse_answer_json, parse_boolean, shape_many, split_column, split_evenly, top_chunks
from semloom.operators.provider import hashed_vector


@pytest.mark.parametrize(("reply", "want"), [("ANSWER: TRUE\n---", True), ("answer: false", False), ("true or false", True), ("maybe", None), ("thinking true. ANSWER: FALSE\n---\ntrue", False), (None, None)])
def test_parse_boolean(reply, want):
    assert parse_boolean(reply) is want


@pytest.mark.parametrize(("reply", "want"), [('ANSWER: {"a": 1}\n---', {"a": 1}), ('x [{"a": 1}, {"a": 2}] y', [{"a": 1}, {"a": 2}]), ('{"a\\_b": 1 // one\n}', {"a_b": 1}), ("none", None), ("{broken", None)])
def test_parse_json(reply, want):
    assert parse_answer_json(reply) == want


def test_shape_many():
    assert shape_many([{"a": 1}, {"b": 2}], ["a", "b"]) == [{"a": 1, "b": None}, {"a": None, "b": 2}]
    assert shape_many({"a": [1, 2], "b": [3]}, ["a", "b"]) == [{"a": 1, "b": 3}, {"a": 2, "b": None}]
    assert shape_many({"a": 1}, ["a"]) == [{"a": 1}]
    assert shape_many("text", ["a"]) == []


@given(st.text(max_size=60), st.integers(1, 9))
def test_chunks_join_to_the_text(text, n):
    assert "".join(fixed_chunks(text, n)) == text
    assert "".join(split_evenly(text, n)) == text
    assert len(split_evenly(text, n)) <= n
    assert all(len(c) == n for c in fixed_chunks(text, n)[:-1])


def test_chunk_columns_are_the_functions(spark):
    texts = ["abcdefg", "", "ab", "abcdef", "x" * 50]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chunk_column(F.col("t"), 3).alias("fixed"), split_column(F.col("t"), 4).alias("even"))
    for r in df.collect():
        assert r["fixed"] == fixed_chunks(r["t"], 3)
        assert r["even"] == split_evenly(r["t"], 4)
    assert fixed_chunks("abcdefg", 3) == ["abc", "def", "g"]


def test_top_chunks_keep_order():
    embed = lambda x: np.array([hashed_vector(t) for t in x])
    text = "red red red " + "blue blue blue"[:12] + "red green up"
    assert top_chunks(text, "red", 12, 2, embed) == "red red red ...red green up"
    assert top_chunks("short", "red", 12, 2, embed) == "short"


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] and round(r[0], 6) for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, None]


def test_schemas():
    a = S.make_schema([{"name": "k", "type": int, "desc": "key"}, {"name": "x", "type": str, "description": ""}])
    assert a["k"].metadata == {"comment": "key"}
    with pytest.raises(ValueError, match="desc"):
        S.make_schema([{"name": "k", "type": int}])
    assert S.union_schemas([a, a], join=True, on=["k"]).names == ["k", "x", "x_right"]
    wider = S.union_schemas([S.union_schemas([a, a], join=True, on=["k"]), a], join=True, on=["k"])
    assert wider.names == ["k", "x", "x_right", "x_right_right"]
    assert S.project_schema(a, ["t.x", "zzz", "k"]).names == ["k", "x"]
    with pytest.raises(AssertionError):
        S.union_schemas([a, T.StructType([T.StructField("k", T.StringType())])])
    image = T.StructType([S.field("pic", S.ImageBase64), S.field("n", int | None), S.field("v", int | float), S.field("l", list[str])])
    assert S.modalities(image, ["pic", "n"]) == {"image", "text"}
    assert [f.dataType.simpleString() for f in image.fields] == ["string", "bigint", "double", "array<string>"]


def test_schema_files(tmp_path):
    (tmp_path / "a.csv").write_text("sender,subject\nwho sent it,what about\n")
    (tmp_path / "a.json").write_text('{"fields": [{"name": "sender", "description": "who"}, {"name": "subject"}]}')
    (tmp_path / "a.yml").write_text("fields:\n  - name: sender\n    type: str\n    description: who\n  - name: subject\n")
    (tmp_path / "a.jsonld").write_text('{"@graph": [{"@id": "x:sender", "@type": "rdf:Property", "rdfs:label": "sender", "rdfs:comment": "who"}]}')
    for ending, names in (("csv", ["sender", "subject"]), ("json", ["sender", "subject"]), ("yml", ["sender", "subject"]), ("jsonld", ["sender"])):
        assert S.SchemaBuilder.from_file(str(tmp_path / f"a.{ending}")).names == names
    assert S.SchemaBuilder.from_file(str(tmp_path / "a.csv"), exclude=["SENDER"], parent=S.TextFile).names == ["filename", "contents", "subject"]
