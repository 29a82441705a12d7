"""Record schemas: built from fields, files or pandas frames; unions and projections; modality marks.

A schema is a Spark ``StructType`` with every field nullable. A field's
description is its ``comment`` metadata, an image or audio field has ``modality``.
"""

from __future__ import annotations

import hashlib
import typing
from typing import Any

from pyspark.sql import types as T


def hash_for_id(text: str, length: int = 10) -> str:
    """A short stable id of a text."""
    return hashlib.sha256(text.encode()).hexdigest()[:length]


class Modality(str):
    """A string type whose values stand for an image or audio clip."""


ImageFilepath = Modality("image:path")
ImageBase64 = Modality("image:base64")
ImageURL = Modality("image:url")
AudioFilepath = Modality("audio:path")
AudioBase64 = Modality("audio:base64")

_SIMPLE = {str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), bytes: T.BinaryType(), Any: T.StringType(), list: T.ArrayType(T.StringType()), "str": T.StringType(), "string": T.StringType(), "int": T.LongType(), "integer": T.LongType(), "number": T.DoubleType(), "float": T.DoubleType(), "bool": T.BooleanType(), "boolean": T.BooleanType(), "bytes": T.BinaryType(), "any": T.StringType()}


def spark_type(kind: Any) -> T.DataType:
    """The Spark type of a Python annotation, a type name, a modality or a Spark type."""
    if isinstance(kind, T.DataType):
        return kind
    if isinstance(kind, Modality):
        return T.StringType()
    if kind in _SIMPLE:
        return _SIMPLE[kind]
    origin, args = typing.get_origin(kind), [a for a in typing.get_args(kind) if a is not type(None)]
    if origin is list:
        return T.ArrayType(spark_type(args[0]) if args else T.StringType())
    if args and (len(args) == 1 or set(args) <= {int, float}):  # optional, or int | float
        return T.DoubleType() if len(args) > 1 else spark_type(args[0])
    if args:
        return T.StringType()
    raise TypeError(f"no Spark type for {kind!r}")


def field(name: str, kind: Any, desc: str = "") -> T.StructField:
    meta = {"comment": desc} if desc else {}
    inner = typing.get_args(kind)[0] if typing.get_origin(kind) is list and typing.get_args(kind) else kind
    if isinstance(inner, Modality):  # one, or a list of them
        meta["modality"], meta["form"] = inner.split(":")
    return T.StructField(name, spark_type(kind), True, meta)


def make_schema(fields: list[dict] | T.StructType) -> T.StructType:
    """A schema from dicts with name, type, and desc or description; all three are asked for."""
    if isinstance(fields, T.StructType):
        return fields
    out = []
    for f in fields:
        missing = [k for k in ("name", "type") if k not in f] + ([] if "desc" in f or "description" in f else ["desc"])
        if missing:
            raise ValueError(f"a field needs {', '.join(missing)}: {f}")
        out.append(field(f["name"], f["type"], f.get("desc", f.get("description", ""))))
    return T.StructType(out)


def schema_of_pandas(frame) -> T.StructType:
    """Column types of a pandas frame; a column named by an integer becomes ``column_{n}``."""
    kinds = {"int64": int, "float64": float, "bool": bool, "object": str}
    return T.StructType([field(f"column_{c}" if isinstance(c, int) else str(c), kinds.get(str(t), Any)) for c, t in frame.dtypes.items()])


def union_schemas(schemas: list[T.StructType], join: bool = False, on: list[str] | None = None) -> T.StructType:
    """Fields of all schemas. Of a join, clashing fields outside ``on`` get ``_right`` until they are unique; else their types must agree."""
    out: dict[str, T.StructField] = {}
    for schema in schemas:
        for f in schema.fields:
            name = f.name
            if name in out:
                if join and name not in (on or []):
                    while name in out:
                        name += "_right"
                elif not join and out[name].dataType != f.dataType:
                    raise AssertionError(f"field {name} has two types: {out[name].dataType} and {f.dataType}")
                else:
                    continue
            out[name] = T.StructField(name, f.dataType, True, f.metadata)
    return T.StructType(list(out.values()))


def project_schema(schema: T.StructType, cols: list[str]) -> T.StructType:
    """The named fields in the schema's order; dotted prefixes are dropped, unknown names are passed over."""
    names = {c.rsplit(".", 1)[-1] for c in cols}
    return T.StructType([f for f in schema.fields if f.name in names])


def modalities(schema: T.StructType, names: list[str]) -> set[str]:
    """Which of text, image and audio the named fields have."""
    return {f.metadata.get("modality", "text") for f in schema.fields if f.name in names}


def _schema(**kinds: Any) -> T.StructType:
    return T.StructType([field(n, k) for n, k in kinds.items()])


DefaultSchema = _schema(value=Any)
Download = _schema(url=str, content=bytes, timestamp=str)
File = _schema(filename=str, contents=bytes)
TextFile = _schema(filename=str, contents=str)
Average = _schema(average=float)
Count = _schema(count=int)
Sum = _schema(sum=float)
Min = _schema(min=float)
Max = _schema(max=float)
OperatorDerivedSchema = T.StructType([])
Table = _schema(rows=list[list[str]], filename=str, header=list[str], name=str)
URL = _schema(url=str)
WebPage = _schema(text=str, html=str, timestamp=str, filename=str)
ImageFile = T.StructType([field("filename", str), field("contents", ImageBase64)])
AudioFile = T.StructType([field("filename", str), field("contents", AudioBase64)])
PDFFile = _schema(filename=str, contents=bytes, text_contents=str)
XLSFile = _schema(filename=str, contents=bytes, number_sheets=int, sheet_names=list[str])
EquationImage = T.StructType([*ImageFile.fields, field("equation_text", str)])
PlotImage = T.StructType([*ImageFile.fields, field("plot_description", str)])


class SchemaBuilder:
    """Schemas from csv, json, jsonld and yml files."""

    @staticmethod
    def from_file(path: str, name: str | None = None, include: list[str] | None = None, exclude: list[str] | None = None, parent: T.StructType | None = None) -> T.StructType:
        """Fields of a schema file; include and exclude lists ignore case, a parent's fields come first."""
        ending = path.rsplit(".", 1)[-1].lower()
        reader = {"csv": _csv_fields, "json": _json_fields, "jsonld": _jsonld_fields, "yml": _yml_fields, "yaml": _yml_fields}.get(ending)
        if reader is None:
            raise ValueError(f"no schema reader for .{ending}")
        with open(path, encoding="utf-8") as f:
            fields = reader(f.read())
        wanted, unwanted = ({x.lower() for x in names or []} for names in (include, exclude))
        fields = [(n, d) for n, d in fields if (not wanted or n.lower() in wanted) and n.lower() not in unwanted]
        base = list(parent.fields) if parent else []
        known = {f.name for f in base}
        return T.StructType(base + [field(n, Any, d) for n, d in dict(fields).items() if n not in known])


def _csv_fields(text: str) -> list[tuple[str, str]]:
    import csv

    rows = list(csv.reader(text.splitlines()))
    names = [c.strip() for c in rows[0]] if rows else []
    notes = rows[1] if len(rows) > 1 else []
    return [(n, notes[i].strip() if i < len(notes) else "") for i, n in enumerate(names) if n]


def _json_fields(text: str) -> list[tuple[str, str]]:
    import json

    data = json.loads(text)
    data = data.get("fields", data.get("properties", data)) if isinstance(data, dict) else data
    if isinstance(data, dict):
        return [(n, d.get("description", d.get("desc", "")) if isinstance(d, dict) else str(d)) for n, d in data.items()]
    return [(d["name"], d.get("description", d.get("desc", ""))) for d in data]


def _jsonld_fields(text: str) -> list[tuple[str, str]]:
    import json

    out = []
    for node in json.loads(text).get("@graph", []):
        kinds = node.get("@type", [])
        if "rdf:Property" in (kinds if isinstance(kinds, list) else [kinds]):
            label = node.get("rdfs:label", node.get("@id", ""))
            note = node.get("rdfs:comment", "")
            out.append((label.get("@value", "") if isinstance(label, dict) else label, note.get("@value", "") if isinstance(note, dict) else note))
    return out


def _yml_fields(text: str) -> list[tuple[str, str]]:
    """A small subset of YAML: ``name: description`` pairs, nested blocks with a description, or lists of names."""
    out, name, deep = [], None, 0
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip()
        key, _, value = body.strip().lstrip("- ").partition(":")
        value = value.strip().strip("\"'")
        if not body or body.lstrip().startswith("#") or key in ("fields", "properties", "---"):
            continue
        depth = len(body) - len(body.lstrip())
        if key == "name" and value:
            name, deep = value, depth
            out.append((name, ""))
        elif key in ("description", "desc") and name is not None:
            out[-1] = (out[-1][0], value)
        elif key in ("type", "required") and name is not None and depth >= deep:
            continue
        else:
            name, deep = key, depth
            out.append((key, value))
    return out
