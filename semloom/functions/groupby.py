"""The group-by signature: keys, aggregate functions and their fields."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

FUNCTIONS = ("count", "sum", "average", "min", "max", "list", "set")


@dataclass(frozen=True)
class GroupBySig:
    """Parallel lists of functions and fields; an output column is named ``func(field)`` as the caller wrote it."""

    group_by_fields: tuple[str, ...]
    agg_funcs: tuple[str, ...]
    agg_fields: tuple[str, ...]

    def __post_init__(self):
        for name in ("group_by_fields", "agg_funcs", "agg_fields"):
            object.__setattr__(self, name, tuple(getattr(self, name)))

    def validate_schema(self, schema: T.StructType) -> tuple[bool, str | None]:
        names = set(schema.names)
        if len(self.agg_funcs) != len(self.agg_fields):
            return False, "agg_funcs and agg_fields differ in length"
        for f in self.group_by_fields + self.agg_fields:
            if f not in names:
                return False, f"no field {f} to group or aggregate"
        for f in self.agg_funcs:
            if f.lower() not in FUNCTIONS:
                return False, f"no aggregate function {f}"
        return True, None

    def get_agg_field_names(self) -> list[str]:
        return [f"{f}({x})" for f, x in zip(self.agg_funcs, self.agg_fields, strict=True)]

    def serialize(self) -> dict:
        return {"group_by_fields": list(self.group_by_fields), "agg_funcs": list(self.agg_funcs), "agg_fields": list(self.agg_fields)}

    def output_schema(self, schema: T.StructType) -> T.StructType:
        out = [schema[f] for f in self.group_by_fields]
        for func, name, label in zip(self.agg_funcs, self.agg_fields, self.get_agg_field_names(), strict=True):
            kind = schema[name].dataType
            plain = kind.elementType if isinstance(kind, T.ArrayType) and func.lower() in ("sum", "min", "max") else kind
            made = {"count": T.LongType(), "average": T.DoubleType(), "list": T.ArrayType(kind), "set": T.ArrayType(kind)}.get(func.lower())
            if func.lower() == "sum":
                made = T.LongType() if isinstance(plain, (T.IntegralType, T.BooleanType)) else T.DoubleType()
            out.append(T.StructField(label, made or plain, True))
        return T.StructType(out)
