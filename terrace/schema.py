"""Schemas of nested tables: JSON record schemas, leaf resolution, narrow read schemas and validation.

Leaf names are addressed bare (``l_shipdate``, not ``OrderList.LineitemList.l_shipdate``), so every leaf name must be
unique in its table.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRIMITIVES = {
    "null": T.NullType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(),
    "double": T.DoubleType(), "string": T.StringType(), "bytes": T.BinaryType(),
}
LOGICAL = {
    "date": T.DateType(), "timestamp-millis": T.TimestampType(), "timestamp-micros": T.TimestampType(),
    "time-millis": T.IntegerType(), "time-micros": T.LongType(), "uuid": T.StringType(),
}


def parse_schema(text: str | dict) -> T.StructType:
    """The Spark schema of a JSON record schema. Recursive records are rejected."""
    kind, _ = _kind(json.loads(text) if isinstance(text, str) else text, {}, ())
    if not isinstance(kind, T.StructType):
        raise ValueError("the top of a table schema must be a record")
    return kind


def _kind(s: Any, named: dict[str, T.DataType], open_: tuple[str, ...]) -> tuple[T.DataType, dict]:
    """Spark type and field metadata. named: types that were defined before and may be used by name."""
    if isinstance(s, list):
        branches = [b for b in s if b != "null"]
        if len(branches) == 1:
            return _kind(branches[0], named, open_)
        fields = [T.StructField("tag", T.IntegerType())]
        fields += [T.StructField(f"branch{i}", _kind(b, named, open_)[0]) for i, b in enumerate(s) if b != "null"]
        return T.StructType(fields), {"union": json.dumps(s)}
    if isinstance(s, str):
        if s in open_:
            raise ValueError(f"recursive schema: {s}")
        if s in named:
            return named[s], {}
        return PRIMITIVES[s], {}
    kind, logical = s["type"], s.get("logicalType")
    if isinstance(kind, (dict, list)):
        return _kind(kind, named, open_)
    if logical == "decimal":
        return T.DecimalType(s["precision"], s.get("scale", 0)), {"decimal_of": kind}
    if logical in LOGICAL:
        return LOGICAL[logical], {"logical": logical}
    if kind in ("record", "group"):
        out = T.StructType()
        for f in s["fields"]:
            t, meta = _kind(f["type"], named, (*open_, s.get("name", "")))
            meta = dict(meta) | ({"order": f["order"]} if "order" in f else {}) | ({"default": json.dumps(f["default"])} if "default" in f else {})
            out.add(T.StructField(f["name"], t, True, meta))
        named[s.get("name", "")] = out
        return out, {"group": True} if kind == "group" else {}
    if kind == "enum":
        named[s["name"]] = T.StringType()
        return T.StringType(), {"symbols": s["symbols"]}
    if kind == "fixed":
        named[s["name"]] = T.BinaryType()
        return T.BinaryType(), {"size": s["size"]}
    if kind == "array":
        t, meta = _kind(s["items"], named, open_)
        return T.ArrayType(t), meta
    if kind == "map":
        return T.MapType(T.StringType(), _kind(s["values"], named, open_)[0]), {}
    return _kind(kind, named, open_)


@dataclass(frozen=True)
class Leaf:
    """A leaf column: the arrays around it, the path of structs below the innermost array, and its type."""

    name: str
    arrays: tuple[str, ...]
    path: tuple[str, ...]
    kind: T.DataType

    @property
    def layer(self) -> int:
        return len(self.arrays)


def is_layer(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)


def leaves(schema: T.StructType, arrays: tuple[str, ...] = (), path: tuple[str, ...] = ()) -> dict[str, Leaf]:
    """Bare leaf name to leaf. Raises on duplicate names. A struct that isn't in an array is part of its layer."""
    out: dict[str, Leaf] = {}
    for f in schema.fields:
        if is_layer(f.dataType):
            if path:
                raise ValueError(f"an array of records inside a plain record isn't a layer: {f.name}")
            found = leaves(f.dataType.elementType, (*arrays, f.name))
        elif isinstance(f.dataType, T.StructType):
            found = {f.name: Leaf(f.name, arrays, (*path, f.name), f.dataType)} | leaves(f.dataType, arrays, (*path, f.name))
        else:
            found = {f.name: Leaf(f.name, arrays, (*path, f.name), f.dataType)}
        if clash := set(out) & set(found):
            raise ValueError(f"leaf names must be unique, repeated: {sorted(clash)}")
        out |= found
    return out


def array_paths(schema: T.StructType, above: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    """Every layer below the root as its path of arrays, outermost first."""
    out = []
    for f in schema.fields:
        if is_layer(f.dataType):
            out += [(*above, f.name), *array_paths(f.dataType.elementType, (*above, f.name))]
    return out


def narrow(schema: T.StructType, names: Iterable[str]) -> T.StructType:
    """The part of a schema that holds the named leaves. Passed to the reader, it prunes below arrays too, where the
    optimizer's own pruning stops at higher-order functions."""
    wanted, known = set(names), leaves(schema)
    if missing := wanted - set(known):
        raise ValueError(f"unknown leaves: {sorted(missing)}")

    def cut(s: T.StructType) -> T.StructType:
        out = T.StructType()
        for f in s.fields:
            if f.name in wanted and not is_layer(f.dataType):
                out.add(f)
            elif is_layer(f.dataType) and (inner := cut(f.dataType.elementType)).fields:
                out.add(T.StructField(f.name, T.ArrayType(inner, f.dataType.containsNull), f.nullable, f.metadata))
            elif isinstance(f.dataType, T.StructType) and (inner := cut(f.dataType)).fields:
                out.add(T.StructField(f.name, inner, f.nullable, f.metadata))
        return out

    return cut(schema)


def invalid_rows(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows that break what Spark types can't say, at any depth: enum symbols and fixed sizes."""
    return df.where(_broken(lambda n: F.col(n), schema))


def _broken(get: Callable[[str], Column], schema: T.StructType) -> Column:
    bad: Column = F.lit(False)
    for f in schema.fields:
        c, kind = get(f.name), f.dataType
        if "symbols" in f.metadata and isinstance(kind, T.StringType):
            bad = bad | F.coalesce(~c.isin(*f.metadata["symbols"]), F.lit(False))
        elif "size" in f.metadata:
            bad = bad | F.coalesce(F.length(c) != f.metadata["size"], F.lit(False))
        elif is_layer(kind):
            bad = bad | F.coalesce(F.exists(c, _element_broken(kind.elementType)), F.lit(False))
        elif isinstance(kind, T.StructType):
            bad = bad | F.coalesce(_broken(lambda n, c=c: c[n], kind), F.lit(False))
    return bad


def _element_broken(kind: T.StructType) -> Callable[[Column], Column]:
    return lambda x: _broken(lambda n: x[n], kind)


def resolve(df: DataFrame, schema: T.StructType) -> DataFrame:
    """A table of an older schema as the reader's, at any depth: promoted types, defaults for missing columns, extra ones
    skipped."""
    return df.select(*(c.alias(f.name) for f, c in zip(schema.fields, _resolved(lambda n: F.col(n), df.schema, schema), strict=True)))


def _resolved(get: Callable[[str], Column], have: T.StructType, want: T.StructType) -> list[Column]:
    kinds = {f.name: f.dataType for f in have.fields}

    def value(c: Column, old: T.DataType, new: T.DataType) -> Column:
        if old == new:
            return c
        if isinstance(new, T.StructType) and isinstance(old, T.StructType):
            inner = F.struct(*(x.alias(f.name) for f, x in zip(new.fields, _resolved(lambda n: c[n], old, new), strict=True)))
            return F.when(c.isNotNull(), inner)
        if isinstance(new, T.ArrayType) and isinstance(old, T.ArrayType):
            return F.transform(c, lambda x: value(x, old.elementType, new.elementType))
        return c.cast(new)

    out = []
    for f in want.fields:
        if f.name in kinds:
            out.append(value(get(f.name), kinds[f.name], f.dataType))
        else:
            out.append(F.lit(json.loads(f.metadata["default"]) if "default" in f.metadata else None).cast(f.dataType))
    return out


def union_value(col: Column, kind: T.StructType) -> Column:
    """The set branch of a tagged union as text."""
    return F.coalesce(*(F.when(col["tag"] == int(f.name[6:]), col[f.name].cast("string")) for f in kind.fields if f.name != "tag"))
