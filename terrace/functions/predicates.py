"""Predicates: factories of ``Column -> Column``, each bound to one leaf when it is given to a filter."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Predicate = Callable[[Column], Column]


def equal(v: Any) -> Predicate:
    return lambda c: c == F.lit(v)


def less(v: Any) -> Predicate:
    return lambda c: c < F.lit(v)


def at_most(v: Any) -> Predicate:
    return lambda c: c <= F.lit(v)


def greater(v: Any) -> Predicate:
    return lambda c: c > F.lit(v)


def between(low: Any, high: Any) -> Predicate:
    """[low, high]."""
    return lambda c: c.between(F.lit(low), F.lit(high))


def half_open(low: Any, high: Any) -> Predicate:
    """[low, high)."""
    return lambda c: (c >= F.lit(low)) & (c < F.lit(high))


def one_of(values: Sequence[Any]) -> Predicate:
    """Membership in a short list; for long ones use semi_join."""
    return lambda c: c.isin(*values)


def bytes_equal(v: bytes) -> Predicate:
    return lambda c: c.cast("binary") == F.lit(bytearray(v))


def finds(pattern: str) -> Predicate:
    return lambda c: c.rlike(pattern)


def matches(pattern: str) -> Predicate:
    return lambda c: c.rlike(f"^(?:{pattern})$")


def contains(part: str) -> Predicate:
    return lambda c: c.contains(part)


def has_token(word: str) -> Predicate:
    return lambda c: F.array_contains(F.split(c, " "), word)


def text_less(v: str) -> Predicate:
    """Order of the value's text, whatever its type."""
    return lambda c: c.cast("string") < v


def opaque(f: Callable[[Any], bool]) -> Predicate:
    """A Python predicate for one value at a time: the slow path, for what columns can't express."""
    return lambda c: F.udf(f, T.BooleanType())(c)


def from_json(config: str | dict, openness: dict[str, str] | None = None) -> dict[str, Predicate]:
    """Predicates by leaf from ``{"Layer.leaf": {"begin": a, "end": b}}`` or ``{"Layer.leaf": value}``; a nested object
    gives its keys' leaves. openness: leaf to ``closed``, ``half`` (default) or ``open`` for its bounds."""
    out: dict[str, Predicate] = {}
    ends = openness or {}

    def walk(name: str, v: Any) -> None:
        leaf = name.rsplit(".", 1)[-1]
        if isinstance(v, dict) and not {"begin", "end"} & set(v):
            for k, x in v.items():
                walk(k, x)
        elif isinstance(v, dict):
            how, a, b = ends.get(leaf, "half"), v.get("begin"), v.get("end")

            def p(c: Column) -> Column:
                low = F.lit(True) if a is None else c > F.lit(a) if how == "open" else c >= F.lit(a)
                return low & (F.lit(True) if b is None else c <= F.lit(b) if how == "closed" else c < F.lit(b))

            out[leaf] = p
        else:
            out[leaf] = equal(v)

    for k, v in (json.loads(config) if isinstance(config, str) else config).items():
        walk(k, v)
    return out


def semi_join(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is in ``keys``. The optimizer broadcasts the keys when their size is known to be small."""
    return df.join(keys.select(on), on, "left_semi")
