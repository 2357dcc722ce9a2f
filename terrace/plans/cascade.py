"""The cascading filter over nested tables, as one declarative rewrite.

keep(L, e)  = own predicates at L hold for e
              and every child array with predicates in its subtree has an element that is kept
prune(e.c)  = the kept elements of e.c; arrays without predicates in their subtree are untouched

The order of the predicates doesn't matter. A predicate that gives null doesn't keep its row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.functions.predicates import Predicate
from terrace.schema import array_paths, is_layer, leaves, narrow


@dataclass(frozen=True)
class Dataset:
    """An immutable query over a nested table: where, having, then table, project, flatten, survivors or counts."""

    df: DataFrame | None
    schema: T.StructType
    source: Callable[[T.StructType], DataFrame] | None = None
    filters: tuple[tuple[str, Predicate], ...] = ()
    havings: tuple[tuple[str, Predicate], ...] = ()
    columns: tuple[str, ...] = field(default=())

    @staticmethod
    def of(df: DataFrame) -> Dataset:
        leaves(df.schema)
        return Dataset(df, df.schema)

    @staticmethod
    def parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> Dataset:
        """A stored table; its read schema is cut to the filters' and the projection's leaves."""
        full = schema or spark.read.parquet(path).schema
        return Dataset(None, full, lambda s: spark.read.schema(s).parquet(path))

    def where(self, leaf: str, predicate: Predicate) -> Dataset:
        if leaf not in leaves(self.schema):
            raise ValueError(f"unknown leaf: {leaf}")
        return replace(self, filters=(*self.filters, (leaf, predicate)))

    def set_filters(self, filters: dict[str, Predicate]) -> Dataset:
        """Replaces all predicates."""
        return replace(self, filters=tuple(filters.items()))

    def having(self, leaf: str, predicate: Predicate) -> Dataset:
        """A predicate on the array of a leaf's values among the children of one element of the layer above."""
        if leaves(self.schema)[leaf].layer == 0:
            raise ValueError(f"{leaf} isn't in an array")
        return replace(self, havings=(*self.havings, (leaf, predicate)))

    def project(self, *names: str) -> Dataset:
        """Keeps the nesting and only the named leaves."""
        narrow(self.schema, names)
        return replace(self, columns=names)

    def _needed(self) -> list[str]:
        return list(dict.fromkeys([*(self.columns or leaves(self.schema)), *(n for n, _ in self.filters), *(n for n, _ in self.havings)]))

    def table(self) -> DataFrame:
        """The filtered, projected nested table."""
        schema = narrow(self.schema, self._needed())
        df = self.df if self.df is not None else self.source(schema)
        known = leaves(schema)
        own: dict[tuple[str, ...], list] = defaultdict(list)
        lists: dict[tuple[str, ...], list] = defaultdict(list)
        for name, p in self.filters:
            own[known[name].arrays].append((known[name].path, p))
        for name, p in self.havings:
            lists[known[name].arrays[:-1]].append((known[name].arrays[-1], known[name].path, p))
        wanted = narrow(self.schema, self.columns) if self.columns else schema
        rows, fields = _prune(schema, wanted, (), df.__getitem__, own, lists)
        for keep in rows.first:
            df = df.where(keep)
        out = df.select(*(c.alias(n) for n, c in fields.items()))
        for c in rows.after:
            out = out.where(F.size(c) > 0)
        return out.select(*wanted.fieldNames())

    def flatten(self, *names: str, outer: bool = False) -> DataFrame:
        """One row for each element of the deepest named layer; leaves of layers above repeat. The leaves must be of one
        path of arrays. outer: childless parents stay, with nulls."""
        known = leaves(self.schema)
        deepest = max((known[n].arrays for n in names), key=len)
        if bad := [n for n in names if deepest[: known[n].layer] != known[n].arrays]:
            raise ValueError(f"leaves of sibling arrays can't be flattened together: {bad}")
        return unnest(self.project(*names).table(), deepest, outer).select(*names)

    def survivors(self, key: str) -> DataFrame:
        """The keys of the surviving elements of a key's layer."""
        return self.flatten(key)

    def counts(self) -> DataFrame:
        """Surviving elements of every layer: layer, n."""
        df = self.table()
        found: list[tuple[str, Column]] = [("root", F.lit(1).cast("long"))]
        for path in array_paths(df.schema):
            found.append((path[-1], _total(F.col(path[0]), path[1:])))
        sums = df.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in found))
        return sums.select(F.explode(F.array(*(F.struct(F.lit(n).alias("layer"), F.col(n).cast("long").alias("n")) for n, _ in found))).alias("x")).select("x.*")


@dataclass
class _Rows:
    first: list[Column]
    after: list[str]


def _prune(schema, wanted, at, get, own, lists) -> tuple[_Rows, dict[str, Column]]:
    """What keeps an element of the layer ``at``, and its fields, with pruned child arrays. after: the children that
    must not be empty once pruned."""

    found = [p(_at(path[1:])(get(path[0]))) for path, p in own.get(at, ())]
    first = [F.coalesce(c, F.lit(False)) for c in found] if at else found  # bare at the root, where the reader can use them
    for arr, path, p in lists.get(at, ()):
        values = F.transform(get(arr), _at(path))
        first.append(F.coalesce(p(values), F.lit(False)))
    fields: dict[str, Column] = {}
    after: list[str] = []
    for f in schema.fields:
        if not is_layer(f.dataType):
            fields[f.name] = get(f.name)
            continue
        below = (*at, f.name)
        touched = any(k[: len(below)] == below for k in [*own, *lists])
        if touched:
            after.append(f.name)
        keeps = f.name in wanted.fieldNames()
        inner = wanted[f.name].dataType.elementType if keeps else T.StructType([])
        fields[f.name] = _pruned_array(get(f.name), f.dataType.elementType, inner, below, own, lists) if touched or inner != f.dataType.elementType else get(f.name)
    return _Rows(first, after), fields


def _at(path: tuple[str, ...]) -> Callable[[Column], Column]:
    return lambda x: reduce(lambda c, p: c[p], path, x)


def _filled(name: str) -> Callable[[Column], Column]:
    return lambda x: F.size(x[name]) > 0


def _pruned_array(arr: Column, schema, wanted, at, own, lists) -> Column:
    def keeps(x: Column) -> Column:
        cond = F.lit(True)
        for c in _prune(schema, wanted, at, x.__getitem__, own, lists)[0].first:
            cond = cond & c
        return cond

    if own.get(at) or lists.get(at):
        arr = F.filter(arr, keeps)
    after: list[str] = []

    def built(x: Column) -> Column:
        rows, fields = _prune(schema, wanted, at, x.__getitem__, own, lists)
        after[:] = rows.after
        kept = {n: c for n, c in fields.items() if n in wanted.fieldNames() or n in rows.after}
        return F.struct(*(c.alias(n) for n, c in (kept or dict([next(iter(fields.items()))])).items()))

    arr = F.transform(arr, built)
    for c in after:
        arr = F.filter(arr, _filled(c))
    return arr


def _total(arr: Column, below: tuple[str, ...]) -> Column:
    if not below:
        return F.coalesce(F.size(arr), F.lit(0)).cast("long")
    return F.aggregate(F.coalesce(arr, F.array()), F.lit(0).cast("long"), lambda n, x: n + _total(x[below[0]], below[1:]))


def unnest(df: DataFrame, arrays: tuple[str, ...], outer: bool = False) -> DataFrame:
    """Explodes a path of arrays; fields of the layers above stay beside the elements' own."""
    spread = F.explode_outer if outer else F.explode
    for a in arrays:
        others = [c for c in df.columns if c != a]
        df = df.select(*others, spread(a).alias("__x")).select(*others, "__x.*")
    return df
