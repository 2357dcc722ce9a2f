"""Nest joins: children become a sorted array column of their parents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class LayerSpec:
    """One layer of a keyed nested table; fk holds the parent's key, in the order of the parent's pk."""

    name: str
    pk: tuple[str, ...]
    fk: tuple[str, ...] = ()


def nest(parent: DataFrame, child: DataFrame, pk: tuple[str, ...], fk: tuple[str, ...], name: str, orphans: str = "drop") -> DataFrame:
    """Each parent gets its children as array ``name``, ordered by all their fields; childless parents get an empty one.

    orphans (children whose key has no parent, null keys too): drop; stub keeps them under a parent that has only its
    key; error fails the job.

    Children are dealt out by key before they are listed: a list made any earlier holds hardly more than one child, and
    making it sorts whole input splits, which spill. The number of partitions is the session's, whatever their size on
    disk, since tables that compress well would be merged to partitions that spill.
    """
    if orphans not in ("drop", "stub", "error"):
        raise ValueError(orphans)
    keys = [F.col(f).alias(p) for p, f in zip(pk, fk, strict=True)]
    dealt = child.repartition(int(child.sparkSession.conf.get("spark.sql.shuffle.partitions")), *fk)
    lists = dealt.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*child.columns))).alias(name))
    empty = F.array().cast(T.ArrayType(child.schema))
    if orphans == "error":
        marked = parent.withColumn("__parent", F.lit(True)).join(lists, list(pk), "full")
        ok = F.when(F.col("__parent"), F.lit(True)).otherwise(F.raise_error(F.lit(f"a row of {name} has no parent")).cast("boolean"))
        return marked.where(ok).select(*parent.columns, F.coalesce(name, empty).alias(name))
    joined = parent.join(lists, list(pk), "left" if orphans == "drop" else "full")
    return joined.select(*parent.columns, F.coalesce(name, empty).alias(name))


def nest_layers(layers: list[tuple[LayerSpec, DataFrame]], orphans: str = "drop") -> DataFrame:
    """Nests layers given root first, each the parent of the next, from the deepest up. Array names are ``<layer>List``."""
    (spec, df), *above = reversed(layers)
    for parent_spec, parent in above:
        df = nest(parent, df, parent_spec.pk, spec.fk, f"{spec.name}List", orphans)
        spec = parent_spec
    return df


def child_keys(child: DataFrame, fk: tuple[str, ...], pk: tuple[str, ...]) -> DataFrame:
    """Forward index: for each parent key the sorted keys of its children."""
    return child.groupBy(*fk).agg(F.array_sort(F.collect_list(F.struct(*pk))).alias("children"))


def parent_of(child: DataFrame, pk: tuple[str, ...], fk: tuple[str, ...]) -> DataFrame:
    """Backward index: for each child key its parent's key."""
    return child.select(*pk, *fk).distinct()


def grouped(df: DataFrame, name: str, fields: list[str]) -> DataFrame:
    """Packs columns into one struct column, a group."""
    return df.select(*(c for c in df.columns if c not in fields), F.struct(*fields).alias(name))
