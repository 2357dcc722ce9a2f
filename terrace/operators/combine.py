"""Concatenation, sorted merges, overlays and row sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.session import shared_dir


def concat(*tables: DataFrame) -> DataFrame:
    """All rows of tables of one schema."""
    return reduce(lambda a, b: a.unionByName(b), tables)


def sorted_merge(keys: list[str], *tables: DataFrame) -> DataFrame:
    """All rows by key; ``source`` says which table a row is from, and breaks ties."""
    marked = (t.withColumn("source", F.lit(i)) for i, t in enumerate(tables))
    return concat(*marked).orderBy(*keys, "source")


def sort_runs(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted runs: each partition sorted by key, spilled by Spark where memory ends."""
    return df.sortWithinPartitions(*keys)


def ordered(df: DataFrame, orders: dict[str, str], symbols: dict[str, list[str]] | None = None) -> DataFrame:
    """Record order: ascending, descending or ignore by field; enums by their symbols' order."""
    by = []
    for name, how in orders.items():
        c = F.array_position(F.array(*(F.lit(s) for s in symbols[name])), F.col(name)) if name in (symbols or {}) else F.col(name)
        if how != "ignore":
            by.append(c.desc() if how == "descending" else c.asc())
    return df.orderBy(*by) if by else df


def overlay(base: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """base with delta's non-null fields on top, by key; keys of either side are kept."""
    b, d = base.alias("b"), delta.alias("d")
    cond = reduce(lambda x, y: x & y, (F.col(f"b.{k}") == F.col(f"d.{k}") for k in key))
    return b.join(d, cond, "full").select(*(F.coalesce(F.col(f"d.{c}"), F.col(f"b.{c}")).alias(c) if c in delta.columns else F.col(f"b.{c}") for c in base.columns))


def both(*conditions: Column) -> Column:
    """Row sets ANDed."""
    return reduce(lambda a, b: a & b, conditions)


def numbered(ordered_rows: DataFrame, name: str = "pos") -> DataFrame:
    """Sorted rows with their place from 1 on. The sorted partitions are kept in the shared folder, and a count for each of
    them is collected, so no task holds all rows."""
    shared_dir(ordered_rows.sparkSession)
    rows = ordered_rows.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__at")).checkpoint()
    counts = {r["__part"]: r["count"] for r in rows.groupBy("__part").count().collect()}
    offsets, total = [0], 0
    for part in range(max(counts, default=0) + 1):
        total += counts.get(part, 0)
        offsets.append(total)
    place = F.element_at(F.array(*map(F.lit, offsets)), F.col("__part") + 1) + F.col("__at") + 1
    return rows.select(place.cast("long").alias(name), *ordered_rows.columns)


def repeated(rows: DataFrame, times: str, most: int = 4096) -> DataFrame:
    """Each row as often as its long ``times`` says, without that column; not at all where it is null or under 1. Rows are
    dealt out before they are repeated, and no array of more than ``most`` is made beside a list of such arrays."""
    s = rows.sparkSession
    parts = max(4 * s.sparkContext.defaultParallelism, int(s.conf.get("spark.sql.shuffle.partitions")))
    cols = [c for c in rows.columns if c != times]
    x = rows.where(F.col(times) > 0).repartition(parts)
    x = x.select(*cols, times, F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(most).cast("long"))).alias("__from"))
    x = x.select(*cols, F.least(F.col(times) - F.col("__from"), F.lit(most)).cast("int").alias("__n"))
    return x.select(*cols, F.explode(F.array_repeat(F.lit(True), F.col("__n"))).alias("__x")).select(*cols)
