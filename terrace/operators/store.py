"""The keyed store: layers of keyed rows with search, insert, update, upsert, cascading delete and compaction.

Each layer is a flat table; the nested view is built by nest joins. A batch of mutations has a sequence number for each
operation, and applying it gives what one operation at a time would give:

insert  no-op where the key lives; needs a living parent.
update  no-op where the key doesn't live; null fields stay as they are; a new foreign key moves the row with its whole
        subtree, and needs a living parent, else the operation is void.
upsert  update where the key lives, else insert.
delete  kills the row and all its descendants. A later insert makes a new row; its former children stay dead.

Layers go root first. Each key's operations, with the events of its parents, are folded in order by one ``aggregate``
expression; keys without operations are only checked against killed parents by a join.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.operators.nest import LayerSpec, nest_layers

OPS = ("insert", "update", "upsert", "delete")


@dataclass(frozen=True)
class NestedStore:
    """Immutable: apply() returns the next state. layers: root first. applied: last batch taken from each named source."""

    layers: tuple[tuple[LayerSpec, DataFrame], ...]
    applied: dict[str, int] = field(default_factory=dict)

    def layer(self, name: str) -> tuple[LayerSpec, DataFrame]:
        return next((s, d) for s, d in self.layers if s.name == name)

    def nested(self) -> DataFrame:
        return nest_layers(list(self.layers))

    def search(self, name: str, keys: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """Rows of the given keys, with all columns or a projection."""
        spec, df = self.layer(name)
        return df.select(*dict.fromkeys([*spec.pk, *(columns or df.columns)])).join(keys.select(*spec.pk), list(spec.pk), "left_semi")

    def exists(self, name: str, keys: DataFrame) -> DataFrame:
        spec, df = self.layer(name)
        return keys.join(df.select(*spec.pk, F.lit(True).alias("found")), list(spec.pk), "left").withColumn("found", F.coalesce("found", F.lit(False)))

    def in_order(self, name: str) -> DataFrame:
        spec, df = self.layer(name)
        return df.orderBy(*spec.pk)

    def apply(self, ops: dict[str, DataFrame]) -> NestedStore:
        """ops: by layer, rows of the layer's columns with ``seq`` (distinct over all layers) and ``op``."""
        out, hist = [], None
        for i, (spec, base) in enumerate(self.layers):
            up = self.layers[i - 1] if i else None
            new, hist = _step(spec, base, ops.get(spec.name), up, hist)
            out.append((spec, new))
        return NestedStore(tuple(out), self.applied)

    def save(self, spark: SparkSession, root: str, applied: dict[str, int] | None = None) -> int:
        """Compaction: writes all layers as a new version, then its marker, which also tells the batches that are in it;
        readers take the last marked version, so a job that dies half-way changes nothing. Returns the version."""
        version = (current_version(spark, root) or 0) + 1
        for spec, df in self.layers:
            df.sortWithinPartitions(*spec.pk).write.mode("overwrite").option("parquet.bloom.filter.enabled#" + spec.pk[0], "true").parquet(f"{root}/v{version}/{spec.name}")
        meta = json.dumps({"layers": [[s.name, list(s.pk), list(s.fk)] for s, _ in self.layers], "applied": self.applied | (applied or {})})
        spark.createDataFrame([(version, meta)], "version long, layers string").coalesce(1).write.mode("append").parquet(f"{root}/versions")
        return version

    @staticmethod
    def open(spark: SparkSession, root: str) -> NestedStore:
        row = spark.read.parquet(f"{root}/versions").orderBy(F.desc("version")).first()
        meta = json.loads(row.layers)
        return NestedStore(tuple((LayerSpec(n, tuple(pk), tuple(fk)), spark.read.parquet(f"{root}/v{row.version}/{n}")) for n, pk, fk in meta["layers"]), meta["applied"])


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Deletes the rows of all but the last ``keep`` versions. Nothing may still read the older ones."""
    last = current_version(spark, root) or 0
    fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for version in range(last - max(1, keep), 0, -1):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/v{version}")
        if not fs.exists(path):
            break  # the ones before it went earlier
        fs.delete(path, True)


def current_version(spark: SparkSession, root: str) -> int | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/versions")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(f"{root}/versions").agg(F.max("version")).first()[0]


def bulk_load(layers: list[tuple[LayerSpec, DataFrame]]) -> NestedStore:
    """A store of layers given root first; rows without a living parent are left out, all the way down."""
    out: list[tuple[LayerSpec, DataFrame]] = []
    for spec, df in layers:
        if out:
            up_spec, up = out[-1]
            keys = up.select(*(F.col(p).alias(f) for p, f in zip(up_spec.pk, spec.fk, strict=True)))
            df = df.join(keys, list(spec.fk), "left_semi").select(*df.columns)
        out.append((spec, df))
    return NestedStore(tuple(out))


def _key(cols: tuple[str, ...], of=F.col) -> Column:
    return F.struct(*(of(c).alias(f"k{i}") for i, c in enumerate(cols)))


def _step(spec: LayerSpec, base: DataFrame, ops: DataFrame | None, up, up_hist: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """The layer after its operations and its parents' deaths; its keys' histories: __key, __hist [(seq, alive)]."""
    cols = base.columns
    kills = None
    if up_hist is not None:
        died = F.transform(F.filter("__hist", lambda h: ~h["alive"]), lambda h: h["seq"])
        kills = up_hist.select(F.col("__key").alias("__parent"), died.alias("__kills")).where(F.size("__kills") > 0)
    if ops is None:
        if kills is None:
            return base, None
        met = base.withColumn("__parent", _key(spec.fk)).join(kills, "__parent", "left")
        gone = met.where("__kills is not null").select(_key(spec.pk).alias("__key"), F.array(F.struct(F.array_min("__kills").alias("seq"), F.lit(False).alias("alive"))).alias("__hist"))
        return met.where("__kills is null").select(*cols), gone

    row = F.struct(*(F.col(c).cast(base.schema[c].dataType).alias(c) for c in cols))
    o = ops.select(F.col("seq").cast("long").alias("seq"), "op", row.alias("row"), _key(spec.pk).alias("__key"))
    if up is not None:
        up_spec, up_base = up
        has_fk = reduce(lambda a, b: a & b, (F.col(f"row.{c}").isNotNull() for c in spec.fk))
        o = o.withColumn("__parent", _key(spec.fk, lambda c: F.col(f"row.{c}")))
        o = o.join(up_base.select(_key(up_spec.pk).alias("__parent"), F.lit(True).alias("__base")).distinct(), "__parent", "left")
        if up_hist is not None:
            o = o.join(up_hist.withColumnRenamed("__key", "__parent").withColumnRenamed("__hist", "__up"), "__parent", "left")
            before = F.filter(F.coalesce("__up", F.array().cast("array<struct<seq:bigint,alive:boolean>>")), lambda h: h["seq"] < F.col("seq"))
            alive = F.when(F.size(before) > 0, F.element_at(before, -1)["alive"]).otherwise(F.coalesce("__base", F.lit(False)))
        else:
            alive = F.coalesce("__base", F.lit(False))
        o = o.withColumn("__legal", F.coalesce(F.when(has_fk, alive), F.lit(False))).withColumn("__moves", has_fk)
    else:
        o = o.withColumn("__legal", F.lit(True)).withColumn("__moves", F.lit(False)).withColumn("__parent", F.lit(None).cast("struct<k0:bigint>"))
    event = lambda seq, op, r, legal, moves, parent: F.struct(seq.alias("seq"), op.alias("op"), r.alias("row"), legal.alias("legal"), moves.alias("moves"), parent.alias("parent"))
    parts = [o.select("__key", event(F.col("seq"), F.col("op"), F.col("row"), F.col("__legal"), F.col("__moves"), F.col("__parent")).alias("e"))]
    touched = o.select("__key").distinct()
    keyed = base.withColumn("__key", _key(spec.pk))
    no_parent = F.lit(None).cast(o.schema["__parent"].dataType)
    mine = keyed.join(touched, "__key", "left_semi")
    parent = _key(spec.fk) if spec.fk else no_parent
    parts.append(mine.select("__key", event(F.lit(-1).cast("long"), F.lit("base"), F.struct(*cols), F.lit(True), F.lit(True), parent).alias("e")))
    if kills is not None:  # each death of a parent that a touched key ever names
        names = parts[0].unionByName(parts[1]).select("__key", F.col("e.parent").alias("__parent")).where("__parent is not null").distinct()
        dead = names.join(kills, "__parent").select("__key", "__parent", F.explode("__kills").alias("seq"))
        parts.append(dead.select("__key", event(F.col("seq"), F.lit("parent_gone"), F.lit(None).cast(o.schema["row"].dataType), F.lit(True), F.lit(False), F.col("__parent")).alias("e")))
    every = reduce(lambda a, b: a.unionByName(b), parts)
    folded = every.groupBy("__key").agg(F.collect_list("e").alias("es")).select(
        "__key", F.array_sort("es", lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)).alias("es")
    )
    state = folded.withColumn("__s", F.aggregate("es", _start(o.schema["row"].dataType, o.schema["__parent"].dataType), lambda s, e: _fold(s, e, cols)))
    changed = state.where("__s.alive").select("__s.row.*")
    hist = state.select("__key", F.col("__s.hist").alias("__hist")).where(F.size("__hist") > 0)
    rest = keyed.join(touched, "__key", "left_anti")
    if kills is not None:
        rest = rest.withColumn("__parent", _key(spec.fk)).join(kills, "__parent", "left")
        gone = rest.where("__kills is not null").select("__key", F.array(F.struct(F.array_min("__kills").alias("seq"), F.lit(False).alias("alive"))).alias("__hist"))
        hist, rest = hist.unionByName(gone), rest.where("__kills is null")
    return rest.select(*cols).unionByName(changed.select(*cols)), hist


def _start(row, parent) -> Column:
    return F.struct(
        F.lit(False).alias("alive"), F.lit(None).cast(row).alias("row"), F.lit(None).cast(parent).alias("parent"),
        F.array().cast("array<struct<seq:bigint,alive:boolean>>").alias("hist"),
    )


def _fold(s: Column, e: Column, cols: list[str]) -> Column:
    """One event on one key's state."""
    op, alive = e["op"], s["alive"]
    born = (op == "base") | (op.isin("insert", "upsert") & ~alive & e["legal"])
    changed = op.isin("update", "upsert") & alive & (e["legal"] | ~e["moves"])
    died = alive & ((op == "delete") | ((op == "parent_gone") & (s["parent"] == e["parent"])))
    merged = F.struct(*(F.coalesce(e["row"][c], s["row"][c]).alias(c) for c in cols))
    now = F.when(born, True).when(F.coalesce(died, F.lit(False)), False).otherwise(alive)
    told = (op != "base") & (now != alive)
    note = F.array(F.struct(e["seq"].alias("seq"), now.alias("alive")))
    return F.struct(
        now.alias("alive"),
        F.when(born, e["row"]).when(changed, merged).otherwise(s["row"]).alias("row"),
        F.when(born | (changed & e["moves"]), e["parent"]).otherwise(s["parent"]).alias("parent"),
        F.when(told, F.concat(s["hist"], note)).otherwise(s["hist"]).alias("hist"),
    )
