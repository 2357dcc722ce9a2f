import random

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.functions import predicates as P
from terrace.operators.combine import repeated
from terrace.operators.nest import LayerSpec, nest, nest_layers
from terrace.operators.store import NestedStore, bulk_load, vacuum
from terrace.plans.cascade import Dataset
from terrace.queries import analytics
from terrace.schema import invalid_rows, leaves, narrow, parse_schema, resolve
from terrace.sources import readers, writers
from terrace.streaming.feed import apply_once, feed

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["q01_pricing", "q03_nested_cascade", "q18_large_orders", "filter_any_order", "filter_sibling_arrays", "having_children_any", "nest_full_outer_stubs", "store_delete_cascade", "store_move_fk"])
def test_queries_match_sql(spark, name):
    db = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "nation", "region", "supplier", "part"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = analytics.QUERIES[name](spark, SF)
    r = db.execute(analytics.SQL[name])
    cols = [c[0] for c in r.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(repr, r.fetchall())) == sorted(repr(tuple(x)) for x in df.select(*cols).collect())


def test_residual_join_counts_before_it_repeats(spark, tmp_path):
    nan, none = float("nan"), None
    frames = {
        "customer": ([(1, 1, 5.0), (2, 1, nan), (3, 1, none), (4, 2, 0.0), (5, none, 5.0), (6, 3, 5.0), (6, 1, 7.0), (none, 1, 7.0)], "c_custkey long, c_nationkey int, c_acctbal double"),
        "supplier": ([(1, 5.0), (1, 5.0), (1, 7.0), (1, nan), (1, none), (2, -0.0), (2, 1.0), (none, 5.0), (3, 5.0)], "s_nationkey int, s_acctbal double"),
        "orders": ([(i, c) for i, c in enumerate([1, 1, 2, 3, 4, 5, 6, 6, 9, none])], "o_orderkey long, o_custkey long"),
    }
    db = duckdb.connect()
    for t, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{t}.parquet")
        db.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    df = analytics.residual_join(spark, str(tmp_path))
    want = db.execute(analytics.SQL["residual_join"]).fetchall()
    assert len(want) == 14 and sorted(map(tuple, df.collect())) == sorted(want)
    assert "NOT (s_acctbal" not in df._jdf.queryExecution().optimizedPlan().toString()  # no pairs of customers and suppliers
    x = spark.createDataFrame([("a", 0), ("b", 1), ("c", 9), ("d", None), ("e", -2), ("f", 8), ("g", 4)], "k string, n long")
    assert {r.k: r["count"] for r in repeated(x, "n", most=4).groupBy("k").count().collect()} == {"b": 1, "c": 9, "f": 8, "g": 4}


def test_schema():
    trip = {"type": "record", "name": "Trip", "fields": [{"name": "km", "type": "double"}, {"name": "fares", "type": {"type": "array", "items": {"type": "record", "name": "Fare", "fields": [{"name": "paid", "type": {"type": "bytes", "logicalType": "decimal", "precision": 9, "scale": 2}}, {"name": "card", "type": {"type": "fixed", "name": "Card", "size": 4}}]}}}]}
    s = parse_schema({"type": "record", "name": "Driver", "fields": [{"name": "driver_id", "type": "long"}, {"name": "shift", "type": {"type": "enum", "name": "Shift", "symbols": ["day", "night"]}}, {"name": "rating", "type": ["null", "float"]}, {"name": "tags", "type": {"type": "map", "values": "string"}}, {"name": "trips", "type": {"type": "array", "items": trip}}]})
    assert leaves(s)["paid"].arrays == ("trips", "fares") and s["rating"].dataType == T.FloatType() and s["trips"].dataType.elementType["fares"].dataType.elementType["paid"].dataType == T.DecimalType(9, 2)
    assert narrow(s, ["paid"]).simpleString() == "struct<trips:array<struct<fares:array<struct<paid:decimal(9,2)>>>>>"
    with pytest.raises(ValueError, match="recursive"):
        parse_schema({"type": "record", "name": "R", "fields": [{"name": "r", "type": {"type": "array", "items": "R"}}]})
    with pytest.raises(ValueError, match="unknown leaves"):
        narrow(s, ["nope"])


def test_evolution_and_validation(spark):
    s = parse_schema({"type": "record", "name": "A", "fields": [{"name": "a", "type": "long"}, {"name": "k", "type": {"type": "enum", "name": "K", "symbols": ["p", "q"]}, "default": "p"}]})
    old = spark.createDataFrame([(1, "z")], "a int, gone string")
    assert [tuple(r) for r in resolve(old, s).collect()] == [(1, "p")]
    assert invalid_rows(spark.createDataFrame([(1, "z"), (2, "q")], "a long, k string"), s).count() == 1


def test_cascade_equals_flat_join_and_prunes(spark, tmp_path):
    rng = random.Random(4)
    a = [(i, rng.randint(0, 3)) for i in range(12)]
    b = [(i, rng.randint(0, 11), rng.randint(0, 3)) for i in range(30)]
    c = [(i, rng.randint(0, 29), rng.randint(0, 3)) for i in range(80)]
    layers = [(LayerSpec("a", ("ak",)), spark.createDataFrame(a, "ak int, av int")), (LayerSpec("b", ("bk",), ("bf",)), spark.createDataFrame(b, "bk int, bf int, bv int")), (LayerSpec("c", ("ck",), ("cf",)), spark.createDataFrame(c, "ck int, cf int, cv int"))]
    nest_layers(layers).write.parquet(str(tmp_path / "n"))
    for _ in range(6):
        limits = {v: rng.randint(0, 3) for v in rng.sample(["av", "bv", "cv"], rng.randint(1, 3))}
        q = Dataset.parquet(spark, str(tmp_path / "n"))
        for v, m in limits.items():
            q = q.where(v, P.at_most(m))
        got = {tuple(r) for r in q.flatten("ak", "bk", "ck").collect()}
        ok = lambda name, v: v <= limits.get(name, 9)
        want = {(x, y, z) for x, xv in a for y, yf, yv in b for z, zf, zv in c if yf == x and zf == y and ok("av", xv) and ok("bv", yv) and ok("cv", zv)}
        assert got == want
    plan = Dataset.parquet(spark, str(tmp_path / "n")).where("cv", P.at_most(1)).project("ak").table()._jdf.queryExecution().toString()
    assert "ReadSchema: struct<ak:int,bList:array<struct<cList:array<struct<cv:int>>>>>" in plan


def test_nest_orphans(spark):
    p, c = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(7, 1), (8, 3)], "c int, f int")
    sizes = lambda how: {r.k: len(r.l) for r in nest(p, c, ("k",), ("f",), "l", how).collect()}
    assert sizes("drop") == {1: 1, 2: 0} and sizes("stub") == {1: 1, 2: 0, 3: 1}
    with pytest.raises(Exception, match="no parent"):
        sizes("error")


def test_nest_lists_children_after_they_are_dealt_out(spark):
    p, c = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(8, 1), (7, 1), (9, None)], "c int, f int")
    x = nest(p, c, ("k",), ("f",), "l")
    plan = x._jdf.queryExecution().executedPlan().toString().splitlines()
    deep = lambda word: [(i, len(s) - len(s.lstrip(" :+-"))) for i, s in enumerate(plan) if word in s]
    (early, _), *others = deep("partial_collect_list")
    dealt = [i for i, _ in deep("Exchange hashpartitioning(f#")]
    assert not others and len(dealt) == 1 and dealt[0] > early, plan  # one exchange of the children, below both aggregates
    assert not deep("Exchange hashpartitioning(k#")[1:], plan
    assert {r.k: [y.c for y in r.l] for r in x.collect()} == {1: [7, 8], 2: []}


def model_apply(tables, ops):
    """One operation at a time. tables: three dicts key -> [fk, value]."""

    def kill(layer, key):
        del tables[layer][key]
        if layer < 2:
            for k in [k for k, r in tables[layer + 1].items() if r[0] == key]:
                kill(layer + 1, k)

    for _, layer, op, key, fk, value in ops:
        t = tables[layer]
        up_lives = layer == 0 or fk in tables[layer - 1]
        if op == "delete":
            if key in t:
                kill(layer, key)
        elif key in t:
            if op in ("update", "upsert") and (layer == 0 or fk is None or up_lives):
                t[key] = [t[key][0] if fk is None else fk, t[key][1] if value is None else value]
        elif op in ("insert", "upsert") and up_lives and (layer == 0 or fk is not None):
            t[key] = [fk, value]


def test_store_equals_sequential_model(spark, tmp_path):
    rng = random.Random(9)
    specs = [LayerSpec("a", ("k",)), LayerSpec("b", ("k",), ("f",)), LayerSpec("c", ("k",), ("f",))]
    tables = [{k: [None, k] for k in range(6)}, {k: [k % 6, k] for k in range(14)}, {k: [k % 14, k] for k in range(30)}]
    schema = "k long, f long, v long"
    store = bulk_load([(s, spark.createDataFrame([(k, *r) for k, r in t.items()], schema)) for s, t in zip(specs, tables, strict=True)])
    ops = []
    for seq in range(70):
        layer = rng.choice([0, 1, 1, 2, 2])
        fk = None if layer == 0 or rng.random() < 0.3 else rng.randint(0, [7, 16][layer - 1])
        ops.append((seq, layer, rng.choice(["insert", "update", "upsert", "delete"]), rng.randint(0, [8, 18, 36][layer]), fk, rng.choice([None, seq + 100])))
    frames = {s.name: spark.createDataFrame([(o[0], o[2], o[3], o[4], o[5]) for o in ops if o[1] == i] or [], "seq long, op string, " + schema) for i, s in enumerate(specs)}
    got = store.apply(frames)
    model_apply(tables, ops)
    for i, s in enumerate(specs):
        assert {r.k: [r.f, r.v] for r in got.layer(s.name)[1].collect()} == tables[i], s.name
    assert got.save(spark, str(tmp_path / "s")) == 1 and got.save(spark, str(tmp_path / "s")) == 2
    assert NestedStore.open(spark, str(tmp_path / "s")).layer("c")[1].count() == len(tables[2])


def test_feed_applies_each_batch_once(spark, tmp_path):
    root, ops = str(tmp_path / "s"), "seq long, op string, k long, v long"
    bulk_load([(LayerSpec("a", ("k",)), spark.createDataFrame([(1, 1)], "k long, v long"))]).save(spark, root)
    rows = lambda: {r.k: r.v for r in NestedStore.open(spark, root).layer("a")[1].collect()}
    spark.createDataFrame([(0, "insert", 2, 2), (1, "delete", 1, None)], ops).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ops).parquet(str(tmp_path / "in"))
    feed(stream, "a", root, str(tmp_path / "c")).awaitTermination()
    assert rows() == {2: 2}
    again = spark.createDataFrame([(0, "upsert", 2, 9)], ops)
    assert not apply_once(again, "a", root, str(tmp_path / "c"), 0) and rows() == {2: 2}
    assert apply_once(again, "a", root, str(tmp_path / "c"), 1) and rows() == {2: 9}
    vacuum(spark, root, 1)
    assert rows() == {2: 9} and not (tmp_path / "s" / "v1").exists() and not (tmp_path / "s" / "v2").exists()


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "x.tbl").write_text("1|a b|true|\n2||false|\n")
    df = readers.delimited(spark, str(tmp_path / "x.tbl"), T.StructType.fromDDL("k int, s string, b boolean"))
    assert [(r.k, r.b) for r in df.orderBy("k").collect()] == [(1, True), (2, False)]
    writers.partitioned(df, str(tmp_path / "p"), "k", 4)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    writers.write(df, str(tmp_path / "w"), "deflate", rows_per_file=1, keys=["k"])
    writers.merge_files(spark, [str(tmp_path / "w"), str(tmp_path / "w")], str(tmp_path / "m"), 2, ["k"])
    assert spark.read.parquet(str(tmp_path / "m")).count() == 4
    with pytest.raises(ValueError, match="codec"):
        writers.codec("lz9")
    writers.translate(df, str(tmp_path / "j"), "json")
    assert readers.json_lines(spark, str(tmp_path / "j"), df.schema).count() == 2
    assert F is not None
