"""The registered queries of the engine itself, each with its SQL. Results are flat."""

from __future__ import annotations

import datetime as dt
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.functions import predicates as P
from terrace.functions.scalars import decimal_from_bytes, key_text, money, revenue
from terrace.operators.combine import concat, numbered, ordered, overlay, repeated, sorted_merge
from terrace.operators.nest import LayerSpec, child_keys, nest, nest_layers, parent_of
from terrace.operators.positions import row_slice, seek
from terrace.operators.store import NestedStore, bulk_load
from terrace.plans.cascade import Dataset
from terrace.schema import invalid_rows, narrow, resolve
from terrace.session import shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CUSTOMER, ORDER, LINE = LayerSpec("customer", ("c_custkey",)), LayerSpec("order", ("o_orderkey",), ("o_custkey",)), LayerSpec("line", ("l_orderkey", "l_no"), ("l_orderkey",))
day = dt.datetime.fromisoformat


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def stored(s: SparkSession, d: str) -> str:
    """Path of the nested table of all columns, customers with orders with lines, stored once by session and data folder."""
    path = f"{shared_dir(s)}/terrace-nested-{s.sparkContext.applicationId}-{zlib.crc32(d.encode())}"
    at = s.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).exists(at):
        layers = [(CUSTOMER, table(s, d, "customer")), (ORDER, table(s, d, "orders")), (LayerSpec("line", ("l_orderkey",), ("l_orderkey",)), table(s, d, "lineitem"))]
        nest_layers(layers).write.mode("overwrite").parquet(path)
    return path


def nested(s: SparkSession, d: str, customer: list[str] = ["c_custkey"], orders: list[str] = ["o_orderkey", "o_custkey"], lines: list[str] = ["l_orderkey"]) -> Dataset:  # noqa: B006
    """Customers with their orders with their lines, of the named columns, from the stored nested table."""
    path = stored(s, d)
    return Dataset.parquet(s, path, narrow(s.read.parquet(path).schema, [*customer, *orders, *lines]))


REV = "sum(cast(l_extendedprice as decimal(12,2)) * (cast(1 as decimal(12,2)) - cast(l_discount as decimal(12,2))))"
FLAT = "customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey"


def rev():
    return F.sum(revenue(F.col("l_extendedprice"), F.col("l_discount")))


def dbl(c, name: str):
    return c.cast("double").alias(name)


# ---- analyses


@query(f"select l_returnflag, l_linestatus, cast(sum(cast(l_quantity as decimal(12,2))) as double) sum_qty, cast(sum(cast(l_extendedprice as decimal(12,2))) as double) sum_price, cast(sum(cast(l_discount as decimal(12,2))) as double) sum_disc, cast({REV} as double) sum_disc_price, cast(sum(cast(l_extendedprice as decimal(12,2)) * (cast(1 as decimal(12,2)) - cast(l_discount as decimal(12,2))) * (cast(1 as decimal(12,2)) + cast(l_tax as decimal(12,2)))) as double) sum_charge, count(*) n from lineitem where l_shipdate <= timestamp '1998-09-01' group by all")
def q01_pricing(s, d):
    x = table(s, d, "lineitem").where(F.col("l_shipdate") <= F.lit(day("1998-09-01")))
    charge = revenue(F.col("l_extendedprice"), F.col("l_discount")) * (F.lit(1).cast("decimal(12,2)") + money("l_tax"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(dbl(F.sum(money("l_quantity")), "sum_qty"), dbl(F.sum(money("l_extendedprice")), "sum_price"), dbl(F.sum(money("l_discount")), "sum_disc"), dbl(rev(), "sum_disc_price"), dbl(F.sum(charge), "sum_charge"), F.count("*").alias("n"))


@query("select l_returnflag, l_linestatus, round(cast(sum(cast(l_quantity as decimal(12,2))) as double) / count(*), 6) avg_qty, round(cast(sum(cast(l_extendedprice as decimal(12,2))) as double) / count(*), 6) avg_price, round(cast(sum(cast(l_discount as decimal(12,2))) as double) / count(*), 6) avg_disc, count(*) n from lineitem where l_shipdate <= timestamp '1998-09-01' group by all")
def q01_pricing_avg(s, d):
    x = table(s, d, "lineitem").where(F.col("l_shipdate") <= F.lit(day("1998-09-01")))
    avg = lambda c, n: F.round(F.sum(money(c)).cast("double") / F.count("*"), 6).alias(n)
    return x.groupBy("l_returnflag", "l_linestatus").agg(avg("l_quantity", "avg_qty"), avg("l_extendedprice", "avg_price"), avg("l_discount", "avg_disc"), F.count("*").alias("n"))


@query("select p_partkey, p_brand, s_suppkey, s_name, cast(cost as double) min_cost from (select *, min(cost) over (partition by p_partkey) least from (select p_partkey, p_brand, s_suppkey, s_name, min(cast(l_extendedprice / l_quantity as decimal(12,2))) cost from part join lineitem on l_partkey = p_partkey join supplier on s_suppkey = l_suppkey where p_size = 15 and regexp_matches(p_type, '(ARGE|MALL)$') group by all)) where cost = least")
def q02_least_cost(s, d):
    """The cheapest suppliers of each part; the unit price of its lines stands in for a supply cost."""
    part = table(s, d, "part").where((F.col("p_size") == 15) & P.finds("(ARGE|MALL)$")(F.col("p_type"))).select("p_partkey", "p_brand")
    lines = table(s, d, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity")).cast("decimal(12,2)").alias("cost"))
    x = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_partkey", "p_brand", "l_suppkey").agg(F.min("cost").alias("cost"))
    x = x.withColumn("least", F.min("cost").over(W.partitionBy("p_partkey"))).where("cost = least")
    return x.join(table(s, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).select("p_partkey", "p_brand", "s_suppkey", "s_name", dbl(F.col("cost"), "min_cost"))


Q03 = "c_mktsegment = 'BUILDING' and o_orderdate < timestamp '1998-03-15' and l_shipdate > timestamp '1998-03-15'"


@query(f"select o_orderkey, o_orderpriority, cast({REV} as double) revenue from {FLAT} where {Q03} group by all")
def q03_revenue(s, d):
    c = table(s, d, "customer").where(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    o = table(s, d, "orders").where(F.col("o_orderdate") < F.lit(day("1998-03-15"))).select("o_orderkey", "o_custkey", "o_orderpriority")
    x = table(s, d, "lineitem").where(F.col("l_shipdate") > F.lit(day("1998-03-15"))).select("l_orderkey", "l_extendedprice", "l_discount")
    x = x.join(o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi"), F.col("l_orderkey") == F.col("o_orderkey"))
    return x.groupBy("o_orderkey", "o_orderpriority").agg(dbl(rev(), "revenue"))


@query(SQL["q03_revenue"])
def q03_nested_cascade(s, d):
    """The same as a cascading filter over the nested table."""
    x = nested(s, d, ["c_custkey", "c_mktsegment"], ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"], ["l_orderkey", "l_shipdate", "l_extendedprice", "l_discount"])
    x = x.where("c_mktsegment", P.equal("BUILDING")).where("o_orderdate", P.less(day("1998-03-15"))).where("l_shipdate", P.greater(day("1998-03-15")))
    return x.flatten("o_orderkey", "o_orderpriority", "l_extendedprice", "l_discount").groupBy("o_orderkey", "o_orderpriority").agg(dbl(rev(), "revenue"))


@query("select o_orderpriority, count(*) n from orders where o_orderdate >= timestamp '1996-07-01' and o_orderdate < timestamp '1996-10-01' and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_shipdate > o_orderdate + interval 60 day) group by all")
def q04_exists_child(s, d):
    o = table(s, d, "orders").where(P.half_open(day("1996-07-01"), day("1996-10-01"))(F.col("o_orderdate")))
    late = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") > F.col("o_orderdate") + F.expr("interval 60 days"))
    return o.join(table(s, d, "lineitem"), late, "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query(f"select n_name, cast({REV} as double) revenue from {FLAT} join supplier on s_suppkey = l_suppkey and s_nationkey = c_nationkey join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey where r_name = 'ASIA' and o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1997-01-01' group by all")
def q05_local_supplier(s, d):
    n = table(s, d, "nation").join(table(s, d, "region").where(F.col("r_name") == "ASIA"), F.col("r_regionkey") == F.col("n_regionkey"), "left_semi")
    sup = table(s, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    o = table(s, d, "orders").where(P.half_open(day("1996-01-01"), day("1997-01-01"))(F.col("o_orderdate")))
    o = o.join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    x = table(s, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.join(sup, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
    return x.groupBy("n_name").agg(dbl(rev(), "revenue"))


Q06 = "l_quantity < 24 and l_discount >= 0.05 and l_discount <= 0.07 and l_shipdate >= timestamp '1996-01-01' and l_shipdate < timestamp '1997-01-01'"


@query(f"select cast(sum(cast(l_extendedprice as decimal(12,2)) * cast(l_discount as decimal(12,2))) as double) revenue, count(*) n from lineitem where {Q06}")
def q06_forecast(s, d):
    x = table(s, d, "lineitem").where((F.col("l_quantity") < 24) & F.col("l_discount").between(0.05, 0.07) & P.half_open(day("1996-01-01"), day("1997-01-01"))(F.col("l_shipdate")))
    return x.agg(dbl(F.sum(money("l_extendedprice") * money("l_discount")), "revenue"), F.count("*").alias("n"))


@query(f"select c.n_name cust_nation, s.n_name supp_nation, year(l_shipdate) l_year, cast({REV} as double) revenue from {FLAT} join supplier on s_suppkey = l_suppkey join nation c on c.n_nationkey = c_nationkey join nation s on s.n_nationkey = s_nationkey where c.n_name in ('NATION_3', 'NATION_7') and s.n_name in ('NATION_3', 'NATION_7') and c.n_name <> s.n_name and l_shipdate between timestamp '1995-01-01' and timestamp '1998-12-31' group by all")
def q07_volume(s, d):
    n = table(s, d, "nation").where(F.col("n_name").isin("NATION_3", "NATION_7"))
    c = table(s, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("cust_nation"))
    sup = table(s, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("supp_nation"))
    o = table(s, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "cust_nation")
    x = table(s, d, "lineitem").where(F.col("l_shipdate").between(F.lit(day("1995-01-01")), F.lit(day("1998-12-31")))).join(sup, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return x.where("cust_nation <> supp_nation").groupBy("cust_nation", "supp_nation", F.year("l_shipdate").cast("long").alias("l_year")).agg(dbl(rev(), "revenue"))


@query(f"select c_custkey, c_name, n_name, cast(cast(c_acctbal as decimal(12,2)) as double) c_acctbal, cast({REV} as double) revenue from {FLAT} join nation on n_nationkey = c_nationkey where l_returnflag = 'R' and o_orderdate >= timestamp '1996-10-01' and o_orderdate < timestamp '1997-01-01' group by all")
def q10_returned(s, d):
    o = table(s, d, "orders").where(P.half_open(day("1996-10-01"), day("1997-01-01"))(F.col("o_orderdate"))).select("o_orderkey", "o_custkey")
    x = table(s, d, "lineitem").where(F.col("l_returnflag") == "R").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.groupBy("o_custkey").agg(rev().alias("revenue")).join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return x.join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name", dbl(money("c_acctbal"), "c_acctbal"), dbl(F.col("revenue"), "revenue"))


@query("select cast(sum(cast(l_extendedprice as decimal(12,2)) * cast(l_discount as decimal(12,2))) as double) revenue from lineitem where l_shipdate >= timestamp '1996-03-02' and l_shipdate < timestamp '1996-06-02'")
def q15_window_sum(s, d):
    x = table(s, d, "lineitem").where(P.half_open(day("1996-03-02"), day("1996-06-02"))(F.col("l_shipdate")))
    return x.agg(dbl(F.sum(money("l_extendedprice") * money("l_discount")), "revenue"))


@query("select c_custkey, c_name, o_orderkey, cast(cast(o_totalprice as decimal(12,2)) as double) o_totalprice, cast(sum(cast(l_quantity as decimal(12,2))) as double) sum_qty from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey group by all having sum(cast(l_quantity as decimal(12,2))) > 300")
def q18_large_orders(s, d):
    x = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum(money("l_quantity")).alias("q")).where("q > 300")
    x = x.join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return x.select("c_custkey", "c_name", "o_orderkey", dbl(money("o_totalprice"), "o_totalprice"), dbl(F.col("q"), "sum_qty"))


@query(f"select cast({REV} as double) revenue, count(*) n, (select count(*) from lineitem where l_discount > 0.05) * 1.0 / count(*) share from lineitem")
def selectivity(s, d):
    x = table(s, d, "lineitem")
    return x.agg(dbl(rev(), "revenue"), F.count("*").alias("n"), (F.count(F.when(F.col("l_discount") > 0.05, 1)) / F.count("*")).alias("share"))


# ---- cascading filters

WHERE = {
    "filter_single_layer": ("c_acctbal > 5000", {"c_acctbal": P.greater(5000.0)}),
    "filter_cascade_down": ("c_mktsegment = 'BUILDING' and o_orderstatus = 'F'", {"c_mktsegment": P.equal("BUILDING"), "o_orderstatus": P.equal("F")}),
    "filter_cascade_up": ("l_quantity < 3", {"l_quantity": P.less(3.0)}),
    "filter_deep_only_exists_parents": ("l_returnflag = 'R' and c_acctbal < 0", {"l_returnflag": P.equal("R"), "c_acctbal": P.less(0.0)}),
    "filter_any_order": ("l_quantity > 45 and c_mktsegment = 'MACHINERY' and o_totalprice > 100000", {"l_quantity": P.greater(45.0), "c_mktsegment": P.equal("MACHINERY"), "o_totalprice": P.greater(100000.0)}),
}
C, O, L = ["c_custkey", "c_acctbal", "c_mktsegment"], ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"], ["l_orderkey", "l_quantity", "l_returnflag"]


def _filtered(name: str) -> None:
    cond, filters = WHERE[name]

    def run(s, d):
        x = nested(s, d, C, O, L)
        for leaf, p in filters.items():
            x = x.where(leaf, p)
        return x.flatten("c_custkey", "o_orderkey", "l_quantity")

    run.__name__ = name
    query(f"select c_custkey, o_orderkey, l_quantity from {FLAT} where {cond}")(run)


for _name in WHERE:
    _filtered(_name)


@query("select c_custkey, count(o_orderkey) n_orders from customer left join orders on o_custkey = c_custkey and o_orderdate < timestamp '1995-01-10' where c_mktsegment = 'BUILDING' group by all")
def filter_root_only_keeps_childless(s, d):
    o = table(s, d, "orders").where(F.col("o_orderdate") < F.lit(day("1995-01-10")))
    x = Dataset.of(nest(table(s, d, "customer"), o, ("c_custkey",), ("o_custkey",), "orders")).where("c_mktsegment", P.equal("BUILDING")).table()
    return x.select("c_custkey", F.size("orders").cast("long").alias("n_orders"))


@query(f"with k as (select * from {FLAT} where o_totalprice > 150000 and l_quantity > 40) select 'root' layer, count(distinct c_custkey) n from k union all select 'orderList', count(distinct o_orderkey) from k union all select 'lineList', count(*) from k")
def filter_surviving_counts_per_layer(s, d):
    return nested(s, d, C, O, L).where("o_totalprice", P.greater(150000.0)).where("l_quantity", P.greater(40.0)).counts()


@query("select distinct o_orderkey from orders join lineitem on l_orderkey = o_orderkey where l_quantity = 50")
def surviving_set(s, d):
    return nested(s, d, C, O, L).where("l_quantity", P.equal(50.0)).survivors("o_orderkey")


@query("with e as (select o_custkey, o_orderkey from orders where o_totalprice > 300000), f as (select o_custkey, o_orderkey from orders where o_orderstatus = 'P') select c_custkey, (select count(*) from e where o_custkey = c_custkey) n_dear, (select count(*) from f where o_custkey = c_custkey) n_open from customer where c_custkey in (select o_custkey from e) and c_custkey in (select o_custkey from f)")
def filter_sibling_arrays(s, d):
    """Two arrays under one root: a root stays if both have a match."""
    o = table(s, d, "orders")
    a = o.select("o_custkey", F.col("o_orderkey").alias("a_key"), F.col("o_totalprice").alias("a_price"))
    b = o.select(F.col("o_custkey").alias("b_cust"), F.col("o_orderkey").alias("b_key"), F.col("o_orderstatus").alias("b_status"))
    x = nest(nest(table(s, d, "customer").select("c_custkey"), a, ("c_custkey",), ("o_custkey",), "As"), b, ("c_custkey",), ("b_cust",), "Bs")
    x = Dataset.of(x).where("a_price", P.greater(300000.0)).where("b_status", P.equal("P")).table()
    return x.select("c_custkey", F.size("As").cast("long").alias("n_dear"), F.size("Bs").cast("long").alias("n_open"))


@query("select o_orderkey from orders join lineitem on l_orderkey = o_orderkey group by 1 having max(case when l_quantity = 50 then 1 else 0 end) = 1")
def having_children_any(s, d):
    x = nested(s, d, C, O, L).having("l_quantity", lambda v: F.exists(v, lambda q: q == 50.0))
    return x.survivors("o_orderkey")


# ---- predicates

PRED = {
    "pred_eq": ("customer", "c_custkey", "c_mktsegment", P.equal("BUILDING"), "c_mktsegment = 'BUILDING'"),
    "pred_lt": ("orders", "o_orderkey", "o_orderdate", P.less(day("1996-03-15")), "o_orderdate < timestamp '1996-03-15'"),
    "pred_le": ("lineitem", "l_orderkey", "l_shipdate", P.at_most(day("1996-03-15")), "l_shipdate <= timestamp '1996-03-15'"),
    "pred_gt": ("lineitem", "l_orderkey", "l_shipdate", P.greater(day("1999-03-15")), "l_shipdate > timestamp '1999-03-15'"),
    "pred_between": ("lineitem", "l_orderkey", "l_discount", P.between(0.05, 0.07), "l_discount >= 0.05::double and l_discount <= 0.07::double"),
    "pred_half_open": ("orders", "o_orderkey", "o_orderdate", P.half_open(day("1996-01-01"), day("1996-04-01")), "o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1996-04-01'"),
    "pred_number_lt": ("lineitem", "l_orderkey", "l_quantity", P.less(5.0), "l_quantity < 5"),
    "pred_number_eq": ("part", "p_partkey", "p_size", P.equal(15), "p_size = 15"),
    "pred_bytes_eq": ("lineitem", "l_orderkey", "l_returnflag", P.bytes_equal(b"R"), "l_returnflag = 'R'"),
    "pred_isin": ("customer", "c_custkey", "c_nationkey", P.one_of([1, 3, 5]), "c_nationkey in (1, 3, 5)"),
    "pred_regex_find": ("part", "p_partkey", "p_type", P.finds("ARGE$"), "regexp_matches(p_type, 'ARGE$')"),
    "pred_fullmatch": ("part", "p_partkey", "p_type", P.matches("[A-Z]+Y"), "regexp_full_match(p_type, '[A-Z]+Y')"),
    "pred_contains": ("customer", "c_custkey", "c_name", P.contains("11"), "contains(c_name, '11')"),
    "pred_token": ("benchmark", "item_id", "text", P.has_token("the"), "list_contains(string_split(text, ' '), 'the')"),
    "pred_text_lt": ("customer", "c_custkey", "c_custkey", P.text_less("3"), "cast(c_custkey as varchar) < '3'"),
    "pred_opaque": ("part", "p_partkey", "p_size", P.opaque(lambda v: v is not None and v % 7 == 3), "p_size % 7 = 3"),
    "pred_json_config": ("lineitem", "l_orderkey", "l_quantity", P.from_json({"LineItem.l_quantity": {"begin": 10.0, "end": 20.0}})["l_quantity"], "l_quantity >= 10 and l_quantity < 20"),
}


def _pred(name: str) -> None:
    t, key, leaf, p, cond = PRED[name]

    def run(s, d):
        return table(s, d, t).where(p(F.col(leaf))).select(key)

    run.__name__ = name
    query(f"select {key} from {t} where {cond}")(run)


for _name in PRED:
    _pred(_name)


@query("select l_orderkey, l_linenumber from lineitem where l_suppkey in (select s_suppkey from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey where r_name = 'EUROPE')")
def semi_join_keyset(s, d):
    n = table(s, d, "nation").join(table(s, d, "region").where(F.col("r_name") == "EUROPE"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    keys = table(s, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select(F.col("s_suppkey").alias("l_suppkey"))
    return P.semi_join(table(s, d, "lineitem"), keys, "l_suppkey").select("l_orderkey", "l_linenumber")


@query("select l_orderkey, l_quantity from lineitem where l_shipdate >= timestamp '1996-01-01' and l_discount > 0.03 and l_tax < 0.05")
def scan_three_predicates(s, d):
    x = table(s, d, "lineitem").where((F.col("l_shipdate") >= F.lit(day("1996-01-01"))) & (F.col("l_discount") > 0.03) & (F.col("l_tax") < 0.05))
    return x.select("l_orderkey", "l_quantity")


# ---- projections, positions, nesting


@query(f"select l_quantity, l_returnflag from {FLAT}")
def project_flatten_leaf(s, d):
    return nested(s, d, C, O, L).flatten("l_quantity", "l_returnflag")


@query("select c_custkey, count(o_orderkey) n, coalesce(sum(o_orderkey), 0) keys from customer left join orders on o_custkey = c_custkey group by all")
def project_nested_subset(s, d):
    x = nested(s, d, C, O, L).project("c_custkey", "o_orderkey").table()
    keys = F.aggregate("orderList", F.lit(0).cast("long"), lambda a, o: a + o["o_orderkey"])
    return x.select("c_custkey", F.size("orderList").cast("long").alias("n"), keys.cast("decimal(38,0)").cast("double").alias("keys")).withColumn("keys", F.col("keys").cast("long"))


SQL["project_nested_subset"] = SQL["project_nested_subset"].replace("coalesce(sum(o_orderkey), 0)", "cast(coalesce(sum(o_orderkey), 0) as bigint)")


@query("select 'root' layer, count(*) n from customer union all select 'orderList', count(*) from orders union all select 'lineList', count(*) from lineitem")
def layer_counts(s, d):
    return nested(s, d).counts()


@query("select * from (select row_number() over (order by o_orderkey) - 1 row_index, o_orderkey from orders) where row_index >= 100 and row_index < 110")
def row_slice_positions(s, d):
    return row_slice(s, f"{d}/orders.parquet", 100, 10, ["o_orderkey"])


@query("select o_orderkey, count(l_orderkey) n from orders left join lineitem on l_orderkey = o_orderkey group by all")
def nest_left_outer_sizes(s, d):
    x = nest(table(s, d, "orders"), table(s, d, "lineitem"), ("o_orderkey",), ("l_orderkey",), "lines")
    return x.select("o_orderkey", F.size("lines").cast("long").alias("n"))


@query("with o as (select * from orders where o_orderkey % 3 <> 0) select coalesce(o_orderkey, l_orderkey) o_orderkey, o_custkey is null stub, count(l_orderkey) n from o full join lineitem on l_orderkey = o_orderkey group by all")
def nest_full_outer_stubs(s, d):
    o = table(s, d, "orders").where("o_orderkey % 3 <> 0")
    x = nest(o, table(s, d, "lineitem"), ("o_orderkey",), ("l_orderkey",), "lines", orphans="stub")
    return x.select("o_orderkey", F.col("o_custkey").isNull().alias("stub"), F.size("lines").cast("long").alias("n"))


@query("with o as (select * from orders where o_orderkey % 3 <> 0) select o_orderkey, count(l_orderkey) n from o left join lineitem on l_orderkey = o_orderkey group by all")
def nest_drop_orphans(s, d):
    x = nest(table(s, d, "orders").where("o_orderkey % 3 <> 0"), table(s, d, "lineitem"), ("o_orderkey",), ("l_orderkey",), "lines")
    return x.select("o_orderkey", F.size("lines").cast("long").alias("n"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from lineitem")
def unnest_roundtrip(s, d):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    return nested(s, d, ["c_custkey"], ["o_orderkey", "o_custkey"], cols).flatten(*cols)


@query("select p_partkey, count(l_partkey) n, cast(coalesce(sum(cast(l_quantity as decimal(12,2))), 0) as double) qty from part left join lineitem on l_partkey = p_partkey group by all")
def nest_part_lines(s, d):
    x = nest(table(s, d, "part").select("p_partkey"), table(s, d, "lineitem").select("l_partkey", "l_quantity"), ("p_partkey",), ("l_partkey",), "lines")
    return x.select("p_partkey", F.size("lines").cast("long").alias("n"), dbl(F.aggregate("lines", F.lit(0).cast("decimal(22,2)"), lambda a, y: (a + money(y["l_quantity"])).cast("decimal(22,2)")), "qty"))


@query("select conv_id, count(*) n_turns, max(length(text)) longest from conversations group by all")
def nest_conversations(s, d):
    x = nest(table(s, d, "conversations").select("conv_id").distinct(), table(s, d, "conversations").withColumnRenamed("conv_id", "of"), ("conv_id",), ("of",), "turns")
    return x.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_max(F.transform("turns", lambda t: F.length(t["text"]))).cast("long").alias("longest"))


@query("select o_orderkey, o_custkey from orders")
def parent_lookup(s, d):
    return parent_of(table(s, d, "orders"), ("o_orderkey",), ("o_custkey",))


@query("select o_custkey, count(*) n, min(o_orderkey) first_child, max(o_orderkey) last_child from orders group by all")
def child_keys_lookup(s, d):
    x = child_keys(table(s, d, "orders"), ("o_custkey",), ("o_orderkey",))
    return x.select("o_custkey", F.size("children").cast("long").alias("n"), F.element_at("children", 1)["o_orderkey"].alias("first_child"), F.element_at("children", -1)["o_orderkey"].alias("last_child"))


@query("select c_custkey, o_orderkey from customer join orders on o_custkey = c_custkey join supplier on s_nationkey = c_nationkey where s_acctbal <> c_acctbal")
def residual_join(s, d):
    """A customer's suppliers are counted, all of its nation but those of its own balance; each order is then repeated so often."""
    sup = table(s, d, "supplier").where("s_nationkey is not null and s_acctbal is not null").groupBy("s_nationkey", "s_acctbal").agg(F.count("*").alias("same"))
    every = sup.groupBy("s_nationkey").agg(F.sum("same").alias("every"))
    c = table(s, d, "customer").where(F.col("c_acctbal").isNotNull()).join(every, F.col("c_nationkey") == F.col("s_nationkey")).select("c_custkey", "c_nationkey", "c_acctbal", "every")
    c = c.join(sup, (F.col("c_nationkey") == F.col("s_nationkey")) & (F.col("c_acctbal") == F.col("s_acctbal")), "left")
    c = c.select("c_custkey", (F.col("every") - F.coalesce("same", F.lit(0))).alias("n")).where("n > 0")
    x = c.join(table(s, d, "orders"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey", "n")
    return repeated(x, "n")


# ---- merges and orders


@query("select o_orderkey from orders where o_orderstatus = 'F' union all select o_orderkey from orders where o_totalprice > 200000")
def concat_files(s, d):
    o = table(s, d, "orders")
    return concat(o.where("o_orderstatus = 'F'"), o.where("o_totalprice > 200000")).select("o_orderkey")


@query("select row_number() over (order by o_orderkey, source) pos, o_orderkey, source from (select o_orderkey, 0 source from orders where o_orderkey % 2 = 0 union all select o_orderkey, 1 from orders where o_orderkey % 3 = 0)")
def sorted_merge_first(s, d):
    """A merge with each row's position."""
    o = table(s, d, "orders").select("o_orderkey")
    x = sorted_merge(["o_orderkey"], o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0"))
    return numbered(x).select("pos", "o_orderkey", "source")


@query("select row_number() over (order by r, o_totalprice desc, o_orderkey) pos, o_orderkey from (select *, list_position(['5-LOW', '1-URGENT', '3-MEDIUM'], o_orderpriority) r from orders where o_orderpriority in ('5-LOW', '1-URGENT', '3-MEDIUM'))")
def order_enum_first(s, d):
    """Positions by enum order, then price descending."""
    rank = ["5-LOW", "1-URGENT", "3-MEDIUM"]
    o = table(s, d, "orders").where(F.col("o_orderpriority").isin(*rank))
    x = ordered(o, {"o_orderpriority": "ascending", "o_totalprice": "descending", "o_orderkey": "ascending"}, {"o_orderpriority": rank})
    return numbered(x.select("o_orderkey")).select("pos", "o_orderkey")


@query("select c_custkey, trim(c_name) || '|' || trim(c_mktsegment) k from customer")
def key_texts(s, d):
    return table(s, d, "customer").select("c_custkey", key_text("c_name", "c_mktsegment").alias("k"))


# ---- keyed store


def _store(s, d) -> NestedStore:
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    no = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*table(s, d, "lineitem").columns)).cast("long").alias("l_no")
    x = table(s, d, "lineitem").select("l_orderkey", no, "l_quantity")
    return bulk_load([(CUSTOMER, table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal")), (ORDER, o), (LINE, x)])


NUMBERED = "(select l_orderkey, row_number() over (partition by l_orderkey order by l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) l_no, l_quantity from lineitem)"


def _ops(df: DataFrame, op: str) -> DataFrame:
    """One operation a key, the first column, in the order of keys; a number that is the same whenever it is computed."""
    return df.withColumn("op", F.lit(op)).withColumn("seq", F.col(df.columns[0]))


@query("select c_custkey, c_name from customer where c_custkey % 10 = 1")
def store_search(s, d):
    keys = table(s, d, "customer").where("c_custkey % 10 = 1").select("c_custkey")
    return _store(s, d).search("customer", keys, ["c_name"])


@query("select c_custkey, case when c_custkey % 4 = 0 then 'n' || c_custkey else c_name end c_name, cast(c_acctbal as double) c_acctbal from customer")
def store_search_overlay(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    delta = c.where("c_custkey % 4 = 0").select("c_custkey", F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("c_name"), F.lit(None).cast("double").alias("c_acctbal"))
    return overlay(c, delta, ["c_custkey"])


@query("select c_custkey, c_name, c_acctbal from customer union all select c_custkey + 1000000, c_name, c_acctbal from customer where c_custkey % 5 = 0")
def store_insert(s, d):
    """New keys are inserted, known ones are left alone."""
    c = table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal").where("c_custkey % 5 = 0")
    new = concat(c.withColumn("c_custkey", F.col("c_custkey") + 1000000), c.withColumn("c_name", F.lit("x")))
    return _store(s, d).apply({"customer": _ops(new, "insert")}).layer("customer")[1]


@query("select o_orderkey, o_custkey, case when o_orderkey % 6 = 0 then 'X' else o_orderstatus end o_orderstatus, o_totalprice from orders")
def store_update_partial(s, d):
    o = table(s, d, "orders").where("o_orderkey % 6 = 0").select("o_orderkey", F.lit(None).cast("long").alias("o_custkey"), F.lit("X").alias("o_orderstatus"), F.lit(None).cast("double").alias("o_totalprice"))
    return _store(s, d).apply({"order": _ops(o, "update")}).layer("order")[1]


@query("select c_custkey, case when c_custkey % 3 = 0 then 'u' else c_name end c_name, c_acctbal from customer union all select c_custkey + 2000000, 'u', null from customer where c_custkey % 3 = 0")
def store_upsert(s, d):
    c = table(s, d, "customer").where("c_custkey % 3 = 0").select("c_custkey", F.lit("u").alias("c_name"), F.lit(None).cast("double").alias("c_acctbal"))
    new = concat(c, c.withColumn("c_custkey", F.col("c_custkey") + 2000000))
    return _store(s, d).apply({"customer": _ops(new, "upsert")}).layer("customer")[1]


@query(f"select 'customer' layer, count(*) n from customer where c_custkey % 4 <> 0 union all select 'order', count(*) from orders where o_custkey % 4 <> 0 union all select 'line', count(*) from {NUMBERED} join orders on o_orderkey = l_orderkey where o_custkey % 4 <> 0")
def store_delete_cascade(s, d):
    keys = table(s, d, "customer").where("c_custkey % 4 = 0").select("c_custkey", F.lit(None).cast("string").alias("c_name"), F.lit(None).cast("double").alias("c_acctbal"))
    st = _store(s, d).apply({"customer": _ops(keys, "delete")})
    return concat(*(df.agg(F.count("*").alias("n")).select(F.lit(spec.name).alias("layer"), "n") for spec, df in st.layers))


@query("with m as (select o_orderkey, case when o_orderkey % 8 = 0 then (select min(c_custkey) from customer) else o_custkey end c from orders) select c c_custkey, count(*) n_orders from m group by all")
def store_move_fk(s, d):
    """Orders move under another customer; the nested view follows."""
    c = table(s, d, "customer").agg(F.min("c_custkey").alias("to"))
    o = table(s, d, "orders").where("o_orderkey % 8 = 0").crossJoin(F.broadcast(c)).select("o_orderkey", F.col("to").alias("o_custkey"), F.lit(None).cast("string").alias("o_orderstatus"), F.lit(None).cast("double").alias("o_totalprice"))
    x = _store(s, d).apply({"order": _ops(o, "update")}).nested()
    return x.where(F.size("orderList") > 0).select("c_custkey", F.size("orderList").cast("long").alias("n_orders"))


@query(f"select l_orderkey, l_no, l_quantity from {NUMBERED} join orders on o_orderkey = l_orderkey where o_custkey % 9 <> 0")
def store_compact(s, d):
    """Deletes, writes a version to the shared folder, and reads it back."""
    keys = table(s, d, "customer").where("c_custkey % 9 = 0").select("c_custkey", F.lit(None).cast("string").alias("c_name"), F.lit(None).cast("double").alias("c_acctbal"))
    root = f"{shared_dir(s)}/terrace-store-{s.sparkContext.applicationId}"
    _store(s, d).apply({"customer": _ops(keys, "delete")}).save(s, root)
    return NestedStore.open(s, root).layer("line")[1]


# ---- text


@query("select event_id, event_type, json_extract_string(props, '$.page') page from events")
def json_decode(s, d):
    return table(s, d, "events").select("event_id", "event_type", F.get_json_object("props", "$.page").alias("page"))


@query("select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def json_roundtrip(s, d):
    c = table(s, d, "customer")
    return c.select(F.from_json(F.to_json(F.struct(*c.columns)), c.schema).alias("x")).select("x.*")


@query("select c_custkey % 8 part, count(*) n from customer group by all")
def hash_partition_counts(s, d):
    from terrace.functions.scalars import partition_of

    return table(s, d, "customer").groupBy(partition_of(F.col("c_custkey"), 8).alias("part")).agg(F.count("*").alias("n"))


# ---- schemas, positions, decimals


@query("select c_custkey, 'none' c_note, o_orderkey, cast(o_totalprice as double) o_totalprice from customer join orders on o_custkey = c_custkey")
def evolved_nested(s, d):
    """A stored nested table under a newer schema: a default at the top, columns dropped and types promoted below an array."""
    old = nested(s, d, ["c_custkey"], ["o_orderkey", "o_custkey", "o_totalprice"], ["l_orderkey"]).table()
    order = T.StructType([T.StructField("o_orderkey", T.DecimalType(20, 0)), T.StructField("o_totalprice", T.DoubleType())])
    new = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_note", T.StringType(), metadata={"default": '"none"'}), T.StructField("orderList", T.ArrayType(order))])
    x = resolve(old, new).select("c_custkey", "c_note", F.explode("orderList").alias("o"))
    return x.select("c_custkey", "c_note", F.col("o.o_orderkey").cast("long").alias("o_orderkey"), "o.o_totalprice")


@query("select distinct o_custkey c_custkey from orders where o_orderstatus not in ('F', 'O')")
def invalid_nested(s, d):
    """Customers with an order whose status isn't a symbol of the enum."""
    x = nested(s, d, ["c_custkey"], ["o_orderkey", "o_custkey", "o_orderstatus"], ["l_orderkey"]).table()
    order = T.StructType([T.StructField("o_orderstatus", T.StringType(), metadata={"symbols": ["F", "O"]})])
    return invalid_rows(x, T.StructType([T.StructField("orderList", T.ArrayType(order))])).select("c_custkey")


@query("select row_number() over (order by o_orderkey) - 1 as row_index, o_orderkey from orders qualify row_index between 100 and 1299")
def row_slice_files(s, d):
    """A slice that spans the files of a sorted table, whose names follow its order."""
    path = f"{shared_dir(s)}/terrace-files-{s.sparkContext.applicationId}-{zlib.crc32(d.encode())}"
    table(s, d, "orders").select("o_orderkey").repartitionByRange(7, "o_orderkey").sortWithinPartitions("o_orderkey").write.mode("overwrite").parquet(path)
    return row_slice(s, path, 100, 1200, ["o_orderkey"])


@query("select o_orderkey, cast(-o_orderkey as decimal(38, 6)) * 1000003 as v from orders")
def decimal_bytes(s, d):
    """Twelve-byte two's complement numbers with six places."""
    o = table(s, d, "orders").withColumn("b", F.unhex(F.concat(F.when(F.col("o_orderkey") == 0, F.repeat(F.lit("00"), 4)).otherwise(F.repeat(F.lit("ff"), 4)), F.lpad(F.hex(-F.col("o_orderkey") * 1000003 * 1000000), 16, "0"))))
    return o.select("o_orderkey", decimal_from_bytes(F.col("b"), 38, 6).alias("v"))


@query("select l_orderkey, l_linenumber from lineitem where l_orderkey >= 1000")
def seek_from(s, d):
    return seek(table(s, d, "lineitem"), "l_orderkey", 1000).select("l_orderkey", "l_linenumber")
