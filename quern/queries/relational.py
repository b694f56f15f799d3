"""Generic relational coverage over the star schema: joins, grouping, sets, top-k (engine extras)."""

from pyspark.sql import functions as F

from quern.sources.tables import table


def _revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def _t(s, d, *names):
    return [table(s, d, n) for n in names]


def pricing_summary(s, d):
    li = table(s, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(_revenue()), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


def top_orders(s, d):
    c, o, li = _t(s, d, "customer", "orders", "lineitem")
    cut = F.lit("1996-03-15").cast("timestamp_ntz")
    joined = li.where(F.col("l_shipdate") > cut).join(o.where(F.col("o_orderdate") < cut), F.col("l_orderkey") == F.col("o_orderkey")).join(c.where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return joined.groupBy("l_orderkey", "o_orderdate").agg(F.round(F.sum(_revenue()), 2).alias("revenue")).orderBy(F.desc("revenue"), "l_orderkey").limit(10)


def nation_revenue(s, d):
    c, o, li, su, n, r = _t(s, d, "customer", "orders", "lineitem", "supplier", "nation", "region")
    x = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(su, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey"))).join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return x.groupBy("r_name", "n_name").agg(F.round(F.sum(_revenue()), 2).alias("revenue"))


def outer_counts(s, d):
    c, o = _t(s, d, "customer", "orders")
    x = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))
    return x.groupBy("n").agg(F.count("*").alias("customers"))


QUERIES = {
    "rel_pricing_summary": pricing_summary,
    "rel_top_orders": top_orders,
    "rel_nation_revenue": nation_revenue,
    "rel_outer_counts": outer_counts,
    "rel_semi": lambda s, d: table(s, d, "orders").join(table(s, d, "lineitem").where("l_quantity > 49"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n")),
    "rel_anti": lambda s, d: table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n")),
    "rel_full_outer": lambda s, d: table(s, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers")).join(table(s, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers")), F.col("c_nationkey") == F.col("s_nationkey"), "full_outer").select(F.coalesce("c_nationkey", "s_nationkey").alias("nation"), "customers", "suppliers"),
    "rel_rollup": lambda s, d: table(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty")),
    "rel_cube": lambda s, d: table(s, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")),
    "rel_set_ops": lambda s, d: (lambda a, b: a.intersect(b).withColumn("op", F.lit("both")).unionByName(a.exceptAll(b).distinct().withColumn("op", F.lit("first"))))(table(s, d, "orders").where("o_totalprice > 200000").select("o_custkey"), table(s, d, "orders").where("o_orderstatus = 'F'").select("o_custkey")),
    "rel_count_distinct": lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers")),
    "rel_top_per_group": lambda s, d: table(s, d, "customer").groupBy("c_nationkey").agg(F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey"))).alias("best"), F.max("c_acctbal").alias("balance")),
}

_REV = "l_extendedprice * (1 - l_discount)"
SQL = {
    "rel_pricing_summary": f"select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum({_REV}), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all",
    "rel_top_orders": f"select l_orderkey, o_orderdate, round(sum({_REV}), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey where l_shipdate > timestamp '1996-03-15' and o_orderdate < timestamp '1996-03-15' and o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING') group by all order by revenue desc, l_orderkey limit 10",
    "rel_nation_revenue": f"select r_name, n_name, round(sum({_REV}), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey and s_nationkey = c_nationkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all",
    "rel_outer_counts": "select n, count(*) as customers from (select c_custkey, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey group by 1) group by 1",
    "rel_semi": "select o_orderpriority, count(*) as n from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity > 49) group by 1",
    "rel_anti": "select c_mktsegment, count(*) as n from customer where c_custkey not in (select o_custkey from orders) group by 1",
    "rel_full_outer": "select coalesce(c_nationkey, s_nationkey) as nation, customers, suppliers from (select c_nationkey, count(*) as customers from customer group by 1) full join (select s_nationkey, count(*) as suppliers from supplier group by 1) on c_nationkey = s_nationkey",
    "rel_rollup": "select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as qty from lineitem group by rollup (l_returnflag, l_linestatus)",
    "rel_cube": "select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)",
    "rel_set_ops": "with a as (select distinct o_custkey from orders where o_totalprice > 200000), b as (select distinct o_custkey from orders where o_orderstatus = 'F') select o_custkey, 'both' as op from (select * from a intersect select * from b) union all select distinct o_custkey, 'first' from (select o_custkey from orders where o_totalprice > 200000 except all select o_custkey from orders where o_orderstatus = 'F')",
    "rel_count_distinct": "select l_returnflag, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers from lineitem group by 1",
    "rel_top_per_group": "select c_nationkey, arg_max(c_custkey, (c_acctbal, -c_custkey)) as best, max(c_acctbal) as balance from customer group by 1",
}
