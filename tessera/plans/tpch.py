"""Decision-support queries over the order tables, as plain DataFrames for Catalyst to plan."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.plans.base import query, r, table


def _revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_discount, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, d):
    t = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return t.groupBy("l_returnflag", "l_linestatus").agg(r(F.sum("l_quantity"), 2).alias("sum_qty"), r(F.sum("l_extendedprice"), 2).alias("sum_price"), r(F.sum(_revenue()), 2).alias("revenue"), r(F.avg("l_discount")).alias("avg_discount"), F.count("*").alias("n"))


@query("""SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderpriority FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'O' GROUP BY l_orderkey, o_orderpriority ORDER BY revenue DESC, l_orderkey LIMIT 10""")
def shipping_priority(spark, d):
    c = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    o = table(spark, d, "orders").filter("o_orderstatus = 'O'").join(c, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    out = table(spark, d, "lineitem").join(o, "l_orderkey").groupBy("l_orderkey", "o_orderpriority").agg(r(F.sum(_revenue()), 2).alias("revenue"))
    return out.orderBy(F.desc("revenue"), "l_orderkey").limit(10)


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""")
def local_suppliers(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    t = table(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return t.groupBy("n_name").agg(r(F.sum(_revenue()), 2).alias("revenue"))


@query("""SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
def forecast_revenue(spark, d):
    t = table(spark, d, "lineitem").filter("l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
    return t.agg(r(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"), F.count("*").alias("n"))


@query("""SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '1-URGENT' GROUP BY c_custkey""")
def customer_orders(spark, d):
    o = table(spark, d, "orders").filter("o_orderpriority <> '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY o_orderpriority""")
def order_priority(spark, d):
    big = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(big, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("""SELECT p_brand, round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) / sum(l_extendedprice) * 100, 5) AS returned FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""")
def returned_share(spark, d):
    t = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    back = F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).otherwise(0.0))
    return t.groupBy("p_brand").agg(r(back / F.sum("l_extendedprice") * 100, 5).alias("returned"))


@query("""SELECT s_suppkey, n, rank FROM (SELECT l_suppkey AS s_suppkey, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS rank FROM lineitem GROUP BY l_suppkey) WHERE rank <= 10""")
def top_suppliers(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return t.withColumn("rank", F.rank().over(Window.orderBy(F.desc("n"))).cast("long")).filter("rank <= 10")
