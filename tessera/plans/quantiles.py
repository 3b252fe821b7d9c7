"""Quantiles of groups of very different sizes, exact and from merged sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import quantiles
from tessera.plans.base import query, r, table

_GROUP = "CASE WHEN {k} % 50 = 0 THEN {k} % 100 END"


@query(f"""SELECT {_GROUP.format(k="l_orderkey")} AS rare, l_extendedprice > 0 AS paid, count(l_extendedprice) AS count, round(avg(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75,
    round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem GROUP BY ALL""")
def quantiles_of_a_hot_group(spark, d):
    rows = table(spark, d, "lineitem").select(F.when(F.col("l_orderkey") % 50 == 0, F.col("l_orderkey") % 100).alias("rare"), (F.col("l_extendedprice") > 0).alias("paid"), "l_extendedprice")
    out = quantiles.describe(rows, ["rare", "paid"], "l_extendedprice")
    return out.select("rare", "paid", "count", *(r(F.col(c), 4).alias(c) for c in ("mean", "median", "p75", "p90", "p95")), "min", "max")


@query("""SELECT source, count(*) AS count, CAST(quantile_disc(n_chars, 0.5) AS DOUBLE) > 0 AS positive, count(DISTINCT lang) AS languages, CAST(min(n_chars) AS DOUBLE) AS least, CAST(max(n_chars) AS DOUBLE) AS most FROM (SELECT source, lang, n_chars FROM documents UNION ALL SELECT 'TOTAL', lang, n_chars FROM documents) GROUP BY source""")
def merged_sketches(spark, d):
    # Kept for each source and language, merged by source and for all: counts, distinct languages and extremes are exact in a sketch.
    kept = quantiles.sketched(table(spark, d, "documents"), ["source", "lang"], "n_chars", "lang")
    out = quantiles.merged(kept, ["source"], (0.0, 0.5, 1.0), "TOTAL")
    return out.select("source", "count", (F.col("median") > 0).alias("positive"), F.col("distinct").alias("languages"), F.col("p0").alias("least"), F.col("p100").alias("most"))


@query("""SELECT user_id, count(value) AS count, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.75) AS p75, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.95) AS p95, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id""")
def sketched_users(spark, d):
    # A sketch of up to k values is exact, so small groups have their very quantiles.
    kept = quantiles.sketched(table(spark, d, "events").withColumn("day", F.dayofmonth("ts")), ["user_id", "day"], "value", "event_type")
    return quantiles.merged(kept, ["user_id"]).withColumnRenamed("distinct", "kinds")
