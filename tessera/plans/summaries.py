"""Queries that summarise: counts, descriptions, rates, crosstabs, metrics, spatial cells, paired statistics, visibility."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import geometry, prompts, visibility
from tessera.functions.actions import COMMANDS
from tessera.operators import aggregates as agg
from tessera.operators import stats
from tessera.plans.base import query, r, table


@query("""SELECT event_type, count(*) AS rows, count(DISTINCT user_id) AS episodes FROM events GROUP BY event_type""")
def manifest_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("rows"), F.count_distinct("user_id").alias("episodes"))


@query("""SELECT 'source' AS dimension, source AS bucket, count(*) AS count FROM documents GROUP BY 2 UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY 2""")
def long_counts(spark, d):
    return agg.counts(table(spark, d, "documents"), {"source": "source", "lang": "lang"})


@query("""SELECT 'head' AS source, CAST(CAST(round(e[1]) AS INT) AS VARCHAR) AS value, count(*) AS count FROM (SELECT embedding AS e FROM embeddings) GROUP BY 2
    UNION ALL SELECT 'labels', CAST(label AS VARCHAR), 2 * count(*) FROM embeddings GROUP BY 2""")
def array_histogram(spark, d):
    e = table(spark, d, "embeddings").select(F.array(F.round(F.element_at("embedding", 1)).cast("int")).alias("head"), F.array("label", "label").alias("labels"))
    return agg.array_histogram(e, ["head", "labels"])


_DESCRIBE = """SELECT {k}, count({v}) AS count, round(avg({v}), 4) AS mean, round(quantile_cont({v}, 0.5), 4) AS median, round(quantile_cont({v}, 0.75), 4) AS p75,
    round(quantile_cont({v}, 0.9), 4) AS p90, round(quantile_cont({v}, 0.95), 4) AS p95, min({v}) AS min, max({v}) AS max FROM {t} GROUP BY {k}"""


@query(_DESCRIBE.format(k="o_orderpriority", v="o_totalprice", t="orders"))
def episode_describe(spark, d):
    out = table(spark, d, "orders").groupBy("o_orderpriority").agg(*agg.describe("o_totalprice"))
    return out.select("o_orderpriority", "count", *(r(F.col(c), 4).alias(c) for c in ("mean", "median", "p75", "p90", "p95")), "min", "max")


@query("""SELECT p_brand, list(p_retailprice ORDER BY p_retailprice)[count(*) // 2 + 1] AS upper FROM part GROUP BY p_brand""")
def upper_medians(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(agg.upper_median("p_retailprice").alias("upper"))


@query("""SELECT coalesce(l_returnflag, 'TOTAL') AS l_returnflag, count(*) AS rows, count(*) FILTER (l_discount > 0.05) AS hits, round(count(*) FILTER (l_discount > 0.05) * 1.0 / count(*), 6) AS rate FROM lineitem GROUP BY ROLLUP (l_returnflag)""")
def scene_rollup(spark, d):
    hit = F.count_if(F.col("l_discount") > 0.05)
    return agg.with_total(table(spark, d, "lineitem"), "l_returnflag", [F.count("*").alias("rows"), hit.alias("hits"), r(agg.rate(hit, F.count("*"))).alias("rate")])


@query("""SELECT l_returnflag, l_linestatus, CASE grouping_id(l_returnflag, l_linestatus) WHEN 0 THEN 'l_returnflag+l_linestatus' WHEN 1 THEN 'l_returnflag' WHEN 2 THEN 'l_linestatus' ELSE 'all' END AS grouping,
    count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())""")
def stratify(spark, d):
    sets = [["l_returnflag", "l_linestatus"], ["l_returnflag"], ["l_linestatus"], []]
    return agg.grouping_sets(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], sets, [F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")])


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def cube_counts(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("""SELECT n_name, count(c_custkey) FILTER (c_acctbal < 0) AS negative, count(c_custkey) FILTER (c_acctbal > 9000) AS rich FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON n_nationkey = c_nationkey GROUP BY n_name""")
def conditional_capture_summary(spark, d):
    nation = table(spark, d, "nation")
    c = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return agg.conditional_counts(c, "n_name", nation, {"negative": F.col("c_acctbal") < 0, "rich": F.col("c_acctbal") > 9000})


_CONFUSION = """SELECT CAST(t.i AS INT) AS truth, CAST(p.i AS INT) AS predicted, count(doc_id) AS n FROM (VALUES (0), (1)) t(i) CROSS JOIN (VALUES (0), (1)) p(i)
    LEFT JOIN labels ON quality = t.i AND CASE WHEN toxic IN (0, 1) THEN toxic ELSE 0 END = p.i GROUP BY 1, 2"""


@query(_CONFUSION)
def confusion_matrix(spark, d):
    return agg.confusion(table(spark, d, "labels"), "quality", "toxic", [0, 1], 0)


@query(f"""WITH c AS ({_CONFUSION}), s AS (SELECT truth AS label, sum(n) AS support, sum(n) FILTER (truth = predicted) AS tp FROM c GROUP BY 1), p AS (SELECT predicted AS label, sum(n) AS predicted FROM c GROUP BY 1),
    q AS (SELECT label, support, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall FROM s JOIN p USING (label))
    SELECT label, CAST(support AS BIGINT) AS support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM q""")
def label_metrics(spark, d):
    out = agg.label_metrics(agg.confusion(table(spark, d, "labels"), "quality", "toxic", [0, 1], 0))
    return out.select("label", "support", *(r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")))


@query("""WITH b AS (SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (NOT t AND NOT p) AS tn, count(*) FILTER (t AND NOT p) AS fn
      FROM (SELECT o_orderstatus = 'F' AS t, o_totalprice > 100000 AS p FROM orders))
    SELECT *, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS fpr FROM b""")
def binary_metrics(spark, d):
    out = table(spark, d, "orders").agg(*agg.binary_metrics(F.col("o_orderstatus") == "F", F.col("o_totalprice") > 100_000))
    return out.select("tp", "fp", "tn", "fn", *(r(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall", "fpr")))


@query("""SELECT grp AS "group", count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM (SELECT c_acctbal, unnest(list_filter(['all', CASE WHEN c_acctbal < 0 THEN 'negative' END, CASE WHEN c_acctbal > 5000 THEN 'rich' END, c_mktsegment], lambda x: x IS NOT NULL)) AS grp FROM customer) GROUP BY grp""")
def overlapping_groups(spark, d):
    groups = {"all": F.lit(True), "negative": F.col("c_acctbal") < 0, "rich": F.col("c_acctbal") > 5000}
    out = agg.overlapping(table(spark, d, "customer"), groups, [F.col("c_mktsegment")], [F.count("*").alias("n"), F.avg("c_acctbal").alias("mean")])
    return out.select("group", "n", r(F.col("mean"), 4).alias("mean"))


@query("""WITH c AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.5) AS b, quantile_cont(c_acctbal, 0.75) AS c FROM customer)
    SELECT c_custkey, CAST(c_acctbal >= a AS INT) + CAST(c_acctbal >= b AS INT) + CAST(c_acctbal >= c AS INT) AS bucket FROM customer, c""")
def quantile_bucket(spark, d):
    customer = table(spark, d, "customer")
    cuts = agg.quantile_cuts(customer, "c_acctbal", [0.25, 0.5, 0.75])
    return customer.select("c_custkey", agg.quantile_bucket(F.col("c_acctbal"), [F.lit(c) for c in cuts]).alias("bucket"))


@query("""SELECT o_custkey, count(*) AS variants, count(DISTINCT o_orderstatus) <= 1 AS same FROM orders GROUP BY o_custkey""")
def invariance(spark, d):
    return agg.invariant(table(spark, d, "orders"), ["o_custkey"], "o_orderstatus")


@query("""SELECT label, CAST(floor(CAST(embedding[1] AS DOUBLE) / 0.1) AS BIGINT) AS cell_x, CAST(floor(CAST(embedding[2] AS DOUBLE) / 0.1) AS BIGINT) AS cell_y, count(*) AS samples, count(DISTINCT vec_id % 50) AS episodes FROM embeddings GROUP BY 1, 2, 3""")
def cell_density(spark, d):
    e = table(spark, d, "embeddings").select("label", F.element_at("embedding", 1).cast("double").alias("x"), F.element_at("embedding", 2).cast("double").alias("y"), (F.col("vec_id") % 50).alias("episode"))
    return agg.cell_density(e, ["label"], ["x", "y"], "episode", 0.1)


@query("""SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type""")
def shares(spark, d):
    return agg.top_share(table(spark, d, "events"), "event_type").select("event_type", "n", r(F.col("share")).alias("share"))


@query("""SELECT c_mktsegment, count(*) FILTER (c_nationkey = 0) AS n0, count(*) FILTER (c_nationkey = 1) AS n1, count(*) FILTER (c_nationkey = 2) AS n2 FROM customer WHERE c_nationkey IN (0, 1, 2) GROUP BY c_mktsegment""")
def pivot_counts(spark, d):
    out = table(spark, d, "customer").filter("c_nationkey IN (0, 1, 2)").groupBy("c_mktsegment").pivot("c_nationkey", [0, 1, 2]).count()
    return out.select("c_mktsegment", *(F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias(f"n{k}") for k in range(3)))


@query("""WITH RECURSIVE w AS (SELECT c_custkey, count(*) FILTER (o_totalprice > 150000) AS gains, count(*) FILTER (o_totalprice <= 150000) AS losses FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey),
    g AS (SELECT DISTINCT gains + losses AS n, least(gains, losses) AS k FROM w), t AS (SELECT n, k, CAST(0 AS BIGINT) AS i, 1.0::DOUBLE AS c FROM g UNION ALL SELECT n, k, i + 1, c * (n - i) / (i + 1) FROM t WHERE i < k),
    p AS (SELECT n, k, round(CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * sum(c) * pow(0.5, n)) END, 8) AS p FROM t GROUP BY n, k)
    SELECT c_custkey, gains, losses, p FROM w JOIN p ON n = gains + losses AND k = least(gains, losses)""")
def exact_paired_p(spark, d):
    runs = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    wins = runs.groupBy("c_custkey").agg(F.count_if(F.col("o_totalprice") > 150_000).alias("gains"), F.count_if(F.col("o_totalprice") <= 150_000).alias("losses"))
    return wins.select("c_custkey", "gains", "losses", r(stats.exact_paired_p(F.col("gains"), F.col("losses")), 8).alias("p"))


@query("""WITH r AS (SELECT rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS x, rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0 AS y FROM orders)
    SELECT count(*) AS n, round(corr(x, y), 6) AS rho, round(corr(x, y) * sqrt((count(*) - 2) / (1 - corr(x, y) ** 2)), 5) AS t FROM r""")
def spearman(spark, d):
    return stats.spearman(table(spark, d, "orders"), "o_totalprice", "o_custkey").select("n", r(F.col("rho")).alias("rho"), r(F.col("t"), 5).alias("t"))


@query("""WITH RECURSIVE v AS (SELECT round(c_acctbal / 100) AS v FROM customer), a AS (SELECT abs(v) AS a, v > 0 AS up FROM v WHERE v <> 0),
    r AS (SELECT a, up, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS r FROM a), t AS (SELECT sum(pow(c, 3) - c) AS ties FROM (SELECT count(*) AS c FROM a GROUP BY a)),
    s AS (SELECT count(*) AS n, CAST(sum(r) FILTER (up) AS DOUBLE) AS w_plus, CAST(sum(r) FILTER (NOT up) AS DOUBLE) AS w_minus FROM r),
    z AS (SELECT *, (w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1.0) * (2 * n + 1) / 24 - ties / 48) AS z FROM s, t),
    q AS (SELECT 0 AS k, CAST(abs(z) AS DOUBLE) AS x, CAST(abs(z) AS DOUBLE) AS term, CAST(abs(z) AS DOUBLE) AS total, CAST(abs(z) AS DOUBLE) AS tail FROM z UNION ALL SELECT k + 1, x, term * x * x / (2 * (k + 1) + 1), total + term * x * x / (2 * (k + 1) + 1), x + (61 - (k + 1)) / tail FROM q WHERE k < 60)
    SELECT n, w_plus, w_minus, round(z, 6) AS z, round(CASE WHEN x < 3 THEN 1 - 2 * exp(-x * x / 2) / sqrt(2 * pi()) * total ELSE 2 * exp(-x * x / 2) / sqrt(2 * pi()) / tail END, 8) AS p FROM z, q WHERE k = 60""")
def wilcoxon(spark, d):
    c = table(spark, d, "customer").select(F.round(F.col("c_acctbal") / 100).alias("v"))
    return stats.wilcoxon(c, "v").select("n", "w_plus", "w_minus", r(F.col("z")).alias("z"), r(F.col("p"), 8).alias("p"))


@query()
def bootstrap_delta(spark, d):
    return stats.bootstrap_delta(table(spark, d, "customer"), "c_acctbal", ["c_custkey"], samples=500)


@query("""SELECT count(*) > 100 AS enough, avg(l_discount) < 0.06 AS low, max(l_quantity) <= 50 AS bounded, count(*) > 100 AND avg(l_discount) < 0.06 AND max(l_quantity) <= 50 AS passed FROM lineitem""")
def gate_decision(spark, d):
    t = table(spark, d, "lineitem").agg(F.count("*").alias("n"), F.avg("l_discount").alias("m"), F.max("l_quantity").alias("q"))
    return t.select(*stats.gate({"enough": F.col("n") > 100, "low": F.col("m") < 0.06, "bounded": F.col("q") <= 50}))


_SHARES = """SELECT user_id % 2 AS half, event_type, count(*) / sum(count(*)) OVER (PARTITION BY user_id % 2) AS p FROM events GROUP BY 1, 2"""


@query(f"""WITH s AS ({_SHARES}), j AS (SELECT a.p AS p, b.p AS q FROM s a JOIN s b ON a.event_type = b.event_type AND a.half = 0 AND b.half = 1)
    SELECT round((sum(p * ln(p / ((p + q) / 2))) + sum(q * ln(q / ((p + q) / 2)))) / 2, 8) AS js, round(sum(abs(p - q)), 8) AS l1 FROM j""")
def js_divergence(spark, d):
    e = table(spark, d, "events").groupBy((F.col("user_id") % 2).alias("half"), "event_type").agg(F.count("*").alias("n"))
    v = e.groupBy("half").agg(F.sort_array(F.collect_list(F.struct("event_type", "n"))).alias("v"), F.sum("n").alias("t")).select("half", F.transform("v", lambda s: s["n"] / F.col("t")).alias("p"))
    both = v.filter("half = 0").select("p", F.lit(1).alias("k")).join(v.filter("half = 1").select(F.col("p").alias("q"), F.lit(1).alias("k")), "k")
    l1 = F.aggregate(F.zip_with("p", "q", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: a + x)
    return both.select(r(prompts.js_divergence("p", "q"), 8).alias("js"), r(l1, 8).alias("l1"))


@query("""WITH s AS (SELECT event_id, value / 50 AS a, (event_id % 13) / 5.0 AS b, (event_id % 7) / 3.0 AS c FROM events)
    SELECT event_id, round(CAST(exp(a) / (exp(a) + exp(b) + exp(c)) AS DOUBLE), 6) AS p_stop, CASE WHEN a >= b AND a >= c THEN 'stop' WHEN b >= c THEN 'forward 3m' ELSE 'turn left 30 degree' END AS best FROM s""")
def stop_probability(spark, d):
    scores = F.create_map(F.lit("stop"), F.col("value") / 50, F.lit("forward 3m"), (F.col("event_id") % 13) / 5.0, F.lit("turn left 30 degree"), (F.col("event_id") % 7) / 3.0)
    e = table(spark, d, "events").select("event_id", scores.alias("s"))
    return e.select("event_id", r(F.element_at(prompts.softmax("s"), "stop")).alias("p_stop"), prompts.argmax_label("s", COMMANDS[:3]).alias("best"))


@query("""SELECT event_id, CASE WHEN event_id % 6 <> 1 THEN event_id % 6 WHEN value / 40 <= 2 THEN CASE WHEN event_id % 11 >= event_id % 5 THEN 2 ELSE 3 END ELSE 1 END AS action_id, CASE WHEN event_id % 6 = 1 AND value / 40 <= 2 THEN 'forward_near_obstacle' END AS reason FROM events""")
def depth_redirect(spark, d):
    e = table(spark, d, "events").select("event_id", prompts.redirect(F.col("event_id") % 6, F.col("value") / 40, F.col("event_id") % 11, F.col("event_id") % 5).alias("r"))
    return e.select("event_id", F.col("r.action_id").alias("action_id"), F.col("r.reason").alias("reason"))


_MASK = """SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity * 20 AS BIGINT) AS px, l_discount AS frac, CAST(l_quantity AS BIGINT) AS w, CAST(l_partkey % 40 AS BIGINT) AS h, l_suppkey % 4 AS sides, l_tax * 4 AS edge, l_suppkey % 9 = 0 AS opposite FROM lineitem"""


def _masks(spark, d):
    m = F.struct(
        (F.col("l_quantity") * 20).cast("long").alias("pixel_count"), F.col("l_discount").alias("pixel_fraction"), F.col("l_quantity").cast("long").alias("bbox_width"), (F.col("l_partkey") % 40).alias("bbox_height"),
        (F.col("l_suppkey") % 4).alias("clipped_sides_count"), (F.col("l_tax") * 4).alias("edge_contact_fraction"), (F.col("l_suppkey") % 9 == 0).alias("touches_opposite_borders"),
        F.array(F.col("l_quantity"), F.col("l_partkey") % 40 * 1.0).alias("centroid"), F.lit(100).alias("width"), F.lit(80).alias("height"),
    )
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", m.alias("m"))


@query(f"""WITH m AS ({_MASK}), a AS (SELECT *, opposite OR sides > 2 OR edge > 0.25 OR frac > 0.75 AS clipped FROM m)
    SELECT l_orderkey, l_linenumber, l_partkey, px, count(*) AS copies, concat_ws(',', CASE WHEN px < 160 THEN 'too_few_pixels' END, CASE WHEN least(w, h) < 8 THEN 'bbox_too_thin' END, CASE WHEN px < ceil(1000 * 0.12) THEN 'too_small_relative_to_peak' END, CASE WHEN clipped THEN 'severely_clipped_or_too_close' END) AS reasons
    FROM a GROUP BY ALL""")
def visibility_reasons(spark, d):
    m = _masks(spark, d)
    out = m.select("l_orderkey", "l_linenumber", "l_partkey", F.col("m.pixel_count").alias("px"), F.array_join(visibility.clear_reasons(F.col("m"), F.lit("mid"), F.lit(1000), visibility.Policy()), ",").alias("reasons"))
    # The same line may occur twice with different suppliers; the count keeps rows comparable.
    return out.groupBy("l_orderkey", "l_linenumber", "l_partkey", "px", "reasons").agg(F.count("*").alias("copies"))


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, l_discount AS frac, l_quantity AS cx, (l_partkey % 40) AS cy, l_suppkey % 4 AS sides, l_suppkey % 9 = 0 AS opposite, l_quantity / 2 AS dist FROM lineitem),
    q AS (SELECT *, greatest(0.0, least(1.0, CASE WHEN frac <= 0.1 THEN frac / 0.1 ELSE 1 - (frac - 0.1) / 0.65 END)) AS occ, greatest(0.0, least(1.0, 1 - sqrt((cx / 100 - 0.5) ** 2 + (cy / 80.0 - 0.5) ** 2) / 0.55)) AS cen,
      greatest(0.0, least(1.0, 1 - 0.15 * sides)) * CASE WHEN opposite THEN 0.5 ELSE 1 END AS clip, greatest(0.0, least(1.0, (20 - dist) / 12)) AS near FROM m)
    SELECT l_orderkey, l_linenumber, round(sum(CAST(0.30 * occ + 0.25 * cen + 0.15 * clip + 0.20 * near + 0.10 * 0.5 AS DOUBLE)), 6) AS quality FROM q GROUP BY 1, 2""")
def view_quality(spark, d):
    null = F.lit(None).cast("double")
    m = _masks(spark, d).withColumn("distance", F.col("m.bbox_width") / 2)
    q = visibility.view_quality(F.col("m"), F.lit("mid"), F.element_at("m.centroid", 1) / 2, null, null, null, visibility.Policy())
    return m.select("l_orderkey", "l_linenumber", q.alias("q")).groupBy("l_orderkey", "l_linenumber").agg(r(F.sum("q")).alias("quality"))


@query("""SELECT vec_id, round(degrees(acos(least(1.0, abs((a*b + b*c + c*e + e*a) / (a*a + b*b + c*c + e*e)))) * 2), 4) AS error, round(atan2(2 * (e * c + a * b), 1 - 2 * (b * b + c * c)), 5) AS yaw
    FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS e FROM embeddings)""")
def quaternions(spark, d):
    a, b, c, e = (F.element_at("embedding", k).cast("double") for k in range(1, 5))
    return table(spark, d, "embeddings").select("vec_id", r(geometry.quaternion_error([a, b, c, e], [b, c, e, a]), 4).alias("error"), r(geometry.euler(a, b, c, e)["yaw"], 5).alias("yaw"))


@query("""SELECT vec_id, CASE WHEN abs(yaw) > 90 THEN 'behind' WHEN abs(yaw) > 45 THEN 'outside_horizontal' WHEN abs(pitch) > 45 THEN 'outside_vertical' ELSE 'inside' END AS view, round(sqrt(x*x + y*y + z*z), 6) AS distance
    FROM (SELECT *, degrees(atan2(y, x)) AS yaw, degrees(atan2(-z, sqrt(x*x + y*y))) AS pitch FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings))""")
def target_view(spark, d):
    b = geometry.bearing(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)), F.lit(0.0), F.array(F.slice(F.col("embedding").cast("array<double>"), 1, 3)))
    e = table(spark, d, "embeddings").select("vec_id", b.alias("b"))
    return e.select("vec_id", geometry.view_relation(F.col("b.yaw"), F.col("b.pitch")).alias("view"), r(F.col("b.distance")).alias("distance"))


@query("""SELECT CASE WHEN o_totalprice / 10000 < 20 THEN 'within_20' WHEN o_totalprice / 10000 < 25 THEN '20_25' WHEN o_totalprice / 10000 < 30 THEN '25_30' WHEN o_totalprice / 10000 < 40 THEN '30_40' ELSE '40_plus' END AS bucket, count(*) AS n FROM orders GROUP BY 1""")
def failure_buckets(spark, d):
    return table(spark, d, "orders").groupBy(visibility.failure_distance_bucket(F.col("o_totalprice") / 10_000).alias("bucket")).agg(F.count("*").alias("n"))
