"""Greedy choices by rule, each with a round a table in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import choices
from tessera.plans.base import query, table
from tessera.plans.relations import _rounds

_CATEGORY = "CASE WHEN doc_id < 4 THEN 'tiny' ELSE coalesce(lang, 'none') END"
_SEEN = "CASE WHEN len(list_filter(t.taken, lambda x: x.{0} = r.f.{0})) > 0 THEN 0 ELSE {1} END"
_PICKED = _rounds(6, "category", "key", "f", f"""WITH b AS (SELECT CAST(doc_id AS VARCHAR) AS key, {_CATEGORY} AS category, ln(1 + n_chars) AS v, doc_id % 5 AS frames, {{'s': source, 't': CAST(doc_id % 7 AS VARCHAR), 'z': CAST(n_chars % 3 AS VARCHAR)}} AS f, CASE WHEN doc_id % 97 = 3 THEN -doc_id ELSE -4611686018427387904 END AS place FROM documents),
    m AS (SELECT category, quantile_cont(v, 0.5) AS m, greatest(1, max(v) - quantile_cont(v, 0.5), quantile_cont(v, 0.5) - min(v)) AS s FROM b GROUP BY category), r AS (SELECT b.*, round(1 - abs(v - m) / s, 12) AS typical FROM b JOIN m USING (category))""",
    f"place DESC, round(typical + {_SEEN.format('s', 5)} + {_SEEN.format('t', 3)} + {_SEEN.format('z', 2)}, 12) DESC, frames, r.key DESC")


@query(f"""SELECT p.category, p.key, CAST(CASE WHEN n <= 6 THEN row_number() OVER (PARTITION BY p.category ORDER BY p.key) ELSE pick END AS INT) AS pick FROM ({_PICKED}) p JOIN (SELECT {_CATEGORY} AS category, count(*) AS n FROM documents GROUP BY 1) c ON c.category = p.category""")
def representatives_by_rule(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("key"), F.expr(_CATEGORY).alias("category"), "n_chars", (F.col("doc_id") % 5).alias("frames"), "source", (F.col("doc_id") % 7).alias("target"), (F.col("n_chars") % 3).alias("size"))
    priority = docs.filter("doc_id % 97 = 3").select("key", "doc_id")
    out = choices.representatives_by_rule(docs, "category", 6, {"source": 5.0, "target": 3.0, "size": 2.0}, F.col("n_chars"), "frames", "key", priority)
    return out.select("category", "key", "pick")


_DIVERSE = "WITH r AS (SELECT o_orderkey AS id, {'e': o_custkey % 50, 'i': o_orderkey % 40, 't': o_orderpriority} AS f, o_orderpriority AS kind, o_totalprice FROM orders)"


def _diverse_sql(n):
    out = f"{_DIVERSE}, t0 AS (SELECT [] AS ids, [] AS taken)"
    used = lambda c: f"len(list_filter(t.taken, lambda x: x.{c} = r.f.{c})) > 0"
    for k in range(n):
        best = f"SELECT r.* FROM r, t{k} t WHERE NOT ({used('e')}) AND NOT ({used('i')}) ORDER BY {used('t')}, kind, o_totalprice, id LIMIT 1"
        out += f", t{k + 1} AS (SELECT CASE WHEN b.id IS NULL THEN ids ELSE list_append(ids, b.id) END AS ids, CASE WHEN b.id IS NULL THEN taken ELSE list_append(taken, b.f) END AS taken FROM t{k} t LEFT JOIN ({best}) b ON true)"
    return f"{out} SELECT unnest(ids) AS id, CAST(generate_subscripts(ids, 1) AS INT) AS pick FROM t{n}"


@query(_diverse_sql(14))
def diverse_examples(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("episode"), (F.col("o_orderkey") % 40).alias("image"), F.col("o_orderpriority").alias("kind"), "o_totalprice")
    return choices.diverse_examples(rows, ["kind", "o_totalprice", "id"], 14, "kind", ["episode", "image"], "id").select("id", "pick")


@query("""WITH f AS (SELECT c_name AS name, abs(c_acctbal / 10 - 170.29386) AS far FROM customer), o AS (SELECT c_name AS name, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS kind, min(o_orderkey) AS episode FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_name),
    m AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY far DESC, name DESC) > 1 AS again FROM f JOIN o USING (name))
    SELECT name, kind, episode, CAST(again AS INT) AS turn, CAST(row_number() OVER (ORDER BY again, far DESC, name DESC) AS INT) AS pick FROM m ORDER BY pick LIMIT 30""")
def class_coverage(spark, d):
    actors = table(spark, d, "customer").select(F.col("c_name").alias("name"), (F.col("c_acctbal") / 10).alias("error"), "c_custkey")
    candidates = table(spark, d, "orders").join(actors, F.col("o_custkey") == F.col("c_custkey")).select("name", F.col("o_orderpriority").alias("kind"), "o_orderdate", F.col("o_orderkey").alias("episode"))
    return choices.class_coverage(actors, candidates, 30, "name", "error", 170.29386, "kind", ["o_orderdate", "episode"], "episode")
