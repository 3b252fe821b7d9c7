"""Queries that write a table in a format and read it back: readers and writers against SQL over the source."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import falsy_coalesce
from tessera.plans.base import query, table
from tessera.sources import readers, stored, writers
from tessera.sources.scratch import folder

_ORDER = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType()), T.StructField("note", T.StringType())])
_NATION = "n_nationkey int, n_name string, n_regionkey int"


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.when(F.col("o_orderkey") % 3 == 0, F.lit("später ☃")).alias("note"))


def _json(df):
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN 'später ☃' END AS note, true AS refused FROM orders")
def json_lines_files(spark, d):
    at = folder(spark)
    writers.json_lines(_orders(spark, d), at)
    try:
        writers.json_lines(_orders(spark, d).limit(1), at)
        refused = False
    except AnalysisException:
        refused = True
    writers.json_lines(_orders(spark, d), at, "overwrite")
    return readers.json_lines(spark, at, _ORDER).withColumn("refused", F.lit(refused))


@query("SELECT count(*) AS lines, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS disorder, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders")
def numbered_files(spark, d):
    at = folder(spark)
    _json(_orders(spark, d).orderBy("o_orderkey")).write.text(at)
    rows = readers.numbered_lines(spark, at, _ORDER)
    by_file = rows.groupBy("file").agg(F.count("*").alias("n"), F.max("line").alias("most"), F.min("line").alias("least"), F.count_distinct("line").alias("kinds"))
    gaps = by_file.agg(F.count_if((F.col("n") != F.col("most")) | (F.col("least") != 1) | (F.col("kinds") != F.col("n"))).alias("gaps"))
    step = rows.select("file", (F.col("line") + 1).alias("line"), F.col("row.o_orderkey").alias("before")).join(rows, ["file", "line"])
    disorder = step.agg(F.count_if(F.col("before") >= F.col("row.o_orderkey")).alias("disorder"))
    return rows.agg(F.count("*").alias("lines"), F.sum("row.o_orderkey").alias("keys")).crossJoin(gaps).crossJoin(disorder).select("lines", "gaps", "disorder", "keys")


@query("SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderkey % 7 = 0) AS bad, (SELECT count(*) FROM orders) AS lines FROM orders WHERE o_orderkey % 7 <> 0")
def tolerant_files(spark, d):
    at = folder(spark)
    o = _orders(spark, d)
    whole = F.to_json(F.struct(*o.columns))
    o.select(F.when(F.col("o_orderkey") % 7 == 0, F.expr("substring(to_json(struct(*)), 1, 9)")).otherwise(whole).alias("value")).write.text(at)
    total = readers.bad_lines(spark, at, _ORDER).agg(F.sum("bad").alias("bad"), F.sum("rows").alias("lines"))
    return readers.tolerant_json_lines(spark, at, _ORDER).select("o_orderkey").crossJoin(F.broadcast(total))


@query("SELECT count(*) AS rows, count(*) FILTER (o_orderkey % 7 = 0 OR o_orderkey % 3 = 0) AS errors, count(*) FILTER (o_orderkey % 7 <> 0 AND o_orderkey % 2 = 0) AS hits FROM orders")
def counted_outputs(spark, d):
    at = folder(spark)
    o = _orders(spark, d).withColumn("hit", F.col("o_orderkey") % 2 == 0)
    o.select(F.when(F.col("o_orderkey") % 7 == 0, "{broken").otherwise(F.to_json(F.struct(*o.columns))).alias("value")).write.text(at)
    return readers.output_counts(spark, at, T.StructType([*_ORDER.fields, T.StructField("hit", T.BooleanType())]), "note", "hit")


def _by_region(spark, d, name: str) -> str:
    """A folder with a file of JSON lines for each region, named by a pattern."""
    at = folder(spark)
    nations = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey")
    for r in table(spark, d, "region").collect():  # a handful of scenes, a small file each
        writers.replace_file(_json(nations.filter(F.col("n_regionkey") == r["r_regionkey"])), f"{at}/{name.format(k=r['r_regionkey'], name=r['r_name'].replace(' ', '_'))}")
    return at


@query("SELECT n_nationkey, n_name, replace(r_name, ' ', '_') AS scene FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 2")
def scene_files(spark, d):
    at = _by_region(spark, d, "{name}.jsonl")
    writers.replace_file(_json(table(spark, d, "nation").filter("n_regionkey = 2").select("n_nationkey", "n_name", "n_regionkey")), f"{at}/failed_{_name(spark, d, 2)}.jsonl")
    file_system, whole = readers.file_system(spark, f"{at}/{_name(spark, d, 2)}.jsonl")
    file_system.delete(whole, False)
    return readers.partitioned_lines(spark, at, _NATION, key="scene").select("n_nationkey", "n_name", "scene")


def _name(spark, d, k):
    return table(spark, d, "region").filter(F.col("r_regionkey") == k).first()["r_name"].replace(" ", "_")


@query("SELECT n_nationkey, n_name, CASE WHEN n_regionkey % 2 = 0 THEN 'actors' ELSE 'rest' END AS kind FROM nation")
def files_of_two_kinds(spark, d):
    at = folder(spark)
    nations = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    writers.replace_file(_json(nations.filter("n_regionkey % 2 = 0")), f"{at}/one_actors.jsonl")
    writers.replace_file(_json(nations.filter("n_regionkey % 2 = 1")), f"{at}/one.jsonl")
    parts = readers.by_suffix(spark, at, {"_actors.jsonl": _NATION}, _NATION)
    return parts["_actors.jsonl"].withColumn("kind", F.lit("actors")).unionByName(parts[""].withColumn("kind", F.lit("rest"))).select("n_nationkey", "n_name", "kind")


@query("SELECT CAST(r_regionkey AS VARCHAR) AS scene, count(*) AS nations, r_regionkey < 3 AS kept FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 3")
def files_keyed_by_path(spark, d):
    at = folder(spark)
    nations = table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names")).collect()  # a handful
    for r in nations:
        pretty = '{\n "names": [' + ",\n".join(f'"{n}"' for n in r["names"]) + "]\n}"
        writers.replace_file(spark.createDataFrame([(pretty,)], "value string"), f"{at}/{r['n_regionkey']}/ep/result.json")
    pattern = r"/(\d+)/([^/]+)/result\.json$"
    keep = spark.createDataFrame([(str(k),) for k in range(3)], "scene string").withColumn("episode", F.lit("ep"))
    every = readers.keyed_json(spark, f"{at}/*/*/*.json", "names array<string>", pattern, ["scene", "episode"])
    some = readers.keyed_json(spark, f"{at}/*/*/*.json", "names array<string>", pattern, ["scene", "episode"], keep)
    return every.join(some.select("scene", F.lit(True).alias("kept")), "scene", "left").select("scene", F.size("names").cast("long").alias("nations"), F.coalesce("kept", F.lit(False)).alias("kept"))


@query("SELECT n_nationkey, n_name, CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INT) AS place, CAST(row_number() OVER (ORDER BY n_nationkey) AS BIGINT) AS line, n_name AS on_line FROM nation")
def arrays_and_lines(spark, d):
    at = folder(spark)
    nations = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    whole = nations.agg(F.sort_array(F.collect_list(F.struct(*nations.columns))).alias("a")).select(F.to_json("a").alias("value"))  # the format is one array in one file
    writers.replace_file(whole, f"{at}/all.json")
    writers.replace_file(_json(nations.orderBy("n_nationkey")), f"{at}/lines.jsonl")
    members = readers.json_array(spark, f"{at}/all.json", _NATION)
    file = readers.numbered_lines(spark, f"{at}/lines.jsonl").select("file").distinct()
    wanted = members.drop("file").withColumn("line", (F.col("place") + 1).cast("long")).crossJoin(F.broadcast(file))
    return readers.at_line(spark, f"{at}/lines.jsonl", wanted, "line", _NATION).select("n_nationkey", "n_name", "place", "line", F.col("row.n_name").alias("on_line"))


@query("SELECT 'merged' AS source, count(*) AS n FROM nation UNION ALL SELECT 'parts', count(*) FROM nation WHERE n_regionkey > 0")
def merged_or_parts(spark, d):
    at = folder(spark)
    nations = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    writers.shards(nations.filter("n_regionkey > 0"), "n_regionkey", f"{at}/lanes")
    parts = readers.merged_or_parts(spark, f"{at}/merged", f"{at}/lanes/*", "n_nationkey int, n_name string").agg(F.count("n_name").alias("n"))
    writers.json_lines(nations, f"{at}/merged")
    whole = readers.merged_or_parts(spark, f"{at}/merged", f"{at}/lanes/*", _NATION).agg(F.count("n_name").alias("n"))
    return whole.select(F.lit("merged").alias("source"), "n").unionByName(parts.select(F.lit("parts").alias("source"), "n"))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def csv_files(spark, d):
    at = folder(spark)
    writers.csv(table(spark, d, "customer"), at, ["c_custkey", "c_name", "c_nationkey", "c_acctbal"], ["c_custkey"])
    return readers.delimited(spark, at, "c_custkey long, c_name string, c_nationkey int, c_acctbal double")


@query("""SELECT 'l' || r_regionkey AS lane, CAST(r_regionkey % 2 AS VARCHAR) AS gpu, array_to_string(list_sort(list(n_name)), '|') AS scenes, CASE WHEN r_regionkey % 2 = 0 THEN 'eval' END AS dataset
    FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey""")
def lane_tables(spark, d):
    at = folder(spark)
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), " , ").alias("scenes"))
    key = F.col("n_regionkey")
    line = F.concat_ws("\t", F.concat(F.lit("l"), key.cast("string")), (key % 2).cast("string"), "scenes", F.when(key % 2 == 0, "eval"))
    writers.replace_file(n.select(line.alias("value")), f"{at}/lanes.tsv")
    return readers.lanes(spark, f"{at}/lanes.tsv").select("lane", "gpu", F.array_join("scenes", "|").alias("scenes"), "dataset")


@query("SELECT DISTINCT 'a::' || n_regionkey || '::' || n_nationkey AS key FROM nation")
def key_lists(spark, d):
    at = folder(spark)
    key = F.concat(F.lit("a::"), F.col("n_regionkey").cast("string"), F.lit("::"), F.col("n_nationkey").cast("string"))
    n = table(spark, d, "nation").select("n_nationkey", key.alias("key"))
    plain = n.filter("n_nationkey % 2 = 0")
    writers.keys(plain.unionByName(plain), "key", f"{at}/keys")
    rest = n.filter("n_nationkey % 2 = 1").select(F.to_json(F.struct(F.col("key").alias("trajectory_key"))).alias("value"))
    rest.unionByName(spark.createDataFrame([("# comment",), ("   ",)], "value string")).write.mode("append").text(f"{at}/keys")
    return readers.key_list(spark, f"{at}/keys")


@query("SELECT count(*) AS step, count(*) >= 25 AS completed, 0.5 AS share, 'x' AS kind FROM nation")
def logs_and_policies(spark, d):
    at = folder(spark)
    log = table(spark, d, "nation").select(F.concat(F.lit("step "), (F.col("n_nationkey") + 1).cast("string"), F.lit("/25 [00:01<00:02] 9/250")).alias("value"))
    log.write.text(f"{at}/log")
    writers.replace_file(spark.createDataFrame([('{"policy": {"share": 0.5,',), (' "kind": "x"}}',)], "value string"), f"{at}/policy.json")
    p = readers.policy(spark, f"{at}/policy.json")
    return readers.progress(spark, f"{at}/log", 25).withColumns({"share": F.lit(p["share"]).cast("decimal(2,1)"), "kind": F.lit(p["kind"])})


@query("SELECT o_orderstatus AS status, count(*) AS n, true AS complete FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")
def split_outputs(spark, d):
    at = folder(spark)
    writers.split(_orders(spark, d), {f"{at}/{s}": (F.col("o_orderstatus") == s, ["o_orderkey", "o_orderstatus"] if s == "F" else None) for s in ("F", "O")})
    return spark.read.schema(_ORDER).json([f"{at}/F", f"{at}/O"]).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.bool_and(F.col("o_totalprice").isNotNull() | (F.col("o_orderstatus") == "F")).alias("complete"))


@query("SELECT 'first_seen' AS kind, 'n_nationkey,n_name,r_name' AS header, 30 AS rows UNION ALL SELECT 'alphabetic', 'n_name,n_nationkey,r_name', 30")
def ragged_csv(spark, d):
    parts = [table(spark, d, "nation").select("n_nationkey", "n_name"), table(spark, d, "region").select("r_name")]
    out = []
    for kind in ("first_seen", "alphabetic"):
        at = folder(spark)
        writers.csv(writers.ragged_union(parts, kind == "alphabetic"), at)
        back = spark.read.option("header", True).csv(at)
        out.append(back.agg(F.lit(kind).alias("kind"), F.lit(",".join(back.columns)).alias("header"), F.count("*").cast("int").alias("rows")))
    return out[0].unionByName(out[1])


@query("SELECT count(*) AS orders, CAST(max(o_orderkey) AS BIGINT) AS last, 'v4' AS version FROM orders")
def manifests(spark, d):
    at = folder(spark)
    writers.replace_file(writers.manifest(table(spark, d, "orders"), {"orders": F.count("*"), "last": F.max("o_orderkey")}, {"version": "v4"}), f"{at}/manifest.json")
    writers.replace_file(writers.manifest(table(spark, d, "orders"), {"orders": F.count("*"), "last": F.max("o_orderkey")}, {"version": "v4"}), f"{at}/manifest.json")
    return readers.json_lines(spark, f"{at}/manifest.json", "orders long, last long, version string")


@query("SELECT o_orderkey, CAST(1 AS BIGINT) AS times FROM orders")
def resumed_appends(spark, d):
    at, o = folder(spark), _orders(spark, d)
    writers.append_new(o.filter("o_orderkey % 3 = 0"), None, ["o_orderkey"], at)
    for _ in range(2):
        writers.append_new(o, readers.tolerant_json_lines(spark, at, _ORDER), ["o_orderkey"], at)
    return readers.json_lines(spark, at, _ORDER).groupBy("o_orderkey").agg(F.count("*").alias("times"))


@query("SELECT o_orderkey, o_orderkey % 3 = 0 AS failed FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def pending_tasks(spark, d):
    o = _orders(spark, d)
    done = o.filter("o_orderkey % 2 = 1").select("o_orderkey", F.col("note").alias("error"))
    # Odd keys are done; those of them with an error are tried again.
    return readers.pending(o, done, ["o_orderkey"], "error", retry=True).select("o_orderkey", (F.col("o_orderkey") % 3 == 0).alias("failed"))


@query("SELECT n_regionkey, count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS keys FROM nation GROUP BY 1")
def sharded_outputs(spark, d):
    at = folder(spark)
    writers.shards(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_regionkey", at)
    return spark.read.schema("n_nationkey int, n_name string, n_regionkey int").json(at).groupBy("n_regionkey").agg(F.count("*").alias("n"), F.sum("n_nationkey").alias("keys"))


@query("""SELECT vec_id, 8 AS height, 8 AS width, CAST(64 - (vec_id % 3) AS BIGINT) AS finite, round(list_min(list_transform(range(64), lambda k: CASE WHEN k >= vec_id % 3 THEN CAST(embedding[k + 1] AS DOUBLE) END)), 6) AS least FROM embeddings""")
def stored_arrays(spark, d):
    def arrays(batches):
        for pdf in batches:
            data = []
            for v, e in zip(pdf["vec_id"], pdf["embedding"], strict=True):
                a, out = np.array(e, np.float64), io.BytesIO()
                a[: v % 3] = np.nan
                np.save(out, a.reshape(8, 8))
                data.append(out.getvalue())
            yield pd.DataFrame({"path": pdf["vec_id"].astype(str), "content": data})

    files = table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(arrays, "path string, content binary")
    return readers.npy_shapes(files).select(F.col("path").cast("long").alias("vec_id"), "height", "width", "finite", F.round("least", 6).alias("least"))


@query("SELECT 'images/' || n_nationkey || '.png' AS raw, CASE WHEN n_nationkey % 3 = 0 THEN 'aligned' WHEN n_nationkey % 3 = 1 THEN 'root' END AS found FROM nation")
def resolved_paths(spark, d):
    at = folder(spark)
    n = table(spark, d, "nation").select("n_nationkey").collect()  # a handful of files
    for r in n:
        if r[0] % 3 < 2:
            writers.replace_file(spark.createDataFrame([("x",)], "value string"), f"{at}/{('aligned', 'root')[r[0] % 3]}/images/{r[0]}.png")
    files = readers.file_listing(spark, at, "*.png").select(F.regexp_extract("path", r"/((?:aligned|root)/images/.*)$", 1).alias("path")).withColumn("there", F.lit(True))
    raw = table(spark, d, "nation").select(F.concat(F.lit("images/"), F.col("n_nationkey").cast("string"), F.lit(".png")).alias("raw"))
    for place in ("aligned", "root"):
        raw = raw.withColumn("path", F.concat(F.lit(f"{place}/"), F.col("raw"))).join(files, "path", "left").withColumn(place, F.when(F.col("there"), F.lit(place))).drop("path", "there")
    return raw.select("raw", falsy_coalesce("aligned", "root").alias("found"))


@query("""SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 3 <> 0 THEN 2 * o_totalprice ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderpriority IS DISTINCT FROM '5-LOW' AND NOT (o_orderpriority = '1-URGENT' AND o_orderkey % 3 = 0)
    UNION ALL SELECT o_orderkey + 100000000, '2-HIGH', -1.0 FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderkey % 5 = 0""")
def replaced_scenes(spark, d):
    at = folder(spark, "stored")
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    stored.create(rows, at, "o_orderpriority")
    # One part is repaired and loses rows, one goes, one gets new rows by their keys.
    urgent = stored.read(spark, at, ["1-URGENT"]).filter("o_orderkey % 3 <> 0").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    stored.replace(urgent, at)
    stored.replace(rows.limit(0), at, ["5-LOW"])
    new = rows.filter("o_orderpriority = '2-HIGH' AND o_orderkey % 5 = 0").select((F.col("o_orderkey") + 100_000_000).alias("o_orderkey"), "o_orderpriority", F.lit(-1.0).alias("o_totalprice"))
    stored.upsert(new, at, ["o_orderpriority", "o_orderkey"])
    return stored.read(spark, at)
