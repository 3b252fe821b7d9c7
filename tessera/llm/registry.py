"""The registered queries of the corpus operators: thin calls over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import best_fit, bradley_terry, byte_bpe, centroids, ftrl, gif, graph_ann, parity_join, pieces, secrets, surrogates, whitening, wrapper
from tessera.llm import common
from tessera.llm.common import crc_part


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.small_batches(spark)
    return common.table(spark, sf_dir, name)


def _judged(scored: DataFrame, held_out, cut: float) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


#: The key of the surrogates in the registered query; a deployment passes its own.
DEMO_KEY = b"tessera-demonstration-key"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = surrogates.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)
    return done.select("doc_id", "text", "n_entities")


def op2_quality_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranking = bradley_terry.train(docs, table(spark, sf_dir, "labels"), crc_part("doc_id", 4) != 2)
    return _judged(bradley_terry.score(docs, ranking), crc_part("doc_id", 4) == 2, bradley_terry.CUT)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern).select("doc_id", "ids")
    back = byte_bpe.decode(coded, path, pattern)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph_ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.jaccard_components(table(spark, sf_dir, "documents"), width=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(table(spark, sf_dir, "documents"))


def op8_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = ftrl.train(docs, table(spark, sf_dir, "labels"), crc_part("doc_id", 5) != 0, max_rows=50_000)
    return _judged(ftrl.score(docs, weights), crc_part("doc_id", 5) == 0, 0.5)


def op9_media_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    back = gif.summaries(gif.store(docs).select("doc_id", "n_bytes", "media")).select("doc_id", "n_bytes", "media", "summary.*")
    feature = F.concat_ws(";", F.col("n_frames").cast("string"), F.col("duration_ms").cast("string"), F.array_join(F.col("histogram").cast("array<string>"), ","))
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op10_secrets_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(docs)).select("doc_id", "secrets")
    line = lambda some: F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(line(F.filter("secrets", lambda s: s["kind"] != "markov")).cast("binary"), 256).alias("base_sha256"),
        line(F.col("secrets")).alias("spans"),
    )


def op11_whitening_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), k=8).withColumn("deviation", F.col("deviation").cast("long"))


def op12_centroids_gemm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10)
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    back = pieces.decode(pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).select("doc_id", "ids"), path)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii_surrogates, op2_quality_bradley_terry, op3_byte_bpe, op4_graph_ann, op5_html_wrapper, op6_ngram_jaccard_join, op7_best_fit_packing, op8_toxicity_ftrl, op9_media_gif, op10_secrets_markov, op11_whitening_tiled, op12_centroids_gemm, op13_sentencepiece)}


#: Sets of shingles, pairs that share one, and reachability: plain, and for small tables only.
_JACCARD_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]) END) AS s FROM words
), sizes AS (
    SELECT doc_id, count(s) AS n FROM words LEFT JOIN shingles USING (doc_id) GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common >= 90 * (p.n + q.n - common)
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT sizes.doc_id, CAST(n AS BIGINT) AS n_shingles, least AS component_id FROM sizes JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) ON a = sizes.doc_id
"""


def _clusters_sql(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """Every round as two tables: rows with their nearest centroid, and the centroids that follow."""
    nearest = "SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.r, v.vec_id, v.x, m.c, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v.x, m.x)]) AS d FROM v, m{j} m) GROUP BY r"
    moved = f"SELECT m.c, coalesce(n.x, m.x) AS x FROM m{{j}} m LEFT JOIN (SELECT c, list((s - (s % n + n) % n) // n ORDER BY i) AS x FROM (SELECT c, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{{j}}, range(1, {dims + 1}) AS t(i) GROUP BY c, i) GROUP BY c) n ON n.c = m.c"
    steps = [f"a{j} AS MATERIALIZED ({nearest.format(j=j)}), m{j + 1} AS MATERIALIZED ({moved.format(j=j)})" for j in range(rounds)]
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding] AS x FROM embeddings WHERE len(embedding) = {dims} AND len([1 FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0),
    m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('3:' || vec_id) AS h, x FROM v ORDER BY 1, 2 LIMIT {k})), {", ".join(steps)}, a{rounds} AS MATERIALIZED ({nearest.format(j=rounds)})
    SELECT vec_id, CAST(a.c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.x, ',')) AS centroid_sha256
    FROM a{rounds} a JOIN m{rounds} m ON m.c = a.c"""


def oracle_sql() -> dict[str, str]:
    return {"op6_ngram_jaccard_join": _JACCARD_SQL, "op12_centroids_gemm": _clusters_sql()}
