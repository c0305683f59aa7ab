"""Queries of the ten operators over their whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, bpe, chat, clusters, decontaminate, html_extract, language, licenses, quality, sharding, simhash, substring_dedup
from .session import table

SHARD_BYTES = 1 << 20


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).drop("text")


def op5_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_pairs(chat.pair_with_next(table(spark, sf_dir, "conversations")))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Of a vocabulary that the cluster's workers have installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    hashed = bpe.decode(ids, path)
    return hashed.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clusters.cluster(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256).alias("centroid_sha256"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out.alias("held_out"), "lang", "text")
    return language.identify(docs, ~F.col("held_out")).select("doc_id", "held_out", "lang_pred", "score")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment.align(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    return out.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))).drop("groups")


def queries() -> dict:
    return {f.__name__: f for f in (op1_simhash, op2_sharding, op3_quality, op4_decontamination, op5_preferences, op6_neighbours, op7_main_text, op8_bpe, op9_licenses, op10_substrings, op11_clusters, op12_language, op13_alignment)}


OP2_SQL = f"""
WITH rows AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents
), sums AS (
  SELECT d, h >> (60 - d) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes FROM rows, range(0, 40) t(d) GROUP BY ALL
), fits AS (
  SELECT r.doc_id, r.n_bytes, s.d, r.h >> (60 - s.d) AS prefix, s.shard_bytes,
         row_number() OVER (PARTITION BY r.doc_id ORDER BY s.d) AS nth
  FROM rows r JOIN sums s ON s.prefix = r.h >> (60 - s.d) WHERE s.shard_bytes <= {SHARD_BYTES}
)
SELECT doc_id, n_bytes, CASE WHEN d = 0 THEN '' ELSE right(lpad(bin(prefix), 64, '0'), d::INTEGER) END AS shard, shard_bytes FROM fits WHERE nth = 1
"""

OP5_SQL = """
WITH base AS (
  SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), last AS (
  SELECT conv_id, max(turn) FILTER (role = 'assistant') AS last FROM base GROUP BY conv_id
), donor AS (
  SELECT b.conv_id - 1 AS conv_id, min(b.text) AS other FROM base b JOIN last l ON b.conv_id = l.conv_id AND b.turn = l.last AND b.role = 'assistant' GROUP BY b.conv_id
), rejected AS (
  SELECT b.conv_id, b.turn, b.role, b.text FROM base b JOIN last l USING (conv_id) WHERE l.last IS NULL OR b.turn < l.last
  UNION ALL SELECT l.conv_id, l.last, 'assistant', d.other FROM last l JOIN donor d USING (conv_id) WHERE l.last IS NOT NULL
), sides AS (
  SELECT 'c' AS side, conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM base
  UNION ALL SELECT 'r', conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) FROM rejected
), common AS (
  SELECT conv_id, coalesce(min(n) FILTER (differ), max(n) + 1) - 1 AS n_shared FROM (
    SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.n, r.n) AS n,
           (c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text) AS differ
    FROM (SELECT * FROM sides WHERE side = 'c') c FULL JOIN (SELECT * FROM sides WHERE side = 'r') r ON c.conv_id = r.conv_id AND c.n = r.n
  ) GROUP BY conv_id
), pieces AS (
  SELECT s.*, k.n_shared, '<|im_start|>' || role || chr(10) AS head, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS piece
  FROM sides s JOIN common k USING (conv_id)
), placed AS (
  SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY conv_id, side, n > n_shared ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start FROM pieces
), spans AS (
  SELECT *, start::BIGINT::VARCHAR || '-' || (start + length(text) + 11)::BIGINT::VARCHAR AS span FROM placed
)
SELECT conv_id AS pair_id, any_value(n_shared)::BIGINT AS n_shared,
  coalesce(string_agg(piece, '' ORDER BY n) FILTER (side = 'c' AND n <= n_shared), '') AS prompt,
  coalesce(string_agg(piece, '' ORDER BY n) FILTER (side = 'c' AND n > n_shared), '') AS chosen,
  coalesce(string_agg(span, ',' ORDER BY n) FILTER (side = 'c' AND n > n_shared AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(piece, '' ORDER BY n) FILTER (side = 'r' AND n > n_shared), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY n) FILTER (side = 'r' AND n > n_shared AND role = 'assistant'), '') AS rejected_mask
FROM spans GROUP BY conv_id
"""

OP10_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM words WHERE len(w) >= 13
), keyed AS (
  SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS k FROM starts
), repeats AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS first FROM keyed) WHERE first < doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM repeats
), removed AS (
  SELECT doc_id, list(p) AS cut FROM gone GROUP BY doc_id
), each AS (
  SELECT d.doc_id, d.w, coalesce(r.cut, []) AS cut FROM words d LEFT JOIN removed r USING (doc_id)
), kept AS (
  SELECT doc_id, len(w) AS n, len(cut) AS m, CASE WHEN len(cut) = 0 THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(cut, i)) END AS k FROM each
)
SELECT doc_id, n::BIGINT AS n_words, m::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""


def _op11_sql(k: int = 40, rounds: int = 5) -> str:
    """Every vector against every centroid in each round."""
    finite = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    parts = [
        f"v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND {finite})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS j, v AS c FROM v QUALIFY j < {k})",
    ]
    for n in range(rounds + 1):
        parts.append(f"d{n} AS (SELECT r, j, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{n})")
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, arg_min(j, (d, j)) AS j, min(d) AS d FROM d{n} GROUP BY r)")
        if n < rounds:
            parts.append(f"s{n} AS (SELECT j, list(m ORDER BY i) AS c FROM (SELECT j, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m FROM (SELECT j, unnest(v) AS x, unnest(range(64)) AS i FROM a{n} JOIN v USING (r)) GROUP BY j, i) GROUP BY j)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT j, coalesce(s{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN s{n} USING (j))")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, j::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY j)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN v USING (r) JOIN c{rounds} USING (j)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": OP2_SQL, "op5_preferences": OP5_SQL, "op10_substrings": OP10_SQL, "op11_clusters": _op11_sql()}
