"""Queries of the thirteen operators over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, centroids, html_text, langid, mixing, packing, quality, shard, simhash, spelling, substring, warc, windows


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_files() -> dict[str, str]:
    import public_tokenizers as p

    return {"tokenizer": p.path("byte_bpe_50k.json"), "ranks": p.path("byte_bpe_50k.tiktoken")}


def word_tokenizer() -> str:
    import public_tokenizers as p

    return p.path("word_bpe_49k.json")


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    names = {"lang_cell": F.col("lang"), "source_cell": F.col("source")}
    numbers = {"length_cell": F.log2(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1.0))}
    out = shard.shard(docs, names, numbers, shards=8, law="rows")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), *names, *numbers, "curve")


def op2_columns(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_columns(packing.pack(_table(spark, sf_dir, "documents"), digest=packing.with_crc, **tokenizer_files()))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op5_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_substring_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op7_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_table(spark, sf_dir, "pages"))


def op8_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    docs = _table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.train(docs, ~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_simhash_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_open_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.pack(_table(spark, sf_dir, "documents"), word_tokenizer(), ids=False)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(spelling.count_words(_table(spark, sf_dir, "documents"), damage=199))


def op13_native_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_hilbert_shards, op2_linear_grouping, op3_source_mix, op4_warc_round_trip, op5_cross_polytope, op6_substring_doubling, op7_site_templates, op8_ppm_language, op9_host_rules, op10_simhash_deletion, op11_open_windows, op12_spelling_variants, op13_native_centroids, pipeline]
    return {f.__name__: f for f in own}


_WORDS = r"""list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"""

SQL = {
    "op3_source_mix": rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) AS sid FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][(sid % 3 + 1)::INT]::BIGINT AS weight, 3 * source_size AS cap FROM s
), c AS (
  SELECT *, cap / weight AS ratio,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cap_before,
    sum(weight) OVER (ORDER BY cap / weight DESC, sid DESC)::BIGINT AS open_weight,
    sum(source_size) OVER ()::BIGINT AS total
  FROM w
), l AS (
  SELECT total - cap_before AS free, open_weight AS rest FROM c WHERE ratio > (total - cap_before) / open_weight ORDER BY ratio, sid LIMIT 1
), t AS (
  SELECT source, sid, n, source_size, CASE WHEN l.free IS NULL OR ratio <= l.free / l.rest THEN cap::DOUBLE ELSE (weight * l.free) / l.rest END AS target FROM c LEFT JOIN l ON true
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS whole FROM t
), r AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.whole, floor(b.target + 0.5)::BIGINT - b.whole * b.source_size AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY b.sid ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM r
""",
    "op4_warc_round_trip": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
""",
    "op6_substring_doubling": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
), win AS (
  SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM d, range(1, len(w) - 33) g(i)
), rep AS (
  SELECT r, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT r, i + j AS p FROM rep, range(0, 35) o(j)
), kept AS (
  SELECT d.r, i, w[i] AS x FROM d, range(1, len(w) + 1) g(i) WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.r = d.r AND gone.p = i)
), text AS (
  SELECT r, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM kept GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN text USING (r)
""",
}


def _centroid_sql(rounds: int = 10) -> str:
    """The rounds of op13 as one table each: distances of all vectors to the eight centroids, the least of them, and floors of means."""
    assigned = "SELECT r, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (SELECT r, cluster, sum((q - c) * (q - c))::BIGINT AS d FROM v JOIN {} USING (i) GROUP BY r, cluster) GROUP BY r"
    means = "SELECT cluster, i, sum(q)::BIGINT AS s, count(*) AS n FROM v JOIN {} USING (r) GROUP BY cluster, i"
    steps = []
    for k in range(rounds):
        steps.append(f"a{k} AS MATERIALIZED ({assigned.format(f'c{k}')})")
        steps.append(f"m{k} AS MATERIALIZED ({means.format(f'a{k}')})")
        steps.append(f"c{k + 1} AS MATERIALIZED (SELECT cluster, i, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM c{k} LEFT JOIN m{k} USING (cluster, i))")
    nl = ",\n"
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS MATERIALIZED (
  SELECT r, i, q[i] AS q FROM k, range(1, 65) g(i)
), c0 AS MATERIALIZED (
  SELECT cluster, i, q[i] AS c FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), q) - 1 AS cluster, q FROM k QUALIFY cluster < 8), range(1, 65) g(i)
),
{nl.join(steps)},
f AS MATERIALIZED ({assigned.format(f"c{rounds}")}),
h AS (SELECT cluster, sha256(string_agg(c::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT vec_id, cluster::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, centroid_sha256
FROM k JOIN f USING (r) JOIN h USING (cluster)
"""


SQL["op13_native_centroids"] = _centroid_sql()


def oracle_sql() -> dict[str, str]:
    return SQL
