"""The driver's tables in the shapes that the operators take, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stable_rank


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and benchmark passages as rows of splits (passages are the split `evaluation`)."""
    d = table(spark, sf_dir, "documents")
    rank = stable_rank(F.col("doc_id").cast("string"), 42)
    split = F.when(rank < 0.7, "train").when(rank < 0.85, "validation").otherwise("test")
    docs = d.select(F.col("doc_id").cast("string").alias("id"), split.alias("split"), F.col("doc_id").alias("ord"), "text", F.col("source").alias("family"), F.concat(F.lit("set_"), (F.col("doc_id") % 7).cast("string")).alias("entities"))
    b = table(spark, sf_dir, "benchmark")
    items = b.select(F.concat(F.lit("b"), F.col("item_id")).alias("id"), F.lit("evaluation").alias("split"), (F.col("item_id") + 10**12).alias("ord"), "text", F.lit(None).cast("string").alias("family"), F.lit(None).cast("string").alias("entities"))
    return docs.union(items)


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels as dataset rows."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(l, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") % 10 == 0, "2.0").otherwise("1.1").alias("version"),
        F.lit("tool_routing").alias("task"),
        "text",
        F.array("text").alias("targets"),
        F.create_map(F.lit("domain"), F.col("lang"), F.lit("format"), F.lit("plain"), F.lit("shelf"), F.col("source")).alias("axes"),
        F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "reviewed").otherwise("draft").alias("quality_status"),
        "source",
        F.lit("train").alias("split"),
        F.col("doc_id").alias("ord"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with lines as graded results of two arms: clusters are the customers' nations, tasks the priorities."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.max("l_discount") * 10).alias("base"), (F.max("l_tax") * 12.5).alias("tuned"))
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = o.join(lines, o.o_orderkey == lines.l_orderkey).join(c, o.o_custkey == c.c_custkey)
    return joined.select(
        F.col("o_orderkey").alias("example_id"),
        F.col("o_orderkey").alias("ord"),
        "base",
        "tuned",
        F.col("base").alias("score"),
        F.col("c_nationkey").cast("string").alias("group_id"),
        F.col("o_orderpriority").alias("task"),
        F.when(F.col("o_orderkey") % 3 == 0, "should_decline").when(F.col("o_orderkey") % 3 == 1, "answerable").alias("subset"),
        F.when(F.year("o_orderdate") % 2 == 1, "ood").otherwise("in_distribution").alias("split_tag"),
        F.concat(F.lit("q"), F.quarter("o_orderdate")).alias("ood_shift"),
    )


RECORDS = """
rec AS (
  SELECT o_orderkey AS example_id, base, tuned, base AS score, CAST(c_nationkey AS VARCHAR) AS group_id, o_orderpriority AS task,
    CASE o_orderkey % 3 WHEN 0 THEN 'should_decline' WHEN 1 THEN 'answerable' END AS subset,
    CASE WHEN year(o_orderdate) % 2 = 1 THEN 'ood' ELSE 'in_distribution' END AS split_tag, 'q' || quarter(o_orderdate) AS ood_shift
  FROM orders JOIN (SELECT l_orderkey, max(l_discount) * 10 AS base, max(l_tax) * 12.5 AS tuned FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey
)"""


def rank_sql(key: str, seed: int) -> str:
    return f"(CAST(CAST('0x' || substr(sha256('{seed}:' || {key}), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616)"


TEXTS = f"""
txt AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN r < 0.7 THEN 'train' WHEN r < 0.85 THEN 'validation' ELSE 'test' END AS split, doc_id AS ord, text, source AS family, 'set_' || (doc_id % 7) AS entities
  FROM (SELECT *, {rank_sql("CAST(doc_id AS VARCHAR)", 42)} AS r FROM documents)
  UNION ALL SELECT 'b' || item_id, 'evaluation', item_id + 1000000000000, text, NULL, NULL FROM benchmark
)"""


def rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order with two parts or more: its parts by price (predicted) and by quantity (reference), ties by part."""
    parts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_extendedprice").alias("p"), F.max("l_quantity").alias("q"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct((-F.col(c)).alias("v"), "l_partkey"))), lambda x: x["l_partkey"].cast("string"))
    return parts.groupBy("l_orderkey").agg(ordered("p").alias("predicted"), ordered("q").alias("reference")).filter(F.size("reference") >= 2)


RANKS = """
part_of AS (SELECT l_orderkey, l_partkey, max(l_extendedprice) AS p, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
rk AS (
  SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY p DESC, l_partkey) AS pr, row_number() OVER (PARTITION BY l_orderkey ORDER BY q DESC, l_partkey) AS rr, count(*) OVER (PARTITION BY l_orderkey) AS n
  FROM part_of QUALIFY n >= 2
)"""


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, messages in order of turns; a conversation is a row, as in a dataset."""
    turns = table(spark, sf_dir, "conversations")
    message = F.struct("turn", "role", F.col("text").alias("content"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("reasoning"))
    return turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(message)), lambda m: m.dropFields("turn")).alias("messages"))
