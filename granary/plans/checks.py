"""Queries of gates, reports, prompts and states over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import conversations as C
from ..functions.metrics import guarded_ratio
from ..operators import evaluation as E
from ..operators import leakage as L
from ..operators import registry as R
from ..operators import validation as Q
from . import bindings
from .bindings import RECORDS, TEXTS, table
from .catalog import SQL, _arms, query, six

_TURNS = "m AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)"
_BLANK = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(f"WITH {_TURNS} SELECT conv_id, i, CASE WHEN role = 'assistant' THEN trim(text, {_BLANK}) ELSE '<think>x</think>' || text END AS content FROM m")
def f17_without_reasoning(spark: SparkSession, sf: str) -> DataFrame:
    """Reasoning put before every turn goes from assistant turns alone."""
    said = F.transform("messages", lambda m: m.withField("content", F.concat(F.when(m["role"] == "assistant", F.lit("<think>\nstep 1\n</think>\n")).otherwise(F.lit("<think>x</think>")), m["content"])).withField("reasoning", F.lit("because")))
    rows = bindings.conversations(spark, sf).select("conv_id", F.posexplode(C.without_reasoning(said)).alias("i", "m"))
    return rows.filter(F.col("m.reasoning").isNull() == (F.col("m.role") == "assistant")).select("conv_id", F.col("i").cast("long").alias("i"), "m.content")


@query(f"WITH {_TURNS} SELECT conv_id, 'Be brief.' || max(CASE WHEN i = 0 AND role = 'system' THEN chr(10) || chr(10) || text ELSE '' END) AS system, count(*) + 1 - max((i = 0 AND role = 'system')::INT) AS n FROM m GROUP BY conv_id")
def f41_composed_prompts(spark: SparkSession, sf: str) -> DataFrame:
    built = bindings.conversations(spark, sf).select("conv_id", C.build_prompt(F.col("messages"), F.lit("Be brief."), compose=True).alias("p"))
    return built.select("conv_id", C.system_prompt(F.col("p")).alias("system"), F.size("p").cast("long").alias("n"))


@query(
    f"""WITH {_TURNS}, s AS (SELECT conv_id, max(CASE WHEN i = 0 AND role = 'system' THEN text END) AS system, min(CASE WHEN role = 'user' THEN i END) AS u FROM m GROUP BY conv_id)
SELECT conv_id, i - (system IS NOT NULL)::INT AS i, CASE WHEN i = u AND system IS NOT NULL THEN system || chr(10) || chr(10) || text ELSE text END AS content FROM m JOIN s USING (conv_id) WHERE system IS NULL OR i > 0"""
)
def f42_folded_system(spark: SparkSession, sf: str) -> DataFrame:
    folded = bindings.conversations(spark, sf).select("conv_id", F.posexplode(C.fold_system(F.col("messages"))).alias("i", "m"))
    return folded.select("conv_id", F.col("i").cast("long").alias("i"), "m.content")


@query(
    """WITH l AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1 AS i FROM lineitem)
SELECT l_orderkey, sum(CASE WHEN i = 0 OR i BETWEEN 2 AND 3 THEN l_partkey ELSE -100 END)::BIGINT AS labels, count(*) FILTER (i = 1 OR i > 3) AS ignored FROM l GROUP BY l_orderkey"""
)
def f43_label_masks(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of orders as ids, of which the first, the third and the fourth lie in assistant spans."""
    ids = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("ids"))
    span = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    masked = ids.select("l_orderkey", C.label_mask(F.col("ids"), F.array(span(0, 1), span(2, 4))).alias("x"))
    return masked.select("l_orderkey", F.aggregate("x", F.lit(0).cast("long"), lambda a, b: a + b).alias("labels"), F.size(F.filter("x", lambda v: v == -100)).cast("long").alias("ignored"))


@query(
    """WITH e AS (SELECT user_id, event_id, CASE event_id % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' ELSE 'note' END AS status, event_id * 0.25::DOUBLE AS ts FROM events)
SELECT CAST(user_id AS VARCHAR) AS experiment_id, arg_max(status, ts) AS status, min(ts) FILTER (status = 'running') AS started, max(ts) FILTER (status IN ('completed', 'failed')) AS finished, round(max(ts) FILTER (status IN ('completed', 'failed')) - min(ts) FILTER (status = 'running'), 2) AS duration_seconds FROM e GROUP BY user_id"""
)
def f51_latest_status(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 4
    status = F.when(k == 0, "running").when(k == 1, "completed").when(k == 2, "failed").otherwise("note")
    return R.latest_status(table(spark, sf, "events").select(F.col("user_id").cast("string").alias("experiment_id"), status.alias("status"), (F.col("event_id") * 0.25).alias("ts")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_discount = 0 THEN 0 ELSE round((l_tax - l_discount) / l_discount, 6) END AS relative_delta FROM lineitem")
def f54_relative_deltas(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").withColumn("relative_delta", guarded_ratio(F.col("l_tax") - F.col("l_discount"), F.col("l_discount")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", *six("relative_delta"))


_LEAKS = f"""{TEXTS}, e AS (SELECT *, min(ord) OVER (PARTITION BY text) AS o FROM txt), x AS (SELECT 'exact_duplicate' AS kind, a.id AS left_id, b.id AS right_id, a.split AS l, b.split AS r, 1.0 AS s FROM e b JOIN e a ON a.ord = b.o AND b.ord > b.o),
f AS (SELECT family, split, arg_min(id, ord) AS id FROM txt WHERE family <> '' GROUP BY family, split), h AS (SELECT *, first_value(split) OVER w AS hs, first_value(id) OVER w AS hi FROM f WINDOW w AS (PARTITION BY family ORDER BY split)),
d AS (SELECT * FROM x UNION ALL SELECT 'scenario_repeat', hi, id, hs, split, 0.0 FROM h WHERE split <> hs)"""


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    rows = bindings.texts(spark, sf)
    return L.exact_duplicates(rows).union(L.scenario_repeats(rows))


@query(f"WITH {_LEAKS} SELECT kind, count(*) AS n, count(*) FILTER (kind = 'exact_duplicate') AS fatal FROM d WHERE l <> r GROUP BY kind")
def j06_across_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Findings across splits, and the fatal ones among them, by kind."""
    found = _leaks(spark, sf)
    crossed = L.cross_split(found).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return crossed.join(L.fatal(found).groupBy("kind").agg(F.count(F.lit(1)).alias("fatal")), "kind", "left").fillna(0)


@query(f"WITH {_LEAKS} SELECT p AS fail_on, CASE p WHEN 'none' THEN 'passes' WHEN 'fatal' THEN (SELECT CASE WHEN count(*) = 0 THEN 'passes' ELSE count(*) || ' findings across splits' END FROM d WHERE l <> r AND kind = 'exact_duplicate') ELSE (SELECT CASE WHEN count(*) = 0 THEN 'passes' ELSE count(*) || ' findings across splits' END FROM d WHERE l <> r) END AS said FROM (SELECT unnest(['none', 'fatal', 'any']) AS p)")
def p13_policies(spark: SparkSession, sf: str) -> DataFrame:
    """What each policy says of the documents' splits."""
    found, said = _leaks(spark, sf), []
    for policy in ("none", "fatal", "any"):
        try:
            L.enforce(found, policy)
            said.append((policy, "passes"))
        except ValueError as e:
            said.append((policy, str(e)))
    return spark.createDataFrame(said, "fail_on string, said string")


@query(f"WITH {_LEAKS} SELECT kind, left_id, right_id, l <> r AS crosses FROM d ORDER BY l <> r DESC, s DESC, kind, left_id, right_id LIMIT 200")
def w07_report(spark: SparkSession, sf: str) -> DataFrame:
    """The findings that a report lists."""
    return L.report_order(_leaks(spark, sf)).select("kind", "left_id", "right_id", (F.col("left_split") != F.col("right_split")).alias("crosses"))


@query(f"WITH v AS ({SQL['p05_validation_findings']}) SELECT severity, count(*) AS findings, sum(n_affected)::BIGINT AS affected, severity <> 'error' AS ok FROM v GROUP BY severity")
def p16_severities(spark: SparkSession, sf: str) -> DataFrame:
    """Findings by severity, and whether a dataset with these alone would pass."""
    found = Q.validate(bindings.examples(spark, sf), max_tokens=2048)
    kinds = found.groupBy("severity").agg(F.count(F.lit(1)).alias("findings"), F.sum("n_affected").alias("affected"))
    return kinds.withColumn("ok", F.col("severity") != "error")


@query("""SELECT o_orderkey, sha256('{"clerk":"' || o_custkey || '","priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}') AS config_hash FROM orders""")
def a17_config_hash(spark: SparkSession, sf: str) -> DataFrame:
    fields = F.create_map(F.lit("status"), "o_orderstatus", F.lit("clerk"), F.col("o_custkey").cast("string"), F.lit("priority"), "o_orderpriority")
    return table(spark, sf, "orders").select("o_orderkey", R.identity_hash(fields).alias("config_hash"))


@query(f"WITH {RECORDS}, d AS (SELECT task, group_id, avg(tuned) - avg(base) AS d FROM rec GROUP BY ALL) SELECT task, group_id, CASE WHEN d > 0.01 THEN 'improved' WHEN d < -0.01 THEN 'regressed' ELSE 'no change' END AS direction FROM d WHERE abs(abs(d) - 0.01) > 1e-9")
def a26_directions(spark: SparkSession, sf: str) -> DataFrame:
    """Which way each task went in each group of examples."""
    delta = _arms(spark, sf).groupBy("task", "group_id").agg((F.avg("tuned") - F.avg("base")).alias("d")).filter(F.abs(F.abs("d") - 0.01) > 1e-9)
    return delta.select("task", "group_id", E.direction(F.col("d")).alias("direction"))
