"""Further queries: answers read out of text, joins of runs, gates, and the logs' windows over tables at rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import conversations as C
from ..functions import extract as A
from ..functions import text as X
from ..operators import evaluation as E
from ..operators import registry as R
from ..sources import files
from ..streaming import logs
from . import bindings
from .bindings import RANKS, RECORDS, table
from .catalog import _EVENTS, _decisions, _summary_sql, query, six

def no_json() -> Column:
    """An answer without JSON."""
    return F.lit(None).cast("string")


@query(f"WITH {RANKS}, t AS (SELECT l_orderkey, count(*) FILTER (pr <= 3) AS p, count(*) FILTER (rr <= 2) AS r, count(*) FILTER (pr <= 3 AND rr <= 2) AS c FROM rk GROUP BY 1) SELECT l_orderkey, round(c / (p + r - c), 6) AS jaccard FROM t")
def f04_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return bindings.rankings(spark, sf).select("l_orderkey", X.jaccard(F.slice("predicted", 1, 3), F.slice("reference", 1, 2)).alias("jaccard")).select("l_orderkey", *six("jaccard"))


@query("SELECT event_id, 'kept ' || event_id AS answer, true AS had FROM events")
def f11_strip_reasoning(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat(F.lit("<think>about "), F.col("event_type"), F.lit("</think>\n kept "), F.col("event_id").cast("string"))
    return table(spark, sf, "events").select("event_id", X.strip_reasoning(said).alias("answer"), X.contains_reasoning(said).alias("had"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 2 = 0 THEN 'fam' ELSE CAST(o_orderkey AS VARCHAR) END AS grp FROM orders")
def f14_group_key(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(key, C.group_key(None, F.when(key % 3 == 0, F.col("o_orderpriority")).otherwise(""), F.when(key % 2 == 0, "fam"), key).alias("grp"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR coalesce(lang, '') = '' THEN '<unspecified>' ELSE lang END AS value FROM documents")
def f18_holdout_value(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", C.holdout_value(F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("lang"))).alias("value"))


@query("SELECT subset, count(*) AS n FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'answerable' WHEN 1 THEN 'should_decline' END AS subset FROM orders) GROUP BY subset")
def f19_subsets(spark: SparkSession, sf: str) -> DataFrame:
    confident = F.when(F.col("o_orderkey") % 3 == 0, True).when(F.col("o_orderkey") % 3 == 1, False)
    return table(spark, sf, "orders").groupBy(E.subset_of(confident).alias("subset")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {RANKS} SELECT l_orderkey, string_agg('part-' || l_partkey, ',' ORDER BY pr) AS ranking FROM rk GROUP BY 1")
def f22_extract_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Rankings written out as numbered lines and read back."""
    lines = F.array_join(F.transform("predicted", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". part-"), x)), "\n")
    names = F.transform("reference", lambda x: F.concat(F.lit("part-"), x))
    return bindings.rankings(spark, sf).select("l_orderkey", F.array_join(A.extract_ranking(lines, no_json(), names), ",").alias("ranking"))


@query("SELECT event_id, lower(event_type) AS factor FROM events")
def f24_extract_factor(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat(F.lit("First of all, this. What decided it: "), F.col("event_type"))
    return table(spark, sf, "events").select("event_id", A.extract_factor(said, no_json(), F.array(F.lit("deadline"))).alias("factor"))


@query("SELECT event_id, event_id % 2 <> 0 AS confident FROM events")
def f25_confidence(spark: SparkSession, sf: str) -> DataFrame:
    said = F.when(F.col("event_id") % 2 == 0, "I do not know which one you mean.").otherwise("Take the first.")
    return table(spark, sf, "events").select("event_id", A.extract_confidence(said, no_json())["confident"].alias("confident"))


@query("SELECT l_orderkey, l_linenumber, l_partkey::BIGINT AS trace, l_suppkey::BIGINT AS answer, true AS closed FROM lineitem")
def f38_split_thinking(spark: SparkSession, sf: str) -> DataFrame:
    begin, end = 2_000_000_001, 2_000_000_002
    ids = F.array(F.lit(begin), F.col("l_partkey").cast("int"), F.lit(end), F.col("l_suppkey").cast("int"))
    s = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", C.split_thinking(ids, begin, end).alias("s"))
    return s.select("l_orderkey", "l_linenumber", F.col("s.trace")[0].cast("long").alias("trace"), F.col("s.answer")[0].cast("long").alias("answer"), "s.closed")


@query(f"WITH {RECORDS} SELECT example_id, round(score, 6) AS stored, round(score + 0.125, 6) AS again, 0.125::DOUBLE AS delta FROM rec WHERE example_id % 10 = 0")
def j02_regraded(spark: SparkSession, sf: str) -> DataFrame:
    rec = bindings.records(spark, sf)
    again = rec.withColumn("score", F.col("score") + F.when(F.col("example_id") % 10 == 0, 0.125).otherwise(0.0))
    return R.regraded(rec, again).select("example_id", *six("stored", "again", "delta"))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey % 2 = 0)")
def j10_missing(spark: SparkSession, sf: str) -> DataFrame:
    have = table(spark, sf, "lineitem").filter("l_partkey % 2 = 0").select(F.col("l_partkey").alias("p_partkey"))
    return files.missing_files(table(spark, sf, "part").select("p_partkey"), have, "p_partkey")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'user' ELSE '' END AS differ FROM events")
def j12_map_differences(spark: SparkSession, sf: str) -> DataFrame:
    e, kind = table(spark, sf, "events"), F.lit("type")
    left = F.create_map(kind, "event_type", F.lit("user"), F.col("user_id").cast("string"))
    right = F.create_map(kind, "event_type", F.lit("user"), (F.col("user_id") + F.when(F.col("event_id") % 4 == 0, 1).otherwise(0)).cast("string"))
    return e.select("event_id", F.array_join(F.map_keys(R.map_differences(left, right)), ",").alias("differ"))


@query(f"WITH {RECORDS} SELECT count(*) AS n, count(*) FILTER (score > 0.5) AS flagged FROM rec")
def j13_gold_floor(spark: SparkSession, sf: str) -> DataFrame:
    rec = bindings.records(spark, sf)
    return R.gold_floor(rec, rec.select("example_id"), F.col("score") > 0.5)


@query(
    f"""WITH {RECORDS}, m AS (SELECT avg(base) FILTER (split_tag = 'in_distribution') AS bi, avg(base) FILTER (split_tag = 'ood') AS bo, avg(tuned) FILTER (split_tag = 'in_distribution') AS ti, avg(tuned) FILTER (split_tag = 'ood') AS t FROM rec)
SELECT round(ti - bi, 6) AS in_score_delta, round(t - bo, 6) AS ood_score_delta, round((ti - t) - (bi - bo), 6) AS gap_delta, CASE WHEN t - bo > 0.01 THEN 'improved' WHEN t - bo < -0.01 THEN 'regressed' ELSE 'no change' END AS ood_verdict FROM m"""
)
def a10_compare_ood(spark: SparkSession, sf: str) -> DataFrame:
    rec = bindings.records(spark, sf)
    both = E.compare_ood(E.ood_report(rec), E.ood_report(rec.withColumn("score", F.col("tuned"))))
    return both.select(*six("in_score_delta", "ood_score_delta", "gap_delta"), "ood_verdict")


@query(f"WITH {_EVENTS} SELECT count(*) AS groups, round(avg(CASE WHEN dd = 1 AND majority = 'error' THEN 1.0 ELSE 0.0 END), 6) AS correct_agreement_rate FROM mj WHERE n >= 2")
def a13_correct_agreement(spark: SparkSession, sf: str) -> DataFrame:
    rows = _decisions(spark, sf).withColumn("reference_decision", F.lit("error"))
    return E.consistency(E.consistency_groups(rows)).select("groups", *six("correct_agreement_rate"))


@query(f"WITH {RECORDS}, u AS (SELECT 'base' AS name, base AS v FROM rec UNION ALL SELECT 'tuned', tuned FROM rec) SELECT name, {_summary_sql('v')} FROM u GROUP BY name")
def a23_sub_scores(spark: SparkSession, sf: str) -> DataFrame:
    rec = bindings.records(spark, sf).select(F.create_map(F.lit("base"), "base", F.lit("tuned"), "tuned").alias("sub_scores"))
    return E.summarize_sub_scores(rec).select("name", "n", *six("mean", "std"), "minimum", "maximum", *six("ci_low", "ci_high"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND sha256(CAST(o_orderkey AS VARCHAR)) LIKE '0a%'")
def p07_find_runs(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("config_hash"))
    return R.find_runs(runs, config_hash="0a", status="F").select("o_orderkey")


@query("SELECT page_id, CASE WHEN regexp_matches(url, '[05]$') THEN 'ends' WHEN regexp_matches(url, '[13579]') THEN 'odd' END AS reason FROM pages")
def p10_upload_check(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", F.col("url").alias("path"))
    return files.upload_check(pages, {"ends": "[05]$", "odd": "[13579]"}).select("page_id", "reason")


@query(
    """WITH c AS (SELECT 'large' AS "check", CASE WHEN o_totalprice > 100000 THEN 'PASS' ELSE 'FAIL' END AS result FROM orders UNION ALL SELECT 'even', CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_totalprice < 200000 THEN 'PASS' ELSE 'FAIL' END ELSE 'SKIP' END FROM orders)
SELECT "check", result, count(*) AS n FROM c GROUP BY ALL"""
)
def p11_gate(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "experiment_id")
    checks = {"large": F.col("o_totalprice") > 100000, "even": F.when(F.col("experiment_id") % 2 == 0, F.col("o_totalprice") < 200000)}
    return R.gate(runs, checks).groupBy("check", "result").agg(F.count(F.lit(1)).alias("n"))


# the streams' operators, over a table at rest


@query("SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def t01_windowed_counts(spark: SparkSession, sf: str) -> DataFrame:
    return logs.windowed_counts(table(spark, sf, "events"), "ts", ["event_type"]).select(F.unix_timestamp("window.start").alias("start"), "event_type", "n")


@query(
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, n, count(*) AS sessions FROM (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL) GROUP BY ALL"""
)
def t02_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return logs.sessions(table(spark, sf, "events"), "ts", ["user_id"]).groupBy("user_id", "n").agg(F.count(F.lit(1)).alias("sessions"))


@query(
    """WITH p AS (SELECT user_id, event_id AS step, max(value) OVER (w ROWS UNBOUNDED PRECEDING) AS peak, max(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id AS experiment_id, step, peak FROM p WHERE peak > 400 AND coalesce(before, -1) <= 400"""
)
def t03_memory_alarm(spark: SparkSession, sf: str) -> DataFrame:
    steps = table(spark, sf, "events").select(F.col("user_id").alias("experiment_id"), F.col("event_id").alias("step"), F.col("value").alias("memory"))
    return logs.memory_alarm(steps, 400.0).filter("alarm").select("experiment_id", "step", "peak")
