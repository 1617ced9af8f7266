"""Queries of saved results, replies, datasets as JSON lines, splits and verdicts, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import conversations as C
from ..functions import replies as P
from ..operators import bootstrap as B
from ..operators import results as S
from ..operators import splits as D
from ..operators import validation as Q
from ..sources import jsonl
from . import bindings
from .bindings import RANKS, RECORDS, rank_sql, table
from .catalog import _arms, compare_sql, query, six


# saved results


def _payloads(spark: SparkSession, sf: str) -> DataFrame:
    """The records of each nation's customers as one payload of an arm."""
    rec = bindings.records(spark, sf)
    nothing = {"response": "an answer", "decision": None}
    kept = rec.select("example_id", F.concat(F.lit("arm"), F.col("group_id")).alias("arm"), F.col("example_id").cast("string").alias("_id"), "task", "score", "split_tag", *[F.lit(v).cast("string").alias(k) for k, v in nothing.items()])
    return S.payloads(kept.drop("example_id").withColumnRenamed("_id", "example_id"), responses=False)


@query(f"WITH {RECORDS} SELECT CAST(example_id AS VARCHAR) AS example_id, 'arm' || group_id AS arm, task, round(score, 6) AS score, split_tag, true AS bare FROM rec")
def s09_load_results(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads written without responses and read back."""
    return S.payload_rows(_payloads(spark, sf)).select("example_id", "arm", "task", *six("score"), "split_tag", F.col("response").isNull().alias("bare"))


@query(f"WITH {RECORDS} SELECT 'arm' || group_id AS arm, count(*) AS example_count FROM rec GROUP BY group_id")
def s10_payload_heads(spark: SparkSession, sf: str) -> DataFrame:
    return _payloads(spark, sf).select("arm", F.get_json_object("value", "$.example_count").cast("long").alias("example_count"))


@query(f"WITH {RECORDS} SELECT count(*) AS n, round(sum(score), 6) AS total FROM rec WHERE split_tag = 'ood' AND task = '1-URGENT'")
def p08_scores_for(spark: SparkSession, sf: str) -> DataFrame:
    return S.scores_for(bindings.records(spark, sf), "ood", "1-URGENT").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total")).select("n", *six("total"))


@query(f"WITH {RANKS}, l AS (SELECT l_orderkey, string_agg('\"' || l_partkey || '\"', ',' ORDER BY pr) AS ranks FROM rk GROUP BY 1) SELECT l_orderkey, CASE WHEN l_orderkey % 3 = 0 THEN 'label' WHEN l_orderkey % 3 = 1 THEN '[' || ranks || ']' ELSE 'said' END AS decision FROM l")
def f34_decision(spark: SparkSession, sf: str) -> DataFrame:
    key, none = F.col("l_orderkey"), F.array().cast("array<string>")
    return bindings.rankings(spark, sf).select(key, S.decision(F.when(key % 3 == 0, "label").otherwise(""), F.when(key % 3 == 1, F.col("predicted")).otherwise(none), none, F.lit("\n said ")).alias("decision"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderstatus WHEN 2 THEN o_clerk END AS decision FROM (SELECT *, 'clerk' || o_custkey AS o_clerk FROM orders)")
def f34_reference_decision(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    ref = F.struct(F.when(k == 0, F.col("o_orderpriority")).alias("label"), F.when(k <= 1, F.col("o_orderstatus")).alias("expected_decision"), F.when(k <= 2, F.concat(F.lit("clerk"), F.col("o_custkey").cast("string"))).alias("text"), F.lit(None).cast("array<string>").alias("ranking"))
    return table(spark, sf, "orders").select("o_orderkey", S.reference_decision(ref).alias("decision"))


@query(f"WITH {RECORDS}, l AS (SELECT DISTINCT task, example_id FROM rec WHERE example_id % 5 <> 0), r AS (SELECT DISTINCT task, example_id FROM rec WHERE example_id % 7 <> 0 OR task = '5-LOW'), b AS (SELECT coalesce(l.task, r.task) AS task, l.example_id AS x, r.example_id AS y FROM l FULL JOIN r ON l.task = r.task AND l.example_id = r.example_id) SELECT task, count(x) AS n_left, count(y) AS n_right, count(x + y) AS n_both, count(x) = count(x + y) AND count(y) = count(x + y) AS covered FROM b GROUP BY task")
def u06_coverage(spark: SparkSession, sf: str) -> DataFrame:
    rec = bindings.records(spark, sf)
    return S.coverage(rec.filter("example_id % 5 <> 0"), rec.filter("example_id % 7 <> 0 or task = '5-LOW'"))


@query(
    """WITH o AS (SELECT o_custkey, o_orderkey, o_orderpriority, o_orderstatus, o_totalprice, lead(o_orderkey) OVER w AS k, lead(o_orderpriority) OVER w AS p, lead(o_orderstatus) OVER w AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_orderkey, CASE WHEN o_orderpriority <> p THEN 'dataset_version,' ELSE '' END || CASE WHEN o_orderkey % 3 <> 0 AND k % 3 <> 0 AND o_orderkey % 3 <> k % 3 THEN 'dataset_hash,' ELSE '' END AS problems,
CASE WHEN o_orderstatus <> s THEN 'family,' ELSE '' END || CASE WHEN o_orderkey % 2 = k % 2 AND o_orderkey % 4 = k % 4 THEN 'identical_runs,' ELSE '' END || CASE WHEN o_orderkey % 11 = 0 OR k % 11 = 0 THEN 'adjustments,' ELSE '' END AS warnings FROM o WHERE k IS NOT NULL"""
)
def j14_comparable(spark: SparkSession, sf: str) -> DataFrame:
    """Each order of a customer and the next one, taken for runs."""
    from pyspark.sql import Window

    key = F.col("o_orderkey")
    run = F.struct(F.col("o_orderpriority").alias("dataset_version"), F.when(key % 3 == 0, "").otherwise((key % 3).cast("string")).alias("dataset_hash"), F.lit("t").alias("task"), F.col("o_orderstatus").alias("family"), F.lit("group").alias("split_strategy"), (key % 2).alias("seed"), (key % 4).cast("string").alias("config_hash"), F.when(key % 11 == 0, 1).otherwise(0).alias("n_adjustments"))
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", run.alias("l"))
    pairs = rows.withColumn("r", F.lead("l").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).filter("r is not null")
    said = pairs.select("o_orderkey", S.comparable(F.col("l"), F.col("r")).alias("c"))
    return said.select("o_orderkey", *[F.concat_ws("", F.transform(f"c.{k}", lambda x: F.concat(x, F.lit(",")))).alias(k) for k in ("problems", "warnings")])


@query(
    """WITH e AS (SELECT *, CAST(event_id AS VARCHAR) AS t FROM events)
SELECT event_id AS example_id, event_id % 7 <> 0 AS ok, event_id % 2 = 0 AS known, CASE WHEN event_id % 7 <> 0 THEN event_id % 5 = 0 END AS empty,
CASE WHEN event_id % 7 <> 0 AND event_id % 2 = 0 THEN event_id % 5 <> 0 AND event_id % 3 <> 0 END AS exact, CASE WHEN event_id % 7 <> 0 AND event_id % 2 = 0 THEN user_id % 3 = 0 END AS prompt_tokens_match, CASE WHEN event_id % 7 <> 0 AND event_id % 2 = 0 THEN true END AS completion_tokens_match, CASE WHEN event_id % 7 <> 0 AND event_id % 2 = 0 THEN event_id % 4 = 0 END AS decision_matches FROM e"""
)
def j15_replies(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("event_id")
    e = table(spark, sf, "events")
    fresh = e.select(key.alias("example_id"), (key % 7 != 0).alias("ok"), F.when(key % 5 == 0, " ").otherwise(F.concat(F.col("event_type"), F.when(key % 3 == 0, "!").otherwise(""))).alias("text"), (F.col("user_id") % 3).alias("prompt_tokens"), F.lit(None).cast("int").alias("completion_tokens"), F.when(key % 4 == 0, "a").alias("decision"))
    frozen = e.filter(key % 2 == 0).select(key.alias("example_id"), F.col("event_type").alias("response"), F.lit(0).alias("prompt_tokens"), F.lit(None).cast("int").alias("completion_tokens"), F.lit("a").alias("decision"))
    return S.replies_against(fresh, frozen).drop("first")


@query(
    "WITH t AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY 1), s AS (SELECT least(q, 100) AS n_tokens, CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE n END AS n_targets, q > 100 AS truncated, q > 150 AS tt, l_orderkey % 3 = 0 AS r FROM t) "
    "SELECT count(*) FILTER (n_targets > 0) AS examples_formatted, count(*) FILTER (n_targets = 0) AS dropped, count(*) FILTER (n_targets > 0 AND truncated) AS truncated, count(*) FILTER (n_targets > 0 AND tt) AS target_truncated, count(*) FILTER (r) AS reasoning_dropped, max(n_tokens) FILTER (n_targets > 0) AS max_tokens, round(avg(n_tokens) FILTER (n_targets > 0), 1) AS mean_tokens, round(avg(n_targets) FILTER (n_targets > 0), 1) AS mean_target_tokens FROM s"
)
def a22_sequence_stats(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("q"))
    rows = t.select(F.least("q", F.lit(100)).alias("n_tokens"), F.when(F.col("l_orderkey") % 5 == 0, 0).otherwise(F.col("n")).alias("n_targets"), (F.col("q") > 100).alias("truncated"), (F.col("q") > 150).alias("target_truncated"), (F.col("l_orderkey") % 3 == 0).alias("had_reasoning"))
    return S.sequence_stats(rows)


@query("SELECT p_brand, arg_min(p_partkey, (p_retailprice, p_partkey)) AS p_partkey, min(p_retailprice) AS p_retailprice, count(*) AS readings FROM part GROUP BY p_brand")
def a24_tightest(spark: SparkSession, sf: str) -> DataFrame:
    return S.tightest(table(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], "p_retailprice", "p_partkey")


@query("SELECT DISTINCT event_type AS perturbation_kind FROM events WHERE event_type <> 'click'")
def p12_unknown_kinds(spark: SparkSession, sf: str) -> DataFrame:
    kinds = table(spark, sf, "events").select(F.when(F.col("event_type") == "click", "schema").otherwise(F.col("event_type")).alias("perturbation_kind"))
    return S.unknown_kinds(kinds)


@query("SELECT 'run-' || replace(o_orderpriority, ' ', '_') || '-' || strftime(o_orderdate, '%Y%m%d-%H%M%S') || '-' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 8) AS experiment_id FROM orders")
def s29_run_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(S.run_id(F.lit("run"), F.col("o_orderpriority"), F.col("o_orderdate"), F.sha2(F.col("o_orderkey").cast("string"), 256)).alias("experiment_id"))


# replies and axes


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'queue_unavailable' WHEN 1 THEN 'quota_exhausted' WHEN 2 THEN 'queue_unavailable' WHEN 3 THEN 'quota_exhausted' ELSE 'model_error' END AS status FROM events")
def f36_error_status(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 5
    title = F.when(k <= 1, " ZeroGPU quota exceeded").when(k == 2, "ZeroGPU queue timeout")
    message = F.when(k == 0, "No GPU was available after 60s").when(k == 3, "You have exceeded your free quota").when(k == 4, "CUDA error")
    return table(spark, sf, "events").select("event_id", P.error_status(title, message).alias("status"))


@query("SELECT DISTINCT 200 + event_id % 310 AS code, CASE WHEN event_id % 310 < 100 THEN 'ready' ELSE coalesce({401: 'unauthorized', 413: 'invalid_request', 422: 'invalid_request', 500: 'model_error', 503: 'starting', 504: 'queue_unavailable'}[200 + event_id % 310], 'model_error') END AS status FROM events".replace("{401", "MAP {401"))
def f36_http_status(spark: SparkSession, sf: str) -> DataFrame:
    code = (F.col("event_id") % 310 + 200).cast("int")
    return table(spark, sf, "events").select(code.cast("long").alias("code"), P.http_status(code).alias("status")).distinct()


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 40 OR l_returnflag = 'R' THEN 'length' ELSE 'stop' END AS reason FROM lineitem")
def f36_finish_reason(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", P.finish_reason(F.col("l_quantity"), F.lit(40), F.when(F.col("l_returnflag") == "R", "length")).alias("reason"))


@query("SELECT event_id, event_id % 4 <> 0 AND event_id % 3 <> 2 AND (event_id % 3 = 1 OR event_id % 5 <> 0) AS keeps FROM events")
def p18_contract(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    status = F.when(k % 3 == 0, "ready").when(k % 3 == 1, "model_error").otherwise("unheard")
    reply = F.struct(F.when(k % 4 == 0, 9).otherwise(k % 4 % 2 + 1).alias("contract_version"), status.alias("status"), (k % 3 == 0).alias("ok"), F.when(k % 5 != 0, "text").alias("text"))
    return table(spark, sf, "events").select("event_id", P.keeps_contract(reply).alias("keeps"))


@query("SELECT conv_id, CASE WHEN bool_and(role IN ('system', 'user', 'assistant')) THEN count(*) END AS n FROM conversations GROUP BY conv_id")
def f55_api_messages(spark: SparkSession, sf: str) -> DataFrame:
    m = P.api_messages(F.col("messages"))
    return bindings.conversations(spark, sf).select("conv_id", F.when(m.isNotNull(), F.size(m)).cast("long").alias("n"))


@query("SELECT doc_id AS id, CASE WHEN lang IS NULL THEN 'format' ELSE 'domain,format' END AS known, CASE WHEN source IS NULL THEN '' ELSE 'shelf' END AS unknown FROM documents")
def f16_axes(spark: SparkSession, sf: str) -> DataFrame:
    axes = F.col("axes")
    names = lambda m: F.array_join(F.array_sort(F.map_keys(m)), ",")
    return bindings.examples(spark, sf).select("id", names(C.known_axes(axes, Q.AXES)).alias("known"), names(C.unknown_axes(axes, Q.AXES)).alias("unknown"))


# datasets as JSON lines


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as lines of a dataset: every seventh has a field too many, every eleventh a bad id, every thirteenth is torn."""
    k = F.col("conv_id")
    axes = F.create_map(F.lit("domain"), F.lit("career"))
    row = F.struct(F.when(k % 11 == 0, F.lit("-")).otherwise(F.concat(F.lit("conv-"), k.cast("string"))).alias("id"), F.lit("1.1").alias("version"), F.lit("tool_routing").alias("task"), F.lit("career").alias("domain"), "messages", axes.alias("variation_axes"), F.when(k % 7 == 0, 1).alias("surplus"))
    line = F.to_json(row)
    return bindings.conversations(spark, sf).select(F.lit("conversations").alias("file"), k.alias("line"), F.when(k % 13 == 0, F.substring(line, 1, 40)).otherwise(line).alias("value"))


_SHAPE = """WITH m AS (SELECT *, lag(role) OVER w AS before, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, min(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS fa, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS fu FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
c AS (SELECT conv_id, max(n) AS n, max(fa) AS fa, max(fu) AS fu, max_by(role, turn) AS l, bool_or(role = 'system' AND i > 1) AS s, bool_or(role = 'assistant' AND before = 'assistant') AS t, bool_or(trim(text) = '') AS e FROM m GROUP BY conv_id),
j AS (SELECT conv_id, CASE WHEN conv_id % 13 = 0 THEN 1 ELSE (conv_id % 7 = 0)::INT + (conv_id % 11 = 0)::INT + (n < 2)::INT + (fa IS NULL)::INT + (fa IS NOT NULL AND l <> 'assistant')::INT + s::INT + (fa IS NOT NULL AND (fu IS NULL OR fu > fa))::INT + t::INT + e::INT END AS errors FROM c)"""


@query(_SHAPE + " SELECT 'conv-' || conv_id AS id FROM j WHERE errors = 0")
def s02_load_examples(spark: SparkSession, sf: str) -> DataFrame:
    return jsonl.judge_lines(_lines(spark, sf))[0].select("id")


@query(_SHAPE + " SELECT conv_id AS line, errors AS n FROM j WHERE errors > 0")
def s02_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return jsonl.judge_lines(_lines(spark, sf))[1].select("line", F.size("errors").cast("long").alias("n"))


@query(_SHAPE + " SELECT 'conv-' || conv_id AS id FROM j WHERE errors = 0 ORDER BY conv_id LIMIT 50")
def s03_first_examples(spark: SparkSession, sf: str) -> DataFrame:
    return jsonl.head(jsonl.judge_lines(_lines(spark, sf))[0], 50).select("id")


@query("""SELECT conv_id, '{"conv_id":' || conv_id || ',"name":null,"role":"' || role || '","turn":' || turn || '}' AS line FROM conversations""")
def s04_json_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("turn", "role", F.lit(None).cast("string").alias("name"), "conv_id")
    return rows.select("conv_id", jsonl.json_line(rows.schema).alias("line"))


@query("SELECT event_id % 3 AS experiment_id, event_type AS event, count(*) AS n, sum(event_id % 5)::BIGINT AS extra FROM events GROUP BY ALL")
def s12_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as lines with a field beyond the schema, and torn lines between them."""
    k = F.col("event_id")
    line = F.to_json(F.struct((k % 3).cast("string").alias("experiment_id"), F.col("event_type").alias("event"), (k % 5).alias("extra")))
    lines = table(spark, sf, "events").select(F.explode(F.array(line, F.substring(line, 1, 9))).alias("value"))
    e = jsonl.parse_events(lines)
    return e.groupBy(F.col("experiment_id").cast("long").alias("experiment_id"), "event").agg(F.count(F.lit(1)).alias("n"), F.sum(F.variant_get("fields", "$.extra", "long")).alias("extra"))


@query("SELECT user_id % 4 AS seed, CAST(event_id % 100 AS VARCHAR) AS example_id, max(event_id) AS last FROM events GROUP BY ALL")
def s14_partial_log(spark: SparkSession, sf: str) -> DataFrame:
    """Of records of one seed and example the last one wins."""
    e = table(spark, sf, "events").select((F.col("user_id") % 4).cast("int").alias("seed"), (F.col("event_id") % 100).cast("string").alias("example_id"), F.col("event_id").cast("string").alias("text"), F.col("event_id").alias("at"))
    return jsonl.last_records(e).select(F.col("seed").cast("long").alias("seed"), "example_id", F.col("text").cast("long").alias("last"))


@query("SELECT sum(event_id % 9 <> 0)::BIGINT + 0 AS parsed, sum(event_id % 9 = 0)::BIGINT AS failed FROM (SELECT (event_id % 9) AS r, event_id FROM events)".replace("sum(event_id % 9 <> 0)", "sum((event_id % 9 <> 0)::INT)").replace("sum(event_id % 9 = 0)", "sum((event_id % 9 = 0)::INT)"))
def a28_load_report(spark: SparkSession, sf: str) -> DataFrame:
    line = F.to_json(F.struct("event_id", "event_type"))
    lines = table(spark, sf, "events").select(F.lit("f").alias("file"), F.explode(F.array(F.when(F.col("event_id") % 9 == 0, F.lit("[1]")).otherwise(line), F.lit("  "))).alias("value"))
    return jsonl.report_lines(lines).select("parsed", "failed")


# splits


@query(f"WITH d AS (SELECT doc_id, {rank_sql('source', 42)} AS r FROM documents) SELECT doc_id AS id FROM d WHERE r >= 0.7::DOUBLE AND r < 0.7::DOUBLE + 0.15::DOUBLE")
def p17_named_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("group_id"))
    return D.named(D.split_rows(rows, D.SplitConfig("group")), "validation").select("id")


def _strategy(name: str) -> D.SplitConfig:
    return D.SplitConfig(name, seed=7)


_RANK7 = rank_sql("CAST(doc_id AS VARCHAR)", 7)


@query(
    f"""WITH d AS (SELECT doc_id, source, lang, {_RANK7} AS r, {rank_sql("source", 7)} AS g FROM documents), q AS (SELECT *, row_number() OVER (ORDER BY sha256('7:' || doc_id), doc_id) - 1 AS i, count(*) OVER () AS n FROM d)
SELECT 'group' AS strategy, CASE WHEN g < 0.7::DOUBLE THEN 'train' WHEN g < 0.7::DOUBLE + 0.15::DOUBLE THEN 'validation' ELSE 'test' END AS split, count(*) AS n FROM d GROUP BY ALL
UNION ALL SELECT 'random', CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train' WHEN i < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'validation' ELSE 'test' END, count(*) FROM q GROUP BY ALL
UNION ALL SELECT 'scenario_family_holdout', CASE WHEN g < 0.7::DOUBLE THEN 'train' WHEN g < 0.7::DOUBLE + 0.15::DOUBLE THEN 'validation' ELSE 'test' END, count(*) FROM d GROUP BY ALL"""
)
def d04_strategies(spark: SparkSession, sf: str) -> DataFrame:
    """Rows a split by the dispatcher over strategies."""
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("family"))
    out = None
    for name in ("group", "random", "scenario_family_holdout"):
        n = D.split_rows(rows, _strategy(name)).groupBy("split").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("strategy"), "split", "n")
        out = n if out is None else out.union(n)
    return out


@query("SELECT (SELECT count(*) FROM documents WHERE doc_id % 50 = 0) AS ids_apart, (SELECT count(*) FROM (SELECT source FROM documents GROUP BY source HAVING count(DISTINCT doc_id % 2) > 1 OR bool_or(doc_id % 50 = 0))) AS groups_apart, (SELECT count(*) FROM documents) + (SELECT count(*) FROM documents WHERE doc_id % 50 = 0) AS n")
def j07_violations(spark: SparkSession, sf: str) -> DataFrame:
    """A bad split on purpose: by parity of the id, and every fiftieth id in both."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("group_id"))
    bad = d.withColumn("split", F.when(F.col("id") % 2 == 0, "train").otherwise("test"))
    return D.violations(bad.union(d.filter("id % 50 = 0").withColumn("split", F.lit("test"))), F.col("group_id"))


# verdicts


@query(compare_sql("round(base, 6) AS base, round(tuned, 6) AS tuned, round(tuned - base, 6) AS delta, overall, coalesce(task, '') AS task, n, clusters, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, p_value, verdict, prim AS \"primary\""))
def r06_compare(spark: SparkSession, sf: str) -> DataFrame:
    out = B.compare(_arms(spark, sf))
    return out.select(F.coalesce("task", F.lit("")).alias("task"), "overall", "n", "clusters", *six("base", "tuned", "delta", "ci_low", "ci_high"), "p_value", "verdict", "primary")


@query(compare_sql("CASE WHEN bool_or(verdict LIKE 'improved%') AND bool_or(verdict LIKE 'regressed%') THEN 'mixed' WHEN bool_or(verdict LIKE 'regressed%') THEN 'regressed' WHEN bool_or(verdict LIKE 'improved%') THEN 'improved' ELSE 'none' END AS conclusion, bool_or(verdict LIKE 'regressed%') AS regressed"))
def r08_conclusion(spark: SparkSession, sf: str) -> DataFrame:
    return B.conclusion(B.compare(_arms(spark, sf)))


@query(f"WITH {RECORDS}, d AS (SELECT example_id, tuned - base AS d FROM rec) SELECT example_id, CASE WHEN abs(d) < 0.01 THEN 'no change' WHEN d > 0 THEN 'improved' ELSE 'regressed' END || CASE WHEN abs(d) >= 0.01 AND example_id % 2 = 0 THEN ' (not significant)' ELSE '' END AS verdict FROM d WHERE abs(abs(d) - 0.01) > 1e-9")
def r04_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    d = _arms(spark, sf).withColumn("d", F.col("tuned") - F.col("base")).filter(F.abs(F.abs("d") - 0.01) > 1e-9)
    return d.select("example_id", B.verdict(F.col("d"), F.when(F.col("example_id") % 2 == 0, False)).alias("verdict"))


@query("WITH p AS (SELECT p_partkey, (p_partkey % 201 - 100) / 1000.0 AS low, (p_partkey % 201 - 100) / 1000.0 + p_partkey % 37 / 1000.0 AS high FROM part) SELECT p_partkey, CASE WHEN round(low, 4) > 0 THEN 'better' WHEN round(high, 4) < 0 THEN 'worse' WHEN round(low, 4) >= -0.02 AND round(high, 4) <= 0.02 THEN 'equivalent' ELSE 'inconclusive' END AS verdict FROM p")
def r05_primary(spark: SparkSession, sf: str) -> DataFrame:
    low = (F.col("p_partkey") % 201 - 100) / 1000.0
    high = low + F.col("p_partkey") % 37 / 1000.0
    return table(spark, sf, "part").select("p_partkey", B.primary_verdict(low, high, 0.02).alias("verdict"))
