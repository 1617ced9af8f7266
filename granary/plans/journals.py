"""Queries of numbered lines, partial logs, streams, bundles, benchmarks and batches over what is made of the driver's tables, with their SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import batching, benchmarks
from ..sources import jsonl, partial
from ..sources.scratch import shared_path
from ..streaming import alarms, resume
from . import bindings
from .bindings import table
from .catalog import query
from .results import _SHAPE, _lines

FILES = 5
ME = {"arm": "tuned", "seeds": [0, 1, 2, 3], "model": {"name": "m"}, "libraries": {"a": "1"}}


def _written(rows: DataFrame, name: str) -> str:
    """rows: file (a small number), k (order in the file), value. A folder of text files, one for each number."""
    path = shared_path(rows.sparkSession, name)
    rows.repartition("file").sortWithinPartitions("file", "k").select("file", "value").write.partitionBy("file").text(path)
    return path


def _number(file: str = "file"):
    return F.regexp_extract(file, r"file=(\d+)/", 1).cast("long")


@query(
    f"""WITH l AS (SELECT event_id % {FILES} AS file, event_id, unnest(CASE WHEN user_id % 3 = 0 THEN [0, 1] WHEN user_id % 3 = 1 THEN [0] ELSE [0, 1, 2] END) AS j, event_type AS t FROM events),
n AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY event_id, j) AS line, event_id, j, t FROM l) SELECT file, line, t || ' ' || event_id AS value FROM n WHERE j = 0"""
)
def s01_line_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Events as lines of five files with blank lines between them, read back by number."""
    e = table(spark, sf, "events")
    some = F.when(F.col("user_id") % 3 == 0, F.array(F.lit(""))).when(F.col("user_id") % 3 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit(" "), F.lit("")))
    text = F.concat(F.array(F.concat_ws(" ", "event_type", "event_id")), some)
    rows = e.select((F.col("event_id") % FILES).alias("file"), "event_id", F.posexplode(text).alias("j", "value")).select("file", F.struct("event_id", "j").alias("k"), "value")
    return jsonl.scan_lines(spark, _written(rows, "lines")).select(_number().alias("file"), "line", "value")


@query(_SHAPE + f", n AS (SELECT conv_id % {FILES} AS file, 2 * row_number() OVER (PARTITION BY conv_id % {FILES} ORDER BY conv_id) - 1 AS line, conv_id, errors FROM j) SELECT file, line, CASE WHEN conv_id % 13 = 0 THEN NULL WHEN conv_id % 11 = 0 THEN '-' ELSE 'conv-' || conv_id END AS id, errors AS n FROM n WHERE errors > 0")
def s02_reject_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Rejected conversations of five JSON-lines files by file and line; every other line is blank."""
    lines = _lines(spark, sf)
    rows = lines.select((F.col("line") % FILES).alias("file"), "line", F.posexplode(F.array("value", F.lit("\t"))).alias("j", "value")).select("file", F.struct("line", "j").alias("k"), "value")
    return jsonl.load_examples(spark, _written(rows, "examples"))[1].select(_number().alias("file"), "line", "id", F.size("errors").cast("long").alias("n"))


def _logs(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events as the log of a run: by user_id % 8 it is fine (0, 7), torn (1), of another identity (2), damaged (3), of another kind (4), without a readable header (5), or broken off in its header (6)."""
    e, u = table(spark, sf, "events"), F.col("user_id") % 8
    heads = {0: partial.header(ME), 2: partial.header(ME | {"arm": "base", "extra": [1]}), 4: partial.header(ME, kind="another"), 5: "{"}
    head = F.when(u == 2, heads[2]).when(u == 4, heads[4]).when(u == 5, heads[5]).otherwise(heads[0])
    said = F.to_json(F.struct((F.col("event_id") % 4).alias("seed"), (F.col("event_id") % 10).cast("string").alias("example_id"), F.col("event_id").cast("string").alias("text")))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    body = e.select(F.col("user_id").alias("file"), (place + 1).cast("long").alias("line"), F.when((u == 3) & (place % 50 == 7), F.substring(said, 1, 9)).otherwise(said).alias("value"), F.lit(True).alias("ended"))
    top = e.select("user_id").distinct().select(F.col("user_id").alias("file"), F.lit(1).cast("long").alias("line"), head.alias("value"), (u != 6).alias("ended"))
    last = body.groupBy("file").agg(F.max("line").alias("line")).filter(F.col("file") % 8 == 1).select("file", F.col("line") + 1, F.lit('{"seed": 1, "exam').alias("value"), F.lit(False).alias("ended"))
    return top.unionByName(body.filter(F.col("file") % 8 != 6)).union(last)


@query(
    """WITH e AS (SELECT user_id, user_id % 8 AS u, count(*) AS n FROM events GROUP BY user_id)
SELECT user_id AS file, CASE WHEN u = 6 THEN 'no_header' WHEN u = 5 THEN 'unreadable_header' WHEN u = 4 THEN 'not_a_log' WHEN u = 2 THEN 'other_identity' WHEN u = 3 AND n >= 7 THEN 'damaged' ELSE 'ok' END AS verdict,
CASE WHEN u = 3 AND n >= 7 THEN 8 END::BIGINT AS line, CASE WHEN u = 2 THEN 'arm,extra' ELSE '' END AS differs_in, u = 1 OR u = 6 AS torn, CASE WHEN u = 6 THEN 0 ELSE n END AS records FROM e"""
)
def s13_log_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """What stands against going on with each log."""
    return partial.judge(_logs(spark, sf), ME).withColumn("differs_in", F.concat_ws(",", "differs_in"))


@query(
    "SELECT user_id AS file, (event_id % 4)::INT AS seed, CAST(event_id % 10 AS VARCHAR) AS example_id, CAST(max(event_id) AS VARCHAR) AS text FROM events WHERE user_id % 8 IN (0, 1, 7) OR user_id % 8 = 3 AND user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) < 7) GROUP BY ALL"
)
def s14_damaged_logs(spark: SparkSession, sf: str) -> DataFrame:
    """The last record of each key of the logs that may be gone on with."""
    lines = _logs(spark, sf)
    return partial.records(lines, partial.judge(lines, ME)).select("file", "seed", "example_id", "text")


@query("SELECT (user_id % 4)::INT AS seed, CAST(event_id % 100 AS VARCHAR) AS example_id, arg_max(CAST(event_id AS VARCHAR), (event_id % 3, event_id * 7919 % 10007, event_id)) AS text, count(*) AS given FROM events GROUP BY ALL")
def t01_resumed_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as generations that come in three files; the stream is stopped after each, once between a batch's write and its commit."""
    e = table(spark, sf, "events")
    line = F.to_json(F.struct((F.col("user_id") % 4).alias("seed"), (F.col("event_id") % 100).cast("string").alias("example_id"), F.col("event_id").cast("string").alias("text")))
    rows = e.select((F.col("event_id") % 3).alias("file"), F.struct(F.col("event_id") * 7919 % 10007, "event_id").alias("k"), line.alias("value"))
    came, log, checkpoint = (shared_path(spark, n) for n in ("generations", "log", "checkpoint"))

    class Stopped(Exception):
        pass

    def stop(number: int) -> None:
        raise Stopped

    for k in range(3):
        part = rows.filter(F.col("file") == k)
        part.repartition(1).sortWithinPartitions("k").select("value").write.mode("append").text(came)
        stream = resume.generation_lines(spark, came)
        if k == 1:
            try:
                resume.record(stream, log, ME, checkpoint, on_batch=stop).awaitTermination()
            except Exception as e:
                if "Stopped" not in str(e):
                    raise
        resume.record(stream, log, ME, checkpoint).awaitTermination()
    return resume.recorded(spark, log, ME).select("seed", "example_id", "text", "given")


@query(
    """WITH p AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE value > 150)
SELECT CAST(user_id AS VARCHAR) AS experiment_id, event_id AS step, value AS peak FROM p WHERE i = 1"""
)
def t03_stream_alarm(spark: SparkSession, sf: str) -> DataFrame:
    """Events as steps of runs that come as they happen: each user's first value over 150, found by a stream that is stopped and goes on."""
    steps = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("experiment_id"), F.col("event_id").alias("step"), F.col("value").alias("memory"))
    came, out, checkpoint = (shared_path(spark, n) for n in ("steps", "alarms", "checkpoint"))
    schema = steps.schema
    n = steps.agg(F.max("step")).first()[0] or 0
    for k in range(3):
        third = (n + 3) // 3
        steps.filter((F.col("step") >= k * third) & (F.col("step") < (k + 1) * third)).write.mode("append").parquet(came)
        found = alarms.memory_alarms(spark.readStream.schema(schema).parquet(came), 150.0)
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("experiment_id string, step long, peak double").parquet(out)


# datasets, benchmarks and batches


@query(_SHAPE + " SELECT CASE conv_id % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split, count(*) FILTER (errors = 0) AS n, count(*) FILTER (errors > 0) AS rejected FROM j GROUP BY 1")
def s06_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as three split files, loaded as a bundle; good rows and rejects of each split."""
    lines = _lines(spark, sf).withColumn("split", F.when(F.col("line") % 4 == 0, "test").when(F.col("line") % 4 == 1, "validation").otherwise("train"))
    paths = {s: shared_path(spark, s) for s in jsonl.SPLITS}
    for s, path in paths.items():
        lines.filter(F.col("split") == s).select("value").write.text(path)
    b = jsonl.load_bundle(spark, paths, strict=False, filters=jsonl.Filters(tasks=["tool_routing"], allow_unreviewed=True))
    both = b.rows.select("split", F.lit(1).alias("n"), F.lit(0).alias("rejected")).union(b.rejects.select("split", F.lit(0), F.lit(1)))
    return both.groupBy("split").agg(F.sum("n").alias("n"), F.sum("rejected").alias("rejected"))


def _answered(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations that end with an answer as JSON; every eleventh is torn, every thirteenth has no ranking."""
    k = F.col("conv_id")
    text = F.concat(
        F.lit('{"ranking":['), k % 7, F.lit(',"b'), k % 3, F.lit('"],"'), F.when(k % 5 == 0, "label").otherwise("deciding_factor"), F.lit('":"f'), k % 4, F.lit('","confident":'), F.when(k % 3 == 0, "true").when(k % 3 == 1, '"yes"').otherwise("false"),
        F.lit(',"next_step":'), F.when(k % 2 == 0, '"go"').otherwise("5"), F.lit(',"mood":'), k, F.lit("}"),
    )
    said = F.when(k % 11 == 0, '{"ranking": [').when(k % 13 == 0, '{"label": "x"}').otherwise(text)
    nothing = F.lit(None).cast("string")
    last = F.struct(F.lit("assistant").alias("role"), said.alias("content"), nothing.alias("name"), nothing.alias("reasoning"))
    return bindings.conversations(spark, sf).select(k.alias("id"), F.lit("tool_routing").alias("task"), F.concat("messages", F.array(last)).alias("messages"))


@query(
    """WITH c AS (SELECT conv_id AS id, count(*) AS prompt FROM conversations GROUP BY conv_id HAVING conv_id % 11 <> 0 AND conv_id % 13 <> 0)
SELECT id, prompt, (id % 7) || ',b' || (id % 3) AS ranking, 'f' || (id % 4) AS label, CASE id % 3 WHEN 0 THEN true WHEN 2 THEN false END AS confident, CASE WHEN id % 2 = 0 THEN 'go' END AS next_step, (SELECT string_agg(DISTINCT 'f' || (id % 4), ',' ORDER BY 'f' || (id % 4)) FROM c) AS options, id AS mood FROM c"""
)
def s26_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    """References read out of answers: kinds are not converted, keys that are not known are kept."""
    rows = benchmarks.build(_answered(spark, sf), "policy")[0]
    r = lambda c: F.col(f"reference.{c}")
    joined = lambda c: F.array_join(r(c), ",").alias(c)
    return rows.select("id", F.size("messages").cast("long").alias("prompt"), joined("ranking"), r("label").alias("label"), r("confident").alias("confident"), r("next_step").alias("next_step"), joined("options"), F.variant_get(r("answer"), "$.mood", "long").alias("mood"))


@query("SELECT DISTINCT conv_id AS id, CASE WHEN conv_id % 11 = 0 THEN 'not_json' ELSE 'no_ranking' END AS problem FROM conversations WHERE conv_id % 11 = 0 OR conv_id % 13 = 0")
def s26_without_reference(spark: SparkSession, sf: str) -> DataFrame:
    return benchmarks.build(_answered(spark, sf), "policy")[1]


def _added_up(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A backend that says the sum of the ids that the mask shows, their number, and the least and greatest length of its batch."""
    ids, mask = (np.stack([x.values.to_numpy() for x in batch.column(c)]) for c in ("ids", "attention_mask"))
    n = len(ids)
    return pa.RecordBatch.from_arrays([pa.array((ids.astype(np.int64) * mask).sum(axis=1)), pa.array(mask.sum(axis=1, dtype=np.int64)), pa.array([ids.shape[1]] * n, pa.int64())], ["total", "n", "width"])


@query("SELECT l_orderkey AS example_id, sum(l_partkey)::BIGINT AS total, count(*) AS n, (8 * ceil(count(*) / 8))::BIGINT AS width, (8 * ceil(count(*) / 8))::INT AS padded FROM lineitem GROUP BY l_orderkey")
def x02_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as requests whose ids are their parts, handed to a backend in batches of one padded length."""
    requests = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("example_id")).agg(F.collect_list(F.col("l_partkey").cast("int")).alias("ids"))
    return batching.generate_batches(requests, _added_up, "total long, n long, width long", ["example_id"])


@query(_SHAPE + " SELECT 'v2' AS version, count(*) FILTER (errors = 0) AS example_count, count(*) FILTER (errors > 0) AS rejected, 'tool_routing=' || count(*) FILTER (errors = 0) AS tasks, 'career=' || count(*) FILTER (errors = 0) AS domains FROM j")
def s17_prepared(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations prepared as a versioned dataset, by its manifest."""
    raw, target = shared_path(spark, "raw"), shared_path(spark, "prepared")
    _lines(spark, sf).select("value").write.text(raw)
    m = jsonl.prepare(spark, raw, target, "v2")
    shown = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return m.select("version", "example_count", "rejected", shown("task_distribution").alias("tasks"), shown("domain_distribution").alias("domains"))


@query("SELECT event_type AS event, CAST(user_id % 5 AS VARCHAR) AS experiment_id, count(*) AS n, sum(event_id)::BIGINT AS steps, true AS stamped FROM events GROUP BY ALL")
def s11_emitted_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events appended in two goes and read back with their times and the fields beyond the schema."""
    path = shared_path(spark, "events")
    e = table(spark, sf, "events").select((F.col("user_id") % 5).cast("string").alias("experiment_id"), F.col("event_type").alias("event"), F.col("event_id").alias("step"))
    for k in range(2):
        jsonl.emit_events(e.filter(F.col("step") % 2 == k), path)
    back = jsonl.read_events(spark, path)
    stamped = F.bool_and((F.col("ts") > 0) & F.col("iso_time").isNotNull())
    return back.groupBy("event", "experiment_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.variant_get("fields", "$.step", "long")).alias("steps"), stamped.alias("stamped"))


@query("SELECT o_orderpriority AS version, count(*) AS example_count, count(*) > 0 AS there FROM orders GROUP BY 1")
def s20_manifests(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest a priority of orders, found in its folder beside files that are none."""
    root = shared_path(spark, "registry")
    made = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("version")).agg(F.max("o_orderdate").cast("string").alias("created_at"), F.count(F.lit(1)).alias("example_count"))
    named = made.withColumn("folder", F.md5("version"))
    named.repartition("folder").write.partitionBy("folder").json(root)
    named.select("folder", F.lit("{ torn").alias("value")).write.mode("append").partitionBy("folder").text(root)
    found = jsonl.load_manifests(spark, f"{root}/*/*")
    return found.select("version", "example_count", (F.col("created_at") != "").alias("there"))
