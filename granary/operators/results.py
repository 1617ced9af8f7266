"""Saved results of evaluations: payloads as tables and back, decisions of answers, coverage and comparability of two runs, statistics of training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_difference
from ..sources import schemas

#: Version of the payload's shape.
RESULTS_VERSION = "1.0"
#: Characters of an answer that stand for its decision where nothing was extracted.
DECISION_CHARS = 200
# Kinds of perturbation that are registered.
PERTURBATIONS = ("paraphrase", "evidence_order", "context_order", "irrelevant_context", "formatting", "schema", "length")


def payload_rows(payloads: DataFrame, value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """A row a result of payloads (JSON objects with arm, example_count and results[]): the columns `keep`, arm, and the fields of a graded record. A payload that is not such an object raises."""
    shape = f"arm string, schema_version string, example_count bigint, results array<struct<{schemas.RECORD_FIELDS}>>"
    parsed = payloads.select(*keep, F.from_json(value, shape).alias("p"), F.col(value).alias("_v"))
    bad = F.raise_error(F.concat(F.lit("not a results payload: "), F.left("_v", F.lit(80))))
    checked = parsed.withColumn("p", F.when(F.col("p.results").isNull(), bad.cast(parsed.schema["p"].dataType)).otherwise(F.col("p")))
    return checked.select(*keep, F.col("p.arm").alias("_arm"), F.inline("p.results")).withColumn("arm", F.coalesce("arm", "_arm")).drop("_arm")


def load_results(spark: SparkSession, pattern: str) -> DataFrame:
    """payload_rows() of files of one payload each, with the file's path."""
    files = spark.read.option("wholetext", True).text(pattern).select("value", F.col("_metadata.file_path").alias("file"))
    return payload_rows(files, keep=["file"])


def save_results(records: DataFrame, path: str, responses: bool = True) -> None:
    """The records as a table of JSON lines, one folder an arm; without responses the answers and their reasoning are left out. The folder must not exist. A payload of one nested object is what
    payloads() makes of it."""
    out = records if responses else records.drop("response", "reasoning")
    out.write.mode("errorifexists").partitionBy("arm").json(path)


def payloads(records: DataFrame, responses: bool = True) -> DataFrame:
    """arm, value: each arm's records as one payload, ordered by id. A payload is one value, so an arm must be small enough to be one: save_results() is for the others."""
    own = records if responses else records.drop("response", "reasoning")
    rows = own.groupBy("arm").agg(F.array_sort(F.collect_list(F.struct(F.col("example_id").alias("example_id"), *[c for c in own.columns if c not in ("arm", "example_id")]))).alias("results"))
    head = F.struct(F.lit(RESULTS_VERSION).alias("schema_version"), "arm", F.size("results").alias("example_count"), "results")
    return rows.select("arm", F.to_json(head).alias("value"))


def scores_for(records: DataFrame, split_tag: str | None = None, task: str | None = None) -> DataFrame:
    """Scores of the records of a split and task, where given."""
    for column, value in (("split_tag", split_tag), ("task", task)):
        if value is not None:
            records = records.filter(F.col(column) == value)
    return records.select("score")


def decision(label: Column, ranking: Column, items: Column, response: Column) -> Column:
    """What stands for an answer when answers are compared: its label, else its ranking or items as a JSON list, else its first characters."""
    listed = lambda c: F.when(F.size(c) > 0, F.to_json(c))
    return F.coalesce(F.nullif(label, F.lit("")), listed(ranking), listed(items), F.substring(F.regexp_replace(response, r"(?U)\A\s+|\s+\z", ""), 1, DECISION_CHARS))


def reference_decision(reference: Column) -> Column:
    """The same of a reference (struct of label, expected_decision, text, ranking): the first that is there; null if none is."""
    return F.coalesce(reference["label"], reference["expected_decision"], reference["text"], F.to_json(reference["ranking"]))


def coverage(left: DataFrame, right: DataFrame, by: str = "task") -> DataFrame:
    """For each value of `by` in either run: ids on the left, on the right, and on both; covered is false where an id is missing on one side. Ids that occur several times count once."""
    ids = lambda rows, side: rows.select(by, "example_id").distinct().withColumn(side, F.lit(1))
    both = ids(left, "l").join(ids(right, "r"), [by, "example_id"], "full")
    out = both.groupBy(by).agg(F.count("l").alias("n_left"), F.count("r").alias("n_right"), F.count(F.col("l") + F.col("r")).alias("n_both"))
    return out.withColumn("covered", (F.col("n_left") == F.col("n_both")) & (F.col("n_right") == F.col("n_both")))


def comparable(left: Column, right: Column, same_dataset: bool = True, same_task: bool = True, across_families: bool = True) -> Column:
    """Struct of problems and warnings (arrays of codes) of two runs: structs of dataset_version, dataset_hash, task, family, split_strategy, seed, config_hash, n_adjustments."""
    differ = lambda c: ~left[c].eqNullSafe(right[c])
    code = lambda bad, name: F.when(F.coalesce(bad, F.lit(False)), F.lit(name))
    hashes = (left["dataset_hash"] != "") & (right["dataset_hash"] != "") & (left["dataset_hash"] != right["dataset_hash"])
    problems = [code(differ("dataset_version") & F.lit(same_dataset), "dataset_version"), code(hashes, "dataset_hash"), code(differ("task") & F.lit(same_task), "task"), code(differ("family") & F.lit(not across_families), "family")]
    warnings = [
        code(differ("family") & F.lit(across_families), "family"),
        code(differ("split_strategy"), "split_strategy"),
        code(~differ("seed") & ~differ("config_hash"), "identical_runs"),
        code((left["n_adjustments"] > 0) | (right["n_adjustments"] > 0), "adjustments"),
    ]
    known = lambda codes: F.filter(F.array(*codes), lambda x: x.isNotNull())
    return F.struct(known(problems).alias("problems"), known(warnings).alias("warnings"))


def sequence_stats(rows: DataFrame) -> DataFrame:
    """rows: n_tokens, n_targets (0: nothing to learn from), truncated, target_truncated, had_reasoning. One row: examples_formatted, dropped, truncated, target_truncated, reasoning_dropped, max_tokens,
    mean_tokens, mean_target_tokens (of what is not dropped; one place). No rows give zeros."""
    used = F.col("n_targets") > 0
    mean = lambda c: F.coalesce(F.round(F.avg(F.when(used, F.col(c))), 1), F.lit(0.0))
    return rows.agg(
        F.count_if(used).alias("examples_formatted"), F.count_if(~used).alias("dropped"), F.count_if(used & F.col("truncated")).alias("truncated"), F.count_if(used & F.col("target_truncated")).alias("target_truncated"),
        F.count_if(F.col("had_reasoning")).alias("reasoning_dropped"), F.coalesce(F.max(F.when(used, F.col("n_tokens"))), F.lit(0)).alias("max_tokens"), mean("n_tokens").alias("mean_tokens"), mean("n_targets").alias("mean_target_tokens"),
    )


def tightest(readings: DataFrame, by: Sequence[str], spare: str, order: str) -> DataFrame:
    """Of each group the reading with the least to spare, of equal ones the first, and the number of readings."""
    return readings.groupBy(*by).agg(F.min_by(F.struct(*[c for c in readings.columns if c not in by]), F.struct(spare, order)).alias("_r"), F.count(F.lit(1)).alias("readings")).select(*by, "_r.*", "readings")


def unknown_kinds(rows: DataFrame, kind: str = "perturbation_kind", registered: Sequence[str] = PERTURBATIONS) -> DataFrame:
    """Kinds that are not registered, each once."""
    return rows.filter((F.col(kind) != "") & ~F.col(kind).isin(*registered)).select(kind).distinct()


def replies_against(replies: DataFrame, frozen: DataFrame) -> DataFrame:
    """Fresh replies (example_id, ok, text, prompt_tokens, completion_tokens, decision) beside frozen records: known, empty, exact, first (first difference), prompt_tokens_match, completion_tokens_match, decision_matches;
    nulls where the reply is not ok or there is no record."""
    f = frozen.select("example_id", F.lit(True).alias("_known"), F.coalesce("response", F.lit("")).alias("_text"), F.col("prompt_tokens").alias("_p"), F.col("completion_tokens").alias("_c"), F.col("decision").alias("_d"))
    both = replies.join(f, "example_id", "left")
    judged = F.col("ok") & F.col("_known")
    text = F.coalesce("text", F.lit(""))
    when = lambda c: F.when(judged, c)
    return both.select(
        "example_id", "ok", F.coalesce("_known", F.lit(False)).alias("known"), F.when(F.col("ok"), F.trim(text) == "").alias("empty"), when(text == F.col("_text")).alias("exact"), when(first_difference(F.col("_text"), text)).alias("first"),
        when(F.col("prompt_tokens").eqNullSafe(F.col("_p"))).alias("prompt_tokens_match"), when(F.col("completion_tokens").eqNullSafe(F.col("_c"))).alias("completion_tokens_match"), when(F.col("decision").eqNullSafe(F.col("_d"))).alias("decision_matches"),
    )


def run_id(name: Column, model: Column, at: Column, config_hash: Column) -> Column:
    """name-model-UTC stamp-hash8 with spaces and slashes replaced; a null model is left out."""
    parts = [name, model, F.date_format(at, "yyyyMMdd-HHmmss"), F.substring(config_hash, 1, 8)]
    return F.concat_ws("-", *[F.translate(p, " /", "__") for p in parts])
