"""Runs, benchmarks and identities: joins of results to what they were made from, fingerprints, gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .orderstats import tree_hash

def annotate(records: DataFrame, benchmark: DataFrame, strict: bool = True) -> DataFrame:
    """Records with group_id and subset of their benchmark row. Strict: a record without one, or of another task, raises."""
    index = benchmark.select(F.col("id").alias("example_id"), F.col("task").alias("_task"), F.col("group_id").alias("_group"), F.col("subset").alias("_subset"), F.lit(True).alias("_known"))
    out = records.join(index, "example_id", "left")
    if strict:
        bad = out.agg(F.count_if(F.col("_known").isNull()).alias("lost"), F.count_if(F.col("_task") != F.col("task")).alias("other")).first()
        if bad.lost or bad.other:
            raise ValueError(f"{bad.lost} records without a benchmark row, {bad.other} of another task")
    return out.drop("group_id", "subset", "_task", "_known").withColumnsRenamed({"_group": "group_id", "_subset": "subset"})


def regraded(records: DataFrame, again: DataFrame) -> DataFrame:
    """example_id, stored, again, delta of records whose score differs at four places when graded again, largest change first."""
    both = records.select("example_id", F.col("score").alias("stored")).join(again.select("example_id", F.col("score").alias("again")), "example_id")
    return both.filter(F.bround("stored", 4) != F.bround("again", 4)).withColumn("delta", F.col("again") - F.col("stored")).orderBy(F.desc(F.abs("delta")), "example_id")


def same_benchmark(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: common ids, and how many of them differ in task or reference_decision (null equal to null)."""
    both = left.select("example_id", F.struct("task", "reference_decision").alias("l")).join(right.select("example_id", F.struct("task", "reference_decision").alias("r")), "example_id")
    return both.agg(F.count(F.lit(1)).alias("common"), F.count_if(~F.col("l").eqNullSafe(F.col("r"))).alias("differ"))


def replay(examples: DataFrame, log: DataFrame, make: Column, keys: Sequence[str] = ("seed", "example_id")) -> DataFrame:
    """Examples with text from the log where it has one, else from `make`; replayed says which."""
    done = log.select(*keys, F.col("text").alias("_text"), F.lit(True).alias("_done"))
    return examples.join(done, list(keys), "left").withColumn("text", F.coalesce("_text", make)).withColumn("replayed", F.coalesce("_done", F.lit(False))).drop("_text", "_done")


def pending(examples: DataFrame, log: DataFrame, keys: Sequence[str] = ("seed", "example_id")) -> DataFrame:
    return examples.join(log, list(keys), "left_anti")


def map_differences(left: Column, right: Column) -> Column:
    """Entries of two maps that differ: key to struct of left and right."""
    both = F.map_zip_with(left, right, lambda k, a, b: F.struct(a.alias("left"), b.alias("right")))
    return F.map_filter(both, lambda k, v: ~v["left"].eqNullSafe(v["right"]))


def identity_hash(fields: Column) -> Column:
    """SHA-256 of a map as JSON with sorted keys."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields)))), 256)


def targets_fingerprint(records: DataFrame) -> DataFrame:
    """One row, sha256 of the distinct (id, task, reference_decision) as JSON lists (tree_hash); a null decision is the string None."""
    return tree_hash(records.select(F.to_json(F.array(F.col("example_id").cast("string"), F.col("task"), F.coalesce("reference_decision", F.lit("None")))).alias("row")).distinct(), "row")


def dataset_hash(rows: DataFrame, content: Column, split: str = "split", row_id: str = "id") -> DataFrame:
    """One row, sha256 of all rows' split, id and content hash (tree_hash), in any order."""
    return tree_hash(rows.select(F.concat_ws(":", F.col(split), F.col(row_id).cast("string"), content).alias("row")), "row")


def latest_status(events: DataFrame) -> DataFrame:
    """The state of each run from its append-only events (experiment_id, ts, status): status, started, finished, duration_seconds (two places)."""
    at = lambda s: F.min(F.when(F.col("status") == s, F.col("ts")))
    ends = F.max(F.when(F.col("status").isin("completed", "failed", "interrupted"), F.col("ts")))
    return events.groupBy("experiment_id").agg(F.max_by("status", "ts").alias("status"), at("running").alias("started"), ends.alias("finished")).withColumn("duration_seconds", F.round(F.col("finished") - F.col("started"), 2))


def find_runs(runs: DataFrame, config_hash: str | None = None, **equal: str) -> DataFrame:
    """Runs whose columns equal what is given, and whose config_hash begins as given."""
    for column, value in equal.items():
        if value is not None:
            runs = runs.filter(F.col(column) == value)
    return runs.filter(F.col("config_hash").startswith(config_hash)) if config_hash else runs


def run_counts(runs: DataFrame) -> DataFrame:
    """n by status, by family and of all, in one pass."""
    return runs.groupingSets([["status"], ["model_family"], []], "status", "model_family").agg(F.count(F.lit(1)).alias("n"))


def gate(runs: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """A row for each check of each run: PASS, FAIL, or SKIP where the condition is null."""
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.when(c, "PASS").when(~c, "FAIL").otherwise("SKIP").alias("result")) for n, c in checks.items()])
    return runs.select("experiment_id", F.explode(rows).alias("x")).select("experiment_id", "x.*")


def select_suite(examples: DataFrame, per_task: int = 1, abstaining: int = 2) -> DataFrame:
    """The first per_task ids of each task and the first `abstaining` ids whose reference is not confident, each once, by id."""
    first = examples.withColumn("_r", F.row_number().over(Window.partitionBy("task").orderBy("id"))).filter(F.col("_r") <= per_task).drop("_r")
    more = examples.filter(~F.col("confident")).orderBy("id").limit(abstaining)
    return first.unionByName(more).dropDuplicates(["id"]).orderBy("id")


def gold_floor(gold: DataFrame, benchmark: DataFrame, flagged: Column) -> DataFrame:
    """How many reference answers a heuristic flags: n, flagged."""
    return gold.join(benchmark, "example_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(flagged).alias("flagged"))
