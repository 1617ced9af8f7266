"""Generations recorded from a stream so that an interrupted run goes on where it stopped.

A log is a folder: `header`, one line with the identity of what is generated; `writer`, the stream that may write it; `records`, a folder a batch. A batch that is run again (the stream died between the batch's write and
its commit) overwrites its own folder with the same rows, so nothing is recorded twice, and of records of one key the last batch's counts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import partial, schemas


def _lines(spark: SparkSession, path: str) -> list[str] | None:
    try:
        return [r["value"] for r in spark.read.text(path).limit(2).collect()]
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def start(spark: SparkSession, path: str, identity: Mapping[str, Any]) -> None:
    """Write the header of a new log; one that is there has to be of the same identity (LogRefused)."""
    if _lines(spark, f"{path}/header") is not None:
        return check(spark, path, identity)
    spark.createDataFrame([(partial.header(identity),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/header")
    return None


def check(spark: SparkSession, path: str, identity: Mapping[str, Any]) -> None:
    found = _lines(spark, f"{path}/header") or []
    rows = [(path, 1, found[0], True)] if found else [(path, 1, "", False)]
    judged = partial.judge(spark.createDataFrame(rows, "file string, line long, value string, ended boolean"), identity).first()
    if judged.verdict != "ok":
        raise partial.LogRefused(judged)


def generation_lines(spark: SparkSession, folder: str, schema: str = schemas.GENERATION) -> DataFrame:
    """The records of JSON-lines files as they come into a folder, with `at`: the time of their file, its name, and the part of it; record() adds the place in that part."""
    m = F.col("_metadata")
    at = F.struct(m["file_modification_time"].alias("time"), m["file_path"].alias("file"), m["file_block_start"].alias("part"))
    return spark.readStream.schema(schema).json(folder).withColumn("at", at)


def record(stream: DataFrame, path: str, identity: Mapping[str, Any], checkpoint: str, key: Sequence[str] = partial.KEY, order: str = "at", on_batch: Callable[[int], None] | None = None) -> StreamingQuery:
    """Record what the stream has (key, order and other columns) and stop; called again with the same checkpoint it goes on. Of a batch's records of one key the last is written: by `order`, then as they are read.

    Refused before anything is written: a log of another identity, and one that a stream with another checkpoint writes (its batches would take the place of those that are there). on_batch is called after a batch
    is written and before it is committed."""
    spark = stream.sparkSession
    start(spark, path, identity)
    rest = [c for c in stream.columns if c not in (*key, order)]

    def write(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        check(own, path, identity)
        me = own.sparkContext.getLocalProperty("sql.streaming.queryId")
        known = _lines(own, f"{path}/writer")
        if known is None:
            own.createDataFrame([(me,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/writer")
        elif known != [me]:
            raise ValueError(f"{path} is written by another stream: go on with its checkpoint")
        placed = batch.withColumn("_row", F.monotonically_increasing_id())
        last = placed.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(order, "_row")).alias("g"), F.count(F.lit(1)).alias("given")).select(*key, "g.*", "given")
        last.write.mode("overwrite").parquet(f"{path}/records/batch={number}")
        if on_batch:
            on_batch(number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recorded(spark: SparkSession, path: str, identity: Mapping[str, Any], schema: str = schemas.GENERATION, key: Sequence[str] = partial.KEY) -> DataFrame:
    """The last record of each key; a log of another identity is refused, one without records is empty."""
    check(spark, path, identity)
    fields = f"{schema}, given bigint, batch bigint"
    try:
        rows = spark.read.schema(fields).parquet(f"{path}/records")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], fields)
    rest = [c for c in rows.columns if c not in (*key, "batch", "given")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("g"), F.sum("given").alias("given")).select(*key, "g.*", "given")


def resumed(requests: DataFrame, done: DataFrame, generate: Callable[[DataFrame], DataFrame], key: Sequence[str] = partial.KEY) -> DataFrame:
    """requests answered from the records where there are some, by `generate` (requests to the records' columns) where there are none; replayed says which. Only requests without a record reach generate."""
    columns = [c for c in done.columns if c != "given"]
    old = requests.select(*key).distinct().join(done.select(*columns), list(key)).withColumn("replayed", F.lit(True))
    new = generate(requests.join(done.select(*key), list(key), "left_anti")).select(*columns).withColumn("replayed", F.lit(False))
    return old.unionByName(new)
