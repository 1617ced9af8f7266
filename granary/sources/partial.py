"""Logs of generations that an interrupted run leaves: a header with the run's identity, then a record a line.

All functions work on lines (file, line, value, ended), of any number of logs at once; `scan()` makes them from files."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .lines import numbered_lines

KIND, VERSION = "evaluation-partial", 1
#: Verdicts on a log, the first that holds. All but ok refuse it.
VERDICTS = ("no_header", "unreadable_header", "not_a_log", "other_identity", "damaged", "ok")
KEY = ("seed", "example_id")


def identity_sha256(identity: Mapping[str, Any]) -> str:
    return hashlib.sha256(json.dumps(identity, sort_keys=True, default=str).encode()).hexdigest()


def header(identity: Mapping[str, Any], kind: str = KIND, version: int = VERSION) -> str:
    """The first line of a log."""
    return json.dumps({"kind": kind, "version": version, "identity_sha256": identity_sha256(identity), "identity": identity}, sort_keys=True, default=str)


def scan(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return numbered_lines(spark, paths, line_feed_only=True)


def _object(value: Column) -> Column:
    """A VARIANT of a JSON object, or null."""
    return F.when(value.rlike(r"^\s*\{.*\}\s*$"), F.try_parse_json(value))


def judge(lines: DataFrame, identity: Mapping[str, Any], kind: str = KIND, version: int = VERSION) -> DataFrame:
    """A row a log: file, verdict, line (of the damage), differs_in (names of the identity's fields that are not as given, in order), torn (a last line without its end is there: it counts for nothing, as it is made again),
    records (complete lines after the header).

    One aggregation; a log's lines are never gathered."""
    whole = F.coalesce("ended", F.lit(True))
    first = (F.col("line") == 1) & whole
    good = F.coalesce(_object(F.col("value")).isNotNull() & F.get_json_object("value", "$.seed").isNotNull() & F.get_json_object("value", "$.example_id").isNotNull(), F.lit(False))
    later = (F.col("line") > 1) & whole
    logs = lines.groupBy("file").agg(F.max(F.when(first, F.col("value"))).alias("head"), F.min(F.when(later & ~good, F.col("line"))).alias("bad"), F.bool_or(~whole).alias("torn"), F.count_if(later).alias("records"))
    head = _object(F.col("head"))
    of = lambda path: F.get_json_object("head", path)
    verdict = (
        F.when(F.col("head").isNull(), "no_header")
        .when(head.isNull(), "unreadable_header")
        .when(~of("$.kind").eqNullSafe(F.lit(kind)) | ~of("$.version").eqNullSafe(F.lit(str(version))), "not_a_log")
        .when(~of("$.identity_sha256").eqNullSafe(F.lit(identity_sha256(identity))), "other_identity")
        .when(F.col("bad").isNotNull(), "damaged")
        .otherwise("ok")
    )
    plain = json.loads(json.dumps(identity, default=str))
    # each side as text in one form: that of a VARIANT
    wanted = F.from_json(F.lit(json.dumps(plain)), "map<string,variant>")
    recorded = F.coalesce(F.from_json(of("$.identity"), "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    text = lambda m: F.transform_values(m, lambda k, v: F.to_json(v))
    sides = F.map_zip_with(text(recorded), text(wanted), lambda k, a, b: ~F.coalesce(a, F.lit("null")).eqNullSafe(F.coalesce(b, F.lit("null"))))
    judged = logs.withColumn("verdict", verdict)
    differs = F.when(F.col("verdict") == "other_identity", F.array_sort(F.map_keys(F.map_filter(sides, lambda k, v: v)))).otherwise(F.array().cast("array<string>"))
    return judged.select("file", "verdict", F.when(F.col("verdict") == "damaged", F.col("bad")).alias("line"), differs.alias("differs_in"), "torn", "records")


def records(lines: DataFrame, judged: DataFrame, schema: str = schemas.GENERATION) -> DataFrame:
    """file and the fields of the records of the logs that are ok, of each (seed, example_id) the last. A torn last line is left out."""
    fine = judged.filter("verdict = 'ok'").select("file")
    work = lines.filter((F.col("line") > 1) & F.coalesce("ended", F.lit(True))).join(fine, "file").select("file", "line", F.from_json("value", schema).alias("g")).select("file", "line", "g.*")
    rest = [c for c in work.columns if c not in ("file", "line", *KEY)]
    return work.groupBy("file", *KEY).agg(F.max_by(F.struct(*rest), "line").alias("g")).select("file", *KEY, "g.*")


class LogRefused(ValueError):
    """A log that must not be gone on with. verdict, file, line and differs_in as judge() has them."""

    def __init__(self, row) -> None:
        self.verdict, self.file, self.line, self.differs_in = row.verdict, row.file, row.line, list(row.differs_in)
        super().__init__(f"{row.file}: {row.verdict}" + (f" in line {row.line}" if row.line else "") + (f", differs in {', '.join(row.differs_in)}" if row.differs_in else ""))


def load(spark: SparkSession, path: str, identity: Mapping[str, Any], kind: str = KIND, version: int = VERSION) -> DataFrame:
    """The records of one log or of all logs of a folder; the first that is not ok raises."""
    lines = scan(spark, path)
    judged = judge(lines, identity, kind, version)
    if bad := judged.filter("verdict <> 'ok'").orderBy("file").limit(1).collect():
        raise LogRefused(bad[0])
    return records(lines, judged)
