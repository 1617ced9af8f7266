"""JSON-lines datasets: scans with line numbers and rejects, typed loading, sinks, manifests."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.conversations import ID_PATTERN, content_hash, shape_errors
from ..operators.registry import dataset_hash
from ..operators.validation import SOURCES, STATUSES, TASKS
from . import schemas
from .lines import numbered_lines


def scan_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """file, line (number in its file, from 1; blank lines count), value: lines that are not blank."""
    return numbered_lines(spark, paths).filter(~F.col("value").rlike(r"^\s*$")).drop("ended")


def scan_json(spark: SparkSession, paths: str | Sequence[str], strict: bool = True) -> DataFrame:
    """file, line, value, object (VARIANT, null if the line is not a JSON object). Strict: such a line fails the job and is named."""
    rows = scan_lines(spark, paths).withColumn("object", F.when(F.col("value").rlike(r"^\s*\{.*\}\s*$"), F.try_parse_json("value")))
    if strict:
        bad = F.raise_error(F.concat(F.lit("not a JSON object in "), F.col("file"), F.lit(", line "), F.col("line").cast("string"), F.lit(": "), F.left("value", F.lit(80))))
        rows = rows.withColumn("object", F.when(F.col("object").isNull(), bad.cast("variant")).otherwise(F.col("object")))
    return rows


def load_report(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Per file: total lines, blank, parsed, failed."""
    return report_lines(spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), "value"))


def report_lines(text: DataFrame) -> DataFrame:
    """load_report() of lines (file, value)."""
    blank = F.col("value").rlike(r"^\s*$")
    good = F.col("value").rlike(r"^\s*\{.*\}\s*$") & F.try_parse_json("value").isNotNull()
    return text.groupBy("file").agg(F.count(F.lit(1)).alias("total"), F.count_if(blank).alias("blank"), F.count_if(~blank & good).alias("parsed"), F.count_if(~blank & ~good).alias("failed"))


def example_errors() -> Column:
    """Codes of what a row breaks: fields, registered names, shape of the conversation."""
    rules = {
        "bad_id": ~F.coalesce(F.col("id").rlike(ID_PATTERN), F.lit(False)),
        "unknown_task": ~F.coalesce(F.col("task").isin(*TASKS), F.lit(False)),
        "missing_domain": F.coalesce(F.col("variation_axes")["domain"], F.lit("")) == "",
        "domain_differs": F.coalesce(F.col("domain") != F.col("variation_axes")["domain"], F.lit(False)),
        "unknown_source": ~F.coalesce(F.col("metadata.source"), F.lit("synthetic")).isin(*SOURCES),
        "unknown_status": ~F.coalesce(F.col("metadata.quality_status"), F.lit("draft")).isin(*STATUSES),
    }
    own = F.filter(F.array(*[F.when(bad, F.lit(code)) for code, bad in rules.items()]), lambda x: x.isNotNull())
    return F.concat(own, shape_errors(F.coalesce("messages", F.array().cast(f"array<{schemas.MESSAGE}>"))))


def load_examples(spark: SparkSession, paths: str | Sequence[str], schema: str = schemas.EXAMPLE) -> tuple[DataFrame, DataFrame]:
    """judge_lines() of the lines of files."""
    return judge_lines(scan_lines(spark, paths), schema)


def judge_lines(lines: DataFrame, schema: str = schemas.EXAMPLE) -> tuple[DataFrame, DataFrame]:
    """lines: file, line, value. Good rows (typed) and rejects (file, line, id, errors). Keys that the schema does not have are errors; both come from one scan's expressions."""
    fields = [f.name for f in T.StructType.fromDDL(schema).fields]
    parsed = lines.select("file", "line", "value", F.from_json("value", schema).alias("x"), F.json_object_keys("value").alias("keys"))
    flat = parsed.select("file", "line", "keys", "x.*").withColumn("not_json", F.col("keys").isNull())
    extra = F.transform(F.array_except(F.coalesce("keys", F.array().cast("array<string>")), F.lit(fields)), lambda k: F.concat(F.lit("unknown_field:"), k))
    errors = F.when(F.col("not_json"), F.array(F.lit("not_json"))).otherwise(F.concat(extra, example_errors()))
    judged = flat.withColumn("errors", errors)
    return judged.filter(F.size("errors") == 0).select("file", "line", *fields), judged.filter(F.size("errors") > 0).select("file", "line", "id", "errors")


def load_strict(spark: SparkSession, paths: str | Sequence[str], schema: str = schemas.EXAMPLE) -> DataFrame:
    good, rejects = load_examples(spark, paths, schema)
    if first := rejects.limit(1).collect():
        raise ValueError(f"invalid row: {first[0].asDict()}")
    return good


def head(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows in file order."""
    return rows.orderBy("file", "line").limit(n)


SPLITS = ("train", "validation", "test")


@dataclass(frozen=True)
class Filters:
    """What rows of a bundle have to be; empty lists ask for nothing. max_examples counts rows of train, in the order of the file."""

    tasks: Sequence[str] = ()
    domains: Sequence[str] = ()
    statuses: Sequence[str] = ("reviewed",)
    excluded_sources: Sequence[str] = ()
    min_messages: int = 2
    allow_unreviewed: bool = False
    max_examples: int | None = None

    def apply(self, rows: DataFrame) -> DataFrame:
        """rows: as load_examples() gives them, with split. Defaults stand in for metadata that is not there."""
        out = rows.filter(F.size("messages") >= self.min_messages)
        status, source = F.coalesce("metadata.quality_status", F.lit("draft")), F.coalesce("metadata.source", F.lit("synthetic"))
        for value, allowed in ((F.col("task"), self.tasks), (F.col("variation_axes")["domain"], self.domains), (status, () if self.allow_unreviewed else self.statuses)):
            if allowed:
                out = out.filter(value.isin(*allowed))
        if self.excluded_sources:
            out = out.filter(~source.isin(*self.excluded_sources))
        if self.max_examples is not None:
            out = out.filter("split <> 'train'").unionByName(head(out.filter("split = 'train'"), self.max_examples))
        return out


@dataclass(frozen=True)
class Bundle:
    """rows: good rows of all splits that pass the filters, with split, file and line. rejects: split, file, line, id, errors. manifest: that of the folder, or None. counts: rows a split."""

    rows: DataFrame
    rejects: DataFrame
    manifest: Row | None
    counts: Mapping[str, int]


def load_manifest(spark: SparkSession, folder: str, name: str = "manifest.json") -> Row | None:
    """The manifest of a dataset folder, a JSON object in a file; None if there is none."""
    try:
        found = spark.read.option("multiLine", True).schema(schemas.MANIFEST).json(f"{folder.rstrip('/')}/{name}").limit(1).collect()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return found[0] if found else None


def load_bundle(spark: SparkSession, paths: Mapping[str, str] | str, required: Sequence[str] = ("train",), strict: bool = True, filters: Filters | None = None, require_manifest: bool = False) -> Bundle:
    """A dataset: its splits by name, or a folder whose splits are found by their names and whose manifest is read.

    Raises: a required split that is not there, or empty after the filters; a manifest that is asked for and not there; a bad line if strict (else it is among the rejects); an id that two rows share, of one split or of several.
    Warns of a manifest that says that the data are private. The filters are columns of one scan; counts and repeated ids take an aggregation each, whatever the number of splits."""
    manifest = None
    if isinstance(paths, str):
        manifest, paths = load_manifest(spark, paths), discover_splits(spark, paths)
    if require_manifest and manifest is None:
        raise ValueError("no manifest")
    if manifest is not None and manifest.contains_private_data:
        warnings.warn(f"dataset {manifest.version} holds private data: copy it to no public place, and publish it with nothing trained on it", stacklevel=2)
    if missing := [s for s in required if s not in paths]:
        raise ValueError(f"missing splits: {missing}")
    good, rejects = zip(*[load_examples(spark, p) for p in paths.values()], strict=True)
    named = lambda frames: reduce(DataFrame.unionByName, [f.withColumn("split", F.lit(s)) for s, f in zip(paths, frames, strict=True)])
    rows, rejects = named(good), named(rejects)
    if strict and (first := rejects.orderBy("split", "file", "line").limit(1).collect()):
        raise ValueError(f"invalid row: {first[0].asDict()}")
    rows = filters.apply(rows) if filters else rows
    counts = {s: 0 for s in paths} | {r.split: r["count"] for r in rows.groupBy("split").count().collect()}
    if empty := [s for s in required if not counts[s]]:
        raise ValueError(f"empty splits: {empty}")
    twice = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("split")).alias("splits")).filter("n > 1")
    if again := twice.orderBy("id").limit(10).collect():
        raise ValueError(f"ids that occur twice: {[(r.id, r.splits) for r in again]}")
    return Bundle(rows, rejects, manifest, counts)


def json_line(schema: T.StructType, drop: Sequence[str] = ()) -> Column:
    """The row as JSON with sorted keys at every level and nulls kept."""

    def build(at: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            return F.when(at.isNotNull(), F.struct(*[build(at[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return F.transform(at, lambda x: build(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.map_from_entries(F.array_sort(F.map_entries(at)))
        return at

    fields = sorted((f for f in schema.fields if f.name not in drop), key=lambda f: f.name)
    return F.to_json(F.struct(*[build(F.col(f.name), f.dataType).alias(f.name) for f in fields]), {"ignoreNullFields": "false"})


def write_jsonl(rows: DataFrame, path: str, files: int | None = None) -> None:
    lines = rows.select(json_line(rows.schema).alias("value"))
    (lines.coalesce(files) if files else lines).write.mode("errorifexists").text(path)


def load_manifests(spark: SparkSession, pattern: str, schema: str = schemas.MANIFEST) -> DataFrame:
    """One-object JSON files matching a pattern, unreadable ones left out, newest first."""
    files = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").schema(schema).json(pattern)
    return files.withColumn("file", F.col("_metadata.file_path")).filter(F.coalesce(*[F.col(c).cast("string") for c in ("created_at", "version") if c in files.columns]).isNotNull()).orderBy(F.desc("created_at"))


def read_events(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """parse_events() of the lines of files."""
    return parse_events(spark.read.text(paths))


def parse_events(lines: DataFrame) -> DataFrame:
    """Events of lines (value), malformed ones left out; fields beyond the schema in `fields` (VARIANT)."""
    rows = lines.select("value", F.when(F.col("value").rlike(r"^\s*\{.*\}\s*$"), F.try_parse_json("value")).alias("fields")).filter("fields is not null")
    return rows.select(F.from_json("value", schemas.EVENT).alias("e"), "fields").select("e.*", "fields")


def last_records(records: DataFrame) -> DataFrame:
    """Of the records of one seed and example the one that comes last by `at`."""
    return records.groupBy("seed", "example_id").agg(F.max_by(F.struct(*[c for c in records.columns if c not in ("seed", "example_id", "at")]), "at").alias("g")).select("seed", "example_id", "g.*")


SPLIT_NAMES = {"train": ("train", "training"), "validation": ("validation", "valid", "val", "dev"), "test": ("test", "eval", "evaluation")}


def discover_splits(spark: SparkSession, folder: str) -> dict[str, str]:
    """Path of each split's file or folder of JSON lines, by the first of its names that is there. A handful of names is looked up, through Spark's readers, so any store will do."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", True).load(folder).select("path").distinct()
    top = names.select(F.regexp_extract("path", r"([^/]+?)(?:\.jsonl)?$", 1).alias("name"), "path").filter(F.col("name").isin(*[n for own in SPLIT_NAMES.values() for n in own])).collect()
    have = {r["name"]: r["path"] for r in top}
    return {split: have[n] for split, own in SPLIT_NAMES.items() for n in own if n in have and n == next(m for m in own if m in have)}


def prepare(spark: SparkSession, source: str, target: str, version: str) -> DataFrame:
    """Write the good rows of a raw dataset to a new versioned folder (an existing one raises): rows as JSON lines under data, rejects under rejects, and the manifest, which is returned: version, example_count, rejected,
    task_distribution, domain_distribution, content_hash."""
    good, rejects = load_examples(spark, source)
    write_jsonl(good.drop("file", "line"), f"{target}/data")
    rejects.write.mode("errorifexists").json(f"{target}/rejects")
    kept = spark.read.schema(schemas.EXAMPLE).json(f"{target}/data")
    spread = lambda c: kept.groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(c, F.lit("")), "n")))).alias(f"{c}_distribution"))
    digest = dataset_hash(kept.withColumn("split", F.lit("all")), content_hash(F.col("messages"))).withColumnRenamed("sha256", "content_hash")
    counts = kept.agg(F.lit(version).alias("version"), F.count(F.lit(1)).alias("example_count")).crossJoin(rejects.agg(F.count(F.lit(1)).alias("rejected")))
    manifest = reduce(DataFrame.crossJoin, [counts, spread("task"), spread("domain"), digest])
    manifest.coalesce(1).write.mode("errorifexists").json(f"{target}/manifest")
    return spark.read.schema(manifest.schema).json(f"{target}/manifest")


def emit_schemas() -> dict[str, str]:
    """The schemas of what is read, as JSON, by name."""
    return {name.lower(): T.StructType.fromDDL(getattr(schemas, name)).json() for name in ("EXAMPLE", "EVALUATION", "RECORD", "MANIFEST", "RUN", "EVENT", "GENERATION")}


def emit_events(events: DataFrame, path: str) -> None:
    """Append events, with ts and iso_time added where they are not there, as JSON lines: a table that is only ever appended to."""
    now = F.current_timestamp()
    rows = events if "ts" in events.columns else events.withColumn("ts", F.unix_micros(now) / 1e6)
    rows = rows if "iso_time" in rows.columns else rows.withColumn("iso_time", F.date_format(F.timestamp_micros((F.col("ts") * 1e6).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"))
    rows.select(json_line(rows.schema).alias("value")).write.mode("append").text(path)
