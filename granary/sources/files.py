"""Folders as tables: hashes, checkpoints, content scans, comparisons of file lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import SENSITIVE, git_blob_sha1, masked

#: Larger files are not scanned for content.
MOST_BYTES = 2 << 20


def list_files(spark: SparkSession, root: str, pattern: str = "*", content: bool = False) -> DataFrame:
    """path, name, bytes, modified of all files under root (and content)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    out = files.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    return out


def file_hashes(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, name, bytes, sha256, git_sha1."""
    return list_files(spark, root, pattern, content=True).select("path", "name", "bytes", F.sha2("content", 256).alias("sha256"), git_blob_sha1(F.col("content")).alias("git_sha1"))


def folder_identity(spark: SparkSession, root: str, names: Sequence[str]) -> DataFrame:
    """One row: SHA-256 of the sorted name:sha256 lines of the files named."""
    rows = file_hashes(spark, root).filter(F.col("name").isin(*names))
    return rows.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("name", F.lit(":"), "sha256"))), "\n"), 256).alias("identity"))


def checkpoints(spark: SparkSession, root: str, needed: Sequence[str] = ()) -> DataFrame:
    """step, files, valid (all needed names are there), newest first, of folders checkpoint-<step> under root."""
    files = list_files(spark, root).withColumn("step", F.expr("try_cast(regexp_extract(path, '/checkpoint-([0-9]+)/', 1) AS BIGINT)")).filter("step is not null")
    have = F.array_distinct(F.collect_list("name"))
    return files.groupBy("step").agg(F.count(F.lit(1)).alias("files"), (F.size(F.array_intersect(have, F.lit(list(needed)).cast("array<string>"))) == len(set(needed))).alias("valid")).orderBy(F.desc("step"))


def keep_newest(rows: DataFrame, order: str, keep: int, valid: Column, protected: Column, by: Sequence[str] = ()) -> DataFrame:
    """Add kept: the newest `keep` (one at least) valid rows, and protected ones, of each group."""
    ranked = Window.partitionBy(*by, F.coalesce(valid, F.lit(False))).orderBy(F.desc(order))
    return rows.withColumn("kept", F.coalesce(protected, F.lit(False)) | (F.coalesce(valid, F.lit(False)) & (F.row_number().over(ranked) <= max(1, keep))))


def scan_content(rows: DataFrame, text: str, key: Sequence[str], patterns: Mapping[str, str] = SENSITIVE, allowed: str | None = None) -> DataFrame:
    """A row for each line and pattern that meets: key, line (from 1), pattern, found (masked). Only the first match of a pattern in a line; matches of `allowed` do not count."""
    lines = rows.select(*key, F.posexplode(F.split(text, "\n")).alias("line", "value")).withColumn("line", F.col("line") + 1)
    hits = F.array(*[F.struct(F.lit(n).alias("pattern"), F.regexp_extract("value", "(?U)" + p, 0).alias("found")) for n, p in patterns.items()])
    out = lines.select(*key, "line", F.explode(hits).alias("h")).filter("h.found <> ''")
    if allowed:
        out = out.filter(~F.col("h.found").rlike(allowed))
    return out.select(*key, "line", "h.pattern", masked(F.col("h.found")).alias("found"))


def scan_folder(spark: SparkSession, root: str, allowed: str | None = None, skipped: str = r"/(\.git|\.venv|venv|node_modules|__pycache__)/", most: int = MOST_BYTES) -> DataFrame:
    """scan_content() of the text files under root that are not in a skipped folder. A file of more than `most` bytes is not scanned: it has one row that says so, with line 0, pattern `not_scanned` and its size as found."""
    files = list_files(spark, root).select("path", "bytes").filter(~F.col("path").rlike(skipped))
    over = files.filter(F.col("bytes") > most).select("path", F.lit(0).alias("line"), F.lit("not_scanned").alias("pattern"), F.col("bytes").cast("string").alias("found"))
    text = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(root)
    rows = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"), "value").filter((F.col("bytes") <= most) & ~F.col("path").rlike(skipped))
    return scan_content(rows, "value", ["path"], allowed=allowed).union(over)


def upload_check(files: DataFrame, forbidden: Mapping[str, str]) -> DataFrame:
    """Add reason: the first pattern (name to regular expression) that the path meets, else null."""
    reasons = [F.when(F.col("path").rlike(p), F.lit(n)) for n, p in forbidden.items()]
    return files.withColumn("reason", F.coalesce(*reasons, F.lit(None).cast("string")))


def compare_files(left: DataFrame, right: DataFrame, key: str = "path", size: str = "bytes", digest: str = "sha256") -> DataFrame:
    """key, status: same, missing (only left), extra (only right), size or hash differs."""
    both = left.select(key, F.col(size).alias("ls"), F.col(digest).alias("lh"), F.lit(1).alias("l")).join(right.select(key, F.col(size).alias("rs"), F.col(digest).alias("rh"), F.lit(1).alias("r")), key, "full_outer")
    status = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "extra").when(~F.col("ls").eqNullSafe(F.col("rs")), "size").when(~F.col("lh").eqNullSafe(F.col("rh")), "hash").otherwise("same")
    return both.select(key, status.alias("status"))


def missing_files(required: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    return required.join(files, key, "left_anti")
