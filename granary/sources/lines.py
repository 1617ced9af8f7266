"""Lines of text files with their numbers, also where a file is read in many parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import stored

#: Parts of files (a path and two numbers each) that are broadcast at most.
BROADCAST_PARTS = 100_000


def numbered_lines(spark: SparkSession, paths: str | Sequence[str], line_feed_only: bool = False) -> DataFrame:
    """file, line (from 1, in its file), value, ended: every line of the files, blank ones too. Lines end as a plain reader's do (LF, CR or CRLF), or with LF alone; ended is then false for a last line without its LF,
    else null.

    Two scans: the first counts the lines of each part in which Spark reads a file; added up along the file they give the number of each part's first line, to which the second scan adds a line's place in its
    part. Both cut files alike, as Spark lists them once. No line is moved: what is joined is a row a part, broadcast up to BROADCAST_PARTS."""
    reader = spark.read.option("lineSep", "\n") if line_feed_only else spark.read
    meta = F.col("_metadata")
    text = reader.text(paths).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("part"), F.monotonically_increasing_id().alias("at"), "value", meta["file_size"].alias("bytes"))
    taken = F.sum(F.octet_length("value").cast("long") + 1) if line_feed_only else F.lit(None).cast("long")
    parts = text.groupBy("file", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), taken.alias("taken"), F.max("bytes").alias("bytes"))
    whole = Window.partitionBy("file")
    ahead = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    lines = F.sum("n").over(whole)
    # every line takes one byte more than its text, but for a last one that was cut off
    torn = F.when(F.sum("taken").over(whole) > F.col("bytes"), lines)
    starts = stored(parts.select("file", "part", (F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("first") + 1).alias("shift"), torn.alias("torn")), "parts")
    few = starts.limit(BROADCAST_PARTS + 1).count() <= BROADCAST_PARTS
    line = F.col("at") + F.col("shift")
    ended = F.coalesce(line != F.col("torn"), F.lit(True)) if line_feed_only else F.lit(None).cast("boolean")
    return text.join(F.broadcast(starts) if few else starts, ["file", "part"]).select("file", line.alias("line"), "value", ended.alias("ended"))
