"""What the operators share: tables in the shared folder, size-checked broadcasts, global order."""

from __future__ import annotations

import contextvars
import logging
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII white space, what separates words.
SPACE = r"[\x20\x09-\x0D]"
#: Rows up to which a narrow table (a few numbers and a short name a row) is broadcast: tens of MB.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset a local session gets one of its own; a cluster has to name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local($|\[)", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="granary-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Folders of the tables that materialise() has written and that are still referred to, and the folders written inside of settled().
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_made: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: this cuts the lineage, and the rows outlive the executors that made them."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    if (made := _made.get()) is not None:
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder by the file system that Spark itself has for it. What cannot be deleted stays, with a line in the log: no result depends on it."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:
        log.warning("could not delete %s", path, exc_info=True)


def release(*tables: DataFrame | None) -> None:
    """Delete tables of materialise() that no later read needs: those made from them are written."""
    for t in tables:
        if t is not None and (path := _paths.pop(t, None)):
            remove_folder(t.sparkSession, path)


def settled(name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """materialise(make()); the tables that make() wrote on the way are deleted once its result is written."""
    made: list[str] = []
    token = _made.set(made)
    try:
        df = make()
    finally:
        _made.reset(token)
    out = materialise(df, name)
    for path in made:
        remove_folder(out.sparkSession, path)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def boxed(docs: DataFrame, *parts: Column) -> DataFrame:
    """One struct column `row` with all of docs' columns, and the columns `parts` of docs: no name of theirs can meet one of an operator. select("row.*") gives docs' columns back."""
    return docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), *parts)


def row_key(*content: str | Column) -> list[Column]:
    """Two longs k1 and k2, 128 bits together, that identify a row by content: two hashes of the columns given, started differently. Equal rows share them."""
    columns = [F.col(c) if isinstance(c, str) else c for c in content]
    # a null adds nothing to a hash, so which columns are null is hashed as well
    nulls = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in columns])
    return [F.xxhash64(F.lit(1), nulls, *columns).alias("k1"), F.xxhash64(F.lit("second"), *reversed(columns), nulls).alias("k2")]


KEY = ["k1", "k2"]


def join_small(big: DataFrame, small: DataFrame, on: str | Sequence[str], how: str = "left", salts: int = 16, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a usually small table that is already materialised and unique in `on`. It is counted first: up to `rows` it is broadcast; beyond,
    it never is: both sides are salted, so that the rows of a hot key go to `salts` tasks."""
    on = [on] if isinstance(on, str) else list(on)
    if small.limit(rows + 1).count() <= rows:
        return big.join(F.broadcast(small), on, how)
    salt = "_salt"
    left = big.withColumn(salt, F.pmod(F.xxhash64(*[F.col(c) for c in big.columns if c not in on] or [F.lit(0)]), F.lit(salts)).cast("int"))
    right = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # Spark goes by the size of files and would broadcast the copies of a table that is small there
    return left.join(right.hint("merge"), [*on, salt], how).drop(salt)


def with_global_index(df: DataFrame, order: Sequence[Column], name: str, parts: int | None = None) -> DataFrame:
    """Add `name`: the row's place (long, from 0) in the order given. Rows are range-partitioned and sorted, each partition's count is added up on the driver
    (one number a partition), and a row's place is its partition's start plus its place there. No task sees more than its range.
    `order` should end in columns that tell rows apart, or a range of equal keys lands in one task."""
    spark = df.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = materialise(ranged, "ranged")
    counts = ranged.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    starts, at = [], 0
    for r in counts:
        starts.append((r["_part"], at))
        at += r["n"]
    table = spark.createDataFrame(starts, "_part long, _start long")
    place = F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return ranged.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(table), "_part").withColumn(name, place).drop("_part", "_at", "_start")
