"""Sharding along a Hilbert curve: documents that are alike in several metadata dimensions come to lie in the same files, and a file's ranges of cells tell which
queries can skip it."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, join_small, materialise, quoted, settled, with_global_index


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """axes: (n, dims) integers of `bits` bits. Each point's place on the Hilbert curve, by Skilling's transposed form: exclusive-or and swap from the high
    bit down, Gray decoding, then interleaving the bits of the axes."""
    x = axes.astype(np.uint64).T.copy()
    dims = len(x)
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        low = q - one
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - one), t)
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << one) | ((x[i] >> np.uint64(b)) & one)
    return out.astype(np.int64)


def name_cells(names: DataFrame, bits: int) -> DataFrame:
    """names: name (strings, one row a row of the data). Table of name, cell for the names that are there; null is cell 0 and not in it.

    Names are numbered in their order; up to 2**bits - 1 of them have a cell each, more are cut into runs of near equal numbers of rows, so a frequent name has a cell nearly for itself."""
    top = (1 << bits) - 1
    counts = materialise(names.filter(F.col("name").isNotNull()).groupBy("name").agg(F.count(F.lit(1)).alias("n")), "names")
    placed = with_global_index(counts, [F.col("name")], "place")
    distinct = counts.count()
    if distinct <= top:
        return placed.select("name", (F.col("place") + 1).cast("int").alias("cell"))
    sized = materialise(placed.withColumn("block", F.floor(F.col("place") / BLOCK)), "placed")
    starts = _starts(sized.groupBy("block").agg(F.sum("n").alias("sum")))
    total = counts.agg(F.sum("n")).first()[0]
    within = Window.partitionBy("block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum("n").over(within), F.lit(0))
    return sized.join(F.broadcast(starts), "block").select("name", (F.floor(before * top / total) + 1).cast("int").alias("cell"))


#: Consecutive places of a block whose sum is taken before sums are added up.
BLOCK = 65_536


def _starts(blocks: DataFrame) -> DataFrame:
    """blocks: block, sum. block, start: the sum of the blocks before."""
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("block", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("start"))


def shard(docs: DataFrame, names: Mapping[str, Column], numbers: Mapping[str, Column], shards: int = 8, law: str = "rows", bits: int = 8, keep: tuple[str, ...] = ()) -> DataFrame:
    """Put every row of docs into one of `shards` runs of the Hilbert curve.

    names, numbers: dimensions of strings and of numbers, by the name of their cell's column (the order is that of the curve's axes). A string's cell is its place among those that are there (name_cells); a number's is
    one of 2**bits - 1 even steps between the least and the greatest; null has cell 0 in both. So the same table always gives the same cells. Rows are sorted by curve index, ties by text, so that copies
    lie together, and by id, and the order is cut into runs: by `rows` (counts differ by one at most) or by `bytes` (a row goes to the run in which its middle byte falls).

    Returns doc_id, the columns `keep`, size (UTF-8 bytes of the text, null: 0, plus 1), text_crc32, the cell of each dimension, curve, place (long, the row's
    place in the whole order), shard (int), slot (long, its place in the shard, from 0). An empty table gives an empty result; repeated rows are rows of their own; other columns are not read, whatever their names.
    """
    box = F.struct("doc_id", *[F.col(quoted(c)) for c in keep]).alias("row")
    return _sharded(docs.select(box, "doc_id", *_measured(names, numbers)), list(names), list(numbers), shards, law, bits).drop("doc_id").select("row.*", "*").drop("row")


def _measured(names: Mapping[str, Column], numbers: Mapping[str, Column]) -> list[Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    own = [c.alias(f"_{n}") for n, c in names.items()] + [c.cast("double").alias(f"_{n}") for n, c in numbers.items()]
    return [(F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), *own]


def _sharded(base: DataFrame, names: list[str], numbers: list[str], shards: int, law: str, bits: int) -> DataFrame:
    if law not in ("rows", "bytes"):
        raise ValueError(f"no such law: {law}")
    ends = base.agg(F.count(F.lit(1)).alias("n"), *[f(f"_{n}").alias(f"{n}_{k}") for n in numbers for k, f in (("low", F.min), ("high", F.max))]).first()
    top = (1 << bits) - 1
    for n in numbers:
        low, high = ends[f"{n}_low"], ends[f"{n}_high"]
        step = F.lit(0.0) if low is None or high <= low else (F.col(f"_{n}") - low) / (high - low) * top
        base = base.withColumn(n, F.when(F.col(f"_{n}").isNull(), 0).otherwise(F.least(F.floor(step), F.lit(top - 1)) + 1).cast("int")).drop(f"_{n}")
    for n in names:
        cells = settled("cells", lambda n=n: name_cells(base.select(F.col(f"_{n}").alias("name")), bits))
        cells = cells.select(F.col("name").alias(f"_{n}"), F.col("cell").alias(n))
        base = join_small(base, cells, f"_{n}").withColumn(n, F.coalesce(n, F.lit(0))).drop(f"_{n}")

    @F.pandas_udf("long")
    def curve(*cells: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in cells], axis=1), bits))

    base = base.withColumn("curve", curve(*names, *numbers))
    placed = with_global_index(base, [F.col("curve"), F.col("text_crc32"), F.col("size"), F.col("doc_id")], "place")
    if law == "bytes":
        return _by_bytes(placed, shards)
    small, extra = divmod(ends["n"], shards)
    edge = extra * (small + 1)
    place = F.col("place")
    low = F.floor(place / (small + 1))
    high = extra + F.floor((place - edge) / max(small, 1))
    run = F.when(place < edge, low).otherwise(high)
    slot = F.when(place < edge, place - low * (small + 1)).otherwise(place - edge - (high - extra) * small)
    return placed.withColumn("shard", run.cast("int")).withColumn("slot", slot.cast("long"))


def _by_bytes(placed: DataFrame, shards: int) -> DataFrame:
    """Runs of near equal bytes: sums of blocks of consecutive places give every block its start, running sums within a block the rest."""
    work = materialise(placed.withColumn("_block", F.floor(F.col("place") / BLOCK)), "sized")
    blocks = _starts(work.groupBy(F.col("_block").alias("block")).agg(F.sum("size").alias("sum"))).select(F.col("block").alias("_block"), F.col("start").alias("_start"))
    total = work.agg(F.sum("size")).first()[0] or 1
    within = Window.partitionBy("_block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("_start") + F.coalesce(F.sum("size").over(within), F.lit(0)) + F.col("size") / 2
    out = work.join(F.broadcast(blocks), "_block").withColumn("shard", F.least(F.floor(middle / total * shards), F.lit(shards - 1)).cast("int"))
    out = materialise(out.drop("_block", "_start"), "cut")
    firsts = out.groupBy("shard").agg(F.min("place").alias("_first"))
    return out.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("place") - F.col("_first")).drop("_first")


def write_shards(docs: DataFrame, path: str, names: Mapping[str, Column], numbers: Mapping[str, Column], shards: int = 8, law: str = "rows", bits: int = 8) -> DataFrame:
    """Write docs, whole rows, as one folder shard=k a shard, in the order of the curve, and return the table of ranges: shard, rows, bytes, and <dimension>_low and <dimension>_high, the least and
    greatest cell in the shard. Rows move once, to their range of the curve. docs must not have a column `shard`."""
    placed = _sharded(boxed(docs, F.col("doc_id"), *_measured(names, numbers)), list(names), list(numbers), shards, law, bits)
    if law == "rows":
        placed = materialise(placed, "placed")
    placed.sortWithinPartitions("shard", "place").select("row.*", "shard").write.partitionBy("shard").parquet(path)
    cells = [*names, *numbers]
    ends = [f(n).alias(f"{n}_{k}") for n in cells for k, f in (("low", F.min), ("high", F.max))]
    return materialise(placed.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), *ends), "ranges")


def read_shards(ranges: DataFrame, path: str, **cells: tuple[int, int]) -> DataFrame:
    """Rows of the shards that can hold a row whose cells lie in the ranges given (dimension: least and greatest cell): the others are not read. The rows still have to be filtered."""
    may = ranges
    for n, (low, high) in cells.items():
        may = may.filter((F.col(f"{n}_high") >= low) & (F.col(f"{n}_low") <= high))
    found = [r["shard"] for r in may.select("shard").collect()]  # a number a shard
    return ranges.sparkSession.read.parquet(path).filter(F.col("shard").isin(found))
