"""Places in an order found without bringing a group into one task: order statistics by ranges, the least of a group by salted rounds, hashes of all rows as a tree."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Rows that a list of the hash tree aims at, and digits (base 16) that its parts have at most.
LIST, MOST_DIGITS = 1024, 12
#: Tasks that share a group while its least rows are looked for.
SALTS = 64


def same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    """Equality of columns of two tables, null equal to null."""
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in columns])


def order_statistics(rows: DataFrame, value: str, by: Sequence[str], places: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """A row a group: by, n, mean (double), min, max, and for each name of places the value at that place (from 1) in order; a place is an expression of n. Null values take no part; null groups are groups. Without `by` there is one
    row, also for an empty table (nulls).

    Distinct values are counted and dealt into sorted ranges. The counts of ranges, added up along each group, tell which range holds a place; only those ranges are read again and
    numbered, each in a task of its own. So no task has more than a range, and what is in no such range is never sorted."""
    keys = list(by) or ["_all"]
    source = rows if by else rows.withColumn("_all", F.lit(0))
    counts = source.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    # the number of the range is written with the rows: what is read back cannot be dealt in another way
    dealt = stored(counts.repartitionByRange(ranges, *keys, "_v").withColumn("_part", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*keys, "_part").agg(F.sum("_c").alias("_n"), F.sum(F.col("_v").cast("double") * F.col("_c")).alias("_s"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    group = Window.partitionBy(*keys)
    ahead = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    located = stored(sums.withColumn("_before", ahead).withColumn("_all_n", F.sum("_n").over(group)), "located")
    totals = located.groupBy(*keys).agg(F.sum("_n").alias("n"), (F.sum("_s") / F.sum("_n")).alias("mean"), F.min("_low").alias("min"), F.max("_high").alias("max"))
    inside = [F.struct(F.lit(name).alias("name"), (place(F.col("_all_n")).cast("long") - F.col("_before")).alias("k")) for name, place in places.items()]
    asked = located.select(*keys, "_part", F.explode(F.filter(F.array(*inside), lambda x: (x["k"] > 0) & (x["k"] <= F.col("_n")))).alias("x")).select(*keys, "_part", "x.*")
    hit = asked.select(*keys, "_part").distinct()
    values = dealt.join(hit, same(dealt, hit, [*keys, "_part"]), "left_semi")
    upto = values.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys, "_part").orderBy("_v")))
    found = upto.join(asked, same(upto, asked, [*keys, "_part"]) & (F.col("k") <= F.col("_upto")) & (F.col("k") > F.col("_upto") - F.col("_c"))).select(*[upto[k] for k in keys], "name", "_v")
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in places])
    if not by:
        one = rows.sparkSession.range(1).select(F.lit(0).alias("_all"))
        return one.join(totals, "_all", "left").join(wide, "_all", "left").drop("_all")
    return totals.join(wide, same(totals, wide, keys), "left").select(*[totals[k] for k in keys], "n", "mean", "min", "max", *places)


def least(rows: DataFrame, by: Sequence[str], order: Sequence[str], k: int, salts: int = SALTS) -> DataFrame:
    """The k least rows of each group, in two rounds: of each of `salts` parts of a group, then of what those leave, which is at most salts * k rows a group."""
    salt = F.pmod(F.xxhash64(*order), F.lit(salts))
    first = F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*order))
    few = rows.withColumn("_salt", salt).withColumn("_r", first).filter(F.col("_r") <= k)
    last = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return few.withColumn("_r", last).filter(F.col("_r") <= k).drop("_salt", "_r")


def digits(n: int, list_rows: int = LIST) -> int:
    """Digits of the tree's parts for n different rows: the fewest with which a part has list_rows rows or less on average."""
    d = 0
    while d < MOST_DIGITS and n > list_rows * 16**d:
        d += 1
    return d


def tree_hash(rows: DataFrame, row: str, list_rows: int = LIST) -> DataFrame:
    """One row, sha256: a hash of the multiset of strings in the column `row`, whatever their order and partitions (null: not counted).

    Equal rows become one with their number. Each is hashed; hashes that share their first digits make a list (the more rows, the more digits, so that lists stay as long as they are), lists are hashed in order, and sixteen
    of those at a time up to the root. An empty table has the hash of an empty text."""
    one = rows.filter(F.col(row).isNotNull()).groupBy(F.sha2(row, 256).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    leaves = stored(one.select(F.sha2(F.concat_ws(":", "h", "n"), 256).alias("h")), "leaves")
    d = digits(leaves.count(), list_rows)
    level = leaves.select(F.left("h", F.lit(d)).alias("p"), "h")
    while True:
        level = level.groupBy("p").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
        if not d:
            break
        d -= 1
        level = level.select(F.left("p", F.lit(d)).alias("p"), F.concat("p", F.lit(":"), "h").alias("h"))
    empty = F.lit("").cast("binary")
    return level.agg(F.coalesce(F.max("h"), F.sha2(empty, 256)).alias("sha256"))
