"""Distributions of a dataset and coverage of its variation axes. Rows have the axes as columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import guarded_ratio
from ..sources.scratch import stored
from .orderstats import order_statistics

MIN_CELL = 3
#: Values of an axis (a short name and a number each) that are broadcast at most.
BROADCAST_VALUES = 500_000
MISSING = "<missing>"


def long_form(rows: DataFrame, axes: Sequence[str]) -> DataFrame:
    """axis, value: a row for each axis of each row."""
    return rows.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in axes])).alias("x")).select("x.*")


def marginal_counts(rows: DataFrame, axes: Sequence[str]) -> DataFrame:
    """axis, value (null: missing), n."""
    return long_form(rows, axes).groupBy("axis", "value").agg(F.count(F.lit(1)).alias("n"))


def axis_coverage(rows: DataFrame, axes: Sequence[str]) -> DataFrame:
    """axis, distinct values, missing, imbalance (largest over smallest count), constant."""
    counts = marginal_counts(rows, axes)
    there = F.when(F.col("value").isNotNull(), F.col("n"))
    out = counts.groupBy("axis").agg(F.count("value").alias("distinct_values"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"), guarded_ratio(F.max(there), F.min(there)).alias("imbalance"))
    return out.withColumn("constant", F.col("distinct_values") == 1)


def _seen(rows: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Observed combinations; `<missing>` stands for a missing value."""
    return rows.select(*[F.coalesce(F.col(a).cast("string"), F.lit(MISSING)).alias(a) for a in axes]).groupBy(*axes).agg(F.count(F.lit(1)).alias("n"))


def axis_values(rows: DataFrame, axes: Sequence[str]) -> DataFrame:
    """axis, i (from 0, in order of the values), value, size (number of its values): the values of each axis; one without any has `<missing>`."""
    found = long_form(rows, axes).filter("value is not null").distinct()
    names = rows.sparkSession.createDataFrame([(a,) for a in axes], "axis string")
    every = names.join(found, "axis", "left").select("axis", F.coalesce("value", F.lit(MISSING)).alias("value"))
    # ranges of an axis are counted and numbered by themselves, so that an axis of very many values is not ordered in one task
    bucket = F.substring(F.sha2("value", 256), 1, 3)
    work = every.withColumn("_b", bucket)
    sums = work.groupBy("axis", "_b").agg(F.count(F.lit(1)).alias("_n"))
    axis = Window.partitionBy("axis")
    starts = sums.select("axis", "_b", F.coalesce(F.sum("_n").over(axis.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"), F.sum("_n").over(axis).alias("size"))
    place = F.row_number().over(Window.partitionBy("axis", "_b").orderBy("value"))
    return work.withColumn("_r", place).join(starts, ["axis", "_b"]).select("axis", (F.col("_s") + F.col("_r") - 1).alias("i"), "value", "size")


def cell_summary(rows: DataFrame, axes: Sequence[str], least: int = MIN_CELL) -> DataFrame:
    """One row: possible (combinations of observed values, exact however many, as decimal(38,0)), observed, thin, covered, empty, fill_rate. Empty cells are counted from the axes' numbers of values and never made."""
    marginal = marginal_counts(rows, axes).groupBy("axis").agg(F.greatest(F.count("value"), F.lit(1)).alias("size"))
    sizes = marginal.agg(F.collect_list(F.col("size").cast("decimal(38,0)")).alias("s"))
    possible = F.aggregate("s", F.lit(1).cast("decimal(38,0)"), lambda a, x: (a * x).cast("decimal(38,0)"))
    lacking = long_form(rows, axes).groupBy("axis").agg(F.count("value").alias("n")).filter("n = 0").select("axis")
    bare = [r["axis"] for r in lacking.collect()]  # a name an axis at most
    whole = _seen(rows, axes).filter(reduce(lambda a, b: a & b, [F.lit(True), *[F.col(a) != MISSING for a in axes if a not in bare]]))
    counts = whole.agg(F.count(F.lit(1)).alias("observed"), F.count_if(F.col("n") < least).alias("thin"), F.count_if(F.col("n") >= least).alias("covered"))
    out = sizes.select(possible.alias("possible")).crossJoin(counts)
    return out.withColumn("empty", F.col("possible") - F.col("observed")).withColumn("fill_rate", (F.col("observed") / F.col("possible")).cast("double"))


def joint_cells(rows: DataFrame, axes: Sequence[str], least: int = MIN_CELL, first: int = 0, most: int | None = None) -> DataFrame:
    """Combinations of observed values: the axes, n, state (empty, thin, covered). `<missing>` stands only for an axis without any value; cells with a missing value are not listed.

    Cells have numbers, from which their values are read by joins with the axes' lists: no product of lists is made, and a stretch of `most` cells from number `first` on can be asked for where all are too many to be
    wanted at once (cell_summary() counts them)."""
    values = stored(axis_values(rows, axes), "values")
    sizes = {r["axis"]: r["size"] for r in values.select("axis", "size").distinct().collect()}  # a number an axis
    total = reduce(lambda x, y: x * y, sizes.values(), 1)
    end = total if most is None else min(total, first + most)
    if end > 2**63 - 1:
        raise ValueError(f"there are {total} cells: ask for a stretch of them")
    cells, step = rows.sparkSession.range(first, max(first, end)), 1
    for a in axes:
        own = values.filter(F.col("axis") == a).select(F.col("i").alias("_i"), F.col("value").alias(a))
        cells = cells.withColumn("_i", F.expr(f"(id div {step}L) % {sizes[a]}L")).join(F.broadcast(own) if sizes[a] <= BROADCAST_VALUES else own, "_i").drop("_i")
        step *= sizes[a]
    out = cells.drop("id").join(_seen(rows, axes), list(axes), "left").fillna(0, ["n"])
    return out.withColumn("state", F.when(F.col("n") == 0, "empty").when(F.col("n") < least, "thin").otherwise("covered"))


def fill_rate(cells: DataFrame) -> DataFrame:
    """possible, observed, fill_rate of listed cells; cell_summary() has them without a list."""
    return cells.agg(F.count(F.lit(1)).alias("possible"), F.count_if(F.col("n") > 0).alias("observed"), (F.count_if(F.col("n") > 0) / F.count(F.lit(1))).alias("fill_rate"))


def top_values(rows: DataFrame, axes: Sequence[str], k: int = 5) -> DataFrame:
    """The k most frequent values of each axis, ties by value: a top-k report."""
    place = F.row_number().over(Window.partitionBy("axis").orderBy(F.desc("n"), "value"))
    return marginal_counts(rows, axes).filter("value is not null").withColumn("place", place).filter(F.col("place") <= k)


def most_common(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Counts, most frequent first, ties in the order first seen."""
    return rows.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first")


def length_stats(rows: DataFrame, value: str) -> DataFrame:
    """n, mean, median, min, max and p95 of whole numbers: the value at place int(0.95 n) in order, for fewer than 20 rows the greatest. Values are dealt into ranges (order_statistics)."""
    p95 = lambda n: F.when(n >= 20, F.floor(n * F.lit(0.95))).otherwise(n)
    at = order_statistics(rows, value, [], {"_a": lambda n: F.floor((n + 1) / 2), "_b": lambda n: F.floor((n + 2) / 2), "_p": p95})
    double = lambda c: F.col(c).cast("double")
    return at.select("n", "mean", ((double("_a") + double("_b")) / 2).alias("median"), double("min").alias("min"), double("max").alias("max"), double("_p").alias("p95"))
