"""Bootstrap intervals and verdicts. Draws come from SHA-256 of seed, repetition and slot, so that any engine makes the same."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import drawn
from ..sources.scratch import stored

MIN_CLUSTERS = 5
#: Units of a block, a power of two.
BLOCK_BITS = 14
BLOCK = 1 << BLOCK_BITS
#: Bytes of units that are broadcast at a time; different pairs of total and size up to which a unit is the number of its pair; draws of a task.
BROADCAST_BYTES = 32 << 20
MOST_VALUES = 4096
TASK_DRAWS = 50_000_000


def draw(repetition: Column, slot: Column, n: Column, seed: int) -> Column:
    """A number from 0 to n - 1."""
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), repetition.cast("string"), F.lit(":"), slot.cast("string")), 256), 1, 15), 16, 10).cast("long")
    return F.pmod(head, n)


def _numbered(per: DataFrame) -> DataFrame:
    """Clusters c with totals and sizes, numbered from 0 in the order of the hash of their name: places within 4096 ranges of the hash, plus the counts of the ranges before."""
    work = per.withColumn("_k", F.sha2("c", 256)).withColumn("_b", F.substring("_k", 1, 3))
    sums = work.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    starts = sums.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_k", "c")) + F.col("_s") - 1
    return work.join(F.broadcast(starts), "_b").select(place.cast("long").alias("g"), "total", "size")


def _blocks(units: DataFrame, values: list[Column]) -> DataFrame:
    """Units as rows of BLOCK: _at, and an array for each of the values in the order of g. A look-up by place then needs neither a row nor a key for each unit."""
    rows = units.groupBy((F.col("g") / BLOCK).cast("long").alias("_at")).agg(F.array_sort(F.collect_list(F.struct("g", *values))).alias("_u"))
    return rows.select("_at", *[F.col(f"_u.{v}").alias(v) for v in units.select(*values).columns])


def _resampled(units: DataFrame, n: int, iterations: int, seed: int) -> DataFrame:
    """units: g (from 0 to n - 1), total, size, a table that is stored. b, estimate: of each repetition the drawn totals over the drawn sizes. Draws are a range of numbers, dealt out evenly, however many; a task makes its draws
    with numpy, a piece at a time, looks them up in the units and adds them up, so draws are neither rows nor shuffled.

    Units are broadcast in blocks, at most BROADCAST_BYTES at a time: one or two bytes a unit where they have at most MOST_VALUES different totals and sizes, else sixteen. More units than that are taken a slice after the other, and
    each slice makes all draws again."""
    spark = units.sparkSession
    known = units.select("total", "size").distinct().limit(MOST_VALUES + 1).collect()
    coded, wide = len(known) <= MOST_VALUES, len(known) > 128
    if coded:
        values = F.broadcast(spark.createDataFrame([(i, r["total"], r["size"]) for i, r in enumerate(known)], f"code {'short' if wide else 'byte'}, total double, size long"))
        units = units.join(values, units["total"].eqNullSafe(values["total"]) & (units["size"] == values["size"])).select("g", "code")
    columns = [F.col("code")] if coded else [F.col("total"), F.col("size")]
    tasks = max(spark.sparkContext.defaultParallelism, -(-n * iterations // TASK_DRAWS))
    most = BROADCAST_BYTES // (16 if not coded else 2 if wide else 1) // BLOCK * BLOCK
    sums = []
    for a in range(0, n, most):
        blocks = _blocks(units if n <= most else units.filter((F.col("g") >= a) & (F.col("g") < a + most)), columns)
        jobs = spark.range(0, tasks, 1, tasks).crossJoin(F.broadcast(blocks))  # a job's only partition has all blocks
        if coded:
            met = jobs.mapInArrow(_adder(n, iterations, seed, tasks, a, min(n - a, most), len(known)), "b int, code short, times long").join(values, "code")
            met = met.select("b", (F.col("total") * F.col("times")).alias("total"), (F.col("size") * F.col("times")).alias("size"))
        else:
            met = jobs.mapInArrow(_adder(n, iterations, seed, tasks, a, min(n - a, most), None), "b int, total double, size long")
        sums.append(met.groupBy("b").agg(F.sum("total").alias("total"), F.sum("size").alias("size")))
    return reduce(DataFrame.union, sums).groupBy("b").agg((F.sum("total") / F.sum("size")).alias("estimate"))


def _adder(n: int, iterations: int, seed: int, tasks: int, first: int, length: int, codes: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Takes one job's number beside each block of the units from `first` on, and gives for each of its repetitions how often each code is drawn (codes: how many there are), or else the drawn totals and sizes."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, held, there = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            if job is None:
                job = batch.column(0)[0].as_py()
                held = [np.zeros(length, np.dtype(c.type.value_type.to_pandas_dtype())) for c in batch.columns[2:]]
                there = np.ones(length, bool) if codes is None else None
            for i, at in enumerate(batch.column(1).to_pylist()):
                from_ = at * BLOCK - first
                for k, (room, c) in enumerate(zip(held, batch.columns[2:], strict=True)):
                    block = c[i].values
                    if there is not None and k == 0:
                        there[from_ : from_ + len(block)] = block.is_valid().to_numpy(zero_copy_only=False)
                        block = block.fill_null(0)
                    room[from_ : from_ + len(block)] = block.to_numpy(zero_copy_only=False)
        if job is None:
            return
        low, high = n * iterations * job // tasks, n * iterations * (job + 1) // tasks
        while low < high:
            b, slot = divmod(low, n)
            end = min(n, slot + high - low)
            times, total, size, found = np.zeros(codes or 0, np.int64), 0.0, 0, 0
            for g in drawn(seed, b, slot, end, n):
                g = g if length == n else g[(g >= first) & (g < first + length)] - first
                if codes is not None:
                    times += np.bincount(held[0][g], minlength=codes)
                else:
                    total, size, found = total + float(held[0][g].sum()), size + int(held[1][g].sum()), found + int(there[g].sum())
            if codes is not None:
                at = np.flatnonzero(times)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), b, np.int32)), pa.array(at.astype(np.int16)), pa.array(times[at])], ["b", "code", "times"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([total if found else None], pa.float64()), pa.array([size], pa.int64())], ["b", "total", "size"])
            low += end - slot

    return add_up


def _interval(estimates: DataFrame, iterations: int) -> DataFrame:
    """ci_low, ci_high (order statistics), below and above (repetitions at or beyond zero)."""
    low, high = int(0.025 * iterations), min(int(0.975 * iterations), iterations - 1)
    at = F.row_number().over(Window.orderBy("estimate")) - 1
    return estimates.withColumn("i", at).agg(F.max(F.when(F.col("i") == low, F.col("estimate"))).alias("ci_low"), F.max(F.when(F.col("i") == high, F.col("estimate"))).alias("ci_high"), F.count_if(F.col("estimate") <= 0).alias("below"), F.count_if(F.col("estimate") >= 0).alias("above"))


def cluster_bootstrap(records: DataFrame, value: Column, cluster: str, iterations: int = 2000, seed: int = 42, min_clusters: int = MIN_CLUSTERS) -> DataFrame:
    """Whole clusters are drawn; the estimate is the sum over the count of what was drawn. One row: n, clusters, observed, estimable, ci_low, ci_high, p_value (of a difference from zero), significant.

    Records are summed up by cluster first: the resampling works on one row a cluster. Fewer than min_clusters, or any record without a cluster, make it not estimable."""
    work = records.select(F.col(cluster).cast("string").alias("c"), value.cast("double").alias("v"))
    per = stored(work.groupBy("c").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("size")), "clusters")  # read four times
    head = per.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("clusters"), F.coalesce(F.sum("total") / F.sum("size"), F.lit(0.0)).alias("observed"), F.coalesce(F.bool_or(F.col("c").isNull()), F.lit(False)).alias("unnamed"))
    known = head.first()
    if known.clusters < min_clusters or known.unnamed:
        nothing = F.lit(None).cast("double")
        return head.drop("unnamed").withColumn("estimable", F.lit(False)).withColumn("ci_low", nothing).withColumn("ci_high", nothing).withColumn("p_value", nothing).withColumn("significant", F.lit(None).cast("boolean"))
    found = _interval(_resampled(stored(_numbered(per), "units"), known.clusters, iterations, seed), iterations)
    p = F.least(F.lit(1.0), 2 * F.when(F.col("observed") >= 0, F.col("below")).otherwise(F.col("above")) / iterations)
    out = head.drop("unnamed").crossJoin(found).withColumn("p_value", p).withColumn("significant", p < 0.05).withColumn("estimable", F.lit(True))
    return out.select("n", "clusters", "observed", "estimable", "ci_low", "ci_high", "p_value", "significant")


def paired_cluster_bootstrap(pairs: DataFrame, cluster: str = "group_id", **options) -> DataFrame:
    """Of tuned - base."""
    return cluster_bootstrap(pairs, F.col("tuned") - F.col("base"), cluster, **options)


def paired_bootstrap(pairs: DataFrame, example: str = "example_id", **options) -> DataFrame:
    """Examples are drawn one by one: each is a cluster of its own."""
    return cluster_bootstrap(pairs, F.col("tuned") - F.col("base"), example, min_clusters=1, **options)


def verdict(delta: Column, significant: Column) -> Column:
    """no change below a hundredth, else improved or regressed, with a note if an interval says it is not significant."""
    way = F.when(delta > 0, "improved").otherwise("regressed")
    return F.when(F.abs(delta) < 0.01, "no change").when(significant.isNull() | significant, way).otherwise(F.concat(way, F.lit(" (not significant)")))


def primary_verdict(low: Column, high: Column, margin: float, estimable: Column | None = None) -> Column:
    """better or worse if the interval excludes zero, equivalent if it lies within the margin, else inconclusive. Ends are rounded to four places, as reports give them."""
    a, b = F.bround(low, 4), F.bround(high, 4)
    out = F.when(a > 0, "better").when(b < 0, "worse").when((a >= -margin) & (b <= margin), "equivalent").otherwise("inconclusive")
    return out if estimable is None else F.when(estimable, out).otherwise("inconclusive")


def compare(pairs: DataFrame, margin: float = 0.02, by: str = "task", cluster: str = "group_id", iterations: int = 2000, seed: int = 42, min_clusters: int = MIN_CLUSTERS) -> DataFrame:
    """Overall and for each value of `by` (null is a value of its own): `by`, overall (whether the row is of all pairs, `by` is then `overall`), n, clusters, base, tuned, delta, estimable, ci_low, ci_high,
    p_value, significant, verdict and primary verdict by paired cluster bootstrap.

    One plan for all values, however many: pairs are summed up by value and cluster, clusters are numbered within their value, and every cluster makes as many draws as there are repetitions, so draws are as many
    rows as clusters times repetitions and are dealt out evenly. No pairs give a row of all pairs that says so."""
    value = F.col(by).cast("string")
    sides = F.array(F.struct(F.lit(True).alias("overall"), F.lit("overall").alias(by)), F.struct(F.lit(False).alias("overall"), value.alias(by)))
    work = pairs.select(F.explode(sides).alias("_s"), F.col(cluster).cast("string").alias("c"), F.col("base").cast("double").alias("base"), F.col("tuned").cast("double").alias("tuned"))
    name = F.concat(F.when(F.col("_s.overall"), "o").otherwise("v"), F.coalesce(F.concat(F.lit("="), F.col(f"_s.{by}")), F.lit("")))
    scored = F.col("tuned") - F.col("base")
    per = work.withColumn("_g", name).groupBy("_g", "_s", "c").agg(F.sum(scored).alias("total"), F.count(F.lit(1)).alias("size"), F.sum("base").alias("base"), F.sum("tuned").alias("tuned"))
    head = per.groupBy("_g", "_s").agg(
        F.sum("size").alias("n"), F.count(F.lit(1)).alias("clusters"), (F.sum("base") / F.sum("size")).alias("base"), (F.sum("tuned") / F.sum("size")).alias("tuned"), (F.sum("total") / F.sum("size")).alias("observed"), F.bool_or(F.col("c").isNull()).alias("unnamed")
    )
    estimable = (F.col("clusters") >= min_clusters) & ~F.col("unnamed")
    units = _numbered_within(per.join(head.filter(estimable).select("_g", F.col("clusters").alias("of")), "_g"))
    found = _interval_within(_resampled_within(units, iterations, seed), iterations)
    p = F.least(F.lit(1.0), 2 * F.when(F.col("observed") >= 0, F.col("below")).otherwise(F.col("above")) / iterations)
    out = head.join(found, "_g", "left").withColumn("estimable", estimable).withColumn("p_value", p).withColumn("significant", p < 0.05).withColumn("delta", F.col("tuned") - F.col("base"))
    shown = out.select(F.col(f"_s.{by}").alias(by), "_s.overall", "n", "clusters", "base", "tuned", "delta", "observed", "estimable", "ci_low", "ci_high", "p_value", "significant")
    return shown.withColumn("verdict", verdict(F.col("delta"), F.col("significant"))).withColumn("primary", primary_verdict(F.col("ci_low"), F.col("ci_high"), margin, F.col("estimable")))


#: Repetitions that a row stands for while draws are dealt out.
CHUNK = 50


def _numbered_within(per: DataFrame) -> DataFrame:
    """_g, g (from 0 in the order of the hash of the cluster's name), of (clusters of the group), total, size: places within ranges of the hash, plus the counts of the ranges before."""
    work = per.withColumn("_k", F.sha2("c", 256)).withColumn("_b", F.substring("_k", 1, 3))
    ahead = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = work.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_n")).select("_g", "_b", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_g", "_b").orderBy("_k", "c")) + F.col("_start") - 1
    return work.join(starts, ["_g", "_b"]).select("_g", place.cast("long").alias("g"), "of", "total", "size")


def _resampled_within(units: DataFrame, iterations: int, seed: int) -> DataFrame:
    """_g, b, estimate: of each repetition within each group the drawn totals over the drawn sizes. A unit's number is also the slot of one draw in every repetition."""
    tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    chunks = F.explode(F.sequence(F.lit(0), F.lit(iterations - 1), F.lit(CHUNK)))
    slots = units.select("_g", F.col("g").alias("slot"), "of", chunks.alias("from")).repartition(tasks, "_g", "slot", "from")
    draws = slots.select("_g", "slot", "of", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + (CHUNK - 1), F.lit(iterations - 1)))).alias("b"))
    drawn = draws.select("_g", "b", draw(F.col("b"), F.col("slot"), F.col("of"), seed).alias("g"))
    return drawn.join(units.select("_g", "g", "total", "size"), ["_g", "g"]).groupBy("_g", "b").agg((F.sum("total") / F.sum("size")).alias("estimate"))


def _interval_within(estimates: DataFrame, iterations: int) -> DataFrame:
    low, high = int(0.025 * iterations), min(int(0.975 * iterations), iterations - 1)
    at = F.row_number().over(Window.partitionBy("_g").orderBy("estimate")) - 1
    end = lambda i: F.max(F.when(F.col("i") == i, F.col("estimate")))
    return estimates.withColumn("i", at).groupBy("_g").agg(end(low).alias("ci_low"), end(high).alias("ci_high"), F.count_if(F.col("estimate") <= 0).alias("below"), F.count_if(F.col("estimate") >= 0).alias("above"))


def conclusion(comparison: DataFrame) -> DataFrame:
    """One row: mixed, regressed, improved or none, from the verdicts, and whether anything regressed."""
    agg = comparison.agg(F.coalesce(F.bool_or(F.col("verdict").startswith("improved")), F.lit(False)).alias("up"), F.coalesce(F.bool_or(F.col("verdict").startswith("regressed")), F.lit(False)).alias("down"))
    return agg.select(F.when(F.col("up") & F.col("down"), "mixed").when(F.col("down"), "regressed").when(F.col("up"), "improved").otherwise("none").alias("conclusion"), F.col("down").alias("regressed"))
