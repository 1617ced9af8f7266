"""Splitting a dataset so that whole groups, or held-out values, stay together. Rows: id and what the strategy looks at; the result has a column split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.conversations import holdout_value
from ..functions.text import stable_rank

STRATEGIES = ("random", "group", "scenario_family_holdout", "entity_holdout", "domain_holdout", "format_holdout")
SPLITS = ("train", "validation", "test")
#: Column that a holdout strategy looks at.
ATTRIBUTES = {"entity_holdout": "entities", "domain_holdout": "domain", "format_holdout": "format"}


@dataclass(frozen=True)
class SplitConfig:
    strategy: str = "group"
    seed: int = 42
    train: float = 0.7
    validation: float = 0.15
    test: float = 0.15
    holdout_values: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES:
            raise ValueError(f"no such strategy: {self.strategy}")
        if abs(self.train + self.validation + self.test - 1.0) > 1e-6 or not 0 < self.train < 1 or min(self.validation, self.test) < 0:
            raise ValueError("fractions must be positive and add up to 1")


def by_rank(rank: Column, train: float, validation: float) -> Column:
    return F.when(rank < F.lit(train), "train").when(rank < F.lit(train + validation), "validation").otherwise("test")


def split_random(rows: DataFrame, config: SplitConfig) -> DataFrame:
    """Rows in the order of a seeded hash of their id, cut at whole counts: the place of a row is its place within its range of ranks plus the counts of the ranges before."""
    n = rows.count()
    first, second = int(n * config.train), int(n * config.train) + int(n * config.validation)
    work = rows.withColumn("_k", F.sha2(F.concat(F.lit(f"{config.seed}:"), F.col("id").cast("string")), 256)).withColumn("_b", F.substring("_k", 1, 3))
    sums = work.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))  # 4096 ranges at most
    starts = sums.withColumn("_s", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = F.row_number().over(Window.partitionBy("_b").orderBy("_k", "id")) + F.col("_s") - 1
    out = work.join(F.broadcast(starts.drop("_n")), "_b").withColumn("_at", at)
    return out.withColumn("split", F.when(F.col("_at") < first, "train").when(F.col("_at") < second, "validation").otherwise("test")).drop("_k", "_b", "_s", "_at")


def split_grouped(rows: DataFrame, group: Column, config: SplitConfig) -> DataFrame:
    """Whole groups by the stable rank of their name: no shuffle."""
    return rows.withColumn("split", by_rank(stable_rank(group, config.seed), config.train, config.validation))


#: Ranges of ranks over which counts are summed before they are added up.
RANGES = 4096


def held_out(rows: DataFrame, value: Column, config: SplitConfig) -> DataFrame:
    """Table of value: those named, or values in the order of their stable rank until the test fraction is reached (at least one). Counts are added up over ranges of the rank, so no task sees all values."""
    counts = rows.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total, distinct = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    if distinct < 2:
        raise ValueError("a holdout needs at least two values")
    if config.holdout_values:
        out = counts.filter(F.col("value").isin(*config.holdout_values)).select("value")
        if missing := sorted(set(config.holdout_values) - {r.value for r in out.collect()}):
            raise ValueError(f"values that do not occur: {missing}")
    else:
        target = max(1, int(total * config.test))
        known = counts.withColumn("rank", stable_rank(F.col("value"), config.seed)).withColumn("range", F.floor(F.col("rank") * RANGES))
        sums = known.groupBy("range").agg(F.sum("n").alias("sum"))
        starts = sums.select("range", F.coalesce(F.sum("sum").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
        within = F.coalesce(F.sum("n").over(Window.partitionBy("range").orderBy("rank", "value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        out = known.withColumn("within", within).join(F.broadcast(starts), "range").filter(F.col("start") + F.col("within") < target).select("value")
    if out.count() >= distinct:
        raise ValueError("nothing would be left to train on")
    return out


def split_holdout(rows: DataFrame, value: Column, group: Column, config: SplitConfig) -> DataFrame:
    """Held-out values go to test; the rest is split by group into train and validation. The table of held-out values is joined, so it may be of any length."""
    held = held_out(rows, value, config).select(F.col("value").alias("_value"), F.lit(True).alias("_held"))
    rest = config.train + config.validation
    seen = F.when(stable_rank(group, config.seed) < F.lit(config.train / rest), "train").when(stable_rank(group, config.seed) < F.lit(config.train / rest + config.validation / rest), "validation").otherwise("train")
    return rows.withColumn("_value", value).join(held, "_value", "left").withColumn("split", F.when(F.col("_held"), "test").otherwise(seen)).drop("_value", "_held")


def split_rows(rows: DataFrame, config: SplitConfig, group: Column | None = None) -> DataFrame:
    """By the configured strategy; group defaults to the first of group_id, family and id that is there."""
    own = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("group_id", "family", "id") if c in rows.columns]
    group = F.coalesce(*own) if group is None else group
    if config.strategy == "random":
        return split_random(rows, config)
    if config.strategy == "group":
        return split_grouped(rows, group, config)
    if config.strategy == "scenario_family_holdout":
        return split_grouped(rows, F.coalesce(F.nullif(F.col("family"), F.lit("")), F.col("id").cast("string")), config)
    return split_holdout(rows, holdout_value(F.col(ATTRIBUTES[config.strategy])), group, config)


def violations(split: DataFrame, group: Column) -> DataFrame:
    """One row: ids_apart (ids in two splits), groups_apart (groups in two splits), n (rows)."""
    apart = lambda key, name: split.groupBy(key.alias("k")).agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias(name))
    return apart(F.col("id"), "ids_apart").crossJoin(apart(group, "groups_apart")).crossJoin(split.agg(F.count(F.lit(1)).alias("n")))


def named(split: DataFrame, name: str) -> DataFrame:
    """The rows of one split; a name that no split has raises."""
    if name not in SPLITS:
        raise ValueError(f"no such split: {name}")
    return split.filter(F.col("split") == name)


def verify(split: DataFrame, group: Column | None = None, expected: int | None = None) -> None:
    """Raises if an id is in two splits, rows are missing, or a group lies in two splits."""
    if expected is not None and split.count() != expected:
        raise ValueError("rows were lost or added")
    apart = lambda key: split.groupBy(key.alias("k")).agg(F.count_distinct("split").alias("n")).filter("n > 1").limit(1).count()
    if apart(F.col("id")):
        raise ValueError("an id is in two splits")
    if group is not None and apart(group):
        raise ValueError("a group lies in two splits")


def split_counts(split: DataFrame) -> DataFrame:
    return split.agg(*[F.count_if(F.col("split") == s).alias(s) for s in SPLITS], F.count(F.lit(1)).alias("total"))


def group_counts(rows: DataFrame, group: Column) -> DataFrame:
    """groups, singletons."""
    return rows.groupBy(group.alias("g")).count().agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("count") == 1).alias("singletons"))
