"""Aggregates of graded results. Records: example_id, task, score, split_tag, ood_shift, group_id, subset, decision, reference_decision, perturbation_kind and others as each function says."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import guarded_ratio
from .orderstats import order_statistics

#: Change that counts as one, in score and in relative score.
STEP = 0.01


def summary_columns(value: Column, z: float = 1.96) -> list[Column]:
    """n, mean, std (of the sample, 0 for one value), minimum, maximum, ci_low, ci_high of a column, for use in agg()."""
    n, mean, std = F.count(value), F.coalesce(F.avg(value), F.lit(0.0)), F.coalesce(F.stddev_samp(value), F.lit(0.0))
    margin = F.when(n > 1, F.lit(z) * std / F.sqrt(F.greatest(n, F.lit(1)))).otherwise(0.0)
    return [n.alias("n"), mean.alias("mean"), std.alias("std"), F.coalesce(F.min(value), F.lit(0.0)).alias("minimum"), F.coalesce(F.max(value), F.lit(0.0)).alias("maximum"), (mean - margin).alias("ci_low"), (mean + margin).alias("ci_high")]


def summarize(records: DataFrame, value: str = "score", by: Sequence[str] = ()) -> DataFrame:
    return records.groupBy(*by).agg(*summary_columns(F.col(value)))


def summarize_sub_scores(records: DataFrame) -> DataFrame:
    """A row for each name in the map sub_scores."""
    return summarize(records.select(F.explode("sub_scores").alias("name", "value")), "value", ["name"])


def confusion(pairs: DataFrame, reference: str = "reference", predicted: str = "predicted") -> DataFrame:
    return pairs.groupBy(reference, predicted).agg(F.count(F.lit(1)).alias("n"))


def class_scores(pairs: DataFrame, reference: str = "reference", predicted: str = "predicted") -> DataFrame:
    """label, support, tp, fp, fn, precision, recall, f1, from one confusion table: each of its cells counts for its reference and its predicted label."""
    cells = confusion(pairs, reference, predicted)
    same = F.col(reference) == F.col(predicted)
    sides = cells.select(F.explode(F.array(F.struct(F.col(reference).alias("label"), F.when(same, F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(same, 0).otherwise(F.col("n")).alias("fn")), F.struct(F.col(predicted).alias("label"), F.lit(0).cast("long").alias("tp"), F.when(same, 0).otherwise(F.col("n")).alias("fp"), F.lit(0).cast("long").alias("fn")))).alias("c")).select("c.*")
    out = sides.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    p, r = guarded_ratio(F.col("tp"), F.col("tp") + F.col("fp")), guarded_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = out.withColumn("support", F.col("tp") + F.col("fn")).withColumn("precision", p).withColumn("recall", r)
    return out.withColumn("f1", guarded_ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def classification_scores(pairs: DataFrame, reference: str = "reference", predicted: str = "predicted") -> DataFrame:
    """accuracy, macro scores over the classes that occur in the references, micro_f1, n."""
    s = class_scores(pairs, reference, predicted)
    there = lambda c: F.coalesce(F.avg(F.when(F.col("support") > 0, F.col(c))), F.lit(0.0))
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    p, r = guarded_ratio(tp, tp + fp), guarded_ratio(tp, tp + fn)
    return s.agg(F.coalesce(F.sum("support"), F.lit(0)).alias("n"), guarded_ratio(tp, F.sum("support")).alias("accuracy"), there("precision").alias("macro_precision"), there("recall").alias("macro_recall"), there("f1").alias("macro_f1"), guarded_ratio(2 * p * r, p + r).alias("micro_f1"))


def majority(records: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """The most frequent value of each group, of equally frequent ones the first seen: by, majority, n, share."""
    counts = records.groupBy(by, value).agg(F.count(F.lit(1)).alias("c"), F.min(order).alias("o"))
    best = counts.groupBy(by).agg(F.max_by(F.col(value), F.struct(F.col("c"), -F.col("o"))).alias("majority"), F.max("c").alias("m"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("distinct"))
    return best.withColumn("share", F.col("m") / F.col("n")).drop("m")


def consistency_groups(records: DataFrame, group: str = "group_id", decision: str = "decision", order: str = "ord", reference: str | None = "reference_decision", least: int = 2) -> DataFrame:
    """Groups of at least `least` answers: n, distinct, majority, share, consistent, gradeable (has a reference), correct (consistent and equal to the first reference)."""
    known = records.filter(F.coalesce(F.col(group).cast("string"), F.lit("")) != "")
    out = majority(known, group, decision, order).filter(F.col("n") >= least)
    if reference:
        refs = known.filter(F.col(reference).isNotNull()).groupBy(group).agg(F.min_by(reference, order).alias("reference"))
        out = out.join(refs, group, "left")
    else:
        out = out.withColumn("reference", F.lit(None).cast("string"))
    same = F.col("distinct") == 1
    return out.withColumn("consistent", same).withColumn("gradeable", F.col("reference").isNotNull()).withColumn("correct", same & F.coalesce(F.col("majority") == F.col("reference"), F.lit(False)))


def consistency(groups: DataFrame) -> DataFrame:
    """groups, agreement_rate, mean_majority_share, correct_agreement_rate (over gradeable groups)."""
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.avg(F.col("consistent").cast("double")), F.lit(0.0)).alias("agreement_rate"), F.coalesce(F.avg("share"), F.lit(0.0)).alias("mean_majority_share"), F.coalesce(F.avg(F.when(F.col("gradeable"), F.col("correct").cast("double"))), F.lit(0.0)).alias("correct_agreement_rate"))


def flips(records: DataFrame, groups: DataFrame, group: str = "group_id", decision: str = "decision", kind: str = "perturbation_kind") -> DataFrame:
    """Answers that differ from their group's majority, by kind of perturbation."""
    joined = records.join(groups.select(group, "majority"), group).filter(F.col(decision) != F.col("majority"))
    return joined.groupBy(F.coalesce(F.nullif(F.col(kind).cast("string"), F.lit("")), F.lit("unspecified")).alias("kind")).agg(F.count(F.lit(1)).alias("flips"))


def ood_report(records: DataFrame) -> DataFrame:
    """One row: n and mean in and out of distribution, gap, relative_gap, measurable, worst_shift. Rows with another split_tag are ignored."""
    tag = lambda t: F.when(F.col("split_tag") == t, F.col("score"))
    both = records.agg(F.count(tag("in_distribution")).alias("n_in"), F.count(tag("ood")).alias("n_ood"), F.coalesce(F.avg(tag("in_distribution")), F.lit(0.0)).alias("in_score"), F.coalesce(F.avg(tag("ood")), F.lit(0.0)).alias("ood_score"))
    gap = F.col("in_score") - F.col("ood_score")
    both = both.withColumn("gap", gap).withColumn("relative_gap", guarded_ratio(gap, F.col("in_score"))).withColumn("measurable", (F.col("n_in") > 0) & (F.col("n_ood") > 0))
    worst = shifts(records).agg(F.min_by("ood_shift", F.struct("mean", "ood_shift")).alias("worst_shift"))
    return both.crossJoin(worst)


def shifts(records: DataFrame) -> DataFrame:
    """A row for each shift of the ood rows: summary and gap to the mean in distribution."""
    inside = records.filter("split_tag = 'in_distribution'").agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("inside"))
    out = summarize(records.filter("split_tag = 'ood' and ood_shift is not null"), by=["ood_shift"])
    return out.crossJoin(F.broadcast(inside)).withColumn("gap", F.col("inside") - F.col("mean")).drop("inside")


def direction(delta: Column) -> Column:
    return F.when(delta > STEP, "improved").when(delta < -STEP, "regressed").otherwise("no change")


def paired(left: DataFrame, right: DataFrame, order: str = "ord") -> DataFrame:
    """Two arms by example_id, of repeated ids the last: example_id, task, subset, group_id, base, tuned. Ids of one arm only are left out."""
    last = lambda df, name: df.groupBy("example_id").agg(F.max_by("score", order).alias(name), *[F.max_by(c, order).alias(c) for c in ("task", "subset", "group_id") if name == "base" and c in df.columns])
    return last(left, "base").join(last(right, "tuned"), "example_id")


def capability_delta(pairs: DataFrame, category: str = "task") -> DataFrame:
    """Means of both arms and their change for each category, and for all (category null): regressed means a relative loss of more than 1 %."""
    out = pairs.rollup(category).agg(F.count(F.lit(1)).alias("n"), F.avg("base").alias("base"), F.avg("tuned").alias("tuned"))
    delta = F.col("tuned") - F.col("base")
    return out.withColumn("delta", delta).withColumn("relative_delta", guarded_ratio(delta, F.col("base"))).withColumn("regressed", F.col("relative_delta") < -STEP)


def corrected_block(records: DataFrame) -> DataFrame:
    """Means over all, by task, by subset and by both, in one pass: task and subset are null where they are not grouped by; rows without a subset count only over all and by task."""
    sets = records.groupingSets([[], ["task"], ["subset"], ["subset", "task"]], "task", "subset").agg(F.grouping("subset").alias("_s"), F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"))
    return sets.filter((F.col("_s") == 1) | F.col("subset").isNotNull()).drop("_s")


def subset_of(confident: Column) -> Column:
    """answerable or should_decline, from a strictly boolean reference."""
    return F.when(confident, "answerable").when(~confident, "should_decline")


def nearest_rank(values: Column, fraction: float) -> Column:
    """Percentile of an array: the place is fraction * n + 0.5, rounded half to even, within 1 and n; 0 for an empty array."""
    n = F.size(values)
    place = F.greatest(F.lit(1), F.least(n, F.bround(n * F.lit(fraction) + 0.5).cast("int")))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.element_at(F.sort_array(values), F.greatest(place, F.lit(1))).cast("double"))


def distribution(rows: DataFrame, value: str, by: Sequence[str] = (), fractions: dict[str, float] | None = None) -> DataFrame:
    """n, mean, percentiles by nearest rank, max; a group's values are dealt into ranges (order_statistics)."""
    fractions = fractions or {"p50": 0.5, "p95": 0.95}
    place = lambda f: lambda n: F.greatest(F.lit(1), F.least(n, F.bround(n * F.lit(f) + 0.5).cast("long")))
    return order_statistics(rows, value, by, {name: place(f) for name, f in fractions.items()}).select(*by, "n", "mean", *fractions, "max")


def faithfulness_report(records: DataFrame) -> DataFrame:
    """Records with a struct faithfulness (see functions.extract): means of its parts and rows with fabricated citations."""
    f = F.col("faithfulness")
    return records.agg(F.count(f).alias("n"), *[F.avg(f[c]).alias(c) for c in ("evidence_coverage", "citation_precision", "unsupported_claim_rate", "score")], F.count_if(f["fabricated"] > 0).alias("with_fabricated"))


def compare_ood(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two one-row ood reports: changes of scores and gap with their verdicts."""
    both = left.select(F.struct("in_score", "ood_score", "gap").alias("l")).crossJoin(right.select(F.struct("in_score", "ood_score", "gap").alias("r")))
    out = both.select(*[(F.col(f"r.{c}") - F.col(f"l.{c}")).alias(f"{c}_delta") for c in ("in_score", "ood_score", "gap")])
    return out.withColumn("ood_verdict", direction(F.col("ood_score_delta"))).withColumn("gap_verdict", direction(-F.col("gap_delta")))
