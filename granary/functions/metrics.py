"""Column functions that score an answer, a set or a ranking. Items are expected in their normal form."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def let(value: Column, use) -> Column:
    """use(value) with value computed once a row, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def exact_match(prediction: Column, reference: Column) -> Column:
    return (prediction == reference).cast("double")


def f1_of(overlap: Column, predicted: Column, expected: Column) -> Column:
    return F.when(overlap == 0, F.lit(0.0)).otherwise(2.0 * (overlap / F.greatest(predicted, F.lit(1))) * (overlap / F.greatest(expected, F.lit(1))) / (overlap / F.greatest(predicted, F.lit(1)) + overlap / F.greatest(expected, F.lit(1))))


def tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda x: x != "")


def _runs(sorted_items: Column) -> Column:
    """Distinct items of a sorted array with their counts."""
    starts = F.filter(F.sequence(F.lit(0), F.size(sorted_items) - 1), lambda i: (i == 0) | (F.get(sorted_items, i) != F.get(sorted_items, i - 1)))
    counted = let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(sorted_items, i).alias("t"), (F.coalesce(F.get(at, k + 1), F.size(sorted_items)) - i).alias("n"))))
    return F.when(F.size(sorted_items) > 0, counted).otherwise(F.array().cast("array<struct<t:string,n:int>>"))


def token_f1(prediction: Column, reference: Column) -> Column:
    """F1 of the common tokens of two normalised texts, counted with repeats: both sides' counts are sorted together, and a token of both stands next to itself."""

    def score(s: Column) -> Column:
        p, r = F.size(s["p"]), F.size(s["r"])
        both = F.array_sort(F.concat(let(s["p"], _runs), let(s["r"], _runs)))
        common = let(both, lambda x: F.aggregate(F.transform(x, lambda y, i: F.when(y["t"] == F.get(x, i + 1)["t"], F.least(y["n"], F.get(x, i + 1)["n"])).otherwise(0)), F.lit(0), lambda acc, n: acc + n))
        return F.when((p == 0) | (r == 0), (p == r).cast("double")).otherwise(let(common, lambda c: f1_of(c, p, r)))

    return let(F.struct(F.sort_array(tokens(prediction)).alias("p"), F.sort_array(tokens(reference)).alias("r")), score)


@F.pandas_udf(T.DoubleType())
def token_f1_long(prediction: pd.Series, reference: pd.Series) -> pd.Series:
    """token_f1() of long texts (null: empty), whose tokens are counted in a table."""
    out = []
    for a, b in zip(prediction, reference, strict=True):
        x, y = (Counter(w for w in (t or "").split(" ") if w) for t in (a, b))
        p, r, common = x.total(), y.total(), sum((x & y).values())
        out.append(float(p == r) if not p or not r else 0.0 if not common else 2.0 * (common / p) * (common / r) / (common / p + common / r))
    return pd.Series(out, dtype="float64")


def token_counts(rows: DataFrame, key: str, normalized: Column) -> DataFrame:
    """key, token (its 64-bit hash, so that what is grouped and joined is two numbers), n: how often each token of a normalised text occurs; a text without tokens has one row with a null token and n 0. Two tokens of one
    pair of texts that share a hash would count as one: for texts of a million tokens once in ten million pairs."""
    hashed = F.transform(tokens(normalized), lambda t: F.xxhash64(t))
    return rows.select(key, F.explode_outer(hashed).alias("token")).groupBy(key, "token").agg(F.count("token").alias("n"))


def token_f1_rows(predictions: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """key, f1 of texts given as token_counts(): the same as token_f1(), by joins and aggregations, for long texts or many."""
    size = lambda rows, name: rows.groupBy(key).agg(F.sum("n").alias(name))
    common = predictions.join(references.withColumnRenamed("n", "m"), [key, "token"]).groupBy(key).agg(F.sum(F.least("n", "m")).alias("c"))
    both = size(predictions, "p").join(size(references, "r"), key).join(common, key, "left").fillna(0, ["c"])
    f1 = F.when((F.col("p") == 0) | (F.col("r") == 0), (F.col("p") == F.col("r")).cast("double")).otherwise(f1_of(F.col("c"), F.col("p"), F.col("r")))
    return both.select(key, f1.alias("f1"))


def set_scores(predicted: Column, reference: Column) -> Column:
    """Struct of precision, recall and f1 of two arrays taken as sets."""

    def score(s: Column) -> Column:
        p, r = F.size(s["p"]), F.size(s["r"])
        common = F.size(F.array_intersect(s["p"], s["r"]))
        usual = F.struct((common / F.greatest(p, F.lit(1))).alias("precision"), (common / F.greatest(r, F.lit(1))).alias("recall"), f1_of(common, p, r).alias("f1"))
        fixed = lambda a, b, c: F.struct(F.lit(a).alias("precision"), F.lit(b).alias("recall"), F.lit(c).alias("f1"))
        return F.when((r == 0) & (p == 0), fixed(1.0, 1.0, 1.0)).when(r == 0, fixed(0.0, 1.0, 0.0)).when(p == 0, fixed(0.0, 0.0, 0.0)).otherwise(usual)

    return let(F.struct(F.array_distinct(predicted).alias("p"), F.array_distinct(reference).alias("r")), score)


def _last(items: Column, x: Column) -> Column:
    """Place (from 0) of the last occurrence."""
    return F.size(items) - F.array_position(F.reverse(items), x).cast("int")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dcg(relevances: Column) -> Column:
    return _sum(F.transform(relevances, lambda x, i: x / F.log2(i + 2.0)))


def ndcg(predicted: Column, ideal: Column, k: int | None = None) -> Column:
    """Linear gains (a repeated ideal item has that of its last place), each item credited once, cut at k or the ideal's length."""

    def score(s: Column) -> Column:
        p, r = s["p"], s["r"]
        n = F.lit(k) if k else F.size(r)
        gain = lambda x: F.when(F.array_contains(r, x), (F.size(r) - _last(r, x)).cast("double")).otherwise(0.0)
        got = F.transform(F.slice(p, F.lit(1), n), lambda x, i: F.when(F.array_position(p, x) == i + 1, gain(x)).otherwise(0.0))
        best = F.slice(F.sort_array(F.transform(F.array_distinct(r), gain), asc=False), F.lit(1), n)
        return F.when(F.size(r) == 0, F.lit(0.0)).otherwise(dcg(got) / dcg(best))

    return let(F.struct(predicted.alias("p"), ideal.alias("r")), score)


def kendall_tau(predicted: Column, reference: Column) -> Column:
    """Agreement of the order of common items, from 0 to 1; 0.5 if there are fewer than two, or no pair is ordered by both. Repeated items rank by their last place."""

    def score(s: Column) -> Column:
        p, r = s["p"], s["r"]
        common = F.filter(r, lambda x: F.array_contains(p, x))
        ranks = F.transform(common, lambda x: F.struct(_last(p, x).alias("p"), _last(r, x).alias("r")))

        def pairs(c: Column) -> Column:
            signs = F.flatten(F.transform(c, lambda x, i: F.transform(F.slice(c, i + 2, F.size(c)), lambda y: F.signum((x["p"] - y["p"]) * (x["r"] - y["r"])))))
            return let(signs, lambda g: let(_sum(F.transform(g, lambda v: F.abs(v))), lambda n: F.when(n == 0, F.lit(0.5)).otherwise((_sum(g) / F.greatest(n, F.lit(1.0)) + 1.0) / 2.0)))

        return F.when(F.size(common) < 2, F.lit(0.5)).otherwise(let(ranks, pairs))

    return let(F.struct(predicted.alias("p"), reference.alias("r")), score)


def footrule(predicted: Column, reference: Column) -> Column:
    """1 less the summed displacement of common items over its greatest value; 0 if nothing is common."""

    def score(s: Column) -> Column:
        p, r = s["p"], s["r"]
        common = F.array_intersect(r, p)
        moved = _sum(F.transform(common, lambda x: F.abs(_last(r, x) - _last(p, x)).cast("double")))
        most = F.when(F.size(r) > 1, F.floor(F.size(r) * F.size(r) / 2)).otherwise(1)
        return F.when(F.size(common) == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - moved / most))

    return let(F.struct(predicted.alias("p"), reference.alias("r")), score)


def top_1(predicted: Column, reference: Column) -> Column:
    return F.coalesce((F.get(predicted, F.lit(0)) == F.get(reference, F.lit(0))).cast("double"), F.lit(0.0))


def guarded_ratio(value: Column, base: Column) -> Column:
    """value / base, 0 where the base is 0."""
    return F.coalesce(F.try_divide(value, F.nullif(base, F.lit(0))), F.lit(0.0))
