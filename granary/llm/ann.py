"""Approximate nearest neighbours by inner product, with cross-polytope hashing.

A fast pseudo-rotation (three rounds of random signs and a Hadamard transform) is followed by the nearest signed axis: that is one function. A table's bucket is what several
functions say together, and their number follows the number of vectors, so that buckets stay small. Queries look into the `probes` buckets of each of `tables` tables whose axes have the
greatest sum of coordinates; what they meet there is ranked by exact inner products. How many probes that takes is measured on a bounded sample of queries against all rows: few where vectors
have near neighbours, more where they have no structure.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEY, join_small, materialise, release, row_key, settled

#: Tables, and axes kept of a rotation.
TABLES, AXES = 10, 64
#: Vectors of a bucket that the number of functions aims at, at least.
PER_BUCKET = 8
#: The number of probes is the least that finds this share of the true neighbours of SAMPLE queries (or all, if fewer), those with the least hash of their vector. Where that would take more than MOST_PROBES
#: buckets of a table, tables have one function less.
TARGET, SAMPLE, MOST_PROBES = 0.95, 200, 2048
#: Entries, but no more than one in eight, that every query is compared with for a bound on what can be among its k + 1 best.
BOUND_SAMPLE = 8192
#: Vectors and queries of a bucket that meet in one task at a time.
BLOCK = 4096
#: Numbers that a task holds at a time while it looks for the best buckets of some queries.
PROBE_ROOM = 1 << 21
#: Answers (k + 1 ids and scores each) that are broadcast at most.
BROADCAST_ANSWERS = 20_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotate(x: np.ndarray, table: int, function: int, seed: int, axes: int) -> np.ndarray:
    signs = np.random.default_rng([seed, table, function]).choice([-1.0, 1.0], (3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x[:, :axes]


def signed_axes(x: np.ndarray, table: int, function: int, seed: int, size: int) -> np.ndarray:
    """How far each row lies along the first size / 2 axes of a rotation and their negatives: 2 a is axis a, 2 a + 1 its negative."""
    r = rotate(x, table, function, seed, size // 2)
    return np.stack((r, -r), axis=2).reshape(len(r), -1)


def functions(n: int, dims: int, axes: int = AXES, per_bucket: float = PER_BUCKET) -> tuple[int, ...]:
    """Signed axes that each function of a table tells apart, for n vectors padded to `dims` dimensions: all axes in every function but the last, and in that one as many as the rest of n calls for."""
    full = 2 * min(axes, dims)
    out, left = [full], n / per_bucket / full
    while left >= 2:
        out.append(min(full, 1 << int(math.log2(left))))
        left /= out[-1]
    return tuple(out)


def codes(x: np.ndarray, sizes: Sequence[int], table: int, seed: int) -> np.ndarray:
    """Each row's bucket in a table: the nearest signed axes of its functions as the digits of a number."""
    out = np.zeros(len(x), np.int64)
    for j, size in enumerate(sizes):
        out = out * size + signed_axes(x, table, j, seed, size).argmax(axis=1)
    return out


def best_codes(x: np.ndarray, sizes: Sequence[int], table: int, seed: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The `probes` buckets of each row with the greatest sums of coordinates, and the sums, greatest first. The best continuations of all prefixes are those of the best prefixes, so no more are kept
    from function to function."""
    total, code = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
    for j, size in enumerate(sizes):
        along = signed_axes(x, table, j, seed, size)
        total = (total[:, :, None] + along[:, None, :]).reshape(len(x), -1)
        code = (code[:, :, None] * size + np.arange(size)).reshape(len(x), -1)
        if total.shape[1] > probes:
            top = np.argpartition(-total, probes - 1, axis=1)[:, :probes]
            total, code = np.take_along_axis(total, top, 1), np.take_along_axis(code, top, 1)
    order = np.argsort(-total, axis=1, kind="stable")
    return np.take_along_axis(code, order, 1), np.take_along_axis(total, order, 1)


def _lifted(x: np.ndarray, longest: float, even: bool, query: bool) -> np.ndarray:
    """Unit vectors, padded to a power of two, whose angles to queries order as the inner products do: unless all have one length, a further coordinate makes up what a vector lacks of the longest."""
    norm = np.sqrt((x * x).sum(axis=1))
    if even or query:
        x = x / norm[:, None]
    else:
        x = np.column_stack((x / longest, np.sqrt(np.maximum(0.0, 1.0 - (norm / longest) ** 2))))
    dims = x.shape[1] + (query and not even)
    size = 1 << max(0, int(dims - 1).bit_length())
    return np.pad(x, ((0, 0), (0, size - x.shape[1])))


def usable(vector: str) -> F.Column:
    """Neither null nor zero, and without null or non-finite components."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return x.isNotNull() & F.coalesce(~bad, F.lit(False)) & F.exists(x, lambda v: v != 0)


def true_neighbours(entries: DataFrame, sample: pd.DataFrame, k: int) -> pd.DataFrame:
    """Compare the queries of the sample with every entry, in blocks: q (place in the sample), v of its k nearest other entries. A bounded number of rows."""
    shared = entries.sparkSession.sparkContext.broadcast((np.stack(sample["v"].to_numpy()).astype(float), sample["e"].to_numpy()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y, own = shared.value
        best, who = np.full((len(y), k), -np.inf), np.zeros((len(y), k), np.int64)
        for pdf in batches:
            for a in range(0, len(pdf), BLOCK):
                x, e = np.stack(pdf["v"].to_numpy()[a : a + BLOCK]).astype(float), pdf["e"].to_numpy()[a : a + BLOCK]
                score = y @ x.T
                score[own[:, None] == e[None, :]] = -np.inf
                score, met = np.concatenate((best, score), axis=1), np.concatenate((who, np.tile(e, (len(y), 1))), axis=1)
                top = np.argpartition(-score, k - 1, axis=1)[:, :k]
                best, who = np.take_along_axis(score, top, 1), np.take_along_axis(met, top, 1)
        yield pd.DataFrame({"q": np.repeat(np.arange(len(y)), k), "e": who.ravel(), "score": best.ravel()})

    near = entries.select("e", "v").mapInPandas(run, "q long, e long, score double").filter(F.col("score") > float("-inf"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "e"))
    nearest = near.withColumn("r", rank).filter(F.col("r") <= k).select("q", "e")
    return entries.select("e", "v").join(F.broadcast(nearest), "e").select("q", "v").toPandas()


def tuned(entries: DataFrame, k: int, tables: int, sizes: tuple[int, ...], seed: int, longest: float, even: bool) -> tuple[tuple[int, ...], int]:
    """The functions (or fewer of them) and the number of probes with which TARGET of the true neighbours of SAMPLE queries are met in one table at least."""
    sample = entries.filter("q").orderBy(*KEY).select("e", "v").limit(SAMPLE).toPandas()
    near = true_neighbours(entries, sample, k) if len(sample) else sample
    if not len(near):
        return sizes[:1], 1
    y = _lifted(np.stack(sample["v"].to_numpy()).astype(float), longest, even, True)
    x, q = _lifted(np.stack(near["v"].to_numpy()).astype(float), longest, even, False), near["q"].to_numpy()
    while True:
        most = min(MOST_PROBES, math.prod(sizes))
        need = np.full(len(x), most)
        for t in range(tables):
            own = sum(along[q, signed_axes(x, t, j, seed, size).argmax(axis=1)] for j, size in enumerate(sizes) for along in [signed_axes(y, t, j, seed, size)])
            for a in range(0, len(y), 16):
                _, totals = best_codes(y[a : a + 16], sizes, t, seed, most)
                at = np.flatnonzero((q >= a) & (q < a + 16))
                need[at] = np.minimum(need[at], (totals[q[at] - a] > own[at, None] + 1e-12).sum(axis=1))
        probes = int(np.sort(need)[math.ceil(TARGET * len(need)) - 1]) + 1
        if probes <= most or len(sizes) == 1:
            return sizes, min(probes, most)
        sizes = sizes[:-1]


def usable_rows(vectors: DataFrame, is_query: F.Column) -> DataFrame:
    """vec_id, v, q (whether the row is a query) of the rows that take part."""
    kind = vectors.schema["embedding"].dataType.elementType
    v = F.col("embedding") if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col("embedding").cast("array<double>")
    return vectors.select("vec_id", v.alias("v"), is_query.alias("q")).filter(usable("v") & F.col("vec_id").isNotNull())


def index_of(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """rows: usable_rows() of one length. Two frames: the rows with k1 and k2, and the table of distinct vectors: e (a number), k1, k2, v, ids (the k + 1 smallest), q (whether any is a query)."""
    keyed = rows.select("*", *row_key("v"))
    few = keyed.select(*KEY, "vec_id", "v").withColumn("r", F.dense_rank().over(Window.partitionBy(*KEY).orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    entries = few.groupBy(*KEY).agg(F.sort_array(F.collect_set("vec_id")).alias("ids"), F.first("v").alias("v"))
    asked = keyed.filter("q").groupBy(*KEY).agg(F.lit(True).alias("q"))
    return keyed, materialise(entries.join(asked, KEY, "left").withColumn("e", F.monotonically_increasing_id()), "entries")


def probes_of(own: np.ndarray, last: int) -> pa.ListArray:
    """Rows of bucket numbers as lists of structs of c (what all functions but the last say) and f (what the last one says there, of `last` answers): made from flat arrays, so that a bucket takes a few bytes."""
    own = np.sort(own, axis=1)
    c = own - own % last
    new = np.ones(own.shape, bool)
    new[:, 1:] = c[:, 1:] != c[:, :-1]
    starts = np.flatnonzero(new)
    f = pa.ListArray.from_arrays(pa.array(np.append(starts, own.size), pa.int32()), pa.array((own % last).ravel(), pa.int32()))
    structs = pa.StructArray.from_arrays([pa.array(c.ravel()[starts]), f], ["c", "f"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(new.sum(axis=1)))), pa.int32()), structs)


def buckets(entries: DataFrame, k: int, tables: int = TABLES, probes: int | None = None, axes: int = AXES, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Two tables: every entry with its buckets (e, v, least, b: one c, f a table) and every entry that is asked for with the buckets it looks into, a row for each of the tables (e, v, b: c and the array f, bound: no more than its (k + 1)-th best score). c numbers a table
    and what all functions but the last say, f what the last one says."""
    norm = F.sqrt(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))
    n, dims, low, high = entries.agg(F.count(F.lit(1)), F.max(F.size("v")), F.min(norm), F.max(norm)).first()
    even = high - low <= 1e-6 * high
    sizes = functions(n, 1 << max(0, int(dims + (not even) - 1).bit_length()), axes)
    if probes is None:
        sizes, probes = tuned(entries, k, tables, sizes, seed, high, even)
    last = sizes[-1] if len(sizes) > 1 else 1
    each = math.prod(sizes) // last

    @F.pandas_udf("array<long>")
    def held(v: pd.Series) -> pd.Series:
        x = _lifted(np.stack(v.to_numpy()).astype(float), high, even, False)
        return pd.Series(list(np.stack([codes(x, sizes, t, seed) + t * each * last for t in range(tables)], axis=1)))

    few = min(BOUND_SAMPLE, n // 8)
    shared = None
    if few > k:
        some = np.stack(entries.orderBy(*KEY).select("v").limit(few).toPandas()["v"].to_numpy()).astype(float)
        shared = entries.sparkSession.sparkContext.broadcast(some)

    def bound(y: np.ndarray) -> np.ndarray:
        if shared is None:
            return np.full(len(y), -np.inf)
        return np.partition(y @ shared.value.T, few - k - 1, axis=1)[:, few - k - 1] - 1e-10 * high * np.sqrt((y * y).sum(axis=1))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in (batch.slice(a, rows) for a in range(0, batch.num_rows, rows)):
                y = np.asarray(some.column(1).flatten()).astype(float).reshape(len(some), -1)
                x, bounds = _lifted(y, high, even, True), pa.array(bound(y))
                own = pa.concat_arrays([probes_of(best_codes(x, sizes, t, seed, probes)[0] + t * each * last, last) for t in range(tables)])
                # a query's tables lie side by side: its vector, repeated, is compressed where it is shuffled
                row = np.repeat(np.arange(len(x)), tables)
                e, v, least = (c.take(pa.array(row)) for c in (*some.columns, bounds))
                yield pa.RecordBatch.from_arrays([e, v, own.take(pa.array(np.arange(tables * len(x)).reshape(tables, -1).T.ravel())), least], ["e", "v", "b", "bound"])

    # a step from function to function tells `probes` prefixes and all axes apart
    rows = max(1, min(64, PROBE_ROOM // (min(probes, math.prod(sizes)) * max(sizes))))
    index = materialise(entries.select("e", "v", F.col("ids")[0].alias("least"), held("v").alias("b")), "codes")
    index = index.withColumn("b", F.transform("b", lambda x: F.struct((x - x % last).alias("c"), (x % last).cast("int").alias("f"))))
    asked = entries.filter("q").select("e", "v")
    kind = asked.schema["v"].dataType.simpleString()
    probed = materialise(asked.mapInArrow(wanted, f"e long, v {kind}, b array<struct<c: long, f: array<int>>>, bound double"), "probed")
    return index, probed


def scored(index: DataFrame, probed: DataFrame) -> int:
    """Inner products that the probes call for, over all queries."""
    own = index.select(F.explode("b").alias("b")).groupBy("b.c", "b.f").agg(F.count(F.lit(1)).alias("n"))
    asked = probed.select(F.explode("b").alias("b")).select("b.c", F.explode("b.f").alias("f")).groupBy("c", "f").agg(F.count(F.lit(1)).alias("m"))
    return own.join(asked, ["c", "f"]).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0


def search(vectors: DataFrame, is_query: F.Column, k: int = 20, tables: int = TABLES, probes: int | None = None, axes: int = AXES, seed: int = 7) -> DataFrame:
    """vectors: vec_id, embedding. For every row for which is_query holds the k rows of other ids with the largest inner products that its probes met: query_id, rank (from 1),
    vec_id, score (in double precision), nearest first, ties to the smaller vec_id.

    Equal vectors are one entry with its k + 1 smallest ids, which is all that any answer can show of them; so copies cost nothing. Every entry is indexed. A bucket with
    many entries or queries meets in blocks, each of which hands on its k + 1 best an entry, ties to the entry of the smaller id; what is below the bound that a sample of the entries sets for a query is not handed
    on, and queries of which that leaves fewer than k + 1 are asked again without it. Vectors of different lengths have no inner product: each
    length is searched among its own. Vectors that are not usable() take no part; repeated rows of an id and vector count once; fewer candidates than k give fewer rows; an empty table gives none. Other columns are not
    read, whatever their names."""
    spark = vectors.sparkSession
    rows = usable_rows(vectors, is_query)
    lengths = sorted(r["d"] for r in rows.select(F.size("v").alias("d")).distinct().collect())
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.union, [_search(rows.filter(F.size("v") == d), k, tables, probes, axes, seed) for d in lengths])


def _search(rows: DataFrame, k: int, tables: int, probes: int | None, axes: int, seed: int) -> DataFrame:
    keyed, entries = index_of(rows, k)
    answers = settled("answers", lambda: _answers(entries, k, tables, probes, axes, seed))
    release(entries)
    queries = keyed.filter("q").select(F.col("vec_id").alias("query_id"), *KEY).distinct()
    queries = join_small(queries, answers, KEY, "inner", rows=BROADCAST_ANSWERS)
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return queries.select("query_id", F.posexplode(others).alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def _answers(entries: DataFrame, k: int, tables: int, probes: int | None, axes: int, seed: int) -> DataFrame:
    """k1, k2 of each entry that is asked for, near: r, vec_id, score of its k + 1 nearest ids, its own among them."""
    index, probed = buckets(entries, k, tables, probes, axes, seed)
    near = materialise(_near(entries, index, probed, k), "near")
    whole = near.filter(F.size("near") > k)
    short = materialise(probed.filter(F.col("bound") > float("-inf")).join(whole.select(F.col("q").alias("e")), "e", "left_anti").withColumn("bound", F.lit(float("-inf"))), "short")
    if short.limit(1).count():
        near = near.join(short.select(F.col("e").alias("q")), "q", "left_anti").union(_near(entries, index, short, k))
    return entries.filter("q").select(*KEY, F.col("e").alias("q")).join(near, "q").drop("q")


def _near(entries: DataFrame, index: DataFrame, probed: DataFrame, k: int) -> DataFrame:
    """q, near: of each entry that is asked for what _answers() says, from the buckets of both."""
    left = index.select("e", "v", "least", F.explode("b").alias("b")).select("e", "v", "least", "b.c", "b.f")
    right = probed.select("e", "v", "bound", F.explode("b").alias("b")).select(F.col("e").alias("asked"), F.col("v").alias("w"), "bound", F.col("b.c").alias("c"), F.col("b.f").alias("fs"))
    counts = index.select(F.explode("b.c").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).join(probed.select(F.explode("b.c").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("m")), "c")
    blocks = materialise(counts.select("c", F.ceil(F.col("n") / BLOCK).cast("int").alias("cn"), F.ceil(F.col("m") / BLOCK).cast("int").alias("qn")), "blocks")
    deal = lambda e, n: F.pmod(F.xxhash64(e), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = join_small(left, blocks, "c", "inner").withColumn("x", deal("e", "cn")).withColumn("y", every("qn")).drop("cn", "qn")
    right = join_small(right, blocks, "c", "inner").withColumn("y", deal("asked", "qn")).withColumn("x", every("cn"))
    right = right.select("asked", "w", "bound", "fs", *[F.col(c).alias(f"{c}2") for c in ("c", "x", "y")])

    def meet(have: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame({"q": [], "e": [], "score": []}).astype({"q": "int64", "e": "int64"})
        if not len(have) or not len(want):
            return nothing
        have = have.sort_values(["f", "least"], kind="stable")
        x, y = np.stack(have["v"].to_numpy()).astype(float), np.stack(want["w"].to_numpy()).astype(float)
        f, ids, least = have["f"].to_numpy(), have["e"].to_numpy(), have["least"].to_numpy()
        room = 1e-10 * np.sqrt((x * x).sum(axis=1).max() * (y * y).sum(axis=1))
        asks = np.concatenate(want["fs"].to_list())
        who = np.repeat(np.arange(len(y)), want["fs"].map(len).to_numpy())
        least_score = want["bound"].to_numpy()
        order = np.argsort(asks, kind="stable")
        asks, who = asks[order], who[order]
        qs, xs, scores = [], [], []
        for code in np.unique(f).tolist():
            a, b = np.searchsorted(f, (code, code + 1)).tolist()
            own = who[slice(*np.searchsorted(asks, (code, code + 1)))]
            for at in range(0, len(own), 256):
                some = own[at : at + 256]
                near = y[some] @ x[a:b].T
                bound = least_score[some]
                if b - a > k + 1:
                    # products of a matrix are rounded differently: what is as near as rounding to the last one kept is compared exactly below
                    bound = np.maximum(bound, np.partition(near, b - a - k - 1, axis=1)[:, b - a - k - 1] - room[some])
                r, c = np.nonzero(near >= bound[:, None])
                qs.append(some[r])
                xs.append(a + c)
        if not sum(map(len, qs)):
            return nothing
        q, e = np.concatenate(qs), np.concatenate(xs)
        for at in range(0, len(q), 1 << 14):
            part = slice(at, at + (1 << 14))
            scores.append((x[e[part]] * y[q[part]]).sum(axis=1))
        score = np.concatenate(scores)
        order = np.lexsort((least[e], -score, q))
        q, e, score = q[order], e[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        best = place <= k
        return pd.DataFrame({"q": want["asked"].to_numpy()[q[best]], "e": ids[e[best]], "score": score[best]})

    met = left.groupBy("c", "x", "y").cogroup(right.groupBy("c2", "x2", "y2")).applyInPandas(meet, "q long, e long, score double").groupBy("q", "e").agg(F.max("score").alias("score"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    # every entry has an id at least: an entry with k + 1 better ones has no place among the ids
    met = met.withColumn("r", F.rank().over(Window.partitionBy("q").orderBy(F.desc("score")))).filter(F.col("r") <= k + 1).drop("r")
    named = met.join(entries.select("e", F.explode("ids").alias("vec_id")), "e").withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1)
    return named.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
