"""Clustering around centroids by column expressions alone.

Vectors are made integers once and stored. A round is one scan: the centroids are literal arrays, zip_with and aggregate give the squared distance to each, the least struct of (distance, number)
chooses, and one sum a component and cluster, added up per task before the shuffle, gives the next centroids. What reaches the driver in a round is `k` rows of sums, whatever the table's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, quoted

DIMENSIONS = 64
CLUSTERS = 8
ROUNDS = 10
#: A component x becomes floor(SCALE * x).
SCALE = 1024
#: What the hash that chooses the first centroids starts with.
SEED = 3
#: Components up to this size (as integers) have distances that a long holds, for up to 64 of them.
LARGEST = 1 << 27


def _whole(vector: Column, dimensions: int, scale: float, largest: int) -> Column:
    """The vector as longs, or null where it takes no part."""
    fits = F.size(vector) == dimensions
    # a comparison with NaN or a null gives no true: NaN counts as larger than any number, so both ends are asked for
    finite = F.forall(vector, lambda x: x.isNotNull() & (x > float("-inf")) & (x < float("inf")))
    small = F.forall(vector, lambda x: F.abs(x.cast("double") * scale) < largest)
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    said = F.raise_error(F.lit(f"a component of a vector is {largest / scale:g} or more: its squared distances do not fit a long"))
    return F.when(fits & finite, F.when(small, whole).otherwise(said.cast("array<long>")))


def nearest(vector: str, centroids: Sequence[Sequence[int]]) -> Column:
    """Struct of distance (long) and cluster (int): the centroid nearest to the column `vector`, the one with the smaller number among equals.

    One expression in SQL text: a call for each of clusters x dimensions numbers would cost more than the scan of a small table."""
    array = lambda c: f"array({', '.join(f'{int(x)}L' for x in c)})"
    distance = lambda c: f"aggregate(zip_with({vector}, {array(c)}, (a, b) -> (a - b) * (a - b)), 0L, (s, x) -> s + x)"
    return F.expr(f"array_min(array({', '.join(f"named_struct('distance', {distance(c)}, 'cluster', {i})" for i, c in enumerate(centroids))}))")


def _key(column: str, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.lit(""))).cast("binary"), 256)


def updated(work: DataFrame, centroids: Sequence[Sequence[int]]) -> list[list[int]]:
    """One round over work (`vector`): each centroid with vectors becomes their mean, rounded down in each component; the others stay."""
    dimensions = range(len(centroids[0]))
    # of 2^36 vectors and more with components of the largest size a long would run over, which is an error and no wrong sum
    sums = [F.expr(f"sum(vector[{i}]) AS s{i}") for i in dimensions]
    rows = work.select("vector", nearest("vector", centroids)["cluster"].alias("cluster")).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect()
    out = [list(c) for c in centroids]
    for r in rows:  # at most one row a centroid
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in dimensions]
    return out


def cluster(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: float = SCALE, seed: int = SEED, keep: Sequence[str] = ()) -> DataFrame:
    """Cluster the vectors that have exactly `dimensions` components, none of them null or non-finite. Component x becomes the integer floor(scale * x), x as double.

    The first centroids are the `clusters` vectors with the smallest hexadecimal sha256 of `<seed>:<id>`, in that order. A round gives every vector to its nearest centroid (squared Euclidean distance, the smaller
    number among equals) and replaces each centroid that has vectors by floor(sum / count) of each component. After the last round vectors are given to their nearest once more.

    Returns a row a vector that takes part: the id, cluster (int), distance (long, squared), cluster_inertia and inertia (long, distances summed over its cluster and over all), centroid_sha256 (of its final
    centroid's components, as decimals joined by commas), and the columns of `keep`, which must not have one of these names. Other columns of vectors are not read.

    Null, short, long and non-finite vectors have no row. A null id is hashed as an empty one. Repeated rows and ids are vectors of their own; among equal hashes the smaller vector comes first. Fewer vectors than
    `clusters` make as many clusters as there are vectors; an empty table gives an empty result. Components of 2^27 / scale and more (131,072 by default) raise an error: a long could not hold their distances."""
    clash = {id_column, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"} & set(keep)
    if clash:
        raise ValueError(f"columns of the result: {sorted(clash)}")
    row = F.struct(*[F.col(quoted(c)) for c in (id_column, *keep)]).alias("row")
    whole = vectors.select(row, _key(quoted(id_column), seed).alias("key"), _whole(F.col(quoted(vector_column)), dimensions, scale, LARGEST).alias("vector"))
    work = materialise(whole.filter(F.col("vector").isNotNull()), "vectors")
    centroids = [list(r["vector"]) for r in work.select("key", "vector").orderBy("key", "vector").limit(clusters).collect()]
    if not centroids:
        digests, sums = [""], [0]
        chosen = work.withColumn("near", F.struct(F.lit(0).cast("long").alias("distance"), F.lit(0).alias("cluster")))
    else:
        for _ in range(rounds):
            centroids = updated(work, centroids)
        digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
        chosen = materialise(work.select("row", nearest("vector", centroids).alias("near")), "chosen")
        per = {r["cluster"]: int(r["s"]) for r in chosen.groupBy("near.cluster").agg(F.sum(F.col("near.distance").cast("decimal(38,0)")).alias("s")).collect()}
        sums = [per.get(i, 0) for i in range(len(centroids))]
    of = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("near.cluster") + 1)
    out = [F.col(f"row.{quoted(c)}") for c in (id_column, *keep)]
    return chosen.select(
        out[0],
        "near.cluster",
        "near.distance",
        of(sums, "long").alias("cluster_inertia"),
        F.lit(sum(sums)).cast("long").alias("inertia"),
        of(digests, "string").alias("centroid_sha256"),
        *out[1:],
    )
