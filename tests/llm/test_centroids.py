import hashlib
import math

import pytest

from granary.llm.centroids import cluster

KIND = "vec_id long, embedding array<float>, label int, cluster string, row string"


def brute(rows, k=8, rounds=10, dims=64):
    """(vec_id, vector) pairs to result rows, in plain Python."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    key = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centroids = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, centroids, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    sums = [sum(d for _, d, c in found if c == j) for j in range(len(centroids))]
    return sorted(((i, c, d, sums[c], sum(sums), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, d, c in found), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


@pytest.fixture(scope="session")
def rows():
    import random

    rng = random.Random(11)
    f = lambda n=64: [rng.choice([-1, 1]) * rng.random() for _ in range(n)]
    same, out = f(), [(i, f()) for i in range(60)]
    out += [(100 + i, same) for i in range(30)]
    out += [(200, None), (201, []), (202, f(63)), (203, f(65)), (204, [*f(63), None]), (205, [*f(63), float("nan")]), (206, [*f(63), float("inf")]), (207, [*f(63), float("-inf")])]
    out += [(None, f()), (300, [0.0] * 64), (300, [0.0] * 64), (301, [-0.0] * 64), (302, [-1e-6] * 64), (303, [100.0] * 64)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", "r") for i, v in rows], KIND)


def test_equals_brute_force(spark, rows):
    df = frame(spark, rows).repartition(3)
    as_stored = [(r.vec_id, r.embedding) for r in df.collect()]
    assert got(cluster(df)) == brute(as_stored)


def test_few_vectors_and_none(spark, rows):
    assert got(cluster(frame(spark, rows[:3]))) == brute([(i, [float(x) for x in v]) for i, v in [(r.vec_id, r.embedding) for r in frame(spark, rows[:3]).collect()]])
    empty = cluster(frame(spark, rows).filter("false"))
    assert empty.count() == 0 and empty.dtypes == cluster(frame(spark, rows[:3])).dtypes
    assert cluster(frame(spark, [(1, None), (2, [1.0])])).count() == 0


def test_empty_clusters_stay(spark):
    rows = [(i, [float(i // 10)] * 2) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(cluster(df, clusters=6, dimensions=2)) == brute(rows, k=6, dims=2)


def test_columns_kept(spark, rows):
    df = frame(spark, rows[:5]).withColumnRenamed("cluster", "a.b")
    out = cluster(df, keep=("a.b", "row"))
    assert {(r["a.b"], r["row"]) for r in out.collect()} == {("c", "r")}
    with pytest.raises(ValueError):
        cluster(frame(spark, rows), keep=("cluster",))


def test_large_components_are_refused(spark):
    df = spark.createDataFrame([(1, [200_000.0, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="do not fit a long"):
        cluster(df, dimensions=2).collect()


def test_no_python_on_executors(spark, rows):
    plan = cluster(frame(spark, rows[:9]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
