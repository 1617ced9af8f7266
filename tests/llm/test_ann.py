import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import ann
from granary.llm.ann import best_codes, buckets, codes, functions, hadamard, index_of, scored, search, signed_axes, usable_rows


def brute(rows, k):
    """rows: (vec_id, vector)."""
    x = np.array([v for _, v in rows], float)
    ids = np.array([i for i, _ in rows])
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            s = (x * np.array(v, float)).sum(axis=1)
            order = sorted((-round(a, 9), j) for a, j in zip(s.tolist(), ids.tolist(), strict=True) if j != i)
            out[i] = [(j, -a) for a, j in order[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v if v is None else [None if x is None else float(x) for x in v], 1) for i, v in rows], "vec_id long, embedding array<float>, e int").repartition(3)


def ask(spark, rows, **options):
    got = {}
    for r in search(frame(spark, rows), F.col("vec_id") % 20 == 0, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 6)))
        assert r["rank"] == len(got[r.query_id])
    return got


def test_rotation_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 64))
    assert np.allclose((hadamard(x) ** 2).sum(axis=1), (x**2).sum(axis=1))


def test_functions_follow_the_number_of_vectors():
    assert functions(500, 64) == (128,) and functions(10_000, 64) == (128, 8) and functions(51_282, 64) == (128, 32)
    assert functions(10**9, 64) == (128, 128, 128, 32) and functions(10**4, 8) == (16, 16, 4)
    for n in (10**3, 10**5, 10**8):
        assert n / math.prod(functions(n, 64)) < 4 * ann.PER_BUCKET


@pytest.mark.parametrize("sizes", [(16,), (16, 4), (16, 16, 8)])
def test_best_codes_are_those_of_all_sums(sizes):
    x = np.random.default_rng(5).normal(size=(7, 16))
    along = [signed_axes(x, 2, j, 1, s) for j, s in enumerate(sizes)]
    total = np.zeros((7, 1))
    for a in along:
        total = (total[:, :, None] + a[:, None, :]).reshape(7, -1)
    got, sums = best_codes(x, sizes, 2, 1, 12)
    assert np.allclose(sums, -np.sort(-total, axis=1)[:, :12]) and np.allclose(np.take_along_axis(total, got, 1), sums)
    assert (got[:, 0] == codes(x, sizes, 2, 1)).all()


def test_recall_without_structure(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = ask(spark, rows), brute(rows, 20)
    assert got.keys() == want.keys()
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found >= 0.9 * sum(map(len, want.values()))
    scores = {(q, i): s for q in want for i, s in want[q]}
    assert all(abs(s - scores[q, i]) < 1e-5 for q in got for i, s in got[q] if (q, i) in scores)


def test_lengths_differ(spark):
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(1500, 20)) * rng.lognormal(0, 0.5, (1500, 1))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = ask(spark, rows), brute(rows, 20)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_copies_ties_and_unusable(spark):
    rng = np.random.default_rng(3)
    hot = rng.normal(size=8).astype(np.float32).tolist()
    rows = [(i, hot) for i in range(200)] + [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(200, 260)]
    bad = [(300, None), (320, [0.0] * 8), (340, [None] + [1.0] * 7), (360, [float("nan")] * 8), (380, [float("inf")] + [0.0] * 7)]
    got, want = ask(spark, rows + bad, tables=20, probes=16), brute(rows, 20)
    assert got.keys() == want.keys()
    for q in range(0, 200, 20):
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] == [i for i in range(22) if i != q][:20]


def test_each_length_is_searched_among_its_own(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=(3, 5, 8)[i % 3]).tolist()) for i in range(240)]
    got = ask(spark, rows, tables=20, probes=64)
    want = {}
    for d in range(3):
        want |= brute([r for r in rows if r[0] % 3 == d], 20)
    assert got.keys() == want.keys() == set(range(0, 240, 20))
    assert all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in want)


def test_few_and_none(spark):
    assert ask(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], probes=4) == {0: [(2, 1.0), (1, 0.0)]}
    assert ask(spark, [(0, None)]) == {}
    assert ask(spark, [(0, [1.0, 0.0])]) == {}
    assert ask(spark, [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0])]) == {0: [(1, 1.0)]}


def test_ties_beyond_any_number_go_to_the_smaller_id(spark):
    """One-hot vectors: hundreds of distinct vectors of equal score; and where products differ by rounding only."""
    rng = np.random.default_rng(4)
    rows = [(i, [1.0 if j == i % 3 else 0.0 for j in range(3)] + [float(i), 0.0]) for i in range(300)]
    rows = [(i, [*v[:3], 0.0, v[3] if i % 20 else 0.0]) for i, v in rows]
    rng.shuffle(rows)
    got, want = ask(spark, rows, tables=12, probes=64), brute(rows, 20)
    assert {q: [i for i, _ in r] for q, r in got.items()} == {q: [i for i, _ in r] for q, r in want.items()}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_registered_table(spark, sf):
    from granary.llm.queries import op5_cross_polytope

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    want = brute(rows, 20)
    got = {}
    for r in op5_cross_polytope(spark, f"/root/testdata/{sf}").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert got.keys() == want.keys()
    assert sum(len(got[q] & {i for i, _ in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_scored_share_falls(spark):
    """Vectors with near neighbours: the share of them that a query is compared with falls as their number grows."""
    share = []
    for n in (2_000, 16_000):
        rng = np.random.default_rng(9)
        centres = rng.normal(size=(n // 40, 32))
        x = centres[rng.integers(0, len(centres), n)] + 0.35 * rng.normal(size=(n, 32))
        table = frame(spark, [(i, v) for i, v in enumerate(x.tolist())])
        _, entries = index_of(usable_rows(table, F.col("vec_id") % 20 == 0), 20)
        index, probed = buckets(entries, 20)
        share.append(scored(index, probed) / probed.count() / n)
    assert share[1] < 0.6 * share[0]


def test_queries_short_of_answers_are_asked_again(spark, monkeypatch):
    """A bound that is far too high leaves queries with too few answers: they get those that they would have had without it."""
    rng = np.random.default_rng(8)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(600, 12)).tolist())]
    plain = ask(spark, rows, probes=24)
    real = ann.buckets

    def high(*args, **options):
        index, probed = real(*args, **options)
        return index, probed.withColumn("bound", F.when(F.col("e") % 2 == 0, 1e9).otherwise(F.col("bound")))

    monkeypatch.setattr(ann, "buckets", high)
    assert ask(spark, rows, probes=24) == plain


def test_probes_are_flat_lists():
    own = np.array([[9, 2, 3, 8], [4, 5, 0, 1]])
    assert ann.probes_of(own, 4).to_pylist() == [[{"c": 0, "f": [2, 3]}, {"c": 8, "f": [0, 1]}], [{"c": 0, "f": [0, 1]}, {"c": 4, "f": [0, 1]}]]
    # 64 queries of 2048 buckets each, no two in one list: a Python object each would take over 50 MB
    wide = ann.probes_of(np.arange(64 * 2048).reshape(64, 2048), 1)
    assert wide.nbytes < 4 << 20


def test_probed_rows_are_small(spark):
    """A row of the probes is of one table: what a reader holds at a time does not grow with the number of tables."""
    x = np.random.default_rng(4).normal(size=(400, 16))
    _, entries = index_of(usable_rows(frame(spark, list(enumerate(x.tolist()))), F.col("vec_id") % 20 == 0), 5)
    _, probed = buckets(entries, 5, probes=16)
    assert probed.count() == 20 * ann.TABLES and probed.select(F.max(F.aggregate("b", F.lit(0), lambda n, b: n + F.size(b["f"])))).first()[0] == 16
