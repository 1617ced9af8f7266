"""Order statistics by ranges, least rows in rounds, the hash tree, cells by number: against plain Python."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from granary.operators import coverage as V
from granary.operators import evaluation as E
from granary.operators import orderstats as O


def brute_hash(rows, size):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    leaves = [sha(f"{sha(r)}:{n}") for r, n in Counter(rows).items()]
    if not leaves:
        return sha("")
    level = defaultdict(list)
    d = O.digits(len(leaves), size)
    for h in leaves:
        level[h[:d]].append(h)
    while True:
        done = {p: sha("".join(sorted(own))) for p, own in level.items()}
        if not d:
            return done[""]
        d -= 1
        level = defaultdict(list)
        for p, h in done.items():
            level[p[:d]].append(f"{p}:{h}")


@pytest.mark.parametrize("seed", range(2))
def test_order_statistics(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([7.0, 7.0, rng.random() * 10, None])) for _ in range(900)] + [("one", 3.0), ("nothing", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    places = {"first": lambda n: F.lit(1), "mid": lambda n: F.floor((n + 1) / 2), "late": lambda n: F.greatest(F.lit(1), F.floor(n * 0.9)), "last": lambda n: n, "beyond": lambda n: n + 1}
    got = {r.g: r for r in O.order_statistics(df, "v", ["g"], places).collect()}
    values = defaultdict(list)
    for g, v in rows:
        if v is not None:
            values[g].append(v)
    assert set(got) == set(values)
    for g, own in values.items():
        own.sort()
        n, r = len(own), got[g]
        assert (r.n, r.min, r.max, r.first, r.mid, r.late, r.last, r.beyond) == (n, own[0], own[-1], own[0], own[(n + 1) // 2 - 1], own[max(1, int(n * 0.9)) - 1], own[-1], None)
        assert r.mean == pytest.approx(sum(own) / n)
    whole = O.order_statistics(df, "v", [], {"mid": places["mid"]}).first()
    every = sorted(v for _, v in rows if v is not None)
    assert (whole.n, whole.mid) == (len(every), every[(len(every) + 1) // 2 - 1])
    nothing = O.order_statistics(df.filter("false"), "v", [], {"mid": places["mid"]}).collect()
    assert len(nothing) == 1 and nothing[0].n is None and nothing[0].mid is None
    assert O.order_statistics(df.filter("false"), "v", ["g"], places).count() == 0
    assert E.distribution(df, "v", ["g"]).filter("g = 'one'").first().p95 == 3.0


def test_no_task_numbers_more_than_its_range(spark):
    """The windows that number values are over a range of a group."""
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.xxhash64("id").alias("v"))
    plan = O.order_statistics(df, "v", ["g"], {"mid": lambda n: F.floor((n + 1) / 2)})._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_part" in w.split("windowspecdefinition(")[1] for w in windows)


def test_least_of_hot_groups(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 10 else f"g{i % 7}", rng.randrange(500), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(4)
    want = set()
    for g in {r[0] for r in rows}:
        want |= set(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))[:5])
    assert {tuple(r) for r in O.least(df, ["g"], ["v", "i"], 5, salts=7).collect()} == want
    same = spark.range(400).select(F.lit("x").alias("g"), F.lit(1).alias("v"))
    assert O.least(same, ["g"], ["v"], 5).count() == 5


@pytest.mark.parametrize("size", [2, 50, 1024])
def test_hash_tree(spark, size):
    rng = random.Random(size)
    rows = [f"r{rng.randrange(900)}" for _ in range(1500)] + ["r1"] * 200
    df = spark.createDataFrame([(r,) for r in rows] + [(None,)], "row string")
    want = brute_hash(rows, size)
    assert O.tree_hash(df, "row", size).first().sha256 == want
    assert O.tree_hash(df.repartition(7).orderBy(F.rand(1)), "row", size).first().sha256 == want
    assert O.tree_hash(df.filter("row <> 'r1'"), "row", size).first().sha256 == brute_hash([r for r in rows if r != "r1"], size) != want
    assert O.tree_hash(df.union(df.limit(1)), "row", size).first().sha256 != want
    assert O.tree_hash(df.filter("false"), "row", size).first().sha256 == hashlib.sha256(b"").hexdigest()
    assert O.digits(10**12) == 8 and O.digits(0) == O.digits(1024) == 0 and O.digits(1025) == 1


def test_cells_of_any_number(spark):
    rng = random.Random(5)
    axes = ["a", "b", "c", "bare"]
    rows = [(rng.choice(["x", "y", None]), str(rng.randrange(6)), rng.randrange(4), None) for _ in range(60)]
    df = spark.createDataFrame(rows, "a string, b string, c int, bare string")
    seen = Counter((r[0], r[1], str(r[2]), "<missing>") for r in rows if r[0] is not None)
    lists = [sorted({str(r[k]) for r in rows if r[k] is not None}) or ["<missing>"] for k in range(4)]
    want = {(*cell, seen[cell], "empty" if not seen[cell] else "thin" if seen[cell] < 3 else "covered") for cell in itertools.product(*lists)}
    assert {tuple(r) for r in V.joint_cells(df, axes).collect()} == want
    pieces = [V.joint_cells(df, axes, first=at, most=7).collect() for at in range(0, len(want), 7)]
    assert {tuple(r) for p in pieces for r in p} == want and sum(map(len, pieces)) == len(want)
    s = V.cell_summary(df, axes).first()
    assert (int(s.possible), s.observed, s.thin, s.covered, int(s.empty)) == (len(want), len(seen), sum(n < 3 for n in seen.values()), sum(n >= 3 for n in seen.values()), len(want) - len(seen))
    assert s.fill_rate == pytest.approx(V.fill_rate(V.joint_cells(df, axes)).first().fill_rate)
    wide = spark.range(3000).select(*[F.xxhash64("id", F.lit(k)).alias(f"x{k}") for k in range(6)])
    names = [f"x{k}" for k in range(6)]
    assert int(V.cell_summary(wide, names).first().possible) == 3000**6
    with pytest.raises(ValueError, match="ask for a stretch"):
        V.joint_cells(wide, names)
    assert V.joint_cells(wide, names, most=10).filter("state = 'empty'").count() >= 9
    assert V.joint_cells(df.filter("false"), axes).collect()[0].state == "empty" and int(V.cell_summary(df.filter("false"), axes).first().possible) == 1
