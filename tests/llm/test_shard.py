import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm.common import with_global_index
from granary.llm.shard import hilbert_index, name_cells, read_shards, shard, write_shards


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_neighbours_on_the_curve_touch(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    index = hilbert_index(cells, bits)
    assert sorted(index) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def dims():
    return {"a": F.col("lang"), "b": F.col("source")}, {"c": F.col("n_chars")}


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(docs, law):
    rows = shard(docs, *dims(), 8, law).collect()
    want = docs.collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in want)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(8))
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    counts = [len(by.get(k, [])) for k in range(8)]
    if law == "rows":
        assert max(counts) - min(counts) <= 1
    else:
        sizes = [sum(r.size for r in by.get(k, [])) for k in range(8)]
        most = max(r.size for r in rows)
        assert max(abs(s - sum(sizes) / 8) for s in sizes) <= most
    ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in ordered] == sorted(r.curve for r in rows)


def test_empty(empty):
    assert shard(empty, *dims()).collect() == []


def test_global_index(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    rows = with_global_index(df, [F.col("k").desc()], "i", 5).collect()
    assert all(r.i == 999 - r.k for r in rows)
    assert with_global_index(df.filter("false"), [F.col("k")], "i").count() == 0


def test_names_have_cells_of_their_own(spark):
    """Names that share their first letters, and null, stay apart; more names than cells are cut by rows."""
    rows = [(f"https://src{i % 20}.example",) for i in range(100)] + [(None,)]
    got = {r.name: r.cell for r in name_cells(spark.createDataFrame(rows, "name string"), 8).collect()}
    assert [got[n] for n in sorted(got)] == list(range(1, 21))
    many = [(f"n{i:03}",) for i in range(100) for _ in range(50 if i == 7 else 1)]
    cells = {r.name: r.cell for r in name_cells(spark.createDataFrame(many, "name string"), 3).collect()}
    assert [cells[n] for n in sorted(cells)] == sorted(cells.values()) and set(cells.values()) <= set(range(1, 8))
    before = sorted(x for (x,) in many)
    assert all(cells[n] == before.index(n) * 7 // len(before) + 1 for n in cells)


def test_cells(docs):
    rows = shard(docs, *dims(), 4, keep=("lang", "source", "n_chars")).collect()
    for column, cell in (("lang", "a"), ("source", "b")):
        order = sorted({r[column] for r in rows if r[column] is not None})
        assert all(r[cell] == (0 if r[column] is None else order.index(r[column]) + 1) for r in rows)
    most = max(r.n_chars for r in rows)
    assert all(r.c == min(254, int(r.n_chars / most * 255)) + 1 for r in rows)


def test_a_filter_skips_shards(spark, docs, tmp_path):
    """Whole rows come back, also with a column that is named as one of ours, and a query for one source leaves shards out."""
    path = str(tmp_path / "shards")
    more = docs.withColumn("place", F.lit("mine")).withColumn("_a", F.lit(1))
    ranges = write_shards(more, path, *dims(), shards=8)
    back = spark.read.parquet(path)
    assert back.columns == [*more.columns, "shard"] and Counter(map(tuple, back.drop("shard").collect())) == Counter(map(tuple, more.collect()))
    names = sorted({r.source for r in docs.collect() if r.source is not None})
    found = 0
    for i, n in enumerate(names, 1):
        part = read_shards(ranges, path, b=(i, i))
        assert part.filter(F.col("source") == n).count() == docs.filter(F.col("source") == n).count()
        found += part.select("shard").distinct().count()
    assert found < 8 * len(names) and ranges.count() == 8
    assert sum(r.rows for r in ranges.collect()) == docs.count()
