import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from granary.llm.queries import oracle_sql, queries

from tests.llm import test_mixing, test_packing, test_quality, test_simhash, test_substring

DATA = "/root/testdata/sf0.001"


def write(spark, docs, path):
    docs.write.parquet(f"{path}/documents.parquet")
    return f"file://{path}"


def stages(spark, docs, sf):
    """What each stage returns, each over the rows of the one before."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf), "stage")
        out.append((name, docs))
    return out


def hold(docs, got):
    """Each stage against a brute-force version of it over its own input."""
    rows = docs.collect()
    full = lambda r: (r.doc_id, r.text, r.lang, r.source, r.n_chars)
    clean = got[0][1].collect()
    assert Counter(map(full, clean)) == Counter(full(r) for r in rows if not test_quality.failed(test_quality.measure(r.text)))
    _, groups = test_simhash.brute(clean)
    single = got[1][1].collect()
    assert Counter(r.doc_id for r in single) == Counter(min((clean[i].doc_id for i in g if clean[i].doc_id is not None), default=None) for g in groups)
    assert set(map(full, single)) <= set(map(full, clean))
    cut = got[2][1].collect()
    want = Counter()
    for r, (text, _, removed) in zip(single, test_substring.brute([r.text for r in single], 35), strict=True):
        want[r.doc_id, text if removed else r.text] += 1
    assert Counter((r.doc_id, r.text) for r in cut) == want
    mixed = got[3][1].collect()
    taken = Counter()
    for (doc_id, _, _, _, n), k in test_mixing.brute(cut)[0].items():
        taken[doc_id] += n * k
    have = Counter()
    for r in mixed:
        have[r.doc_id] += len(test_mixing.words(r.text))
    assert +taken == +have
    packed = got[4][1].collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == test_packing.expected(mixed, 2048)
    spans = {}
    for r in packed:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    own = [c for c in docs.columns if c not in ("text", "n_chars")]
    known = {tuple(r[c] for c in own) for r in rows}
    for _, stage in got[:-1]:
        assert stage.columns == docs.columns
        assert {tuple(r[c] for c in own) for r in stage.collect()} <= known


def test_stages_on_planted_documents(spark, docs, tmp_path):
    """Also with columns of their own that are named as ours: they come back as they were."""
    names = "n_words dead done partial copies row k1 k2 _row _key _host host fp root doc h n hot few_words cut _cut _name _size".split()
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    sf = write(spark, docs, tmp_path)
    hold(docs, stages(spark, docs, sf))


def test_run_on_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = stages(spark, docs, DATA)
    hold(docs, got)
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(key, corpus_pipeline.run(spark, DATA).collect())) == Counter(map(key, got[-1][1].collect()))


def test_no_documents(spark, tmp_path):
    sf = write(spark, spark.read.parquet(f"{DATA}/documents.parquet").filter("false"), tmp_path)
    assert corpus_pipeline.run(spark, sf).collect() == []


def test_registered():
    assert [n for n in queries() if n.startswith("op")] == sorted((n for n in queries() if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert "pipeline" in queries() and set(oracle_sql()) <= set(queries())
    assert "corpus_pipeline" in sys.modules


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cur = con.execute(oracle_sql()[name])
    columns = sorted(c[0] for c in cur.description)
    order = [[c[0] for c in cur.description].index(c) for c in columns]
    want = Counter(tuple(r[i] for i in order) for r in cur.fetchall())
    got = queries()[name](spark, DATA)
    assert sorted(got.columns) == columns
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == want
