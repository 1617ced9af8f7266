import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm.langid import Table, code_lengths, predict, train
from granary.llm.queries import op8_ppm_language

ORDER = 3


def tree(texts):
    """Counts of each byte after each context of up to ORDER bytes, from windows of ORDER + 1."""
    out = defaultdict(lambda: defaultdict(int))
    for t in texts:
        data = b" " * ORDER + t.encode()
        for i in range(ORDER, len(data)):
            for k in range(ORDER + 1):
                out[data[i - k : i]][data[i]] += 1
    return out


def bits(model, text):
    data, total = b" " * ORDER + text.encode(), 0.0
    for i in range(ORDER, len(data)):
        for k in range(ORDER, -1, -1):
            context = data[i - k : i]
            if context not in model:
                continue
            own = model[context]
            n, q = sum(own.values()), len(own)
            if data[i] in own:
                total += math.log2((n + q) / own[data[i]])
                break
            total += math.log2((n + q) / q)
        else:
            total += 8
    return total


def sentences(letters, n, seed):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 30))) for _ in range(n)]


@pytest.fixture
def rows(spark):
    texts = [(x, lang) for lang, letters in (("aa", "abcdéf"), ("bb", "cdefgh"), ("cc", "fghija")) for x in sentences(letters, 40, lang)]
    rows = [(i, t, lang, "s") for i, (t, lang) in enumerate(texts)] + [(1000, None, "aa", "s"), (1001, "", "bb", "s"), (1002, "12 !?", "cc", "s"), (1003, "zzz", None, "s"), (None, "abc", "aa", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3)


def test_table():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64))
    t = Table(keys, np.zeros((len(keys), 1)))
    assert (t.find(keys) == np.arange(len(keys))).all()
    assert (t.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()
    assert (Table(np.zeros(0, np.uint64), np.zeros((0, 1))).find(keys) == -1).all()


def test_code_lengths_are_those_of_the_trees(rows):
    own = [r for r in rows.collect() if r.text is not None and r.lang is not None and r.doc_id is not None]
    model = train(rows, F.lit(True), ORDER)
    assert model.langs == ["aa", "bb", "cc"]
    trees = {lang: tree([r.text for r in own if r.lang == lang]) for lang in model.langs}
    texts = [r.text for r in own[::7]] + ["new words ÿ", "abc" * 50]
    got = code_lengths(model, [t.encode() for t in texts], ORDER)
    for t, b in zip(texts, got, strict=True):
        assert b == pytest.approx([bits(trees[lang], t) for lang in model.langs], rel=1e-4, abs=1e-2)


def test_long_texts_are_scored_in_stretches(rows, monkeypatch):
    model = train(rows, F.lit(True), ORDER)
    texts = [r.text.encode() for r in rows.collect() if r.text] + [b"abc " * 500]
    whole = code_lengths(model, texts, ORDER)
    monkeypatch.setattr("granary.llm.langid.CHUNK", 37)
    assert np.allclose(whole, code_lengths(model, texts, ORDER))


def test_predictions(rows):
    model = train(rows, F.col("doc_id") % 3 != 0, ORDER)
    got = {r.doc_id: r for r in predict(rows, model, ("doc_id", "lang"), ORDER).collect()}
    assert len(got) == rows.count()
    for i in (1000, 1001, 1002):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[1003].lang_pred in model.langs and all(0 <= r.score <= 1 for r in got.values())
    held = [r for r in got.values() if r.doc_id is not None and r.doc_id % 3 == 0 and r.doc_id < 1000]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.9 * len(held)


def test_sample_is_bounded_and_nothing_learned(rows):
    few = train(rows, F.lit(True), ORDER, max_docs=2)
    assert few.langs == ["aa", "bb", "cc"]
    none = train(rows, F.lit(False), ORDER)
    assert {r.lang_pred for r in predict(rows, none, order=ORDER).collect()} == {"und"}
    assert predict(rows.filter("false"), few, order=ORDER).collect() == []


def test_three_hundred_languages(spark):
    """Languages have no bound; each has its share of the bytes that are learned from, and one document at least."""
    import random

    rng = random.Random(4)

    def text(k, n):
        own = random.Random(k)
        words = ["".join(own.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(own.randint(3, 7))) for _ in range(30)]
        return " ".join(rng.choice(words) for _ in range(n))

    docs = spark.createDataFrame([(10 * k + j, text(k, 60), f"l{k:03}") for k in range(300) for j in range(3)], "doc_id long, text string, lang string")
    model = train(docs, F.col("doc_id") % 10 < 2, ORDER, max_total=300 * 400)
    assert model.langs == [f"l{k:03}" for k in range(300)] and {len(b.langs) for b in model.blocks} == {8, 4}
    held = predict(docs.filter("doc_id % 10 = 2"), model, ("doc_id", "lang"), ORDER).collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and [r.lang_pred for r in held if r.doc_id == 2992] == ["l299"]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op8_ppm_language(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in rows if got[r.doc_id].held_out and r.lang is not None]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)
