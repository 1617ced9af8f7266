import hashlib
import re
from collections import Counter

import pytest

from granary.llm.mixing import mix, mixed_documents


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Share, cap and share the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    held = {}
    while True:
        free, rest = sum(sizes.values()) - sum(held.values()), sum(w[s] for s in order if s not in held)
        over = {s: float(cap * sizes[s]) for s in order if s not in held and free * w[s] / rest > cap * sizes[s]}
        if not over:
            return held | {s: free * w[s] / rest for s in order if s not in held}
        held |= over


def brute(rows):
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(words(r.text))
    target = targets(sizes)
    out = Counter()
    for s in sizes:
        key = lambda r: (int(hashlib.md5(f"0:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:15], 16), r.doc_id is not None, r.doc_id or 0, len(words(r.text)))
        budget = int(target[s] + 0.5)
        whole, left = divmod(budget, sizes[s]) if sizes[s] else (0, 0)
        for r in sorted((r for r in rows if r.source == s), key=key):
            n = len(words(r.text))
            part = min(n, left)
            left -= part
            out[r.doc_id, n, sizes[s], round(target[s], 6), whole * n + part] += 1
    return out, target


def test_mix(docs):
    want, target = brute(docs.collect())
    got = mix(docs).collect()
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got) == want
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.5


def test_same_again(docs):
    row = lambda r: (r.doc_id is not None, r.doc_id or 0, r.taken)
    assert sorted(map(row, mix(docs).collect())) == sorted(map(row, mix(docs.repartition(7)).collect()))


def test_mixed_documents(docs):
    want = Counter()
    for (doc_id, size, _, _, taken), n in brute(docs.collect())[0].items():
        want[doc_id] += n * taken
        assert size or not taken
    got = mixed_documents(docs).collect()
    assert got[0].__fields__ == docs.columns
    have = Counter()
    for r in got:
        have[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
    assert {k: v for k, v in want.items() if v} == {k: v for k, v in have.items() if v}
    whole = {(r.doc_id, r.text) for r in docs.collect()}
    cut = [r for r in got if (r.doc_id, r.text) not in whole]
    assert len(cut) <= docs.select("source").distinct().count()


def test_no_words(spark, empty):
    assert mix(empty).collect() == [] and mixed_documents(empty).collect() == []
    rows = mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).collect()
    assert [(r.target, r.taken) for r in rows] == [(0.0, 0), (0.0, 0)]


@pytest.mark.parametrize("weights", [(1,), (3, 1)])
def test_weights(docs, weights):
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(words(r.text))
    want = targets(sizes, weights)
    assert all(abs(r.target - want[r.source]) < 1e-6 for r in mix(docs, weights=weights).collect())
