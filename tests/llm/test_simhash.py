import random
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from granary.llm.components import components
from granary.llm.simhash import drop_near_duplicates, fingerprint, near_duplicates, near_links


def print_of(text):
    words = [bytes(w) for w in bytes((text or "").encode()).lower().split()]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union_find(links, nodes):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


@pytest.mark.parametrize("text", [None, "", "One", "one TWO", "a b c", "a b c d", "É a B c", "x " * 300, " ".join(f"w{i % 50}" for i in range(70_000))])
def test_fingerprint(text):
    assert fingerprint(text) % (1 << 64) == print_of(text)
    assert -(1 << 63) <= fingerprint(text) < 1 << 63


def test_spark_hashes_alike(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("hot", [0, 3, 64])
def test_links_are_all_found(spark, hot):
    """Random fingerprints, clusters around centres, and many that share a half; with keys made finer early, late or never."""
    rng = random.Random(hot)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    prints = {0, (1 << 64) - 1}
    for _ in range(12):
        c = rng.getrandbits(64)
        prints.add(c)
        prints.update(flip(c, rng.randint(1, 4)) for _ in range(12))
    half = rng.getrandbits(32)
    prints.update((half << 32) | rng.getrandbits(8) for _ in range(60))
    prints.update((rng.getrandbits(6) << 32) | half for _ in range(30))
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    got = {(min(r), max(r)) for r in map(tuple, near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), hot).collect())}
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) % (1 << 64)).count("1") <= 2}
    assert got == want and want


@pytest.mark.parametrize("kind", ["chain", "hub", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(kind)
    links = {"chain": [(i, i + 1) for i in range(200)], "hub": [(7, i) for i in range(300)], "random": [(rng.randrange(500), rng.randrange(500)) for _ in range(300)], "none": [(3, 3)]}[kind]
    rng.shuffle(links)
    nodes = {x for a, b in links if a != b for x in (a, b)}
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()))
    assert got == union_find([x for x in links if x[0] != x[1]], nodes)


def brute(rows):
    prints = [print_of(r.text) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 2]
    roots = union_find(links, range(len(rows)))
    groups = defaultdict(list)
    for i, r in roots.items():
        groups[r].append(i)
    return prints, list(groups.values())


def test_near_duplicates(docs):
    rows = docs.collect()
    prints, groups = brute(rows)
    want = Counter()
    for g in groups:
        least = min((rows[i].doc_id for i in g if rows[i].doc_id is not None), default=None)
        want.update((rows[i].doc_id, prints[i], least) for i in g)
    got = near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    assert max(map(len, groups)) > 5


def test_drop(docs):
    rows = docs.collect()
    want = set()
    for g in brute(rows)[1]:
        want.add(min((rows[i].doc_id for i in g if rows[i].doc_id is not None), default=None))
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=str) == sorted(want, key=str)


def test_empty(empty):
    assert near_duplicates(empty).collect() == [] and drop_near_duplicates(empty).collect() == []
