import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from granary.llm import spelling
from granary.llm.spelling import Tree, codes, count_words, group_spellings, one_edit, vectors


def brute_words(docs, damage=199):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if damage and h % damage == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def brute(n, ratio=5):
    """By every word with one code point left out: two words are near if those of one hold the other, or they share one at the same place."""
    by = defaultdict(set)
    for w in n:
        for k in range(len(w)):
            by[len(w), k, w[:k] + w[k + 1 :]].add(w)
    near = defaultdict(set)
    for (_, _, cut), words in by.items():
        for a, b in itertools.permutations(words, 2):
            near[a].add(b)
        if cut in n:
            for a in words:
                near[a].add(cut)
                near[cut].add(a)
    forms = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= ratio * n[w]:
                forms[w] = best

    def root(w):
        return root(forms[w]) if w in forms else w

    return {(w, forms.get(w), root(w), n[w], len(near[w]), n[forms[w]] if w in forms else None) for w in n}


def rows(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def vocabulary(seed, size, letters="abcdé", lengths=(6, 7, 8)):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.choice(lengths))) for _ in range(size)}
    return {w: int(5 ** (1 + 5 * rng.random())) for w in words}


@pytest.mark.parametrize("leaf,small,sample", [(8192, 24, 100_000), (20, 3, 100_000), (16, 2, 200)])
def test_equals_brute_force(spark, monkeypatch, leaf, small, sample):
    monkeypatch.setattr(spelling, "LEAF", leaf)
    monkeypatch.setattr(spelling, "SMALL", small)
    monkeypatch.setattr(spelling, "SAMPLE", sample)
    n = vocabulary(leaf, 700) | {"ÿ" * 6: 7, "aaaaaa": 5, "aaaaaaa": 30, "aaaaaaaa": 200, "aaaaaab": 1000, "z" * 300: 40, "z" * 299: 5, "z" * 298 + "y": 900}
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    assert rows(group_spellings(df)) == brute(n)


def test_large_leaves_are_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "LEAF_BYTES", 2000)
    n = vocabulary(9, 300)
    assert rows(group_spellings(spark.createDataFrame(list(n.items()), "word string, n long"))) == brute(n)


def test_long_chains_and_ties(spark):
    n = {"abcdef": 5, "abcdeg": 25, "abcdhg": 125, "abcihg": 625, "abjihg": 3125, "akjihg": 15625, "lkjihg": 15625 * 5}
    n |= {"qqqqqq": 5, "qqqqqx": 50, "qqqqqa": 50, "qqqqqqq": 50}
    assert rows(group_spellings(spark.createDataFrame(list(n.items()), "word string, n long"))) == brute(n)


def test_other_letters(spark):
    n = vocabulary(4, 200, "aбω中", (1, 2, 3)) | {"a": 9, "😀a": 50, "😀": 400, "b" * 200: 5}
    assert rows(group_spellings(spark.createDataFrame([*n.items(), (None, 7), ("", 9)], "word string, n long"))) == brute(n)


@pytest.mark.parametrize("damage", [199, 3, None])
def test_words_of_documents(spark, docs, damage):
    rng = random.Random(1)
    text = " ".join(rng.choice(["Straße", "naïvely", "COLOURED", "colored", "Ünïcode", "ÀÉabcd", "x×y÷zab", "tiny", "don't-stop", "中文abcdefg"]) for _ in range(900))
    more = spark.createDataFrame([(i, text[i * 50 :], "en", "s", 1, "x") for i in range(20)] + [(None, text, None, None, None, None)], docs.schema)
    both = docs.union(more).withColumn("word", docs.lang)
    want = brute_words([(r.doc_id, r.text) for r in both.collect()], damage)
    counted = count_words(both, damage=damage)
    assert {r.word: r.n for r in counted.collect()} == want and want
    assert rows(group_spellings(counted)) == brute(want)


def test_counts_are_handed_on(spark, docs, monkeypatch):
    monkeypatch.setattr(spelling, "COUNTED", 3)
    text = "abcdefg hijklmn opqrstu vwxyzab cdefghi " * 5
    df = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    assert {r.word: r.n for r in count_words(df).collect()} == brute_words([(1, text), (2, text)], None)


def test_empty(spark, empty):
    assert group_spellings(count_words(empty)).count() == 0
    assert group_spellings(spark.createDataFrame([("abcdefg", 5)], "word string, n long")).first().asDict() == {"word": "abcdefg", "form": None, "root": "abcdefg", "n": 5, "n_near": 0, "form_n": None}


def test_boxes_lose_no_edit():
    """Every single edit of a word lies in a leaf that the word reaches, also for counts over the bound."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abc") for _ in range(9)) for _ in range(300)]
    for change in (0, 1):
        edits = [w[:k] + rng.choice("abcd") + w[k + 1 - change :] for w in words for k in (rng.randrange(9),)]
        tree = Tree(vectors(codes(edits, 9 + change)), 4)
        home = tree.home(vectors(codes(edits, 9 + change)))
        found = {(leaf, int(i)) for leaf, own in tree.reach(vectors(codes(words, 9)), 1 - change) for i in own}
        assert all((int(home[i]), i) in found for i in range(300))
    near = one_edit(codes(["abcdef", "abcdeg"], 6), codes(["abcdef", "abcdxf"], 6))
    assert near.tolist() == [[False, True], [True, False]]
    assert one_edit(codes(["aab"], 3), codes(["aaab", "abab", "baab", "aabc", "bbab"], 4)).tolist() == [[True, True, True, True, False]]
    assert vectors(codes(["a" * 500], 500))[0, 0] == 127 and np.abs(vectors(codes(["abcdé"], 5))).sum() == 9


def test_long_tables_are_not_broadcast(spark, monkeypatch):
    """Chains beyond the bound are joined by shuffles, also where their files are small; roots are the same."""
    words = spark.createDataFrame([("abcdefgh", 1000), ("abcdefgx", 100), ("abcdefyx", 15), ("abcdezyx", 3)], "word string, n long")
    want = {r.word: r.root for r in group_spellings(words).collect()}
    monkeypatch.setattr(spelling, "BROADCAST_WORDS", 1)
    out = group_spellings(words)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.word: r.root for r in out.collect()} == want and want["abcdezyx"] == "abcdefgh"
