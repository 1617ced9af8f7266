import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import substring
from granary.llm.substring import _chosen, _cut, alive_windows, dedup_documents, hash_words, least_places, levels, remove_repeats


def brute(texts, width):
    """Kept words and number of words removed of each text."""
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((b" ".join(x for k, x in enumerate(w) if k not in gone).decode(), len(w), len(gone)))
    return out


def test_levels():
    assert levels() == [9, 18, 35] and levels(50) == [13, 25, 50] and levels(5, 2) == [2, 3, 5] and levels(7) == [7]


def test_least_places():
    rng = np.random.default_rng(0)
    for width in (1, 2, 5, 8, 13):
        x = rng.integers(0, 9, 60).astype(np.uint64)
        assert least_places(x, width).tolist() == [p + int(x[p : p + width].argmin()) for p in range(60 - width + 1)]


def test_words_hash_alike():
    h, n = hash_words([b"a bc  a", b"", b"\tbc\x0b", b"\xc3\xa9 a"])
    assert n.tolist() == [3, 0, 1, 2]
    assert h[0] == h[2] == h[5] and h[1] == h[3] and len(set(h.tolist())) == 3


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab cde"), max_size=40).map(" ".join), min_size=1, max_size=6), st.integers(3, 9))
def test_levels_lose_nothing(texts, width):
    """The levels by hand, over texts of few different words."""
    raw = [t.encode() for t in texts]
    dead = [np.zeros(0, np.int64) for _ in texts]
    for length in levels(width, 2):
        text, h, h2, lo, hi, _ = _chosen(raw, dead, length, width)
        by = defaultdict(list)
        for row in zip(text.tolist(), zip(h.tolist(), h2.tolist()), lo.tolist(), hi.tolist(), strict=True):
            by[row[1]].append(row)
        for rows in by.values():
            if len(rows) == 1:
                k, _, a, b = rows[0]
                dead[k] = np.append(dead[k], (a << 32) | b)
    got = [_cut(t, d, width) for t, d in zip(texts, dead, strict=True)]
    assert [(t, n, int((s[1::2] - s[::2]).sum())) for t, n, s in got] == brute(texts, width)


def test_alive():
    assert alive_windows(6, np.array([(1 << 32) | 2]), 3).tolist() == [True, False, False, True]
    assert alive_windows(2, None, 3).tolist() == []


@pytest.mark.parametrize("rows", [0, 500_000])
def test_against_brute_force(docs, rows, monkeypatch):
    """Also with every table taken for too large to broadcast."""
    monkeypatch.setattr(substring, "BROADCAST_ROWS", rows)
    own = docs.collect()
    want = Counter((r.doc_id, *w) for r, w in zip(own, brute([r.text for r in own], 35), strict=True))
    got = remove_repeats(docs).collect()
    assert Counter((r.doc_id, r.text, r.n_words, r.n_removed) for r in got) == want
    for r in got:
        assert sum(b - a for a, b in zip(r.removed[::2], r.removed[1::2], strict=True)) == r.n_removed
    assert any(r.n_removed for r in got)


def test_dedup_documents(docs):
    own = docs.collect()
    want = Counter()
    for r, (text, _, removed) in zip(own, brute([r.text for r in own], 35), strict=True):
        want[r.doc_id, text if removed else r.text, len(text) if removed else r.n_chars, r.source] += 1
    got = dedup_documents(docs)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text, r.n_chars, r.source) for r in got.collect()) == want


def test_empty_and_width(spark, empty):
    assert remove_repeats(empty).collect() == []
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_words, r.n_removed) for r in remove_repeats(df, 5).collect()}
    assert [got[i] for i in range(30)] == brute(texts, 5)


def test_words_made_to_cancel_out(spark):
    """A Thue-Morse word and its complement have equal polynomial hashes modulo 2**64; documents that differ in such a word share no window of 35."""
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    words = ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    rest = [f"w{i}" for i in range(34)]
    rows = [(i, " ".join([*rest[:17], w, *rest[17:]])) for i, w in enumerate(words)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.n_removed for r in got] == [0, 0]
    hashes = [hash_words([b" ".join(w.encode() for w in words)], which)[0] for which in (0, 1)]
    assert len({int(h) for own in hashes for h in own}) == 4


@pytest.mark.parametrize("which", [0, 1])
def test_every_byte_of_a_word_counts(which):
    rng = random.Random(3)
    words = {bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 90))) for _ in range(3000)}
    words |= {b"a" * n for n in range(1, 90)}
    words = sorted(words)
    hashes, n = hash_words([b" ".join(words)], which)
    assert n.tolist() == [len(words)] and len(set(hashes.tolist())) == len(words)
    alone = [int(hash_words([w], which)[0][0]) for w in words[::50]]
    assert alone == hashes[::50].tolist()
