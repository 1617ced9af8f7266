import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import packing
from granary.llm.packing import Encoder, _Plan, best_plan, pack, plan_runs, with_crc
from granary.llm.queries import tokenizer_files

FILES = tokenizer_files()
FAST, PLAIN = Encoder(FILES["tokenizer"], FILES["ranks"]), Encoder(FILES["tokenizer"])


def ids(text):
    return PLAIN.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\tab'sé1.  <|>"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_words_give_the_ids_of_the_whole(text):
    assert np.frombuffer(FAST.encode(text), "<u4").tolist() == ids(text)
    assert np.frombuffer(PLAIN.encode(text), "<u4").tolist() == ids(text)


def test_special_names():
    for text in ("a <|endoftext|> b", "x<|endoftext|>"):
        assert np.frombuffer(FAST.encode(text), "<u4").tolist() == ids(text)


def test_a_call_a_text_however_many_words(monkeypatch):
    enc = Encoder(FILES["tokenizer"], FILES["ranks"])
    calls = []
    monkeypatch.setattr(enc, "ranked", lambda text, ranked=enc.ranked: calls.append(text) or ranked(text))
    for k in range(20):
        text = " ".join(f"w{i}x" for i in range(1000 * k, 1000 * k + 1000))
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == ids(text)
    assert len(calls) == 20


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(" \n\t\x1c\u2003ab's1.é中"), max_size=60), st.integers(1, 9))
def test_blocks(text, size):
    parts = list(packing.blocks(text, size))
    assert "".join(parts) == text
    assert [x for p in parts for x in ids(p)] == ids(text)


def test_long_texts_and_runs(monkeypatch):
    for text in ("a" * 1_200_000, " " * 1_200_000 + "x", "x" + "\n \t" * 400_000 + "y z", "&" * 1_200_000, "one two\n" * 150_000):
        assert np.frombuffer(FAST.encode(text), "<u4").tolist() == ids(text)
    monkeypatch.setattr(packing, "BLOCK", 1000)
    monkeypatch.setattr(packing, "LONGEST_SPACE", 5)
    for text in ("ab cd, ef\n" * 1000, "a b " * 600 + " " * 9 + "c d" * 600, "it's  so " * 900):
        assert np.frombuffer(FAST.encode(text), "<u4").tolist() == ids(text)


def test_characters_of_the_first_planes():
    for low in range(0, 0x20000, 4096):
        text = "\n".join(f"a{c}b 1{c}2 !{c}? {c} {c}{c}" for c in map(chr, range(low, low + 4096)) if not "\ud800" <= c <= "\udfff")
        assert np.frombuffer(FAST.encode(text), "<u4").tolist() == ids(text), hex(low)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30), st.sampled_from([1 / 8, 1 / 3, 1 / 2]), st.sampled_from([2, 5, 64]))
def test_plans_hold_every_piece_once(histogram, large, groups):
    runs = plan_runs(histogram, 64, large, groups)
    placed = Counter()
    for lengths, n in runs:
        assert sum(lengths) <= 64 and n > 0
        for x in lengths:
            placed[x] += n
    assert placed == Counter(histogram)


def test_plans_come_near_the_least():
    rng = np.random.default_rng(3)
    lengths = np.minimum(2048, rng.lognormal(6.5, 1.0, 20_000).astype(int) + 1)
    histogram = Counter(lengths.tolist())
    least = -(-int(lengths.sum()) // 2048)
    simple = _Plan(2048)
    counts = np.zeros(2049, np.int64)
    for x, n in histogram.items():
        counts[x] = n
    simple.best_fit(counts)
    got = sum(n for _, n in best_plan(histogram))
    assert got <= 1.002 * least + 1 and got <= 1.002 * sum(n for _, n in simple.runs())


def expected(rows, capacity):
    out = Counter()
    for r in rows:
        whole = [*ids(r.text or ""), 0]
        first = (len(whole) - 1) % capacity + 1
        cuts = [0, *range(first, len(whole) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            out[r.doc_id, k, a, b - a, zlib.crc32(np.array(whole[a:b], "<u4").tobytes())] += 1
    return out


@pytest.mark.parametrize("capacity", [64, 2048])
def test_pack(docs, capacity):
    rows = pack(docs, capacity=capacity, digest=with_crc, **FILES).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected(docs.collect(), capacity)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in rows)
    assert len(by) <= 1.05 * total / capacity + 2


def test_pack_keeps_ids(docs):
    rows = pack(docs.filter("doc_id = 403"), **FILES).collect()
    assert np.frombuffer(rows[0].ids, "<u4").tolist() == [*ids("one"), 0]


def test_empty(empty):
    assert pack(empty, digest=with_crc, **FILES).collect() == []
