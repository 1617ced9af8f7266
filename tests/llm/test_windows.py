import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm.queries import word_tokenizer
from granary.llm.windows import Packer, WordEncoder, _powers, pack

PATH = word_tokenizer()
ENCODER = WordEncoder(PATH)


def ids(text):
    return ENCODER.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t\x0b\x1c\x1f\x85\xa0'sredmlvtª¹²×÷ßÿÀÞµaB1.,<|>"), st.characters(max_codepoint=255)), max_size=60))
def test_words_of_western_texts(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids(text)


def test_every_character_of_western_texts():
    for text in ("".join(map(chr, range(256))), " ".join(map(chr, range(256))), "a".join(map(chr, range(256))), "1".join(map(chr, range(256)))):
        assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids(text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t\r\x0b\x85\xa0 ́ab'sÉİΣſ1.  <|>"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_words_give_the_ids_of_the_whole(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids(text)


def test_special_names_and_forgetting(monkeypatch):
    import granary.llm.windows as w

    monkeypatch.setattr(w, "REMEMBERED", 5)
    for text in ("a <|endoftext|> b", "x<|startoftext|>y", "<|end oftext|>", "a b c d e f g h", "h g f e d c b a " + "z" * 100):
        assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(1, 5))
def test_windows_are_full_and_hold_every_id_once(lengths, windows):
    packer, out = Packer(16, windows), []
    data = [np.arange(n, dtype="<u4") + 1000 * i for i, n in enumerate(lengths)]
    for i, x in enumerate(data):
        out += [(w, True) for w in packer.add(i, x.tobytes())]
        assert len(packer.used) <= windows and all(0 < u < 16 for u in packer.used)
    out += list(packer.finish())
    found = defaultdict(list)
    for pieces, whole in out:
        at = 0
        for doc, start, b, offset in pieces:
            assert offset == at
            at += len(b) // 4
            found[doc].append((start, np.frombuffer(b, "<u4").tolist()))
        assert at == 16 if whole else at < 16
    assert sum(not whole for _, whole in out) <= 1
    for i, x in enumerate(data):
        assert sum((b for _, b in sorted(found[i])), []) == x.tolist()


def test_a_document_goes_where_it_fits_best():
    packer = Packer(16, 3)
    for n in (9, 12, 10):
        assert not list(packer.add(n, bytes(4 * n)))
    assert not list(packer.add("x", bytes(16)))[1:] and packer.used == [9, 10]  # 4 fill the window with 12
    assert not list(packer.add("y", bytes(24)))[1:] and packer.used == [9]
    assert _powers(0) == [] and _powers(11) == [8, 2, 1]


def check(rows, texts, capacity, columns=("doc_id",)):
    """Every id once, offsets without gaps, nothing padded."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        documents[r.doc_id].append(r)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= capacity and at & (at - 1) == 0
    assert sum(sum(x for _, x in p) < capacity for p in sequences.values()) <= capacity.bit_length()
    want = defaultdict(int)
    for i, t in texts:
        want[i, tuple([*ids(t or ""), 2])] += 1
    for (i, whole), n in want.items():
        ends, open_ = n, defaultdict(list)
        got = sorted((r for r in documents[i] if r.doc_tokens == len(whole)), key=lambda r: r.start)
        if n == 1 and sum(1 for j, _ in want if j == i) == 1:
            at = 0
            for r in got:
                part = np.array(whole[r.start : r.start + r.length], "<u4").tobytes()
                assert r.start == at and r.ids_crc32 == zlib.crc32(part) and (not hasattr(r, "ids") or r.ids is None or bytes(r.ids) == part)
                at += r.length
            assert at == len(whole)
        else:
            covered = defaultdict(int)
            for r in got:
                assert r.ids_crc32 == zlib.crc32(np.array(whole[r.start : r.start + r.length], "<u4").tobytes())
                for k in range(r.start, r.start + r.length):
                    covered[k] += 1
            assert all(covered[k] == n for k in range(len(whole)))
        assert ends and not open_
    assert sum(r.length for r in rows) == sum(len(w) * n for (_, w), n in want.items())


@pytest.mark.parametrize("capacity,windows", [(64, 2), (256, 16), (4096, 16)])
def test_equals_the_tokenizer(docs, capacity, windows):
    rows = pack(docs, PATH, capacity=capacity, windows=windows).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()], capacity)


def test_long_and_many_tasks(spark):
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice(["the", "of", "antidisestablishmentarianism", "x9", "é,"]) for _ in range(rng.choice([1, 5, 30, 4000])))) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(13)
    rows = pack(df, PATH, capacity=512, windows=3, ids=False).collect()
    assert "ids" not in rows[0].asDict()
    check(rows, texts, 512)


def test_empty_and_clashes(docs, empty):
    assert pack(empty, PATH).count() == 0
    named = docs.withColumnRenamed("size", "part").withColumn("whole", docs.lang).withColumn("row", docs.lang)
    out = pack(named, PATH, columns=("doc_id", "part", "whole", "row"), ids=False)
    assert out.columns[:4] == ["doc_id", "part", "whole", "row"] and {r.part for r in out.collect()} == {"x"}
    with pytest.raises(ValueError):
        pack(named.withColumn("length", docs.lang), PATH, columns=("doc_id", "length"))
