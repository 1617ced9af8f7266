import gzip
import io
import random

import pyarrow as pa
import pytest

from granary.llm.common import new_path
from granary.llm.warc import member, read_archives, record, round_trip, salvage, write_archives

DATE = "2024-01-01T00:00:00Z"


def rec(i, payload):
    return record("response", f"urn:page:{i}:{i}:1", f"http://h/{i}", DATE, payload, "x")


def found(data):
    return list(salvage(pa.PythonFile(io.BytesIO(data), mode="r")))


def payloads(n=12):
    rng = random.Random(1)
    return [bytes(rng.choice(b"abc \r\n<>") for _ in range(rng.randint(0, 3000))) for _ in range(n)]


@pytest.mark.parametrize("pack", [member, lambda x: x])
def test_sound_files(pack):
    data = [rec(i, p) for i, p in enumerate(payloads())]
    got = found(b"".join(map(pack, data)))
    assert [x.block for x in got] == payloads() and all(x.kind == "record" for x in got)
    assert got[-1].end == len(b"".join(map(pack, data)))
    assert found(b"") == []


@pytest.mark.parametrize("pack", [member, lambda x: x])
@pytest.mark.parametrize("seed", range(12))
def test_damage_costs_only_what_it_hits(pack, seed):
    rng = random.Random(seed)
    parts = [pack(rec(i, p)) for i, p in enumerate(payloads())]
    hit = sorted(rng.sample(range(len(parts)), 3))
    for i in hit:
        part = bytearray(parts[i])
        if rng.random() < 0.5:
            # of a plain record only the version line and the block are checked, byte by byte
            inside = rng.randrange(len(part) - 20) if pack is member else part.index(b"\r\n\r\n") + 4
            at = rng.randrange(0, 3) if rng.random() < 0.5 else inside
            part[at : at + 8] = bytes(b ^ 0x5A for b in part[at : at + 8])
        else:
            part = part[: max(1, rng.randrange(len(part) - 8))]
        parts[i] = bytes(part)
    data = b"".join(parts)
    got = found(data)
    kept = [x.block for x in got if x.kind == "record"]
    want = payloads()
    assert kept == [p for i, p in enumerate(want) if i not in hit]
    at = 0
    for x in got:
        assert x.start == at and x.end > at
        at = x.end
    assert at == len(data)
    assert all(x.reason for x in got if x.kind == "gap")


def test_garbage_between_and_mixed():
    data = b"junk" + rec(1, b"one") + member(rec(2, b"two")) + b"\x1f\x8b\x08junk" + rec(3, b"WARC/1.0\r\n not a header") + b"tail"
    got = found(data)
    assert [(x.kind, x.block) for x in got] == [("gap", b""), ("record", b"one"), ("record", b"two"), ("gap", b""), ("record", b"WARC/1.0\r\n not a header"), ("gap", b"")]
    assert gzip.decompress(data[got[2].start : got[2].end]) == rec(2, b"two")


def test_wrong_digest_and_length():
    good, bad = rec(1, b"good"), rec(2, b"what").replace(b"\r\n\r\nwhat", b"\r\n\r\nthat")
    long = rec(3, b"x" * 50).replace(b"Content-Length: 50", b"Content-Length: 90")
    assert [x.block for x in found(bad + good + long + good) if x.kind == "record"] == [b"good", b"good"]


def test_large_record_over_chunks():
    big = random.Random(2).randbytes(5 << 20)
    assert [x.block for x in found(member(rec(1, big)) + rec(2, big) + member(rec(3, b"z")))] == [big, big, b"z"]


@pytest.fixture
def pages(spark):
    long, short = "<p>" + "long " * 60, "<p>short"
    rows = [(i, f"http://h/{i} é?", long if i % 3 == 0 else f"{long}{i}") for i in range(30)] + [(40, "u", short), (41, "u", short), (42, None, None), (43, "u", ""), (50, "u", "é" * 60), (51, "u", "é" * 60)]
    return spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, key int").repartition(4)


def test_round_trip(pages):
    import hashlib

    rows = {r.page_id: r for r in round_trip(pages).collect()}
    want = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    assert rows.keys() == want.keys()
    for i, data in want.items():
        r = rows[i]
        first = min(k for k, v in want.items() if v == data)
        again = len(data) >= 100 and first != i
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None)


def test_repeated_rows(spark):
    html = "x" * 200
    rows = round_trip(spark.createDataFrame([(1, "u", html)] * 3 + [(2, "u", html)], "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to or 0, r.payload_bytes) for r in rows) == [(1, "response", 0, 200), (1, "revisit", 1, 200), (1, "revisit", 1, 200), (2, "revisit", 1, 200)]
    assert round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_read_damaged_archive(spark, pages):
    path = new_path(spark, "damaged")
    files = write_archives(pages.coalesce(1), path)
    name = files.first().file.removeprefix("file:").removeprefix("//")
    with open(name, "r+b") as f:
        f.seek(300)
        f.write(b"\0" * 40)
    rows = read_archives(spark, files).collect()
    assert sum(r.kind == "gap" for r in rows) >= 1 and sum(r.kind == "record" for r in rows) >= pages.count() - 2
    assert all(r.end > r.start for r in rows)
