"""WARC archives: a writer that stores equal payloads once, and a salvage reader.

The writer makes one gzip member a record. The reader checks every record (gzip checksum, headers, length, block digest); after a failed check it looks for the next valid
member or version line, goes on from there, and logs the bytes between as a quarantined gap. Files are read and written in chunks through pyarrow's file systems by the tasks
that Spark hands them to.
"""

from __future__ import annotations

import hashlib
import logging
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import KEY, join_small, materialise, new_path, release, remove_folder, row_key

log = logging.getLogger(__name__)

#: Payloads of fewer bytes are always stored.
LEAST_SHARED = 100
#: Compressed bytes after which a writer starts the next file.
FILE_BYTES = 32 << 20
#: Bytes read at a time, and the most that one record's headers may have, in a member or not.
CHUNK, MOST_HEADER = 1 << 20, 1 << 26
#: The most bytes of a record: what one value of a Spark column can hold. Longer ones are quarantined.
MOST_RECORD = (1 << 31) - (1 << 16)
VERSIONS = (b"WARC/1.0\r\n", b"WARC/1.1\r\n")
MAGIC = b"\x1f\x8b\x08"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path:
        return pafs.LocalFileSystem(), path.removeprefix("file:")
    return pafs.FileSystem.from_uri(quote(path, safe="/:@?&=%+,;~!*()'$"))


def record(kind: str, rid: str, uri: str, date: str, payload: bytes, digest: str, refers_to: str | None = None) -> bytes:
    """One WARC record; a revisit's block is empty and names the record that has its payload."""
    block = b"" if kind == "revisit" else payload
    lines = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{rid}>"),
        ("WARC-Target-URI", uri),
        ("WARC-Date", date),
        ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
    ]
    if refers_to:
        lines += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{refers_to}>")]
    lines += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _sums(pages: DataFrame) -> DataFrame:
    """A row for each distinct page: k1, k2, page_id, digest and bytes of its payload, copies (rows that are equal)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(*row_key("page_id", "url", "html"), "page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    return rows.groupBy(*KEY).agg(*[F.first(c).alias(c) for c in ("page_id", "digest", "bytes")], F.count(F.lit(1)).alias("copies"))


def _same(sums: DataFrame) -> DataFrame:
    """digest, first (k1 and k2 of the row that is stored), of payloads that several rows share."""
    least = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", *KEY))
    shared = sums.filter(F.col("bytes") >= LEAST_SHARED).groupBy("digest").agg(F.sum("copies").alias("n"), least.alias("first"))
    return materialise(shared.filter("n > 1").select("digest", F.col("first.k1").alias("f1"), F.col("first.k2").alias("f2")), "shared")


def record_id(k1: int, k2: int, twin: int) -> str:
    """Name of the record of the `twin`-th of equal rows."""
    return f"urn:page:{k1 & (1 << 64) - 1:016x}{k2 & (1 << 64) - 1:016x}:{twin}"


def _record_id(k1: str, k2: str, twin: F.Column) -> F.Column:
    """record_id() as a column."""
    return F.concat(F.lit("urn:page:"), *[F.lower(F.lpad(F.hex(k), 16, "0")) for k in (k1, k2)], F.lit(":"), twin.cast("string"))


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", sums: DataFrame | None = None) -> DataFrame:
    """Write a record for every row of pages (page_id, url, html) to WARC files under path; a table of file, records, bytes (one row a file).

    Payload: the html in UTF-8 (null: empty). Of rows with equal payloads of at least LEAST_SHARED bytes the one with the smallest page_id is stored as response, the
    others as revisits of it. Which payloads are shared is found on digests alone; texts stay in their scan where the list of shared digests is small enough to broadcast.
    A task writes to a name of its own attempt and renames the file when it is whole, so an attempt that is lost or repeated leaves no half file in the table. A null url is
    written as empty. Equal rows are records of their own; other columns of pages are not read, whatever their names."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    sums = _sums(pages) if sums is None else sums
    shared = _same(sums)
    twins = materialise(sums.filter("copies > 1").select(*KEY), "twins")
    work = join_small(pages.select(*row_key("page_id", "url", "html"), "url", "html", F.sha2(payload, 256).alias("digest")), shared, "digest").withColumn("twin", F.lit(1))
    if twins.limit(1).count():  # equal rows: number them, so that only one of those with the first key is the response
        again = join_small(work, twins, KEY, "left_semi").withColumn("twin", F.row_number().over(Window.partitionBy(*KEY).orderBy(*KEY)))
        work = join_small(work, twins, KEY, "left_anti").unionByName(again)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        fs, base = file_system(path)
        fs.create_dir(base, recursive=True)
        out, name, count, size = None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            fs.move(f"{base}/_{name}.open", f"{base}/{name}.warc.gz")
            return pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}.warc.gz"]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], ["file", "records", "bytes"])

        for batch in batches:
            for url, text, digest, *keys in zip(*batch.columns, strict=True):
                if out is None:
                    name, count, size = f"part-{uuid.uuid4().hex}", 0, 0
                    out = fs.open_output_stream(f"{base}/_{name}.open", compression=None)
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                k1, k2, f1, f2, twin = (x.as_py() for x in keys)
                again = f1 is not None and ((f1, f2) != (k1, k2) or twin > 1)
                uri = quote(url.as_py() or "", safe="/:@?&=%+,;~!*()'$#[]")
                done = member(record("revisit" if again else "response", record_id(k1, k2, twin), uri, date, data, digest.as_py(), record_id(f1, f2, 1) if again else None))
                out.write(done)
                count, size = count + 1, size + len(done)
                if size >= FILE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return materialise(work.select("url", "html", "digest", *KEY, "f1", "f2", "twin").mapInArrow(run, "file string, records long, bytes long"), "archives")


@dataclass
class Found:
    """A record, or a gap (kind "gap", with the reason) from byte start to end of its file."""

    kind: str
    start: int
    end: int
    headers: dict[str, str]
    block: bytes
    reason: str = ""


class Broken(Exception):
    pass


def check_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of the bytes of one whole record."""
    if not data.startswith(VERSIONS):
        raise Broken("no version line")
    cut = data.find(b"\r\n\r\n", 0, MOST_HEADER)
    if cut < 0:
        raise Broken("headers do not end")
    headers = parse_headers(data[:cut])
    n = content_length(headers)
    block = data[cut + 4 : cut + 4 + n]
    if data[cut + 4 + n :] != b"\r\n\r\n" or len(block) != n:
        raise Broken("length")
    check_digest(headers, block)
    return headers, block


def parse_headers(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise Broken("header line")
        out[name.decode("latin-1").lower()] = value.strip().decode("utf-8", "surrogateescape")
    if "warc-type" not in out:
        raise Broken("no type")
    return out


def content_length(headers: dict[str, str]) -> int:
    n = headers.get("content-length", "")
    if not n.isascii() or not n.isdigit() or len(n) > 12:
        raise Broken("no length")
    return int(n)


def check_digest(headers: dict[str, str], block: bytes) -> None:
    kind, _, want = headers.get("warc-block-digest", "").partition(":")
    if kind == "sha256" and hashlib.sha256(block).hexdigest() != want.lower():
        raise Broken("digest")


class Source:
    """Bytes of a file by position, in chunks; what lies before the last position asked for is forgotten."""

    def __init__(self, stream: pa.NativeFile) -> None:
        self.stream, self.base, self.data, self.over = stream, 0, bytearray(), False

    def at(self, start: int, n: int) -> bytes:
        """Up to n bytes from start on."""
        while not self.over and self.base + len(self.data) < start + n:
            more = self.stream.read(max(CHUNK, start + n - self.base - len(self.data)) if start + n - self.base < 8 * CHUNK else CHUNK)
            if not more:
                self.over = True
            self.data += more
        return bytes(self.data[start - self.base : start - self.base + n])

    def forget(self, before: int) -> None:
        if before - self.base >= CHUNK:
            del self.data[: before - self.base]
            self.base = before


def _gzip_record(src: Source, start: int, most: int) -> tuple[int, dict[str, str], bytes]:
    """End, headers and block of the record whose member starts here."""
    z, out, at, size = zlib.decompressobj(31), [], start, 0
    try:
        while not z.eof:
            part = src.at(at, CHUNK)
            if not part:
                raise Broken("member does not end")
            got = z.decompress(part)
            if size == 0 and got and not got[:10].startswith(tuple(v[: len(got[:10])] for v in VERSIONS)):
                raise Broken("no version line")
            out.append(got)
            size += len(got)
            if size > most:
                raise Broken("too long")
            at += len(part) - len(z.unused_data)
    except zlib.error:
        raise Broken("member") from None
    return (at, *check_record(b"".join(out)))


def _plain_record(src: Source, start: int, most: int) -> tuple[int, dict[str, str], bytes]:
    head = src.at(start, 1 << 16)
    if not head.startswith(VERSIONS):
        raise Broken("no version line")
    while (cut := head.find(b"\r\n\r\n", 0, MOST_HEADER)) < 0:
        # look further while what is there can still be headers
        if any(b":" not in line for line in head.split(b"\r\n")[1:-1]) or len(head) >= MOST_HEADER:
            raise Broken("headers do not end")
        more = src.at(start, 4 * len(head))
        if len(more) == len(head):
            raise Broken("headers do not end")
        head = more
    headers = parse_headers(head[:cut])
    n = content_length(headers)
    if n > most:
        raise Broken("too long")
    body = src.at(start + cut + 4, n + 4)
    if body[n:] != b"\r\n\r\n":
        raise Broken("length")
    check_digest(headers, body[:n])
    return start + cut + 4 + n + 4, headers, body[:n]


def salvage(stream: pa.NativeFile, most: int = MOST_RECORD) -> Iterator[Found]:
    """Records of a file of gzip members, of plain records, or of both, and the gaps between them. most: bytes of a record, beyond which it is quarantined."""
    src, at, gap, reason = Source(stream), 0, None, ""
    while True:
        src.forget(at if gap is None else max(gap, at - 16))
        start = src.at(at, 10)
        if not start:
            break
        try:
            if start.startswith(MAGIC):
                end, headers, block = _gzip_record(src, at, most)
            elif start in VERSIONS:
                end, headers, block = _plain_record(src, at, most)
            else:
                raise Broken("neither member nor version line")
        except Broken as e:
            if gap is None:
                gap, reason = at, str(e)
            at = _next(src, at + 1)
            continue
        if gap is not None:
            yield Found("gap", gap, at, {}, b"", reason)
            gap = None
        yield Found("record", at, end, headers, block)
        at = end
    if gap is not None:
        yield Found("gap", gap, at, {}, b"", reason)


def _next(src: Source, at: int) -> int:
    """Where the next member or version line may start, at or after a byte; the end of the file if there is none."""
    while True:
        part = src.at(at, CHUNK)
        hits = [i for i in (part.find(MAGIC), *(part.find(v) for v in VERSIONS)) if i >= 0]
        if hits:
            return at + min(hits)
        if len(part) < CHUNK:
            return at + len(part)
        at += len(part) - 9
        src.forget(at)


def read_archives(spark: SparkSession, files: DataFrame, most: int = MOST_RECORD) -> DataFrame:
    """files: file (paths). A row a record or gap: file, start, end (bytes of the file), kind (record or gap), reason (of a gap), type, record_id, uri, refers_to, digest (as its header says), payload (binary).

    Files are dealt out evenly; a task streams its files. Any file may be damaged anywhere: see salvage()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = schema.names
        for batch in batches:
            for file in batch.column(0).to_pylist():
                fs, path = file_system(file)
                rows, size = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for x in salvage(stream, most):
                        h = x.headers
                        bare = lambda k, h=h: h[k].strip("<>") if k in h else None
                        rows.append((file, x.start, x.end, x.kind, x.reason or None, h.get("warc-type"), bare("warc-record-id"), unquote(h["warc-target-uri"]) if "warc-target-uri" in h else None, bare("warc-refers-to"), h.get("warc-payload-digest"), x.block if x.kind == "record" else None))
                        size += len(x.block)
                        if size >= 4 * CHUNK or len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], names)

    arrow = pa.schema([("file", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("reason", pa.string()), ("type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("payload", pa.binary())])
    schema = spark.createDataFrame([], "file string, start long, end long, kind string, reason string, type string, record_id string, uri string, refers_to string, digest string, payload binary").schema
    n = max(1, files.count())
    dealt = files.select("file").repartition(min(n, 4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))), "file")
    return dealt.mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive pages in the shared folder and read them back. A row per row of pages: page_id, payload_bytes, payload_digest (of the payload read, a revisit's being that of the record it
    refers to), record_type, refers_to (page_id). A page whose record cannot be read back (or, for a revisit, the response's) has nulls there; what the reader had to pass over is
    counted in the log, and its table of gaps stays in the shared folder. The archives themselves are deleted."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    sums = materialise(_sums(pages), "sums")
    files = write_archives(pages, path, sums=sums)
    read = read_archives(spark, files)
    slim = materialise(read.select("file", "start", "end", "kind", "reason", "record_id", "type", "refers_to", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("sum")), "records")
    remove_folder(spark, path)
    release(files)
    gaps = slim.filter("kind = 'gap'").select("file", "start", "end", "reason")
    if n := gaps.count():
        kept = materialise(gaps, "gaps")
        log.warning("%d quarantined gaps, listed in %s", n, kept.inputFiles()[0].rsplit("/", 1)[0])
    slim = slim.filter("kind = 'record'")
    stored = slim.filter("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("bytes").alias("_bytes"), F.col("sum").alias("_sum"))
    first = sums.select(_record_id("k1", "k2", F.lit(1)).alias("refers_to"), F.col("page_id").alias("_first"))
    wanted = slim.filter("type = 'revisit'").groupBy("refers_to").count().select("refers_to").join(stored, "refers_to", "left").join(first, "refers_to", "left")
    again = F.col("type") == "revisit"
    out = join_small(slim, materialise(wanted, "wanted"), "refers_to").select(
        "record_id",
        F.when(again, F.col("_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.when(again, F.col("_sum")).otherwise(F.col("sum")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(again, F.col("_first")).alias("refers_to"),
    )
    rows = sums.select("page_id", *KEY, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("twin")).select("page_id", _record_id("k1", "k2", F.col("twin")).alias("record_id"))
    return rows.join(out, "record_id", "left").drop("record_id")
