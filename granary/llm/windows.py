"""Bounded-space online packing of token sequences.

A task takes its documents as they come and keeps a fixed number of windows open. A document goes where it fits best; where it fits nowhere and no more windows may be opened, its head fills up the fullest
window, which is emitted, and the rest is placed in the same way. So a task holds a few windows of ids, whatever its input, and documents are never shuffled. At its end a task joins its open windows, and what
is left of each task, less than one window, is joined over all tasks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, quoted

CAPACITY = 4096
#: The id after each document.
END = 2
#: Windows that a task keeps open.
OPEN = 16
#: Words of which a worker remembers the ids, at most twice as many and those of one text, and their longest in characters.
REMEMBERED, LONGEST = 300_000, 40
#: What the vocabulary's pattern says of texts up to U+00FF (fixed values of the vocabulary): endings, letters, digits, white space; all else runs together.
ENDINGS, LETTERS, DIGITS, SPACES = "'s|'t|'re|'ve|'m|'ll|'d", "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
WORDS = re.compile(f"{ENDINGS}|[{LETTERS}]+|[{DIGITS}]|[^{SPACES}{LETTERS}{DIGITS}]+")


class WordEncoder:
    """Ids under a BPE vocabulary that drops white space, as little-endian unsigned 32-bit bytes.

    Texts up to U+00FF are cut into words here: their lower case is that of each character and nothing in them is composed. A word's ids depend on the word alone, so they are remembered: up to REMEMBERED new
    ones, and those before them until as many are new again. Other texts, and those that may name a special token, go to the tokenizer as they are."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return np.array(self._whole(text), "<u4").tobytes()
        if "<|" in text:
            return np.array(self._whole(text), "<u4").tobytes()
        words = WORDS.findall(text.lower())
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, {}
        known, before = self.known, self.before
        if new := set(words).difference(known):
            known.update((w, before[w]) for w in new if w in before)
            known.update(self._learn([w for w in new if w not in known]))
        out = b"".join([known[w] for w in words])
        for w in new:
            if len(w) > LONGEST:
                del known[w]
        return out

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words, all encoded as one text with spaces between them."""
        if not words:
            return {}
        whole = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        of = np.array(whole.word_ids)
        edges = np.flatnonzero(np.diff(of, prepend=-1))
        if len(edges) != len(words):
            raise RuntimeError("the tokenizer cuts words in another way than this encoder")
        data, bounds = np.array(whole.ids, "<u4").tobytes(), [*(4 * edges).tolist(), 4 * len(of)]
        return {w: data[a:b] for w, a, b in zip(words, bounds[:-1], bounds[1:], strict=True)}


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class Packer:
    """Open windows of one task. A piece is (document, start, ids as bytes, offset)."""

    def __init__(self, capacity: int = CAPACITY, windows: int = OPEN) -> None:
        if windows < 1:
            raise ValueError("at least one window has to be open")
        self.capacity, self.windows = capacity, windows
        self.pieces: list[list[tuple]] = []
        self.used: list[int] = []

    def _put(self, k: int, doc, start: int, ids: bytes) -> list[tuple] | None:
        """Put ids at the end of window k; the window's pieces if it is full now."""
        self.pieces[k].append((doc, start, ids, self.used[k]))
        self.used[k] += len(ids) // 4
        if self.used[k] < self.capacity:
            return None
        self.used.pop(k)
        return self.pieces.pop(k)

    def add(self, doc, ids: bytes) -> Iterator[list[tuple]]:
        """Place a document; full windows as they are emitted."""
        at, end, full = 0, len(ids), 4 * self.capacity
        while at < end:
            if end - at >= full:
                yield [(doc, at // 4, ids[at : at + full], 0)]
                at += full
                continue
            n = (end - at) // 4
            fits = [(self.capacity - u, k) for k, u in enumerate(self.used) if self.capacity - u >= n]
            if fits:
                k, take = min(fits)[1], n
            elif len(self.used) < self.windows:
                self.pieces.append([])
                self.used.append(0)
                k, take = len(self.used) - 1, n
            else:
                k = max(range(len(self.used)), key=self.used.__getitem__)
                take = self.capacity - self.used[k]
            if done := self._put(k, doc, at // 4, ids[at : at + 4 * take]):
                yield done
            at += 4 * take

    def finish(self) -> Iterator[tuple[list[tuple], bool]]:
        """Join the open windows, the fullest first: pieces are cut where a window is full. The last window is marked as one that is not."""
        rest = sorted(zip(self.used, self.pieces, strict=True), key=lambda x: -x[0])
        self.used, self.pieces = [], []
        out: list[tuple] = []
        used = 0
        for _, pieces in rest:
            for doc, start, ids, _ in pieces:
                while ids:
                    take = min(4 * (self.capacity - used), len(ids))
                    out.append((doc, start, ids[:take], used))
                    used += take // 4
                    start, ids = start + take // 4, ids[take:]
                    if used == self.capacity:
                        yield out, True
                        out, used = [], 0
        if out:
            yield out, False


def _packed(docs: DataFrame, tokenizer: str, capacity: int, windows: int, end_id: int, ids_kept: bool) -> DataFrame:
    """docs: row, text. Pieces with the task (part) and its window's number (at); whole: the window is full. Ids stay where asked for and in windows that are not full."""
    schema = docs.select("row").withColumns({n: F.lit(v).cast(t) for n, v, t in (("start", 0, "long"), ("length", 0, "long"), ("ids_crc32", 0, "long"), ("doc_tokens", 0, "long"), ("offset", 0, "long"), ("part", 0, "int"), ("at", 0, "long"), ("whole", True, "boolean"), ("ids", None, "binary"))}).schema
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer, part = encoder(tokenizer), Packer(capacity, windows), TaskContext.get().partitionId()
        emitted = 0
        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            nonlocal size
            columns = list(zip(*rows, strict=True))
            rows.clear()
            size = 0
            # a document is its row as an Arrow array of one
            row = pa.concat_arrays(columns[0])
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary())
            return pa.RecordBatch.from_arrays([row, *[pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True)]], schema.names)

        def put(pieces: Sequence[tuple], whole: bool) -> None:
            nonlocal emitted, size
            for (row, tokens), start, ids, offset in pieces:
                rows.append((row, start, len(ids) // 4, zlib.crc32(ids), tokens, offset, part, emitted, whole, ids if ids_kept or not whole else None))
                size += len(ids) if ids_kept else 256
            emitted += 1

        for b in batches:
            for i, t in enumerate(b.column(1)):
                ids = enc.encode(t.as_py() or "") + end
                for pieces in packer.add((b.column(0).slice(i, 1), len(ids) // 4), ids):
                    put(pieces, True)
                if size >= 1 << 21:
                    yield batch()
        for pieces, whole in packer.finish():
            put(pieces, whole)
        if rows:
            yield batch()

    return docs.mapInArrow(run, schema)


def _powers(n: int) -> list[int]:
    """Powers of two that add up to n, from large to small."""
    return [1 << b for b in reversed(range(n.bit_length())) if n >> b & 1]


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, windows: int = OPEN, end_id: int = END, columns: Sequence[str] = ("doc_id",), ids: bool = True) -> DataFrame:
    """Tokenise docs' texts, add `end_id` to each and pack them into sequences of at most `capacity` ids (a power of two), of which the last few are powers of two and all others full: nothing is padded.

    Returns a row a piece: the columns given, start (long, its document's ids before it), length (long), ids_crc32 (long, unsigned, of the ids as little-endian unsigned 32-bit numbers), doc_tokens (long, its
    document's ids), sequence_id (long; from -1 down for those made of what tasks had left), offset (long, gapless from 0), and ids (binary) unless ids is False. Each id of a document lies in one piece.
    A document is cut where it is longer than a sequence, where no open window of its task holds it, or where open windows are joined at the end.

    A null text is empty and has its end id; repeated rows are documents of their own; an empty table gives an empty result. Columns given must not have the name of one of the result; other columns are not read.
    Where documents lie follows how Spark cuts the table into tasks and is read from the stored pieces: it does not change within one result. Windows in memory: `windows` of `capacity` ids a task, and one document."""
    if capacity & (capacity - 1):
        raise ValueError("capacity has to be a power of two")
    own = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    if clash := set(own) & set(columns):
        raise ValueError(f"columns of the result: {sorted(clash)}")
    spark = docs.sparkSession
    row = F.struct(*[F.col(quoted(c)) for c in columns]).alias("row")
    pieces = materialise(_packed(docs.select(row, F.col("text")), tokenizer, capacity, windows, end_id, ids), "pieces")
    left = pieces.filter("not whole")
    # one number a task, as in common.with_global_index
    totals = left.groupBy("part").agg(F.sum("length").alias("n")).orderBy("part").collect()
    base, bases = 0, []
    for r in totals:
        bases.append((r["part"], base))
        base += r["n"]
    full, rest = divmod(base, capacity)
    edges = np.cumsum([full * capacity, *_powers(rest)]).tolist()
    ends = left.join(F.broadcast(spark.createDataFrame(bases, "part int, base long")), "part").withColumn("from", F.col("base") + F.col("offset")).withColumn("to", F.col("from") + F.col("length"))
    inner = F.concat(F.array(F.col("from")), F.transform(F.sequence((F.col("from") / capacity).cast("long") + 1, (F.col("to") / capacity).cast("long") + 1), lambda x: x * capacity), F.array(*[F.lit(x).cast("long") for x in edges]))
    cuts = F.array_sort(F.array_distinct(F.filter(inner, lambda x: (x >= F.col("from")) & (x < F.col("to")))))
    cut = ends.withColumn("cuts", cuts).select("*", F.posexplode("cuts").alias("k", "a")).withColumn("b", F.coalesce(F.get("cuts", F.col("k") + 1), F.col("to")))
    last = F.array(*[F.lit(x).cast("long") for x in edges])
    number = F.when(F.col("a") < full * capacity, (F.col("a") / capacity).cast("long")).otherwise(F.lit(full - 1) + F.size(F.filter(last, lambda x: x <= F.col("a"))))
    first = F.when(F.col("a") < full * capacity, (F.col("a") / capacity).cast("long") * capacity).otherwise(F.array_max(F.filter(last, lambda x: x <= F.col("a"))))
    part = F.substring(F.col("ids"), (4 * (F.col("a") - F.col("from")) + 1).cast("int"), (4 * (F.col("b") - F.col("a"))).cast("int"))
    merged = cut.select(
        "row",
        (F.col("start") + F.col("a") - F.col("from")).alias("start"),
        (F.col("b") - F.col("a")).alias("length"),
        F.crc32(part).alias("ids_crc32"),
        "doc_tokens",
        (-1 - number).cast("long").alias("sequence_id"),
        (F.col("a") - first).alias("offset"),
        part.alias("ids"),
    )
    whole = pieces.filter("whole").select("row", "start", "length", "ids_crc32", "doc_tokens", (F.shiftleft(F.col("part").cast("long"), 40) + F.col("at")).alias("sequence_id"), "offset", "ids")
    return whole.unionByName(merged).select("row.*", *(own if ids else own[:-1]))
