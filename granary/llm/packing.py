"""Best-fit packing of token sequences by linear grouping.

Lengths are whole numbers up to the capacity, so a histogram of `capacity` counters says all that a plan needs: it is made on the driver from those
counters alone, as runs of equal sequences, and its size depends on the capacity and not on the number of documents. Executors tokenise, number the
pieces of each length and look their place up in the plan.
"""

from __future__ import annotations

import base64
import math
import re
import struct
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

CAPACITY = 2048
#: How byte-level BPE cuts a text into pre-tokens (a fixed pattern of the vocabulary, written so that runs are not gone back into).
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Characters of a text that are encoded by ranks at once, about.
BLOCK = 1 << 20
#: Characters of white space in a row that are still encoded by ranks: the pattern's matcher keeps a state a character there, up to a million.
LONGEST_SPACE = 100_000
#: A boundary between pre-tokens in any text.
BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
#: Words of which a worker remembers the ids, at most, by their place in a line (about 25 MB each).
REMEMBERED = 100_000
#: Lengths over this share of the capacity are large: they are grouped and put into configurations; the others fill what is left.
LARGE = 1 / 3
#: Numbers of groups that are tried.
GROUPS = (64, 256, 512)


def blocks(text: str, size: int) -> Iterator[str]:
    """text in parts of `size` characters or more, each up to the next boundary between pre-tokens."""
    at = 0
    while m := BOUNDARY.search(text, at + size):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


class Encoder:
    """Ids of texts under a byte-level BPE vocabulary, as little-endian unsigned 32-bit bytes.

    A boundary between pre-tokens lies before every single space between two other characters that are not white space. With ranks, a text is encoded in blocks cut
    there, a call a block: what it costs does not depend on how many different words there are. Without them, words are encoded one by one and remembered, and texts with
    other white space than single spaces and line ends between words go to the tokenizer whole; so do texts with the name of a special token, and blocks with white space
    over LONGEST_SPACE."""

    def __init__(self, path: str, ranks: str | None = None) -> None:
        """path: the tokenizer's JSON file. ranks: the same vocabulary as a file of ranks, by which texts are encoded faster, to the same ids."""
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.ranked = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.ranked = tiktoken.Encoding("ranks", pat_str=PRE_TOKEN, mergeable_ranks=pairs, special_tokens={}).encode_ordinary

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.line_end = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, known: dict[str, bytes], words: Sequence[str], lead: str) -> None:
        new = list({w for w in words if w not in known})
        if not new:
            return
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list(set(words))
        for w, e in zip(new, self.tokenizer.encode_batch_fast([lead + w for w in new], add_special_tokens=False), strict=True):
            known[w] = struct.pack(f"<{len(e.ids)}I", *e.ids)

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        if self.ranked:
            return b"".join(map(self._by_ranks, blocks(text, BLOCK)))
        lines = text.split("\n")
        parts = [line.split(" ") for line in lines]
        if any(not p[0] or not p[-1] for p in parts) or "  " in text or len(text.split()) != sum(map(len, parts)):
            return self.whole(text)
        out = []
        for p in parts:
            out.append(self._words(self.first, p[:1], ""))
            if len(p) > 1:
                out.append(self._words(self.later, p[1:], " "))
            out.append(self.line_end)
        return b"".join(out[:-1])

    def _by_ranks(self, text: str) -> bytes:
        if len(text) > LONGEST_SPACE and re.search(rf"(?<!\s)\s{{{LONGEST_SPACE}}}", text):
            return self.whole(text)
        return np.array(array("I", self.ranked(text)), "<u4").tobytes()

    def _words(self, known: dict[str, bytes], words: list[str], lead: str) -> bytes:
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            self.learn(known, words, lead)
            return b"".join([known[w] for w in words])


_encoders: dict[tuple[str, str | None], Encoder] = {}


def encoder(path: str, ranks: str | None = None) -> Encoder:
    """This worker's encoder, which remembers words from task to task."""
    if (path, ranks) not in _encoders:
        _encoders[path, ranks] = Encoder(path, ranks)
    return _encoders[path, ranks]


def tokenize_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, columns: tuple[str, ...] = ("doc_id",), ranks: str | None = None) -> DataFrame:
    """Tokenise every text (null: empty), add `end_id` and cut what is longer than `capacity` into pieces of that length, the first one shorter where they do
    not come out even.

    Returns a row a piece: the columns given, piece (int, from 0), start (long, its document's ids before it), length (long), ids (binary, little-endian unsigned 32-bit)."""
    n = len(columns)
    schema = docs.select(*columns).withColumns({"piece": F.lit(0), "start": F.lit(0).cast("long"), "length": F.lit(0).cast("long"), "ids": F.lit(b"")}).schema
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, ranks)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows, piece, start, length, ids = [], [], [], [], []
                for i, t in enumerate(batch.column(n)):
                    data = enc.encode(t.as_py() or "") + end
                    total = len(data) // 4
                    a = 0
                    for k, b in enumerate(range((total - 1) % capacity + 1, total + 1, capacity)):
                        rows.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        ids.append(data[4 * a : 4 * b])
                        a = b
                kept = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:n]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], schema.names)

    return docs.select(*columns, "text").mapInArrow(run, schema)


class _Plan:
    """Runs of equal sequences. A run: [lengths of its slots, sequences, room left]."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.by_room: dict[int, list[list]] = {}
        self.rooms: list[int] = []

    def add(self, lengths: tuple[int, ...], n: int) -> None:
        room = self.capacity - sum(lengths)
        if room not in self.by_room:
            self.by_room[room] = []
            insort(self.rooms, room)
        self.by_room[room].append([lengths, n])

    def best_fit(self, counts: np.ndarray) -> None:
        """Put what is left, from long to short, where the least room is left that holds it; a sequence takes as many equal ones as fit."""
        for length in range(len(counts) - 1, 0, -1):
            left = int(counts[length])
            while left:
                k = bisect_left(self.rooms, length)
                if k == len(self.rooms):
                    each = self.capacity // length
                    if left >= each:
                        self.add((length,) * each, left // each)
                        left %= each
                    else:
                        self.add((length,) * left, 1)
                        left = 0
                    continue
                room = self.rooms[k]
                lengths, n = self.by_room[room].pop()
                if not self.by_room[room]:
                    del self.by_room[room]
                    self.rooms.pop(k)
                each = min(room // length, left)
                m = min(n, left // each)
                self.add(lengths + (length,) * each, m)
                if n > m:
                    self.add(lengths, n - m)
                left -= m * each

    def runs(self) -> list[tuple[tuple[int, ...], int]]:
        return [(lengths, n) for room in sorted(self.by_room) for lengths, n in self.by_room[room]]


def _fullest(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[int]:
    """The configuration of available sizes that holds the largest one left and fills the capacity best: how many of each size. reach[c] is the size index by which
    a sum c was first reached, used[c] how many of that size it takes."""
    largest = int(np.flatnonzero(counts)[-1])
    take = [0] * len(sizes)
    take[largest] = 1
    room = capacity - int(sizes[largest])
    by = np.full(room + 1, -1, np.int32)
    by[0] = len(sizes)
    used = np.zeros(room + 1, np.int32)
    for k in range(largest, -1, -1):
        size, have = int(sizes[k]), int(counts[k]) - (k == largest)
        if have <= 0 or size > room:
            continue
        used[:] = 0
        for c in range(1, min(have, room // size) + 1):
            reached = (by[: room + 1 - size] >= 0) & (used[: room + 1 - size] == c - 1) & ((by[: room + 1 - size] == k) if c > 1 else (by[: room + 1 - size] != k))
            new = np.flatnonzero(reached & (by[size:] < 0)) + size
            if not len(new):
                break
            by[new] = k
            used[new] = c
        if by[room] >= 0:
            break
    at = int(np.flatnonzero(by >= 0)[-1])
    while at:
        k = int(by[at])
        take[k] += 1
        at -= int(sizes[k])
    return take


def plan_runs(histogram: dict[int, int], capacity: int = CAPACITY, large: float = LARGE, groups: int = 64) -> list[tuple[tuple[int, ...], int]]:
    """Runs (lengths of the slots, number of sequences) that hold every piece of the histogram.

    1. Full pieces are sequences of their own. 2. Large lengths, sorted, are cut into `groups` groups of equal numbers of pieces and rounded up to their group's greatest: few
    sizes are left. 3. Configurations of these sizes are chosen one by one: the fullest that holds the largest size left, as often as the counts allow. 4. Actual pieces take
    the places of their group's size, the longest first. 5. What is left, and all small pieces, go best-fit into the room that remains."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    plan = _Plan(capacity)
    if counts[capacity]:
        plan.add((capacity,), int(counts[capacity]))
        counts[capacity] = 0
    big = np.flatnonzero(counts)
    big = big[big > large * capacity]
    total = int(counts[big].sum())
    if total:
        group = np.minimum((np.cumsum(counts[big]) - 1) * groups // total, groups - 1)
        members = [big[group == g] for g in np.unique(group)]
        sizes = np.array([m[-1] for m in members])
        have = np.array([counts[m].sum() for m in members])
        queues = [[[int(x), int(counts[x])] for x in m] for m in members]
        while have.any():
            take = np.array(_fullest(sizes, have, capacity))
            times = int((have[take > 0] // take[take > 0]).min())
            have -= take * times
            _substitute(plan, take, times, queues)
        counts[big] = 0
    plan.best_fit(counts)
    return plan.runs()


def _substitute(plan: _Plan, take: np.ndarray, times: int, queues: list[list[list[int]]]) -> None:
    """Put actual lengths into `times` sequences of the configuration `take`, as runs in which every slot's length stays the same."""
    slots = [k for k in range(len(take) - 1, -1, -1) for _ in range(int(take[k]))]
    lanes: list[list[list[int]]] = []
    for k in slots:
        need, lane = times, []
        while need:
            length, n = queues[k][-1]
            m = min(n, need)
            lane.append([length, m])
            need -= m
            if m == n:
                queues[k].pop()
            else:
                queues[k][-1][1] -= m
        lanes.append(lane)
    left = times
    while left:
        m = min(lane[-1][1] for lane in lanes)
        plan.add(tuple(lane[-1][0] for lane in lanes), m)
        for lane in lanes:
            lane[-1][1] -= m
            if not lane[-1][1]:
                lane.pop()
        left -= m


def best_plan(histogram: dict[int, int], capacity: int = CAPACITY, large: float = LARGE, groups: Sequence[int] = GROUPS) -> list[tuple[tuple[int, ...], int]]:
    """The plan of fewest sequences over the numbers of groups tried."""
    return min((plan_runs(histogram, capacity, large, g) for g in groups), key=lambda runs: sum(n for _, n in runs))


def _lookup(runs: list[tuple[tuple[int, ...], int]], capacity: int) -> tuple[np.ndarray, ...]:
    """Arrays over (length, first number): start of the run of numbers, first sequence and offset, sorted by length and number."""
    sequence, next_number, rows = 0, [0] * (capacity + 1), []
    for lengths, n in runs:
        offset = 0
        for x in lengths:
            rows.append((x, next_number[x], sequence, offset))
            next_number[x] += n
            offset += x
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3]


def with_crc(pieces: DataFrame) -> DataFrame:
    """pieces with ids_crc32 (long, unsigned) in place of ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, large: float = LARGE, groups: Sequence[int] = GROUPS) -> DataFrame:
    """Add sequence_id and offset (long) to pieces, a table in the shared folder with `length` from 1 to capacity.

    The n pieces of a length are numbered from 0: they are dealt by the hash of all their columns into sqrt(n) buckets, numbered there, and start after the buckets before. The plan gives
    each (length, number) its sequence and offset."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `capacity` rows
    histogram = {r["length"]: r["n"] for r in counts}
    lengths, numbers, sequences, offsets = _lookup(best_plan(histogram, capacity, large, groups) if histogram else [], capacity)
    first_of = np.searchsorted(lengths, np.arange(capacity + 2))
    shared = spark.sparkContext.broadcast((numbers, sequences, offsets, first_of))
    dealt = spark.createDataFrame([(x, math.isqrt(n - 1) + 1) for x, n in histogram.items()], "length long, _buckets long")
    work = pieces.join(F.broadcast(dealt), "length").withColumn("_bucket", F.pmod(F.xxhash64(*[c for c in pieces.columns if c != "length"]), F.col("_buckets"))).drop("_buckets")
    sums = work.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("length", "_bucket", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    order = [F.col(c) for c in pieces.columns if c not in ("length", "ids")]
    numbered = work.withColumn("_at", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order)) - 1).join(starts, ["length", "_bucket"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        numbers, sequences, offsets, first_of = shared.value
        x, k = length.to_numpy(), number.to_numpy()
        # numbers ascend within a length: shifting each length's stretch makes the whole array ascend
        step = np.int64(1) << np.int64(40)
        flat = np.repeat(np.arange(len(first_of) - 1, dtype=np.int64), np.diff(first_of)) * step + numbers
        at = np.searchsorted(flat, x * step + k, "right") - 1
        return pd.DataFrame({"sequence_id": sequences[at] + (k - numbers[at]), "offset": offsets[at]})

    placed = numbered.withColumn("_p", place("length", F.col("_start") + F.col("_at")))
    return placed.select(*pieces.columns, "_p.sequence_id", "_p.offset")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, digest: Callable[[DataFrame], DataFrame] | None = None, ranks: str | None = None, **options) -> DataFrame:
    """Tokenise, cut and pack docs into sequences of at most `capacity` ids.

    Returns a row a piece: doc_id, piece, start, length, ids (or what `digest` makes of it: it is applied before pieces are stored), sequence_id, offset. Pieces of a sequence lie at offsets without gaps. A null text is empty and
    still has its end id; repeated rows are packed as documents of their own; an empty table gives an empty result. Of equal (doc_id, piece) rows it is open which lies where."""
    pieces = tokenize_pieces(docs, tokenizer, capacity, ranks=ranks)
    pieces = materialise(digest(pieces) if digest else pieces, "pieces")
    return pack_pieces(pieces, capacity, **options)
