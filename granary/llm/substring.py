"""Exact substring dedup by level-wise doubling.

A window of `width` words is removed if its word sequence also starts anywhere else. Windows are not compared at once: level by level, from short
sequences to the full width (each length the half of the next, rounded up), a window is represented by one of the sequences of that length inside it, the one with the least
hash. Equal windows choose equal sequences, so a sequence that is found once in the corpus rules out every window that chose it; the others are
extended to twice the length. At the full width a window stands for itself, and what is left is repeated. Short sequences are compared by 64 bits, where two that fall
together only cost work; windows of the full width by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, KEY, boxed, materialise, quoted, release, row_key

#: Words of a window.
WIDTH = 35
#: Words of the shortest sequences looked at, at least.
SHORTEST = 8
#: Bytes of text that are hashed at a time (a longer text is hashed by itself).
CHUNK = 1 << 21

#: Bytes of a word that are hashed eight at a time by arrays; longer words are hashed one by one.
LANES = 64

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Odd multipliers of the two hashes of a word and of a sequence.
_WORD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))
_SEQUENCE = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_LOW = np.array([0, *[(1 << (8 * n)) - 1 for n in range(1, 8)], (1 << 64) - 1], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def hash_words(texts: list[bytes], which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash (one of two) of each word of the texts, one after the other, and the number of words of each text. A word's bytes are mixed in eight at a time, each
    time through a function that is not linear, so words made to cancel out do not meet."""
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    space = _SPACES[data]
    starts = np.flatnonzero(~space[1:] & space[:-1]) + 1
    if not space[0]:
        starts = np.concatenate(([0], starts))
    ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    length = ends - starts
    wide = np.ndarray(len(joined) + 1, "<u8", joined + bytes(8), strides=(1,))
    hashes = _mix(length.astype(np.uint64) * _WORD[which] + np.uint64(which + 1))
    left = np.flatnonzero(length <= LANES)
    at = 0
    while len(left):
        lane = wide[starts[left] + at] & _LOW[np.minimum(length[left] - at, 8)]
        hashes[left] = _mix((hashes[left] ^ lane) * _WORD[which])
        at += 8
        left = left[length[left] > at]
    for i in np.flatnonzero(length > LANES).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(joined[starts[i] : ends[i]], seed=which)
    first = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return hashes, np.diff(np.searchsorted(starts, first))


def sequence_hashes(words: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of the `length` words from each place on: that of two halves, which overlap by a word if the length is odd."""
    if length == 1:
        return words
    half = (length + 1) // 2
    short = sequence_hashes(words, half, which)
    n = max(0, len(words) - length + 1)
    return _mix(short[:n] * _SEQUENCE[which] + short[length - half : length - half + n])


def least_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each place p the first place of the least of hashes[p : p + width]."""
    n = max(0, len(hashes) - width + 1)
    value, place, span = hashes, np.arange(len(hashes), dtype=np.int32), 1
    while span < width:
        step = min(span, width - span)
        m = len(value) - step
        right = value[step:] < value[:m]
        value, place = np.where(right, value[step:], value[:m]), np.where(right, place[step:], place[:m])
        span += step
    return place[:n]


def alive_windows(n_words: int, dead: np.ndarray | None, width: int) -> np.ndarray:
    """Mask of the windows of a text outside the dead ranges (longs of first << 32 | last)."""
    n = max(0, n_words - width + 1)
    if dead is None or not len(dead) or not n:
        return np.ones(n, bool)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, dead >> 32, 1)
    np.add.at(edge, (dead & 0xFFFFFFFF) + 1, -1)
    return np.cumsum(edge[:n]) == 0


def levels(width: int = WIDTH, shortest: int = SHORTEST) -> list[int]:
    """Lengths from short to `width`, each the half of the next, rounded up."""
    out = [width]
    while (out[0] + 1) // 2 >= shortest:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _chosen(texts: list[bytes], dead: list, length: int, width: int) -> tuple[np.ndarray, ...]:
    """Of the windows still alive, the sequences they chose: text, hash, second hash (of windows; zero for what is shorter), first and last window that chose it, number of
    sequences of the text."""
    words, counts = hash_words(texts)
    ends = np.cumsum(counts)
    hashes = sequence_hashes(words, length)
    place = least_places(hashes, width - length + 1)
    alive = np.zeros(len(place), bool)
    for end, n, d in zip(ends.tolist(), counts.tolist(), dead, strict=True):
        if n >= width:
            alive[end - n : end - width + 1] = alive_windows(n, d, width)
    at = np.flatnonzero(alive)
    if not len(at):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty, empty
    text = np.searchsorted(ends, at, "right")
    new = np.concatenate(([True], (place[at[1:]] != place[at[:-1]]) | (text[1:] != text[:-1])))
    first = at[new]
    last = at[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(at) - 1]))]
    text = text[new]
    base = ends[text] - counts[text]
    second = sequence_hashes(hash_words(texts, 1)[0], length, 1)[place[first]] if length == width else np.zeros(len(first), np.uint64)
    return text, hashes[place[first]].view(np.int64), second.view(np.int64), first - base, last - base, np.bincount(text, minlength=len(texts))[text]


def _level(docs: DataFrame, key: list[str], length: int, width: int) -> DataFrame:
    """docs: the key (one or two longs), dead (array of long or null), text. Rows of the key, h, h2, lo, hi, of."""
    schema = pa.schema([*[(k, pa.int64()) for k in key], ("h", pa.int64()), ("h2", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("of", pa.int32())])
    dead_at, text_at = len(key), len(key) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(key))]
            at = 0
            while at < batch.num_rows:
                start, texts, size = at, [], 0
                while at < batch.num_rows and (not texts or size < CHUNK):
                    texts.append((batch.column(text_at)[at].as_py() or "").encode("utf-8", "surrogatepass"))
                    size += len(texts[-1])
                    at += 1
                dead = [None if not d.is_valid else d.values.to_numpy() for d in batch.column(dead_at)[start:at]]
                text, *found = _chosen(texts, dead, length, width)
                for a in range(0, len(text), 1 << 16):
                    part = slice(a, a + (1 << 16))
                    columns = [k[start + text[part]] for k in keys] + [x[part] for x in found]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(t.type.to_pandas_dtype())) for c, t in zip(columns, schema, strict=True)], schema.names)

    kinds = ", ".join(f"{k} long" for k in key)
    return docs.select(*key, "dead", "text").mapInArrow(run, f"{kinds}, h long, h2 long, lo int, hi int, of int")


def _small(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def short_key(docs: DataFrame) -> list[str]:
    """KEY, or its first half alone where that tells the rows of docs apart as well: a row of every level carries the key, and half of it is half of what is shuffled for it."""
    meets = docs.groupBy("k1").agg((F.min("k2") != F.max("k2")).alias("meets")).filter("meets").limit(1).count()
    return KEY if meets else KEY[:1]


def dead_windows(docs: DataFrame, key: list[str], width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """docs: the key, text. Two tables in the shared folder: the key and dead (the ranges of windows that are not repeated), and the key of texts without a repeated window.

    A level reads texts that have windows left, with their dead ranges. A sequence found once gives its text and range by minima over its only row, so counting is one aggregation with partial sums, without a
    join back, and no hot sequence is gathered anywhere. A level's tables are deleted when the next one's are written."""
    no_dead = F.lit(None).cast("array<long>")
    dead, done = None, None
    for length in levels(width):
        if dead is None:
            work = docs.withColumn("dead", no_dead)
        else:
            left = docs.join(F.broadcast(done), key, "left_anti") if _small(done) else docs.join(done, key, "left_anti")
            work = left.join(dead, key, "left")
        rows = _level(work, key, length, width)
        same = ["h", "h2"] if length == width else ["h"]
        once = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in (*key, "lo", "hi", "of")]).filter("n = 1")
        packed = F.shiftleft(F.col("lo").cast("long"), 32).bitwiseOR(F.col("hi").cast("long"))
        new = once.groupBy(*key).agg(F.collect_list(packed).alias("dead"), (F.count(F.lit(1)) == F.first("of")).alias("done"))
        new = materialise(new, f"dead{length}")
        gone = new.filter("done").select(*key)
        ranges = new.filter("not done").select(*key, "dead")
        if dead is not None:
            ranges = dead.union(ranges).groupBy(*key).agg(F.flatten(F.collect_list("dead")).alias("dead"))
            gone = done.union(gone)
        before = (new, dead, done)
        dead, done = materialise(ranges, "ranges"), materialise(gone, "done")
        release(*before)
    return dead, done


def _cut(text: str | None, dead: np.ndarray | None, width: int) -> tuple[str, int, np.ndarray]:
    """Kept words joined by one space, number of words, ranges of removed words (first and one past the last, one after the other)."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    alive = np.flatnonzero(alive_windows(len(words), dead, width))
    if not len(alive):
        return b" ".join(words).decode("utf-8", "surrogatepass"), len(words), alive
    split = np.flatnonzero(np.diff(alive) > width)
    starts, ends = alive[np.concatenate(([0], split + 1))], alive[np.concatenate((split, [len(alive) - 1]))] + width
    spans = np.stack((starts, ends), axis=1).reshape(-1)
    edges = [0, *spans.tolist(), len(words)]
    kept = [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]]
    return b" ".join(kept).decode("utf-8", "surrogatepass"), len(words), spans


def _apply(docs: DataFrame, columns: list[str], width: int) -> DataFrame:
    """docs: the columns, text, dead, done. The columns, text (kept words), n_words, n_removed, removed (array of word positions: first, end, first, end ...)."""
    n = len(columns)
    schema = docs.select(*columns, "text").withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "removed": F.array(F.lit(0))}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                texts, words, removed, spans = [], [], [], []
                for t, d, gone in zip(batch.column(n), batch.column(n + 1), batch.column(n + 2), strict=True):
                    if gone.as_py():
                        count = len((t.as_py() or "").encode("utf-8", "surrogatepass").split())
                        dead = np.array([max(0, count - width)], np.int64)
                    else:
                        dead = d.values.to_numpy() if d.is_valid else None
                    text, count, cut = _cut(t.as_py(), dead, width)
                    texts.append(text)
                    words.append(count)
                    removed.append(int((cut[1::2] - cut[::2]).sum()))
                    spans.append(cut.astype(np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string()), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.int32()))], schema.names)

    return docs.select(*columns, "text", "dead", "done").mapInArrow(run, schema)


def _judged(docs: DataFrame, columns: list[str], width: int) -> DataFrame:
    """docs: the columns, k1, k2, text. What _apply() returns for every row."""
    key = short_key(docs)
    dead, done = dead_windows(docs.select(*key, "text"), key, width)
    done = done.withColumn("done", F.lit(True))
    if _small(done):
        flagged = docs.join(F.broadcast(done), key, "left")
        clean = flagged.filter("done").withColumn("dead", F.lit(None).cast("array<long>"))
        rest = flagged.filter("done is null").join(dead, key, "left")
        return _apply(clean, columns, width).unionByName(_apply(rest, columns, width))
    return _apply(docs.join(done, key, "left").join(dead, key, "left"), columns, width)


def remove_repeats(docs: DataFrame, width: int = WIDTH, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Remove every word of docs' texts that is covered by a window of `width` words whose word sequence also starts anywhere else, in the same text or another.

    Returns a row per row of docs: the columns given, text (the kept words joined by one space), n_words, n_removed, removed (positions of removed words: first, end, ...).
    Windows are judged on the input. A null or empty text has no words and gives an empty one; texts shorter than the window lose nothing; repeated rows repeat
    each other's windows. An empty table gives an empty result. Other columns of docs are not read, whatever their names. Windows are taken for equal if 128 bits of hash are."""
    kept = F.struct(*[F.col(quoted(c)) for c in columns]).alias("row")
    out = _judged(docs.select(kept, *row_key("doc_id", "text"), "text"), ["row"], width)
    return out.select("row.*", "text", "n_words", "n_removed", "removed")


def dedup_documents(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with repeated passages removed; texts that lose nothing stay as they are. n_chars follows the text. Columns as in docs, whatever their names; rows as in remove_repeats()."""
    out = _judged(boxed(docs, *row_key("doc_id", "text"), F.col("text")), ["row"], width)
    cut = F.col("n_removed") > 0
    row = F.col("row").withField("text", F.when(cut, F.col("text")).otherwise(F.col("row.text")))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")))
    return out.select(row.alias("row")).select("row.*")
