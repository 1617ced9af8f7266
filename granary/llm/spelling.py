"""Groups of spelling variants: words one edit apart, found through k-d trees over letter counts.

A word's vector counts its letters, and once more those of its first four. One letter replaced raises one count and lowers another, one inserted raises one (of the first four letters it may push
one out): so words one edit apart differ by at most two in L1, and a search need not enter a box farther away than that. A few trees, one a length, are made on the driver from a bounded sample
of vectors and cut the vocabulary into leaves. A word lies in one leaf and asks all leaves of its own and the next length that its edits can reach. A task sorts its leaves, makes
a tree of each and streams the questions through it; what boxes leave over is compared letter by letter. The sample decides only about how even leaves are, never about what is found.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_small, materialise, quoted, release

#: Code points and occurrences of a word, at least.
SHORTEST, LEAST = 6, 5
#: A form has so many times the occurrences of what it stands for.
RATIO = 5
#: Words that a task counts before it hands them on.
COUNTED = 200_000
#: Vectors from which the driver makes trees, about; words of a leaf that it aims at; of a leaf inside of a task.
SAMPLE, LEAF, SMALL = 100_000, 8192, 24
#: Bytes of a leaf's words; a larger one is dealt into parts, each of which is asked.
LEAF_BYTES = 16 << 20
#: Words (each with another one) that are broadcast at most: with what the driver makes of them, about 20 MB.
BROADCAST_WORDS = 50_000
#: Pairs of words compared at a time, in bytes.
BLOCK = 1 << 23

#: Counts: letters a to z, six for all others; once of the whole word and once of its first letters.
LETTERS, PREFIX = 32, 4
_BUCKET = np.array([c - 97 if 97 <= c <= 122 else 26 + c % 6 for c in range(256)], np.uint8)
_MOST = 127


def count_words(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shortest: int = SHORTEST, least: int = LEAST, damage: int | None = None) -> DataFrame:
    """Words of the texts (null: none): maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased, of at least `shortest` code points and `least` occurrences. Returns word, n (long).

    damage: with h the crc32 of `<id>:<word>`, a word loses its code point h % length wherever `damage` divides h (a null id: empty)."""
    found = re.compile(f"[a-zÀ-ÿ]{{{shortest},}}")
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def batch(counts: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                text = t.as_py() or ""
                # bytes.lower() knows A-Z only
                own = Counter(found.findall(text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
                if damage:
                    lead = zlib.crc32(f"{i.as_py() if i.is_valid else ''}:".encode())
                    for w in [w for w in own if zlib.crc32(w.encode(), lead) % damage == 0]:
                        k = zlib.crc32(w.encode(), lead) % len(w)
                        counts[w[:k] + w[k + 1 :]] += own.pop(w)
                counts.update(own)
                if len(counts) > COUNTED:
                    yield batch(counts)
                    counts.clear()
        yield batch(counts)

    parts = docs.select(F.col(quoted(id_column)).cast("string"), F.col(quoted(text_column))).mapInArrow(run, "word string, n long")
    return parts.filter(F.length("word") >= shortest).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def codes(words: list[str], length: int) -> np.ndarray:
    """A row of code points a word; all have the length given."""
    joined = "".join(words)
    try:
        return np.frombuffer(joined.encode("latin-1"), np.uint8).reshape(-1, length)
    except UnicodeEncodeError:
        return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, length)


def vectors(code: np.ndarray) -> np.ndarray:
    """Letter counts (up to 127: a larger difference of two words is never made smaller than one of a single letter) of words and of their first letters."""
    buckets = _BUCKET[code] if code.dtype == np.uint8 else np.where((code >= 97) & (code <= 122), code - 97, 26 + code % 6)
    n, rows = len(code), np.arange(len(code))[:, None] * LETTERS
    counts = lambda b: np.minimum(np.bincount((rows + b).ravel(), minlength=n * LETTERS).reshape(n, LETTERS), _MOST)
    return np.concatenate((counts(buckets), counts(buckets[:, :PREFIX])), axis=1).astype(np.int16)


class Tree:
    """A k-d tree over count vectors. A node is split where it is halved best; its box is what the splits above it leave."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        self.nodes: list[tuple[int, int, int, int, int, int]] = []  # dimension, threshold, bounds there so far, children; or -1 and the leaf's number
        self.leaves: list[np.ndarray] = []
        dims = points.shape[1]
        todo = [(np.arange(len(points)), np.zeros(dims, np.int16), np.full(dims, _MOST, np.int16), -1, 0)]
        while todo:
            own, low, high, parent, side = todo.pop()
            at = len(self.nodes)
            if parent >= 0:
                node = list(self.nodes[parent])
                node[4 + side] = at
                self.nodes[parent] = tuple(node)
            split = self._split(points[own]) if len(own) > leaf else None
            if split is None:
                self.nodes.append((-1, len(self.leaves), 0, 0, 0, 0))
                self.leaves.append(own)
                continue
            d, t = split
            self.nodes.append((d, t, int(low[d]), int(high[d]), 0, 0))
            left = points[own, d] <= t
            below, above = high.copy(), low.copy()
            below[d], above[d] = t, t + 1
            todo += [(own[left], low, below, at, 0), (own[~left], above, high, at, 1)]

    @staticmethod
    def _split(points: np.ndarray) -> tuple[int, int] | None:
        n, best = len(points), (0, 0, 0)
        for t in range(int(points.max())):
            under = np.count_nonzero(points <= t, axis=0)
            halves = np.minimum(under, n - under)
            d = int(halves.argmax())
            best = max(best, (int(halves[d]), d, t))
            if t > 3 and best[0]:
                break
        return best[1:] if best[0] else None

    def reach(self, points: np.ndarray, lower: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of points) for each leaf whose box holds a vector that comes from the point by raising one count by one and lowering `lower` counts (0 or 1) by one; of the first letters one of each at most."""
        zeros = np.zeros(len(points), np.int16)
        todo = [(0, np.arange(len(points)), (zeros, zeros), (zeros, zeros))]
        most = (lower, 1)
        while todo:
            at, own, up, down = todo.pop()
            d, t, low, high, left, right = self.nodes[at]
            if d < 0:
                yield t, own
                continue
            block = int(d >= LETTERS)
            q = points[own, d]
            fewer = down[block] + np.maximum(q - t, 0) - np.maximum(q - high, 0)
            keep = fewer <= most[block]
            if keep.any():
                new = (fewer, down[1]) if block == 0 else (down[0], fewer)
                todo.append((left, own[keep], (up[0][keep], up[1][keep]), (new[0][keep], new[1][keep])))
            more = up[block] + np.maximum(t + 1 - q, 0) - np.maximum(low - q, 0)
            keep = more <= 1
            if keep.any():
                new = (more, up[1]) if block == 0 else (up[0], more)
                todo.append((right, own[keep], (new[0][keep], new[1][keep]), (down[0][keep], down[1][keep])))

    def home(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        out = np.zeros(len(points), np.int32)
        todo = [(0, np.arange(len(points)))]
        while todo:
            at, own = todo.pop()
            d, t, *_, left, right = self.nodes[at]
            if d < 0:
                out[own] = t
                continue
            under = points[own, d] <= t
            todo += [(left, own[under]), (right, own[~under])]
        return out


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Matrix of whether each of the first words becomes each of the others by one letter replaced (equal lengths) or inserted (the others are longer by one)."""
    n = short.shape[1]
    if long.shape[1] == n:
        return (short[:, None, :] != long[None, :, :]).sum(axis=2, dtype=np.int32) == 1
    head = np.logical_and.accumulate(short[:, None, :] == long[None, :, :-1], axis=2).sum(axis=2, dtype=np.int32)
    tail = np.logical_and.accumulate(short[:, None, ::-1] == long[None, :, :0:-1], axis=2).sum(axis=2, dtype=np.int32)
    return head + tail >= n


def neighbours(tree: Tree, index: np.ndarray, asking: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of asking, row of index) of words one edit apart; asking has the same length or one letter less."""
    same = asking.shape[1] == index.shape[1]
    left, right = [], []
    for leaf, rows in tree.reach(vectors(asking), int(same)):
        own = tree.leaves[leaf]
        wide = max(1, BLOCK // (index.shape[1] * 4 * max(1, min(len(rows), 256))))
        for a in range(0, len(rows), 256):
            for b in range(0, len(own), wide):
                i, j = np.nonzero(one_edit(asking[rows[a : a + 256]], index[own[b : b + wide]]))
                left.append(rows[a + i])
                right.append(own[b + j])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _best(own: np.ndarray, near: np.ndarray, n: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (own, near): each own, its number of pairs, and its near of largest n, the smallest word among equals."""
    order = np.lexsort((words[near], -n[near], own))
    first = np.flatnonzero(np.concatenate(([True], own[order][1:] != own[order][:-1]))) if len(order) else order
    return own[order][first], np.diff(np.concatenate((first, [len(order)]))), near[order][first]


_FOUND = "word string, n_near long, near string, near_n long"


def _asked(routed: DataFrame) -> DataFrame:
    """routed: length, leaf, part, kind (0: lies here, 1: asks here, 2: asks here for words longer by one), word, n; sorted so inside of partitions. Rows of _FOUND, several a word."""
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words, counts, made = None, [], [], None

        def answers(kind: int, length: int, asking: list[str], n: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal made
            if made is None:
                code = codes(words, length)
                made = Tree(vectors(code), SMALL), code, np.array(words), np.array(counts, np.int64)
            tree, index, names, numbers = made
            left, right = neighbours(tree, index, codes(asking, length - (kind == 2)))
            own = np.array(asking)
            sides = [(own, left, right, names, numbers)] + ([(names, right, left, own, n)] if kind == 2 else [])
            for mine, a, b, theirs, sizes in sides:
                w, k, best = _best(a, b, sizes, theirs)
                if len(w):
                    yield pa.RecordBatch.from_arrays([pa.array(mine[w].tolist(), pa.string()), pa.array(k, pa.int64()), pa.array(theirs[best].tolist(), pa.string()), pa.array(sizes[best], pa.int64())], schema=schema)

        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                *here, kind = keys[a].tolist()
                if here != key:
                    key, words, counts, made = here, [], [], None
                own, n = b.column(4).slice(a, z - a).to_pylist(), b.column(5).slice(a, z - a).to_numpy()
                if kind == 0:
                    words += own
                    counts += n.tolist()
                elif words:
                    yield from answers(kind, here[0], own, n)

    return routed.mapInArrow(run, _FOUND)


def _grouped(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    """Rows and words of a batch (`word` first) by length."""
    words = b.column(0).to_pylist()
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        yield length, rows, [words[i] for i in rows]


def _sample(words: DataFrame, total: int) -> dict[int, list[bytes]]:
    """Vectors by length of about SAMPLE words, chosen by hash."""
    chosen = words if total <= SAMPLE else words.filter(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < (1 << 30) * SAMPLE // total).limit(2 * SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for length, rows, own in _grouped(b):
                data = vectors(codes(own, length)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([length] * len(rows), pa.int32()), pa.array([v.tobytes() for v in data], pa.binary())], ["length", "vector"])

    out: dict[int, list[bytes]] = {}
    for r in chosen.select("word").mapInArrow(run, "length int, vector binary").collect():
        out.setdefault(r["length"], []).append(bytes(r["vector"]))
    return out


def _routed(words: DataFrame, trees, parts, ask: bool) -> DataFrame:
    """Each word in its leaf, and (ask) in all leaves that it asks."""
    names = ["length", "leaf", "part", "kind", "word", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, many = trees.value, parts.value if parts else {}

        def rows(length: int, leaf: np.ndarray | int, part, kind: int, word: pa.Array, n: pa.Array) -> pa.RecordBatch:
            size = len(word)
            whole = lambda x: pa.array(np.broadcast_to(np.asarray(x, np.int32), size), pa.int32())
            return pa.RecordBatch.from_arrays([whole(length), whole(leaf), whole(part), whole(kind), word, n], names)

        for b in batches:
            for length, at, own in _grouped(b):
                points = vectors(codes(own, length))
                word, n = b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))
                leaf = known[length].home(points) if length in known else np.zeros(len(own), np.int32)
                dealt = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % many.get((length, k), 1) for w, k in zip(own, leaf.tolist(), strict=True)], np.int32) if many else 0
                yield rows(length, leaf, dealt, 0, word, n)
                if not ask:
                    continue
                for kind, other in ((1, length), (2, length + 1)):
                    found = known[other].reach(points, int(kind == 1)) if other in known else [(0, np.arange(len(own)))]
                    for k, who in found:
                        some = pa.array(who)
                        for part in range(many.get((other, k), 1)):
                            yield rows(other, k, part, kind, word.take(some), n.take(some))

    return words.select("word", "n").mapInArrow(run, "length int, leaf int, part int, kind int, word string, n long")


def near_words(words: DataFrame) -> DataFrame:
    """words: word, n, a table in the shared folder with each word once. Rows of _FOUND: each word that has near words, with their number and the one of largest n (the smallest in code-point order among equals)."""
    spark = words.sparkSession
    total = words.count()
    sample = _sample(words, total)
    leaf = max(8, LEAF * SAMPLE // max(total, SAMPLE))
    trees = {}
    for length, data in sample.items():
        if len(data) > leaf:
            trees[length] = Tree(np.frombuffer(b"".join(data), np.uint8).reshape(-1, 2 * LETTERS).astype(np.int16), leaf)
            trees[length].leaves = []
    shared = spark.sparkContext.broadcast(trees)
    # leaves are at most an eighth of the sample, and of those only the large ones are listed
    sizes = _routed(words, shared, None, False).groupBy("length", "leaf").agg(F.count(F.lit(1)).alias("n")).withColumn("bytes", F.col("n") * (F.col("length") + 128)).filter(F.col("bytes") > LEAF_BYTES)
    parts = {(r["length"], r["leaf"]): -(-r["bytes"] // LEAF_BYTES) for r in sizes.collect()}
    routed = _routed(words, shared, spark.sparkContext.broadcast(parts), True)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), total // (4 * LEAF))
    found = _asked(routed.repartition(tasks, "length", "leaf", "part").sortWithinPartitions("length", "leaf", "part", "kind"))
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.word").alias("near"), (-F.col("best.n")).alias("near_n"))


def group_spellings(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """words: word, n (long), each word once. Two words are near if one code point is inserted, deleted or replaced between them. A word's form is its near word of largest n (the smallest in code-point order among equals),
    if that n is at least `ratio` (over 1) times the word's own.

    Returns word, form, root (the last of the forms from word on, word itself if it has none), n, n_near, form_n. Null words take no part; an empty table gives an empty result; words of one code point have no near
    words of none. Forms rise in n by `ratio` a step, so roots are found in a few doublings of the way."""
    if ratio <= 1:
        raise ValueError("ratio has to be over 1")
    words = materialise(words.select("word", F.col("n").cast("long").alias("n")).filter(F.col("word").isNotNull() & (F.col("word") != "")), "words")
    found = near_words(words)
    both = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    both = both.unionByName(found.withColumn("n", F.lit(None).cast("long")))
    one = both.groupBy("word").agg(*[F.max(c).alias(c) for c in ("n", "n_near", "near", "near_n")])
    has = F.col("near_n") >= ratio * F.col("n")
    forms = materialise(one.select("word", "n", "n_near", F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n")), "forms")
    release(words)
    chain = materialise(forms.filter("form is not null").select("word", F.col("form").alias("root")), "chain")
    ends = forms.agg(F.max("n"), F.min("n")).first()
    steps, reached = 0, ends[1]
    while reached is not None and reached * ratio <= ends[0]:
        steps, reached = steps + 1, max(1, reached) * ratio
    way = 1
    while way < steps:
        after = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = materialise(join_small(chain, after, "root", salts=4, rows=BROADCAST_WORDS).select("word", F.coalesce("next", "root").alias("root")), "chain")
        release(chain)
        chain, way = longer, 2 * way
    out = join_small(forms, chain, "word", salts=1, rows=BROADCAST_WORDS)
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
