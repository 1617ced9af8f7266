"""Leakage between and within splits, as an edge list of findings.

Rows: id, split, ord (place in reading order), text, family, entities. A finding pairs the first-seen row of a class with each later one (a star, not all
pairs): kind, left_id, right_id, left_split, right_split, similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SHINGLE, normalize_text
from ..sources.scratch import stored

KINDS = ("id_collision", "exact_duplicate", "normalized_duplicate", "near_duplicate", "scenario_repeat", "entity_leak")
#: Kinds that make a split unusable when they cross splits.
FATAL = ("id_collision", "exact_duplicate", "normalized_duplicate", "near_duplicate")
THRESHOLD = 0.85
#: Parts of a class of equal keys while its first row is looked for.
SALTS = 16
#: Min-hash rows of 16 bands of 4.
BANDS, ROWS = 16, 4
#: Signatures that a task remembers; grams, and texts, of a block whose texts are compared together.
SIGNED, CELL, MEMBERS = 20_000, 1 << 20, 256


def star(rows: DataFrame, key: Column, kind: str, similarity: float = 1.0) -> DataFrame:
    """The first row of each class of equal keys (not null) with every later one. The first is found by an aggregation, so a large class is not sorted in one task.

    Keys are computed once: rows of id, split, ord and key are dealt out by key and salt, and that exchange serves both the firsts and the rows that they are joined to. For that no filter may be pushed below it:
    a null key is a name with a mark, and what is asked of a pair is not a plain comparison."""
    salt = F.pmod(F.xxhash64("id", "ord"), F.lit(SALTS))
    work = rows.select("id", "split", "ord", F.coalesce(key.cast("string"), F.lit("\x00null")).alias("_key"), key.isNull().alias("_null")).withColumn("_salt", salt).repartition("_key", "_salt")
    first = work.groupBy("_key", "_salt").agg(F.min(F.struct("ord", "id", "split", "_null")).alias("_f"), F.count_if(~F.col("_null")).alias("_n"))
    first = first.groupBy("_key").agg(F.min("_f").alias("_f"), F.sum("_n").alias("_n")).filter("_n > 1")
    later = F.coalesce((F.col("ord") > F.col("_f.ord")) & ~F.col("_null") & ~F.col("_f._null"), F.lit(False))
    return work.join(first, "_key").filter(later).select(
        F.lit(kind).alias("kind"), F.col("_f.id").alias("left_id"), F.col("id").alias("right_id"), F.col("_f.split").alias("left_split"), F.col("split").alias("right_split"), F.lit(similarity).alias("similarity")
    )


def pair_key(left: str = "left_id", right: str = "right_id") -> Column:
    return F.array_sort(F.array(F.col(left), F.col(right)))


def id_collisions(rows: DataFrame) -> DataFrame:
    return star(rows, F.col("id"), "id_collision")


def exact_duplicates(rows: DataFrame) -> DataFrame:
    return star(rows, F.sha2("text", 256), "exact_duplicate")


def normalized_duplicates(rows: DataFrame) -> DataFrame:
    """Stars of equal normalised texts, without pairs of ids that are exact duplicates already."""
    found = star(rows, F.sha2(normalize_text(F.col("text")), 256), "normalized_duplicate").withColumn("_p", pair_key())
    return found.join(exact_duplicates(rows).select(pair_key().alias("_p")).distinct(), "_p", "left_anti").drop("_p")


def _grams(text: str, size: int) -> np.ndarray:
    """Distinct 64-bit hashes of the character n-grams of a normalised text."""
    if not text:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(codes) <= size:
        codes = np.pad(codes, (0, size - len(codes)), constant_values=0xFFFFFFFF)
    h = np.zeros(len(codes) - size + 1, np.uint64)
    for j in range(size):
        h = (h ^ codes[j : j + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


_A, _B = np.random.default_rng(42).integers(1, 2**63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _bands(grams: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for a in range(0, len(grams), 4096):
        x = grams[a : a + 4096, None] * _A + _B
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        least = np.minimum(least, x.min(axis=0))
    out = np.zeros(BANDS, np.uint64)
    for r in range(ROWS):
        out = (out ^ least.reshape(BANDS, ROWS)[:, r]) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return out


#: Bits of a sketch, one a min-hash; two sets agree in a bit with a chance of (1 + similarity) / 2.
SKETCH, BITS = 256, ("s0", "s1", "s2", "s3")
_SA, _SB = np.random.default_rng(7).integers(1, 2**63, (2, SKETCH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sketch(grams: np.ndarray) -> np.ndarray:
    """Four longs."""
    least = np.full(SKETCH, np.uint64(2**64 - 1))
    for a in range(0, len(grams), 512):
        x = grams[a : a + 512, None] * _SA + _SB
        np.minimum(least, x.min(axis=0), out=least)
    x = (least ^ (least >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.packbits((x >> np.uint64(63)).astype(np.uint8)).view(np.int64)


def agreeing(threshold: float) -> int:
    """Bits in which sketches of sets at the threshold agree but for five standard deviations."""
    p = (1 + threshold) / 2
    return int(SKETCH * p - 5 * (SKETCH * p * (1 - p)) ** 0.5)


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """Pairs of different texts whose sets of character n-grams of the normalised text have a Jaccard similarity of `threshold` or more.

    Rows of equal normalised text are one class, which its first row stands for; the others are its members by normalized_duplicates() and exact_duplicates(), so copies are not expanded into
    pairs, and where rows of two splits are alike one of the three says so. Candidates share one of 16 min-hash bands (recall at 0.85 is above 0.9999) and nearly as many of 256 bits of a sketch as alike sets do; sets whose sizes differ
    by more than the threshold allows are no candidates. No bucket is left out, however large.

    Texts are normalised and signed once and stored; buckets hold numbers only, a row a band. Candidates are compared in cells, each of two blocks of texts: a text goes to its cells and not to its pairs."""
    texts = rows.filter(F.col("text").isNotNull()).select("id", "split", "ord", normalize_text(F.col("text")).alias("norm"))
    texts = texts.withColumn("cls", F.coalesce(F.sha2("norm", 256), F.lit("")))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}  # copies are signed once where they lie near each other
        for batch in batches:
            found = []
            for cls, t in zip(batch.column(4).to_pylist(), batch.column(3), strict=True):
                if cls not in known:
                    if len(known) >= SIGNED:
                        known.clear()
                    g = _grams(t.as_py(), size)
                    known[cls] = (len(g), _bands(g).view(np.int64), _sketch(g))
                found.append(known[cls])
            own = [pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.list_(pa.int64())), *[pa.array([x[2][i] for x in found], pa.int64()) for i in range(4)]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], [*batch.schema.names, "n", "bands", *BITS])

    shape = T.StructType([*texts.schema.fields, T.StructField("n", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType())), *[T.StructField(b, T.LongType()) for b in BITS]])
    signed = stored(texts.mapInArrow(sign, shape).withColumn("rid", F.monotonically_increasing_id()), "signed", "zstd")  # has the texts
    firsts = signed.groupBy("cls").agg(F.min(F.struct("ord", "id", "split", "rid")).alias("f")).select("f.*")
    classes = stored(firsts.join(signed.select("rid", "n", "bands", *BITS), "rid"), "classes")

    buckets = classes.select("rid", "n", *BITS, F.posexplode("bands").alias("band", "h")).select(F.xxhash64("band", "h").alias("key"), "rid", "n", *BITS).repartition("key")  # for both sides of the join
    others = buckets.select("key", F.col("rid").alias("b"), F.col("n").alias("nb"), *[F.col(b).alias(f"x{b}") for b in BITS])
    sized = F.least("n", "nb") >= F.lit(threshold) * F.greatest("n", "nb")
    differ = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"x{b}"))) for b in BITS), F.lit(0))
    candidates = buckets.join(others, "key").filter((F.col("rid") < F.col("b")) & sized & (differ <= SKETCH - agreeing(threshold))).select(F.col("rid").alias("a"), "b").distinct()
    cells = _cells(candidates, classes.select("rid", "n"))
    members = cells.select("cell", F.explode(F.array("a", "b")).alias("rid")).distinct()
    held = members.join(signed.select("rid", "norm"), "rid").select("cell", F.col("rid").alias("a"), F.lit(None).cast("long").alias("b"), "norm")
    work = held.union(cells.select("cell", "a", "b", F.lit(None).cast("string"))).repartition("cell").sortWithinPartitions("cell", F.col("b").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, grams = None, {}
        for batch in batches:
            out = []
            for at, a, b, norm in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if at != cell:
                    cell, grams = at, {}
                if b is None:
                    grams[a] = _grams(norm, size)
                    continue
                g, h = grams[a], grams[b]
                common = len(np.intersect1d(g, h, assume_unique=True))
                alike = common / (len(g) + len(h) - common) if len(g) + len(h) else 1.0
                if alike >= threshold:
                    out.append((a, b, alike))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "similarity"])

    alike = work.mapInArrow(compare, "a long, b long, similarity double")
    named = lambda end, x: classes.select(F.col("rid").alias(end), F.struct("ord", "id", "split").alias(x))
    both = alike.join(named("a", "x"), "a").join(named("b", "y"), "b")
    out = both.select(F.least("x", "y").alias("l"), F.greatest("x", "y").alias("r"), "similarity")
    return out.select(F.lit("near_duplicate").alias("kind"), F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id"), F.col("l.split").alias("left_split"), F.col("r.split").alias("right_split"), "similarity")


def _cells(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """cell, a, b: pairs dealt out so that a cell has the pairs between two blocks of about CELL grams and MEMBERS texts each at most, or within one. A block is of texts whose least neighbour is the same, as it is for near copies of one text; a group of
    m blocks sends a text to m cells at most, where it has m times as many pairs."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("rid"), F.col("b").alias("other")), F.struct(F.col("b").alias("rid"), F.col("a").alias("other")))).alias("e")).select("e.*")
    roots = ends.groupBy("rid").agg(F.min("other").alias("other")).select("rid", F.least("rid", "other").alias("root")).join(sizes, "rid")
    parts = roots.groupBy("root").agg(F.greatest(F.ceil(F.sum("n") / F.lit(CELL)), F.ceil(F.count(F.lit(1)) / F.lit(MEMBERS))).alias("parts"))
    placed = roots.join(parts, "root").select("rid", F.xxhash64("root", F.pmod(F.xxhash64("rid"), "parts")).alias("block"))
    side = lambda end: placed.select(F.col("rid").alias(end), F.col("block").alias(f"block_{end}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    return met.select(F.xxhash64(F.least("block_a", "block_b"), F.greatest("block_a", "block_b")).alias("cell"), "a", "b")


def scenario_repeats(rows: DataFrame) -> DataFrame:
    """A family in several splits: the first row of its alphabetically first split with the first row of each other split."""
    firsts = rows.filter(F.coalesce(F.col("family"), F.lit("")) != "").groupBy("family", "split").agg(F.min(F.struct("ord", "id")).alias("f"))
    head = Window.partitionBy("family").orderBy("split")
    work = firsts.withColumn("h", F.first(F.struct("split", F.col("f.id").alias("id"))).over(head)).filter(F.col("split") != F.col("h.split"))
    return work.select(F.lit("scenario_repeat").alias("kind"), F.col("h.id").alias("left_id"), F.col("f.id").alias("right_id"), F.col("h.split").alias("left_split"), F.col("split").alias("right_split"), F.lit(0.0).alias("similarity"))


def entity_leaks(rows: DataFrame) -> DataFrame:
    """Every row outside train whose entity group (other than `unseen`) is in train, with the first such train row."""
    named = rows.filter((F.coalesce(F.col("entities"), F.lit("")) != "") & (F.col("entities") != "unseen"))
    train = named.filter("split = 'train'").groupBy("entities").agg(F.min(F.struct("ord", "id")).alias("f"))
    return named.filter("split <> 'train'").join(train, "entities").select(F.lit("entity_leak").alias("kind"), F.col("f.id").alias("left_id"), F.col("id").alias("right_id"), F.lit("train").alias("left_split"), F.col("split").alias("right_split"), F.lit(0.0).alias("similarity"))


def check_leakage(rows: DataFrame, threshold: float = THRESHOLD, near: bool = True, within_split: bool = True) -> DataFrame:
    """Findings of all detectors."""
    out = id_collisions(rows).union(exact_duplicates(rows)).union(normalized_duplicates(rows))
    out = (out.union(near_duplicates(rows, threshold)) if near else out).union(scenario_repeats(rows)).union(entity_leaks(rows))
    return out if within_split else cross_split(out)


def cross_split(findings: DataFrame) -> DataFrame:
    return findings.filter("left_split <> right_split")


def fatal(findings: DataFrame) -> DataFrame:
    return cross_split(findings).filter(F.col("kind").isin(*FATAL))


def kind_counts(findings: DataFrame) -> DataFrame:
    """A row for every kind, also those without findings: n, n_cross_split."""
    kinds = findings.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
    counted = findings.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("left_split") != F.col("right_split")).alias("n_cross_split"))
    return F.broadcast(kinds).join(counted, "kind", "left").fillna(0)


def enforce(findings: DataFrame, fail_on: str = "fatal") -> int:
    """Number of findings across splits that count under the policy (none, fatal, any); raises if there is one."""
    if fail_on not in ("none", "fatal", "any"):
        raise ValueError(f"no such policy: {fail_on}")
    n = 0 if fail_on == "none" else (fatal(findings) if fail_on == "fatal" else cross_split(findings)).count()
    if n:
        raise ValueError(f"{n} findings across splits")
    return n


def report_order(findings: DataFrame, most: int = 200) -> DataFrame:
    """The findings that a report lists: across splits first, then by similarity."""
    return findings.orderBy(F.desc(F.col("left_split") != F.col("right_split")), F.desc("similarity"), "kind", "left_id", "right_id").limit(most)
