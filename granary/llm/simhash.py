"""SimHash near-duplicates, found through deletion variants.

Fingerprints that differ in at most two bits are cut into two halves: one of the halves then differs in at most one bit. Each half is indexed as it is and,
for every bit, with that bit wild; equal variants meet in an equality join and are verified on the whole fingerprint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, KEY, boxed, join_small, materialise, quoted, release, row_key, settled
from .components import components

#: Words of a shingle and seed of its hash.
SHINGLE, SEED = 3, 42
#: A half of which more distinct fingerprints than this share a variant is indexed by a quarter of the other half as well.
HOT = 64
#: Distinct fingerprints a task, so that their variants (66 each) are made by as many tasks as they need.
BATCH = 20_000


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of the lower-cased (A-Z) text's word shingles, repeats included; fewer words make one shingle, none gives zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return int(np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64).view(np.int64)[0])
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    spans = zip(starts[: 1 - SHINGLE].tolist(), (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.flatnonzero(2 * ones > len(hashes))
    return int(np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64), initial=np.uint64(0)).view(np.int64)) if len(bits) else 0


def with_fingerprint(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns given and fp (long), for every row; texts stay in the scan."""
    kept = docs.select(*columns, "text")
    schema = docs.select(*columns).withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py()) for t in batch.column(len(columns))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], fps], [*columns, "fp"])

    return kept.mapInArrow(run, schema)


def _shift(op: str, x: Column, by: Column) -> Column:
    return F.call_function(op, x, by.cast("int"))


def _wild(last: int, code: Callable[[Column, Column], Column], x: Column) -> Column:
    """code(j, x with bit j cleared) for j from 0 to last."""
    one = F.lit(1).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(last)), lambda j: code(j, x.bitwiseAND(F.bitwise_not(_shift("shiftleft", one, j)))))


def near_links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """fps: distinct longs `fp`. Returns a, b: all pairs of fingerprints that differ in one or two bits, some of them more than once.

    A key holds which half it is of, its wild bit (or 32 for none) and the half with that bit cleared. Under an exact half the other half may differ in two
    bits, under a half with a wild bit (which one side has set and the other not) in one. A key that more than `hot` fingerprints share is made finer by a
    variant of a quarter of the other half, by the same argument; where more than `hot` share that as well, all but the last quarter is settled, and each fingerprint asks for those that are one or two bits
    away in it. So nothing is lost and no large group meets whole.
    """
    halves = [_half(F.col("fp"), F.lit(h)) for h in (0, 1)]
    code = lambda h, j, x: _shift("shiftleft", F.lit(h * 33).cast("long") + j, F.lit(32)).bitwiseOR(x)
    exact = [code(h, F.lit(32), x) for h, x in enumerate(halves)]
    wild = [_wild(31, partial(code, h), x) for h, x in enumerate(halves)]
    spark = fps.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), fps.count() // BATCH)
    keyed = fps.select("fp").repartition(tasks, "fp").select("fp", F.explode(F.concat(F.array(*exact), *wild)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(_side(F.col("key"), F.col("fp"))).alias("n1"))
    meets = sizes.filter(F.when(_is_exact(F.col("key")), F.col("n") > 1).otherwise((F.col("n1") > 0) & (F.col("n1") < F.col("n"))))
    meets = materialise(meets.select("key", (F.col("n") > hot).alias("hot")), "meets")
    # most variants are of one fingerprint alone: a short list of the others spares all of them a second shuffle
    few = meets.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    live = materialise(keyed.join(F.broadcast(meets) if few else meets, "key"), "variants")
    links = _meet(live.filter("not hot"), ["key"])
    if not live.filter("hot").limit(1).count():
        return links
    finer = _finer(live.filter("hot"))
    sizes = finer.groupBy("key", "key2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    finer = materialise(finer.join(sizes.select("key", "key2", (F.col("n") > hot).alias("crowded")), ["key", "key2"]), "finer")
    links = links.union(_meet(finer.filter("not crowded"), ["key", "key2"]))
    return links.union(_ask(finer.filter("crowded"))) if finer.filter("crowded").limit(1).count() else links


def _ask(rows: DataFrame) -> DataFrame:
    """Rows of key and key2: pairs found by equality with what each fingerprint asks for. Outside of the quarter that key2 leaves open they differ at most in the wild bits of the keys."""
    other = 1 - F.floor(F.shiftright("key", 32) / 33)
    last = 1 - F.floor(F.shiftright("key2", 16) / 17)
    at = F.when(other == 0, F.lit(32)).otherwise(F.lit(0)) + F.when(last == 0, F.lit(16)).otherwise(F.lit(0))
    quarter = _shift("shiftrightunsigned", F.col("fp"), at).bitwiseAND(0xFFFF)
    masks = F.array(*[F.lit((1 << i) | (1 << j)) for i in range(16) for j in range(i, 16)], F.lit(0))
    rows = rows.select("key", "key2", "fp", quarter.alias("q"))
    asked = rows.select("key", "key2", F.col("fp").alias("a"), F.explode(F.transform(masks, lambda m: F.col("q").bitwiseXOR(m))).alias("q"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    return asked.join(rows.withColumnRenamed("fp", "b"), ["key", "key2", "q"]).filter((F.col("a") < F.col("b")) & near).select("a", "b")


def _half(fp: Column, which: Column) -> Column:
    return F.when(which == 0, F.shiftrightunsigned(fp, 32)).otherwise(fp.bitwiseAND(0xFFFFFFFF))


def _bit_of(key: Column) -> Column:
    return (F.shiftright(key, 32) % 33).cast("int")


def _is_exact(key: Column) -> Column:
    return _bit_of(key) == 32


def _side(key: Column, fp: Column) -> Column:
    """The wild bit's value in the half that the key is of; 0 under an exact half."""
    half = _half(fp, F.floor(F.shiftright(key, 32) / 33))
    return F.when(_is_exact(key), F.lit(0)).otherwise(_shift("shiftright", half, _bit_of(key)).bitwiseAND(1).cast("int"))


def _finer(rows: DataFrame) -> DataFrame:
    """Add key2: under an exact half, quarters of the other with none or one wild bit (two differences leave at most one in a quarter); under a wild half,
    the quarters as they are (one difference leaves one of them equal)."""
    other = _half(F.col("fp"), 1 - F.floor(F.shiftright("key", 32) / 33))
    quarters = [F.shiftright(other, 16), other.bitwiseAND(0xFFFF)]
    code = lambda q, j, x: _shift("shiftleft", F.lit(q * 17).cast("long") + j, F.lit(16)).bitwiseOR(x)
    plain = F.array(*[code(q, F.lit(16), x) for q, x in enumerate(quarters)])
    wild = [_wild(15, partial(code, q), x) for q, x in enumerate(quarters)]
    return rows.withColumn("key2", F.explode(F.when(_is_exact(F.col("key")), F.concat(plain, *wild)).otherwise(plain)))


def _meet(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of fingerprints under one key, verified: the two sides of a wild bit, or in order under an exact half."""
    left = rows.select(*keys, F.col("fp").alias("a"), _side(F.col("key"), F.col("fp")).alias("sa"))
    right = rows.select(*keys, F.col("fp").alias("b"), _side(F.col("key"), F.col("fp")).alias("sb"))
    apart = F.when(_is_exact(F.col("key")), F.col("a") < F.col("b")).otherwise(F.col("sa") < F.col("sb"))
    return left.join(right, keys).filter(apart & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")


def _named(prints: DataFrame) -> DataFrame:
    """prints: doc_id, fp. A row a fingerprint: fp, root, component_id."""
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(near_links(distinct.select("fp")), "a", "b")
    rooted = materialise(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "rooted")
    least = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Group documents whose fingerprints are linked, directly or through others, at two or fewer differing bits.

    Returns a row per row of docs: the columns given, fp (long), root (a fingerprint that names the group), component_id
    (smallest doc_id in the group; null ids count only if there is no other). Null and empty texts have fingerprint zero and link like any other; repeated rows are rows of their own.
    An empty table gives an empty result. Other columns of docs are not read, whatever their names.
    """
    kept = F.struct(*[F.col(quoted(c)) for c in columns]).alias("row")
    prints = materialise(with_fingerprint(docs.select("doc_id", kept, "text"), ("doc_id", "row")), "prints")
    named = settled("named", lambda: _named(prints))
    return prints.join(named, "fp").select("row.*", "fp", "root", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs without its near-duplicates: of each group the row with the smallest doc_id stays (of rows that share it, one). Columns as in docs, whatever their names; null and
    empty texts, which are one group, nulls in other columns and empty tables as in near_duplicates().

    Only ids are gathered and joined back: rows to drop are found by their key, and stay in their scan where the list is small enough to broadcast. Of rows that are equal in id and text one stays; only those are shuffled."""
    prints = materialise(with_fingerprint(docs.select("doc_id", *row_key("doc_id", "text"), "text"), ("doc_id", *KEY)), "prints")
    named = settled("named", lambda: _named(prints))
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), *KEY)
    grouped = materialise(prints.join(named, "fp").select("doc_id", *KEY, "root"), "grouped")
    firsts = materialise(grouped.groupBy("root").agg(F.min(rank).alias("first")), "firsts")
    rest = F.struct(*KEY) != F.struct("first.k1", "first.k2")
    dropped = materialise(grouped.join(firsts, "root").filter(rest).select(*KEY).distinct(), "dropped")
    twins = materialise(grouped.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*KEY).join(dropped, KEY, "left_anti"), "twins")
    release(prints, named, grouped, firsts)
    single = join_small(boxed(docs, *row_key("doc_id", "text")), dropped, KEY, "left_anti")
    if twins.limit(1).count():
        single = join_small(single, twins, KEY, "left_anti").unionByName(join_small(single, twins, KEY, "left_semi").dropDuplicates(KEY))
    return single.select("row.*")
