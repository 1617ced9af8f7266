"""Mixing sources to target weights, in DataFrame operations only.

Documents get hash-random keys. Within a source the keys are uniform, so cutting their range into sqrt(n) even buckets range-sorts the source without a
sample; running sums over the buckets tell in which of them the source's budget ends, and running sums within that one at which document. That place in the order decides about every
other document of the source by itself: what lies before it is taken once more than what lies after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACE, WORD, boxed, join_small, materialise, quoted, release, settled, with_global_index

#: Bits of a key.
KEY_BITS = 60


def _key(seed: int) -> Column:
    """A document's random key: the first 60 bits of the MD5 of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, share: float = 1.0) -> DataFrame:
    """sizes: source, source_size, n_docs (one row a source). Adds sid (rank by code point, null last), weight, target.

    Sources share `share` of all words by weight. A target stops at `cap` times its source's size; what is over is shared again among the others by weight.
    The fixed point gives every source min(cap * size, level * weight), with sources at their cap in the order of cap over weight: up to BROADCAST_ROWS sources the level
    is found by one running sum in that order, beyond by aggregations that each set more sources to their cap. Sources of no words have target 0.
    """
    ranked = with_global_index(sizes, [F.col("source").asc_nulls_last()], "sid")
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("sid") % len(weights) + 1).cast("int")).cast("long")
    ranked = materialise(ranked.withColumn("weight", w).withColumn("_cap", F.col("source_size") * cap), "sources")
    n, total = ranked.agg(F.count(F.lit(1)), F.sum("source_size")).first()
    total = (total or 0) if share == 1.0 else int((total or 0) * share)
    free, rest = (_level_by_sum if n <= BROADCAST_ROWS else _level_by_rounds)(ranked, total)
    level = free / rest if rest else float("inf")
    over = F.col("_cap") / F.col("weight") <= F.lit(level)
    open_target = F.col("weight") * F.lit(free).cast("long") / F.lit(max(rest, 1)).cast("long")
    return ranked.withColumn("target", F.when(over, F.col("_cap").cast("double")).otherwise(open_target.cast("double"))).drop("_cap")


def _level_by_sum(ranked: DataFrame, total: int) -> tuple[int, int]:
    """Words that sources below their cap share, and the sum of their weights (0 if all are at their cap)."""
    ratio = F.col("_cap") / F.col("weight")
    before = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.desc("ratio"), F.desc("sid")).rowsBetween(Window.unboundedPreceding, 0)
    sums = ranked.withColumn("ratio", ratio).select("ratio", "sid", F.coalesce(F.sum("_cap").over(before), F.lit(0)).alias("held"), F.sum("weight").over(after).alias("rest"))
    first = sums.filter(F.col("ratio") > (F.lit(total) - F.col("held")) / F.col("rest")).orderBy("ratio", "sid").first()
    return (total - first["held"], first["rest"]) if first else (0, 0)


def _level_by_rounds(ranked: DataFrame, total: int) -> tuple[int, int]:
    over = lambda level: F.col("_cap") / F.col("weight") <= F.lit(level)
    level, capped, free, rest = -1.0, -1, total, 0
    while True:
        n, held, open_w = ranked.agg(F.count_if(over(level)), F.coalesce(F.sum(F.when(over(level), F.col("_cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~over(level), F.col("weight"))), F.lit(0))).first()
        if n == capped:
            return free, rest
        capped, free, rest = n, total - held, open_w
        if not rest:
            return 0, 0
        level = free / rest


#: What orders the documents of a source.
ORDER = ["_key", "_id", "_size"]


def _cuts(narrow: DataFrame, weights: Sequence[int], cap: int, share: float) -> DataFrame:
    """narrow: _source, _key, _id, _size. A row a source: _name (of the source), source_size, target, copies (of every document), and where the rest of the budget ends: cut (the ORDER of a
    document, null if there is no rest), cut_n (documents that share it), cut_whole (those of them that are taken whole) and cut_words (taken of one further).

    Rows are summed by bucket first; documents are ordered only in the bucket of each source where its budget ends, and there as counts of equal ones."""
    sizes = narrow.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("_n"))
    budget = F.floor(F.col("target") + 0.5).cast("long")
    sources = source_targets(sizes, weights, cap, share)
    sources = sources.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    sources = sources.withColumn("_rest", budget - F.col("copies") * F.col("source_size")).withColumn("_buckets", F.ceil(F.sqrt("_n")))
    sources = materialise(sources.select(_name(F.col("source")).alias("_name"), "source_size", "target", "copies", "_rest", "_buckets"), "targets")
    placed = join_small(narrow.withColumn("_name", _name(F.col("_source"))), sources.select("_name", "_rest", "_buckets"), "_name", "inner")
    placed = placed.withColumn("_bucket", F.least(F.floor(F.col("_key") / float(1 << KEY_BITS) * F.col("_buckets")), F.col("_buckets") - 1)).drop("_buckets")
    ahead = Window.partitionBy("_name").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_name", "_bucket", "_rest").agg(F.sum("_size").alias("_sum")).withColumn("_start", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)))
    ends = materialise(sums.filter((F.col("_start") < F.col("_rest")) & (F.col("_rest") <= F.col("_start") + F.col("_sum"))).select("_name", "_bucket", "_start"), "ends")
    last = join_small(placed, ends, ["_name", "_bucket"], "inner").groupBy("_name", "_rest", "_start", *ORDER).agg(F.count(F.lit(1)).alias("_m"))
    within = Window.partitionBy("_name").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_start") + F.coalesce(F.sum(F.col("_size") * F.col("_m")).over(within), F.lit(0))
    last = last.withColumn("_left", F.col("_rest") - before).filter((F.col("_left") > 0) & (F.col("_left") <= F.col("_size") * F.col("_m")))
    whole = F.floor(F.col("_left") / F.col("_size")).cast("long")
    cut = last.select("_name", F.struct(*ORDER).alias("cut"), F.col("_m").alias("cut_n"), whole.alias("cut_whole"), (F.col("_left") - whole * F.col("_size")).alias("cut_words"))
    return sources.drop("_rest", "_buckets").join(cut, "_name", "left")


def _name(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("-"))


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _narrow(seed: int) -> list[Column]:
    return [F.col("source").alias("_source"), _key(seed).alias("_key"), F.col("doc_id").alias("_id")]


def _taken(placed: DataFrame, size: Column, cuts: DataFrame) -> DataFrame:
    """placed: _key, _id and the columns of _cuts(). Adds copies (whole repeats) and partial (words of a last, cut one). `size` is evaluated only where key and id are those of the cut.

    Documents before the cut are taken once more. Those that share its place are told apart by a number where there are several: they are few, unless rows of one id are many."""
    own, at = (F.col("_key"), F.col("_id")), (F.col("cut._key"), F.col("cut._id"))
    none = F.col("cut").isNull()
    same = own[0].eqNullSafe(at[0]) & own[1].eqNullSafe(at[1])
    # null ids come first, as in the order by which the cut was found
    earlier = (own[0] < at[0]) | ((own[0] == at[0]) & F.when(own[1].isNull(), at[1].isNotNull()).when(at[1].isNull(), F.lit(False)).otherwise(own[1] < at[1]))
    side = F.when(none, 1).when(~same, F.when(earlier, -1).otherwise(1)).otherwise(F.signum(size - F.col("cut._size")).cast("int"))
    work = placed.withColumn("_side", side)
    plain = work.filter((F.col("_side") != 0) | (F.col("cut_n") == 1)).withColumn("_at", F.lit(0))
    if cuts.filter("cut_n > 1").limit(1).count():
        tied = work.filter((F.col("_side") == 0) & (F.col("cut_n") > 1)).withColumn("_at", F.row_number().over(Window.partitionBy("_name").orderBy("_key")) - 1)
        plain = plain.unionByName(tied)
    once_more = (F.col("_side") < 0) | ((F.col("_side") == 0) & (F.col("_at") < F.col("cut_whole")))
    partial = F.when((F.col("_side") == 0) & (F.col("_at") == F.col("cut_whole")), F.col("cut_words")).otherwise(0).cast("long")
    return plain.withColumn("partial", partial).withColumn("copies", F.col("copies") + once_more.cast("long")).drop("_side", "_at", "_key", "_id", "_name", "cut", "cut_n", "cut_whole", "cut_words")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, share: float = 1.0, seed: int = 0, keep: Sequence[str] = ()) -> DataFrame:
    """Decide how many words of each document the mix takes.

    Returns a row per row of `docs`: doc_id, the columns `keep`, source, size (words of the text), source_size, target (its source's), copies (whole repeats), partial (words of a
    last, cut repeat) and taken = copies * size + partial. Documents are taken in the order of their keys, over and over, until their source's target, rounded to whole words,
    is met exactly. The same seed gives the same mix.

    A null text has no words; a null source is a source of its own; repeated rows are documents of their own (which of those that share id and size is cut is then open);
    an empty table gives an empty result. Columns of docs other than doc_id, text, source and `keep` are not read, whatever their names.
    """
    box = F.struct(*[F.col(quoted(c)) for c in ("doc_id", *keep, "source")]).alias("row")
    rows = materialise(docs.select(box, *_narrow(seed), _size().alias("_size")), "mix")
    cuts = settled("cuts", lambda: _cuts(rows.drop("row"), weights, cap, share))
    placed = join_small(rows.withColumn("_name", _name(F.col("_source"))), cuts, "_name", "inner")
    out = _taken(placed.withColumn("size", F.col("_size")), F.col("_size"), cuts)
    return out.select("row.*", "size", "source_size", "target", "copies", "partial", (F.col("copies") * F.col("size") + F.col("partial")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, share: float = 1.0, seed: int = 0) -> DataFrame:
    """The mix itself: each document as often as it is taken, the last repeat cut to its first `partial` words (joined by one space); n_chars follows the text.
    Columns as in docs, whatever their names. Documents of which nothing is taken are left out; else as in mix().

    Texts stay in their scan: the table of cuts is joined to it, by broadcast if it is small enough."""
    narrow = materialise(docs.select(*_narrow(seed), _size().alias("_size")), "mix")
    cuts = settled("cuts", lambda: _cuts(narrow, weights, cap, share))
    release(narrow)
    work = boxed(docs, *_narrow(seed)).withColumn("_name", _name(F.col("_source"))).drop("_source")
    placed = join_small(work, cuts.drop("source_size", "target"), "_name", "inner")
    words = F.filter(F.split("row.text", SPACE + "+"), lambda x: x != "")
    size = F.coalesce(F.regexp_count("row.text", F.lit(WORD)), F.lit(0)).cast("long")
    taken = _taken(placed, size, cuts).filter("(copies > 0 or partial > 0) and row.text is not null").filter(F.col("row.text").rlike(WORD))
    each = F.concat(F.array_repeat(F.lit(None).cast("long"), F.col("copies").cast("int")), F.when(F.col("partial") > 0, F.array(F.col("partial"))).otherwise(F.array().cast("array<long>")))
    out = taken.withColumn("_cut", F.explode(each))
    row = F.col("row").withField("text", F.when(F.col("_cut").isNull(), F.col("row.text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("_cut").cast("int")), " ")))
    out = out.select(row.alias("row"))
    if "n_chars" in docs.columns:
        out = out.select(F.col("row").withField("n_chars", F.length("row.text").cast(docs.schema["n_chars"].dataType)).alias("row"))
    return out.select("row.*")
