"""Quality rules with host-level verdicts, in DataFrame operations only.

Every document is measured by itself; failures are then counted per host, a host's rates are shrunk towards the corpus by a beta prior that is fitted to
the hosts themselves, and the host's verdict is joined back to its documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, boxed, join_small, materialise, quoted

#: Words of a repeat window.
WINDOW = 8
#: A host is rejected if its shrunk rate of failure in any rule is above this,
MAX_HOST_RATE = 0.5
#: or if it is, by so many standard deviations, above both so many times the corpus rate and this rate.
TIMES, LEAST_RATE, SURE = 3.0, 0.15, 3.0


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, also when `use` refers to it from inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeat_count(hashes: Column, width: int = WINDOW) -> Column:
    """hashes: array of one long a word. Words that lie in a window of `width` words found twice or more in the array.

    Most texts have no repeated window, which the number of distinct window hashes tells. In the others windows are sorted by hash; a window whose neighbour has
    the same hash is repeated, and sorted repeated windows cover min(width, distance to the next) words each."""

    def covered(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(sorted_pairs: Column) -> Column:
            n = F.size(sorted_pairs)
            marked = F.transform(
                sorted_pairs,
                lambda x, k: F.when(((k > 0) & (F.get(sorted_pairs, k - 1)["h"] == x["h"])) | ((k < n - 1) & (F.get(sorted_pairs, k + 1)["h"] == x["h"])), x["i"]),
            )
            return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))

        def cover(at: Column) -> Column:
            steps = F.transform(at, lambda i, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - i, F.lit(width))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

        return let(let(pairs, repeated), cover)

    windows = F.transform(F.sequence(F.lit(1), F.size(hashes) - (width - 1)), lambda i: F.xxhash64(F.slice(hashes, i, width)))
    found = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(hashes) > width, found).otherwise(F.lit(0).cast("long"))


def _by_word(text: Column) -> Column:
    """Struct of n (words) and r (words in repeated windows)."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda x: x != "")
    return let(F.transform(words, lambda x: F.xxhash64(x)), lambda h: F.struct(F.size(h).cast("long").alias("n"), repeat_count(h).alias("r")))


def measures(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_lines (those with a word), n_dup_lines, n_repeat_words (all long) of a text. All are 0 for a null or empty text."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rest = [
        (F.length(whole) - F.regexp_count(whole, F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
    ]
    whole = let(_by_word(text), lambda m: F.struct(m["n"].alias("n_words"), *rest, m["r"].alias("n_repeat_words")))
    return let(whole, lambda m: F.struct(*[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols")], m["lines"]["n"].alias("n_lines"), m["lines"]["dup"].alias("n_dup_lines"), m["n_repeat_words"].alias("n_repeat_words")))


#: Rules whose failures are counted per host: a document fails one by the condition. The first two make base_failed; n_lines is the number of lines with a word.
RULES = {
    "few_words": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * word_chars",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
}


def host_verdicts(measured: DataFrame, host: str, max_rate: float = MAX_HOST_RATE, times: float = TIMES, sure: float = SURE) -> DataFrame:
    """measured: a row a document with `host` and a boolean column a rule of RULES. A row a host: n_docs, and for each rule <rule>_rate (shrunk) and <rule>_ok; host_ok (all of them).

    Prior: for each rule a beta distribution whose mean is the corpus rate m and whose strength s = m (1 - m) / v - 1, with v the variance of the hosts' rates
    weighted by their documents less what binomial noise explains, held within 1 to 1e6 (1e6 also where the hosts do not differ). A host's posterior has the mean
    (failures + s m) / (documents + s), its shrunk rate. A host fails a rule if that rate is above max_rate, or if the rate less `sure` standard deviations of the posterior is above
    LEAST_RATE and above `times` the corpus rate: it then stands out of the corpus for certain. A null host is a host like any other.
    """
    counts = materialise(measured.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), *[F.count_if(F.col(r)).alias(r) for r in RULES]), "hosts")
    n = F.col("n_docs")
    got = counts.agg(F.sum(n).alias("n"), F.count(F.lit(1)).alias("hosts"), *[F.sum(r).alias(r) for r in RULES], *[F.sum(F.col(r) * F.col(r) / n).alias(f"{r}_sq") for r in RULES]).first()
    out, ok = counts, F.lit(True)
    for r in RULES:
        mean = (got[r] or 0) / got["n"] if got["n"] else 0.0
        spread = (got[f"{r}_sq"] or 0.0) / got["n"] - mean * mean if got["n"] else 0.0
        noise = mean * (1 - mean) * got["hosts"] / got["n"] if got["n"] else 0.0
        strength = min(1e6, max(1.0, mean * (1 - mean) / (spread - noise) - 1)) if spread - noise > 1e-12 else 1e6
        rate = (F.col(r) + F.lit(strength * mean)) / (n + F.lit(strength))
        certain = rate - F.lit(sure) * F.sqrt(rate * (1 - rate) / (n + F.lit(strength + 1)))
        out = out.withColumn(f"{r}_rate", rate).withColumn(f"{r}_ok", (rate <= F.lit(max_rate)) & (certain <= F.lit(max(LEAST_RATE, times * mean))))
        ok = ok & F.col(f"{r}_ok")
    return out.withColumn("host_ok", ok).drop(*RULES)


def _host_key(host: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), host), F.lit("-"))


def _failed() -> Column:
    return F.col("few_words") | F.col("repeats")


def quality(docs: DataFrame, host: str = "source", keep: tuple[str, ...] = (), **limits: float) -> DataFrame:
    """Measure each document and judge it and its host.

    Returns a row per row of docs: doc_id, the columns `keep`, host, the measures, base_failed (the first two RULES), host_ok and kept (neither failed). A null or empty text fails by its words. A null host
    is a host like any other; repeated rows are documents of their own; an empty table gives an empty result. Columns other than doc_id, text, host and `keep` are not read, whatever their names."""
    box = F.struct("doc_id", *[F.col(quoted(c)) for c in keep]).alias("row")
    m = docs.select(box, F.col(quoted(host)).alias("host"), measures(F.col("text")).alias("_m")).select("row", "host", "_m.*")
    m = materialise(m.withColumns({r: F.expr(c) for r, c in RULES.items()}), "measured")
    verdicts = materialise(host_verdicts(m, "host", **limits).select(_host_key(F.col("host")).alias("_host"), "host_ok"), "verdicts")
    judged = join_small(m.withColumn("_host", _host_key(F.col("host"))), verdicts, "_host").drop("_host")
    return judged.withColumn("base_failed", _failed()).withColumn("kept", ~F.col("base_failed") & F.col("host_ok")).drop(*RULES).select("row.*", *[c for c in judged.columns if c not in ("row", *RULES)], "base_failed", "kept")


def filter_documents(docs: DataFrame, host: str = "source", **limits: float) -> DataFrame:
    """The documents that quality() keeps, with docs' own columns, whatever their names.

    Every text is measured once: the pass that counts failures per host also stores the documents that pass by themselves, and those whose host is rejected are left out of that table
    by a join with the list of rejected hosts. Nulls, empty tables and repeated rows are treated as in quality()."""
    m = boxed(docs, F.col(quoted(host)).alias("host"), measures(F.col("text")).alias("_m")).select("row", "host", "_m.*").withColumns({r: F.expr(c) for r, c in RULES.items()})
    m = materialise(m.select(F.when(~_failed(), F.col("row")).alias("row"), "host", *RULES), "passed")
    verdicts = host_verdicts(m.drop("row"), "host", **limits)
    rejected = materialise(verdicts.filter(~F.col("host_ok")).select(_host_key(F.col("host")).alias("_host")), "rejected")
    own = m.filter(~_failed()).select("row", _host_key(F.col("host")).alias("_host"))
    return join_small(own, rejected, "_host", "left_anti").select("row.*")
