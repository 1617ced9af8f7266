"""Language identification by prediction by partial matching.

Every language has a tree of byte contexts up to `order` bytes long. A byte costs -log2 of its share in the longest context that knows it, plus the price of
an escape for every longer context that does not; escapes have the probability q / (n + q) in a context of n bytes with q different ones. Statistics are
frozen after training, so a text's code length is a sum of table entries, the same wherever it is computed, and the shortest code names the language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_small, materialise, release

#: Longest context in bytes.
ORDER = 4
#: What is learned from, at most: of each language the documents with the least hash of their id, up to so many and to so many bytes of text; and so many bytes of all languages, of which each has an equal share. One
#: document of each language is always learned from.
MAX_DOCS, MAX_BYTES, MAX_TOTAL = 2000, 32 << 20, 128 << 20
#: Languages whose statistics share a table: a gram that one of them has seen has a place for each, so tables of many languages would be mostly empty.
TOGETHER = 8
#: Bytes that are scored at a time.
CHUNK = 1 << 20


class Table:
    """A static hash table from unsigned 64-bit keys to rows of a float array."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 4 - 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        self.keys, self.rows = keys, rows
        at, left = self._home(keys), np.arange(len(keys), dtype=np.int32)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            at, left = (at[lost] + 1) & self.mask, left[lost]
        self.slot_keys = np.where(self.slots >= 0, keys[self.slots] if len(keys) else 0, np.uint64(0))

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, -1 where a key is not there."""
        at = self._home(keys)
        found = self.slots[at]
        lost = np.flatnonzero((self.slot_keys[at] != keys) & (found >= 0))
        while len(lost):
            at[lost] = (at[lost] + 1) & self.mask
            found[lost] = self.slots[at[lost]]
            lost = lost[(self.slot_keys[at[lost]] != keys[lost]) & (found[lost] >= 0)]
        return found


@dataclass
class Block:
    """Statistics of a few languages. langs in code point order; costs[k]: bits of a byte after k bytes of context, a column a language, for every such gram that any language has seen;
    escapes[k]: bits of the escape from a context of k bytes."""

    langs: list[str]
    costs: list[Table]
    escapes: list[Table]

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """grams: order + 1 bytes each, packed. Code length of the last byte given the others, a column a language."""
        order = len(self.costs) - 1
        at = self.costs[order].find(grams)
        out = self.costs[order].rows[at]
        lost = np.flatnonzero(at < 0)
        if len(lost):
            out[lost] = 0
        for k in range(order, -1, -1):
            if not len(lost):
                break
            context = _suffix(grams[lost] >> np.uint64(8), k)
            e = self.escapes[k].find(context)
            out[lost[e >= 0]] += self.escapes[k].rows[e[e >= 0]]
            if k == 0:
                out[lost] += 8.0
                break
            c = self.costs[k - 1].find(_suffix(grams[lost], k))
            hit = c >= 0
            out[lost[hit]] += self.costs[k - 1].rows[c[hit]]
            lost = lost[~hit]
        return out


def _suffix(grams: np.ndarray, n: int) -> np.ndarray:
    return grams & np.uint64((1 << (8 * n)) - 1)


def _grams(data: np.ndarray, order: int) -> np.ndarray:
    """Packed grams that end at each byte from `order` on."""
    wide = data.astype(np.uint64)
    n = len(wide) - order
    out = wide[:n].copy()
    for j in range(1, order + 1):
        out = (out << np.uint64(8)) | wide[j : j + n]
    return out


def _fit_block(counts: pd.DataFrame, order: int) -> Block:
    langs = sorted(counts["lang"].unique().tolist(), key=lambda x: [ord(c) for c in x])
    lower: Table | None = None
    costs, escapes = [], []
    for k in range(order + 1):
        grams = counts.assign(gram=_suffix(counts["gram"].to_numpy().astype(np.uint64), k + 1)).groupby(["lang", "gram"], sort=False)["n"].sum().reset_index()
        keys = np.unique(grams["gram"].to_numpy(np.uint64))
        n = np.zeros((len(keys), len(langs)))
        n[np.searchsorted(keys, grams["gram"].to_numpy(np.uint64)), grams["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()] = grams["n"].to_numpy()
        contexts, inverse = np.unique(keys >> np.uint64(8), return_inverse=True)
        total, kinds = np.zeros((len(contexts), len(langs))), np.zeros((len(contexts), len(langs)))
        np.add.at(total, inverse, n)
        np.add.at(kinds, inverse, n > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
            direct = np.log2((total + kinds)[inverse] / n)
        back = lower.rows[lower.find(_suffix(keys, k))] if lower else np.full(n.shape, 8.0)
        lower = Table(keys, np.where(n > 0, direct, escape[inverse] + back).astype(np.float32))
        costs.append(lower)
        escapes.append(Table(contexts, escape.astype(np.float32)))
    return Block(langs, costs, escapes)


@dataclass
class Model:
    """All languages in code point order, in blocks. A language's costs are its own, whatever block it is in."""

    langs: list[str]
    blocks: list[Block]


def fit_counts(counts: pd.DataFrame, order: int = ORDER) -> Model:
    """counts: lang, gram (order + 1 bytes), n; one row a pair."""
    langs = sorted(counts["lang"].unique().tolist(), key=lambda x: [ord(c) for c in x])
    own = dict(tuple(counts.groupby("lang", sort=False)))
    return Model(langs, [_fit_block(pd.concat([own[x] for x in langs[a : a + TOGETHER]]), order) for a in range(0, len(langs), TOGETHER)])


def _chosen(known: DataFrame, max_docs: int, max_bytes: int, max_total: int) -> DataFrame:
    """Table of doc_id, lang: the sample. Rows are ranked by a hash of their id, but only those under a bound that a language's number of rows sets: the bound is
    raised where it lets too few ids through, so the sample is the same as that of a ranking of all rows, and no task sees a language whole. The driver gets places and sizes of the ids under the bound (a few
    times max_docs a language) and finds where each language's sample ends."""
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a number a language
    max_bytes = min(max_bytes, max_total // max(1, len(counts)))
    spark = known.sparkSession
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    sized = known.select("lang", "doc_id", place.alias("place"), F.octet_length("text").cast("long").alias("bytes"))
    bounds = {r["lang"]: min(1.0, 2 * max_docs / r["n"]) for r in counts}
    while True:
        table = spark.createDataFrame(list(bounds.items()), "lang string, bound double")
        under = sized.join(F.broadcast(table), "lang").filter("place <= bound")
        found = materialise(under.groupBy("lang", "doc_id", "place").agg(F.sum("bytes").alias("bytes")), "sample")
        have = {r["lang"]: r["n"] for r in found.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
        short = [x for x, b in bounds.items() if b < 1.0 and have.get(x, 0) < max_docs]
        if not short:
            break
        release(found)
        bounds |= {x: min(1.0, 2 * bounds[x]) for x in short}
    ranked = found.select("lang", "place", "doc_id", "bytes").toArrow().to_pandas().sort_values(["lang", "place", "doc_id"], kind="stable")
    by = ranked.groupby("lang", sort=False)
    ranked["end"] = by["bytes"].cumsum()
    kept = ranked[(by.cumcount() < max_docs) & ((by.cumcount() == 0) | (ranked["end"] <= max_bytes))]
    # a sample ends at the first document that does not fit
    ends = kept.groupby("lang", sort=False)[["place", "doc_id"]].last().reset_index()
    table = spark.createDataFrame(ends, found.select("lang", "place", "doc_id").schema).withColumnsRenamed({"place": "_place", "doc_id": "_doc_id"})
    before = F.struct("place", "doc_id") <= F.struct("_place", "_doc_id")
    chosen = materialise(found.join(F.broadcast(table), "lang").filter(before).select("doc_id", "lang"), "chosen")
    release(found)
    return chosen


def train(docs: DataFrame, learn: Column, order: int = ORDER, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES, max_total: int = MAX_TOTAL) -> Model:
    """Learn from rows of docs for which `learn` holds, with a text and a lang: whole texts, within the bounds given.

    Rows are chosen by id and lang alone (rows without an id are not, rows that share both come together); grams of their texts are counted on the executors, and the driver gets the counts: their number is bounded by
    the sample, whatever the size of docs. Nothing to learn from gives a model that names no language. Other columns of docs are not read, whatever their names."""
    known = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text")
    sample = join_small(known, _chosen(known, max_docs, max_bytes, max_total), ["doc_id", "lang"], "left_semi").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pad = b" " * order
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(pad + text.encode("utf-8", "surrogatepass"))
            for lang, texts in by.items():
                grams = [_grams(np.frombuffer(t, np.uint8), order) for t in texts]
                values, n = np.unique(np.concatenate(grams), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values)), pa.array(values.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return fit_counts(counts.toArrow().to_pandas(), order)


def predict(docs: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",), order: int = ORDER) -> DataFrame:
    """Score every whole text under every language.

    Returns the columns given, lang_pred (the language of the shortest code, ties to the first by code point; `und` if the text is null or has no letter, or nothing was
    learned), score (its posterior probability with all languages equally likely before; 0 for und) and bits_per_byte (of the shortest code; null for und)."""
    spark, n = docs.sparkSession, len(columns)
    schema = T.StructType([*docs.select(*columns).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = [t.as_py() for t in batch.column(n)]
            heard = [i for i, t in enumerate(texts) if m.langs and t is not None and any(map(str.isalpha, t))]
            lang, score, rate = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
            at = 0
            while at < len(heard):
                some, size = [], 0
                while at < len(heard) and (not some or size < CHUNK):
                    some.append((heard[at], texts[heard[at]].encode("utf-8", "surrogatepass")))
                    size += len(some[-1][1])
                    at += 1
                for (i, t), bits in zip(some, code_lengths(m, [t for _, t in some], order), strict=True):
                    best = int(np.argmin(bits))
                    lang[i], score[i], rate[i] = m.langs[best], float(1.0 / np.exp2(np.maximum(bits[best] - bits, -1000.0)).sum()), float(bits[best] / len(t))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(lang), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], schema.names)

    return docs.select(*columns, "text").mapInArrow(run, schema)


def code_lengths(model: Model, texts: list[bytes], order: int = ORDER) -> np.ndarray:
    """Bits of each text under each language. Long texts are scored in stretches that overlap by the context, so memory stays bounded."""
    pad = b" " * order
    data = np.frombuffer(pad + pad.join(texts), np.uint8)
    ends = np.cumsum([len(t) + order for t in texts])
    out = np.zeros((len(texts), len(model.langs)))
    for a in range(0, len(data) - order, CHUNK):
        b = min(a + CHUNK, len(data) - order)
        grams = _grams(data[a : b + order], order)
        # grams at g (from a to b) end at byte g + order of data: text k holds those from ends[k-1] to ends[k] - order
        first, last = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, b - 1, "right"))
        at = 0
        for block in model.blocks:
            bits, own = block.bits(grams), slice(at, at + len(block.langs))
            at = own.stop
            for k in range(first, min(last, len(texts) - 1) + 1):
                lo = max(a, int(ends[k]) - len(texts[k]) - order)
                hi = min(b, int(ends[k]) - order)
                if hi > lo:
                    out[k, own] += bits[lo - a : hi - a].sum(axis=0, dtype=np.float64)
    return out
