"""A corpus cleaned, deduplicated, mixed and packed: stages over `documents`, each of which works on all that the one before it kept.

All stages but the last return the columns of docs, whatever their names; an empty table gives an empty one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm import mixing, packing, quality, simhash, substring
from granary.llm.common import materialise, release, settled  # noqa: F401
from granary.llm.queries import op2_columns, tokenizer_files


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or lie on a rejected host, go. A null or empty text fails by its words; a null source is a host like any other; repeated rows are judged alike."""
    return quality.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, the one with the smallest id, null ids last; of rows equal in id and text one stays."""
    return simhash.drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that stand anywhere else are cut from the texts. Every row stays, also one whose text becomes empty; a null text stays null."""
    return substring.dedup_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the last repeat in a source is cut at its budget. Texts without words go; a null source is a source of its own; which of several rows of one id and size is cut is
    open."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents and their places in sequences."""
    return op2_columns(packing.pack(docs, digest=packing.with_crc, **tokenizer_files()))


STAGES = [("quality rules", rules), ("SimHash near-dedup", near_duplicates), ("substring dedup", repeated_passages), ("source mix", mix), ("best-fit packing", packed)]
#: Tokenising and hashed windows over all documents are not SQL: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. A stage's result is written before the tables that it made on the way, and its predecessor's result, are deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settled(name.replace(" ", "-"), lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
