"""Benchmarks made from a sealed release: its files checked against its lock, and the references read out of the answers."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOCK = "RELEASE.lock"
#: Labels that are copied into every row as its options, at most.
MOST_OPTIONS = 10_000
#: Keys of an answer that name its label, the first that is there.
LABEL_KEYS = ("deciding_factor", "label")


class ReleaseBroken(ValueError):
    """A release whose bytes are not those of its lock. mismatches: (file, what is wrong)."""

    def __init__(self, mismatches: Sequence[tuple[str, str]]) -> None:
        self.mismatches = list(mismatches)
        super().__init__("; ".join(f"{f}: {w}" for f, w in self.mismatches[:10]))


def release_files(spark: SparkSession, folder: str) -> DataFrame:
    """file (path inside of the folder), bytes, sha256 of all files of a folder; a file is hashed where it is read, and has at most 2 GB."""
    inside = folder.split("://")[-1].rstrip("/").removeprefix("file:") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return found.select(F.substring_index("path", inside, -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def check_release(spark: SparkSession, folder: str, lock: str = LOCK) -> DataFrame:
    """A row a file that the lock lists (a JSON object whose all_file_hashes maps names to SHA-256): file, expected, actual (null: missing), ok. Files that it does not list do not matter."""
    wanted = spark.read.option("multiLine", True).schema("all_file_hashes map<string,string>").json(f"{folder}/{lock}").select(F.explode("all_file_hashes").alias("file", "expected"))
    have = release_files(spark, folder).select("file", F.col("sha256").alias("actual"))
    return wanted.join(have, "file", "left").withColumn("ok", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)))


def verify_release(spark: SparkSession, folder: str, lock: str = LOCK) -> str:
    """The release's own hash: a chain over its files in order of name, each link the SHA-256 of the link before, the name and the file's hash. A missing or changed file raises ReleaseBroken."""
    rows = sorted(check_release(spark, folder, lock).collect())  # a row a file
    if bad := [(r.file, "missing" if r.actual is None else f"{r.actual[:16]} != {r.expected[:16]}") for r in rows if not r.ok]:
        raise ReleaseBroken(bad)
    link = ""
    for r in rows:
        link = hashlib.sha256(f"{link}{r.file}:{r.actual}".encode()).hexdigest()
    return link


def _of_kind(answer: Column, key: str, kind: str) -> Column:
    """The value of a key if it is of that JSON kind, else null; kinds are not converted."""
    at = F.try_variant_get(answer, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(at) == {"string": "STRING", "boolean": "BOOLEAN"}[kind], F.try_variant_get(answer, f"$.{key}", kind))


def references(examples: DataFrame, label_keys: Sequence[str] = LABEL_KEYS) -> DataFrame:
    """examples: messages and other columns. Adds problem (not_json, no_ranking or null), ranking (array of strings), label, confident, next_step (of exactly these kinds, else null), reasons (VARIANT of an object, else null) and
    answer (the whole last message as VARIANT: keys that are not known are kept)."""
    last = F.try_element_at("messages", F.lit(-1))["content"]
    out = examples.withColumn("answer", F.when(last.rlike(r"(?s)^\s*\{.*\}\s*$"), F.try_parse_json(last)))
    answer = F.col("answer")
    reasons = F.try_variant_get(answer, "$.reasons", "variant")
    ranked = F.try_variant_get(answer, "$.ranking", "array<string>")
    return out.withColumns({
        "problem": F.when(answer.isNull(), "not_json").when(ranked.isNull(), "no_ranking"),
        "ranking": ranked,
        "label": F.coalesce(*[_of_kind(answer, k, "string") for k in label_keys]),
        "confident": _of_kind(answer, "confident", "boolean"),
        "next_step": _of_kind(answer, "next_step", "string"),
        "reasons": F.when(F.schema_of_variant(reasons).startswith("OBJECT"), reasons),
    })


def build(examples: DataFrame, grader: str, label_keys: Sequence[str] = LABEL_KEYS, split_tag: str = "ood", ood_shift: str = "format") -> tuple[DataFrame, DataFrame]:
    """Evaluation rows from training rows (id, task, messages), and the rows that give none (id, problem). The last message is the reference, those before are the prompt; a row with a label has all labels of all rows, in order,
    as its options.

    Labels are counted before they are copied into rows: more than MOST_OPTIONS raise."""
    judged = references(examples, label_keys)
    good = judged.filter("problem is null")
    labels = good.select("label").filter("label is not null").distinct()
    own = [r["label"] for r in labels.limit(MOST_OPTIONS + 1).collect()]
    if len(own) > MOST_OPTIONS:
        raise ValueError(f"more than {MOST_OPTIONS} labels: they cannot be options of every row")
    options = F.when(F.col("label").isNotNull(), F.lit(sorted(own)).cast("array<string>"))
    reference = F.struct("ranking", "label", "confident", "next_step", "reasons", options.alias("options"), "answer")
    prompt = F.slice("messages", F.lit(1), F.greatest(F.size("messages") - 1, F.lit(0)))
    rows = good.select("id", "task", prompt.alias("messages"), reference.alias("reference"), F.lit(grader).alias("grader"), F.lit(split_tag).alias("split_tag"), F.lit(ood_shift).alias("ood_shift"))
    return rows, judged.filter("problem is not null").select("id", "problem")
