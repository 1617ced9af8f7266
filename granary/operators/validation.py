"""Checks of a whole dataset. Rows: id, version, task, text, targets (array of answers), axes (map), quality_status, source, split. Findings: severity, code, subject, n_affected, example_ids (up to 50)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FACT_HINTS, PLACEHOLDERS, PLACEHOLDERS_HOLD, any_of, approximate_token_count, sensitive_content
from .orderstats import least

# Registered names.
VERSIONS = ("1.0", "1.1")
TASKS = ("notification_prioritization", "tool_routing", "mission_control_briefing", "context_prioritization", "recommendation_generation", "memory_conflict_resolution", "workspace_reasoning")
AXES = ("domain", "entities", "urgency", "deadlines", "evidence_quality", "conflicting_evidence", "context_length", "presentation_order", "format", "source_type", "workspace", "task", "difficulty", "ambiguity")
REQUIRED_AXES = ("domain",)
SOURCES = ("synthetic", "synthetic_seeded", "real_sanitized", "expert_authored", "development_fixture")
STATUSES = ("draft", "auto_generated", "reviewed", "rejected")
SEVERITIES = ("error", "warning", "info")
#: Ids that a finding lists.
LISTED = 50


def _finding(severity: str | Column, code: str, subject: Column | None = None) -> Column:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(severity.alias("severity"), F.lit(code).alias("code"), (F.lit("") if subject is None else subject).alias("subject"))


def row_findings(rows: DataFrame, max_tokens: int | None = None, require_reviewed: bool = False, scan_content: bool = True) -> DataFrame:
    """id, severity, code, subject: everything that one row is guilty of by itself, in one pass."""
    empty = F.array().cast("array<string>")
    target = lambda patterns, flags, holds={}: F.exists(F.coalesce("targets", empty), lambda t: any_of(t, patterns, flags, holds))
    when = lambda bad, finding: F.when(F.coalesce(bad, F.lit(False)), F.array(finding)).otherwise(F.array().cast("array<struct<severity:string,code:string,subject:string>>"))
    parts = [when(F.coalesce(F.col("axes")[a], F.lit("")) == "", _finding("error", "missing_required_axis", F.lit(a))) for a in REQUIRED_AXES]
    parts += [
        when(~F.col("version").isin(*VERSIONS), _finding("warning", "unexpected_schema_version", F.col("version"))),
        when(F.coalesce("quality_status", F.lit("")) != "reviewed", _finding("error" if require_reviewed else "warning", "unreviewed_examples")),
        when(F.col("quality_status") == "rejected", _finding("error", "rejected_examples_present")),
        when(target(PLACEHOLDERS, "(?U)", PLACEHOLDERS_HOLD), _finding("error", "placeholder_content")),
        when(target(FACT_HINTS, "(?iU)"), _finding("warning", "possible_fact_memorization")),
        F.transform(F.filter(F.map_keys(F.coalesce("axes", F.create_map().cast("map<string,string>"))), lambda k: ~k.isin(*AXES)), lambda k: _finding("info", "unregistered_variation_axes", k)),
    ]
    if max_tokens is not None:
        parts.append(when(approximate_token_count(F.col("text")) > max_tokens, _finding("warning", "examples_exceed_max_tokens")))
    if scan_content:
        parts.append(F.transform(sensitive_content(F.coalesce("text", F.lit(""))), lambda n: _finding("error", "possible_sensitive_content", n)))
    return rows.select("id", F.explode(F.concat(*parts)).alias("f")).select("id", "f.*")


def validate(rows: DataFrame, max_tokens: int | None = None, require_reviewed: bool = False, scan_content: bool = True) -> DataFrame:
    """All findings: those of single rows gathered by code and subject, and those of the whole (empty, repeated ids, mixed versions, constant axes).

    Counts are complete; ids listed are the LISTED least, found in salted rounds, so that a code which nearly every row has is not ranked in one task."""
    per_row = row_findings(rows, max_tokens, require_reviewed, scan_content).repartition("id")  # one exchange, so that texts are scanned once for counts and ids
    by = ("severity", "code", "subject")
    counts = per_row.groupBy(*by).agg(F.count(F.lit(1)).alias("n_affected"))
    ids = least(per_row, by, ["id"], LISTED).groupBy(*by).agg(F.sort_array(F.collect_list("id")).alias("example_ids"))
    out = counts.join(ids, list(by))
    return out.unionByName(whole_findings(rows))


def duplicate_ids(rows: DataFrame) -> DataFrame:
    """id, n and first_split (by ord, if there is one) of ids that occur more than once."""
    order = "ord" if "ord" in rows.columns else "split"
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min_by("split", order).alias("first_split")).filter("n > 1")


def whole_findings(rows: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    twice = rows.groupBy("id").count().filter("count > 1")
    repeated = twice.agg(F.lit("error").alias("severity"), F.lit("duplicate_ids").alias("code"), F.lit("").alias("subject"), F.count(F.lit(1)).alias("n_affected")).filter("n_affected > 0")
    listed = twice.orderBy("id").limit(LISTED).agg(F.sort_array(F.collect_list(F.col("id").cast("string"))).alias("example_ids"))
    repeated = repeated.crossJoin(listed)
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("version").alias("versions"))
    empty = totals.filter("n = 0").select(F.lit("error").alias("severity"), F.lit("empty_dataset").alias("code"), F.lit("").alias("subject"), F.lit(0).cast("long").alias("n_affected"), none.alias("example_ids"))
    mixed = totals.filter("versions > 1").select(F.lit("warning").alias("severity"), F.lit("mixed_schema_versions").alias("code"), F.lit("").alias("subject"), F.col("n").alias("n_affected"), none.alias("example_ids"))
    axes = rows.select(F.explode("axes").alias("axis", "value")).filter(F.col("axis").isin(*AXES) & F.col("value").isNotNull()).groupBy("axis").agg(F.count(F.lit(1)).alias("have"), F.min("value").alias("low"), F.max("value").alias("high"))
    constant = axes.crossJoin(F.broadcast(totals)).filter((F.col("low") == F.col("high")) & (F.col("have") >= F.greatest(F.lit(4), F.floor(F.col("n") / 2))))
    constant = constant.select(F.lit("warning").alias("severity"), F.lit("constant_variation_axis").alias("code"), F.col("axis").alias("subject"), F.col("have").alias("n_affected"), none.alias("example_ids"))
    return reduce(DataFrame.unionByName, [repeated, empty, mixed, constant])


def ok(findings: DataFrame) -> bool:
    """No finding is an error."""
    return findings.filter("severity = 'error'").limit(1).count() == 0


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.array_position(F.lit(list(SEVERITIES)), F.col("severity")), "code", "subject")


def apply_filters(rows: DataFrame, tasks=None, domains=None, statuses=("reviewed",), excluded_sources=(), min_messages: int = 2, allow_unreviewed: bool = False, max_examples: int | None = None) -> DataFrame:
    """Rows that pass; of split train, then, the first max_examples by ord. Rows: task, domain, quality_status, source, n_messages, split, ord."""
    out = rows.filter(F.col("n_messages") >= min_messages)
    for column, allowed in (("task", tasks), ("domain", domains), ("quality_status", None if allow_unreviewed else statuses)):
        if allowed:
            out = out.filter(F.col(column).isin(*allowed))
    if excluded_sources:
        out = out.filter(~F.coalesce(F.col("source").isin(*excluded_sources), F.lit(False)))
    if max_examples is not None:
        head = out.filter("split = 'train'").orderBy("ord").limit(max_examples)
        out = out.filter("split <> 'train'").unionByName(head)
    return out
