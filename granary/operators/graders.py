"""Graders: each turns an answer and its reference into columns score, parse_failed and sub-scores. References are columns of one struct, so a table may mix graders."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.extract import extract_confidence, extract_factor, extract_json, extract_label, extract_ranking, is_json_object
from ..functions.text import any_of, normalize_answer

# Rubric dimensions, those where more is worse, and phrases that the structural rubric looks for.
DIMENSIONS = ("correctness", "evidence_usage", "prioritization_quality", "actionability", "relevance", "critical_omission", "unsupported_claims", "consistency")
NEGATIVE = ("critical_omission", "unsupported_claims")
HEDGES = (r"\bas an ai\b", r"\bi (?:cannot|can't|am unable to)\b")
UNSUPPORTED = (r"\bobviously\b", r"\beveryone knows\b", r"\bit is well known\b", r"\bcertainly the (?:best|worst)\b")
ACTIONS = (r"\b(?:should|recommend|suggest|next step|action|prioriti[sz]e)\b", r"(?m)^\s*(?:\d+[.)]|[-*])\s+")
NDCG_WEIGHT = 0.6

REFERENCE = "text string, label string, options array<string>, items array<string>, ranking array<string>, confident boolean, required_points array<string>, forbidden_points array<string>, evidence_ids array<string>, expected_decision string"


def _norm(text: Column) -> Column:
    return normalize_answer(text, exact=False)


def _norms(items: Column) -> Column:
    return F.transform(F.coalesce(items, F.array().cast("array<string>")), _norm)


def _result(score: Column, failed: Column, **subs: Column) -> Column:
    names = [x for n, c in subs.items() for x in (F.lit(n), c.cast("double"))]
    return F.struct(score.cast("double").alias("score"), failed.alias("parse_failed"), F.create_map(*names).alias("sub_scores"))


def exact_match(response: Column, parsed: Column, ref: Column) -> Column:
    want = _norm(F.coalesce(ref["text"], ref["label"], F.lit("")))
    same = M.exact_match(_norm(response), want)
    return _result(same, F.lit(False), exact_match=same, token_f1=M.token_f1(_norm(response), want))


def classification(response: Column, parsed: Column, ref: Column) -> Column:
    options = F.coalesce(ref["options"], F.array().cast("array<string>"))
    return M.let(extract_label(response, parsed, options), lambda label: _result(M.exact_match(_norm(label), _norm(F.coalesce(ref["label"], F.lit("")))), F.trim(label) == "", accuracy=M.exact_match(_norm(label), _norm(F.coalesce(ref["label"], F.lit(""))))))


def set_match(response: Column, parsed: Column, ref: Column) -> Column:
    want = F.coalesce(ref["items"], F.array().cast("array<string>"))
    listed = F.coalesce(F.when(parsed.startswith("["), F.from_json(parsed, "array<string>")), *[F.when(is_json_object(parsed), F.from_json(F.get_json_object(parsed, f"$.{k}"), "array<string>")) for k in ("items", "selected", "relevant")], F.array().cast("array<string>"))
    got = F.when(F.size(listed) > 0, listed).otherwise(extract_ranking(response, parsed, want))
    return M.let(got, lambda g: M.let(M.set_scores(_norms(g), _norms(want)), lambda s: _result(s["f1"], F.size(g) == 0, precision=s["precision"], recall=s["recall"], f1=s["f1"])))


def _ranked(response: Column, parsed: Column, ref: Column, use: Callable[[Column], Column]) -> Column:
    """use() of a struct of the extracted ranking's scores."""

    def scores(got: Column) -> Column:
        return M.let(
            F.struct(_norms(got).alias("p"), _norms(ref["ranking"]).alias("r")),
            lambda s: F.struct((F.size(got) == 0).alias("failed"), F.when(F.size(got) == 0, F.lit(0.0)).otherwise(M.ndcg(s["p"], s["r"])).alias("ndcg"), F.when(F.size(got) == 0, F.lit(0.0)).otherwise(M.kendall_tau(s["p"], s["r"])).alias("tau"), M.top_1(s["p"], s["r"]).alias("top_1")),
        )

    return M.let(M.let(extract_ranking(response, parsed, ref["ranking"]), scores), use)


def _blend(s: Column) -> Column:
    return F.lit(NDCG_WEIGHT) * s["ndcg"] + F.lit(1 - NDCG_WEIGHT) * s["top_1"]


def ranking(response: Column, parsed: Column, ref: Column) -> Column:
    return _ranked(response, parsed, ref, lambda s: _result(_blend(s), s["failed"], ndcg=s["ndcg"], kendall_tau=s["tau"], top_1_accuracy=s["top_1"]))


def _covered(normalized: Column, points: Column) -> Column:
    found = F.size(F.filter(points, lambda p: F.instr(normalized, _norm(p)) > 0))
    return F.when(F.size(points) == 0, F.lit(1.0)).otherwise(found / F.greatest(F.size(points), F.lit(1)))


def heuristic_rubric(response: Column, parsed: Column, ref: Column) -> Column:
    """Correctness, evidence usage, actionability, omission and unsupported claims, each from 0 to 1; the mean with the NEGATIVE ones inverted."""
    empty = F.array().cast("array<string>")
    required, forbidden, evidence = (F.coalesce(ref[k], empty) for k in ("required_points", "forbidden_points", "evidence_ids"))

    def judge(n: Column) -> Column:
        covered = _covered(n, required)
        correct = F.when(ref["expected_decision"].isNull(), covered).otherwise((F.instr(n, _norm(ref["expected_decision"])) > 0).cast("double"))
        usage = F.when(F.size(evidence) > 0, _covered(n, evidence)).when(F.size(required) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.size(M.tokens(n)) / 40))
        action = (any_of(response, ACTIONS, "(?iU)") & ~any_of(response, HEDGES, "(?iU)")).cast("double")
        hits = sum((response.rlike("(?iU)" + p).cast("int") for p in UNSUPPORTED), F.lit(0))
        bad = F.size(F.filter(forbidden, lambda p: F.instr(n, _norm(p)) > 0))
        penalty = F.least(F.lit(1.0), F.lit(0.34) * (hits + 2 * bad))
        mean = (correct + usage + action + covered + (1.0 - penalty)) / 5
        return _result(mean, F.lit(False), correctness=correct, evidence_usage=usage, actionability=action, critical_omission=1.0 - covered, unsupported_claims=penalty)

    return M.let(_norm(response), judge)


def policy(response: Column, parsed: Column, ref: Column) -> Column:
    """Mean of what the reference names: order, stated reason, commitment; whether the format is JSON is reported, not scored."""
    labelled = F.nullif(ref["label"], F.lit("")).isNotNull()
    allowed = F.when(F.size(F.coalesce(ref["options"], F.array().cast("array<string>"))) > 0, ref["options"]).otherwise(F.array(ref["label"]))
    factor = F.when(labelled, (_norm(extract_factor(response, parsed, allowed)) == _norm(ref["label"])).cast("double"))
    firm = F.when(ref["confident"].isNotNull(), (extract_confidence(response, parsed)["confident"] == ref["confident"]).cast("double"))

    def judge(s: Column) -> Column:
        parts = F.filter(F.array(_blend(s), factor, firm), lambda x: x.isNotNull())
        return _result(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts), s["failed"], format_valid=is_json_object(parsed), ranking_ndcg=s["ndcg"], ranking_top_1=s["top_1"], ranking_kendall_tau=s["tau"], ranking=_blend(s), deciding_factor=factor, confidence=firm)

    return _ranked(response, parsed, ref, judge)


Grader = Callable[[Column, Column, Column], Column]
GRADERS: dict[str, Grader] = {"exact_match": exact_match, "classification": classification, "set_match": set_match, "ranking": ranking, "heuristic_rubric": heuristic_rubric, "policy": policy}


def register_grader(name: str, grader: Grader) -> None:
    """Add a grader: a function of columns (response, its JSON or null, reference struct) to a struct of score, parse_failed and sub_scores."""
    GRADERS[name] = grader


def grade(df: DataFrame, response: str = "response", reference: str = "reference", grader: str = "grader") -> DataFrame:
    """Add score, parse_failed and sub_scores (map; sub-scores that do not apply are left out) by the grader that each row names; unknown names raise."""
    work = df.withColumn("_json", extract_json(F.col(response)))
    args = F.col(response), F.col("_json"), F.col(reference)
    chosen = F.raise_error(F.concat(F.lit("no such grader: "), F.coalesce(F.col(grader), F.lit("null")))).cast("struct<score:double,parse_failed:boolean,sub_scores:map<string,double>>")
    for name, build in GRADERS.items():
        chosen = F.when(F.col(grader) == name, build(*args)).otherwise(chosen)
    out = work.withColumn("_g", chosen).select(*df.columns, "_g.score", "_g.parse_failed", F.map_filter("_g.sub_scores", lambda k, v: v.isNotNull()).alias("sub_scores"))
    return out


def judge_prompt(response: Column, reference_json: Column, dimensions: Iterable[str] = DIMENSIONS) -> Column:
    rubric = "\n".join(f"- {d}: 0 to 4" for d in dimensions)
    return F.concat(F.lit(f"Rate the response on each dimension from 0 (worst) to 4 (best). Answer only with a JSON object of dimension names and whole numbers.\n\nDimensions:\n{rubric}\n\nReference:\n"), reference_json, F.lit("\n\nResponse:\n"), response)


def judged(df: DataFrame, judge: Callable[[pd.Series], pd.Series], response: str = "response", reference_json: str = "reference_json", dimensions: Iterable[str] = DIMENSIONS) -> DataFrame:
    """Score by a judge given as a vectorised function of prompts: ratings from 0 to 4, clamped and scaled, the NEGATIVE ones inverted, their mean; a reply without ratings fails."""
    ask = F.pandas_udf(judge, "string")
    names = list(dimensions)
    rated = df.withColumn("_json", extract_json(ask(judge_prompt(F.col(response), F.col(reference_json), names))))
    rate = lambda d: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.expr(f"try_cast(get_json_object(_json, '$.{d}') AS DOUBLE)") / 4))
    values = F.filter(F.array(*[(1.0 - rate(d)) if d in NEGATIVE else rate(d) for d in names]), lambda x: x.isNotNull())
    rated = rated.withColumn("_v", F.when(is_json_object(F.col("_json")), values).otherwise(F.array().cast("array<double>")))
    return rated.withColumn("parse_failed", F.size("_v") == 0).withColumn("score", F.when(F.size("_v") == 0, F.lit(0.0)).otherwise(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x) / F.size("_v"))).drop("_json", "_v")
