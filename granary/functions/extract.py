"""Column functions that read decisions, rankings, labels, claims and citations out of free text."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .metrics import let
from .text import normalize_answer

# Phrases by which an answer declines to commit.
ABSTENTION = (
    r"\bi (?:do not|don't) know\b",
    r"\b(?:tell|let) me\b",
    r"\bwhich one\b",
    r"\bdo you mean\b",
    r"\bclarif(?:y|ication)\b",
    r"\bconfirm\b",
    r"\b(?:cannot|can't|could not) (?:tell|say|decide|pick)\b",
    r"\bnot enough\b|\binsufficient\b|\bunderspecified\b|\bunclear\b",
    r"\bwould (?:just )?be a guess\b|\bcoin flip\b",
    r"\buntil you say otherwise\b",
    r"\bbefore i (?:pick|recommend|choose)\b",
    r"\bnot going to overwrite\b",
)
# Keys under which answers state things, and the phrase that names the deciding factor.
RANKING_KEYS = ("ranking", "order", "priorities", "items")
LABEL_KEYS = ("label", "decision", "answer", "category", "priority")
FACTOR_KEYS = ("deciding_factor", "decided_by", "factor")
CONFIDENCE_KEYS = ("confident", "is_confident", "confidence")
DECIDED_BY = r"(?i)what\s+decided\s+it\s*[:\-—]\s*([A-Za-z_][A-Za-z_ ]*)"
LIST_LINE = r"(?m)^\s*(?:\d+[.)]|[-*])\s*(.+?)\s*$"
# Claim-bearing tokens, citations, and words that are capital only because they start a sentence.
NUMBER = r"\b\d+(?:[.,]\d+)*%?\b"
DATE = r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2}\b"
CURRENCY = r"[$€£]\s?\d[\d,.]*"
PROPER_NOUN = r"\b[A-Z][a-zA-Z]{2,}(?:\s+[A-Z][a-zA-Z]{2,})*\b"
CITATION = r"(?i)\b(?:evidence|source|doc|item|ref)[-_ ]?([A-Za-z0-9_-]{1,32})\b"
CITED = ("evidence", "source", "doc", "item", "ref")  # one of which a citation holds
STARTERS = "The This That These Those There Here It They You Your We Our If When While Since Because However Therefore Given Based Prioritize Recommend Consider Note First Second Third Finally Both All".split()

# Where a JSON value is looked for in an answer.
_FENCED = re.compile(r"```(?:json)?\s*(\{.*?\}|\[.*?\])\s*```", re.S)
_BARE = re.compile(r"(\{.*\}|\[.*\])", re.S)


def _json_of(text: str) -> str | None:
    for found in (_FENCED.search(text), _BARE.search(text)):
        if found:
            try:
                return json.dumps(json.loads(found[1]), ensure_ascii=False)
            except ValueError:
                pass
    try:
        return json.dumps(json.loads(text.strip()), ensure_ascii=False)
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def _strict_json(text: pd.Series) -> pd.Series:
    return text.map(_json_of, na_action="ignore")


def extract_json(text: Column) -> Column:
    """Canonical text of the first JSON value in a text that parses: a fenced block, else the widest braces or brackets, else the whole. Strict parsing is not what
    Spark's lenient JSON functions do, so an Arrow UDF does it, on texts that have a bracket, digit, quote or literal at all."""
    may = text.rlike(r"[{\[\d\"]|true|false|null|NaN|Infinity")
    return _strict_json(F.when(may, text))


def is_json_object(parsed: Column) -> Column:
    return F.coalesce(parsed.startswith("{"), F.lit(False))


def _string_array(value: Column) -> Column:
    """An array of strings from JSON text, null unless it is a list of nothing but strings."""
    items = F.from_json(value, "array<string>")
    kinds = F.schema_of_variant(F.try_parse_json(value))
    return F.when(kinds.isin("ARRAY<STRING>", "ARRAY<VOID>") & (items.isNotNull()), items)


def _at(parsed: Column, key: str) -> Column:
    return F.get_json_object(parsed, f"$.{key}")


def _kind(parsed: Column, key: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(parsed), f"$.{key}", "variant"))


def _word(name: Column) -> Column:
    return F.concat(F.lit(r"(?iU)(?<!\w)\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)"))


def first_named(line: Column, candidates: Column) -> Column:
    """The candidate that a line names first; of those at one place the longer."""
    hits = F.filter(F.transform(candidates, lambda c: F.struct(F.regexp_instr(line, _word(c)).alias("at"), (-F.length(c)).alias("n"), c.alias("c"))), lambda h: h["at"] > 0)
    return F.array_min(hits)["c"]


def extract_ranking(text: Column, parsed: Column, candidates: Column) -> Column:
    """An order of items: a JSON list of strings (itself or under RANKING_KEYS), else two or more listed lines (each as the candidate it names, if one), else candidates in the order
    of their first mention, else empty. parsed: extract_json(text); candidates may be empty."""
    listed = F.transform(F.regexp_extract_all(text, F.lit(LIST_LINE), F.lit(1)), lambda x: F.coalesce(first_named(x, candidates), x))
    mentioned = F.array_sort(F.filter(F.transform(candidates, lambda c: F.struct(F.regexp_instr(text, _word(c)).alias("at"), c.alias("c"))), lambda h: h["at"] > 0))
    by_key = [F.when(is_json_object(parsed), _string_array(_at(parsed, k))) for k in RANKING_KEYS]
    return F.coalesce(F.when(parsed.startswith("["), _string_array(parsed)), *by_key, F.when(F.size(listed) >= 2, listed), F.transform(mentioned, lambda h: h["c"]), F.array().cast("array<string>"))


def extract_label(text: Column, parsed: Column, allowed: Column) -> Column:
    """A label: a JSON scalar under LABEL_KEYS, else the allowed label found first in the normalised text, else the first line."""
    by_key = [F.when(is_json_object(parsed) & _kind(parsed, k).rlike("^(STRING|BIGINT|DOUBLE|DECIMAL.*|BOOLEAN)$"), _at(parsed, k)) for k in LABEL_KEYS]
    hits = let(normalize_answer(text, exact=False), lambda n: F.filter(F.transform(allowed, lambda a: F.struct(F.instr(n, normalize_answer(a, exact=False)).alias("at"), a.alias("a"))), lambda h: h["at"] > 0))
    trimmed = F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")
    return F.coalesce(*by_key, F.array_min(hits)["a"], F.regexp_replace(F.split_part(trimmed, F.lit("\n"), F.lit(1)), r"(?U)\A\s+|\s+\z", ""))


def extract_factor(text: Column, parsed: Column, allowed: Column) -> Column:
    """What an answer says decided it: a JSON string under FACTOR_KEYS, else the phrase DECIDED_BY, else the allowed factor mentioned first (with spaces or underscores), else empty."""
    by_key = [F.when(is_json_object(parsed) & (_kind(parsed, k) == "STRING"), F.nullif(F.trim(_at(parsed, k)), F.lit(""))) for k in FACTOR_KEYS]
    phrase = F.lower(F.replace(F.rtrim(F.trim(F.regexp_extract(text, DECIDED_BY, 1)), F.lit(".")), F.lit(" "), F.lit("_")))
    low = F.lower(text)
    places = F.flatten(F.transform(allowed, lambda a: F.array(F.struct(F.instr(low, F.replace(F.lower(a), F.lit("_"), F.lit(" "))).alias("at"), a.alias("a")), F.struct(F.instr(low, F.lower(a)).alias("at"), a.alias("a")))))
    return F.coalesce(*by_key, F.when(text.rlike(DECIDED_BY), phrase), F.array_min(F.filter(places, lambda h: h["at"] > 0))["a"], F.lit(""))


def extract_confidence(text: Column, parsed: Column) -> Column:
    """Struct of confident and method: an explicit JSON boolean under CONFIDENCE_KEYS, else whether the text holds none of the ABSTENTION phrases."""
    explicit = F.coalesce(*[F.when(is_json_object(parsed) & (_kind(parsed, k) == "BOOLEAN"), _at(parsed, k) == "true") for k in CONFIDENCE_KEYS])
    held = ~text.rlike("(?iU)" + "|".join(ABSTENTION))
    return F.struct(F.coalesce(explicit, held).alias("confident"), F.when(explicit.isNotNull(), "explicit").otherwise("heuristic").alias("method"))


def extract_claims(text: Column) -> Column:
    """Distinct sorted numbers, dates, amounts and proper nouns (single words that merely start a sentence left out)."""
    every = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
    names = F.filter(every(PROPER_NOUN), lambda x: ~x.isin(*STARTERS))
    # what a pattern cannot do without is looked for first
    some = lambda p, held: F.when(~held, F.array().cast("array<string>")).otherwise(every(p))
    signs = text.contains("$") | text.contains("€") | text.contains("£")
    return F.array_sort(F.array_distinct(F.concat(some(NUMBER, text.rlike("[0-9]")), some(DATE, text.rlike(r"[A-Za-z]\s+[0-9]")), some(CURRENCY, signs), names)))


def extract_citations(text: Column) -> Column:
    held = let(F.lower(text), lambda low: reduce(lambda a, b: a | b, [low.contains(w) for w in CITED]))
    return F.array_sort(F.array_distinct(F.when(~held, F.array().cast("array<string>")).otherwise(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1)))))


def faithfulness(response: Column, context: Column, provided: Column, decisive: Column) -> Column:
    """Struct of evidence_coverage, citation_precision, unsupported_claim_rate and score: shares of decisive ids named, of citations that were provided, and of claims that the
    context does not hold; 1, 1 and 0 where there is nothing to judge."""
    norm = lambda x: normalize_answer(x, exact=False)
    share = lambda part, whole, empty: F.when(whole == 0, F.lit(empty)).otherwise(part / F.greatest(whole, F.lit(1)))

    def judge(s: Column) -> Column:
        used = F.size(F.filter(decisive, lambda e: F.instr(s["r"], norm(e)) > 0))
        given = F.transform(provided, norm)
        sound = F.size(F.filter(s["cited"], lambda c: F.array_contains(given, norm(c))))
        lost = F.size(F.filter(s["claims"], lambda c: F.instr(s["c"], norm(c)) == 0))
        precision = F.when(F.size(provided) == 0, F.lit(1.0)).otherwise(share(sound, F.size(s["cited"]), 1.0))
        return F.struct(share(used, F.size(decisive), 1.0).alias("evidence_coverage"), precision.alias("citation_precision"), share(lost, F.size(s["claims"]), 0.0).alias("unsupported_claim_rate"), (F.size(s["cited"]) - sound).alias("fabricated"))

    parts = F.struct(F.when(F.size(decisive) > 0, norm(response)).alias("r"), norm(context).alias("c"), extract_citations(response).alias("cited"), extract_claims(response).alias("claims"))
    return let(let(parts, judge), lambda j: j.withField("score", (j["evidence_coverage"] + j["citation_precision"] + (1.0 - j["unsupported_claim_rate"])) / 3.0))
