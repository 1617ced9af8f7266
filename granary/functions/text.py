"""Column functions over texts: normal forms, shingles, ranks, token estimates, pattern scans, small parsers."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names and patterns of content that must not be published.
SENSITIVE = {
    "email_address": r"\b[\w.+-]+@[\w-]+\.[\w.]{2,}\b",
    "us_phone": r"\b(?:\+1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b",
    "bearer_token": r"\bBearer\s+[A-Za-z0-9\-._~+/]{20,}",
    "jwt": r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    "openai_key": r"\bsk-[A-Za-z0-9]{20,}",
    "hf_token": r"\bhf_[A-Za-z0-9]{30,}",
    "aws_access_key": r"\bAKIA[0-9A-Z]{16}\b",
    "supabase_url": r"https://[a-z0-9]{20}\.supabase\.co",
    "private_key_block": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
}
#: What a text has to hold for a pattern to be found in it: looking for a plain string first spares most texts the pattern.
HOLDS = {"email_address": "@", "bearer_token": "Bearer", "jwt": "eyJ", "openai_key": "sk-", "hf_token": "hf_", "aws_access_key": "AKIA", "supabase_url": ".supabase.co", "private_key_block": "PRIVATE KEY-----"}
# Placeholders that must not be in a finished answer.
PLACEHOLDERS = (r"\bTODO\b", r"\bFIXME\b", r"(?i)\blorem ipsum\b", r"(?m)^\s*\.\.\.\s*$")
PLACEHOLDERS_HOLD = {PLACEHOLDERS[0]: "TODO", PLACEHOLDERS[1]: "FIXME", PLACEHOLDERS[3]: "..."}
# Phrases that state a private fact.
FACT_HINTS = (r"\bbecause (?:he|she|they|I) (?:work|works|worked) at\b", r"\byour (?:resume|CV) (?:says|states|lists)\b", r"\bas we discussed (?:last|on) \w+\b")

#: Characters of a shingle.
SHINGLE = 5


def fold(text: str) -> str:
    """Compatibility decomposition without marks, case folded."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()


#: Letters up to U+017F that fold to one other character; the rest of what folds is left to the exact path (but for sharp s).
_FOLDED = {chr(c): fold(chr(c)) for c in range(0x180)}
_SINGLE = {a: b for a, b in _FOLDED.items() if a != b and len(b) == 1}
_HARD = "".join(f"\\x{{{ord(a):x}}}" for a, b in _FOLDED.items() if len(b) != 1 and a != "ß") + r"\x1c-\x1f\x85\x{180}-\x{10ffff}"


@F.pandas_udf(T.StringType())
def _fold_exact(text: pd.Series) -> pd.Series:
    return text.map(fold, na_action="ignore")


def folded(text: Column, exact: bool = True) -> Column:
    """fold() of a text: in the JVM where each character folds by itself, else, if exact, in an Arrow UDF that sees only those texts."""
    simple = F.replace(F.translate(text, "".join(_SINGLE), "".join(_SINGLE.values())), F.lit("ß"), F.lit("ss"))
    if not exact:
        return simple
    hard = text.rlike(f"[{_HARD}]")
    return F.when(hard, _fold_exact(F.when(hard, text))).otherwise(simple)


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def no_punctuation(text: Column) -> Column:
    return squeeze(F.regexp_replace(text, r"(?U)[^\w\s]", " "))


def normalize_text(text: Column, exact: bool = True) -> Column:
    """For duplicate detection: folded, runs of digits as 0, punctuation as space, white space squeezed."""
    return no_punctuation(F.regexp_replace(folded(text, exact), r"(?U)\d+", "0"))


def normalize_answer(text: Column, exact: bool = True) -> Column:
    """For comparing answers: folded, articles removed (unless nothing else is there), punctuation as space, white space squeezed; digits stay."""
    articles = lambda low: no_punctuation(F.regexp_replace(low, r"(?U)\b(?:a|an|the)\b", " "))
    long = _once(folded(text, exact), lambda low: _once(articles(low), lambda bare: F.when(bare == "", no_punctuation(low)).otherwise(bare)))
    # a single plain word, an article too, is only lower-cased
    return F.when(text.rlike(r"\A[A-Za-z0-9_]+\z"), F.lower(text)).otherwise(long)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, also inside of lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingles(normalized: Column, size: int = SHINGLE) -> Column:
    """Distinct character n-grams; a text of up to `size` characters is one by itself, an empty one has none."""

    def cut(c: Column) -> Column:
        many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - (size - 1), F.lit(1))), lambda i: F.array_join(F.slice(c, i, size), "")))
        return F.when(F.size(c) > size, many).when(F.size(c) > 0, F.array(F.array_join(c, ""))).otherwise(F.array().cast("array<string>"))

    characters = F.filter(F.split(normalized, ""), lambda x: x != "")  # by code points; substring() would walk from the start each time
    return F.element_at(F.transform(F.array(characters), cut), 1)


def _distinct_grams(text: str | None, size: int) -> int:
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(codes) <= size:
        return min(len(codes), 1)
    grams = len(codes) - size + 1
    bits = max(1, int(codes.max()).bit_length())
    keys, each = [], 64 // bits
    for a in range(0, size, each):
        key = np.zeros(grams, np.uint64)
        for j in range(a, min(size, a + each)):
            key = (key << np.uint64(bits)) | codes[j : j + grams]
        keys.append(key)
    if len(keys) == 1:
        return len(np.unique(keys[0]))
    order = np.lexsort(keys)
    return 1 + int(np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys]).sum())


def shingle_count(normalized: Column, size: int = SHINGLE) -> Column:
    """How many shingles() a text has (null: none), without making them: code points side by side in 64-bit numbers, as many numbers as it takes, so the count is exact."""

    @F.pandas_udf(T.LongType())
    def count(text: pd.Series) -> pd.Series:
        return pd.Series([_distinct_grams(t, size) for t in text], dtype="int64")

    return count(normalized)


def jaccard(left: Column, right: Column) -> Column:
    """Of two sets; two empty ones are alike, an empty and another one are not."""
    common = F.size(F.array_intersect(left, right))
    both = F.size(left) + F.size(right) - common
    return F.when(both == 0, F.lit(1.0)).otherwise(common / F.greatest(both, F.lit(1)))


def stable_rank(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 64 bits of the SHA-256 of seed:key, the same on every run and engine."""
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 16), 16, 10)
    return head.cast("decimal(20,0)").cast("double") / F.lit(18446744073709551616.0)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda x: x != ""))


def approximate_token_count(text: Column) -> Column:
    return (F.floor(word_count(text) * F.lit(1.3)) + 1).cast("int")


def found(text: Column, pattern: str, holds: str | None = None) -> Column:
    """Whether a pattern is found, by a look for the string that it cannot do without first."""
    return text.rlike(pattern) if holds is None else text.contains(holds) & text.rlike(pattern)


def matching(text: Column, patterns: dict[str, str], holds: Mapping[str, str] = {}) -> Column:
    """Names of the patterns found in a text."""
    return F.filter(F.array(*[F.when(found(text, p, holds.get(n)), F.lit(n)) for n, p in patterns.items()]), lambda x: x.isNotNull())


def sensitive_content(text: Column) -> Column:
    return matching(text, {n: "(?U)" + p for n, p in SENSITIVE.items()}, HOLDS)


def any_of(text: Column, patterns: Sequence[str], flags: str = "", holds: Mapping[str, str] = {}) -> Column:
    return reduce(lambda a, b: a | b, [found(text, flags + p, holds.get(p)) for p in patterns])


def strip_reasoning(text: Column) -> Column:
    """Without <think> spans; what precedes a closing tag that is left goes too."""
    closed = F.regexp_replace(text, r"(?is)<think>.*?</think>\s*", "")
    left = F.when(closed.rlike(r"(?i)</think>"), F.regexp_replace(closed, r"(?is)\A.*?</think>\s*", "")).otherwise(closed)
    return F.regexp_replace(left, r"(?U)\A\s+|\s+\z", "")


def contains_reasoning(text: Column) -> Column:
    return text.rlike(r"(?i)</?think>")


def retry_after(message: Column) -> Column:
    """Seconds of `try again in [N day(s), ]H:MM:SS`, or null."""
    at = r"(?i)try again in (?:(\d+) days?, )?(\d+):(\d{2}):(\d{2})"
    part = lambda i: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(message, at, i), F.lit("")), F.lit("999999999")), F.lit(0)).cast("long")
    return F.when(message.rlike(at), part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4))


def first_difference(left: Column, right: Column) -> Column:
    """Place (from 0) of the first character in which two texts differ, the shorter one's length if it begins the other, null if they are equal."""
    a, b = F.split(left, ""), F.split(right, "")
    n = F.least(F.length(left), F.length(right))
    at = F.array_position(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y), F.lit(False))
    return F.when(left == right, F.lit(None).cast("long")).when(at > 0, at - 1).otherwise(n.cast("long"))


def redact(text: Column) -> Column:
    return F.concat(F.lit("<redacted len="), F.length(text).cast("string"), F.lit(" sha256="), F.substring(F.sha2(text, 256), 1, 12), F.lit(">"))


def masked(match: Column) -> Column:
    return F.concat(F.left(match, F.lit(6)), F.lit("…"))


def git_blob_sha1(content: Column) -> Column:
    """Of binary content: SHA-1 of `blob <bytes>`, a zero byte and the content."""
    head = F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8")
    return F.sha1(F.concat(head, F.unhex(F.lit("00")), content))


def padded_length(length: Column, multiple: int = 8) -> Column:
    return (F.ceil(length / multiple) * multiple).cast("long")
