"""Column functions over replies of a service: status of an error, of an HTTP code, of a reply's shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Statuses of a reply, what a title or message of an error says, and what an HTTP code means.
STATUSES = ("ready", "starting", "queue_unavailable", "quota_exhausted", "model_error", "invalid_request", "unauthorized", "disabled")
QUEUE_TITLES = ("zerogpu queue timeout", "zerogpu pending credits exceeded")
QUEUE_PHRASES = ("too many zerogpu credits", "no gpu was available", "expired zerogpu proxy token", "zerogpu api /schedule error", "queue is full")
QUOTA_TITLES = ("zerogpu quota exceeded",)
QUOTA_PHRASES = ("exceeded your", "reached its gpu limit", "zerogpu runs limit")
HTTP_STATUS = {401: "unauthorized", 413: "invalid_request", 422: "invalid_request", 500: "model_error", 503: "starting", 504: "queue_unavailable"}
VERSIONS = (1, 2)
ROLES = ("system", "user", "assistant")


def error_status(title: Column, message: Column) -> Column:
    """What an error of the scheduler means; what says queue wins over what says quota."""
    t, m = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (title, message))
    says = lambda titles, phrases: t.isin(*titles) | reduce(Column.__or__, [F.contains(m, F.lit(p)) for p in phrases])
    return F.when(says(QUEUE_TITLES, QUEUE_PHRASES), "queue_unavailable").when(says(QUOTA_TITLES, QUOTA_PHRASES), "quota_exhausted").otherwise("model_error")


def http_status(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in HTTP_STATUS.items() for x in pair])
    return F.when(code.between(200, 299), "ready").otherwise(F.coalesce(known[code], F.lit("model_error")))


def finish_reason(completion_tokens: Column, most: Column, reason: Column) -> Column:
    """length if the answer was cut off, else stop."""
    return F.when((completion_tokens >= most) | F.coalesce(reason == "length", F.lit(False)), "length").otherwise("stop")


def keeps_contract(reply: Column, answer: bool = True) -> Column:
    """Whether a reply (struct of contract_version, status, ok, text) has a known version and status, is ok exactly if it is ready, and brings a text if it is an answer."""
    shape = reply["contract_version"].isin(*VERSIONS) & reply["status"].isin(*STATUSES) & (reply["ok"] == (reply["status"] == "ready"))
    whole = ~reply["ok"] | reply["text"].isNotNull() if answer else F.lit(True)
    return F.coalesce(shape & whole, F.lit(False))


def api_messages(messages: Column) -> Column:
    """Messages as role and content, null if any has another role or a name."""
    fit = F.forall(messages, lambda m: m["role"].isin(*ROLES) & (F.coalesce(m["name"], F.lit("")) == ""))
    return F.when(fit, F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))))
