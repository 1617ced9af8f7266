"""Column functions over message arrays: array<struct<role, content, name, reasoning>>."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_reasoning

# Fixed values.
ROLES = ("system", "user", "assistant", "tool")
ID_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9._:-]{2,127}$"


def _first_assistant(messages: Column) -> Column:
    """Place (from 1) of the first assistant turn, 0 if there is none."""
    return F.array_position(F.transform(messages, lambda m: m["role"]), "assistant")


def conversation_text(messages: Column, assistant: bool = True, reasoning: bool = True) -> Column:
    """Lines of `role: content`, with the reasoning of a turn on a line of its own; without assistant turns if asked."""
    lines = F.transform(
        messages if assistant else F.filter(messages, lambda m: m["role"] != "assistant"),
        lambda m: F.concat(m["role"], F.lit(": "), m["content"], F.coalesce(F.concat(F.lit("\n"), m["role"], F.lit(" reasoning: "), m["reasoning"]), F.lit("")) if reasoning else F.lit("")),
    )
    return F.array_join(lines, "\n")


def content_hash(messages: Column, assistant: bool = True) -> Column:
    return F.sha2(conversation_text(messages, assistant), 256)


def system_prompt(messages: Column) -> Column:
    first = F.get(messages, F.lit(0))
    return F.when(first["role"] == "system", first["content"])


def assistant_targets(messages: Column) -> Column:
    return F.transform(F.filter(messages, lambda m: m["role"] == "assistant"), lambda m: m["content"])


def prompt_messages(messages: Column) -> Column:
    """Turns before the first assistant turn."""
    at = _first_assistant(messages)
    return F.when(at == 0, messages).otherwise(F.slice(messages, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")))


def without_reasoning(messages: Column) -> Column:
    """Assistant turns without <think> spans and reasoning."""
    return F.transform(messages, lambda m: F.when(m["role"] == "assistant", m.withField("content", strip_reasoning(m["content"])).withField("reasoning", F.lit(None).cast("string"))).otherwise(m))


def shape_errors(messages: Column) -> Column:
    """Codes of what is wrong with a training conversation: too few turns, no assistant turn, another role last, a system turn that is not first, no user turn before the first
    assistant, two assistant turns in a row, empty content, a tool turn without a name, an unknown role, reasoning outside assistant turns or blank."""
    roles = F.transform(messages, lambda m: m["role"])
    first = F.array_position(roles, "assistant")
    twice = F.exists(F.zip_with(roles, F.slice(roles, 2, F.greatest(F.size(roles), F.lit(1))), lambda a, b: (a == "assistant") & (b == "assistant")), lambda x: F.coalesce(x, F.lit(False)))
    rules = {
        "too_few_messages": F.size(messages) < 2,
        "no_assistant": first == 0,
        "last_not_assistant": (first > 0) & (F.element_at(roles, -1) != "assistant"),
        "system_not_first": F.array_contains(F.slice(roles, 2, F.greatest(F.size(roles), F.lit(1))), "system"),
        "no_user_before_assistant": (first > 0) & ~F.array_contains(F.slice(roles, F.lit(1), F.greatest(first - 1, F.lit(0)).cast("int")), "user"),
        "consecutive_assistants": twice,
        "empty_content": F.exists(messages, lambda m: F.coalesce(m["content"].rlike(r"(?U)\A\s*\z"), F.lit(True))),
        "unnamed_tool": F.exists(messages, lambda m: (m["role"] == "tool") & F.coalesce(m["name"] == "", F.lit(True))),
        "unknown_role": F.exists(messages, lambda m: ~F.coalesce(m["role"].isin(*ROLES), F.lit(False))),
        "reasoning_not_on_assistant": F.exists(messages, lambda m: (m["role"] != "assistant") & m["reasoning"].isNotNull()),
        "blank_reasoning": F.exists(messages, lambda m: F.coalesce(m["reasoning"].rlike(r"(?U)\A\s*\z"), F.lit(False))),
    }
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in rules.items()]), lambda x: x.isNotNull())


def group_key(explicit: Column | None, group_id: Column, family: Column, row_id: Column) -> Column:
    """The group that a row is split by: empty strings count as missing."""
    parts = [group_id, family, row_id] if explicit is None else [explicit, group_id, family, row_id]
    return F.coalesce(*[F.nullif(p.cast("string"), F.lit("")) for p in parts])


def holdout_value(value: Column) -> Column:
    return F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit("<unspecified>"))


def build_prompt(messages: Column, system: Column, compose: bool = False) -> Column:
    """Messages with a system turn: added if there is none; an existing one is kept, or (compose) put after the given text."""
    has = F.get(messages, F.lit(0))["role"] == "system"
    turn = lambda text: F.array(F.struct(F.lit("system").alias("role"), text.alias("content"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("reasoning")))
    joined = F.concat(turn(F.concat(system, F.lit("\n\n"), F.get(messages, F.lit(0))["content"])), F.slice(messages, 2, F.greatest(F.size(messages), F.lit(1)))) if compose else messages
    return F.when(has, joined).otherwise(F.concat(turn(system), messages))


def fold_system(messages: Column) -> Column:
    """The leading system turn folded into the first user turn, for templates that have no system role."""
    system = system_prompt(messages)
    rest = F.slice(messages, 2, F.greatest(F.size(messages), F.lit(1)))
    at = F.array_position(F.transform(rest, lambda m: m["role"]), "user")
    folded = F.transform(rest, lambda m, i: F.when(i + 1 == at, m.withField("content", F.concat(system, F.lit("\n\n"), m["content"]))).otherwise(m))
    return F.when(system.isNull(), messages).otherwise(folded)


def label_mask(ids: Column, spans: Column) -> Column:
    """ids where a span (struct of start and end, end excluded) covers them, else -100."""
    return F.transform(ids, lambda t, i: F.when(F.exists(spans, lambda s: (s["start"] <= i) & (i < s["end"])), t).otherwise(F.lit(-100)))


def split_thinking(ids: Column, begin: int, end: int) -> Column:
    """Struct of trace (null without markers), answer and closed, of token ids with a thinking span."""
    a, b = F.array_position(ids, begin).cast("int"), F.array_position(ids, end).cast("int")
    trace = F.when(b > 0, F.slice(ids, a + 1, F.greatest(b - a - 1, F.lit(0)))).when(a > 0, F.slice(ids, a + 1, F.size(ids)))
    answer = F.when(b > 0, F.slice(ids, b + 1, F.size(ids))).when(a > 0, F.array().cast("array<int>")).otherwise(ids)
    return F.struct(trace.alias("trace"), answer.alias("answer"), ((a == 0) | (b > 0)).alias("closed"))


def known_axes(axes: Column, registered: Sequence[str]) -> Column:
    """Entries of a map of axes that have a value and a registered name."""
    return F.map_filter(axes, lambda k, v: v.isNotNull() & k.isin(*registered))


def unknown_axes(axes: Column, registered: Sequence[str]) -> Column:
    """Entries that have a value and another name."""
    return F.map_filter(axes, lambda k, v: v.isNotNull() & ~k.isin(*registered))
