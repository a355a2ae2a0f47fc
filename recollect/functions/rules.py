"""Predicates over queries and answers: routing, refusals, leaked calls, template errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import est_tokens, is_blank, trimmed

# Patterns and markers.
GLOBAL_PATTERNS = "how many|how much|every|all of|list all|count|total|sum of|summarize|overall|across all|each "
REFUSALS = [
    "do not specify", "does not specify", "not specified", "cannot answer", "can't answer",
    "unable to answer", "not mentioned", "no information", "does not contain", "do not contain",
    "not contain", "not available", "isn't specified", "is not specified",
    "not enough information", "insufficient information", "cannot determine", "can't determine",
    "unable to determine", "not provided", "does not indicate", "not indicated",
    "information required to answer", "cannot be determined", "not possible to determine",
]
CALL_MARKS = ["<tool_call", "</tool_call", "<function=", "<function_call", "<|tool_call", "<tool▁call", "[tool_call]"]
TEMPLATE_MARKS = ["system message must be at the beginning", "must alternate", "template", "raise_exception", "jinja"]
EXHAUSTIVE_WORDS, TARGETED_WORDS = ["exhaustive", "global", "aggregat"], ["targeted", "lookup", "needle"]


def has_any(text: Column, marks: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(m)) for m in marks))


def keyword_route(query: Column, patterns: str = GLOBAL_PATTERNS) -> Column:
    marks = [p.strip().lower() for p in patterns.split("|") if p.strip()]
    return F.when(has_any(F.lower(query), marks) if marks else F.lit(False), "exhaustive").otherwise("targeted")


def verdict(reply: Column) -> Column:
    """Null if the reply names neither route; exhaustive wins a tie."""
    low = F.lower(reply)
    return F.when(has_any(low, EXHAUSTIVE_WORDS), "exhaustive").when(has_any(low, TARGETED_WORDS), "targeted")


def route(query: Column, override: Column, mode: Column, reply: Column, patterns: str = GLOBAL_PATTERNS) -> Column:
    """An override first, then the verdict if the mode asks a classifier, then the keywords."""
    told = F.lower(trimmed(override))
    forced = F.when(told.isin("exhaustive", "targeted"), told)
    asked = F.when(F.lower(trimmed(mode)) == "classifier", verdict(reply))
    return F.coalesce(forced, asked, keyword_route(query, patterns))


def is_blind(query: Column) -> Column:
    return ~is_blank(query) & ~query.rlike("[A-Za-z]")


def strategy(mode: Column, has_tools: Column, has_calls: Column, has_results: Column) -> Column:
    """A forced mode, or else compaction where the request or its messages have to do with tools."""
    told = F.lower(trimmed(mode))
    return F.when(told.isin("compaction", "extraction"), told).when(has_tools | has_calls | has_results, "compaction").otherwise("extraction")


def named(value: Column, names: list[str], otherwise: str | None) -> Column:
    """The name among these that the value is, in any case and with white space around it; or else the default."""
    told = F.lower(trimmed(value))
    return F.when(told.isin(names), told).otherwise(F.lit(otherwise))


def repair(value: Column) -> Column:
    """How messages are to be repaired; what is not known is tried as it is."""
    return named(value, ["off", "convert", "hoist", "merge-user0"], "verbatim")


def trace_level(value: Column) -> Column:
    told = F.lower(trimmed(value))
    return F.when(told.isin("full", "verbose"), "full").when(told.isin("summary", "on", "1", "true", "yes"), "summary").otherwise("off")


def offers_tools(turn: Column, turns: int, must_answer: bool) -> Column:
    """Whether tools are offered in this turn, from 0; not in the last one if that must answer."""
    return ~((turn + 1 >= max(1, turns)) & F.lit(must_answer))


def notes_too_long(notes: Column, n_ctx: int, max_tokens: int) -> Column:
    return est_tokens(notes) > max(512, n_ctx - max_tokens)


def looks_incomplete(answer: Column) -> Column:
    a = F.lower(trimmed(answer))
    return (F.octet_length(a) < 2) | has_any(a, REFUSALS)


def looks_like_call(answer: Column) -> Column:
    return has_any(F.lower(trimmed(answer)), CALL_MARKS)


def decision(answer: Column, escalate: Column) -> Column:
    leaked = looks_like_call(answer)
    return F.when((leaked | looks_incomplete(answer)) & escalate, "escalate").when(leaked, "no_fallback").otherwise("answer")


def is_template_error(status: Column, body: Column) -> Column:
    return (status == 400) & has_any(F.lower(body), TEMPLATE_MARKS)
