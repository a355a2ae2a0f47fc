"""Message contents in JSON, and tool calls that a model wrote as text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What stands for an image, and the tags around a call.
IMAGE = "[image omitted: text-only core]"
OPEN, CLOSE = "<tool_call>", "</tool_call>"


def flatten(content: Column) -> Column:
    """The text of a content in JSON: a string itself, the parts of a list by lines, anything else nothing."""
    parsed = F.try_parse_json(content)
    kind = F.schema_of_variant(parsed)
    parts = F.try_variant_get(parsed, "$", "array<variant>")
    texts = F.transform(parts, lambda p: F.when(F.try_variant_get(p, "$.type", "string") == "image_url", F.lit(IMAGE)).otherwise(F.when(F.schema_of_variant(F.try_variant_get(p, "$.text", "variant")) == "STRING", F.try_variant_get(p, "$.text", "string")).otherwise("")))
    return F.when(kind == "STRING", F.try_variant_get(parsed, "$", "string")).when(kind.startswith("ARRAY"), F.array_join(F.transform(texts, lambda t: F.coalesce(t, F.lit(""))), "\n")).otherwise("")


def _call(text: str, known: frozenset[str]) -> tuple[str, str] | None:
    """Name and arguments (as JSON) if the text is a JSON object that calls a known tool."""
    try:
        told = json.loads(text)
    except ValueError:
        return None
    if not isinstance(told, dict):
        return None
    inner = told.get("function", told)
    name = inner.get("name") if isinstance(inner, dict) else None
    if not isinstance(name, str) or name.lower() not in known:
        return None
    given = inner["arguments"] if "arguments" in inner else inner.get("parameters")
    if isinstance(given, str):  # encoded twice
        try:
            given = json.loads(given)
        except ValueError:
            pass
    return name, json.dumps(given, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


TAGGED = re.compile(f"(?is){re.escape(OPEN)}(.*?){re.escape(CLOSE)}")
FENCED = re.compile(r"(?s)```(?:[^\n]*\n)?(.*?)```")
STRINGS = re.compile(r'"(?:[^"\\]|\\.)*"?|[{}]', re.DOTALL)


def _objects(text: str) -> Iterator[str]:
    """For each opening brace, what lies up to its closing one; braces in strings do not count."""
    at = text.find("{")
    while at >= 0:
        depth = 0
        for m in STRINGS.finditer(text, at):
            depth += {"{": 1, "}": -1}.get(m[0], 0)
            if depth == 0:
                yield text[at : m.end()]
                break
        at = text.find("{", at + 1)


def calls_in(text: str | None, known: frozenset[str]) -> list[tuple[str, str]]:
    """Calls between tags, or else in fences, or else the first bare object that is one."""
    if not text:
        return []
    for pattern in (TAGGED, FENCED):
        found = [c for m in pattern.finditer(text) if (c := _call(m[1].strip(), known))]
        if found:
            return found
    return next(([c] for o in _objects(text) if (c := _call(o, known))), [])


def text_calls(text: Column, known: list[str]) -> Column:
    """Array of (name, arguments as JSON with keys in order) of the known tools that a text calls. A parser, hence Arrow."""
    names = frozenset(k.lower() for k in known)

    @F.pandas_udf("array<struct<name: string, arguments: string>>")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"name": n, "arguments": a} for n, a in calls_in(t, names)])

    return find(text)
