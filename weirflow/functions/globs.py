"""Canonical-name globs: ``*`` is the only sign with a meaning and spans anything;
a pattern matches the whole name."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def shape(pattern: str) -> tuple[str, list[str]]:
    """(shape, literal parts): never, any, exact, prefix, suffix, ends, contains or segments."""
    parts = pattern.split("*")
    if len(parts) == 1:
        return ("exact" if pattern else "never"), parts
    if not any(parts):
        return "any", []
    first, *mid, last = parts
    mid = [m for m in mid if m]
    if not mid:
        return ("ends" if first and last else "prefix" if first else "suffix"), parts
    if len(mid) == 1 and not first and not last:
        return "contains", mid
    return "segments", parts


def regex(pattern: str) -> str:
    """The same language as an anchored regular expression for Java, RE2 and Python."""
    body = ".*".join(re.sub(r"([^0-9A-Za-z_ /:\u0080-\U0010ffff])", r"\\\1", p) for p in re.split(r"\*+", pattern))
    return f"(?s)^{body}$"


def matches(name: str, pattern: str) -> bool:
    kind, parts = shape(pattern)
    if kind == "never":
        return name == ""
    if kind == "any":
        return True
    if kind == "exact":
        return name == pattern
    if kind == "prefix":
        return name.startswith(parts[0])
    if kind == "suffix":
        return name.endswith(parts[-1])
    if kind == "ends":
        return len(name) >= len(parts[0]) + len(parts[-1]) and name.startswith(parts[0]) and name.endswith(parts[-1])
    if kind == "contains":
        return parts[0] in name
    return re.fullmatch(regex(pattern).removeprefix("(?s)^").removesuffix("$"), name, re.S) is not None


def predicate(name: Column, pattern: str) -> Column:
    """The cheapest test that Spark has for the pattern's shape."""
    kind, parts = shape(pattern)
    if kind == "never":
        return name == ""
    if kind == "any":
        return name.isNotNull()
    if kind == "exact":
        return name == pattern
    if kind == "prefix":
        return name.startswith(parts[0])
    if kind == "suffix":
        return name.endswith(parts[-1])
    if kind == "ends":
        return name.startswith(parts[0]) & name.endswith(parts[-1]) & (F.length(name) >= len(parts[0]) + len(parts[-1]))
    if kind == "contains":
        return name.contains(parts[0])
    return name.rlike(regex(pattern))


def any_of(name: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (predicate(name, p) for p in patterns), F.lit(False))
