"""Scalar functions of the analysis as columns."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEVERITIES = ("info", "low", "medium", "high", "critical")
CONFIDENCES = ("low", "medium", "high")
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#\\]+[/?#\\]"
DYN = "<DYN>"


def _rank(c: Column, names: tuple[str, ...]) -> Column:
    low = F.lower(c)
    return F.coalesce(*[F.when(low == n, i + 1) for i, n in enumerate(names)], F.lit(0))


def severity_rank(c: Column) -> Column:
    return _rank(c, SEVERITIES)


def confidence_rank(c: Column) -> Column:
    return _rank(c, CONFIDENCES)


def fingerprint(*parts: Column) -> Column:
    """16 hex digits of a SHA-256 over the parts; lines are no part, so moved code keeps its print."""
    return F.substring(F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16)


def position(file: Column, line: Column, col: Column) -> Column:
    known = file.isNotNull() & line.isNotNull() & col.isNotNull()
    return F.when(known, F.concat_ws(":", file, line.cast("string"), col.cast("string"))).otherwise("<unknown>")


def verdict(reply: str) -> str | None:
    """What a reviewer's reply says: the ``verdict`` of the outermost JSON object in it, or None."""
    start, end = reply.find("{"), reply.rfind("}")
    try:
        said = json.loads(reply[start : end + 1]) if 0 <= start < end else None
    except ValueError:
        return None
    return str(said.get("verdict", "")) if isinstance(said, dict) else None


def false_positive(reply: Column) -> Column:
    """The same for a column: whether a reply drops its finding. Only the exact word does."""
    body = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    said = F.lower(F.trim(F.get_json_object(body, "$.verdict")))
    return F.coalesce(said.isin("false_positive", "false-positive"), F.lit(False))


def plain_name(path: Column) -> Column:
    """A path without its groups in angle brackets, however deep, and without the separators that they leave."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(a: Column, c: Column) -> Column:
        depth = F.when(c == "<", a["depth"] + 1).when(c == ">", F.greatest(a["depth"] - 1, F.lit(0))).otherwise(a["depth"])
        keep = (a["depth"] == 0) & (c != "<") & (c != ">")
        return F.struct(depth.alias("depth"), F.when(keep, F.concat(a["out"], c)).otherwise(a["out"]).alias("out"))

    nested = F.aggregate(F.split(path, ""), start, step, lambda a: a["out"])
    bare = F.when(path.rlike("[<>]"), nested).otherwise(path)
    return F.regexp_replace(F.trim(F.regexp_replace(bare, ":{2,}", "::")), "^:+|:+$", "")


def line_and_column(text: Column, offset: Column) -> tuple[Column, Column]:
    """Line and column, both from 1, of a byte of a text, counted from 0. A line ends with CR, LF or both."""
    raw = F.encode(text, "UTF-8")
    # between CR and LF a line hasn't ended yet
    torn = (F.hex(F.substring(raw, offset, F.lit(2))) == "0D0A") & (offset > 0)
    before = F.decode(F.substring(raw, F.lit(1), offset - F.when(torn, 1).otherwise(0)), "ISO-8859-1")  # a character for each byte
    ends = F.size(F.regexp_extract_all(before, F.lit("\r\n|\r|\n"), F.lit(0)))
    return (ends + 1).cast("long"), (offset - F.length(F.regexp_extract(before, "(?s)^(.*[\r\n])", 1)) + 1).cast("long")


def descriptor_params(descriptor: Column) -> Column:
    """Parameter types of a JVM method descriptor, as written."""
    body = F.regexp_extract(F.regexp_extract(descriptor, r"\(([^)]*)\)", 1), r"^((?:\[*(?:L[^;]*;|[^L\[]))*)", 1)  # as far as it is well formed
    return F.regexp_extract_all(body, F.lit(r"\[*(?:L[^;]*;|[^L\[])"), F.lit(0))


def slot_width(param: Column) -> Column:
    """Local variables that a parameter takes: long and double take two."""
    return F.when(param.isin("J", "D"), 2).otherwise(1)


def humanised(n: Column) -> Column:
    """Bytes for a reader, cut to one decimal."""
    c = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        c = F.when(n >= 1 << 10 * k, F.concat(F.format_string("%.1f", F.floor(n * 10 / (1 << 10 * k)) / 10), F.lit(f" {unit}"))).otherwise(c)
    return c


def first_sentence(text: Column) -> Column:
    """Up to the first full stop that ends a sentence."""
    end = r"(?s)^(.*?[.!?])(?:\s|\z)"
    return F.when(text.rlike(end), F.regexp_extract(text, end, 1)).otherwise(text)


def rust_format(token: str) -> str | None:
    """The text of a compiled format template, {} for each argument: bytes below 0x80 are the length of a literal that
    follows, 0xC0 is an argument, and what follows any other byte is unknown."""
    m = re.fullmatch(r'\s*(?:const\s+)?b"(.*)"[^"]*', token, re.S)
    plain = {"n": b"\n", "t": b"\t", "r": b"\r", "0": b"\0", "\\": b"\\", '"': b'"', "'": b"'"}
    if not m:
        return None
    raw, body, at = bytearray(), m.group(1), 0
    while at < len(body):
        if body[at] != "\\":
            raw += body[at].encode()
            at += 1
        elif re.match(r"x[0-9a-fA-F]{2}", body[at + 1 :]):
            raw.append(int(body[at + 2 : at + 4], 16))
            at += 4
        elif body[at + 1 : at + 2] in plain and at + 1 < len(body):
            raw += plain[body[at + 1]]
            at += 2
        else:
            return None
    out, at = bytearray(), 0
    while at < len(raw):
        b, at = raw[at], at + 1
        if b < 0x80:
            if at + b > len(raw):
                return None
            out += raw[at : at + b]
            at += b
        else:
            out += b"{}"
            at = at if b == 0xC0 else len(raw)
    try:
        return out.decode()
    except UnicodeDecodeError:
        return None


def trailing_name(c: Column) -> Column:
    return F.regexp_extract(c, r"([^.:]*)$", 1)


def owner_class(key: Column) -> Column:
    """The type of a method's key: what stands between its last two separators."""
    return F.regexp_extract(key, r"([^.:/]*)[.:][^.:]*$", 1)


def module_name(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"(?<=[^/])\.[^./]*$", "")


def relative(path: Column, root: str) -> Column:
    """Below the root as a relative path, elsewhere as it is."""
    r = root.rstrip("/") + "/"
    slashed = F.regexp_replace(path, r"\\", "/")
    return F.when(slashed.startswith(r), F.substring(slashed, len(r) + 1, 1 << 20)).otherwise(slashed)


def host_fixed(skeleton: Column) -> Column:
    """Whether scheme and host are literal, so that only what follows them can vary."""
    return F.coalesce(F.substring_index(skeleton, DYN, 1).rlike(_HOST), F.lit(False))


def is_host_fixed(skeleton: str) -> bool:
    return re.match(_HOST, skeleton.split(DYN, 1)[0]) is not None


_TEMPLATE = re.compile(r"%%|%[^A-Za-z]*[A-Za-z]?|\{\{|\}\}|\{[^}]*\}?")


def skeleton(template: str) -> str:
    """A template with each placeholder as <DYN>."""
    return _TEMPLATE.sub(lambda m: {"%%": "%", "{{": "{", "}}": "}"}.get(m.group(), DYN), template)


def template_skeleton(c: Column) -> Column:
    """The same on the JVM side: escapes are set aside first, then placeholders go, then escapes come back."""
    aside = F.regexp_replace(c, r"(%%)|(%[^A-Za-z]*[A-Za-z]?)|(\{\{)|(\}\})|(\{[^}]*\}?)", "\u0001$1\u0002$2\u0003$3\u0004$4\u0005$5\u0006")
    out = F.regexp_replace(aside, "\u0001%%\u0002\u0003\u0004\u0005\u0006", "%")
    out = F.regexp_replace(out, "\u0001\u0002\u0003\\{\\{\u0004\u0005\u0006", "{")
    out = F.regexp_replace(out, "\u0001\u0002\u0003\u0004\\}\\}\u0005\u0006", "}")
    return F.regexp_replace(out, "\u0001\u0002[^\u0003]*\u0003\u0004\u0005[^\u0006]*\u0006", DYN)


def sarif_level(severity: Column) -> Column:
    r = severity_rank(severity)
    return F.when(r >= 4, "error").when(r == 3, "warning").when(r >= 1, "note").otherwise("none")


def sarif_score(severity: Column) -> Column:
    r = severity_rank(severity)
    return F.when(r == 0, F.lit("0.0")).otherwise(F.format_string("%d.0", 2 * r - 1))


@F.pandas_udf(T.StringType())
def common_root(paths: pd.Series) -> str:
    """The longest directory that all paths are in."""
    parts = [p.split("/")[:-1] for p in paths.dropna()]
    if not parts:
        return ""
    lo, hi = min(parts), max(parts)
    n = next((i for i, (a, b) in enumerate(zip(lo, hi)) if a != b), min(len(lo), len(hi)))
    return "/".join(lo[:n])
