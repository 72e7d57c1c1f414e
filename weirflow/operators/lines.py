"""Scans over lines of text: credentials, directives, snippets, templates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: (rule, severity, expression) in the syntax that Java, RE2 and Python share.
SECRETS = [
    ("secret-aws-access-key", "critical", r"\bAKIA[0-9A-Z]{16}\b"),
    ("secret-private-key", "critical", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("secret-jwt", "high", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    ("secret-db-connection", "high", r"\b(?:postgres|postgresql|mysql|mongodb|redis)://[^\s:/@]+:[^\s:/@]+@[^\s/]+"),
    ("secret-token", "high", r"""(?i)\b(?:token|api_key|apikey|secret|password)\s*[:=]\s*["'][0-9a-zA-Z_-]{16,}["']"""),
]
_EXEMPT = r"(^|/)(node_modules|vendor|testdata|fixtures|i18n|locales)(/|$)|\.(lock|min\.js|map)$|openapi|swagger"


def numbered(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, line, text): lines from 1."""
    return df.select(*keys, F.posexplode(F.split(text, "\n"))).select(*keys, (F.col("pos") + 1).cast("long").alias("line"), F.col("col").alias("text"))


def secrets(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line, rule_id, severity, match): the first match of each rule on a line."""
    lead = F.expr("text").rlike("|".join(f"(?:{x})" for _, _, x in SECRETS if not x.startswith("(?i)")) + "|(?i:token|api_key|apikey|secret|password)")
    hits = F.array(*[F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"), F.regexp_extract("text", x, 0).alias("match")) for r, s, x in SECRETS])
    return lines.where(lead).select(*keys, "line", F.explode(F.filter(hits, lambda h: h["match"] != "")).alias("h")).select(*keys, "line", "h.*")


def matching(texts: DataFrame, keys: list[str], rules: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """(keys, line, rule_id): lines that a rule's expression matches. A text in which none does isn't cut into lines."""
    schema = ", ".join(f"{k} {t}" for k, t in texts.select(*keys).dtypes) + ", line long, rule_id string"
    if not rules:
        return texts.sparkSession.createDataFrame([], schema)
    holds = F.lit(False)
    for _, x in rules:
        holds = holds | F.col(text).rlike(x)
    hits = F.filter(F.array(*[F.when(F.col("text").rlike(x), F.lit(r)) for r, x in rules]), lambda h: h.isNotNull())
    return numbered(texts.where(holds), keys, text).select(*keys, "line", F.explode(hits).alias("rule_id"))


def grep(texts: DataFrame, key: str, text: str, pattern: str, most: int = 50, cap: int = 8000) -> DataFrame:
    """(key, line, hit): the first lines that match, ``most`` of them, and no further one after ``cap`` bytes."""
    hits = numbered(texts.where(F.col(text).rlike(pattern)), [key], text).where(F.col("text").rlike(pattern))
    first = hits.select(key, "line", F.trim(F.col("text"), F.lit(" \t\r")).alias("hit")).orderBy(key, "line").limit(most)
    before = F.sum(F.octet_length("hit")).over(Window.orderBy(key, "line")) - F.octet_length("hit")  # ``most`` rows
    return first.withColumn("_before", before).where(F.col("_before") <= cap).drop("_before")


def raw_outputs(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, callee, expression, line) of what components (``component_sinks``) and ERB templates put into a page raw."""
    names = [f"k{i}" for i in range(len(keys))]
    kinds = dict(texts.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found = [], []
            for r, t in enumerate(b.column("text").to_pylist()):
                own = component_sinks(t or "") + erb_outputs(t or "")
                at += [r] * len(own)
                found += own
            cols = zip(*found) if found else ([], [], [])
            yield pa.record_batch([*(b.column(n).take(pa.array(at, pa.int64())) for n in names), *(pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64())))], [*names, "callee", "expression", "line"])

    given = texts.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(text).alias("text")).where(F.col("text").rlike(r"v-html|:(href|src)\s*=|\{@html|<%=="))
    return given.mapInArrow(run, ", ".join(f"{n} {kinds[k]}" for n, k in zip(names, keys)) + ", callee string, expression string, line long").toDF(*keys, "callee", "expression", "line")


def erb_outputs(text: str) -> list[tuple[str, str, int]]:
    return [("erb_raw", m.group(1).strip(), text.count("\n", 0, m.start()) + 1) for m in re.finditer(r"<%==(.*?)-?%>", text, re.S)]


def exempt(path):
    """Vendored code, fixtures, translations and schemas hold no secrets of one's own."""
    return path.rlike(_EXEMPT)


def snippets(findings: DataFrame, lines: DataFrame, reach: int) -> DataFrame:
    """findings with each line of the file within ``reach``: the range is unrolled to an equi-join."""
    around = findings.withColumn("_line", F.explode(F.sequence(F.col("line") - reach, F.col("line") + reach)))
    text = lines.select(F.col("file").alias("_f"), F.col("line").alias("_l"), F.col("text"))
    return around.join(text, (around["file"] == text["_f"]) & (around["_line"] == text["_l"])).drop("_f", "_l")


DIRECTIVE = r"""\b(href|src|action)\s*=\s*"([^"]*)\""""


def page_directives(pages: DataFrame, keys: list[str], html: str) -> DataFrame:
    """(keys, ord, attr, value) of every linking attribute of a page."""
    found = F.regexp_extract_all(F.col(html), F.lit(DIRECTIVE), F.lit(0))
    x = pages.select(*keys, F.posexplode(found))
    return x.select(*keys, F.col("pos").cast("long").alias("ord"), F.regexp_extract("col", DIRECTIVE, 1).alias("attr"), F.regexp_extract("col", DIRECTIVE, 2).alias("value"))


def blanked(text: str) -> str:
    """As long as before, with nothing but line ends."""
    return re.sub(r"[^\n]", " ", text)


def script_blocks(html: str) -> str:
    """A single-file component with everything but its scripts blanked, each at its own place."""
    out, at = [], 0
    for m in re.finditer(r"<script\b[^>]*>(.*?)</script\s*>", html, re.S | re.I):
        out += [blanked(html[at : m.start(1)]), m.group(1)]
        at = m.end(1)
    return "".join([*out, blanked(html[at:])])


def component_sinks(html: str) -> list[tuple[str, str, int]]:
    """(sink, expression, line) of the directives that put a value into a page raw."""
    found = []
    for kind, x in (("vue_html", r'\bv-html\s*=\s*"([^"]*)"'), ("vue_url", r'(?:\bv-bind)?:(?:href|src)\s*=\s*"([^"]*)"'), ("svelte_html", r"\{@html\s+([^}]*)\}")):
        found += [(kind, m.group(1).strip(), html.count("\n", 0, m.start()) + 1) for m in re.finditer(x, html)]
    return sorted(found, key=lambda f: (f[2], f[0]))


def erb_ruby(text: str) -> str:
    """An ERB template as Ruby of the same length: markup blanked, <%== x %> as a raw(...) call where there is room."""
    out, at = [], 0
    for m in re.finditer(r"<%(==|=|-|#)?(.*?)-?%>", text, re.S):
        out.append(blanked(text[at : m.start()]))
        kind, body = m.group(1), m.group(2)
        if kind == "#":
            out.append(blanked(m.group()))
        else:
            code = f"raw({body.strip()})" if kind == "==" else body.strip("\t ")
            pad = len(m.group()) - len(code)
            out.append(code + " " * (pad - 1) + ";" if pad > 0 else code[: len(m.group())])
        at = m.end()
    return "".join([*out, blanked(text[at:])])
