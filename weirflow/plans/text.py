"""Scans over text: credentials, directives, hosts, templates, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirflow.catalog import query
from weirflow.functions.scalars import common_root, host_fixed, module_name, template_skeleton
from weirflow.operators import lines, triage
from weirflow.session import table

_Q = lambda s: s.replace("'", "''")
_LINES = "lines AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS text FROM documents)"
_SECRETS = "WITH " + _LINES + ", hits AS (" + " UNION ALL ".join(f"SELECT doc_id, line, '{r}' AS rule_id, '{s}' AS severity, regexp_extract(text, '{_Q(x)}', 0) AS match FROM lines WHERE regexp_matches(text, '{_Q(x)}')" for r, s, x in lines.SECRETS) + ")"


def _secrets(spark, sf_dir):
    return lines.secrets(lines.numbered(table(spark, sf_dir, "documents"), ["doc_id"], "text"), ["doc_id"])


@query("secret_lines", _SECRETS + " SELECT doc_id, line, rule_id, severity, match FROM hits")
def secret_lines(spark, sf_dir):
    return _secrets(spark, sf_dir)


@query("secret_dedup", _SECRETS + " SELECT rule_id, match, min(doc_id) AS doc_id, arg_min(line, doc_id * 1000000 + line) AS line, count(*) AS n FROM hits GROUP BY rule_id, match")
def secret_dedup(spark, sf_dir):
    s = _secrets(spark, sf_dir)
    g = s.groupBy("rule_id", "match").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("n"))
    return g.select("rule_id", "match", "first.doc_id", "first.line", "n")


@query(
    "inline_ignore",
    "WITH l AS (SELECT 'c' || conv_id AS file, turn AS line, CASE WHEN turn % 3 = 0 THEN text || ' // weirflow:ignore' WHEN turn % 3 = 1 THEN text || ' # weirflow:ignore[r1, r2]' ELSE text END AS text FROM conversations),"
    " f AS (SELECT 'c' || conv_id AS file, turn AS line, 'r' || (conv_id % 4) AS rule_id FROM conversations),"
    " d AS (SELECT file, line, regexp_extract(text, 'weirflow:ignore\\[([A-Za-z0-9_, -]+)\\]', 1) AS ids FROM l WHERE contains(text, 'weirflow:ignore'))"
    " SELECT f.file, f.line, f.rule_id, count(*) FILTER (d.file IS NOT NULL AND (ids = '' OR list_contains(list_transform(string_split(ids, ','), lambda x: trim(x)), f.rule_id))) > 0 AS ignored"
    " FROM f LEFT JOIN d ON d.file = f.file AND (d.line = f.line OR d.line + 1 = f.line) GROUP BY ALL",
)
def inline_ignore(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    file = F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("file")
    text = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(f" // {triage.IGNORE}"))).when(F.col("turn") % 3 == 1, F.concat("text", F.lit(f" # {triage.IGNORE}[r1, r2]"))).otherwise(F.col("text"))
    src = c.select(file, F.col("turn").alias("line"), text.alias("text"))
    f = c.select(file, F.col("turn").alias("line"), F.concat(F.lit("r"), (F.col("conv_id") % 4).cast("string")).alias("rule_id")).distinct()
    return triage.ignored(f, src).select("file", "line", "rule_id", "ignored")


@query(
    "snippet_window",
    "WITH l AS (SELECT 'd' || doc_id AS file, line, text FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS text FROM documents)),"
    " f AS (SELECT 'd' || doc_id AS file, 1 + doc_id % 7 AS line FROM documents) SELECT f.file, f.line, l.line AS at, md5(l.text) AS digest FROM f JOIN l ON l.file = f.file AND l.line BETWEEN f.line - 2 AND f.line + 2",
)
def snippet_window(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("file", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    f = d.select("file", (1 + F.col("doc_id") % 7).alias("line"))
    s = lines.snippets(f, lines.numbered(d, ["file"], "text"), 2)
    return s.select("file", "line", F.col("_line").alias("at"), F.md5("text").alias("digest"))


_HOSTS = "SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^(https?://[^/]*/).*$', '\\1') || '<DYN>' WHEN 2 THEN regexp_replace(url, '^(https?://)[^/]*', '\\1<DYN>') ELSE regexp_replace(url, '^(https?://[^/]*).*$', '\\1') || '<DYN>' END AS skel FROM pages"


@query("host_fixed_urls", f"WITH s AS ({_HOSTS}) SELECT page_id, skel, regexp_matches(string_split(skel, '<DYN>')[1], '^[a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#\\\\]+[/?#\\\\]') AS fixed FROM s")
def host_fixed_urls(spark, sf_dir):
    u, k = F.col("url"), F.col("page_id") % 4
    skel = (
        F.when(k == 0, u).when(k == 1, F.concat(F.regexp_replace(u, "^(https?://[^/]*/).*$", "$1"), F.lit("<DYN>")))
        .when(k == 2, F.regexp_replace(u, "^(https?://)[^/]*", "$1<DYN>")).otherwise(F.concat(F.regexp_replace(u, "^(https?://[^/]*).*$", "$1"), F.lit("<DYN>")))
    )
    return table(spark, sf_dir, "pages").select("page_id", skel.alias("skel")).select("page_id", "skel", host_fixed(F.col("skel")).alias("fixed"))


@query(
    "template_skeleton",
    "WITH t AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name || ' %s of %5.2f' WHEN 1 THEN '{' || p_brand || '} at {}' WHEN 2 THEN '100%% ' || p_type || ' {{x}}' ELSE p_name END AS tpl FROM part)"
    " SELECT p_partkey, tpl, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(tpl, '%%', chr(1)), '{{', chr(2)), '}}', chr(3)), '%[^A-Za-z]*[A-Za-z]?', '<DYN>', 'g'), '\\{[^}]*\\}?', '<DYN>', 'g'), chr(1), '%', 'g'), chr(2), '{', 'g'), chr(3), '}', 'g') AS skel FROM t",
)
def template_skeletons(spark, sf_dir):
    k, p = F.col("p_size") % 4, table(spark, sf_dir, "part")
    tpl = F.when(k == 0, F.concat("p_name", F.lit(" %s of %5.2f"))).when(k == 1, F.concat(F.lit("{"), "p_brand", F.lit("} at {}"))).when(k == 2, F.concat(F.lit("100%% "), "p_type", F.lit(" {{x}}"))).otherwise(F.col("p_name"))
    return p.select("p_partkey", tpl.alias("tpl")).select("p_partkey", "tpl", template_skeleton(F.col("tpl")).alias("skel"))


@query(
    "page_directives",
    "WITH m AS (SELECT page_id, regexp_extract_all(html, '" + _Q(lines.DIRECTIVE) + "', 0) AS found FROM pages), x AS (SELECT page_id, unnest(range(len(found))) AS ord, unnest(found) AS hit FROM m)"
    " SELECT page_id, ord, regexp_extract(hit, '" + _Q(lines.DIRECTIVE) + "', 1) AS attr, regexp_extract(hit, '" + _Q(lines.DIRECTIVE) + "', 2) AS value FROM x",
)
def page_directives(spark, sf_dir):
    return lines.page_directives(table(spark, sf_dir, "pages"), ["page_id"], "html")


@query("coverage_by_lang", "SELECT lang, count(*) AS files, count(*) FILTER (text IS NOT NULL AND n_chars > 100) AS converted, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def coverage_by_lang(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.count("*").alias("files"), F.count(F.when(F.col("text").isNotNull() & (F.col("n_chars") > 100), 1)).alias("converted"), F.sum("n_chars").alias("chars"))


@query("lines_by_source", "SELECT source, sum(len(string_split(text, chr(10))))::BIGINT AS lines, max(len(string_split(text, chr(10))))::BIGINT AS longest FROM documents GROUP BY source")
def lines_by_source(spark, sf_dir):
    n = F.size(F.split("text", "\n")).cast("long")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(n).alias("lines"), F.max(n).alias("longest"))


@query("file_selection", "SELECT page_id, path, regexp_replace(path, '\\.[^./]*$', '') AS module FROM (SELECT page_id, regexp_extract(url, '^https?://[^/]*/([^?#]*)', 1) || '/p' || page_id || ['.py', '.min.js', '.d.ts', '.rb'][page_id % 4 + 1] AS path FROM pages) WHERE NOT regexp_matches(path, '\\.(min\\.js|min\\.css|bundle\\.js|map|d\\.ts)$') AND NOT list_has_any(string_split(path, '/'), ['vendor', 'node_modules', 'dist', 'build', 'fr'])")
def file_selection(spark, sf_dir):
    from weirflow.sources.inventory import selected

    ext = F.element_at(F.array(*map(F.lit, (".py", ".min.js", ".d.ts", ".rb"))), (F.col("page_id") % 4 + 1).cast("int"))
    path = F.concat(F.regexp_extract("url", "^https?://[^/]*/([^?#]*)", 1), F.lit("/p"), F.col("page_id").cast("string"), ext)
    p = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return p.where(selected(F.col("path"), skip=["vendor", "node_modules", "dist", "build", "fr"])).select("page_id", "path", module_name(F.col("path")).alias("module"))


@query("common_roots", "SELECT lang, CASE WHEN count(DISTINCT source) > 1 THEN 'src/' || lang ELSE 'src/' || lang || '/' || min(source) END AS root FROM documents GROUP BY lang")
def common_roots(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", "source").distinct()
    paths = d.select("lang", F.concat_ws("/", F.lit("src"), "lang", "source", F.lit("a.src")).alias("path"))
    return paths.groupBy("lang").agg(common_root("path").alias("root"))
