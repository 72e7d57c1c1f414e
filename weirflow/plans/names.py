"""Names, places and replies: the operators of ``operators.names`` and the scalar functions around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirflow.catalog import query
from weirflow.functions import scalars
from weirflow.operators import lines, names
from weirflow.plans import derived
from weirflow.plans.derived import METHOD, SQL
from weirflow.session import table
from weirflow.sources import mir_frontend

_GENERIC = "'Vec::<' || p_type || '<' || p_brand || ', u8>>::' || replace(p_name, ' ', '_') || CASE WHEN p_size % 2 = 0 THEN '::<&str>' ELSE '' END"


@query("plain_names", rf"SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace({_GENERIC}, '<[^<>]*>', '', 'g'), '<[^<>]*>', '', 'g'), ':{{2,}}', '::', 'g'), ':') AS name FROM part")
def plain_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.plain_name(F.expr(_GENERIC)).alias("name"))


@query(
    "line_columns",
    "WITH p AS (SELECT doc_id, substr(text, 1, (doc_id * 37 % length(text))::INT) AS head FROM documents WHERE length(text) > 0)"
    r" SELECT doc_id, 1 + len(regexp_extract_all(head, '\r\n|\r|\n')) AS line, strlen(head) - strlen(regexp_extract(head, '(?s)^(.*[\r\n])', 1)) + 1 AS col FROM p",
)
def line_columns(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    at = F.octet_length(F.substring(F.col("text"), F.lit(1), (F.col("doc_id") * 37 % F.length("text")).cast("int")))
    line, col = scalars.line_and_column(F.col("text"), at)
    return d.select("doc_id", line.alias("line"), col.alias("col"))


_DESC = "'(Ljava/lang/' || replace(p_brand, '#', '') || ';I[B' || CASE p_size % 3 WHEN 0 THEN 'J' WHEN 1 THEN '[[D' ELSE 'D[Lx/Y;' END || ')V'"


@query(
    "descriptor_params",
    rf"WITH d AS (SELECT p_partkey, regexp_extract_all(regexp_extract({_DESC}, '\(([^)]*)\)', 1), '\[*(?:L[^;]*;|[^L\[])') AS ps FROM part)"
    " SELECT p_partkey, array_to_string(ps, ' ') AS params, list_sum(list_transform(ps, lambda p: CASE WHEN p IN ('J', 'D') THEN 2 ELSE 1 END))::BIGINT AS slots FROM d",
)
def descriptor_params(spark, sf_dir):
    params = scalars.descriptor_params(F.expr(_DESC))
    slots = F.aggregate(params, F.lit(0).cast("long"), lambda n, p: n + scalars.slot_width(p))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(params, " ").alias("params"), slots.alias("slots"))


_REPLY = (
    "CASE turn % 5 WHEN 0 THEN 'Looks safe: {\"verdict\": \"false_positive\", \"reason\": \"' || role || '\"} as said' WHEN 1 THEN '{\"verdict\": \" False-Positive \"}'"
    " WHEN 2 THEN 'false_positive' WHEN 3 THEN '{\"verdict\": \"false\"}' ELSE '{\"verdict\": \"false_positive\"' END"
)


@query(
    "review_verdicts",
    rf"WITH r AS (SELECT conv_id, turn, regexp_extract({_REPLY}, '(?s)(\{{.*\}})', 1) AS body FROM conversations)"
    " SELECT conv_id, turn, CASE WHEN json_valid(body) THEN coalesce(lower(trim(json_extract_string(body, '$.verdict'))) IN ('false_positive', 'false-positive'), false) ELSE false END AS dropped FROM r",
)
def review_verdicts(spark, sf_dir):
    """Replies of a reviewer: only one that says exactly so in its JSON object drops a finding."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", scalars.false_positive(F.expr(_REPLY)).alias("dropped"))


#: Functions by dotted path; a call of kind 7 names one below further packages, one of kind 6 without its first part.
_PATH = "replace(module, '/', '.') || '.' || method_name"
_CALLEE = f"CASE WHEN k = 7 AND seq % 2 = 0 THEN 'site.' || module WHEN k = 7 THEN module ELSE substr(module, 5) END || '.' || {METHOD.format('callee_fn')}"


@query(
    "import_resolution",
    SQL + f", fns AS (SELECT fn AS target, {_PATH} AS path FROM func), callees AS (SELECT DISTINCT replace({_CALLEE}, '/', '.') AS callee FROM instr WHERE k IN (6, 7)),"
    " ends AS (SELECT target, array_to_string(string_split(path, '.')[i:], '.') AS key FROM (SELECT target, path, unnest(range(2, len(string_split(path, '.')))) AS i FROM fns)),"
    " idx AS (SELECT path AS key, min(target) AS target, 0 AS tier FROM fns GROUP BY path HAVING count(*) = 1 UNION ALL SELECT key, min(target), 1 FROM ends GROUP BY key HAVING count(*) = 1),"
    " tries AS (SELECT callee, i, array_to_string(string_split(callee, '.')[i:], '.') AS key FROM (SELECT callee, unnest(range(1, len(string_split(callee, '.')))) AS i FROM callees))"
    " SELECT callee, arg_min(target, i * 2 + tier) AS target FROM tries JOIN idx USING (key) GROUP BY callee",
)
def import_resolution(spark, sf_dir):
    f = derived.functions(spark, sf_dir).select(F.col("fn").alias("target"), F.lit("py").alias("scope"), F.expr(_PATH).alias("path"))
    callee = F.translate(F.expr(_CALLEE), "/", ".")
    c = derived.instructions(spark, sf_dir).where("k IN (6, 7)").select(callee.alias("callee"), F.lit("py").alias("scope"), callee.alias("path"))
    return names.import_targets(f, c)


_MODULE = "'lib/d' || CAST(floor({0} / 8) AS BIGINT)"


@query(
    "default_exports",
    SQL + f", one AS (SELECT {_MODULE.format('fn')} AS module, min(fn) AS fn FROM func WHERE fn % 5 = 0 GROUP BY 1 HAVING count(*) = 1),"
    f" c AS (SELECT fn, seq, {_MODULE.format('callee_fn')} AS module FROM instr WHERE k = 6) SELECT c.fn, seq, coalesce('js:f' || one.fn, 'js:' || substr(module, 5)) AS callee FROM c LEFT JOIN one USING (module)",
)
def default_exports(spark, sf_dir):
    """Calls of a module's default export: of one with none or several the bare name is left."""
    exports = derived.functions(spark, sf_dir).where("fn % 5 = 0").select(F.expr(_MODULE.format("fn")).alias("module"), F.concat(F.lit("js:f"), F.col("fn").cast("string")).alias("target"))
    calls = derived.instructions(spark, sf_dir).where("k = 6").select("fn", "seq", F.concat(F.lit(names.DEFAULT), F.expr(_MODULE.format("callee_fn"))).alias("callee"))
    return names.default_exports(calls, exports)


@query(
    "cell_calls",
    SQL + ", m AS (SELECT 'app/c' || CAST(floor(fn / 16) AS BIGINT) || '_cell' AS module, 'a' || fn % 11 AS method, min(fn) AS fn FROM func GROUP BY 1, 2 HAVING count(*) = 1),"
    " c AS (SELECT fn, seq, 'app/c' || CAST(floor(callee_fn / 16) AS BIGINT) || '_cell' AS module, 'a' || callee_fn % 13 AS method FROM instr WHERE k = 5)"
    " SELECT c.fn, seq, coalesce('ruby:f' || m.fn, 'ruby:' || method) AS callee FROM c LEFT JOIN m USING (module, method)",
)
def cell_calls(spark, sf_dir):
    """Calls in templates of cells, to the class beside the folder of the template."""
    methods = derived.functions(spark, sf_dir).select(
        F.expr("'app/c' || CAST(floor(fn / 16) AS BIGINT) || '_cell'").alias("module"), F.expr("'a' || fn % 11").alias("method"), F.concat(F.lit("ruby:f"), F.col("fn").cast("string")).alias("target")
    )
    calls = derived.instructions(spark, sf_dir).where("k = 5").select("fn", "seq", F.expr(f"'{names.CELL}app/c' || CAST(floor(callee_fn / 16) AS BIGINT) || '/show|a' || callee_fn % 13").alias("callee"))
    return names.cell_calls(calls, methods)


@query(
    "request_hosts",
    SQL + " SELECT DISTINCT 'f' || fn AS fn FROM instr WHERE NOT is_target AND (k = 0 OR k = 13 AND fn IN (SELECT callee_fn FROM instr WHERE is_target AND k BETWEEN 4 AND 7))",
)
def request_hosts(spark, sf_dir):
    """Kind 0 is an ordinary source, kind 13 a request object."""
    callee = F.when(F.col("k") == 0, "source").when(F.col("k") == 13, "request").when(F.col("k").between(4, 7), F.concat(F.lit("f"), F.col("callee_fn").cast("string")))
    calls = derived.program(spark, sf_dir).select(F.concat(F.lit("f"), F.col("fn").cast("string")).alias("fn"), "is_target", callee.alias("callee")).where("callee IS NOT NULL")
    return names.request_hosts(calls, F.col("callee") == "source", F.col("callee") == "request")


@query(
    "grep_lines",
    "WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS text FROM documents),"
    r" g AS (SELECT doc_id, line, trim(text, ' ' || chr(9) || chr(13)) AS hit FROM l WHERE regexp_matches(text, '\b[a-z]+ing\b') ORDER BY doc_id, line LIMIT 50)"
    " SELECT doc_id, line, hit FROM (SELECT *, sum(strlen(hit)) OVER (ORDER BY doc_id, line) - strlen(hit) AS before FROM g) WHERE before <= 8000",
)
def grep_lines(spark, sf_dir):
    """What a reviewer's search gives: the first 50 lines, and no further one after 8,000 bytes."""
    return lines.grep(table(spark, sf_dir, "documents"), "doc_id", "text", r"\b[a-z]+ing\b")


@query(
    "size_strings",
    "SELECT doc_id, CASE WHEN n >= 1048576 THEN printf('%.1f MB', floor(n * 10 / 1048576.0) / 10) WHEN n >= 1024 THEN printf('%.1f KB', floor(n * 10 / 1024.0) / 10) ELSE n || ' B' END AS size,"
    r" md5(CASE WHEN regexp_matches(text, '(?s)^.*?[.!?](?:\s|$)') THEN regexp_extract(text, '(?s)^(.*?[.!?])(?:\s|$)', 1) ELSE text END) AS sentence FROM (SELECT *, n_chars * 977 AS n FROM documents WHERE text IS NOT NULL)",
)
def size_strings(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", scalars.humanised(F.col("n_chars") * 977).alias("size"), F.md5(scalars.first_sentence(F.col("text"))).alias("sentence"))


def _mir(spark, sf_dir):
    """Calls of each function of the derived program as the text of a dump, a block each."""
    i = derived.instructions(spark, sf_dir).where("k BETWEEN 4 AND 7")
    g = i.groupBy("fn").agg(F.sort_array(F.collect_list(F.struct("seq", "callee_fn", "opnd", "line", "col"))).alias("r"), F.count("*").alias("n"))
    block = (
        "concat('    bb', b, ': {\\n        _', x.seq + 1, ' = <T as lib::Of<u', x.seq, '>>::g', x.callee_fn, '::<Vec<u8>>(copy _', x.opnd + 1, ', const \"// ', x.seq,"
        " '\") -> [return: bb', b + 1, ', unwind: bb99]; // scope 0 at src/m.rs:', x.line, ':', x.col, ': 9:9\\n    }\\n')"
    )
    body = F.array_join(F.expr(f"transform(r, (x, b) -> {block})"), "")
    return g.select(F.concat(F.lit("f"), F.col("fn").cast("string"), F.lit(".mir")).alias("path"), F.concat(F.lit("fn f"), F.col("fn").cast("string"), F.lit("(_1: u8) -> u8 {\n"), body, F.lit("    bb"), F.col("n").cast("string"), F.lit(": {\n        return;\n    }\n}\n")).alias("text"))


@query("mir_calls", SQL + " SELECT 'rust:f' || fn AS fn, 'rust:g' || callee_fn AS callee, line, col FROM instr WHERE k BETWEEN 4 AND 7")
def mir_calls(spark, sf_dir):
    """Calls that are read from the text of a dump: names without type arguments, places from the comments."""
    low = mir_frontend.lower(_mir(spark, sf_dir)).where("error IS NULL")
    at = lambda k: F.regexp_extract("c.id", r"^src/m\.rs:(\d+):(\d+):\d+$", k).cast("long")
    return low.select("fn", F.explode("calls").alias("c")).select("fn", "c.callee", at(1).alias("line"), at(2).alias("col"))


_PAGE = "html || chr(10) || '<p v-html=\"m' || page_id || '\"/>' || chr(10) || '<%== u' || page_id || ' -%>'"


@query(
    "template_outputs",
    "WITH n AS (SELECT page_id, len(string_split(html, chr(10))) AS n FROM pages) SELECT page_id, 'vue_html' AS callee, 'm' || page_id AS expression, n + 1 AS line FROM n UNION ALL SELECT page_id, 'erb_raw', 'u' || page_id, n + 2 FROM n",
)
def template_outputs(spark, sf_dir):
    """What pages with two directives put out raw."""
    p = table(spark, sf_dir, "pages").where("html IS NOT NULL").select("page_id", F.expr(_PAGE).alias("html"))
    return lines.raw_outputs(p, ["page_id"], "html")
