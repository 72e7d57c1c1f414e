"""The corpus queries, one for each operator, and SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import audio, jaccard, langid, mixing, packing, quality, suffix, tokenids, topk, toxicity
from weirflow.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_WORDS = r"regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


ORACLES["op1_ngram_jaccard_join"] = f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS k, * FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL)),
words AS (SELECT k, {_WORDS} AS w FROM docs),
grams AS (
  SELECT DISTINCT k, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g
  FROM words WHERE len(w) > 0),
sizes AS (SELECT k, count(*) AS n FROM grams GROUP BY k),
common AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.k <> b.k GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.k = a JOIN sizes y ON y.k = b WHERE 5 * c >= 3 * (x.n + y.n - c)),
reach AS (SELECT k AS a, k AS b FROM docs UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
class AS (SELECT a, min(doc_id) AS class_id FROM reach JOIN docs ON k = b GROUP BY a)
SELECT doc_id, class_id, (SELECT count(*) FROM links WHERE links.a = docs.k) AS links FROM docs JOIN class ON class.a = docs.k
"""


@_query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model)


@_query
def op2_token_id_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.index(table(spark, sf_dir, "documents"))


@_query
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


ORACLES["op3_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, min(embedding) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 GROUP BY vec_id),
d AS (
  SELECT a.vec_id, b.vec_id AS neighbor_id, list_distance(a.e::DOUBLE[], b.e::DOUBLE[]) AS distance
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id) AS rank FROM d)
SELECT vec_id, rank::INTEGER AS rank, neighbor_id, round(distance, 6) AS distance FROM r WHERE rank <= 10
"""


@_query
def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.spans(table(spark, sf_dir, "documents"))


ORACLES["op4_suffix_array_dedup"] = f"""
WITH words AS (
  SELECT DISTINCT doc_id, text, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
windows AS (
  SELECT doc_id, unnest(range(0, len(w) - 49)) AS p, unnest(list_transform(range(0, len(w) - 49),
    lambda i: array_to_string(w[i + 1:i + 50], ' '))) AS win
  FROM words WHERE len(w) >= 50),
ranked AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY md5(win) ORDER BY doc_id, p) AS k,
    count(*) OVER (PARTITION BY md5(win)) AS n
  FROM windows),
marks AS (
  SELECT doc_id, unnest(range(p, p + 50)) AS word, k > 1 AS removed FROM ranked WHERE n > 1),
state AS (SELECT doc_id, word, bool_or(removed) AS removed FROM marks GROUP BY doc_id, word),
islands AS (
  SELECT *, word - row_number() OVER (PARTITION BY doc_id, removed ORDER BY word) AS g FROM state)
SELECT doc_id, min(word) AS start_word, max(word) + 1 AS end_word, removed
FROM islands GROUP BY doc_id, removed, g
"""


@_query
def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@_query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


@_query
def op8_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There is no table of audio; the bytes of each turn of a conversation stand in for what the line carried."""
    turns = table(spark, sf_dir, "conversations")
    kind = F.pmod(F.coalesce(F.col("conv_id"), F.lit(0)) + F.coalesce(F.col("turn"), F.lit(0)), F.lit(3))
    codec = F.when(kind == 0, "mulaw").when(kind == 1, "alaw").otherwise("ima_adpcm")
    return audio.decode(turns, ["conv_id", "turn"], codec, F.col("text"))


@_query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


@_query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
