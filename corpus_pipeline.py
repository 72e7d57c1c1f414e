"""The corpus pipeline: toxic documents go, one document of each group of near
copies stays, passages that came before are cut, sources are mixed to target
weights, and the mixture is packed into windows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the docs of the next. All but the last return the columns of
documents. Rows that a stage can't judge (null id or text, no words) stay, until
mixing, which has no tokens of theirs to use. Texts may be of any length, tables
empty, and further columns, whatever their names, are kept until mixing, where
they are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weirflow.llm import jaccard, mixing, packing, suffix, toxicity
from weirflow.session import finished, made, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without toxic texts. Null and empty texts and texts without a known term stay; repeated rows go or stay
    together; with labels of no toxic row all stay."""
    return toxicity.keep(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each class of near copies, the least (doc_id, text hash). Rows without id, text or words stay."""
    return jaccard.distinct(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without passages of 50 words that came before, by (doc_id, text hash, place). A document that has nothing
    else goes; null ids, null texts and texts under 50 words stay as they are."""
    return suffix.removed(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What documents give to the slots of the mixture, under their ids: a document that lies in two blocks is two rows,
    and one whose block isn't drawn has none. Null sources are the source ''."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(unit, window, offset, doc_id, start, n_tokens): where each row of docs lies; ``start`` counts its own tokens."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_copies", without_near_copies),
    ("repeated_passages", without_repeated_passages),
    ("mixing", mixed),
    ("packing", packed),
]

#: A factorization machine, suffix cutting of texts and best-fit packing have no form in SQL: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage as a table in the shared folder; all others that were written for it are deleted."""
    docs, since = table(spark, sf_dir, "documents"), made()
    for _, stage in STAGES:
        docs = finished(stage(spark, docs, sf_dir), since)
    return docs
