"""The bounded labelled sample that a classifier is fitted on, and features by row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.textkit import slices

#: At most this many labelled rows fit a model. It bounds training only; statistics and scoring cover every row.
SAMPLE_ROWS = 12_000


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled documents, chosen by hash of the id, the same at every run.
    Rows without id, label or text don't count; an id labelled twice keeps its larger label."""
    picked = (
        labels.select("doc_id", F.col(label).cast("int").alias("y")).na.drop().groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    return docs.select("doc_id", "text").na.drop().join(F.broadcast(picked), "doc_id")  # rows is a fixed bound


Featurise = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]


def rows_of(df: DataFrame, featurise: Featurise, y: str = "y") -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Feature rows and labels on the driver, in order of id. Features are made by the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            idx, val, off = featurise(b.column("text"))
            yield pa.record_batch(
                [b.column("doc_id"), b.column(y), [idx[x:z].astype(np.int32).tobytes() for x, z in zip(off, off[1:])], [val[x:z].astype(np.float32).tobytes() for x, z in zip(off, off[1:])]],
                ["doc_id", "y", "i", "v"],
            )

    got = df.mapInArrow(run, f"doc_id long, y {dict(df.dtypes)[y]}, i binary, v binary").toArrow().sort_by([("doc_id", "ascending"), ("i", "ascending")])
    rows = [(np.frombuffer(i, np.int32).astype(np.int64), np.frombuffer(v, np.float32).astype(float)) for i, v in zip(got["i"].to_pylist(), got["v"].to_pylist())]
    return rows, np.asarray(got["y"].to_pylist())


def shared(col: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row's span of ``col``: (values, offsets)."""
    out, off = [], [0]
    for a, b in zip(first, first[1:]):
        u = np.sort(col[a:b])
        if len(u):
            u = u[np.concatenate([[True], u[1:] != u[:-1]])]
        out.append(u)
        off.append(off[-1] + len(u))
    return (np.concatenate(out) if out else col[:0]), np.asarray(off)


def sums(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of x over each row's span; empty spans give 0."""
    c = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0, dtype=np.float64)])
    return c[off[1:]] - c[off[:-1]]


def keyed(df: DataFrame, text: str = "text") -> DataFrame:
    """Only the id and the text, under names that extra columns of the input can't clash with."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def decimals(c: Column | str, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)
