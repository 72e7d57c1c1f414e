"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, trained by follow-the-regularised-leader with an elastic-net
penalty, then calibrated by a temperature.

Features are all runs of 1, 2 and 3 characters of the lower-cased text, hashed to
2^BITS. Document frequencies come from every document of the corpus; a vector
tf x idf is scaled to length 1. The model is fitted on at most SAMPLE_ROWS
documents with a known language, four fifths for the weights and one fifth for
the temperature, and scores every row.

A slice of texts becomes one sorted array of (row, n-gram) keys; its runs are the
counts, so the work follows the text and not the number of hashed n-grams.

Defined results: null and empty texts are 'und' with confidence 0; null ids are
scored like others; a text of any length is one row and is read whole; repeated
rows give repeated results; ties between languages go to the first by name; an
empty table gives no rows; without a known language all are 'und'; columns beyond
doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.ftrl import Ftrl, probability, temperature
from weirflow.llm.labelled import SAMPLE_ROWS, keyed, rows_of
from weirflow.llm.textkit import buffers, slices

BITS = 15
LONGEST = 3
PASSES = 3
L1, L2 = 0.05, 0.05


def sparse(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed n-gram, its count in the row, offsets of each row): the distinct n-grams of each row, in order."""
    raw, off = buffers(pc.utf8_lower(pc.fill_null(arr, "")))
    place = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[off]  # of rows, in characters
    char = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(arr), dtype=np.uint32), np.diff(place))
    h, keys = np.full(len(char), 1, np.uint32), []
    for n in range(min(LONGEST, len(char))):
        m = len(char) - n
        h = (h[:m] * np.uint32(0x01000193) + char[n:]) * np.uint32(0x9E3779B1)
        key = row[:m] << np.uint32(BITS) | (h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)
        keys.append(key[row[:m] == row[n:]] if n else key)
    key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint32)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    one = key[first]
    bounds = np.searchsorted(one, np.arange(len(arr) + 1, dtype=np.uint64) << np.uint64(BITS))
    return (one & np.uint32((1 << BITS) - 1)).astype(np.int64), np.diff(np.append(first, len(key))).astype(float), bounds


def row_sums(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    out = np.zeros(len(off) - 1)
    on = np.flatnonzero(np.diff(off))
    if len(on):
        out[on] = np.add.reduceat(x, off[on])
    return out


def unit(idf: np.ndarray, arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed n-gram, tf x idf scaled to length 1, offsets of each row)."""
    i, c, off = sparse(arr)
    x = c * idf[i]
    length = np.sqrt(row_sums(x * x, off))
    return i, x / np.repeat(np.where(length > 0, length, 1), np.diff(off)), off


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(number of documents with each hashed n-gram, number of documents), of the whole corpus. A task sends one
    table of fixed size; tables are summed by the executors in chunks."""
    chunks = 64
    span = (1 << BITS) // chunks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        for b in slices(batches, "text"):
            df += np.bincount(sparse(b.column("text"))[0], minlength=1 << BITS)
            n += b.num_rows
        if n:
            yield pa.record_batch([pa.array([*range(chunks), -1], pa.int32()), pa.array([*(df[k * span : (k + 1) * span].tobytes() for k in range(chunks)), np.int64(n).tobytes()], pa.binary())], ["chunk", "part"])

    def add(t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(p, np.int64) for p in t.column("part").to_pylist()], axis=0)
        return pa.table({"chunk": t.column("chunk")[:1], "part": [total.tobytes()]})

    got = docs.mapInArrow(run, "chunk int, part binary").groupBy("chunk").applyInArrow(add, "chunk int, part binary").toArrow()
    df, n = np.zeros(1 << BITS, np.int64), 0
    for k, p in zip(got["chunk"].to_pylist(), got["part"].to_pylist()):
        if k < 0:
            n = int(np.frombuffer(p, np.int64)[0])
        else:
            df[k * span : (k + 1) * span] = np.frombuffer(p, np.int64)
    return df, n


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray, w: np.ndarray, bias: np.ndarray, t: float):
        self.langs, self.idf, self.w, self.bias, self.t = langs, idf, np.asfortranarray(w), bias, t

    def scores(self, arr: pa.Array) -> np.ndarray:
        i, x, off = unit(self.idf, arr)
        return np.stack([row_sums(x * w[i], off) for w in self.w.T], 1) + self.bias

    def label(self, arr: pa.Array) -> tuple[list[str], np.ndarray]:
        empty = pc.fill_null(pc.equal(pc.binary_length(arr), 0), True).to_numpy(zero_copy_only=False)
        if not self.langs:
            return ["und"] * len(arr), np.zeros(len(arr))
        p = probability(self.scores(arr) / self.t) if len(self.langs) > 1 else np.ones((len(arr), 1))
        best = p.argmax(1)
        return ["und" if e else self.langs[k] for k, e in zip(best, empty)], np.where(empty, 0.0, p.max(1))


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    df, n = document_frequency(keyed(docs))
    idf = np.log((1 + n) / (1 + df)) + 1
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("y")).na.drop().groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    known = keyed(docs).na.drop().join(F.broadcast(picked), "doc_id")  # rows is a fixed bound

    x, y = rows_of(known, lambda arr: unit(idf, arr))
    langs = sorted(set(y.tolist()))
    if len(langs) < 2:
        return Model(langs, idf, np.zeros((1 << BITS, len(langs))), np.zeros(len(langs)), 1.0)
    y = np.searchsorted(langs, y)
    held = np.arange(len(x)) % 5 == 0
    m = Ftrl(1 << BITS, len(langs), alpha=0.5, l1=L1, l2=L2).fit([r for r, h in zip(x, held) if not h], y[~held], PASSES)
    w = m.weights()
    raw = np.array([v @ w[i] + w[-1] for (i, v), h in zip(x, held) if h])
    return Model(langs, idf, w[:-1], w[-1], temperature(raw, y[held]))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, confidence) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            lang, p = sent.value.label(b.column("text"))
            yield pa.record_batch([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(np.round(p, 6))], ["doc_id", "lang", "confidence"])

    return keyed(docs).mapInArrow(run, "doc_id long, lang string, confidence double")
