"""Quality classifier: logistic regression on hashed word n-grams, trained by
follow-the-regularised-leader updates and scored as sparse dot products.

A word here is a run of non-blanks as written, with its case and punctuation,
and has a *shape*: its bytes as classes (upper, lower, digit, beyond ASCII, or
the sign itself) without repeats, so that "LOREM!!" is "A!". Features are the
words and shapes, their pairs with the next, and whether the next is the same
word; a feature's value is its count by the number of words, times SCALE.

Defined results: null texts and texts without words have score 0 and are not
kept; null ids are scored like others; repeated rows give repeated results; an
empty table gives no rows; without labels the score is 0.5 and all are kept;
columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weirflow.llm.ftrl import Ftrl, probability
from weirflow.llm.labelled import SAMPLE_ROWS, keyed, rows_of, sample, sums
from weirflow.llm.mixing import token_spans
from weirflow.llm.textkit import mix, slices, span_hash

BITS = 20
SCALE = 8.0
PASSES = 3
L1, L2 = 1.0, 0.1
THRESHOLD = 0.5

_CLASS = np.arange(256, dtype=np.uint8)
for _c, _r in ((b"A", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (b"a", b"abcdefghijklmnopqrstuvwxyz"), (b"0", b"0123456789"), (b"u", bytes(range(128, 256)))):
    _CLASS[list(_r)] = _c[0]
_MUL = np.uint64(0xD6E8FEB86659FD93)
KINDS = 5


def features(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features, KINDS for each word; the first word of each row)."""
    raw, start, end, first = token_spans(arr)
    word = span_hash(raw)(start, end)
    kind = _CLASS[raw]
    new = np.ones(len(raw), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[start] = True
    place = np.concatenate([[0], np.cumsum(new)])
    shape = span_hash(kind[new])(place[start], place[end]) ^ np.uint64(0x5A)
    last = np.zeros(len(start), bool)
    last[first[1:][np.diff(first) > 0] - 1] = True
    nxt = np.minimum(np.arange(len(start)) + 1, max(len(start) - 1, 0))
    pair = np.where(last, np.uint64(1), mix(word * _MUL + word[nxt]))
    shapes = np.where(last, np.uint64(2), mix(shape * _MUL + shape[nxt]))
    same = np.where(last, np.uint64(3), np.where(word == word[nxt], np.uint64(4), np.uint64(5)))
    f = np.stack([word, shape, pair, shapes, mix(same)], 1)
    return (f >> np.uint64(64 - BITS)).astype(np.int64), first


def rows(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    f, first = features(arr)
    idx, val, off = [np.zeros(0, np.int64)], [np.zeros(0)], [0]
    for a, b in zip(first, first[1:]):
        i, c = np.unique(f[a:b], return_counts=True)
        idx.append(i)
        val.append(c * (SCALE / max(b - a, 1)))
        off.append(off[-1] + len(i))
    return np.concatenate(idx), np.concatenate(val), np.array(off)


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights, the last one the intercept."""
    x, y = rows_of(sample(docs, labels, "quality", most), rows)
    return Ftrl(1 << BITS, alpha=0.3, l1=L1, l2=L2).fit(x, y, PASSES).weights()[:, 0] if len(x) else np.zeros((1 << BITS) + 1)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score, keep) of every row."""
    on = np.flatnonzero(weights)
    sent = docs.sparkSession.sparkContext.broadcast((on, weights[on]))  # of bounded size, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros((1 << BITS) + 1)
        w[sent.value[0]] = sent.value[1]
        for b in slices(batches, "text"):
            f, first = features(b.column("text"))
            n = np.diff(first)
            dot = sums(w[f].sum(1), first) * SCALE / np.maximum(n, 1)
            p = np.where(n > 0, np.round(probability((dot + w[-1])[:, None])[:, 0], 6), 0.0)
            yield pa.record_batch([b.column("doc_id"), pa.array(p), pa.array(p >= THRESHOLD)], ["doc_id", "score", "keep"])

    return keyed(docs).mapInArrow(run, "doc_id long, score double, keep boolean")
