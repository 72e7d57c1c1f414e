"""Toxicity: a factorization machine over hashed terms (Rendle, 2010).

score(x) = b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j, x_i > 0 where the
document has a word, or the first five bytes of a word, that hashes to i. The
pairwise part learns what an additive model can't: an insult next to a group
mention is toxic, either alone is not. Every term of the labelled documents gets
a weight (FTRL) and a factor vector (AdaGrad). In place of 1, x_i is a scale that
follows the evidence of the term (``scales``), else the many terms of one document
alone would learn its label by heart.

Defined results: null and empty texts, and texts without a term of the model,
score the intercept alone and are never toxic, whatever it is; null ids are scored
like others; repeated rows give repeated results; an empty table gives none;
columns beyond doc_id and text are ignored in scoring and kept by ``keep``. Without a row labelled toxic nothing is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.ftrl import Ftrl, probability
from weirflow.llm.labelled import SAMPLE_ROWS, keyed, rows_of, sample, shared, sums
from weirflow.llm.textkit import Words, slices

BITS = 20
FACTORS = 8
PASSES = 4
#: With few labelled rows there are more passes, three times as many at most, towards so many steps.
STEPS = 20_000
#: Documents at which a term without evidence of its own has half its share.
RARE = 10
STEM = 5
THRESHOLD = 0.25


def hashes(w: Words) -> np.ndarray:
    """Two terms for each word, itself and its first five bytes, side by side."""
    stem = w.span_hash(w.start, np.minimum(w.start + STEM, w.end))
    return (np.stack([w.hash, stem ^ np.uint64(0x9E37)], 1).ravel() >> np.uint64(64 - BITS)).astype(np.int64)


def terms(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = Words(arr)
    idx, off = shared(hashes(w), 2 * w.first)
    return idx, np.ones(len(idx)), off


@dataclass
class FactorizationMachine:
    """The terms of the labelled documents, with w and v times their scale: ``slot`` maps a term to its row of w and v, 0 being no term."""

    bias: float
    terms: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def scorer(self):
        """Of texts, their probabilities and whether they are toxic."""
        slot = np.zeros(1 << BITS, np.int32)
        slot[self.terms] = np.arange(1, len(self.terms) + 1)

        def score(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            words = Words(arr)
            s = slot[hashes(words)]
            hit = np.flatnonzero(s)
            idx, off = shared(s[hit], np.searchsorted(hit, 2 * words.first))
            v = self.v[idx - 1].astype(float)
            pair = sums(v, off) ** 2 - sums(v * v, off)
            p = probability((self.bias + sums(self.w[idx - 1], off) + 0.5 * pair.sum(1))[:, None])[:, 0]
            return p, (p >= THRESHOLD) & (np.diff(off) > 0)

        return score


def scales(rows: list[np.ndarray], y: np.ndarray, n_terms: int) -> np.ndarray:
    """x of each term where a document has it: the square of its evidence of the label (log likelihood ratio of the
    two-by-two table) against the chance maximum over so many terms, 1 at most. Terms without evidence of their own
    keep a share that grows with the documents that they are in, so pairs of them are learned too; none gets 0."""
    n = np.bincount(np.concatenate(rows), minlength=n_terms).astype(float)
    a = np.bincount(np.concatenate([r for r, on in zip(rows, y) if on]), minlength=n_terms).astype(float)
    total, toxic = float(len(rows)), float(np.sum(y))
    cells = ((a, n * toxic), (n - a, n * (total - toxic)), (toxic - a, (total - n) * toxic), (total - toxic - n + a, (total - n) * (total - toxic)))
    g = sum(o * np.log(np.where(o > 0, o * total / np.maximum(e, 1), 1)) for o, e in cells)
    least = n / (n + RARE) / np.sqrt(max(1, n.sum() / total))
    return np.maximum(least, np.minimum(1, g / np.log(2 * n_terms)) ** 2)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, passes: int = PASSES, seed: int = 11, rate: float = 0.05, l2: float = 0.02) -> FactorizationMachine:
    on, at = np.unique(np.concatenate([np.zeros(0, np.int64), *(i for i, _ in rows)]), return_inverse=True)
    if not np.any(y) or not len(on):
        return FactorizationMachine(-35.0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)))
    rows = np.split(at, np.cumsum([len(i) for i, _ in rows])[:-1])
    scale = np.append(scales(rows, y, len(on)), 1.0)
    lin = Ftrl(len(on), alpha=0.3, l1=0.1, l2=0.5)
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 0.05, (len(on), FACTORS))
    gsq = np.full((len(on), FACTORS), 1e-2)
    for _ in range(max(passes, min(3 * passes, STEPS // len(rows)))):
        for r in rng.permutation(len(rows)):
            t = rows[r]
            i = np.append(t, len(on))
            xi, w = scale[i], lin.weights(i)[:, 0]
            x = xi[:-1, None]
            f = v[t] * x
            total = f.sum(0)
            p = probability(np.array([w @ xi + 0.5 * (total @ total - (f * f).sum())]))[0]
            g = p - float(y[r])
            gi = g * xi
            s = (np.sqrt(lin.n[i, 0] + gi * gi) - np.sqrt(lin.n[i, 0])) / lin.alpha
            lin.z[i, 0] += gi - s * w
            lin.n[i, 0] += gi * gi
            if len(t) > 1:
                grad = x * (g * (total - f) + l2 * f)
                gsq[t] += grad**2
                v[t] -= rate * grad / np.sqrt(gsq[t])
    w = lin.weights()[:, 0] * scale
    return FactorizationMachine(float(w[-1]), on, w[:-1], (v * scale[:-1, None]).astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> FactorizationMachine:
    x, y = rows_of(sample(docs, labels, "toxic", rows), terms)
    return fit(x, y)


def score(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """(doc_id, score, toxic) of every row. The model has a fixed number of terms, so what is sent to executors doesn't grow."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value.scorer()
        for b in slices(batches, "text"):
            p, toxic = f(b.column("text"))
            yield pa.record_batch([b.column("doc_id"), pa.array(np.round(p, 6)), pa.array(toxic)], ["doc_id", "score", "toxic"])

    return keyed(docs).mapInArrow(run, "doc_id long, score double, toxic boolean")


def keep(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """The rows of docs that aren't toxic, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value.scorer()
        for b in batches:
            text = pa.record_batch([b.column(at).cast(pa.string())], ["text"])
            toxic = [f(s.column(0))[1] for s in slices([text], "text")]
            yield b.filter(pa.array(~np.concatenate(toxic))) if toxic else b

    return docs.mapInArrow(run, docs.schema)
