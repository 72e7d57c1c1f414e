"""Mixing sources to target weights.

1. Tokens (runs of non-blanks) of each source are packed into blocks of BLOCK:
   documents follow one another by (bucket of the id, id, text), the last block
   of a source is shorter. Bucket totals make the place of every document known
   without an order over the whole source, so a hot source is spread like any.
2. The output has as many slots as there are blocks, in shards of SHARD. Each
   shard draws its source counts from a multinomial seeded by its number.
3. The slots of a source are numbered through all shards; number r reads block
   permutation(r mod n) of the source's n blocks, where the permutation is a
   Feistel network with cycle walking, keyed by source and by the pass r div n.
   So a source is read whole before any block comes again, and any slot is
   known from its number alone.
4. Slots are joined with blocks by (source, block).

Weights: ``weights`` maps sources to targets, and sources it doesn't name get
none. Without it a source weighs its tokens to the power ALPHA, which lifts
small sources.

Defined results: rows with null id, null text or no tokens give no tokens; a
null source is the source ''; a text of any length is cut into as many blocks as
it fills; repeated rows count as often as they come; empty tables give no slots;
columns beyond doc_id, text and source, whatever their names, are ignored, and
null in ``mixed_documents``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirflow.llm.textkit import buffers, mix, slices
from weirflow.session import written

BLOCK = 1024
SHARD = 4096
BUCKETS = 4096
ALPHA = 0.7
SEED = 20

_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\r\x0b\x0c")] = True


def token_spans(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start and end of each token, first token of each row)."""
    raw, off = buffers(arr)
    solid = ~_BLANK[raw]
    before = np.zeros(len(raw) + 1, bool)
    before[1:] = solid
    before[off] = False
    after = np.zeros(len(raw) + 1, bool)
    after[: len(raw)] = solid
    after[off] = False
    start = np.flatnonzero(solid & ~before[:-1])
    return raw, start, np.flatnonzero(solid & ~after[1:]) + 1, np.searchsorted(start, off)


def placed(docs: DataFrame) -> DataFrame:
    """(source, bucket, doc_id, text) of the rows that have tokens to give."""
    return docs.select(
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(BUCKETS)).cast("int").alias("bucket"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    ).where("doc_id IS NOT NULL AND text IS NOT NULL")


def totals(docs: DataFrame) -> DataFrame:
    """(source, bucket, n): tokens of each bucket; at most sources x BUCKETS rows, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            n = np.diff(token_spans(b.column("text"))[3])
            yield pa.RecordBatch.from_arrays([b.column("source"), b.column("bucket"), pa.array(n)], ["source", "bucket", "n"])

    return docs.mapInArrow(run, "source string, bucket int, n long").groupBy("source", "bucket").agg(F.sum("n").alias("n"))


def pieces(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """((source, block, at, n, ids, texts) pieces of blocks, (source, tokens)): a piece is what one bucket gives to a block,
    document by document."""
    per = written(totals(docs))
    begin = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the place where a bucket begins travels as the bucket's first row: no join, nothing to broadcast
    heads = per.select("source", "bucket", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), begin.alias("begin"))
    d = docs.withColumn("begin", F.lit(None).cast("long")).unionByName(heads).repartition("source", "bucket").sortWithinPartitions("source", "bucket", F.asc_nulls_first("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        open_: tuple | None = None  # (source, block, place in block, tokens, [ids], [texts])
        for b in slices(batches, "text"):
            raw, start, end, first = token_spans(b.column("text"))
            out: list[tuple] = []
            data = raw.tobytes()
            for r, (s, i, begin) in enumerate(zip(*(b.column(c).to_pylist() for c in ("source", "doc_id", "begin")))):
                if begin is not None:
                    if open_:
                        out.append(open_)
                    open_, at = None, begin
                x, last = int(first[r]), int(first[r + 1])
                while x < last:
                    y = min(last, x + block - at % block)
                    text = data[start[x] : end[y - 1]]
                    if open_ is None:
                        open_ = (s, at // block, at % block, y - x, [i], [text])
                    else:
                        open_ = (*open_[:3], open_[3] + y - x, *open_[4:])
                        open_[4].append(i)
                        open_[5].append(text)
                    at += y - x
                    x = y
                    if at % block == 0:
                        out.append(open_)
                        open_ = None
            if out:
                yield rows(out)
        if open_:
            yield rows([open_])

    def rows(out: list[tuple]) -> pa.RecordBatch:
        s, k, at, n, i, t = zip(*out)
        texts = pa.array(t, pa.list_(pa.binary())).cast(pa.list_(pa.string()))
        return pa.record_batch([pa.array(s, pa.string()), pa.array(k, pa.int64()), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(i, pa.list_(pa.int64())), texts], ["source", "block", "at", "n", "ids", "texts"])

    return d.mapInArrow(run, "source string, block long, at int, n int, ids array<long>, texts array<string>"), per.groupBy("source").agg(F.sum("n").alias("tokens")).where("tokens > 0")


_ROUND = np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def feistel(x: np.ndarray, n: int, key: np.ndarray) -> np.ndarray:
    """A permutation of range(n) for each key (one for each x): four rounds over the least even number of bits, walked into range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        v = out[todo]
        left, right = v >> np.uint64(half), v & mask
        for k in range(4):
            left, right = right, left ^ (mix(right + key[todo] + _ROUND[k]) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def seed_of(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little")


def slots(spark, n_blocks: dict[str, int], weights: dict[str, float], count: int, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(slot, shard, source, pass, block) of every slot."""
    names = sorted(s for s in n_blocks if weights.get(s, 0) > 0 and n_blocks[s] > 0)
    if not names or not count:
        return spark.createDataFrame([], "slot long, shard long, source string, pass long, block long")
    w = np.array([weights[s] for s in names], float)
    w /= w.sum()

    def draw(shards: np.ndarray) -> np.ndarray:
        return np.array([np.random.default_rng(seed_of(seed, int(k))).multinomial(min(shard, count - int(k) * shard), w) for k in shards]).reshape(-1, len(names))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column("id").to_numpy()
            c = draw(k)
            yield pa.record_batch([np.repeat(k, len(names)), np.tile(np.arange(len(names)), len(k)), c.ravel()], ["shard", "s", "n"])

    per = spark.range(math.ceil(count / shard)).mapInArrow(drawn, "shard long, s long, n long")
    before = per.withColumn("before", F.sum("n").over(Window.partitionBy("s").orderBy("shard")) - F.col("n"))
    before = before.withColumn("at", F.sum("n").over(Window.partitionBy("shard").orderBy("s")) - F.col("n")).where("n > 0")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, s, n, before, at in zip(*(b.column(c).to_pylist() for c in ("shard", "s", "n", "before", "at"))):
                r = before + np.arange(n)
                m = n_blocks[names[s]]
                keys = np.array([seed_of(seed, names[s], int(p)) for p in range(r[0] // m, r[-1] // m + 1)], np.uint64)
                block = feistel(r % m, m, keys[r // m - r[0] // m])
                # places in the shard are shuffled, so that sources alternate
                place = feistel(at + np.arange(n), (size := min(shard, count - k * shard)), np.full(n, seed_of(seed, "place", k), np.uint64))
                assert size
                yield pa.record_batch([pa.array(k * shard + place), pa.array(np.full(n, k)), pa.array([names[s]] * n), pa.array(r // m), pa.array(block)], ["slot", "shard", "source", "pass", "block"])

    return before.mapInArrow(numbered, "slot long, shard long, source string, pass long, block long")


def target(tokens: dict[str, int], weights: dict[str, float] | None = None, alpha: float = ALPHA) -> dict[str, float]:
    w = weights if weights is not None else {s: float(n) ** alpha for s, n in tokens.items()}
    all_ = sum(w.get(s, 0) for s in tokens) or 1
    return {s: w.get(s, 0) / all_ for s in tokens}


def filled(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(slot, shard, source, pass, block, n_tokens, ids, texts) of every slot: its tokens document by document."""
    parts, per = pieces(placed(docs), block)
    tokens = {r["source"]: r["tokens"] for r in per.collect()}  # a row for each source
    n_blocks = {s: -(-n // block) for s, n in tokens.items()}
    picked = slots(docs.sparkSession, n_blocks, target(tokens, weights), sum(n_blocks.values()), shard, seed)
    held = F.array_sort(F.collect_list(F.struct("at", "ids", "texts"))).alias("held")
    blocks = parts.groupBy("source", "block").agg(F.sum("n").cast("int").alias("n_tokens"), held)
    blocks = blocks.select("source", "block", "n_tokens", F.flatten("held.ids").alias("ids"), F.flatten("held.texts").alias("texts"))
    # the slots grow with the corpus, which a plan over range() can't know: never broadcast
    return picked.hint("merge").join(blocks, ["source", "block"]).select("slot", "shard", "source", "pass", "block", "n_tokens", "ids", "texts")


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(slot, shard, source, pass, block, n_tokens, text) of every slot."""
    return filled(docs, weights, block, shard, seed).select("slot", "shard", "source", "pass", "block", "n_tokens", F.array_join("texts", "\n").alias("text"))


def mixed_documents(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """The mixture with the columns of docs: a row for what each document gives to a slot, under the id of the document;
    columns that a block doesn't have are null. A block that is drawn again comes again."""
    m = filled(docs, weights, block).select("source", F.explode(F.arrays_zip("ids", "texts")).alias("d"))
    own = {"doc_id": F.col("d.ids"), "text": F.col("d.texts"), "source": F.col("source"), "n_chars": F.length("d.texts")}
    return m.select(*[(own[c] if c in own else F.lit(None)).cast(t).alias(c) for c, t in docs.dtypes])
