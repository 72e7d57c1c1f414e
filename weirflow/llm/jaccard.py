"""N-gram Jaccard join: a grouped prefix join over sets of word 3-grams.

Two documents match where |A & B| / |A | B| >= 3/5. Every set is put in one
global order of n-grams, frequent ones last; sets that match share an n-gram of
their prefixes, the first |A| - ceil(t |A|) + 1 members.

1. Documents with the same prefix and size form a group; only groups are
   indexed, as (n-gram, group) entries spread by n-gram. A task sends an entry of
   a group once, however many documents it has.
2. Group pairs that share a prefix n-gram pass the size filter and the
   positional filter. An entry carries a print of the n-gram before it in its
   prefix: where two entries agree in that too, the pair comes up at the
   earlier n-gram already, so a run of common n-grams gives a pair once.
3. The pairs left are expanded to members; a bitmap of each set, about 2 bits a
   member, drops pairs that can't match, and the rest are verified on the whole
   sets. Documents with equal sets are one class, which is verified once and is
   never gathered: it is a count, a least document and a key of its members.
4. Matching pairs leave a task as numbers of links and as a spanning forest, so
   what is returned grows with the documents and not with their pairs.

The global order needs no exact counts: n-grams found in several documents of
one stretch of input are counted and the most frequent 2^19 come last, by
count; all others by hash. A different order changes the work, never the result.
Sets are compared by 64-bit hashes; a chance agreement of a print (31 bits) and of
the n-gram after it (32 bits inside a bucket) can drop one of a pair's candidates.

A document is a distinct (doc_id, text). Defined results: a null text is an empty
one; rows with null id take no part; texts without words match nothing; a text of
one or two words has one gram, all of it; repeated rows are one document; texts
under one id are several documents, which may match each other; very long texts
are read whole; ties go to the least (doc_id, text hash); empty tables give no
rows; columns beyond doc_id and text, whatever their names, are ignored by
``join`` and kept by ``distinct``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirflow.llm.labelled import keyed
from weirflow.llm.textkit import Words, mix, ngram_hash, slices, unpack
from weirflow.session import by_bucket, finished, made, spread_keys, width, written

N = 3
NUM, DEN = 3, 5  # threshold
FREQUENT = 1 << 19
LOCAL = 2
STRETCH = 1 << 21
#: Most pairs that one hub sends to a place, entries that a task holds before sending them, and n-grams of the corpus to a bucket.
BLOCK_PAIRS = 1 << 20
HELD = 1 << 20
SHARE = 1 << 22

_TOP = np.uint64(1 << 63)
_ONE = np.uint64(1)


def grams(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of all n-grams of a slice, not distinct."""
    w = Words(arr)
    n = np.diff(w.first)
    doc = w.doc()
    ok = np.flatnonzero(np.arange(len(doc)) + N <= np.repeat(w.first[1:], n))
    docs, out = [doc[ok]], [ngram_hash(w.hash, N)[ok]]
    for k in range(1, N):
        short = np.flatnonzero(n == k)
        docs.append(short)
        out.append(ngram_hash(w.hash, k)[w.first[short]] ^ np.uint64(k) if len(short) else np.zeros(0, np.uint64))
    return np.concatenate(docs), np.concatenate(out)


def distinct_sorted(doc: np.ndarray, key: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, key) in order without repeats, and the offsets of each row."""
    o = np.lexsort((key, doc))
    doc, key = doc[o], key[o]
    if len(doc):
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])
        doc, key = doc[new], key[new]
    return doc, key, np.searchsorted(doc, np.arange(rows + 1))


def sums(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, dtype=np.uint64, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def class_keys(key: np.ndarray, off: np.ndarray) -> np.ndarray:
    return mix(sums(mix(key + np.uint64(0x51)), off) + np.diff(off).astype(np.uint64))


def frequent(docs: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """((hashes, sorted, and the rank of each), n-grams of all documents): at most FREQUENT hashes, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, total = [], 0, 0

        def flush():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            on = c >= LOCAL
            return pa.record_batch([h[on].view(np.int64), c[on].astype(np.int64)], ["h", "c"])

        for b in slices(batches, "text"):
            _, h, _ = distinct_sorted(*grams(b.column("text")), b.num_rows)
            held.append(h)
            n += len(h)
            total += len(h)
            if n >= STRETCH:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()
        yield pa.record_batch([pa.array([None], pa.int64()), pa.array([total])], ["h", "c"])

    got = docs.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).orderBy(F.col("h").isNotNull(), F.desc("c"), "h").limit(FREQUENT + 1).toArrow()
    h, c = got["h"].combine_chunks(), got["c"].to_numpy()
    total = int(c[0]) if len(c) else 0
    h, c = h.slice(1).to_numpy(), c[1:]
    h = h.view(np.uint64)[np.lexsort((h, c))]
    o = np.argsort(h)
    return (h[o], o.astype(np.uint64)), total


class Order:
    """Maps hashes to keys whose numeric order is the global order."""

    def __init__(self, frequent: tuple[np.ndarray, np.ndarray]):
        self.h, self.rank = frequent
        self.maybe = np.zeros(1 << 24, bool)
        self.maybe[self.h >> np.uint64(40)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        key = h >> _ONE
        i = np.flatnonzero(self.maybe[h >> np.uint64(40)])
        at = np.searchsorted(self.h, h[i])
        at[at == len(self.h)] = 0
        hit = self.h[at] == h[i] if len(self.h) else np.zeros(len(i), bool)
        key[i[hit]] = _TOP | self.rank[at[hit]]
        return key


ENTRY = [np.uint32, np.uint32, np.uint16, np.uint64, np.uint32]  # tag of the key, print of the one before, position, group, size
MEMBER = [np.int64, np.int64, np.uint64, np.uint64, np.uint32, np.uint8]  # doc_id, text hash, group, class, size, whether the bitmap is there


def parts_of(bucket: np.ndarray, cols: list[np.ndarray], tail: list[bytes] | None = None) -> dict[int, bytes]:
    """Rows packed by bucket, columns one after another, then the tail of each row."""
    o = np.argsort(bucket, kind="stable")
    b, cols = bucket[o], [c[o] for c in cols]
    cutting = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else []
    return {int(b[x]): b"".join([np.int64(y - x).tobytes(), *(c[x:y].tobytes() for c in cols), *([tail[r] for r in o[x:y]] if tail else [])]) for x, y in zip(cutting, [*cutting[1:], len(b)])}


def bits_of(size: np.ndarray) -> np.ndarray:
    """Length of a set's bitmap: the power of two from 2 size on, 64 to 2^16."""
    return 1 << np.clip(np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64), 6, 16)


def bitmaps(key: np.ndarray, off: np.ndarray) -> list[bytes]:
    """Parity bitmaps (Sandes et al., 2020): bit i is the parity of the members that hash to i. Two bitmaps differ in
    at most as many bits as their sets in members, also when the longer is folded by exclusive or."""
    m = bits_of(np.diff(off))
    begin = np.concatenate([[0], np.cumsum(m)])
    doc = np.repeat(np.arange(len(m)), np.diff(off))
    at = begin[:-1][doc] + (mix(key ^ np.uint64(0x77)) & (m[doc] - 1).astype(np.uint64)).astype(np.int64)
    flat = np.packbits((np.bincount(at, minlength=begin[-1]) & 1).astype(np.uint8), bitorder="little")
    return [flat[x // 8 : y // 8].tobytes() for x, y in zip(begin, begin[1:])]


def may_match(size: np.ndarray, marks: list[bytes], x: np.ndarray, y: np.ndarray, words: int = 1 << 20) -> np.ndarray:
    """For pairs (x, y) of sets, given by size and bitmap: False only where they can't reach the threshold. Bitmaps of a
    length are a matrix; pairs of the same two lengths are compared side by side, ``words`` words at a time."""
    need = -(-NUM * (size[x] + size[y]) // (NUM + DEN))
    out = np.minimum(size[x], size[y]) >= need
    length = np.array([len(m) // 8 for m in marks], np.int64)
    row = np.zeros(len(marks), np.int64)
    held = {}
    for n in np.unique(length).tolist():
        at = np.flatnonzero(length == n)
        row[at] = np.arange(len(at))
        held[n] = np.frombuffer(b"".join([marks[k] for k in at]), np.uint64).reshape(-1, n)
    swap = length[x] < length[y]
    long, short = np.where(swap, y, x), np.where(swap, x, y)
    kind = length[long] * (1 << 20) + length[short]
    for k in np.unique(kind[out]).tolist():
        n, m = divmod(k, 1 << 20)
        on = np.flatnonzero(out & (kind == k))
        step = max(1, words // n)
        for at in (on[i : i + step] for i in range(0, len(on), step)):
            a = np.bitwise_xor.reduce(held[n][row[long[at]]].reshape(len(at), n // m, m), 1) if n > m else held[n][row[long[at]]]
            differ = np.bitwise_count(a ^ held[m][row[short[at]]]).sum(1, dtype=np.int64)
            out[at] = differ <= size[x[at]] + size[y[at]] - 2 * need[at]
    return out


def members_of(payloads: list[bytes]) -> tuple:
    cols: list[list[np.ndarray]] = [[] for _ in MEMBER]
    marks: list[bytes | None] = []
    for p in payloads:
        n, at = int(np.frombuffer(p, np.int64, 1)[0]), 8
        for c, d in zip(cols, MEMBER):
            c.append(np.frombuffer(p, d, n, at))
            at += n * np.dtype(d).itemsize
        for m, there in zip((bits_of(cols[-2][-1].astype(np.int64)) // 8).tolist(), cols[-1][-1].tolist()):
            marks.append(p[at : at + m] if there else None)
            at += m if there else 0
    return *(np.concatenate(c) if c else np.zeros(0, d) for c, d in zip(cols, MEMBER)), marks


def indexed(docs: DataFrame, order: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """(bucket, entries, members): prefix entries by n-gram, and members in any bucket, packed."""
    sent = docs.sparkSession.sparkContext.broadcast(order)
    number = np.array(spread_keys(buckets), np.int32)

    def rows(of: dict[int, bytes], column: int) -> pa.RecordBatch:
        cols = [pa.array(list(of.values()), pa.binary()), pa.nulls(len(of), pa.binary())]
        return pa.record_batch([pa.array(number[list(of)]), cols[column], cols[1 - column]], ["bucket", "entries", "members"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_key, seen = Order(sent.value), set()
        held: list[list[np.ndarray]] = []

        def entries() -> pa.RecordBatch:
            bucket, *cols = (np.concatenate(c) for c in zip(*held))
            held.clear()
            return rows(parts_of(bucket, cols), 0)

        for b in slices(batches, "text"):
            doc, h = grams(b.column("text"))
            doc, key, off = distinct_sorted(doc, to_key(h), b.num_rows)
            size = np.diff(off)
            pos = np.arange(len(key)) - off[:-1][doc]
            pre = size - (NUM * size + DEN - 1) // DEN + 1
            on = pos < pre[doc]
            group = mix(sums(np.where(on, mix(key ^ np.uint64(0xA5A5)), np.uint64(0)), off) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            cls, marks = class_keys(key, off), bitmaps(key, off)
            ids, th = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "h"))
            # the bitmap of a class is sent once
            there = np.zeros(b.num_rows, np.uint8)
            there[np.unique(cls, return_index=True)[1]] = 1
            there[size == 0] = 0
            at = int(mix(th[:1].view(np.uint64))[0] % np.uint64(buckets))
            yield rows(parts_of(np.full(b.num_rows, at), [ids, th, group, cls, size.astype(np.uint32), there], [m if x else b"" for m, x in zip(marks, there)]), 1)
            # one document of a group is enough for the index
            lead = np.zeros(b.num_rows, bool)
            for g, r in zip(*(x.tolist() for x in np.unique(group, return_index=True))):
                if g not in seen:
                    seen.add(g)
                    lead[r] = True
            before = np.concatenate([[np.uint64(0)], key[:-1]]) if len(key) else key
            fp = np.where(pos > 0, (mix(before) >> np.uint64(32)).astype(np.uint32) | np.uint32(1), np.uint32(0))
            on &= lead[doc]
            e = np.flatnonzero(on)
            # inside a bucket 32 bits of the key do: where they agree by chance, a pair more is verified
            tag = mix(key[e])
            held.append([(tag % np.uint64(buckets)).astype(np.int32), (tag >> np.uint64(32)).astype(np.uint32), fp[e], np.minimum(pos[e], 65535).astype(np.uint16), group[doc[e]], size[doc[e]].astype(np.uint32)])
            if sum(len(c[0]) for c in held) >= HELD:
                yield entries()
        if held:
            yield entries()

    return docs.mapInArrow(run, "bucket int, entries binary, members binary")


def pairs_in(key: np.ndarray, fp: np.ndarray, pos: np.ndarray, group: np.ndarray, size: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Group pairs (a < b) that pass the filters, in pieces."""
    o = np.lexsort((group, size, key))
    key, fp, pos, group, size = key[o], fp[o], pos[o].astype(np.int64), group[o], size[o].astype(np.int64)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1]) | (size[1:] != size[:-1])
    key, fp, pos, group, size = key[new], fp[new], pos[new], group[new], size[new]
    if not len(key):
        return
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
    # partners follow their entry, up to size / t
    span = run * (1 << 40) + size
    to = np.searchsorted(span, run * (1 << 40) + size * DEN // NUM, "right")
    count = to - np.arange(len(key)) - 1
    has = np.flatnonzero(count > 0)
    ends = np.cumsum(count[has])
    at = 0
    while at < len(has):
        z = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        i = has[at:z]
        at = z
        x = np.repeat(i, count[i])
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(count[i]) - count[i], count[i])
        need = (NUM * (size[x] + size[y]) + NUM + DEN - 1) // (NUM + DEN)
        ok = (1 + np.minimum(size[x] - pos[x], size[y] - pos[y]) - 1 >= need) & ((fp[x] != fp[y]) | (fp[x] == 0))
        x, y = x[ok], y[ok]
        yield np.minimum(group[x], group[y]), np.maximum(group[x], group[y])


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    o = np.lexsort((b, a))
    a, b = a[o], b[o]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def candidates(docs: DataFrame) -> tuple[DataFrame, int]:
    """(written rows (a, b, doc_id, h, size, marks): group pairs, or with doc_id and text hash a member: group a, class b,
    with its bitmap for some of each class; buckets)."""
    order, total = frequent(docs)
    buckets = max(width(docs.sparkSession), -(-total // SHARE))

    def run(t: pa.Table) -> pa.Table:
        entries = unpack(t.column("entries").drop_null().to_pylist(), ENTRY)
        doc_id, th, group, cls, size, _, marks = members_of(t.column("members").drop_null().to_pylist())
        found = [np.zeros(0, np.uint64)] * 2
        held: list[tuple] = []
        for p in pairs_in(*entries):
            held.append(p)
            if sum(len(x[0]) for x in held) > 1 << 20:
                found = distinct_pairs(*(np.concatenate(x) for x in zip(found, *held)))
                held = []
        a, b = distinct_pairs(*(np.concatenate(x) for x in zip(found, *held))) if held else found
        k, m = len(a), len(doc_id)
        return pa.table({
            "a": np.concatenate([a, group]).view(np.int64),
            "b": np.concatenate([b, cls]).view(np.int64),
            "doc_id": pa.array(np.concatenate([np.zeros(k, np.int64), doc_id]), mask=np.arange(k + m) < k),
            "h": np.concatenate([np.zeros(k, np.int64), th]),
            "size": np.concatenate([np.zeros(k, np.int32), size.astype(np.int32)]),
            "marks": pa.array([None] * k + marks, pa.binary()),
        })

    return written(by_bucket(indexed(docs, order, buckets), buckets).applyInArrow(run, "a long, b long, doc_id long, h long, size int, marks binary")), buckets


def members_in(found: DataFrame) -> DataFrame:
    """Written (doc_id, h, grp, cls, size, times): each document once, with the number of its rows."""
    one = found.where("doc_id IS NOT NULL").groupBy("doc_id", "h").agg(F.max("a").alias("grp"), F.max("b").alias("cls"), F.max("size").alias("size"), F.count("*").alias("times"))
    return written(one)


def classes_of(members: DataFrame) -> DataFrame:
    """Written (grp, cls, size, n, rep, h): documents with equal n-gram sets, their number and the least of them."""
    c = members.where("size > 0").groupBy("grp", "cls").agg(F.max("size").alias("size"), F.count("*").alias("n"), F.min(F.struct("doc_id", "h")).alias("least"))
    return written(c.select("grp", "cls", "size", "n", F.col("least.doc_id").alias("rep"), F.col("least.h").alias("h")))


def placed(pairs: DataFrame, places: int) -> DataFrame:
    """Written (x, y, at): where each pair is looked at. Pairs whose x have the same least neighbour (for near copies of
    one document: all) go to one place, so that what they need of a class is sent there once; large ones are split into
    blocks. The tables on the way there are deleted."""
    since = made()
    pairs = written(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")))
    both = pairs.union(pairs.select("y", "x")).toDF("v", "w")
    near = both.groupBy("v").agg(F.least("v", F.min("w")).alias("hub"))
    hub = finished(pairs.join(near.toDF("x", "hub"), "x"), since)
    large = hub.groupBy("hub").agg(F.ceil(F.sqrt(F.count("*") / BLOCK_PAIRS)).alias("k")).where("k > 1")
    k = F.coalesce("k", F.lit(1))
    at = F.pmod(F.xxhash64("hub", F.pmod("x", k), F.pmod("y", k)), F.lit(places)).cast("int")
    return finished(hub.join(large, "hub", "left").select("x", "y", at.alias("at")), since)


def sent_to(pairs: DataFrame) -> DataFrame:
    """(cls, to): where each class is needed."""
    return pairs.select(F.explode(F.array("x", "y")).alias("cls"), F.col("at").alias("to")).distinct()


def local_roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least vertex that each of n vertices is connected with by the edges (u, v)."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        on = a != b
        if not on.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[on], np.minimum(a, b)[on])
        while (root[root] != root).any():
            root = root[root]


def matching(texts: Iterator[pa.RecordBatch], x: np.ndarray, y: np.ndarray, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(classes, their documents, x, y, common): of pairs of classes those that match, as rows of ``classes``."""
    cls, n, keys, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for b in slices(texts, "text"):
        _, key, off = distinct_sorted(*grams(b.column("text")), b.num_rows)
        cls.append(b.column("cls").to_numpy())
        n.append(b.column("n").to_numpy())
        keys.append(key)
        size.append(np.diff(off))
    cls, n, key, size = (np.concatenate(c) for c in (cls, n, keys, size))
    known, key = np.unique(key, return_inverse=True)
    first = np.concatenate([[0], np.cumsum(size)])
    by = np.argsort(cls)
    x, y = (by[np.searchsorted(cls, v, sorter=by)] for v in (x, y))
    o = np.argsort(x, kind="stable")
    x, y = x[o], y[o]
    common = np.zeros(len(x), np.int64)
    mark = np.zeros(len(known), bool)
    begin = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else []
    for a, z in zip(begin, [*begin[1:], len(x)]):  # all partners of one class side by side
        own = key[first[x[a]] : first[x[a] + 1]]
        mark[own] = True
        ends = np.cumsum(size[y[a:z]])
        while a < z:
            to = a + max(1, int(np.searchsorted(ends, (ends[0] - size[y[a]]) + most, "right")))
            m = size[y[a:to]]
            start = np.cumsum(m) - m
            at = np.repeat(first[y[a:to]] - start, m) + np.arange(int(m.sum()))
            common[a:to] = np.add.reduceat(mark[key[at]].astype(np.int64), start)
            a, ends = to, ends[to - a :]
        mark[own] = False
    ok = DEN * common >= NUM * (size[x] + size[y] - common)
    return cls, n, x[ok], y[ok], common[ok]


def verified(docs: DataFrame, found: DataFrame, classes: DataFrame, places: int) -> DataFrame:
    """Written (x, y, links): class x has ``links`` further documents as links, or with y x and y are connected. The edges
    of a place are a forest."""
    members = classes.select("grp", "cls")
    # spread by a once: both distinct pairs and the join on a find them there
    groups = found.where("doc_id IS NULL").select("a", "b").repartition("a").distinct()
    several = members.groupBy("grp").agg(F.count("*").alias("k")).where("k > 1").select(F.col("grp").alias("a"), F.col("grp").alias("b"))
    a, b = members.toDF("a", "x"), members.toDF("b", "y")
    across = groups.where("a <> b").join(a, "a").join(b, "b").select("x", "y")
    within = several.join(a, "a").join(b, "b").where("x < y").select("x", "y")
    expanded = across.union(within)
    pairs = placed(expanded, places)
    bitmap = found.where("marks IS NOT NULL").groupBy(F.col("b").alias("cls")).agg(F.first("size").alias("size"), F.first("marks").alias("marks"))
    marks = sent_to(pairs).join(bitmap, "cls").select("to", "cls", "size", "marks")

    def possible(marks: pa.Table, pairs: pa.Table) -> pa.Table:
        cls, size = (marks.column(c).to_numpy() for c in ("cls", "size"))
        by = np.argsort(cls)
        x, y = (by[np.searchsorted(cls, pairs.column(c).to_numpy(), sorter=by)] for c in ("x", "y"))
        return pairs.select(["x", "y"]).filter(pa.array(may_match(size.astype(np.int64), marks.column("marks").to_pylist(), x, y)))

    pairs = placed(marks.groupBy("to").cogroup(pairs.groupBy("at")).applyInArrow(possible, "x long, y long"), places)
    wanted = (
        sent_to(pairs).join(classes.select("cls", "rep", "h", "n"), "cls")
        .groupBy(F.col("rep").alias("doc_id"), "h", "cls", "n").agg(F.collect_list("to").alias("ats"))
    )

    def check(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        cls, n, x, y, _ = matching(texts.combine_chunks().to_batches(), *(pairs.column(c).to_numpy() for c in ("x", "y")))
        links = (np.bincount(x, n[y], len(cls)) + np.bincount(y, n[x], len(cls))).astype(np.int64)
        root = local_roots(len(cls), x, y)
        some, leaf = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(root)))
        return pa.table({
            "x": np.concatenate([cls[some], cls[leaf]]),
            "y": pa.array(np.concatenate([cls[some], cls[root[leaf]]]), mask=np.arange(len(some) + len(leaf)) < len(some)),
            "links": pa.array(np.concatenate([links[some], links[leaf]]), mask=np.arange(len(some) + len(leaf)) >= len(some)),
        })

    texts = docs.join(wanted, ["doc_id", "h"]).select(F.explode("ats").alias("at"), "cls", "n", "text")
    return written(texts.groupBy("at").cogroup(pairs.groupBy("at")).applyInArrow(check, "x long, y long, links long"))


def usable(docs: DataFrame) -> DataFrame:
    """(doc_id, text, h); a null text is an empty one."""
    return keyed(docs).where("doc_id IS NOT NULL").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("h", F.xxhash64("text"))


def once(docs: DataFrame, i: str, h: str) -> DataFrame:
    """docs without the rows of a document that a task has seen already: a document of very many rows leaves one a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            keys = zip(b.column(i).to_pylist(), b.column(h).to_pylist())
            yield b.filter(pa.array([k not in seen and not seen.add(k) for k in keys], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of vertices with an edge (u, v), but roots: the least vertex that v is connected with, by alternating
    large and small stars. Minima are partial aggregates and joined back, so a vertex with very many edges is no task."""
    both = lambda e: e.select("u", "v").union(e.select(F.col("v"), F.col("u"))).toDF("u", "v")
    e = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    last = None
    while True:
        mark = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == last:
            return e.select(F.col("u").alias("v"), F.col("v").alias("root"))
        last = mark
        near = both(e)
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = written(near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        e = written(small.where("u <> v").distinct())


def classified(docs: DataFrame) -> DataFrame:
    """(doc_id, h, size, times, keeper, keeper_h, links) of every document: ``keeper`` is the least document that it is
    connected with by links, itself where it has none, and ``links`` the number of documents that match it."""
    d = usable(docs)
    found, buckets = candidates(d)
    members = members_in(found)
    classes = classes_of(members)
    if not members.where("times > 1").isEmpty():
        d = once(d, "doc_id", "h")
    got = verified(d, found, classes, 2 * buckets)
    links = got.where("y IS NULL").groupBy(F.col("x").alias("cls")).agg(F.sum("links").alias("others"))
    joined = components(got.where("y IS NOT NULL").select(F.col("x").alias("u"), F.col("y").alias("v")))
    root = joined.union(joined.select("root").distinct().select("root", F.col("root").alias("r"))).toDF("cls", "root")
    least = root.join(classes, "cls").groupBy("root").agg(F.min(F.struct("rep", "h")).alias("k"))
    of = root.join(least, "root").select("cls", "k")
    by_class = classes.join(of, "cls", "left").join(links, "cls", "left").select(
        "cls", F.coalesce("k.rep", "rep").alias("keeper"), F.coalesce("k.h", "h").alias("keeper_h"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("links")
    )
    some = members.where("size > 0").join(by_class, "cls").select("doc_id", "h", "size", "times", "keeper", "keeper_h", "links")
    none = members.where("size = 0").select("doc_id", "h", "size", "times", F.col("doc_id").alias("keeper"), F.col("h").alias("keeper_h"), F.lit(0).cast("long").alias("links"))
    return some.unionByName(none)


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, links) of every document: the least id that it is connected with by links, and the number of
    documents that match it, copies included. No link is left out; none is a row of its own."""
    return classified(docs).select("doc_id", F.col("keeper").alias("class_id"), "links")


_ID, _HASH = "weirflow id", "weirflow hash"


def distinct(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one document of each class: the least (doc_id, text hash), in one row; which of its rows
    isn't defined where others of their columns differ. Rows that nothing can be said of, without id, text or words, stay."""
    c = written(classified(docs).where("size > 0").select(F.col("doc_id").alias(_ID), F.col("h").alias(_HASH), F.expr("doc_id <> keeper OR h <> keeper_h").alias("gone"), "times").where("gone OR times > 1"))
    given = docs.withColumns({_ID: docs["doc_id"].cast("long"), _HASH: F.xxhash64(docs["text"].cast("string"))})
    own = [F.col(f"`{x}`") for x in docs.columns]
    # what goes grows with the corpus: never broadcast
    kept = given.join(c.select(_ID, _HASH).hint("merge"), [_ID, _HASH], "left_anti").select(own)
    again = c.where("NOT gone").select(_ID, _HASH)
    if again.isEmpty():
        return kept
    return kept.union(once(given, _ID, _HASH).join(again.hint("merge"), [_ID, _HASH], "left_semi").dropDuplicates([_ID, _HASH]).select(own))
