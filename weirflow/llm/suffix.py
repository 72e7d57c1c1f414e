"""Suffix-array dedup of passages: deep-shallow sorting (Manzini and Ferragina, 2004).

A word is *repeated* where some window of 50 words that covers it occurs at
least twice in the corpus, in other documents or elsewhere in its own. All
occurrences of a window but the first, by (doc_id, text hash, position), are to
be removed; a word that any of them covers is *removed*, another repeated word
is *kept*.

Distribution: every window names an anchor, its least 8-word hash (leftmost of
ties), so equal windows have equal anchors at the same place, and about 1 word
in 22 is an anchor. A task sends one occurrence of each anchor, and a flag where
it has several, to the anchor's bucket; anchors that occur once end there.
Occurrences of the others with the same words all around, each word as 32 bits of
its hash, are one class. A task sends the words of a class once; how many
occurrences a class has and which is the first are aggregates, and occurrences
themselves are never gathered: passages with any number of copies are a few
classes in their bucket. There the suffixes of the classes, one for each window,
are sorted:

- shallow: multikey quicksort, three-way by one word, all segments at once, to a
  depth of SHALLOW words;
- deep: a segment that is still together has a long common prefix; a blind trie
  orders it, with one comparison of words for each insertion. Segments of two
  need a single comparison and are done side by side.

Neighbours whose common prefix is 50 words or more are the same window. What the
sort says of a class is joined to its occurrences by the key of the class. One
phrase of 8 to 49 words with very many different surroundings has as many classes,
which all are in its bucket, about 0.4 KB each.

Defined results: rows with null id or null text take no part; texts under 50
words have no window; repeated rows of an id and text are one document; ids
with several texts are several documents; ties go to the least (doc_id, text
hash, position); very long texts are read whole; empty tables give no rows; other
columns, whatever their names, are ignored by ``spans`` and kept by ``removed``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.labelled import keyed
from weirflow.llm.textkit import Words, buffers, mix, ngram_hash, slices, span_hash
from weirflow.session import by_bucket, spread_keys, width, written

WINDOW = 50
GRAM = 8
SHALLOW = 8
#: Anchors that a task holds before sending them, and bytes of text to a bucket.
HELD = 1 << 20
SHARE = 1 << 26

_REACH = WINDOW - GRAM + 1  # 8-word hashes in a window


# --- anchors ---------------------------------------------------------------


def anchors(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, anchor, first window, last window, hash); positions are word indices of the slice."""
    g = ngram_hash(w.hash, GRAM)
    n = len(w.hash) - WINDOW + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, np.zeros(0, np.uint64)
    low, at, have = g.copy(), np.arange(len(g), dtype=np.int32), 1

    def step(low: np.ndarray, at: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
        m = len(low) - by
        right = low[by:] < low[:m]
        return np.where(right, low[by:], low[:m]), np.where(right, at[by:], at[:m])

    while have * 2 <= _REACH:
        low, at = step(low, at, have)
        have *= 2
    low, at = step(low, at, _REACH - have) if _REACH > have else (low, at)
    doc = w.doc()
    p = np.flatnonzero(np.arange(n) + WINDOW <= w.first[1:][doc[:n]])
    if not len(p):
        return none, none, none, none, np.zeros(0, np.uint64)
    a = at[p].astype(np.int64)
    d = doc[p]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (d[1:] != d[:-1])]))
    last = np.append(new[1:], len(p)) - 1
    return d[new], a[new], p[new], p[last], g[a[new]]


def columns(*cols: np.ndarray) -> bytes:
    return np.int64(len(cols[0])).tobytes() + b"".join(c.tobytes() for c in cols)


def read(p: bytes | pa.Buffer, *dtypes) -> tuple[list[np.ndarray], int]:
    n, at, out = int(np.frombuffer(p, np.int64, 1)[0]), 8, []
    for d in dtypes:
        out.append(np.frombuffer(p, d, n, at))
        at += n * np.dtype(d).itemsize
    return out, at


def split(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, row numbers) of each bucket."""
    o = np.argsort(bucket, kind="stable")
    b = bucket[o]
    edge = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else []
    for x, y in zip(edge, [*edge[1:], len(b)]):
        yield int(b[x]), o[x:y]


def unseen(b: pa.RecordBatch, seen: set) -> pa.RecordBatch:
    """Rows of documents that aren't in ``seen`` yet: a task takes a repeated row once."""
    keys = zip(b.column("doc_id").to_pylist(), b.column("h").to_pylist())
    on = [k not in seen and not seen.add(k) for k in keys]
    return b if all(on) else b.filter(pa.array(on, pa.bool_()))


def by_document(pos: np.ndarray, i: np.ndarray, th: np.ndarray) -> pa.Table:
    """(doc_id, h, at): positions of each document, packed."""
    o = np.lexsort((pos, th, i))
    pos, i, th = pos[o].astype(np.uint32), i[o], th[o]
    edge = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (th[1:] != th[:-1])])) if len(i) else np.zeros(0, np.int64)
    return pa.table({"doc_id": i[edge], "h": th[edge], "at": pa.array([pos[x:y].tobytes() for x, y in zip(edge, [*edge[1:], len(i)])], pa.binary())})


def anchor_hashes(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, part, known): one occurrence of each anchor of a task, by hash: (hash, position, whether the task has
    several, doc_id, text hash); ``known`` has all occurrences of those, in any bucket."""
    number = np.array(spread_keys(buckets), np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        held: list[list[np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            h, pos, i, th = (np.concatenate(c) for c in zip(*held))
            held.clear()
            u, first, back, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            several = (n > 1).astype(np.uint8)
            ks, ps, known = [], [], []
            for k, r in split((u % np.uint64(buckets)).astype(np.int64)):
                f = first[r]
                ks.append(k)
                ps.append(columns(u[r], pos[f], several[r], i[f], th[f]))
                known.append(None)
            on = np.flatnonzero(several[back])
            for k, r in split((mix(th[on].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)):
                ks.append(k)
                ps.append(None)
                known.append(columns(pos[on[r]], i[on[r]], th[on[r]]))
            return pa.record_batch([pa.array(number[np.array(ks, np.int64)]), pa.array(ps, pa.binary()), pa.array(known, pa.binary())], ["bucket", "part", "known"])

        for b in slices(batches, "text", 4 << 20):
            b = unseen(b, seen)
            w = Words(b.column("text"))
            d, a, _, _, h = anchors(w)
            ids, th = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "h"))
            held.append([h, (a - w.first[d]).astype(np.uint32), ids[d], th[d]])
            if sum(len(x[0]) for x in held) >= HELD:
                yield flush()
        if held:
            yield flush()

    return docs.mapInArrow(run, "bucket int, part binary, known binary")


def repeated_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, h, ats): positions of anchors that occur more than once, for each document."""

    def run(t: pa.Table) -> pa.Table:
        def all_of(column: str, *dtypes) -> list[np.ndarray]:
            parts = [read(p, *dtypes)[0] for p in t.column(column).drop_null().to_pylist()]
            return [np.concatenate([np.zeros(0, k), *(p[c] for p in parts)]) for c, k in enumerate(dtypes)]

        h, pos, several, i, th = all_of("part", np.uint64, np.uint32, np.uint8, np.int64, np.int64)
        o = np.lexsort((several, pos, th, i, h))
        h, pos, several, i, th = h[o], pos[o], several[o], i[o], th[o]
        last = np.ones(len(h), bool)
        last[:-1] = (h[1:] != h[:-1]) | (pos[1:] != pos[:-1]) | (i[1:] != i[:-1]) | (th[1:] != th[:-1])
        h, pos, several, i, th = (x[last] for x in (h, pos, several, i, th))
        run_of = np.cumsum(np.concatenate([[False], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        twice = (np.bincount(run_of, 1.0 + several) > 1)[run_of] & (several == 0)  # the others are known
        own = all_of("known", np.uint32, np.int64, np.int64)
        return by_document(*(np.concatenate([x[twice], y]) for x, y in zip((pos, i, th), own)))

    found = by_bucket(anchor_hashes(docs, buckets), buckets).applyInArrow(run, "doc_id long, h long, at binary")
    return found.groupBy("doc_id", "h").agg(F.collect_set("at").alias("ats"))


def contexts(docs: DataFrame, repeated: DataFrame, buckets: int) -> DataFrame:
    """Occurrences of repeated anchors, (bucket, ctx, doc_id, h, p0): class and first word; and, where ``part`` is set, the
    words of classes, packed by bucket."""
    number = np.array(spread_keys(buckets), np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sent = set(), set()
        for b in slices(batches, "text", 4 << 20):
            b = unseen(b, seen)
            w = Words(b.column("text"))
            d, a, p0, p1, h = anchors(w)
            wanted = np.zeros(len(w.hash), bool)
            for r, ats in enumerate(b.column("ats").to_pylist()):
                wanted[w.first[r] + np.concatenate([np.frombuffer(x, np.uint32) for x in ats]).astype(np.int64)] = True
            on = wanted[a]
            d, a, p0, p1, h = d[on], a[on], p0[on], p1[on], h[on]
            left, n = (a - p0).astype(np.uint8), (p1 - p0).astype(np.uint8)
            code = (w.hash >> np.uint64(32)).astype(np.uint32)
            ctx = mix(span_hash(code)(p0, p1 + WINDOW) + mix(h + (left.astype(np.uint64) << np.uint64(8) | n)))
            ids, th = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "h"))
            bucket = (h % np.uint64(buckets)).astype(np.int64)
            u, first = np.unique(ctx, return_index=True)
            new = np.array([f for c, f in zip(u.tolist(), first.tolist()) if c not in sent and not sent.add(c)], np.int64)
            ks, ps = [], []
            for k, r in split(bucket[new]):
                r = new[r]
                m = n[r].astype(np.int64) + WINDOW
                words = np.repeat(p0[r] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
                ks.append(k)
                ps.append(columns(ctx[r], h[r], left[r], n[r]) + columns(code[words]))
            none = len(ks)
            pad = lambda x, kind: pa.concat_arrays([pa.nulls(none, kind), pa.array(x, kind)])
            yield pa.record_batch(
                [pa.array(number[np.concatenate([np.array(ks, np.int64), bucket])]), pad(ctx.view(np.int64), pa.int64()), pad(ids[d], pa.int64()), pad(th[d], pa.int64()), pad(p0 - w.first[d], pa.int64()), pa.concat_arrays([pa.array(ps, pa.binary()), pa.nulls(len(d), pa.binary())])],
                ["bucket", "ctx", "doc_id", "h", "p0", "part"],
            )

    given = docs.join(repeated, ["doc_id", "h"]).select("doc_id", "h", "text", "ats")
    return written(given.mapInArrow(run, "bucket int, ctx long, doc_id long, h long, p0 long, part binary"))


# --- deep-shallow sort -----------------------------------------------------


def shallow(code: np.ndarray, at: np.ndarray, seg: np.ndarray, depth: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the suffixes ``at`` inside each segment (seg is sorted), to ``depth`` words:
    (order, segment of each), where suffixes that agree in all those words share a segment."""
    order = np.arange(len(at))
    seg = np.concatenate([[0], np.cumsum(seg[1:] != seg[:-1])]) if len(at) else seg
    d = np.zeros(len(at), np.int64)  # words known equal in the segment
    while True:
        first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]])) if len(seg) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(seg)))
        run = np.repeat(np.arange(len(first)), n)
        on = np.flatnonzero((n[run] > 1) & (d < depth)) if len(run) else run
        if not len(on):
            return order, run
        key = code[at[order[on]] + d[on]]
        mid = code[at[order[first + n // 2]] + np.minimum(d[first + n // 2], depth - 1)][run[on]]
        side = 1 + (key > mid).astype(np.int64) - (key < mid)
        o = np.lexsort((side, run[on]))
        order[on], side, dd = order[on][o], side[o], d[on][o]
        d[on] = dd + (side == 1)
        three = run * 3
        three[on] += side
        seg = three


def common(code: np.ndarray, x: np.ndarray, y: np.ndarray, limit: int = WINDOW) -> np.ndarray:
    """Common prefix, in words, of the suffixes x[i] and y[i], up to limit."""
    lcp = np.full(len(x), limit)
    on = np.arange(len(x))
    for k in range(limit):
        off = code[x[on] + k] != code[y[on] + k]
        lcp[on[off]] = k
        on = on[~off]
        if not len(on):
            break
    return lcp


class BlindTrie:
    """Patricia trie of suffixes: a node knows its depth and the word each branch starts with; the words
    skipped on the way down are never looked at. Each insertion compares with one leaf only."""

    def __init__(self, code: np.ndarray, limit: int = WINDOW):
        self.code, self.limit = code, limit
        self.root: list | None = None  # a node is [depth, {word: node}, suffix of some leaf, suffixes that are equal]

    def insert(self, s: int) -> None:
        text = self.code[s : s + self.limit]
        if self.root is None:
            self.root = [self.limit, {}, s, [s]]
            return
        node = self.root
        while node[0] < self.limit:
            node = node[1].get(int(text[node[0]])) or next(iter(node[1].values()))
        other = self.code[node[2] : node[2] + self.limit]
        differ = np.flatnonzero(text != other)
        lcp = int(differ[0]) if len(differ) else self.limit
        if lcp == self.limit:
            node[3].append(s)
            return
        up, node = None, self.root
        while node[0] < lcp:
            up, node = node, node[1][int(text[node[0]])]
        leaf = [self.limit, {}, s, [s]]
        if node[0] == lcp:
            node[1][int(text[lcp])] = leaf
            return
        fork = [lcp, {int(self.code[node[2] + lcp]): node, int(text[lcp]): leaf}, s, []]
        if up is None:
            self.root = fork
        else:
            up[1][int(text[up[0]])] = fork

    def groups(self) -> Iterator[list[int]]:
        """Suffixes in order; those equal to the limit together."""
        todo = [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if node[0] == self.limit:
                yield node[3]
            else:
                todo += [node[1][k] for k in sorted(node[1], reverse=True)]


def equal_windows(code: np.ndarray, at: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """A number for each suffix, the same where suffixes of a segment agree in WINDOW words. Segments are runs."""
    order, run = shallow(code, at, seg)
    out = np.arange(len(at))
    first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(run)))
    two = first[n == 2]
    x, y = order[two], order[two + 1]
    same = common(code, at[x], at[y]) >= WINDOW
    out[y[same]] = out[x[same]]
    for f, m in zip(first[n > 2], n[n > 2]):
        o = order[f : f + m]
        trie, held = BlindTrie(code), {}
        for i in o:
            held.setdefault(int(at[i]), []).append(i)
        for s in held:
            trie.insert(s)
        for g in trie.groups():
            rows = [i for s in g for i in held[s]]
            out[rows] = rows[0]
    return out


# --- repeated windows ------------------------------------------------------


CHUNK = 1 << 14


def edges(*same: np.ndarray) -> np.ndarray:
    """Where a run of rows begins that agree in all arrays."""
    new = np.ones(len(same[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in same])
    return np.flatnonzero(new)


def class_windows(parts: list[pa.Buffer], ctx: np.ndarray, count: np.ndarray, i: np.ndarray, th: np.ndarray, p0: np.ndarray) -> Iterator[pa.Table]:
    """(ctx, id1, h1, p1, lead, rest): of each class of one bucket its first occurrence, and runs of repeated windows as
    (first word, end word, removed), for that and for the others. Given are the words of classes, and the number of occurrences of each and the
    first of them.

    Words stay where they came; they are taken out for sorting only where a hash has several classes, in chunks of whole
    hashes."""
    cols: list[list[np.ndarray]] = [[] for _ in range(6)]
    codes: list[np.ndarray] = []
    for k, p in enumerate(parts):
        (c, h, left, n), at = read(p, np.uint64, np.uint64, np.uint8, np.uint8)
        (code,), _ = read(p[at:], np.uint32)
        size = n.astype(np.int64) + WINDOW
        codes.append(code)
        for col, v in zip(cols, (c.view(np.int64), h, left.astype(np.int64), n.astype(np.int64), np.full(len(h), k, np.int32), np.cumsum(size) - size)):
            col.append(v)
    c, h, left, n, part, start = (np.concatenate(x) for x in cols) if codes else (np.zeros(0, np.int64),) * 6
    o = np.lexsort((c, h))
    o = o[edges(c[o])] if len(o) else o  # the same class from several tasks
    c, h, left, n, part, start = (x[o] for x in (c, h, left, n, part, start))
    by = np.argsort(ctx)
    own = by[np.searchsorted(ctx, c, sorter=by)]
    count, i, th, p0 = count[own], i[own], th[own], p0[own]
    first, at = edges(h), 0
    while at < len(h):
        nxt = np.searchsorted(first, at + CHUNK)
        nxt = nxt - 1 if 0 < nxt and first[nxt - 1] > at and (nxt == len(first) or first[nxt] - at > 2 * CHUNK) else nxt
        to = int(first[nxt]) if nxt < len(first) else len(h)
        x = slice(at, to)
        lead, rest = states(h[x], left[x], n[x], count[x], i[x], th[x], p0[x], part[x], start[x], codes)
        on = np.flatnonzero(np.diff(rest[1]))
        if len(on):
            yield pa.table({"ctx": c[x][on], "id1": i[x][on], "h1": th[x][on], "p1": p0[x][on], "lead": packed_runs(*lead).take(pa.array(on)), "rest": packed_runs(*rest).take(pa.array(on))})
        at = to


def packed_runs(runs: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer((off * 12).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(runs, np.int32))])


def states(h, left, n, count, i, th, p0, part, start, codes: list[np.ndarray]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Runs (first word, end word, removed) of classes in order of hash, and the offsets of each class: for the first
    occurrence and for the others."""
    wn = n + 1
    begin = np.cumsum(wn) - wn  # of the windows of each class
    wc = np.repeat(np.arange(len(h)), wn)
    wo = np.arange(len(wc)) - np.repeat(begin, wn)
    number = np.cumsum(np.concatenate([[False], h[1:] != h[:-1]]))
    place = left[wc] - wo
    several = (np.bincount(number) > 1)[number]
    own = np.flatnonzero(several)
    code, words = np.zeros(0, np.uint32), np.zeros(len(h), np.int64)
    if len(own):
        size = n[own] + WINDOW
        words[own] = np.cumsum(size) - size
        code = np.concatenate([codes[part[r]][start[r] : start[r] + s] for r, s in zip(own.tolist(), size.tolist())])
    lead = np.where(count[wc] > 1, 1, 0).astype(np.int8)  # of a class alone with its windows
    rest = np.where(count[wc] > 1, 2, 0).astype(np.int8)
    todo = np.flatnonzero(several[wc])
    # equal windows have the same hash and the same place of the anchor; a very frequent hash is done place by place
    todo = todo[np.lexsort((place[todo], number[wc[todo]]))]
    if len(h) > 2 * CHUNK:
        todo = todo[np.argsort(place[todo], kind="stable")]
    edge = edges(place[todo]).tolist() if len(h) > 2 * CHUNK else [0]
    for x, y in zip(edge, [*edge[1:], len(todo)]) if len(todo) else []:
        r = todo[x:y]
        k = wc[r]
        g = equal_windows(code, words[k] + wo[r], number[k] * 256 + place[r])
        times = np.bincount(g, count[k], len(r))
        o = np.lexsort((p0[k] + wo[r], th[k], i[k], g))
        best = np.full(len(r), -1)
        head = edges(g[o])
        best[g[o[head]]] = k[o[head]]
        rest[r] = np.where(times[g] > 1, 2, 0)
        lead[r] = np.where(times[g] > 1, np.where(best[g] == k, 1, 2), 0)
    return runs_of(lead, wc, wo, len(h)), runs_of(rest, wc, wo, len(h))


def runs_of(state: np.ndarray, wc: np.ndarray, wo: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    edge = edges(state, wc)
    end = np.append(edge[1:], len(state))
    on = state[edge] > 0
    edge, end = edge[on], end[on]
    return np.stack([wo[edge], wo[end - 1] + WINDOW, state[edge] == 2], 1).astype(np.int32), np.searchsorted(wc[edge], np.arange(classes + 1))


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray, removed: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of removed and of kept repeated words: (doc, start, end, removed)."""
    d = np.concatenate([doc, doc])
    x = np.concatenate([start, end])
    up = np.concatenate([np.ones(len(doc), np.int64), -np.ones(len(doc), np.int64)])
    r = np.concatenate([removed, removed])
    o = np.lexsort((x, d))
    d, x, up, r = d[o], x[o], up[o], r[o]
    some, cutting = np.cumsum(up), np.cumsum(np.where(r, up, 0))
    last = np.ones(len(d), bool)  # all events of one place are in
    last[:-1] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    d, x, some, cutting = d[last], x[last], some[last], cutting[last]
    state = np.where(cutting > 0, 2, np.where(some > 0, 1, 0))
    new = np.ones(len(d), bool)
    new[1:] = (state[1:] != state[:-1]) | (d[1:] != d[:-1])
    d, x, state = d[new], x[new], state[new]
    on = np.flatnonzero(state)
    return d[on], x[on], x[on + 1], state[on] == 2


_SPAN = "doc_id long, h long, start_word long, end_word long, removed boolean"


def usable(docs: DataFrame) -> DataFrame:
    return keyed(docs).where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("h", F.xxhash64("text"))


def all_spans(docs: DataFrame) -> DataFrame:
    d = usable(docs)
    size = d.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(width(docs.sparkSession), -(-size // SHARE))
    given = contexts(d, repeated_anchors(d, buckets), buckets)
    parts, occurrences = given.where("part IS NOT NULL").select("bucket", "part"), given.where("part IS NULL").drop("part")
    classes = occurrences.distinct().groupBy("bucket", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "h", "p0")).alias("first")).select("bucket", "ctx", "n", "first.*")

    def sort(parts: pa.Table, classes: pa.Table) -> pa.Table:
        found = list(class_windows([x.as_buffer() for x in parts.column("part")], *(classes.column(c).to_numpy() for c in ("ctx", "n", "doc_id", "h", "p0"))))
        kinds = [("ctx", pa.int64()), ("id1", pa.int64()), ("h1", pa.int64()), ("p1", pa.int64()), ("lead", pa.binary()), ("rest", pa.binary())]
        return pa.concat_tables(found) if found else pa.schema(kinds).empty_table()

    runs = by_bucket(parts, buckets).cogroup(by_bucket(classes, buckets)).applyInArrow(sort, "ctx long, id1 long, h1 long, p1 long, lead binary, rest binary")
    own = F.expr("doc_id = id1 AND h = h1 AND p0 = p1")
    of = occurrences.join(runs, "ctx").select("doc_id", "h", "p0", F.when(own, F.col("lead")).otherwise(F.col("rest")).alias("runs")).where("length(runs) > 0")

    def union(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        i, th, p0 = (t.column(c).to_numpy() for c in ("doc_id", "h", "p0"))
        raw, off = buffers(t.column("runs").combine_chunks())
        run = raw.view(np.int32).reshape(-1, 3).astype(np.int64)
        row = np.repeat(np.arange(len(i)), np.diff(off) // 12)
        o = np.lexsort((th, i))
        first = edges(i[o], th[o])
        doc = np.empty(len(i), np.int64)
        doc[o] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(o))))
        d, s, e, r = merged(doc[row], run[:, 0] + p0[row], run[:, 1] + p0[row], run[:, 2] > 0)
        return pa.table([i[o[first]][d], th[o[first]][d], s, e, r], names=["doc_id", "h", "start_word", "end_word", "removed"])

    return of.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h"), F.lit(buckets)).cast("int")).groupBy("bucket").applyInArrow(union, _SPAN)


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, removed): runs of repeated words, the end exclusive, counted from 0."""
    return all_spans(docs).select("doc_id", "start_word", "end_word", "removed")


# --- cutting ---------------------------------------------------------------


def cut_words(texts: pa.Array, spans: list[list[tuple[int, int]] | None]) -> pa.Array:
    """Texts without the given runs of words and what follows each word up to the next."""
    raw, off = buffers(texts)
    w = Words(texts, hashed=False, any_case=True)
    out = []
    for r, runs in enumerate(spans):
        text = raw[off[r] : off[r + 1]].tobytes()
        if runs:
            begin = (w.start[w.first[r] : w.first[r + 1]] - off[r]).tolist() + [len(text)]
            kept, at = [], 0
            for s, e in sorted(runs):
                kept.append(text[at : begin[s]])
                at = begin[e]
            text = b"".join([*kept, text[at:]])
        out.append(text)
    return pa.array(out, pa.binary()).cast(pa.string())


_RUNS = "weirflow repeated runs"


def removed(docs: DataFrame) -> DataFrame:
    """docs, all columns, without the removed words; n_chars is set where there is such a column.
    A document that loses all of its words goes."""
    runs = all_spans(docs).where("removed").groupBy(F.col("doc_id").alias("cut id"), F.col("h").alias("cut hash")).agg(F.collect_list(F.struct("start_word", "end_word")).alias(_RUNS))
    j = docs.join(runs, (docs["doc_id"] == runs["cut id"]) & (F.xxhash64(docs["text"].cast("string")) == runs["cut hash"]), "left").drop("cut id", "cut hash")
    names, schema = docs.columns, docs.schema
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            runs = b.column(len(names))
            cols = [b.column(i) for i in range(len(names))]
            hit = pc.is_valid(runs)
            if hit.true_count:
                text = cols[at].cast(pa.string())
                new = cut_words(text, [None if r is None else [(x["start_word"], x["end_word"]) for x in r] for r in runs.to_pylist()])
                some = pa.array(np.diff(Words(new, hashed=False, any_case=True).first) > 0)
                cols[at] = pc.if_else(hit, new, text).cast(cols[at].type)
                if "n_chars" in names:
                    k = names.index("n_chars")
                    cols[k] = pc.if_else(hit, pc.utf8_length(new).cast(cols[k].type), cols[k])
                keep = pc.or_(pc.invert(hit), some)
                yield pa.record_batch(cols, names).filter(keep)
            else:
                yield pa.record_batch(cols, names)

    return j.mapInArrow(run, schema)
