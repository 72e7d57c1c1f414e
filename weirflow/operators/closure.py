"""Reachability over call and def-use edges: what taint reaches, as relations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.session import written

#: Rounds between two checkpoints of the whole reached set, and steps along the edges in a round.
EVERY, STEPS = 8, 4


def reach(start: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """The rows (keys) that lead from ``start`` along ``edges`` (keys, then n_keys), start included.

    Semi-naive: a round joins only what the last one added, for several steps, so a long chain of calls takes few
    jobs. A frontier under Spark's broadcast threshold is broadcast by its measured size (AQE), a larger one is
    shuffled; lineage is cut by reliable checkpoints."""
    nxt = [f"n_{k}" for k in keys]
    seen = new = written(start.select(*keys).distinct())
    rounds = 0
    while True:
        step, steps = new, None
        for _ in range(STEPS):
            step = step.join(edges, keys).select(*[F.col(n).alias(k) for n, k in zip(nxt, keys)]).distinct()
            steps = step if steps is None else steps.unionByName(step)
        new = written(steps.distinct().join(seen, keys, "left_anti"))
        if new.isEmpty():
            return seen
        rounds += 1
        seen = seen.unionByName(new)
        if rounds % EVERY == 0:
            seen = written(seen)


def summaries(instr: DataFrame, keep: str = "false", carried: Sequence[str] = ()) -> DataFrame:
    """Per function, what its own source instructions reach and what its parameter reaches:
    (fn, from_entry, keys array<long>, callees array<long>, sinks array<long>, last long, kept array<struct>).

    last is the last instruction. kept, in the row of the parameter, are the instructions for which ``keep`` holds: the
    columns ``carried``, and whether its operand is reached by own sources (own) and by the parameter (entry).

    A function is small, so its inside is closed in one pass here and rounds are spent on calls between functions
    only. instr: (fn, seq, k, opnd, callee_fn); an operand is an earlier instruction or 0, the parameter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            first = np.concatenate([[0], np.cumsum(b.column("seqs").value_lengths().to_numpy())])
            seq, k, opnd, callee = (b.column(c).flatten().to_numpy() for c in ("seqs", "ks", "opnds", "callees"))
            n = len(seq)
            row = np.repeat(np.arange(b.num_rows), np.diff(first))
            # an instruction points to the one of its operand, or to n, the parameter, or to n + 1, nothing known;
            # sources and sanitizers end a chain, and chains are followed by doubling
            at = np.searchsorted(row * (1 << 32) + seq, row * (1 << 32) + opnd) if n else row
            at = np.minimum(at, n - 1)
            at = np.where(opnd == 0, n, np.where((seq[at] == opnd) & (row[at] == row), at, n + 1))
            end = np.append(np.where((k == 0) | (k == 3), np.arange(n), at), [n, n + 1])
            while (end[end] != end).any():
                end = end[end]
            ends = [np.append(k == 0, [False, False])[end], end == n]
            for entry, hot in zip((False, True), ends):
                fed = hot[at]  # the operand is hot
                keys = np.flatnonzero(hot[:n])
                call = np.flatnonzero((k >= 4) & (k <= 7) & fed)
                sink = np.flatnonzero(((k == 1) | (k == 2)) & hot[:n])
                u = np.unique(np.stack([row[call], callee[call]], 1), axis=0)
                of = np.arange(b.num_rows) if entry else np.unique(row[keys])
                key_row, key = row[keys], seq[keys]
                if entry:  # the parameter itself
                    o = np.argsort(np.concatenate([of, key_row]), kind="stable")
                    key_row, key = np.concatenate([of, key_row])[o], np.concatenate([np.zeros(len(of), np.int64), key])[o]
                lists = [pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(r, of), len(r)), pa.int32()), pa.array(v, pa.int64())) for r, v in ((key_row, key), (u[:, 0], u[:, 1]), (row[sink], seq[sink]))]
                lists.append(b.column("last").take(pa.array(of)))
                if carried:
                    some = np.flatnonzero(b.column("kept").flatten().is_valid().to_numpy(False)) if entry else np.zeros(0, np.int64)
                    values = b.column("kept").flatten().take(pa.array(some)).flatten()
                    values = pa.StructArray.from_arrays([*values, *(pa.array(x[at[some]]) for x in ends)], [*carried, "own", "entry"])
                    lists.append(pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(row[some], of), len(some)), pa.int32()), values))
                yield pa.record_batch([b.column("fn").take(pa.array(of)), pa.array(np.full(len(of), entry)), *lists], names)

    names = ["fn", "from_entry", "keys", "callees", "sinks", "last", *(["kept"] if carried else [])]
    flow = F.struct("seq", "k", "opnd", "callee_fn", *([F.when(F.expr(keep), F.struct(*carried)).alias("kept")] if carried else []))
    g = instr.groupBy("fn").agg(F.sort_array(F.collect_list(flow)).alias("r"))
    g = g.select("fn", *[F.col(f"r.{c}").alias(a) for c, a in (("seq", "seqs"), ("k", "ks"), ("opnd", "opnds"), ("callee_fn", "callees"))], F.array_max("r.seq").alias("last"), *([F.col("r.kept")] if carried else []))
    kept = "".join(f", {c}:{instr.schema[c].dataType.simpleString()}" for c in carried)[2:]
    return g.mapInArrow(run, "fn long, from_entry boolean, keys array<long>, callees array<long>, sinks array<long>, last long" + (f", kept array<struct<{kept},own:boolean,entry:boolean>>" if carried else ""))


def entered(instr: DataFrame, functions: DataFrame, scope: DataFrame | None = None, keep: str = "false", carried: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The summaries as a table, and (fn) of the functions whose parameter is tainted. instr passes once."""
    s = written(summaries(instr, keep, carried))
    known = functions.select("fn")
    if scope is not None:
        known = known.join(scope, "fn", "left_semi")
        s = written(s.join(scope, "fn", "left_semi"))
    called = s.select("fn", "from_entry", F.explode("callees").alias("n_fn")).join(known.withColumnRenamed("fn", "n_fn"), "n_fn", "left_semi")
    called = written(called)
    start = called.where("NOT from_entry").select(F.col("n_fn").alias("fn"))
    return s, reach(start, called.where("from_entry").select("fn", "n_fn"), ["fn"])


def tainted(instr: DataFrame, functions: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """(fn, key) of every tainted register: sources, what they reach in their function, and what the parameters of
    called functions reach. With ``scope`` (fn) only functions of the scope are entered or seeded."""
    s, into = entered(instr, functions, scope)
    own = s.where("NOT from_entry").select("fn", F.explode("keys").alias("key"))
    via = s.where("from_entry").join(into, "fn", "left_semi").select("fn", F.explode("keys").alias("key"))
    # a function without instructions has no summary, its parameter is tainted all the same
    bare = into.select("fn", F.lit(0).cast("long").alias("key"))
    return own.unionByName(via).unionByName(bare).distinct()


def fed(instr: DataFrame, functions: DataFrame, keep: str, carried: Sequence[str]) -> DataFrame:
    """(fn, columns carried, own) of the instructions for which ``keep`` holds and whose operand is tainted; own is
    whether by a source of the function itself. Which they are is known from the summary of a function and from whether
    its parameter is tainted, so instr passes once."""
    s, into = entered(instr, functions, None, keep, carried)
    return hot(s, into).drop("entry")


def hot(s: DataFrame, into: DataFrame) -> DataFrame:
    """The kept instructions of summaries whose operand is tainted."""
    rows = s.where("from_entry").select("fn", F.explode(F.filter("kept", lambda x: x["own"] | x["entry"])).alias("_k")).select("fn", "_k.*")
    return rows.where("own").unionByName(rows.where("NOT own").join(into, "fn", "left_semi"))


def at(instr: DataFrame, tainted: DataFrame, kinds: str) -> DataFrame:
    """Instructions of the kinds whose operand is tainted."""
    return instr.where(kinds).join(tainted.select("fn", F.col("key").alias("opnd")), ["fn", "opnd"], "left_semi")


def entered_functions(instr: DataFrame, functions: DataFrame, roots: DataFrame) -> DataFrame:
    """Functions that roots reach over resolved calls, roots included."""
    edges = instr.where("k BETWEEN 4 AND 7").select("fn", F.col("callee_fn").alias("n_fn")).distinct().join(functions.select(F.col("fn").alias("n_fn")), "n_fn", "left_semi")
    return reach(roots, written(edges.select("fn", "n_fn")), ["fn"])


def _dominator_sets(succ: dict[int, list[int]], entry: int) -> dict[int, int]:
    """Reachable node -> bits of its dominators, by position in reverse post-order."""
    post, todo, seen = [], [(entry, iter(succ[entry]))], {entry}
    while todo:
        node, rest = todo[-1]
        n = next((x for x in rest if x not in seen and x in succ), None)
        if n is None:
            post.append(node)
            todo.pop()
        else:
            seen.add(n)
            todo.append((n, iter(succ[n])))
    order = post[::-1]
    bit = {n: 1 << k for k, n in enumerate(order)}
    preds: dict[int, list[int]] = {n: [] for n in order}
    for n in order:
        for m in succ[n]:
            if m in preds:
                preds[m].append(n)
    every = (1 << len(order)) - 1
    dom = dict.fromkeys(order, every)
    dom[entry] = 1
    changed = True
    while changed:
        changed = False
        for n in order[1:]:
            d = every
            for p in preds[n]:
                d &= dom[p]
            d |= bit[n]
            if d != dom[n]:
                dom[n], changed = d, True
    return dom


def dominators(blocks: DataFrame) -> DataFrame:
    """(fn, block, dom): the blocks that every path from the entry to a block passes, of the blocks that are reached.
    blocks: (fn, block, succs array<long>, entry boolean). A function's graph is small and is one row."""

    def pairs(at: tuple, succs: tuple, entry: int) -> tuple[list[int], list[int]]:
        dom = _dominator_sets(dict(zip(at, succs)), entry)
        order = list(dom)
        own = [(n, m) for n, bits in dom.items() for k, m in enumerate(order) if bits >> k & 1]
        return [n for n, _ in own], [m for _, m in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple[list[int], list[int]]] = {}  # small graphs are alike
        for b in batches:
            fns, nodes, doms = [], [], []
            for f, at, succs, entry in zip(*(b.column(c).to_pylist() for c in ("fn", "nodes", "succs", "entry"))):
                graph = (tuple(at), tuple(map(tuple, succs)), entry)
                if graph not in known:
                    if len(known) >= 1 << 14:
                        known.clear()
                    known[graph] = pairs(*graph)
                n, m = known[graph]
                fns += [f] * len(n)
                nodes += n
                doms += m
            yield pa.record_batch([pa.array(c, pa.int64()) for c in (fns, nodes, doms)], ["fn", "block", "dom"])

    g = blocks.groupBy("fn").agg(F.sort_array(F.collect_list(F.struct("block", "succs"))).alias("r"), F.min(F.when(F.col("entry"), F.col("block"))).alias("entry"))
    return g.select("fn", F.col("r.block").alias("nodes"), F.col("r.succs").alias("succs"), "entry").mapInArrow(run, "fn long, block long, dom long")


def paths(instr: DataFrame, hot: DataFrame) -> DataFrame:
    """(fn, sink, step, seq): from each tainted sink back over its operands to where the taint came in, source first.
    Consecutive repeats don't occur, as an operand is an earlier instruction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for f, sq, ks, op in zip(*(b.column(c).to_pylist() for c in ("fn", "seqs", "ks", "opnds"))):
                at = {s: (k, o) for s, k, o in zip(sq, ks, op)}
                for sink in (s for s, k in zip(sq, ks) if k in (1, 2)):
                    walk, s = [sink], at[sink][1]
                    while s in at:
                        walk.append(s)
                        if at[s][0] == 0:
                            break
                        s = at[s][1]
                    out += [(f, sink, i, s) for i, s in enumerate(reversed(walk))]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)], ["fn", "sink", "step", "seq"])

    rows = F.sort_array(F.collect_list(F.struct("seq", "k", "opnd")))
    some = instr.join(hot.select("fn").distinct(), "fn", "left_semi")
    g = some.groupBy("fn").agg(rows.alias("r")).select("fn", F.col("r.seq").alias("seqs"), F.col("r.k").alias("ks"), F.col("r.opnd").alias("opnds"))
    return g.mapInArrow(run, "fn long, sink long, step long, seq long").join(hot.select("fn", F.col("key").alias("sink")), ["fn", "sink"], "left_semi")
