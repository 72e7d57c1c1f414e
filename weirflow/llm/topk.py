"""Exact top-k search: the k nearest of every query, by multi-resolution segment statistics.

A vector is cut into 1, 4 and 16 segments. With a segment's mean m and standard
deviation s over its length l, the distance of two vectors is at least
sqrt(sum over segments of l ((m - m')^2 + (s - s')^2)) at each resolution, so
sqrt(l) (m, s) are features whose distance never exceeds the true one.

Queries are the rows that ``queries`` names, by default those whose id is divisible
by EVERY; they are compared with all rows but themselves.

1. Vectors are put in the order of the nearest of up to PIVOTS sampled pivots by their
   features at 4 segments, by ranges, so no cell is too large for a task, and cut into
   blocks, each with the box of its finest features.
2. Queries are ordered alike and cut into groups. A query's first bound is its k-th
   nearest of the pivots, which are rows too.
3. A block goes to the groups whose box is within their largest bound. Groups and blocks
   meet in a grid of (group, part) tasks; a block is sent once to each group.
4. A task opens its blocks one by one, nearest first. Pairs pass the bounds coarse to
   fine, survivors get their exact distance, and the k nearest so far tighten the bounds
   before the next block. The nearest of all parts are merged.

Pivots, groups and parts change the work, never the result.

Defined results: rows with null id, a null or empty vector or a null or non-finite
member take no part, neither as query; ties go to the least id; repeated ids keep the
least vector; vectors of different lengths are an error; fewer than k + 1 rows give what
there is; an empty table or no query gives no rows; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.session import width, written

K = 10
EVERY = 50
SEGMENTS = (1, 4, 16)
PIVOTS = 1024
BLOCK = 4096
#: Most queries of a group, blocks of a part, and queries that are compared at a time.
GROUP = 1 << 16
PART = 64
AT_ONCE = 512


def features(v: np.ndarray, segments: int) -> np.ndarray:
    """(rows, 2 segments); a length that doesn't divide leaves the last members to the last segment."""
    n, d = v.shape
    segments = min(segments, d)
    edge = np.linspace(0, d, segments + 1).astype(int)
    parts = [v[:, a:b] for a, b in zip(edge, edge[1:])]
    return np.concatenate([np.stack([p.mean(1) * np.sqrt(p.shape[1]) for p in parts], 1), np.stack([p.std(1) * np.sqrt(p.shape[1]) for p in parts], 1)], 1)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


def resolutions(v: np.ndarray) -> list[np.ndarray]:
    """Features coarse to fine, at last the vectors themselves."""
    return [*(features(v, s) for s in SEGMENTS), v]


def nearest(qi: np.ndarray, q: list[np.ndarray], di: np.ndarray, d: list[np.ndarray], bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, distance) of the up to k nearest of d within bound, for each q; ids that are the same don't meet.
    q and d are given at all resolutions."""
    slack = bound * bound * (1 + 1e-9) + 1e-9
    blunt = (slack + 1e-7 + 1e-12 * ((q[-1] ** 2).sum(1) + (d[-1] ** 2).sum(1).max(initial=0)))[:, None]  # for differences of large products
    left = np.ones((len(qi), len(di)), bool)
    on: tuple[np.ndarray, np.ndarray] | None = None
    # while many pairs are left a bound is one product of matrices, then it is taken pair by pair
    for s, (fq, fd) in enumerate(zip(q, d)):
        exact = s == len(SEGMENTS)
        if on is None:
            left &= squared(fq, fd) <= blunt
            if 8 * np.count_nonzero(left) < left.size or exact:
                on = np.nonzero(left)
        elif not exact:
            ok = np.empty(len(on[0]), bool)
            for a in range(0, len(ok), 1 << 18):
                x, y = on[0][a : a + (1 << 18)], on[1][a : a + (1 << 18)]
                ok[a : a + len(x)] = ((fq[x] - fd[y]) ** 2).sum(1) <= slack[x]
            on = on[0][ok], on[1][ok]
    x, y = on
    dist = np.empty(len(x))
    for a in range(0, len(x), 1 << 17):
        u, v = x[a : a + (1 << 17)], y[a : a + (1 << 17)]
        dist[a : a + len(u)] = np.sqrt(((q[-1][u] - d[-1][v]) ** 2).sum(1))
    ok = (dist <= bound[x]) & (qi[x] != di[y])
    return first_k(x[ok], di[y[ok]], dist[ok], k)


def first_k(row: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    o = np.lexsort((ids, dist, row))
    row, ids, dist = row[o], ids[o], dist[o]
    ok = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[ok], ids[ok], dist[ok]


def matrix(payload: bytes | pa.Buffer, dim: int) -> np.ndarray:
    return np.frombuffer(payload, np.float64).reshape(-1, dim)


def ordered(vectors: DataFrame, sample: np.ndarray, cells: int, size: int, apart: bool) -> DataFrame:
    """(block, ids, vectors, low, high): runs of up to ``size`` vectors in the order of cells; ``apart``: of one cell each."""
    dim = sample.shape[1]
    pivots = features(sample[:cells], SEGMENTS[1])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            e = b.column("embedding")
            if set(e.value_lengths().unique().to_pylist()) != {dim}:
                raise ValueError(f"vectors of different lengths: {dim} and others")
            v = np.asarray(e.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
            cell = squared(features(v, SEGMENTS[1]), pivots).argmin(1)
            yield pa.record_batch([b.column("vec_id"), pa.array([x.tobytes() for x in v], pa.binary()), pa.array(cell), pa.array(features(v, SEGMENTS[0])[:, 0])], ["vec_id", "v", "cell", "mean"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, raw, open_ = [], [], -1

        def block() -> pa.RecordBatch:
            v = matrix(b"".join(raw), dim)
            f = features(v, SEGMENTS[-1])
            return pa.record_batch([pa.array([ids[0]], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary()), pa.array([f.min(0).tolist()], pa.list_(pa.float64())), pa.array([f.max(0).tolist()], pa.list_(pa.float64()))], ["block", "ids", "vectors", "low", "high"])

        for b in batches:
            for i, v, c in zip(b.column("vec_id").to_pylist(), b.column("v").to_pylist(), b.column("cell").to_pylist()):
                if ids and (len(ids) == size or apart and c != open_):
                    yield block()
                    ids, raw = [], []
                open_ = c
                ids.append(i)
                raw.append(v)
        if ids:
            yield block()

    got = vectors.mapInArrow(dealt, "vec_id long, v binary, cell long, mean double")
    n = max(1, -(-vectors.count() // (max(1, GROUP // size) * size)))
    return got.repartitionByRange(n, "cell", "mean", "vec_id").sortWithinPartitions("cell", "mean", "vec_id").mapInArrow(cut, "block long, ids binary, vectors binary, low array<double>, high array<double>")


def bounded(groups: DataFrame, sample: np.ndarray, k: int) -> DataFrame:
    """Groups with (bounds, most): the distance of each query's k-th nearest of the sample, and the largest of them."""
    dim = sample.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bounds = []
            for p in b.column("vectors"):
                v = matrix(p.as_buffer(), dim)
                bound = np.full(len(v), np.inf)
                if len(sample) > k:  # a query may be one of the sample: one more than k
                    for a in range(0, len(v), AT_ONCE):
                        x = v[a : a + AT_ONCE]
                        blunt = 1e-12 * ((x * x).sum(1) + (sample * sample).sum(1).max())
                        bound[a : a + AT_ONCE] = np.sqrt(np.partition(squared(x, sample), k, 1)[:, k] + blunt) * (1 + 1e-6) + 1e-6
                bounds.append(bound)
            yield pa.record_batch([*b.columns, pa.array([x.tobytes() for x in bounds], pa.binary()), pa.array([float(x.max()) for x in bounds])], [*b.schema.names, "bounds", "most"])

    return groups.mapInArrow(run, "block long, ids binary, vectors binary, low array<double>, high array<double>, bounds binary, most double")


def search(batches: Iterator[pa.RecordBatch], dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """Rows of a task in order: for each (group, part) the group, then its blocks, nearest first."""
    open_: list[list] = []  # of each run of AT_ONCE queries: ids, resolutions, bounds, box, rows, neighbours, distances

    def done() -> Iterator[pa.RecordBatch]:
        for qi, *_, row, other, dist in open_:
            yield pa.record_batch([pa.array(qi[row]), pa.array(other), pa.array(dist)], ["vec_id", "neighbor_id", "distance"])

    for b in batches:
        for r in range(b.num_rows):
            ids = np.frombuffer(b.column("ids")[r].as_buffer(), np.int64)
            v = matrix(b.column("vectors")[r].as_buffer(), dim)
            if b.column("bounds")[r].is_valid:
                yield from done()
                open_, bound = [], np.frombuffer(b.column("bounds")[r].as_buffer(), np.float64).copy()
                for a in range(0, len(ids), AT_ONCE):
                    f = resolutions(v[a : a + AT_ONCE])
                    open_.append([ids[a : a + AT_ONCE], f, bound[a : a + AT_ONCE], (f[-2].min(0), f[-2].max(0)), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)])
                continue
            d = resolutions(v)
            low, high = d[-2].min(0), d[-2].max(0)
            for run in open_:
                qi, f, bound, (low2, high2), row, other, dist = run
                most = bound.max()
                if (np.maximum(0, np.maximum(low - high2, low2 - high)) ** 2).sum() > most * most * (1 + 1e-9) + 1e-9:
                    continue
                x, i, s = nearest(qi, f, ids, d, bound, k)
                if len(x):
                    run[4:] = row, other, dist = first_k(np.concatenate([row, x]), np.concatenate([other, i]), np.concatenate([dist, s]), k)
                    last = np.flatnonzero(np.bincount(row, minlength=len(qi)) == k)
                    bound[last] = np.minimum(bound[last], dist[np.searchsorted(row, last, "right") - 1])
    yield from done()


GAP = "aggregate(zip_with(zip_with(low, high2, (a, b) -> a - b), zip_with(low2, high, (a, b) -> a - b), (a, b) -> greatest(a, b, 0D)), 0D, (s, x) -> s + x * x)"


def top_k(vectors: DataFrame, k: int = K, queries: Column | None = None) -> DataFrame:
    """(vec_id, rank, neighbor_id, distance) of every query: distance in double precision, rounded to 6 digits.
    ``queries``: a condition on vec_id."""
    spark: SparkSession = vectors.sparkSession
    out = "vec_id long, rank int, neighbor_id long, distance double"
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")).where(
        "vec_id IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    )
    v = written(v.groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    sampled = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).toPandas()  # PIVOTS rows at most
    if sampled.empty:
        return spark.createDataFrame([], out)
    if len({len(e) for e in sampled.embedding}) > 1:
        raise ValueError("vectors of different lengths")
    sample = np.array(sampled.embedding.tolist(), np.float64)
    dim = sample.shape[1]
    cells = min(PIVOTS, -(-v.count() // BLOCK))
    asked = v.where(F.pmod("vec_id", F.lit(EVERY)) == 0 if queries is None else queries)
    q = written(bounded(ordered(asked, sample, cells, GROUP, False), sample, k))
    d = written(ordered(v, sample, cells, BLOCK, True))
    n_groups, n_blocks = q.count(), d.count()
    if not n_groups:
        return spark.createDataFrame([], out)
    parts = max(-(-n_blocks // PART), min(n_blocks, -(-width(spark) // n_groups)))
    # boxes meet first, a row for each block and group: a block goes to all slots, a group lies in one
    slots = max(1, n_groups // 16)
    box = d.select("block", F.pmod(F.xxhash64("block"), F.lit(parts)).alias("part"), "low", "high", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    groups = q.select(F.col("block").alias("g"), "most", F.col("low").alias("low2"), F.col("high").alias("high2"), F.pmod(F.hash("block"), F.lit(slots)).alias("slot"))
    meet = box.join(groups, "slot").withColumn("gap", F.expr(GAP)).where("gap <= most * most * (1 + 1e-9D) + 1e-9D").select("g", "part", "gap", "block")
    opened = q.select(F.col("block").alias("g"), F.lit(-1.0).alias("gap"), "ids", "vectors", "bounds").join(meet.select("g", "part").distinct(), "g")
    rows = opened.unionByName(meet.join(d.select("block", "ids", "vectors"), "block").drop("block").withColumn("bounds", F.lit(None).cast("binary")))
    tasks = rows.select("g", "part", "gap", "ids", "vectors", "bounds").repartition(2 * n_groups * parts, "g", "part").sortWithinPartitions("g", "part", "gap")
    near = tasks.mapInArrow(lambda batches: search(batches, dim, k), "vec_id long, neighbor_id long, distance double")
    best = near.groupBy("vec_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbor_id"))), 1, k).alias("best"))
    return best.select("vec_id", F.posexplode("best").alias("rank", "b")).select("vec_id", (F.col("rank") + 1).alias("rank"), F.col("b.neighbor_id").alias("neighbor_id"), F.round("b.distance", 6).alias("distance"))
