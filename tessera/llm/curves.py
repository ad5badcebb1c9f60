"""Nearest neighbours by shifted space-filling curves, widened until they are exact.

Vectors are projected to a few dimensions, shifted and ordered along several Hilbert curves; each curve has
its own projection and shift. What is ordered are codes, a byte a dimension, range-partitioned by (curve, key,
vec_id), so equal vectors spread too. Each query meets the ``window`` rows before and after it on every curve:
within its task as the rows pass by, and across the edges of tasks by the rows' places on the whole curve, so
windows don't depend on partitions. The best by their codes on all curves are merged, and reranked by the
original vectors, which gives each query its k-th best cosine so far.

Rows of the first curve are also packed, in its order, into blocks with a centre and a largest angle to it.
The windows are widened to a block only if a vector within that angle could reach the query's k-th best. Where
neighbours are near, as in clustered vectors, this opens few blocks; vectors spread evenly over all
directions have no near neighbours, and then it opens most of them, in block products of matrices. Either
way nothing that belongs in a result is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranges
from .runtime import freed, prepare, stored

KEYED = "curve int, key long, vec_id long, vec binary, task int"
NEAR = "query_id long, vec_id long, near float, curve int, part int, at long, code binary, size long"
BLOCK = "block long, ids binary, vecs binary, centre binary, cosine double"
SLACK = 1e-9
SALTS = 16
NO_CUTS = np.empty((0, 2), np.int64)


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of integers in [0, 2 ** bits), by Skilling's transposed form."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        low = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        flip ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
    x ^= flip
    out = np.zeros_like(x[0])
    for k in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> k & 1)
    return out


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b, summed dimension by dimension in double precision."""
    dot, aa, bb = (np.zeros(len(a)) for _ in range(3))
    for k in range(a.shape[1]):
        x, y = a[:, k].astype(float), b[:, k].astype(float)
        dot, aa, bb = dot + x * y, aa + x * x, bb + y * y
    return dot / np.sqrt(aa * bb)


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(float)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def best(query: int, vec: np.ndarray, ids: np.ndarray, rows: np.ndarray, near: np.ndarray, k: int, least: float) -> list[tuple]:
    """The k best rows of one query by exact cosine, ties to smaller ids; ``near``: their cosines but for rounding."""
    usable = (ids != query) & (near >= least - SLACK)
    if not usable.any():
        return []
    distinct = len(np.unique(ids[usable]))
    if distinct > k:  # all that may be among the k best of distinct ids
        order = np.flatnonzero(usable)[np.argsort(-near[usable], kind="stable")]
        seen, at = set(), 0
        while len(seen) < k:
            seen.add(int(ids[order[at]]))
            at += 1
        usable &= near >= near[order[at - 1]] - SLACK
    at = np.flatnonzero(usable)
    score = cosines(np.broadcast_to(vec, (len(at), len(vec))), rows[at])
    out, seen = [], set()
    for i in np.lexsort((ids[at], -score)):
        v = int(ids[at[i]])
        if v not in seen:
            seen.add(v)
            out.append((query, v, float(score[i])))
            if len(out) == k:
                break
    return out


def codes(points: np.ndarray) -> list[bytes]:
    """Unit vectors as a 32-bit scale and a byte a dimension."""
    scale = np.abs(points).max(1) / 127
    whole = np.rint(points / scale[:, None]).astype(np.int8)
    return [s.tobytes() + w.tobytes() for s, w in zip(scale.astype("<f4"), whole)]


def decoded(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the scales of some codes."""
    data = np.frombuffer(b"".join(packed), np.int8).reshape(len(packed), -1)
    return data[:, 4:], np.ascontiguousarray(data[:, :4]).view("<f4").ravel()


def places(points: np.ndarray, curve: int, dims: int, bits: int, seed: int) -> np.ndarray:
    """The keys of unit vectors on a curve."""
    r = np.random.default_rng([seed, curve])
    turn, shift = r.normal(size=(points.shape[1], dims)), r.uniform(0, 1, dims)
    # A random direction meets most unit vectors within 3 deviations.
    z = points @ turn / 6 + 0.5 + shift / (1 << bits)
    return hilbert(np.clip(z * (1 << bits), 0, (1 << bits) - 1).astype(np.int64), bits)


def _keys(curves: int, dims: int, bits: int, seed: int, kind: str, whole: bool, cut: np.ndarray):
    """Rows once for each curve, as codes, or as they are if ``whole``, and their task by cuts of (key over all curves, vec_id)."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            ids, col = np.asarray(b.column(0)), b.column(1)
            if not len(ids):
                continue
            rows = np.asarray(col.flatten()).reshape(len(ids), -1).astype(kind)
            points = unit(rows)
            vecs = pa.array([x.tobytes() for x in rows] if whole else codes(points), pa.binary())
            for c in range(curves):
                key = places(points, c, dims, bits, seed)
                task = ranges.task_of((c << dims * bits) + key, ids, cut)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), c, np.int32)), pa.array(key), pa.array(ids), vecs, pa.array(task)], names=["curve", "key", "vec_id", "vec", "task"])

    return freed(run)


def laid(rows: DataFrame, size: int, curves: int, dims: int, bits: int, seed: int, kind: str, whole: bool, rows_of_task: int) -> DataFrame:
    """``size`` rows in order of (curve, key, vec_id) over tasks and in each, with curve, vec_id and vec."""
    tasks = int(min(100_000, max(2 * rows.sparkSession.sparkContext.defaultParallelism, size * curves // rows_of_task)))
    some = rows.sample(ranges.share(size * curves, tasks), seed=1).mapInArrow(_keys(curves, dims, bits, seed, kind, True, NO_CUTS), KEYED)
    cut = ranges.cuts(some.select((F.shiftleft(F.col("curve").cast("long"), dims * bits) + F.col("key")).alias("key"), "vec_id").toArrow(), tasks)
    keyed = rows.mapInArrow(_keys(curves, dims, bits, seed, kind, whole, cut), KEYED)
    return keyed.repartitionById(len(cut) + 1, "task").sortWithinPartitions("curve", "key", "vec_id").select("curve", "vec_id", "vec")


def _nearest(query: int, own: np.ndarray, ids: np.ndarray, near: np.ndarray, k: int) -> list[tuple]:
    """The k best of some rows for a query, other than itself, by their codes."""
    near = np.where(own, -np.inf, near)
    if len(near) > k:
        near[near < np.partition(near, -k)[-k]] = -np.inf
    at = np.flatnonzero(near > -np.inf)
    return [(query, int(ids[i]), float(near[i])) for i in at[np.lexsort((ids[at], -near[at]))][:k]]


def _windows(k: int, window: int, every: int):
    """For rows in order of the curves: the best of each query's window, as far as the task reaches, and its rows at its edges.

    Rows are of three kinds: pairs (query_id, vec_id, near); rows within ``window`` of the first or last of a
    curve in this task, with their place in it; and the number of rows of each curve.
    """

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        curve, ids, whole, scale, done, passed = None, np.empty(0, np.int64), None, None, 0, 0
        names = [x.split()[0] for x in NEAR.split(", ")]
        types = [pa.int64(), pa.int64(), pa.float32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64()]

        def search(stop: int) -> list[tuple]:
            out = []
            for at in done + np.flatnonzero(ids[done:stop] % every == 0):
                a, z = max(0, at - window), at + window + 1
                near = (whole[a:z].astype(np.float32) @ whole[at].astype(np.float32)) * scale[a:z] * scale[at]
                out += [(*x, *(None,) * 5) for x in _nearest(int(ids[at]), ids[a:z] == ids[at], ids[a:z], near, k)]
            return out

        def edge(a: int, z: int) -> list[tuple]:
            """Rows of the buffer as edge rows; ``passed`` rows of the curve went before the buffer."""
            return [(None, int(ids[i]), None, int(curve), part, passed + i, scale[i].tobytes() + whole[i].tobytes(), None) for i in range(a, z)]

        def finish() -> list[tuple]:
            """The rest of a curve; its head was given when it came, its last rows are given now."""
            size = passed + len(ids)
            return search(len(ids)) + edge(max(window - passed, len(ids) - window, 0), len(ids)) + [(None, None, None, int(curve), part, None, None, size)]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for b in found:
            own, new_ids = np.asarray(b.column(0)), np.asarray(b.column(1))
            new, new_scale = decoded(b.column(2).to_pylist())
            for c in np.unique(own):
                some = own == c
                out = []
                if c != curve:
                    out = finish() if curve is not None else []
                    curve, ids, whole, scale, done, passed, before = c, new_ids[some], new[some], new_scale[some], 0, 0, 0
                else:
                    before = passed + len(ids)
                    ids, whole, scale = np.append(ids, new_ids[some]), np.append(whole, new[some], axis=0), np.append(scale, new_scale[some])
                if before < window:  # the head of a curve in this task
                    out += edge(before - passed, min(window - passed, len(ids)))
                if len(ids) - window > done:
                    out += search(len(ids) - window)
                    done = len(ids) - window
                    drop = max(0, done - window)
                    ids, whole, scale, done, passed = ids[drop:], whole[drop:], scale[drop:], done - drop, passed + drop
                if out:
                    yield batch(out)
        if curve is not None:
            yield batch(finish())

    return freed(run)


def _across(k: int, window: int):
    """Of the rows of a cell and the queries whose windows reach it, all near edges: each query's best in other tasks."""

    def run(found: pa.Table) -> pa.Table:
        part, rank, ids, asked = (np.asarray(found[c]) for c in ("part", "rank", "vec_id", "asked"))
        whole, scale = decoded(found["code"].to_pylist())
        rows = np.flatnonzero(~asked)
        these, out = whole[rows].astype(np.float32), []
        for q in np.flatnonzero(asked):
            near = (these @ whole[q].astype(np.float32)) * scale[rows] * scale[q]
            out += _nearest(int(ids[q]), (part[rows] == part[q]) | (np.abs(rank[rows] - rank[q]) > window) | (ids[rows] == ids[q]), ids[rows], near, k)
        columns = list(zip(*out)) or [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float32()))], names=["query_id", "vec_id", "near"])

    return run


def _scored(kind: str):
    """Cosines of pairs of vectors."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            if b.num_rows:
                x, y = (np.asarray(b.column(k).flatten()).reshape(b.num_rows, -1).astype(kind) for k in (2, 3))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cosines(x, y))], names=["query_id", "vec_id", "score"])

    return freed(run)


def windowed(rows: DataFrame, size: int, kind: str, k: int, every: int, curves: int, dims: int, bits: int, window: int, seed: int) -> DataFrame:
    """query_id, vec_id and score of the best in each query's windows, by codes 4 * k of them, scored by the vectors."""
    found = stored(laid(rows, size, curves, dims, bits, seed, kind, False, 1 << 18).mapInArrow(_windows(4 * k, window, every), NEAR), "curve-windows")
    inside = found.filter("query_id is not null").select("query_id", "vec_id", "near")
    # Across edges of tasks: a row's place on the whole curve tells its cell, and windows reach into the next ones.
    order = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    starts = found.filter("size is not null").select("curve", "part", F.coalesce(F.sum("size").over(order), F.lit(0)).alias("start"))
    edges = found.filter("code is not null").join(starts, ["curve", "part"]).select("curve", "part", "vec_id", "code", (F.col("start") + F.col("at")).alias("rank"))
    edges = stored(edges.withColumn("cell", F.floor(F.col("rank") / window)), "curve-edges")
    asked = edges.filter(F.col("vec_id") % every == 0).withColumn("cell", F.explode(F.array(*[F.col("cell") + i for i in (-1, 0, 1)])))
    cells = edges.withColumn("asked", F.lit(False)).unionByName(asked.withColumn("asked", F.lit(True))).groupBy("curve", "cell")
    across = cells.applyInArrow(_across(4 * k, window), "query_id long, vec_id long, near float")  # a cell has at most ``window`` rows
    one = inside.unionByName(across).groupBy("query_id", "vec_id").agg(F.max("near").alias("near"))
    order = Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id")
    few = stored(one.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= 4 * k).select("query_id", "vec_id"), "curve-candidates")
    both = few.join(rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("x")), "query_id").join(rows.select("vec_id", F.col("embedding").alias("y")), "vec_id")
    return both.select("query_id", "vec_id", "x", "y").mapInArrow(_scored(kind), "query_id long, vec_id long, score double")


def _blocks(block: int, kind: str):
    """Blocks of rows that come in a curve's order."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        for b in found:
            for low in range(0, b.num_rows, block):
                part = b.slice(low, block)
                ids, vecs = np.asarray(part.column(0)), np.frombuffer(b"".join(part.column(1).to_pylist()), kind).reshape(part.num_rows, -1)
                u = unit(vecs)
                centre = u.mean(0)
                norm = np.linalg.norm(centre)
                centre = centre / norm if norm > 1e-12 else u[0]
                row = [[(task << 32) + made], [ids.astype(np.int64).tobytes()], [vecs.tobytes()], [centre.tobytes()], [float((u @ centre).min())]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in row], names=[x.split()[0] for x in BLOCK.split(", ")])
                made += 1

    return freed(run)


def _chunks(size: int, kind: str):
    """Queries, with their k-th best so far, packed."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        for b in found:
            for at in range(0, b.num_rows, size):
                x = b.slice(at, size)
                packed = [np.asarray(x.column(0)).astype(np.int64).tobytes(), b"".join(x.column(1).to_pylist()), np.asarray(x.column(2)).astype(float).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + made]), *(pa.array([p], pa.binary()) for p in packed)], names=["chunk", "query_ids", "queries", "least"])
                made += 1

    return freed(run)


def _bounds(kind: str):
    """Pairs of a chunk and a block that may hold something for one of its queries."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            for chunk, q, least, blocks, centres, cos in zip(*(b.column(k).to_pylist() for k in range(6))):
                least, blocks, cos = np.frombuffer(least), np.frombuffer(blocks, np.int64), np.frombuffer(cos)
                q, centres = unit(np.frombuffer(q, kind).reshape(len(least), -1)), np.frombuffer(centres).reshape(len(blocks), -1)
                angle = np.arccos(np.clip(q @ centres.T, -1, 1)) - np.arccos(np.clip(cos, -1, 1))
                open_ = blocks[(np.cos(np.maximum(angle, 0)) >= least[:, None] - 1e-6).any(0)]
                if len(open_):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(open_), chunk)), pa.array(open_)], names=["chunk", "block"])

    return freed(run)


def _opened(k: int, kind: str):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            for query_ids, q, least, ids, vecs in zip(*(b.column(j).to_pylist() for j in range(5))):
                query_ids, least, ids = np.frombuffer(query_ids, np.int64), np.frombuffer(least), np.frombuffer(ids, np.int64)
                q, v = np.frombuffer(q, kind).reshape(len(query_ids), -1), np.frombuffer(vecs, kind).reshape(len(ids), -1)
                near, out = unit(q) @ unit(v).T, []
                for i in np.flatnonzero(near.max(1) >= least - SLACK):
                    out += best(int(query_ids[i]), q[i], ids, v, near[i], k, float(least[i]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    return freed(run)


def usable(vectors: DataFrame) -> tuple[DataFrame, int, str]:
    """Rows that take part, how many they are, and the kind of their numbers."""
    column = F.col("embedding")
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    rows = vectors.select(F.col("vec_id").cast("long"), (column if kind == "<f4" else column.cast("array<double>")).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(finite & F.exists("embedding", lambda x: x != 0))
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return (rows, 0, kind) if sizes is None else (rows.filter(F.size("embedding") == sizes["n"]), sizes["count"], kind)


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best distinct vectors of each query, with rank."""
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return one.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(vectors: DataFrame, k: int = 5, every: int = 50, curves: int = 8, dims: int = 8, bits: int = 6, window: int = 256, block: int = 1024, widen: bool = True, seed: int = 17) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of each row whose vec_id is divisible by ``every``.

    Vectors that are null, zero or of another length than most, or that hold null or non-finite numbers,
    take no part, nor do rows without vec_id. Rows of one vec_id count as one, by their best score, and are
    never their own neighbours. Ties go to the smaller vec_id. With fewer than k candidates all are
    returned; an empty table gives no rows. Other columns are ignored. ``widen=False`` stops after the
    windows: approximate, linear in the rows, and the same whatever the partitions, unless rows are repeated.
    """
    spark = vectors.sparkSession
    prepare(spark)
    if dims * bits > 54 or curves > 256:
        raise ValueError("keys of all curves are held in 64 bits: dims * bits may be 54, curves 256")
    rows, size, kind = usable(vectors)
    first = stored(_top(windowed(rows, size, kind, k, every, curves, dims, bits, window, seed), k).select("query_id", "rank", "vec_id", "score"), "curve-first")
    if not widen:
        return first.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    packed = laid(rows, size, 1, dims, bits, seed, kind, True, 1 << 17).select("vec_id", "vec")
    blocks = stored(packed.mapInArrow(_blocks(block, kind), BLOCK), "curve-blocks")
    kth = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).otherwise(-2.0).alias("least"))
    queries = rows.filter(F.col("vec_id") % every == 0).mapInArrow(_keys(1, dims, bits, seed, kind, True, NO_CUTS), KEYED).join(kth, F.col("vec_id") == F.col("query_id"), "left")
    queries = queries.select("vec_id", "vec", F.coalesce("least", F.lit(-2.0)).alias("least"), "key")
    chunked = stored(queries.repartitionByRange("key", "vec_id").sortWithinPartitions("key", "vec_id").drop("key").mapInArrow(_chunks(1024, kind), "chunk long, query_ids binary, queries binary, least binary"), "query-chunks")
    # Summaries of blocks, 1024 in a row, meet each chunk once: rows are numbered by a hash of the block.
    per = max(1, -(-blocks.count() // 1024))
    packed = blocks.select(F.pmod(F.xxhash64("block"), F.lit(per)).cast("int").alias("group"), "block", "centre", "cosine")
    summary = packed.groupBy("group").applyInArrow(_summary, "group int, blocks binary, centres binary, cosines binary")
    spread = chunked.select("chunk", "queries", "least", F.explode(F.sequence(F.lit(0), F.lit(per - 1))).alias("group"))
    pairs = spread.join(summary, "group").select("chunk", "queries", "least", "blocks", "centres", "cosines").mapInArrow(_bounds(kind), "chunk long, block long")
    # A chunk goes to as many keys as keep about 64 blocks each, so that no task has all that it opens.
    salts = per * SALTS
    salted = chunked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    opened = pairs.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")).join(blocks.select("block", "ids", "vecs"), "block")
    opened = opened.join(salted, ["chunk", "salt"]).select("query_ids", "queries", "least", "ids", "vecs")
    more = opened.mapInArrow(_opened(k, kind), "query_id long, vec_id long, score double")
    return _top(first.drop("rank").unionByName(more), k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _summary(found: pa.Table) -> pa.Table:
    """One row for a group of about 1024 blocks."""
    found = found.combine_chunks()
    return pa.table({"group": found["group"][:1], "blocks": [np.asarray(found["block"]).astype(np.int64).tobytes()], "centres": [b"".join(found["centre"].to_pylist())], "cosines": [np.asarray(found["cosine"]).astype(float).tobytes()]})
