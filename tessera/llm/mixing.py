"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Each source is dealt by a seeded hash over shards, and the words of a shard, in seeded order of its
documents, are cut into blocks of ``block`` words. Blocks are the seats of an apportionment: first among
sources in proportion to their targets, then, for each source, among its shards in proportion to their
words, each time to the highest quotients v / (2s + 1). A shard then takes its quota of blocks: whole
passes over all its blocks and a run of blocks that starts at a seeded place and may wrap around.

Only per-source and per-shard totals reach the driver: at most ``max_shards`` rows a source. A shard that
holds more than ``shard_docs`` documents is laid out in sub-shards by the high bits of the seeded hash, so
that no window grows with the source: words before a sub-shard are summed over a tree of such bits.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import WORD, prepare, stored

WEIGHTS = (3.0, 1.0, 2.0)


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words wanted from each source: ``share`` of all words by weight, where no source gives more than
    ``most`` times its own; the rest is shared out again by weight until none is above."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), share * sum(sizes)
    while open_:
        unit = left / (sum(weights[i] for i in open_) or 1.0)
        full = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if out[i] == 0 and i not in full]
    return out


def sainte_lague(votes: list[float], seats: int, most: list[int]) -> list[int]:
    """Seats by highest quotients v / (2s + 1), at most ``most[i]`` each; ties go to the smaller index.

    The quota v / V * seats is met within half a seat of a common divisor, so the search starts one seat
    below what a bisected divisor gives and deals the last few seats one by one from a heap.
    """
    votes = np.asarray(votes, float)
    most = np.asarray(most, np.int64)
    seats = min(int(seats), int(most[votes > 0].sum()))
    if seats <= 0:
        return [0] * len(votes)

    def given(d: float) -> np.ndarray:
        return np.minimum(np.floor(votes / d + 0.5), most).astype(np.int64)

    low, high = votes[votes > 0].min() / (2.0 * most.max() + 2.0), 2.0 * votes.max() + 1.0
    for _ in range(200):
        mid = math.sqrt(low * high)
        low, high = (mid, high) if given(mid).sum() > seats else (low, mid)
        if high / low < 1 + 1e-14:
            break
    got = given(high)
    heap = [(-votes[i] / (2 * got[i] + 1), i) for i in range(len(votes)) if votes[i] > 0 and got[i] < most[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got.tolist()


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


SAME = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & (F.col(f"{a}.shard") == F.col(f"{b}.shard"))
WIDTH = 8  # bits of a level of the tree


def _before(parts: DataFrame, bits: int) -> DataFrame:
    """source, shard, sub, words and before: the words of the smaller sub-shards of the shard."""
    up = F.shiftright("sub", WIDTH)
    order = Window.partitionBy("source", "shard", up).orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    laid = parts.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
    if bits <= WIDTH:
        return laid
    above = _before(parts.groupBy("source", "shard", up.alias("sub")).agg(F.sum("words").alias("words")), bits - WIDTH)
    joined = laid.alias("a").join(above.alias("b"), SAME("a", "b") & (F.shiftright("a.sub", WIDTH) == F.col("b.sub")))
    return joined.select("a.source", "a.shard", "a.sub", "a.words", (F.col("a.before") + F.col("b.before")).alias("before"))


def ends(dealt: DataFrame, bits: int) -> DataFrame:
    """Adds _end: the words of a document's shard up to its last one. ``bits``: the most that number sub-shards.

    A window holds a sub-shard; only rows equal in doc_id and size, whose hash is equal, can make it large.
    """
    order = Window.partitionBy("source", "shard", *["sub"] * (bits > 0)).orderBy("_key", "doc_id", "size")
    laid = dealt.withColumn("_end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    if not bits:
        return laid
    parts = stored(dealt.groupBy("source", "shard", "sub").agg(F.sum("size").alias("words")), "mix-parts")
    joined = laid.alias("d").join(_before(parts, bits).alias("p"), SAME("d", "p") & (F.col("d.sub") == F.col("p.sub")))
    return joined.select(*(f"d.{c}" for c in dealt.columns), (F.col("_end") + F.col("before")).alias("_end"))


def deal(narrow: DataFrame, facts: list[tuple], seed: int) -> DataFrame:
    """Documents with facts of their source, shard and sub-shard."""
    plan = narrow.sparkSession.createDataFrame(facts, "source string, shards int, bits int, source_size long, target double")
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    same = F.col("d.source").eqNullSafe(F.col("p.source"))
    part = F.expr("CASE WHEN bits > 0 THEN shiftright(_key, 64 - bits) + shiftleft(1L, bits - 1) ELSE 0L END")
    dealt = narrow.alias("d").join(plan.alias("p"), same).withColumn("_key", key)
    return dealt.select("doc_id", "d.source", "size", "source_size", "target", "_key", F.pmod("_key", F.col("shards")).cast("int").alias("shard"), part.alias("sub"))


def shape(n: int, shard_docs: int, max_shards: int) -> tuple[int, int]:
    """How many shards a source of n documents has, and how many bits number the sub-shards of each."""
    shards = min(max_shards, max(1, -(-n // shard_docs)))
    return shards, max(0, -(-n // (shards * shard_docs)) - 1).bit_length()


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7, block: int = 16, shard_docs: int = 256, max_shards: int = 4096) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken, first (how often the mix takes its first word).

    Sources are ordered by code point, null last; ``weights`` repeat over them. A null or empty text has
    size 0 and is never taken. Repeated rows are separate documents, dealt and counted on their own. An
    empty table gives no rows. Other columns are ignored. The order of documents in a shard is by seeded
    hash of doc_id and size, so reruns agree; rows equal in both are interchangeable.
    """
    spark = docs.sparkSession
    prepare(spark)
    narrow = stored(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "mix-sizes")
    per = [r for r in narrow.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()]
    per.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    sizes = [r["size"] for r in per]
    want = targets(sizes, [weights[i % len(weights)] for i in range(len(per))], share, most)
    blocks = sainte_lague(want, round(sum(want) / block), [int(most * -(-s // block)) for s in sizes])
    facts = [(r["source"], *shape(r["n"], shard_docs, max_shards), r["size"], t) for r, t in zip(per, want)]
    dealt = deal(narrow, facts, seed)
    held = dealt.groupBy("source", "shard").agg(F.sum("size").alias("words")).collect()
    by: dict = {}
    for r in sorted(held, key=lambda r: r["shard"]):
        by.setdefault(r["source"], []).append((r["shard"], r["words"]))
    quotas = []
    for (source, *_), seats in zip(facts, blocks):
        parts = by[source]
        n = [-(-w // block) for _, w in parts]
        got = sainte_lague([float(w) for _, w in parts], seats, [int(most * k) for k in n])
        quotas += [(source, shard, w, max(1, k), q) for (shard, w), k, q in zip(parts, n, got)]
    quota = spark.createDataFrame(quotas, "source string, shard int, words long, blocks long, quota long")
    laid = ends(dealt, max((bits for _, _, bits, _, _ in facts), default=0)).alias("d").join(quota.alias("q"), SAME("d", "q"))
    passes, extra = F.floor(F.col("quota") / F.col("blocks")), F.col("quota") % F.col("blocks")
    first = F.pmod(F.xxhash64(F.lit(seed), F.lit("start"), F.col("d.source"), F.col("d.shard")), F.col("blocks"))
    begin, stop, turn = first * block, (first + extra) * block, F.col("blocks") * block
    within = lambda a, b: F.greatest(F.lit(0), F.least(F.col("_end"), b) - F.greatest(F.col("_end") - F.col("size"), a))
    holds = lambda a, b: ((F.col("_end") - F.col("size") >= a) & (F.col("_end") - F.col("size") < b)).cast("long")
    some = F.col("size") > 0
    return laid.select(
        "doc_id", "d.source", "size", "source_size", "target",
        F.when(some, passes * F.col("size") + within(begin, stop) + within(F.lit(0), stop - turn)).otherwise(0).cast("long").alias("taken"),
        F.when(some, passes + holds(begin, stop) + holds(F.lit(0), stop - turn)).otherwise(0).cast("int").alias("first"),
    )
