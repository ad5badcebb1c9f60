"""Quality of texts by a convolutional network over bytes, in numpy.

A text's bytes are laid in blocks of ``stride``; overlapping chunks of two blocks cover all of it. Each byte
has a learned vector, each filter is learned over a chunk, and the largest answer of each filter over all
chunks goes through one hidden layer into one probability. The largest answers are kept as running maxima,
so texts of any length are scored whole in bounded memory.

Training is by Adam on a bounded sample of labelled rows, ``per_label`` of each label, at most ``most_bytes``
long and ``total_bytes`` together, chosen by a hash of doc_id among rows whose crc32(doc_id) mod 5 is not 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import freed, prepare, text_buffers

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def layout(data: np.ndarray, offsets: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of bytes, each text with one empty block after it, and the first block of each text. Byte 0 is padding."""
    sizes = np.diff(offsets)
    blocks = np.maximum(1, -(-sizes // stride)) + 1
    first = np.append(0, np.cumsum(blocks))
    out = np.zeros(int(first[-1]) * stride, np.uint8)
    out[np.repeat(first[:-1] * stride - offsets[:-1], sizes) + np.arange(len(data))] = data
    return out.reshape(-1, stride), first


class Network:
    """embed (256, d), wide (2 * stride * d, filters), bias, hidden (filters, h), hidden bias, out (h), out bias."""

    def __init__(self, stride: int = 16, d: int = 6, filters: int = 32, hidden: int = 16, seed: int = 5):
        r = np.random.default_rng(seed)
        n = 2 * stride * d
        self.stride, self.d = stride, d
        self.p = {
            "embed": r.normal(0, 0.5, (256, d)), "wide": r.normal(0, 1 / np.sqrt(n), (n, filters)), "bias": np.zeros(filters),
            "hidden": r.normal(0, 1 / np.sqrt(filters), (filters, hidden)), "hbias": np.zeros(hidden), "out": r.normal(0, 1 / np.sqrt(hidden), hidden), "obias": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def answers(self, blocks: np.ndarray) -> np.ndarray:
        """Answers of all filters at the chunks that start at each block but the last."""
        x = self.p["embed"][blocks].reshape(len(blocks), -1)
        half = self.stride * self.d
        return (x @ self.p["wide"][:half])[:-1] + (x @ self.p["wide"][half:])[1:]

    def pooled(self, data: np.ndarray, offsets: np.ndarray, most: int = 1 << 16) -> np.ndarray:
        """Largest answer of each filter over all chunks of each text, taking ``most`` blocks at a time."""
        blocks, first = layout(data, offsets, self.stride)
        n = len(first) - 1
        out = np.full((n, self.p["bias"].size), -np.inf, np.float32)
        for low in range(0, len(blocks) - 1, most):
            y = self.answers(blocks[low : low + most + 1])
            a, z = np.searchsorted(first, low, side="right") - 1, np.searchsorted(first, low + len(y), side="left")
            ends = first[a + 1 : z + 1] - 1 - low  # the block after a text starts no chunk
            y[ends[(ends >= 0) & (ends < len(y))]] = -np.inf
            np.maximum(out[a:z], np.maximum.reduceat(y, np.maximum(first[a:z] - low, 0), axis=0), out=out[a:z])
        return out

    def head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = np.tanh(pooled + self.p["bias"])
        h = np.maximum(m @ self.p["hidden"] + self.p["hbias"], 0)
        return m, h, 1 / (1 + np.exp(-np.clip(h @ self.p["out"] + self.p["obias"], -30, 30)))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) < 2:
            return np.empty(0)
        return self.head(self.pooled(data, offsets))[2].astype(float)

    def gradient(self, data: np.ndarray, offsets: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict:
        blocks, first = layout(data, offsets, self.stride)
        y, n, half = self.answers(blocks), len(label), self.stride * self.d
        at = np.stack([first[k] + y[first[k] : first[k + 1] - 1].argmax(0) for k in range(n)])
        m, h, p = self.head(np.take_along_axis(y, at, 0))
        g = (weight * (p - label) / weight.sum()).astype(np.float32)
        gh = g[:, None] * self.p["out"] * (h > 0)
        gm = gh @ self.p["hidden"].T * (1 - m * m)
        seen = np.concatenate([blocks[at], blocks[at + 1]], axis=2)  # n, filters, bytes of the chunk
        x = self.p["embed"][seen].reshape(n, at.shape[1], -1)
        gx = (gm[:, :, None] * self.p["wide"].T[None]).reshape(-1, self.d)
        flat = seen.ravel()
        embed = np.stack([np.bincount(flat, gx[:, k], 256) for k in range(self.d)], 1)
        assert half * 2 == x.shape[2]
        return {"embed": embed, "wide": np.einsum("nf,nfx->xf", gm, x, optimize=True), "bias": gm.sum(0), "hidden": m.T @ gh, "hbias": gh.sum(0), "out": h.T @ g, "obias": g.sum(keepdims=True)}

    def fit(self, texts: list[bytes], labels: list[int], epochs: int = 12, size: int = 64, rate: float = 0.01, seed: int = 11, steps: int = 600) -> Network:
        """Adam with equal weight for both labels; the rate falls to a tenth. At least ``steps`` steps."""
        r, y = np.random.default_rng(seed), np.asarray(labels, np.float32)
        weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
        m, v, t = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        per = max(1, -(-len(texts) // size))
        epochs = max(epochs, -(-steps // per))
        total = epochs * per
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for k in range(0, len(order), size):
                part = order[k : k + size]
                some = [texts[i] for i in part]
                offsets = np.append(0, np.cumsum([len(s) for s in some]))
                grads = self.gradient(np.frombuffer(b"".join(some), np.uint8), offsets, y[part], weight[part].astype(np.float32))
                t += 1
                now = rate * (1 - 0.9 * t / total)
                for name, g in grads.items():
                    g = g + 1e-4 * self.p[name]
                    m[name], v[name] = 0.9 * m[name] + 0.1 * g, 0.999 * v[name] + 0.001 * g * g
                    self.p[name] -= (now * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
        return self


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, per_label: int, most_bytes: int, total_bytes: int, seed: int = 3) -> DataFrame:
    """The labelled rows to train on: quality and text, at most ``per_label`` and half of ``total_bytes`` of each label."""
    rows = labels.filter(~held_out("doc_id") & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    order = [F.xxhash64(F.lit(seed), F.col("doc_id")), F.col("doc_id")]
    short = docs.filter(F.octet_length("text") <= most_bytes).select("doc_id", "text")
    chosen = [rows.filter(F.col("quality") == k).distinct().orderBy(*order).limit(per_label) for k in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * per_label rows, as what follows
    sizes = short.select("doc_id", F.octet_length("text").alias("size")).join(ids, "doc_id").groupBy("doc_id", "quality").agg(F.max("size").alias("size"))
    held = F.sum("size").over(Window.partitionBy("quality").orderBy(*order))
    kept = F.broadcast(sizes.withColumn("held", held).filter(F.col("held") <= total_bytes // 2).select("doc_id", "quality"))
    return short.join(kept, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, per_label: int = 3000, most_bytes: int = 65_536, total_bytes: int = 64 << 20, **options) -> Network:
    """A network fitted to labels.quality; with no labelled rows, or of one label only, one that answers by its bias.

    ``total_bytes`` bounds the text that reaches the driver, ``most_bytes`` that of one document.
    """
    rows = sample(docs, labels, per_label, most_bytes, total_bytes).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["quality"]))
    net = Network()
    if len({r["quality"] for r in rows}) == 2:
        net.fit([(r["text"] or "").encode() for r in rows], [r["quality"] for r in rows], **options)
    else:
        net.p["out"][:] = 0
        net.p["obias"][:] = 2.0 if not rows or rows[0]["quality"] == 1 else -2.0
    return net


def _scorer(net: Network, at_least: float, keep: bool):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            if not b.num_rows:
                continue
            scores = np.concatenate([net.score(*text_buffers(b.column(0).slice(k, 128))) for k in range(0, b.num_rows, 128)])
            if keep:
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(scores)], names=[*b.schema.names[1:], "_score"])
            else:
                yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(scores), pa.array((scores >= at_least).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return freed(run)


def score(docs: DataFrame, net: Network, at_least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of ``at_least``) of each document.

    A null text is scored as an empty one. Repeated rows give repeated rows; a null doc_id is not held out;
    an empty table gives no rows; columns other than doc_id and text are not read.
    """
    prepare(docs.sparkSession)
    rows = docs.select("text", F.col("doc_id").cast("long"), held_out("doc_id").alias("held_out"))
    return rows.mapInArrow(_scorer(net, at_least, False), SCHEMA)


def keep(docs: DataFrame, net: Network, at_least: float = 0.3) -> DataFrame:
    """The documents, with all their columns, that score ``at_least``.

    A null text is scored as an empty one. Repeated rows get one score, so they stay or go together; a score of
    exactly ``at_least`` stays; an empty table gives no rows.
    """
    from pyspark.sql.types import DoubleType, StructType

    prepare(docs.sparkSession)
    names = [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names)
    rows = plain.select(F.col(names[docs.columns.index("text")]).alias("_text"), *names)
    scored = rows.mapInArrow(_scorer(net, at_least, True), StructType([*plain.schema.fields]).add("_score", DoubleType()))
    return scored.filter(F.col("_score") >= at_least).drop("_score").toDF(*docs.columns)
