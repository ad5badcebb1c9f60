"""Hierarchical multi-length packing of token ids into context windows.

Documents are cut into full windows of the longest tier; what remains of a document is routed to the
shortest tier that holds it. Each tier's windows are packed from its own remainders, best fit first, gaps of
long windows are filled from shorter tiers, and only what closes a window is cut. So every window is full
but the last of a task, whose rest is laid out in windows of powers of two down to the shortest tier and one
padded window below that.

Packing runs where the rows are read: texts are not shuffled, and a task holds one pool of remainders at a time.
Then the windows of each tier are numbered over all tasks, by what each task made of each tier, and dealt into
step groups of equal tokens: only the last group of a tier is short.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import freed, prepare, stored
from .tokens import encoder

TIERS = (64, 128, 256, 512, 1024)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, task int, nth long"


class _Pool:
    """Pieces by length: each (length, number, doc, start, ids, doc_tokens)."""

    def __init__(self):
        self.items: list = []
        self.n = 0

    def put(self, doc, start, ids, total) -> None:
        self.n += 1
        bisect.insort(self.items, (len(ids), self.n, doc, start, ids, total), key=lambda x: x[:2])

    def take(self, most: int):
        """The longest piece of at most ``most`` ids, or None."""
        k = bisect.bisect_right(self.items, most, key=lambda x: x[0])
        return self.items.pop(k - 1)[2:] if k else None

    def least(self):
        return self.items.pop(0)[2:] if self.items else None


class Packer:
    """Packs the documents of one task."""

    def __init__(self, task: int, tiers: tuple = TIERS):
        self.tiers, self.longest, self.task = tiers, tiers[-1], task
        self.pools = {t: _Pool() for t in tiers}
        self.sequence, self.made, self.rows, self.held = task << 32, dict.fromkeys(tiers, 0), [], 0

    def _route(self, doc, start, ids, total) -> None:
        self.pools[next(t for t in self.tiers if t >= len(ids))].put(doc, start, ids, total)
        self.held += 1

    def add(self, doc, ids: np.ndarray) -> None:
        n, whole = len(ids), len(ids) // self.longest * self.longest
        for at in range(0, whole, self.longest):
            self._close([(doc, at, ids[at : at + self.longest], n)], self.longest)
        if whole < n:
            self._route(doc, whole, ids[whole:], n)

    def _close(self, pieces: list, tier: int) -> None:
        """Write a window as a sequence."""
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.sequence, at, tier, self.task, self.made[tier]))
            at += len(ids)
        self.sequence += 1
        self.made[tier] += 1

    def _fill(self, gap: int, below: int) -> list:
        """Pieces that fill a gap from tiers up to ``below``, longest tier first; the last may be cut."""
        out, usable = [], [t for t in reversed(self.tiers) if t <= below]
        while gap:
            got = next((x for t in usable if (x := self.pools[t].take(gap))), None)
            if got is None:
                got = next((x for t in reversed(usable) if (x := self.pools[t].least())), None)
                if got is None:
                    break
                doc, start, ids, total = got
                self._route(doc, start + gap, ids[gap:], total)
                got = (doc, start, ids[:gap], total)
            out.append(got)
            self.held -= 1
            gap -= len(got[2])
        return out

    def pack(self, last: bool = False) -> None:
        """Pack what the pools hold; unless it is the last time, the pieces of a window that stays open go back."""
        for tier in reversed(self.tiers):
            while got := self.pools[tier].take(tier):
                self.held -= 1
                pieces = [got, *self._fill(tier - len(got[2]), tier)]
                size = sum(len(x[2]) for x in pieces)
                if size == tier:
                    self._close(pieces, tier)
                elif last:
                    self._rest(pieces)
                else:
                    for x in pieces:
                        self._route(*x)
                    return

    def _rest(self, pieces: list) -> None:
        """Lay the last pieces out in windows of powers of two, the rest below the shortest tier in one padded window."""
        size = sum(len(x[2]) for x in pieces)
        while size:
            width = next((t for t in reversed(self.tiers) if t <= size), size)
            window, need = [], width
            while need:
                doc, start, ids, total = pieces.pop(0)
                window.append((doc, start, ids[:need], total))
                if len(ids) > need:
                    pieces.insert(0, (doc, start + need, ids[need:], total))
                need -= len(window[-1][2])
            self._close(window, width if width in self.tiers else self.longest)
            size -= width

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.int64()] * 7 + [pa.int32()] * 2 + [pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _packer(tokenizer: str, end: int | None, tiers: tuple, pool: int):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId(), tiers)
        for part, ids, offsets in encoder(tokenizer).stream(found, end):
            for doc, a, z in zip(part.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                packer.add(doc, ids[a:z])
            if packer.held > pool:
                packer.pack()
            if packer.rows:
                yield packer.batch()
        packer.pack(last=True)
        if packer.rows:
            yield packer.batch()

    return freed(run)


def balanced(packed: DataFrame, tiers: tuple, step: int) -> DataFrame:
    """Windows numbered over all tasks and dealt into step groups; the counts have a row for each task and tier."""
    made = packed.groupBy("task", "tier").agg((F.max("nth") + 1).alias("made"))
    order = Window.partitionBy("tier").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(made.withColumn("_before", F.coalesce(F.sum("made").over(order), F.lit(0))).drop("made"), "packed-windows")
    group = F.floor((F.col("_before") + F.col("nth")) * F.col("tier") / step) * len(tiers) + F.array_position(F.array(*map(F.lit, tiers)), F.col("tier")) - 1
    return packed.join(starts, ["task", "tier"]).withColumn("step_group", group.cast("long"))


def pack(docs: DataFrame, tokenizer: str, end: int | None = 0, tiers: tuple = TIERS, pool: int = 2048, step: int = 65_536) -> DataFrame:
    """One row a piece: doc_id, start (ids of its document before it), length, ids_crc32, doc_tokens, sequence_id,
    offset in its sequence, tier (the window that the sequence is for) and step_group.

    A step group holds windows of one tier that come to ``step`` tokens, or fewer windows if a window is longer;
    only the last of a tier holds less. A null or empty text is its end id alone. Repeated rows are packed as
    often as they come; a null doc_id stays null. An empty table gives no rows. Columns other than doc_id and
    text are ignored. A task pads at most one window. Sequence ids carry the number of the input partition and
    are not gapless.
    """
    prepare(docs.sparkSession)
    tiers = tuple(sorted(tiers))
    packed = stored(docs.select("doc_id", "text").mapInArrow(_packer(tokenizer, end, tiers, pool), SCHEMA), "packed")
    return balanced(packed, tiers, step).select(*[x.split()[0] for x in SCHEMA.split(", ")][:8], "step_group")
