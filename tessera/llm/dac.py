"""Token ids in files of directly addressable codes.

An id is cut into chunks of ``bits`` bits, low chunk first. Level 0 holds the first chunk of every token,
level 1 the second chunk of those that have one, and so on; a bitmap a level tells which tokens go on, and a
directory with the count of set bits before every 512 tells where. So token i is read by one chunk, one bit
and one rank a level, without decoding what comes before it.

A file: magic, length and CRC-32 of a JSON header, the header (sections with their types, places and lengths),
the sections, and a CRC-32 of all before it. Documents lie whole in a file, in ascending doc_id order over
files. A file is opened by its header alone; a token is read from where it lies, by a few ranges of bytes a
level, and ``verify`` reads all of a file, a megabyte at a time.
"""

from __future__ import annotations

import contextlib
import functools
import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import commit, filesystem, freed, prepare, scratch, stored
from .tokens import encoder

MAGIC = b"TOKDAC01"
SPAN = 512
ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
MANIFEST = "path string, part int, seq int, docs long, tokens long, bytes long"
RECORD = "doc_id long, start long, n_tokens long, ids_crc32 long"


def levels(ids: np.ndarray, bits: int = 8) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level its chunks, its packed continuation bits and its rank directory."""
    out, rest, kind = [], ids.astype(np.uint32), np.uint8 if bits <= 8 else np.uint16
    while True:
        more = rest >> np.uint32(bits)
        goes_on = more > 0
        packed = np.packbits(goes_on, bitorder="little")
        packed = np.append(packed, np.zeros(-len(packed) % (SPAN // 8), np.uint8))
        counts = ONES[packed].reshape(-1, SPAN // 8).sum(1, dtype=np.uint64)
        out.append(((rest & np.uint32((1 << bits) - 1)).astype(kind), packed, np.append(np.uint64(0), np.cumsum(counts, dtype=np.uint64))))
        if not goes_on.any():
            return out
        rest = more[goes_on]


def pack(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, bits: int = 8) -> bytes:
    """The bytes of a file."""
    parts = {"doc_id": np.array([d or 0 for d in doc_ids], np.int64), "no_id": np.array([d is None for d in doc_ids], np.uint8), "offsets": np.append(0, np.cumsum(lengths)).astype(np.int64)}
    for k, (chunks, marks, directory) in enumerate(levels(ids, bits)):
        parts |= {f"chunks{k}": chunks, f"marks{k}": marks, f"ranks{k}": directory}
    body, sections = bytearray(), {}
    for name, a in parts.items():
        body += b"\0" * (-len(body) % 8)
        sections[name] = [a.dtype.str, len(body), len(a)]
        body += a.tobytes()
    head = json.dumps({"bits": bits, "docs": len(doc_ids), "tokens": len(ids), "sections": sections}).encode()
    data = MAGIC + struct.pack("<II", len(head), zlib.crc32(head)) + head + bytes(body)
    return data + struct.pack("<I", zlib.crc32(data))


class File:
    """Random access to the tokens of a file. ``read(start, stop)`` gives its bytes; all but the header are read on demand."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self._read, self.size = read, size
        start = read(0, 16)
        if len(start) < 16 or start[:8] != MAGIC:
            raise ValueError("not a file of token ids")
        n, crc = struct.unpack_from("<II", start, 8)
        head = read(16, 16 + n)
        if zlib.crc32(head) != crc:
            raise ValueError("the header of a file of token ids is broken")
        self.head, self._base = json.loads(head), 16 + n
        self.bits, self.tokens, self.docs = self.head["bits"], self.head["tokens"], self.head["docs"]
        self.sections = {k: (np.dtype(t), place, count) for k, (t, place, count) in self.head["sections"].items()}
        self.levels = sum(x.startswith("chunks") for x in self.sections)

    @staticmethod
    def of(data: bytes) -> File:
        return File(lambda a, z: data[a:z], len(data))

    @staticmethod
    @contextlib.contextmanager
    def open(path: str) -> Iterator[File]:
        fs, place = filesystem(path)
        with fs.open_input_file(place) as f:
            yield File(lambda a, z: f.read_at(z - a, a), f.size())

    def verify(self, step: int = 1 << 20) -> None:
        """Raise ValueError unless the whole file has its checksum."""
        crc = 0
        for a in range(0, self.size - 4, step):
            crc = zlib.crc32(self._read(a, min(a + step, self.size - 4)), crc)
        if crc != struct.unpack("<I", self._read(self.size - 4, self.size))[0]:
            raise ValueError("not a whole file of token ids")

    def part(self, name: str, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Some numbers of a section."""
        kind, place, count = self.sections[name]
        stop = count if stop is None else min(stop, count)
        at = self._base + place
        return np.frombuffer(self._read(at + start * kind.itemsize, at + stop * kind.itemsize), kind)

    @functools.cached_property
    def offsets(self) -> np.ndarray:
        return self.part("offsets")

    @property
    def doc_ids(self) -> list[int | None]:
        return [None if no else int(d) for d, no in zip(self.part("doc_id"), self.part("no_id"))]

    def _rank(self, level: int, i: int) -> int:
        """Set bits before bit i of a level's bitmap."""
        block, byte = i // SPAN, i // 8
        marks = self.part(f"marks{level}", block * (SPAN // 8), byte + 1)
        found = int(self.part(f"ranks{level}", block, block + 1)[0]) + int(ONES[marks[: byte - block * (SPAN // 8)]].sum(dtype=np.int64))
        return found + (bin(int(marks[-1]) & ((1 << (i % 8)) - 1)).count("1") if i % 8 else 0)

    def token(self, i: int) -> int:
        """Token i of the file."""
        out, shift = 0, 0
        for k in range(self.levels):
            out |= int(self.part(f"chunks{k}", i, i + 1)[0]) << shift
            if not self.part(f"marks{k}", i // 8, i // 8 + 1)[0] >> (i % 8) & 1:
                break
            i, shift = self._rank(k, i), shift + self.bits
        return out

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Tokens start to stop of the file."""
        out, where, shift = np.zeros(stop - start, np.uint32), slice(None), 0
        for k in range(self.levels):
            out[where] |= self.part(f"chunks{k}", start, stop).astype(np.uint32) << np.uint32(shift)
            low = start // 8
            on = np.unpackbits(self.part(f"marks{k}", low, (stop + 7) // 8), bitorder="little")[start - 8 * low : stop - 8 * low].astype(bool)
            if not on.any():
                break
            start = self._rank(k, start)
            stop, shift = start + int(on.sum()), shift + self.bits
            where = np.flatnonzero(on) if isinstance(where, slice) else where[on]
        return out

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.offsets[k]), int(self.offsets[k + 1]))

    def documents(self, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Runs of documents of about ``most`` tokens: the first one, their offsets and their tokens."""
        at, offsets = 0, self.offsets
        while at < self.docs:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield at, offsets[at : end + 1] - offsets[at], self.slice(int(offsets[at]), int(offsets[end]))
            at = end


def _writer(folder: str, tokenizer: str, end: int | None, roll: int, bits: int):
    def write(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get(), 0
        docs, lengths, ids, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, lengths, ids, held, seq
            data = pack(docs, np.concatenate(lengths), np.concatenate(ids), bits)
            fs, base = filesystem(folder)
            fs.create_dir(base)
            name = f"tokens-{task.partitionId():06d}-{seq:05d}.dac"
            temporary = f"{base}/.{name}.{task.taskAttemptId()}"
            with fs.open_output_stream(temporary) as f:
                f.write(data)
            commit(fs, temporary, f"{base}/{name}")
            row = {"path": [f"{folder}/{name}"], "part": pa.array([task.partitionId()], pa.int32()), "seq": pa.array([seq], pa.int32()), "docs": [len(docs)], "tokens": [held], "bytes": [len(data)]}
            docs, lengths, ids, held, seq = [], [], [], 0, seq + 1
            return pa.RecordBatch.from_pydict(row)

        for part, got, offsets in encoder(tokenizer).stream(found, end):
            docs += part.column(0).to_pylist()
            lengths.append(np.diff(offsets))
            ids.append(got)
            held += len(got)
            if held >= roll:
                yield flush()
        if docs:
            yield flush()

    return freed(write)


def write(docs: DataFrame, folder: str, tokenizer: str, end: int | None = 0, roll: int = 4_000_000, bits: int = 8) -> DataFrame:
    """Write the ids of each text, and the id ``end`` after it, in ascending doc_id order; returns the manifest.

    A null text is empty. Rows with a null doc_id come first; rows of one doc_id are in order of a hash of
    their texts, and equal rows are written as often as they come. An empty table gives an empty manifest.
    A file holds about ``roll`` tokens, or one batch of documents if that is more. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie"))
    laid = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").drop("_tie")
    return stored(laid.mapInArrow(_writer(folder, tokenizer, end, roll, bits), MANIFEST), "token-manifest")


def _reader(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in found:
        for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            with File.open(path) as file:
                file.verify()
                doc_ids = file.doc_ids
                for first, offsets, ids in file.documents():
                    ids = ids.astype("<u4")
                    crc = [zlib.crc32(ids[a:z].tobytes()) for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                    starts = offsets[:-1] + file.offsets[first] + base
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[first : first + len(crc)], pa.int64()), pa.array(starts), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """One row a document from the files of a manifest: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The running sum over the manifest has one row a file, so one task orders it at any size of corpus.
    """
    prepare(spark)
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    listed = manifest.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long").alias("base"))
    n = max(1, min(10_000, manifest.count()))
    return listed.repartition(n).mapInArrow(_reader, RECORD)


def round_trip(docs: DataFrame, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """Write the documents and read them back."""
    spark = docs.sparkSession
    return read(spark, write(docs, folder or scratch(spark, "tokens"), tokenizer, **options))
