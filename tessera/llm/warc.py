"""A deterministic sharded WARC writer and its reader.

Page ids are cut into ranges of at most ``shard`` bytes of payload: a histogram, made finer where a bucket
holds more, gives the cuts, so they follow from the data alone, whatever the cluster. Rows of one page_id,
and those of none, that hold more are cut by digest; only rows that agree in both stay in one range at any
size. A range is sorted by one task of its own, which writes gzip members
into files that roll at a compressed size, and its number is in their names. A file is written under a temporary name and renamed when it is whole; the
manifest, a table with one row a file, is written last, and only files that it names count. A task that is
run again writes the same bytes. Headers are made anew from the row: record ids are UUIDs of page_id and
digest, the date is a parameter, digests are computed from the bytes written.

Of records with equal payloads of at least ``least`` bytes, the one with the smallest page_id is a response
and the others are revisits of it. The pairs (page, page that it repeats) are computed from digests alone and
travel into the range sort as small rows beside the pages, so payloads are shuffled once.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import commit, filesystem, prepare, scratch, stored

EOL = b"\r\n"
BUCKETS = 1 << 20
IDS = uuid.UUID("6f1c9a52-52c9-4f0b-9d3e-0c6a6d2b7d11")
# Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CUTS = {"parent": pa.int32(), "bucket": pa.int64(), "to": pa.int32(), "cut": pa.int32(), "first_range": pa.int32(), "ranges": pa.int32()}
MANIFEST = "path string, first_page_id long, last_page_id long, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(IDS, f'{page_id}:{digest}')}>"


def _uri(url: str | None, page_id: int | None) -> str:
    if not url:
        return f"urn:page:{page_id}"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def render(page_id, url, payload: bytes, digest: str, first, revisit: bool, date: str) -> bytes:
    """One record, without compression. ``first``: the page that a revisit repeats."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date),
        ("WARC-Target-URI", _uri(url, page_id)), ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "application/http;msgtype=response"),
    ]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if url is None:
        head.append(("X-No-Url", "1"))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first, digest))]
        head += [("X-Refers-To-Page-Id", str(first))] if first is not None else []
    head.append(("Content-Length", str(len(block))))
    lines = EOL.join(f"{k}: {v}".encode() for k, v in head)
    return VERSION + EOL + lines + EOL + EOL + block + EOL + EOL


def _member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Files:
    """The files of one range."""

    def __init__(self, part: int, folder: str, roll: int, level: int, date: str):
        self.part, self.attempt = part, TaskContext.get().taskAttemptId()
        self.folder, self.roll, self.level, self.date, self.n, self.out = folder, roll, level, date, 0, None

    def add(self, page_id, record: bytes) -> list:
        if self.out is None:
            self.fs, base = filesystem(self.folder)
            self.fs.create_dir(base)
            name = f"pages-{self.part:06d}-{self.n:05d}.warc.gz"
            self.name, self.temporary, self.final = f"{self.folder}/{name}", f"{base}/.{name}.{self.attempt}", f"{base}/{name}"
            self.out, self.sha, self.size = self.fs.open_output_stream(self.temporary, compression=None), hashlib.sha256(), 0
            self.first, self.records = page_id, 0
            info = b"format: WARC File Format 1.1\r\n"
            head = f"WARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(None, name)}\r\nWARC-Date: {self.date}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
            self._write(_member(VERSION + EOL + head.encode() + info + EOL + EOL, self.level))
        self._write(_member(record, self.level))
        self.last, self.records = page_id, self.records + 1
        return self.close() if self.size >= self.roll else []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> list:
        if self.out is None:
            return []
        self.out.close()
        self.out = None
        commit(self.fs, self.temporary, self.final)
        self.n += 1
        return [(self.name, self.first, self.last, self.records, self.size, self.sha.hexdigest())]


def _writer(folder: str, roll: int, level: int, date: str):
    def write(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, key, first, listed, seen = None, (), None, False, 0
        schema = pa.schema([("path", pa.string()), ("first_page_id", pa.int64()), ("last_page_id", pa.int64()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
        for b in found:
            rows = []
            for page_id, digest, is_page, target, url, html, part in zip(*(b.column(k).to_pylist() for k in range(7))):
                if files is None or files.part != part:
                    rows += files.close() if files else []
                    files = _Files(part, folder, roll, level, date)
                if (page_id, digest) != key:
                    key, first, listed, seen = (page_id, digest), None, False, 0
                if not is_page:
                    first, listed = target, True
                    continue
                revisit = listed and (first != page_id or seen > 0)
                seen += 1
                rows += files.add(page_id, render(page_id, url, (html or "").encode(), digest, first, revisit, date))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        if files and (rows := files.close()):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return write


def _shift(first: int, last: int, most: int) -> int:
    """The fewest low bits to drop so that first to last fall into at most ``most`` buckets."""
    return next(k for k in range(64) if (last >> k) - (first >> k) < most)


def assigned(leaves: pd.DataFrame, most: int, first: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """The range of each leaf, in order of page ids, over how many ranges it goes, and the first range after all.

    Leaves share ranges of at most ``most`` bytes; one that holds more has one page_id and ranges of its own.
    """
    part, split, held = np.zeros(len(leaves), np.int32), np.ones(len(leaves), np.int32), 0
    for k, n in enumerate(leaves["bytes"].tolist()):
        if n > most:
            first += held > 0
            part[k], split[k], held = first, -(-n // most), 0
            first += int(split[k])
            continue
        if held + n > most:
            first, held = first + 1, 0
        part[k], held = first, held + n
    return part, split, first + (held > 0)


def ranges(pages: DataFrame, shard: int) -> tuple[Callable[[DataFrame], DataFrame], int]:
    """What adds to rows the column range, by page_id and digest, and the number of ranges.

    A bucket holds the ids that agree but for some low bits, so nothing overflows. Buckets above ``shard``
    bytes are cut again between their own smallest and largest id, until they are below or hold one id. There
    are about eight buckets for ``shard`` bytes, at most BUCKETS, and a pass makes at most twice as many rows.
    Beyond BUCKETS * ``shard`` bytes (32 TB at 32 MB) ranges grow instead of their number.
    """
    size = (F.coalesce(F.octet_length("html"), F.lit(0)) + 500).cast("long")
    sizes = pages.select(F.col("page_id").cast("long").alias("page_id"), size.alias("size"))
    low, high, total, none = sizes.agg(F.min("page_id"), F.max("page_id"), F.sum("size"), F.sum(F.when(F.col("page_id").isNull(), F.col("size")))).first()
    most = max(shard, -(-(total or 0) // BUCKETS))
    count = min(BUCKETS, max(64, -(-8 * (total or 0) // most)))
    root, levels = 0 if low is None else _shift(low, high, count), []

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({"node": F.lit(0), "shift": F.lit(root), "part": F.lit(0), "split": F.lit(1)})
        for held in levels:
            found = rows.sparkSession.createDataFrame(pa.table({k: pa.array(held[k].to_numpy(), t) for k, t in CUTS.items()}))
            bucket = F.when(F.col("shift") >= 0, F.expr("shiftright(page_id, shift)"))
            rows = rows.withColumn("at", bucket).join(F.broadcast(found), (F.col("node") == F.col("parent")) & (F.col("at") == F.col("bucket")), "left")  # at most 2 * BUCKETS rows
            rows = rows.withColumns({"node": F.coalesce("to", "node"), "shift": F.coalesce("cut", F.lit(-1)), "part": F.coalesce("first_range", "part"), "split": F.coalesce("ranges", "split")}).drop("at", *CUTS)
        return rows

    made, open_ = 0, low is not None
    while open_:
        rows = placed(sizes.filter("page_id is not null")).filter("shift >= 0")
        totals = rows.groupBy(F.col("node").alias("parent"), F.expr("shiftright(page_id, shift)").alias("bucket"))
        held = totals.agg(F.sum("size").alias("bytes"), F.min("page_id").alias("first"), F.max("page_id").alias("last")).toPandas().sort_values("first")
        wide = (held["bytes"] > most) & (held["first"] < held["last"])
        each = max(2, count // max(1, int(wide.sum())))
        held["cut"] = [_shift(int(a), int(z), each) if w else -1 for a, z, w in zip(held["first"], held["last"], wide)]
        held["to"], held["first_range"], held["ranges"] = range(made + 1, made + len(held) + 1), 0, 1
        made += len(held)
        levels.append(held)
        open_ = bool(wide.any())
    over = -(-(none or 0) // most)  # ranges of the rows without page_id, which come first
    n = over
    if levels:
        leaves = pd.concat([x[x["cut"] < 0] for x in levels]).sort_values("first")
        part, split, n = assigned(leaves, most, over)
        for held in levels:
            held["first_range"] = held["to"].map(dict(zip(leaves["to"], part))).fillna(0)
            held["ranges"] = held["to"].map(dict(zip(leaves["to"], split))).fillna(1)

    def ranged(rows: DataFrame) -> DataFrame:
        lead = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
        split = F.when(F.col("page_id").isNull(), F.lit(max(1, over))).otherwise(F.col("split"))
        within = F.expr("shiftright(_lead * _spread, 32)")
        return placed(rows).withColumns({"_lead": lead, "_spread": split.cast("long")}).withColumn("range", (F.col("part") + within).cast("int"))

    return ranged, max(1, n)


def write(pages: DataFrame, folder: str, roll: int = 64 << 20, shard: int = 32 << 20, least: int = 100, level: int = 6, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write pages (page_id, url, html) as WARC files and return the manifest.

    A null html is an empty payload; a null url becomes urn:page:<id>. Payloads under ``least`` bytes are
    always responses. A page_id may be any integer of 64 bits. Repeated rows of one page_id and payload: the first is the response, the others
    revisit it. Pages with a null page_id revisit the smallest page_id of their payload; if there is none,
    one of them is the response and the others' target is null. An empty table gives an empty manifest.
    """
    prepare(pages.sparkSession)
    digest = F.sha2(F.encode(F.coalesce("html", F.lit("")), "utf-8"), 256)
    keyed = pages.select("page_id", digest.alias("digest"), F.octet_length("html").alias("n")).filter(F.col("n") >= least).drop("n")
    copies = stored(keyed.groupBy("digest").agg(F.min("page_id").alias("target"), F.count("*").alias("n")).filter("n > 1").drop("n"), "warc-copies")
    listed = keyed.join(copies, "digest").groupBy("page_id", "digest").agg(F.min("target").alias("target"))
    none = F.lit(None)
    rows = listed.select("page_id", "digest", F.lit(False).alias("is_page"), "target", none.cast("string").alias("url"), none.cast("string").alias("html"))
    rows = rows.unionByName(pages.select("page_id", digest.alias("digest"), F.lit(True).alias("is_page"), none.cast("long").alias("target"), "url", "html"))
    ranged, n = ranges(pages, shard)
    laid = ranged(rows).select(*rows.columns, "range").repartitionById(n, "range").sortWithinPartitions("range", "page_id", "digest", "is_page", "url")
    return stored(laid.mapInArrow(_writer(folder, roll, level, date), MANIFEST), "warc-manifest")


def members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    z, got = zlib.decompressobj(31), []
    for data in chunks:
        while data:
            got.append(z.decompress(data))
            data = b""
            if z.eof:
                yield b"".join(got)
                data, z, got = z.unused_data, zlib.decompressobj(31), []
    if got and any(got):
        raise ValueError("the last record is cut off")


def parse(record: bytes) -> tuple[dict, bytes]:
    """Headers, with names in lower case, and block of one record; digests and lengths are checked."""
    head, _, rest = record.partition(EOL + EOL)
    first, *lines = head.split(EOL)
    if first != VERSION:
        raise ValueError("not a WARC record")
    headers = {k.decode().lower(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines)}
    block = rest[: int(headers["content-length"])]
    if rest[len(block) :] != EOL + EOL or len(block) != int(headers["content-length"]):
        raise ValueError("the record's length is wrong")
    if "warc-block-digest" in headers and headers["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("the record's digest is wrong")
    return headers, block


def _reader(payloads: bool):
    def rows(path: str) -> Iterator[tuple]:
        fs, place = filesystem(path)
        with fs.open_input_stream(place, compression=None) as f:
            for record in members(iter(lambda: f.read(1 << 20), b"")):
                headers, block = parse(record)
                if headers["warc-type"] == "warcinfo":
                    continue
                http, _, payload = block.partition(EOL + EOL)
                size, digest = int(re.search(rb"Content-Length: (\d+)", http)[1]), headers["warc-payload-digest"].removeprefix("sha256:")
                if headers["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"{path}: a payload doesn't match its digest")
                number = lambda k: int(headers[k]) if k in headers else None
                url = None if "x-no-url" in headers else headers["warc-target-uri"]
                yield number("x-page-id"), url, size, digest, headers["warc-type"], number("x-refers-to-page-id"), payload if payloads and headers["warc-type"] == "response" else None

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for b in found:
            for path in b.column(0).to_pylist():
                held, weight = [], 0
                for r in rows(path):
                    held.append(r)
                    weight += 200 + len(r[-1] or b"")
                    if weight > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                        held, weight = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return read


def read(spark: SparkSession, manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the files that a manifest names, each file by one task; payloads of responses if asked for."""
    prepare(spark)
    n = max(1, min(10_000, manifest.count()))
    return manifest.select("path").repartition(n).mapInArrow(_reader(payloads), RECORD)


def archive(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write pages as WARC files and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    manifest = write(pages, folder or scratch(spark, "warc"), **options)
    return read(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
