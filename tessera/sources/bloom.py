"""The bloom filters in Parquet files, which the readers of Python don't give: where they lie, and what they hold.

Footers and headers are Thrift structs in the compact protocol; a struct is read here as a dict of its fields by
their numbers. A filter is a row of blocks of eight 32-bit words; a value's hash chooses a block and one bit in each word.
"""

from __future__ import annotations

import datetime
import struct
from collections.abc import Callable
from typing import Any

import numpy as np

# Fixed values of the Parquet format: the salts of the eight words, and the numbers of fields.
SALT = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint64)
ROW_GROUPS, COLUMNS, META, PATH, PLACE, SIZE = 4, 1, 3, 3, 14, 1
EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)


class _Compact:
    """A reader of the compact protocol."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def varint(self) -> int:
        out = shift = 0
        while True:
            b = self.byte()
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    def number(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def raw(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def value(self, kind: int) -> Any:
        if kind in (1, 2):
            return kind == 1
        if kind == 3:
            return self.byte()
        if kind in (4, 5, 6):
            return self.number()
        if kind == 7:
            return struct.unpack("<d", self.raw(8))[0]
        if kind == 8:
            return self.raw(self.varint())
        if kind in (9, 10):
            head = self.byte()
            n = head >> 4 if head >> 4 < 15 else self.varint()
            return [self.byte() == 1 if head & 15 in (1, 2) else self.value(head & 15) for _ in range(n)]
        if kind == 11:
            n = self.varint()
            kinds = self.byte() if n else 0
            return {self.value(kinds >> 4): self.value(kinds & 15) for _ in range(n)}
        if kind == 12:
            return self.struct()
        raise ValueError(f"not a Thrift type: {kind}")

    def struct(self) -> dict[int, Any]:
        out, last = {}, 0
        while head := self.byte():
            last = last + (head >> 4) if head >> 4 else self.number()
            out[last] = self.value(head & 15)
        return out


def places(footer: bytes) -> list[dict[str, int]]:
    """For each row group of a footer the columns that have a bloom filter, and where it begins."""
    groups = _Compact(footer).struct().get(ROW_GROUPS, [])
    return [{".".join(x.decode() for x in c[META][PATH]): c[META][PLACE] for c in g[COLUMNS] if PLACE in c.get(META, {})} for g in groups]


def plain(value: Any, kind: str) -> bytes | None:
    """A value as Parquet stores it, of a column of one of Spark's types; None if its filters can't be asked."""
    if kind in ("int", "smallint", "tinyint"):
        return struct.pack("<i", value)
    if kind == "bigint":
        return struct.pack("<q", value)
    if kind == "string":
        return value.encode()
    if kind == "date":
        return struct.pack("<i", (value - datetime.date(1970, 1, 1)).days)
    if kind == "timestamp":
        return struct.pack("<q", (value.astimezone(datetime.timezone.utc) - EPOCH) // datetime.timedelta(microseconds=1))
    return None


def test(read: Callable[[int, int], bytes], place: int, kind: str) -> Callable[[Any], bool]:
    """Whether a value may be among those of a filter; ``read(start, size)`` gives a file's bytes. The filter is read when first asked."""
    import xxhash

    held: list[np.ndarray] = []

    def may(value: Any) -> bool:
        data = plain(value, kind)
        if data is None:
            return True
        if not held:
            head = _Compact(read(place, 64))
            size = head.struct()[SIZE]
            held.append(np.frombuffer(read(place + head.at, size), "<u4").reshape(-1, 8))
        h = xxhash.xxh64_intdigest(data, 0)
        block = held[0][(h >> 32) * len(held[0]) >> 32].astype(np.uint64)
        bit = (np.uint64(h & 0xFFFFFFFF) * SALT & np.uint64(0xFFFFFFFF)) >> np.uint64(27)
        return bool((block >> bit & np.uint64(1)).all())

    return may
