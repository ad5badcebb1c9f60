"""Word shingles of texts as sets of 64-bit hashes, in numpy.

A word is a run of anything but ASCII white space, with A-Z lowered. A text's set holds its distinct runs of
``width`` words; with fewer words, the whole sequence as one; without words it is empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .runtime import text_buffers

BASE = np.uint64(0x9E3779B97F4A7C15)
LOW = 4096
SLICE = 4 << 20  # bytes whose words are hashed at a time


def _series(step: np.uint64, n: int) -> np.ndarray:
    return np.append(np.uint64(1), np.cumprod(np.full(max(0, n - 1), step, np.uint64)))


SMALL = _series(BASE, LOW)  # powers of BASE below LOW; further ones are products with powers of BASE ** LOW


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(place: np.ndarray) -> np.ndarray:
    """BASE to the power of each of some numbers."""
    most = int(place.max()) if len(place) else 0
    if most < LOW:
        return SMALL[place]
    return SMALL[place % LOW] * _series((SMALL[-1:] * BASE)[0], most // LOW + 1)[place // LOW]


def _starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where words begin; a text's start, of those given, ends the word before it."""
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    begins = np.append(True, space[:-1])[: len(data)] & ~space
    begins[starts] = ~space[starts]
    return begins


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts and how many words come before each text, and after the last.

    Numbers of eight bytes a byte of text are held for about SLICE bytes at a time, or for one longer word.
    """
    found, firsts, at = [], [], 0
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    while at < len(data):
        end, look = len(data), at + SLICE
        while look < len(data):  # cut where a word begins
            begins = np.flatnonzero(_starts(data[look - 1 : look + SLICE], starts[(starts >= look) & (starts < look + SLICE)] - look + 1)[1:])
            if len(begins):
                end = look + int(begins[0])
                break
            look += SLICE
        hashes, first = _hashes(data[at:end], starts[(starts >= at) & (starts < end)] - at)
        found.append(hashes)
        firsts.append(first + at)
        at = end
    if not found:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(found), np.searchsorted(np.concatenate(firsts), offsets)


def _hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(_starts(data, starts))
    if not len(first):
        return np.empty(0, np.uint64), first
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    # The place of each byte from the start of its word on; white space counts nothing.
    place = np.arange(len(data)) - np.repeat(np.append(0, first), np.diff(np.concatenate([[0], first, [len(data)]])))
    lowered = np.where((data >= 0x41) & (data <= 0x5A), data + np.uint8(32), data).astype(np.uint64) + np.uint64(1)
    lowered[space] = 0
    place[space] = 0
    return mix(np.add.reduceat(lowered * powers(place), first)), first


def sets(texts: pa.Array, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts, joined, and the n + 1 offsets of the texts."""
    hashes, before = words(*text_buffers(texts))
    n, out = len(before) - 1, []
    runs = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        runs = mix(runs + hashes[k : k + len(runs)] * (BASE + np.uint64(2 * k)))
    for a, z in zip(before[:-1].tolist(), before[1:].tolist()):
        if z - a >= width:
            out.append(np.unique(runs[a : z - width + 1]))
        elif z > a:
            short = np.array([z - a], np.uint64)
            for k in range(a, z):
                short = mix(short + hashes[k : k + 1] * BASE + np.uint64(1))
            out.append(short)
        else:
            out.append(np.empty(0, np.uint64))
    return (np.concatenate(out) if n else np.empty(0, np.uint64)), np.append(0, np.cumsum([len(x) for x in out])).astype(np.int64)
