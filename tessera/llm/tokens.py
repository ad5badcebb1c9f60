"""Token ids of whole texts by the tokenizers library, at the speed of a dictionary lookup.

A byte-level BPE with the usual split pattern never makes a token that reaches from a visible character into
white space that follows it, and what follows is split as it would be at the start of a text. So a text is
cut there into pieces such as " word"; pyarrow finds the distinct pieces of a group of batches, the library
encodes each of them once, and the ids of a text are those of its pieces, joined. Added tokens without white
space, such as special ones, lie whole in a piece, and what follows them starts anew in both ways; with others
texts are not cut.
"""

from __future__ import annotations

import array
import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .runtime import text_buffers

MEMORY = 500_000  # distinct pieces whose ids a worker keeps
GROUP = 8 << 20  # bytes of text encoded together
SOME = 8192  # pieces that the library encodes at once


@functools.lru_cache(maxsize=2)
def load(path: str):
    """The tokenizer in a file, with the library's own settings: a special token's string in a text gives its id."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=2)
def divisible(path: str) -> bool:
    """Whether a cut at white space leaves all added tokens whole: none holds white space or looks at what is beside it."""
    added = load(path).get_added_tokens_decoder().values()
    return not any(t.lstrip or t.rstrip or t.single_word or any(c.isspace() for c in t.content) for t in added)


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces: those of texts, and white space of ASCII that follows a visible character.

    A character counts as visible here if it is ASCII or in U+00C0 to U+00FF; after any other, no cut is made.
    """
    n = len(data)
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    if n < 2:
        return starts
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    seen = (data > 0x20) & (data < 0x7F)
    seen[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80)
    cut = np.zeros(n, bool)
    cut[1:] = space[1:] & seen[:-1]
    cut[starts] = True
    return np.flatnonzero(cut)


class Encoder:
    """Encodes texts; keeps the distinct pieces that it has met and their ids in Arrow arrays, up to a bound."""

    def __init__(self, path: str):
        self.path = path
        self.known = pa.array([], pa.large_string())
        self.ids = pa.array([], pa.list_(pa.uint32()))

    def _encode(self, pieces: pa.Array) -> pa.Array:
        tokenizer, sizes, flat = load(self.path), [0], array.array("I")
        for at in range(0, len(pieces), SOME):  # the library's answers are far larger than their ids
            for e in tokenizer.encode_batch_fast(pieces.slice(at, SOME).to_pylist(), add_special_tokens=False):
                ids = e.ids
                flat.extend(ids)
                sizes.append(len(ids))
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(np.frombuffer(flat, np.uint32) if len(flat) else np.empty(0, np.uint32)))

    def _ids_of(self, pieces: pa.Array) -> pa.Array:
        """The ids of each of some distinct pieces."""
        place = pc.index_in(pieces, value_set=self.known)
        missing = pc.is_null(place)
        new = pieces.filter(missing)
        if len(new):
            ids, size = self._encode(new), len(self.known)
            place = np.array(place.fill_null(0))
            place[np.asarray(missing)] = size + np.arange(len(new))
            self.known, self.ids = pa.concat_arrays([self.known, new]), pa.concat_arrays([self.ids, ids])
        found = self.ids.take(pa.array(place))
        if len(self.known) > MEMORY:
            self.known, self.ids = pieces, found
        return found

    def encode_all(self, columns: list[pa.Array], end: int | None = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each column of texts the ids of all its texts, joined, each with the id ``end`` after it, and the n + 1 offsets."""
        laid, coded = [], []
        for texts in columns:
            data, offsets = text_buffers(texts)
            begin = cuts(data, offsets) if divisible(self.path) else offsets[:-1][offsets[:-1] < offsets[1:]]
            bounds = np.append(begin, len(data)).astype(np.int64)
            pieces = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
            coded.append(pc.dictionary_encode(pieces))
            # How many pieces come before each text, and after the last.
            laid.append(np.searchsorted(begin, offsets))
        if not coded:
            return
        same = pa.chunked_array(coded).unify_dictionaries()
        ids = self._ids_of(same.chunk(0).dictionary)
        for before, chunk in zip(laid, same.chunks):
            lists = ids.take(chunk.indices)
            values, ends = np.asarray(lists.flatten()), np.asarray(lists.offsets)
            offsets = (ends[before] - ends[0]).astype(np.int64)
            if end is not None:
                values = np.insert(values, offsets[1:], end)
                offsets = offsets + np.arange(len(offsets))
            yield values, offsets

    def encode(self, texts: pa.Array, end: int | None = 0) -> tuple[np.ndarray, np.ndarray]:
        return next(self.encode_all([texts], end))

    def stream(self, found: Iterable[pa.RecordBatch], end: int | None = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Record batches with texts in column 1, in slices, with their ids; about GROUP bytes are encoded together."""
        held, size = [], 0
        for b in found:
            for k in range(0, b.num_rows, 256):
                held.append(b.slice(k, 256))
                size += held[-1].column(1).nbytes
                if size >= GROUP:
                    yield from ((x, *y) for x, y in zip(held, self.encode_all([x.column(1) for x in held], end)))
                    held, size = [], 0
        yield from ((x, *y) for x, y in zip(held, self.encode_all([x.column(1) for x in held], end)))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of this process, whose memory serves all tasks that it runs."""
    return Encoder(path)
