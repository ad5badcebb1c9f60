"""Exact Jaccard join of word shingles by a token-group matrix.

Groups. The tokens of a set are dealt by hash into segments. Two sets with a Jaccard similarity of t differ
in at most D tokens, D following from their sizes, so of D + 1 segments one agrees; the number of segments
goes by classes of size, and a set takes part in its own class and the next, in which any partner must be.
Sets that share no segment can't be linked, whatever else they share (a common passage or frequent words
don't make a whole segment equal). Sets that do are linked to the first of each segment, and the connected
components of these links are the groups of similar sets.

Common tokens. Segments hold a few tokens only, so of two sets that share a passage some are equal by chance, and
the sets with common passages would be one group that grows with the table. Tokens that many sets of a sample hold
are therefore left out of segments first: sets differ in no more of the other tokens than of all, so what follows
from D holds for them too. A set whose other tokens are too few for its segments takes more and smaller ones, and
in the end those of all its tokens. The sample decides what is compared, not what is linked.

Matrix. A group is laid out by size in blocks of bounded numbers of sets and tokens, which tasks write to files in the shared
folder, with the tokens that most of its sets hold as its centre, each set's distance from it, and a bitmap of
hashed tokens for each set and so, by their union, for the block. Blocks of fitting sizes of one group meet.
Jaccard distance is a metric, so distances from the centres, and between these, decide most pairs: near copies
of one text are linked, and strangers are not, without a look at their tokens. For the others, what a query's
bitmap has outside a block's union it can't share with any member, which bounds its overlap with all of them;
only if some query's bound reaches t are the members' bitmaps multiplied, and only members whose own bound
reaches t are opened: their tokens are read and a product of matrices over the tokens gives exact overlaps. It
leaves one edge a set, not all pairs, and the number of its links.

Equal sets are joined before, by a 128-bit fingerprint, and stand as one with a weight.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranges, shingles
from .components import components
from .runtime import commit, discard, filesystem, freed, prepare, scratch, stored
from .shingles import mix

BLOCK_SETS, BLOCK_TOKENS, COLUMNS = 256, 1 << 17, 4096
# Ways to deal a set's tokens into segments, each for sets for which those before left too many empty: whether
# common tokens are left out, and by how much there are more segments.
MAPPINGS = ((True, 1), (True, 2), (True, 4), (False, 1), (False, 1), (False, 1))
SAMPLE, LONGEST, OFTEN, MOST_COMMON, CUT_SETS = 1 << 14, 1 << 14, 4, 1 << 17, 1 << 11
SLACK = 1e-9


def classes(percent: int, most: int) -> np.ndarray:
    """Lower ends of the classes of size: sets two classes apart can't be linked."""
    ends = [1]
    while ends[-1] <= most:
        ends.append(max(ends[-1] + 1, -(-100 * ends[-1] // percent)))
    return np.array([*ends, max(ends[-1] + 1, -(-100 * ends[-1] // percent))])


def segments(low: int, high: int, percent: int) -> tuple[int, int]:
    """Number of segments for sizes from low to below high, and how many of a set's may be empty."""
    differ = 2 * (high - 1) * (100 - percent) // (100 + percent)
    spare = 0
    for _ in range(8):
        k = differ + 1 + spare
        mean = k * (1 - 1 / k) ** low if k > 1 else 0.0
        spare = max(spare, int(np.ceil(mean + 2 * np.sqrt(mean) - 0.05)))
    return differ + 1 + spare, spare


class Common:
    """Some tokens, and which of others are among them."""

    def __init__(self, tokens: np.ndarray):
        self.tokens, self.marks = np.sort(tokens), np.zeros(1 << 20, bool)
        self.marks[self.tokens >> np.uint64(44)] = True

    def among(self, tokens: np.ndarray) -> np.ndarray:
        found = self.marks[tokens >> np.uint64(44)]
        some = np.flatnonzero(found)
        if len(some):
            at = np.searchsorted(self.tokens, tokens[some])
            found[some] = self.tokens[np.minimum(at, len(self.tokens) - 1)] == tokens[some]
        return found


def signatures(flat: np.ndarray, offsets: np.ndarray, percent: int, common: Common | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each set its segments' signatures, joined, and the n + 1 offsets."""
    sizes, n = np.diff(offsets), len(offsets) - 1
    seldom = ~common.among(flat) if common else np.ones(len(flat), bool)
    if not len(flat):
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    ends = classes(percent, int(sizes.max()))
    own = np.searchsorted(ends, sizes, side="right") - 1
    out, owner = [], []
    shape = {s: segments(int(ends[s]), int(ends[min(s + 2, len(ends) - 1)]), percent) for s in {*own[sizes > 0].tolist(), *(own[sizes > 0] - 1).tolist()} if s >= 0}
    for scheme in (own - 1, own):
        todo = np.flatnonzero((sizes > 0) & (scheme >= 0))
        for mapping, (without, more) in enumerate(MAPPINGS):
            if not len(todo):
                break
            k = np.array([shape[s][0] for s in scheme[todo].tolist()])
            spare = np.array([shape[s][1] for s in scheme[todo].tolist()]) + (more - 1) * k
            k = more * k
            first = np.append(0, np.cumsum(k))
            pick = np.repeat(offsets[todo], sizes[todo]) + np.arange(int(sizes[todo].sum())) - np.repeat(np.cumsum(sizes[todo]) - sizes[todo], sizes[todo])
            of = np.repeat(np.arange(len(todo)), sizes[todo])
            if without:
                pick, of = pick[seldom[pick]], of[seldom[pick]]
            token = flat[pick]
            place = first[of] + ((mix(token + np.uint64(77 + mapping)) >> np.uint64(16)) % k[of].astype(np.uint64)).astype(np.int64)
            total = np.zeros(int(first[-1]), np.uint64)
            np.add.at(total, place, mix(token + np.uint64(5)))
            held = np.bincount(place, minlength=len(total)) > 0
            doc = np.repeat(np.arange(len(todo)), k)
            empty = k - np.bincount(doc[held], minlength=len(todo))
            last = mapping == len(MAPPINGS) - 1
            use = held | (last & (empty > spare)[doc])
            segment = np.arange(len(total)) - first[doc]
            seal = (scheme[todo][doc].astype(np.uint64) << np.uint64(40)) + (segment.astype(np.uint64) << np.uint64(4)) + np.uint64(mapping)
            out.append(mix(mix(seal) + total)[use])
            owner.append(todo[doc][use])
            todo = todo[empty > spare]
    sig, who = np.concatenate(out), np.concatenate(owner)
    return sig[np.argsort(who, kind="stable")], np.append(0, np.cumsum(np.bincount(who, minlength=n)))


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def _slices(found: Iterator[pa.RecordBatch], k: int, width: int):
    for b in found:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            yield part, *shingles.sets(part.column(k), width)


def prints(flat: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """A 128-bit fingerprint of each set; None for an empty one."""
    sizes = np.diff(offsets)
    sums = [np.append(np.uint64(0), np.cumsum(mix(flat + np.uint64(s)))) for s in (11, 13)]
    both = [mix(c[offsets[1:]] - c[offsets[:-1]] + sizes.astype(np.uint64)) for c in sums]
    return [x.tobytes() if n else None for x, n in zip(np.stack(both, 1), sizes)]


def nodes(keys: list[bytes | None]) -> list[int | None]:
    """The first half of each fingerprint as a number, by which groups are found. Two sets with one number share a group, no more."""
    return [None if k is None else int.from_bytes(k[:8], "little", signed=True) for k in keys]


PRINTS = "doc_id long, n_shingles long, print binary, node long, sampled array<bigint>"


def _prints(width: int, share: float):
    """Sizes and fingerprints of all sets, and the tokens of a share of the distinct ones, once a task."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for part, flat, offsets in _slices(found, 1, width):
            key, sizes = prints(flat, offsets), np.diff(offsets)
            sampled: list = [None] * len(sizes)
            for k in np.flatnonzero((sizes > 0) & (sizes <= LONGEST)).tolist():
                if int.from_bytes(key[k][:8], "little") < share * 2**64 and key[k] not in seen:
                    seen.add(key[k])
                    sampled[k] = flat[offsets[k] : offsets[k + 1]].view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(sizes), pa.array(key, pa.binary()), pa.array(nodes(key), pa.int64()), pa.array(sampled, pa.list_(pa.int64()))], names=[x.split()[0] for x in PRINTS.split(", ")])

    return freed(run)


def common_tokens(printed: DataFrame) -> Common:
    """Tokens that many sets of the sample hold, the most frequent ones."""
    listed = printed.filter("sampled is not null").dropDuplicates(["print"]).select(F.explode("sampled").alias("token"))
    often = listed.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN).orderBy(F.desc("n"), "token").limit(MOST_COMMON)
    return Common(np.asarray(often.toArrow()["token"]).astype(np.int64).view(np.uint64))  # at most 1 MB


def _sampled(percent: int, common: Common):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = part.column(1)
                sig, at_ = signatures(np.asarray(sets.flatten()).view(np.uint64), np.append(0, np.cumsum(np.asarray(sets.value_lengths()))), percent, common)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(np.repeat(np.asarray(part.column(0)), np.diff(at_)))], names=["sig", "node"])

    return freed(run)


def cuts(printed: DataFrame, percent: int, common: Common, rows_of_task: int = 1 << 20) -> np.ndarray:
    """Where to cut the order of (sig, node) for tasks of about equal rows, from at most about CUT_SETS of the sampled sets."""
    docs, some = printed.agg(F.count("*"), F.count("sampled")).first()
    part = min(1.0, CUT_SETS / max(1, some))
    few = printed.filter("sampled is not null").filter(F.pmod("node", F.lit(1 << 20)) < part * (1 << 20)).select("node", "sampled")
    listed = stored(few.mapInArrow(_sampled(percent, common), "sig long, node long"), "sampled-signatures")
    rows = listed.count()
    if not rows:
        discard(printed.sparkSession, listed)
        return np.empty((0, 2), np.int64)
    tasks = int(min(100_000, max(2 * printed.sparkSession.sparkContext.defaultParallelism, rows / (some * part) * docs // rows_of_task)))
    found = ranges.cuts(listed.sample(ranges.share(rows, tasks), seed=1).toArrow(), tasks)
    discard(printed.sparkSession, listed)
    return found


def _signed(width: int, percent: int, common: Common, cut: np.ndarray):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, flat, offsets in _slices(found, 0, width):
            own = np.array([n or 0 for n in nodes(prints(flat, offsets))], np.int64)
            sizes = np.diff(offsets)
            _, once = np.unique(own, return_index=True)  # of equal sets one in a slice is enough
            once = np.sort(once[sizes[once] > 0])
            pick = np.zeros(len(sizes), bool)
            pick[once] = True
            sig, at = signatures(flat[np.repeat(pick, sizes)], np.append(0, np.cumsum(sizes[once])), percent, common)
            sig, node = sig.view(np.int64), np.repeat(own[once], np.diff(at))
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(node), pa.array(ranges.task_of(sig, node, cut))], names=["sig", "node", "task"])

    return freed(run)


def _firsts(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of sig and node: pairs of each node and the first of its sig in this task, once each.

    The first and last sig of a task may go on in others; their first nodes are given as rows with that sig.
    """
    sig = lead = edge = None
    held, size = [], 0

    def distinct() -> pa.RecordBatch:
        nonlocal held, size
        pairs = np.unique(np.concatenate(held), axis=0)
        held, size = [], 0
        return pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["sig", "a", "b"])

    for b in found:
        s, d = np.asarray(b.column(0)), np.asarray(b.column(1))
        if not len(s):
            continue
        new = np.append(sig is None or s[0] != sig, s[1:] != s[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(s)), -1))
        leader = np.where(first >= 0, d[np.maximum(first, 0)], lead if lead is not None else 0)
        if edge is None:
            edge = (int(s[0]), int(d[0]))
        sig, lead = s[-1], leader[-1]
        if (d != leader).any():
            held.append(np.stack([d, leader], 1)[d != leader])
            size += len(held[-1])
        if size > 1 << 18:
            yield distinct()
    if sig is not None:
        if held:
            yield distinct()
        ends = sorted({edge, (int(sig), int(lead))})
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*((s, d, d) for s, d in ends))], names=["sig", "a", "b"])


BLOCK = "family long, block long, low long, high long, path string, at long, sets long, size long, a long, b long, links long"
BITS, MOST_BITS = 4096, 1 << 16  # of a set's bitmap: eight a token of the largest set in the block, within these


def distance(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard distance of two sorted sets; 1 if one is empty."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 1 - both / (len(x) + len(y) - both) if both else 1.0


class Block:
    """The sets of a block: docs, weights, sizes, a centre and distances from it; bitmaps and tokens when they are asked for."""

    def __init__(self, bits: int, docs: np.ndarray, weights: np.ndarray, sizes: np.ndarray, apart: np.ndarray, centre: np.ndarray, marks, tokens):
        self.bits, self.docs, self.weights, self.sizes, self.apart, self.centre = bits, docs, weights, sizes, apart, centre
        self._marks, self._tokens = marks, tokens

    @staticmethod
    def of(docs: list[int], weights: list[int], sets: list[np.ndarray]) -> Block:
        sizes, tokens = np.array([len(x) for x in sets], np.int64), np.concatenate(sets)
        n = min(MOST_BITS, max(BITS, 1 << int(8 * sizes.max() - 1).bit_length()))
        bits = np.zeros((len(docs), n), bool)
        bits[np.repeat(np.arange(len(docs)), sizes), (mix(tokens + np.uint64(99)) >> np.uint64(20)) % np.uint64(n)] = True
        every, held = np.unique(tokens, return_counts=True)
        centre = every[2 * held > len(sets)]
        marks = np.packbits(bits, axis=1)
        return Block(n, np.array(docs, np.int64), np.array(weights, np.int64), sizes, np.array([distance(x, centre) for x in sets]), centre, lambda: marks, lambda: tokens)

    def pack(self) -> bytes:
        head = np.array([self.bits, len(self.centre)])
        return b"".join(x.tobytes() for x in (head, self.docs, self.weights, self.sizes, self.apart, self.centre, self.marks, self.tokens))

    @staticmethod
    def load(path: str, at: int, sets: int, size: int) -> Block:
        fs, place = filesystem(path)

        def read(start: int, stop: int) -> bytes:
            with fs.open_input_file(place) as f:
                return f.read_at(stop - start, at + start)

        data = read(0, min(size, 16 + 32 * sets + (1 << 14)))
        bits, centre = np.frombuffer(data, np.int64, 2).tolist()
        head = 16 + 32 * sets + 8 * centre
        data = data if len(data) >= head else read(0, head)
        tail = head + sets * bits // 8
        numbers = np.frombuffer(data, np.int64, 3 * sets, 16).reshape(3, sets)
        apart = np.frombuffer(data, np.float64, sets, 16 + 24 * sets)
        marks = lambda: np.frombuffer(read(head, tail), np.uint8).reshape(sets, -1)
        return Block(bits, *numbers, apart, np.frombuffer(data, np.uint64, centre, 16 + 32 * sets), marks, lambda: np.frombuffer(read(tail, size), np.uint64))

    @functools.cached_property
    def marks(self) -> np.ndarray:
        return self._marks()

    @functools.cached_property
    def tokens(self) -> np.ndarray:
        return self._tokens()

    def tight(self, percent: int) -> bool:
        """Whether all of its sets are certainly linked to each other."""
        return 2 * self.apart.max() <= 1 - percent / 100 - SLACK

    @functools.lru_cache(maxsize=2)
    def marked(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bitmaps, folded to so many bits, as a matrix, the number of bits in each, and their union."""
        whole = np.unpackbits(self.marks, axis=1).reshape(len(self.docs), -1, bits).max(1).astype(np.float32)
        return whole, whole.sum(1), whole.max(0)

    def members(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, token) of all tokens of some sets."""
        keep = np.zeros(len(self.docs), bool)
        keep[rows] = True
        of = np.repeat(np.arange(len(self.docs)), self.sizes)
        pick = keep[of]
        return of[pick], self.tokens[pick]


def overlaps(a: Block, b: Block, percent: int) -> np.ndarray | None:
    """Which sets of a are linked to which of b; None if the bounds open nothing."""

    between, most = distance(a.centre, b.centre), 1 - percent / 100
    x, y = a.apart[:, None], b.apart[None, :]
    sure = x + between + y <= most - SLACK
    never = np.maximum(np.abs(x - y) - between, between - x - y) > most + SLACK
    unsure = ~(sure | never)
    if not unsure.any():
        return sure if sure.any() else None
    some = sure if sure.any() else None
    bits = min(a.bits, b.bits)
    (am, ac, au), (bm, bc, bu) = a.marked(bits), b.marked(bits)

    def reach(x: Block, marks: np.ndarray, counts: np.ndarray, y: Block, union: np.ndarray) -> np.ndarray:
        """Which sets of x may be linked to a member of y, by what they have outside its union."""
        most = x.sizes - (counts - marks @ union)
        return (100 + percent) * most >= percent * (x.sizes + y.sizes.min())

    rows, cols = np.flatnonzero(unsure.any(1) & reach(a, am, ac, b, bu)), np.flatnonzero(unsure.any(0) & reach(b, bm, bc, a, au))
    if not len(rows) or not len(cols):
        return some
    both = am[rows] @ bm[cols].T
    sizes = a.sizes[rows][:, None] + b.sizes[cols][None, :]
    most = np.minimum((a.sizes - ac)[rows][:, None], (b.sizes - bc)[cols][None, :]) + both
    open_ = unsure[np.ix_(rows, cols)] & ((100 + percent) * most >= percent * sizes)
    rows, cols = rows[open_.any(1)], cols[open_.any(0)]
    if not len(rows):
        return some
    (ra, ta), (rb, tb) = a.members(rows), b.members(cols)
    shared = np.intersect1d(np.unique(ta), np.unique(tb), assume_unique=True)

    def columns(r: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(shared, t), max(0, len(shared) - 1))
        hit = shared[at] == t if len(shared) else np.zeros(len(t), bool)
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], r[hit][order]

    (ca, ra), (cb, rb) = columns(ra, ta), columns(rb, tb)
    total = np.zeros((len(a.docs), len(b.docs)), np.float32)
    for low in range(0, len(shared), COLUMNS):
        sa, sb = slice(*np.searchsorted(ca, [low, low + COLUMNS])), slice(*np.searchsorted(cb, [low, low + COLUMNS]))
        width = min(COLUMNS, len(shared) - low)
        x, y = np.zeros((len(a.docs), width), np.float32), np.zeros((len(b.docs), width), np.float32)
        x[ra[sa], ca[sa] - low] = 1
        y[rb[sb], cb[sb] - low] = 1
        total += x @ y.T
    return sure | unsure & ((100 + percent) * total.astype(np.int64) >= percent * (a.sizes[:, None] + b.sizes[None, :]))


def _edges(docs: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """An edge from each doc to the smallest of its component in a symmetric matrix of links."""
    rank = np.argsort(np.argsort(docs, kind="stable"), kind="stable")
    label = rank.copy()
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(docs)).min(1))
        if (new == label).all():
            break
        label = new
    by = np.sort(docs)
    return [(int(d), int(by[k])) for d, k in zip(docs, label) if d != by[k]]


def _found(a: Block, b: Block | None, percent: int) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray | None] | None:
    """Edges between two blocks, or within one, and the number of links of the sets of each; None without any."""
    linked = overlaps(a, b or a, percent)
    if linked is None:
        return None
    if b is None:
        square = linked & ~np.eye(len(a.docs), dtype=bool)
        return _edges(a.docs, square), square @ a.weights, None
    if linked.all():  # a tight block's own edges lead to its smallest doc already
        least = min(a.docs.min(), b.docs.min())
        ends = [d for x in (a, b) for d in ([x.docs.min()] if x.tight(percent) else x.docs)]
        edges = [(int(d), int(least)) for d in ends if d != least]
    else:
        n = len(a.docs)
        square = np.zeros((n + len(b.docs),) * 2, bool)
        square[:n, n:], square[n:, :n] = linked, linked.T
        edges = _edges(np.append(a.docs, b.docs), square)
    return edges, linked @ b.weights, linked.T @ a.weights


def _tasked(cut: np.ndarray):
    """Members of groups with the task that makes their blocks."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            yield b.append_column("task", pa.array(ranges.task_of(np.asarray(b.column(0)), np.asarray(b.column(1)), cut)))

    return run


def _blocks(folder: str, width: int, percent: int):
    """Of docs in order of family and size: blocks, written to one file a task, and the links within each."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, now, tokens, last, place = TaskContext.get(), 0, None, 0, None, 0
        held: list = []
        fs, base = filesystem(folder)
        fs.create_dir(base)
        name = f"blocks-{task.partitionId():06d}"
        temporary, out = f"{base}/.{name}.{task.taskAttemptId()}", None
        names = [x.split()[0] for x in BLOCK.split(", ")]

        def block() -> pa.RecordBatch:
            nonlocal made, held, out, place
            out = out or fs.open_output_stream(temporary)
            made_of = Block.of(*zip(*held))
            data = made_of.pack()
            out.write(data)
            sizes = made_of.sizes
            rows = [(now, (task.partitionId() << 32) + made, int(sizes.min()), int(sizes.max()), f"{folder}/{name}", place, len(held), len(data), None, None, None)]
            edges, counts, _ = _found(made_of, None, percent) or ([], [], None)
            rows += [(None,) * 8 + (*x, None) for x in edges] + [(None,) * 8 + (int(d), None, int(c)) for d, c in zip(made_of.docs, counts) if c]
            made, held, place = made + 1, [], place + len(data)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "path" else pa.int64()) for c, n in zip(zip(*rows), names)], names=names)

        for part, flat, offsets in _slices(found, 3, width):
            for family, doc, weight, key, own, a, z in zip(*(part.column(k).to_pylist() for k in (0, 1, 2, 4)), prints(flat, offsets), offsets[:-1].tolist(), offsets[1:].tolist()):
                if key != own or (doc, key) == last:  # another text of this doc_id, or the same row again
                    continue
                last = (doc, key)
                if held and (family != now or len(held) >= BLOCK_SETS or tokens + z - a > BLOCK_TOKENS):
                    yield block()
                    tokens = 0
                now = family
                held.append((doc, weight, flat[a:z]))
                tokens += z - a
        if held:
            yield block()
        if out:
            out.close()
            commit(fs, temporary, f"{base}/{name}")

    return freed(run)


LINKS = "a long, b long, links long"


def _across(percent: int, kept: int = 16, held: int = 2048):
    """Links between pairs of blocks, which come in order of the first: edges (a, b, None), and numbers of links (a, None, n).

    Numbers are summed in the task, for up to ``held`` blocks at a time.
    """

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = functools.lru_cache(maxsize=kept)(Block.load)
        sums: dict = {}

        def rows(pairs: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs)], names=["a", "b", "links"])

        def counted() -> Iterator[pa.RecordBatch]:
            for docs, counts in sums.values():
                some = [(int(d), None, int(c)) for d, c in zip(docs, counts) if c]
                if some:
                    yield rows(some)
            sums.clear()

        for batch in found:
            for row in zip(*(batch.column(k).to_pylist() for k in range(8))):
                blocks = load(*row[:4]), load(*row[4:])
                got = _found(*blocks, percent)
                if got is None:
                    continue
                if got[0]:
                    yield rows([(*x, None) for x in got[0]])
                for key, block, counts in zip((row[:2], row[4:6]), blocks, got[1:]):
                    sums[key] = block.docs, sums[key][1] + counts if key in sums else counts
                if len(sums) > held:
                    yield from counted()
        yield from counted()

    return freed(run)


FEWEST, MOST = 1 << 10, 1 << 20  # words of a bitmap


def bits(rows: DataFrame, column: str) -> tuple[DataFrame, Callable[[str], F.Column]]:
    """A bitmap of hashes of a column's values, and what tells of a column whether it may be among them: certainly if it is.

    It has 16 bits a row, in rows of 64 bits, and at most MOST of them (16 MB), so it may be broadcast at any
    size; with far more than ten million values it is full, tells nothing, and costs a shuffle, not a result.
    """
    n = min(MOST, max(FEWEST, 1 << (max(1, rows.count()) // 4).bit_length()))
    h = F.xxhash64(column)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 20), F.lit(64)).cast("int"))
    made = stored(rows.groupBy(F.pmod(h, F.lit(n)).alias("word")).agg(F.bit_or(one).alias("bits")), "bitmap")

    def among(name: str) -> F.Column:
        h = F.xxhash64(name)
        return (F.pmod(h, F.lit(n)) == F.col("word")) & (F.call_function("shiftright", F.col("bits"), F.pmod(F.shiftright(h, 20), F.lit(64)).cast("int")).bitwiseAND(1) == 1)

    return made, among


def join(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, its own included) and n_links of each row.

    A null or empty text, or one of white space only, has an empty set and no link. Repeated rows are linked
    to each other; rows of one doc_id are one node. A row without doc_id is linked with nothing and has no
    component_id. An empty table gives no rows. Columns other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    share = min(1.0, SAMPLE / max(1, texts.count()))
    printed = stored(texts.mapInArrow(_prints(width, share), PRINTS), "prints")
    common = common_tokens(printed)
    cut = cuts(printed, percent, common)
    printed = printed.drop("sampled")
    known = printed.filter("doc_id is not null and print is not null")
    firsts = stored(known.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("weight"), F.min("node").alias("node")), "firsts")
    real = texts.filter("doc_id is not null")

    # Groups of similar sets.
    rows = real.select("text").mapInArrow(_signed(width, percent, common, cut), "sig long, node long, task int")
    laid = rows.repartitionById(len(cut) + 1, "task").select("sig", "node").sortWithinPartitions("sig", "node")
    found = stored(laid.mapInArrow(_firsts, "sig long, a long, b long"), "segment-pairs")
    ends = found.filter("sig is not null")
    least = stored(ends.groupBy("sig").agg(F.min("a").alias("least")), "segment-ends")
    across = ends.join(least, "sig").select("a", F.col("least").alias("b"))
    family = components(found.filter("sig is null").select("a", "b").unionByName(across))
    discard(spark, found, least)

    # Blocks of a group, of one text for each distinct set. A bitmap of fixed size keeps most other texts out of the shuffle.
    members = family.unionByName(family.select(F.col("component").alias("node"), "component").distinct())
    single = firsts.join(members, "node").select(F.col("component").alias("family"), F.col("first").alias("doc"), "weight", "print")
    grouped = stored(single, "group-members")
    sized = printed.select(F.col("doc_id").alias("doc"), "print", "n_shingles").distinct()
    single = held = stored(grouped.join(sized, ["doc", "print"]), "group-members")
    members = single.count()
    tasks = int(max(spark.sparkContext.defaultParallelism * 16, members // 4096))
    place = F.shiftleft(F.col("n_shingles"), 32) + F.pmod(F.xxhash64("doc"), F.lit(1 << 32))  # by size, equal sizes anyhow
    single = single.withColumn("place", place)
    cut = ranges.cuts(single.select("family", "place").sample(ranges.share(members, tasks), seed=1).toArrow(), tasks)
    tasked = single.select("family", "place", "doc", "weight", "print").mapInArrow(_tasked(cut), "family long, place long, doc long, weight long, print binary, task int")
    bitmap, among = bits(single, "doc")
    near = real.join(F.broadcast(bitmap), among("doc_id"), "left_semi")  # at most 16 MB
    chosen = tasked.hint("merge").join(near, F.col("doc") == F.col("doc_id")).select("family", "doc", "weight", "text", "print", "place", "task")
    laid = chosen.repartitionById(len(cut) + 1, "task").sortWithinPartitions("family", "place", "doc", "print").drop("place", "task")
    folder = scratch(spark, "block-files")
    blocks = stored(laid.mapInArrow(_blocks(folder, width, percent), BLOCK), "blocks")
    discard(spark, grouped, held, bitmap)

    # Pairs of blocks of a group whose sizes fit.
    place = ["path", "at", "sets", "size"]
    listed = stored(blocks.filter("family is not null").select("family", "block", "low", "high", *place), "block-list")
    a, b = listed.alias("a"), listed.alias("b")
    fit = (F.col("a.high") * 100 >= F.col("b.low") * percent) & (F.col("b.high") * 100 >= F.col("a.low") * percent)
    pairs = a.join(b, (F.col("a.family") == F.col("b.family")) & (F.col("a.block") < F.col("b.block")) & fit)
    pairs = pairs.select(F.col("a.block").alias("x"), F.col("b.block").alias("y"), *[F.col(f"a.{c}").alias(f"x_{c}") for c in place], *[F.col(f"b.{c}").alias(f"y_{c}") for c in place])
    met = stored(pairs, "block-pairs")
    spread = max(spark.sparkContext.defaultParallelism * 4, met.count() // 256)
    pairs = met.repartitionByRange(spread, "x", "y").sortWithinPartitions("x", "y").drop("x", "y")
    across = pairs.mapInArrow(_across(percent), LINKS)
    links = stored(blocks.filter("a is not null").select("a", "b", "links").unionByName(across), "links")
    discard(spark, blocks, listed, met, folder)

    # Rows of one doc_id with different sets are one node.
    twice = known.groupBy("doc_id").agg(F.count_distinct("print").alias("n")).filter("n > 1").select("doc_id")
    same = known.join(twice, "doc_id").join(firsts, "print").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    found = components(links.filter("b is not null").select("a", "b").unionByName(same))
    counts = stored(links.filter("b is null").groupBy("a").agg(F.sum("links").alias("links")), "link-counts")
    discard(spark, links)
    rows = printed.drop("node").join(firsts.drop("node"), "print", "left").join(found, F.col("first") == F.col("node"), "left").join(counts, F.col("first") == F.col("a"), "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("component", "first", "doc_id").alias("component_id"), F.when(F.col("first").isNull(), 0).otherwise(F.col("weight") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"))
