"""Exact BM25 top-k by sharded inverted indexes and block-max WAND.

Each task indexes the rows that it reads: a shard file holds the documents, those of one language or kind
together by ``kinds`` and in order of their lengths, and for each term its postings, sorted by document.
Document frequencies, the number of documents and their mean length are summed over all shards, so scores are
those of one index. Queries are the documents whose doc_id is divisible by ``every``, whole texts, packed in
files.

A query has a cursor in the documents' order and a threshold, its k-th best so far. Postings are cut into
blocks of ``BLOCK`` documents, and of each term the largest impact in each block is known. The pivot is the
first block at or after the cursor in which the maxima of the query's terms add up to the threshold; blocks
before it are skipped. What rare terms add is summed first, in the blocks that the thresholds leave; where that
and the maxima of the frequent terms together miss the threshold in a pivot block, a query skips the block or a
document is skipped for all, and frequent terms are scored for the others, in one product of matrices for all
queries that share the pivot. Then the cursor moves behind the block. The threshold starts from what other
shards gave: those of the task so far, and a few that are searched before all others. Without that it starts
from the block of the largest bound, which is taken before the cursor starts. So this is block-max WAND with
pivots that are blocks, and documents within them, in place of one posting at a time: queries of hundreds of
words would spend far more on moving single cursors than on the scores that it saves.

What comes near a query's k-th best is scored again in whole numbers, so ties are exact and shards merge
without rounding: a term adds round(1e6 * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean length))).
"""

from __future__ import annotations

import io
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import commit, filesystem, freed, prepare, scratch, stored, text_buffers
from .shingles import words

K1, B, UNIT = 1.2, 0.75, 1e6
BLOCK, GROUP, DENSE, SELDOM, NEXT, KINDS, MARKS = 256, 1024, 2048, 64, 4, 8, 512
BUILT = "path string, docs long, words long, term long, df long, query_id long, cluster long, terms array<bigint>"


def _save(folder: str, name: str, **arrays: np.ndarray) -> str:
    out = io.BytesIO()
    np.savez(out, **arrays)
    fs, base = filesystem(folder)
    fs.create_dir(base)
    temporary = f"{base}/.{name}.{TaskContext.get().taskAttemptId()}"
    with fs.open_output_stream(temporary) as f:
        f.write(out.getbuffer())
    commit(fs, temporary, f"{base}/{name}")
    return f"{folder}/{name}"


def _load(path: str) -> dict[str, np.ndarray]:
    fs, place = filesystem(path)
    with fs.open_input_stream(place) as f, np.load(io.BytesIO(f.read())) as found:
        return {k: found[k] for k in found.files}


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays(columns, names=names)


def count_terms(hashes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of all texts, joined, their counts, and the n + 1 offsets."""
    terms, counts, sizes = [], [], [0]
    for a, z in zip(before[:-1].tolist(), before[1:].tolist()):
        t, c = np.unique(hashes[a:z], return_counts=True)
        terms.append(t)
        counts.append(c)
        sizes.append(len(t))
    return np.concatenate(terms) if terms else np.empty(0, np.uint64), np.concatenate(counts) if counts else np.empty(0, np.int64), np.cumsum(sizes)


def kinds(n: int, owner: np.ndarray, local: np.ndarray, df: np.ndarray) -> np.ndarray:
    """The kind, such as a language, of each of n documents: their groups by cosine over the most frequent terms.

    ``owner`` and ``local`` pair documents and terms. Only the order of a shard's documents depends on kinds.
    """
    marks = np.sort(np.argsort(-df, kind="stable")[:MARKS])
    column = np.full(len(df), -1)
    column[marks] = np.arange(len(marks))
    at = column[local]
    held = at >= 0
    x = np.zeros((n, len(marks)), np.float32)
    x[owner[held], at[held]] = (np.log(n / df[marks]) + 0.1)[at[held]]
    norm = np.sqrt((x * x).sum(1))
    x /= np.maximum(norm, 1e-9)[:, None]
    # The first centres are documents far from each other, of those that hold many marks.
    centres = x[[int(norm.argmax())]]
    near, many = x @ centres[0], norm >= np.median(norm)
    while len(centres) < KINDS:
        far = int(np.where(many, near, 2).argmin())
        centres = np.concatenate([centres, x[[far]]])
        near = np.maximum(near, x @ x[far])
    for _ in range(8):
        kind = (x @ centres.T).argmax(1)
        centres = np.stack([x[kind == i].sum(0) if (kind == i).any() else c for i, c in enumerate(centres)])
        centres /= np.maximum(np.sqrt((centres * centres).sum(1)), 1e-9)[:, None]
    return kind


def _indexer(folder: str, every: int, shard_docs: int, shard_words: int):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        ids, parts, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal ids, parts, held, made
            doc_ids = np.concatenate(ids)
            terms, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            offsets = np.append(0, np.cumsum(np.concatenate([np.diff(p[2]) for p in parts])))
            lengths = np.concatenate([p[3] for p in parts])
            sizes, n = np.diff(offsets), len(doc_ids)
            owner = np.repeat(np.arange(n), sizes)
            vocabulary, local = np.unique(terms, return_inverse=True)
            df = np.bincount(local, minlength=len(vocabulary))
            place = np.empty(n, np.int64)
            by = np.lexsort((doc_ids, lengths, kinds(n, owner, local, df)))
            place[by] = np.arange(n)
            doc = place[owner]
            order = np.lexsort((doc, local))
            path = _save(folder, f"shard-{task:06d}-{made:05d}.npz", doc_ids=doc_ids[by], lengths=lengths[by], vocabulary=vocabulary, df=df, posting_doc=doc[order].astype(np.int32), posting_tf=counts[order].astype(np.int32))
            made += 1
            none = lambda k, t=pa.int64(): pa.nulls(k, t)
            lists = pa.list_(pa.int64())
            yield _batch([pa.array([path]), pa.array([n]), pa.array([int(lengths.sum())]), none(1), none(1), none(1), none(1), none(1, lists)], BUILT)
            m = len(vocabulary)
            if m:
                yield _batch([none(m, pa.string()), none(m), none(m), pa.array(vocabulary.view(np.int64)), pa.array(df), none(m), none(m), none(m, lists)], BUILT)
            asked = np.flatnonzero((doc_ids % every == 0) & (sizes > 0))
            if len(asked):
                own = [terms[offsets[i] : offsets[i + 1]].view(np.int64) for i in asked]
                m = len(asked)
                # The most frequent term of each query, the smallest hash of several.
                cluster = np.array([terms[a + counts[a:z].argmax()] for a, z in zip(offsets[asked], offsets[asked + 1])])
                yield _batch([none(m, pa.string()), none(m), none(m), none(m), none(m), pa.array(doc_ids[asked]), pa.array(cluster.view(np.int64)), pa.array(own, lists)], BUILT)
            ids, parts, held = [], [], 0

        for b in found:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                hashes, before = words(*text_buffers(part.column(1)))
                ids.append(np.asarray(part.column(0)))
                parts.append((*count_terms(hashes, before), np.diff(before)))
                held += len(hashes)
                if sum(map(len, ids)) >= shard_docs or held >= shard_words:
                    yield from flush()
        if ids:
            yield from flush()

    return freed(run)


def _packer(folder: str, size: int):
    """Files of queries: ids, offsets, the terms of all with their frequencies, and which of them each query holds."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, count = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal made, held, count
            t = pa.Table.from_batches(held).combine_chunks()
            lists = t["terms"].combine_chunks()
            pairs = lists.flatten()
            vocabulary, first, term = np.unique(np.asarray(pairs.field("term")).view(np.uint64), return_index=True, return_inverse=True)
            path = _save(folder, f"queries-{task:06d}-{made:05d}.npz", ids=np.asarray(t["query_id"]), offsets=np.append(0, np.cumsum(np.asarray(lists.value_lengths()))), vocabulary=vocabulary, df=np.asarray(pairs.field("df"))[first], term=term.astype(np.int32))
            made, held, count = made + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(t)])], names=["path", "queries"])

        for b in found:
            for at in range(0, b.num_rows, size):
                held.append(b.slice(at, size))
                count += held[-1].num_rows
                if count >= size:
                    yield flush()
        if held and count:
            yield flush()

    return freed(run)


def _spread(starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of ranges that have a start and a size, and which of the ranges each belongs to."""
    row = np.repeat(np.arange(len(starts)), size)
    return (starts - (np.cumsum(size) - size))[row] + np.arange(len(row)), row


def _ranges(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of ranges that have a start and a size."""
    ends = np.cumsum(size)
    return np.repeat(starts - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


@dataclass
class Work:
    """Blocks that were taken, postings of rare terms scored in them, and documents scored in full, over all queries."""

    blocks: int = 0
    postings: int = 0
    documents: int = 0


class Shard:
    """The index of a shard, with the impacts that the corpus's mean length gives."""

    def __init__(self, data: dict[str, np.ndarray], mean: float):
        self.doc_ids, lengths, self.vocabulary, df = data["doc_ids"], data["lengths"], data["vocabulary"], data["df"]
        self.n, self.starts = len(self.doc_ids), np.append(0, np.cumsum(df))
        self.df, self.doc, tf = df, data["posting_doc"], data["posting_tf"]
        self.doc = self.doc.astype(np.min_scalar_type(max(self.n, BLOCK)))
        self.norm = K1 * (1 - B + B * lengths / mean)
        self.impact = self.impacts(tf, self.doc).astype(np.float32)
        self.blocks = max(1, -(-self.n // BLOCK))
        often = np.flatnonzero(df >= max(2, self.n // SELDOM))
        often = often[np.argsort(-df[often], kind="stable")[:DENSE]]
        self.dense = np.full(len(df), -1, np.int64)
        self.dense[often] = np.arange(len(often))
        # blocks, frequent terms, documents of the block
        self.matrix = np.zeros((self.blocks, len(often), BLOCK), np.float32)
        pick, row = self.postings(often)
        docs = self.doc[pick].astype(np.int64)
        self.matrix[docs // BLOCK, row, docs % BLOCK] = self.impact[pick]
        # Bands of frequent terms: those of a quarter of the documents, of a sixteenth, and of fewer.
        self.bands = np.searchsorted(-df[often], [-(self.n // 4), -(self.n // 16), 0])
        self.maxima = self.matrix.max(2).T if len(often) else np.zeros((0, self.blocks), np.float32)
        # Postings of a term in a block: where they begin, the block, and their largest impact.
        owner, block = np.repeat(np.arange(len(df)), df), self.doc // BLOCK
        self.runs = np.append(np.flatnonzero(np.append(True, (np.diff(owner) != 0) | (np.diff(block) != 0))[: len(block)]), len(block))
        self.run_block = block[self.runs[:-1]].astype(np.min_scalar_type(self.blocks))
        self.run_best = np.maximum.reduceat(self.impact, self.runs[:-1]) if len(block) else self.impact
        self.term_runs = np.append(0, np.cumsum(np.bincount(owner[self.runs[:-1]], minlength=len(df))))
        # Terms of each document, for scores in whole numbers.
        order = np.argsort(self.doc.astype(np.min_scalar_type(self.n)), kind="stable")
        self.forward_term, self.forward_tf = np.repeat(np.arange(len(df), dtype=np.int32), df)[order], tf[order]
        self.forward = np.append(0, np.cumsum(np.bincount(self.doc, minlength=self.n)))

    def impacts(self, tf: np.ndarray, doc: np.ndarray) -> np.ndarray:
        tf = tf.astype(float)
        return tf * (K1 + 1) / (tf + self.norm[doc])

    def postings(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all postings of some terms, and which of the terms each belongs to."""
        return _spread(self.starts[terms], self.df[terms])

    def answer(self, ids: np.ndarray, offsets: np.ndarray, terms: np.ndarray, idf: np.ndarray, k: int, found: list[list[tuple[int, int]]] | None = None) -> tuple[list[list[tuple[int, int]]], Work]:
        """The k best (-score, doc) of each of a group of queries, for any k, and the work that it took.

        ``found`` holds what other shards gave: it is merged, and what can't beat it is skipped.
        """
        return self.search(ids, offsets, self.places(terms), idf, k, found)

    def places(self, terms: np.ndarray) -> np.ndarray:
        """Where terms are in the vocabulary, -1 for those that the shard lacks."""
        if not len(self.vocabulary):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == terms, at, -1)

    def search(self, ids: np.ndarray, offsets: np.ndarray, places: np.ndarray, idf: np.ndarray, k: int, found: list[list[tuple[int, int]]] | None = None, floor: np.ndarray | None = None) -> tuple[list[list[tuple[int, int]]], Work]:
        """``answer``, for terms given by their places in the vocabulary.

        ``floor`` has a score for each query that k documents of other shards reach; what can't is left to them.
        """
        found = found or [[] for _ in ids]
        n, known = len(ids), places >= 0
        row = np.repeat(np.arange(n), np.diff(offsets))[known]
        local, weight = places[known], idf[known]
        dense = self.dense[local]
        often = dense >= 0
        query = np.zeros((n, self.matrix.shape[1]), np.float32)
        query[row[often], dense[often]] = weight[often]
        ends = np.append(0, np.cumsum(np.bincount(row[~often], minlength=n)))
        rare, rare_weight = local[~often], weight[~often]
        near: list = []  # (query, document, score) of what came near a threshold
        own_row, own_doc = self._own(ids)
        frequent = self._frequent(query)
        bound = frequent + self._rare_bounds(rare, rare_weight, ends)
        slack = 1e-5 * bound.max(1) + 1e-3
        best = np.zeros((n, k), np.float32)  # documents that share no term are no result
        for i, f in enumerate(found):
            best[i, : len(f)] = [-x / UNIT for x, _ in f]
        if floor is not None:
            best = np.maximum(best, floor[:, None].astype(np.float32))
        least = best.min(1)
        work = Work()

        def take(b: int, rows: np.ndarray, tile: np.ndarray, held: tuple) -> None:
            """Score what can reach the thresholds of some queries in a block; ``tile`` has what rare terms add,
            ``held`` queries, some frequent terms, and the weights of these terms in these queries."""
            # Documents that the frequent terms can still lift to the threshold.
            open_ = tile >= (least[rows] - slack[rows] - frequent[rows, b])[:, None]
            open_[:, self.n - b * BLOCK :] = False
            work.blocks += len(rows)
            kept, docs = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
            if not len(kept):
                return
            rows, (asked, some, weights), part = rows[kept], held, self.matrix[b]
            if len(rows) < len(asked):
                weights = weights.take(np.searchsorted(asked, rows), 0)
            docs = docs if 2 * len(docs) <= BLOCK else np.arange(BLOCK)
            if len(docs) < BLOCK:
                part = part[np.ix_(some, docs)]
            elif len(some) < len(part):
                part = part.take(some, 0)
            work.documents += len(kept) * len(docs)
            tile = tile if len(kept) == len(tile) else tile[kept]
            if part.shape[1] == BLOCK:
                sums = weights @ part
                sums += tile
            else:
                sums = np.zeros((len(kept), BLOCK), np.float32)
                sums[:, docs] = tile[:, docs] + weights @ part
            hers = own_doc // BLOCK == b  # a query's own document is no candidate
            at = np.searchsorted(rows, own_row[hers])
            at[at == len(rows)] = 0
            mine = rows[at] == own_row[hers]
            sums[at[mine], own_doc[hers][mine] % BLOCK] = 0
            # Most queries find nothing near their threshold here.
            some = np.flatnonzero(sums.max(1) >= least[rows] - 2 * slack[rows])
            rows, sums = rows[some], sums[some]
            best[rows] = np.partition(np.concatenate([best[rows], sums], 1), BLOCK, axis=1)[:, -k:]
            least[rows] = best[rows].min(1)
            at, docs = np.nonzero((sums > 0) & (sums >= (least[rows] - 2 * slack[rows])[:, None]))
            near.append((rows[at], docs + b * BLOCK, sums[at, docs]))

        def move(todo: np.ndarray) -> None:
            """Move all cursors over the blocks to take, each from pivot to pivot."""
            sums, postings = self._rare_sums(rare, rare_weight, ends, todo)
            work.postings += postings
            for low in range(0, self.blocks, NEXT):
                nearby = slice(low, low + NEXT)
                asked = np.flatnonzero((todo[:, nearby] & (bound[:, nearby] >= (least - slack)[:, None])).any(1))
                if not len(asked):
                    continue
                weights = query.take(asked, 0)
                some = np.flatnonzero(self.maxima[:, nearby].any(1) & weights.any(0))
                held = asked, some, weights if len(some) == weights.shape[1] else weights.take(some, 1)
                for b in range(low, min(low + NEXT, self.blocks)):
                    rows = asked[todo[asked, b] & (bound[asked, b] >= least[asked] - slack[asked])]
                    if len(rows):
                        take(b, rows, sums[rows, b * BLOCK : (b + 1) * BLOCK], held)

        todo = bound > 0
        first = (np.arange(self.blocks) == bound.argmax(1)[:, None]) & todo & (least <= 0)[:, None]
        if first.any():
            move(first)
            todo &= ~first
        move(todo & (bound >= (least - slack)[:, None]))
        whole = np.zeros(len(self.vocabulary))
        ends = np.append(0, np.cumsum(np.bincount(row, minlength=n)))
        if not near:
            return found, work
        at, doc, score = (np.concatenate(x) for x in zip(*near))
        kept = score >= (least - 2 * slack)[at]
        by = np.lexsort((doc[kept], at[kept]))
        at, doc = at[kept][by], doc[kept][by]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
        for q, docs in zip(at[first].tolist(), np.split(doc, first[1:])):
            mine = slice(ends[q], ends[q + 1])
            whole[local[mine]] = weight[mine]
            size = self.forward[docs + 1] - self.forward[docs]
            place, holder = _ranges(self.forward[docs], size), np.repeat(np.arange(len(docs)), size)
            adds = whole.take(self.forward_term[place])
            shared = np.flatnonzero(adds)
            adds, holder = adds[shared], holder[shared]
            adds = np.rint(UNIT * (adds * self.impacts(self.forward_tf[place[shared]], docs[holder])))
            total = np.bincount(holder, adds, len(docs)).astype(np.int64)  # whole numbers below 2 ** 53: exact
            whole[local[mine]] = 0
            first = np.lexsort((self.doc_ids[docs], -total))[:k]
            found[q] = sorted([*found[q], *zip((-total[first]).tolist(), self.doc_ids[docs[first]].tolist())])[:k]
        return found, work

    def _frequent(self, query: np.ndarray) -> np.ndarray:
        """What the frequent terms add to a document of each block at most: for each band of terms the sum of a
        query's maxima, or the largest sum that any query could get from a document, if that is less."""
        most, out = query.max(0), np.zeros((len(query), self.blocks), np.float32)
        ends = np.append(0, self.bands).tolist()
        bands = np.zeros((len(self.bands), len(most)), np.float32)
        for i, (a, z) in enumerate(itertools.pairwise(ends)):
            bands[i, a:z] = most[a:z]
        mass = np.matmul(bands, self.matrix).max(2)
        for i, (a, z) in enumerate(itertools.pairwise(ends)):
            if a < z:
                out += np.minimum(query[:, a:z] @ self.maxima[a:z], mass[:, i])
        return out

    def _rare_bounds(self, terms: np.ndarray, weight: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """What the rare terms of each query add to a document of each block at most."""
        out = np.zeros((len(ends) - 1, self.blocks))
        for q, (a, z) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            starts = self.term_runs[terms[a:z]]
            size = self.term_runs[terms[a:z] + 1] - starts
            runs = _ranges(starts, size)
            out[q] = np.bincount(self.run_block[runs], np.repeat(weight[a:z], size) * self.run_best[runs], self.blocks)
        return out

    def _rare_sums(self, terms: np.ndarray, weight: np.ndarray, ends: np.ndarray, todo: np.ndarray) -> tuple[np.ndarray, int]:
        """What the rare terms of each query add to each document of the blocks to take, and the postings that it took."""
        fetched, width = 0, self.blocks * BLOCK
        out, share = np.zeros((len(ends) - 1, width), np.float32), todo.mean(1)
        for q in np.flatnonzero(share).tolist():
            mine, size = terms[ends[q] : ends[q + 1]], self.df[terms[ends[q] : ends[q + 1]]]
            place, each = _ranges(self.starts[mine], size), np.repeat(weight[ends[q] : ends[q + 1]], size)
            doc = self.doc[place]
            if share[q] < 0.5:  # else it costs more to leave postings out than to add them
                kept = np.flatnonzero(todo[q].take(doc // BLOCK))
                place, doc, each = place[kept], doc[kept], each[kept]
            out[q] = np.bincount(doc, each * self.impact[place], width)
            fetched += len(place)
        return out, fetched

    def _own(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, document) of the documents that queries are, in order of the queries."""
        order = np.argsort(self.doc_ids, kind="stable")
        a, z = np.searchsorted(self.doc_ids[order], ids, side="left"), np.searchsorted(self.doc_ids[order], ids, side="right")
        places, row = _spread(a, z - a)
        return row, order[places]


def _floors(path: str | None, ids: np.ndarray) -> np.ndarray:
    """The scores of a table, by query; 0 for queries that it lacks."""
    if path is None:
        return np.zeros(len(ids))
    fs, place = filesystem(path)
    held = pq.read_table(place, filesystem=fs, columns=["query_id", "score"])
    keys, scores = np.asarray(held["query_id"]), np.asarray(held["score"])
    order = np.argsort(keys)
    at = np.minimum(np.searchsorted(keys, ids, sorter=order), max(0, len(keys) - 1))
    return np.where(keys[order[at]] == ids, scores[order[at]] / UNIT, 0.0) if len(keys) else np.zeros(len(ids))


def _searcher(docs: int, mean: float, k: int, floors: str | None = None):
    """Answers of the shards of a task to some files of queries, merged; the rows pair them.

    ``floors`` is a table of scores that k documents reach which other tasks return.
    """

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = sorted(x for b in found for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        best, floor = {}, {}
        for path, some in itertools.groupby(pairs, key=lambda x: x[0]):
            shard = Shard(_load(path), mean)
            for _, name in some:
                q = _load(name)
                if name not in floor:
                    floor[name] = _floors(floors, q["ids"])
                idf, places = np.log(1 + (docs - q["df"] + 0.5) / (q["df"] + 0.5)), shard.places(q["vocabulary"])
                for low in range(0, len(q["ids"]), GROUP):
                    at, ids = q["offsets"][low : low + GROUP + 1], q["ids"][low : low + GROUP]
                    part = q["term"][at[0] : at[-1]]
                    before = best.get((name, low), (None, None))[1]
                    best[name, low] = ids, shard.search(ids, at - at[0], places[part], idf[part], k, before, floor[name][low : low + GROUP])[0]
            del shard
        for ids, lists in best.values():
            rows = [(q, d, -s) for q, own in zip(ids.tolist(), lists) for s, d in own]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["query_id", "doc_id", "score"])

    return freed(run)


def _lots(files: DataFrame, size: str, most: int, name: str) -> DataFrame:
    """Files in order, dealt into lots of about ``most`` of what they hold. A row stands for thousands of documents."""
    before = F.sum(size).over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
    return files.select(F.col("path").alias(f"{name}_path"), F.floor(F.coalesce(before, F.lit(0)) / most).cast("int").alias(name))


def lot_queries(queries: int, shard_lots: int, query_file: int, parallel: int) -> int:
    """Queries of a task: up to four files of them, where tasks still outnumber the cores, as each lot loads all shards."""
    return min(4 * query_file, max(query_file, queries * shard_lots // (4 * parallel)))


def head_shards(shards: int) -> int:
    """Shards that are searched first: an eighth of them, 16 at most."""
    return min(16, shards // 8)


def search(corpus: DataFrame, k: int = 10, every: int = 50, shard_docs: int = 8192, shard_words: int = 1 << 22, query_file: int = 4096, task_shards: int = 4) -> DataFrame:
    """query_id, rank, doc_id and score of the k best documents for each document whose doc_id is divisible by ``every``.

    A query is the set of its text's words (runs of anything but ASCII white space, A-Z lowered). Its own
    document is no candidate, nor are documents that share no word with it. Ties go to the smaller doc_id.
    Null and empty texts count as documents without words and ask nothing. Rows without doc_id take no part.
    Rows of one doc_id are documents of their own, and one query, that of the smallest terms. An empty table
    gives no rows. Other columns are ignored. Every query meets every shard, so pruned or not the work grows
    with queries times documents.
    """
    spark = corpus.sparkSession
    prepare(spark)
    rows = corpus.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    built = stored(rows.mapInArrow(_indexer(scratch(spark, "shards"), every, shard_docs, shard_words), BUILT), "index")
    shards = built.filter("path is not null").select("path", "docs", "words")
    n, docs, total = shards.agg(F.count("*"), F.sum("docs"), F.sum("words")).first()
    result = "query_id long, doc_id long, score long"
    if not n or not total:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    asked = built.filter("query_id is not null").groupBy("query_id").agg(F.min(F.struct("cluster", "terms")).alias("q")).select("query_id", "q.*")
    asked = stored(asked, "queries")
    terms = asked.select("query_id", "cluster", F.explode("terms").alias("term"))
    # Frequencies are summed before they meet the queries' terms, so that the join has one row a term on this side.
    df = stored(built.filter("term is not null").groupBy("term").agg(F.sum("df").alias("df")), "frequencies")
    known = terms.join(df, "term").groupBy("query_id", "cluster").agg(F.sort_array(F.collect_list(F.struct("term", "df"))).alias("terms"))
    laid = known.repartitionByRange("cluster", "query_id").sortWithinPartitions("cluster", "query_id").select("query_id", "terms")
    files = stored(laid.mapInArrow(_packer(scratch(spark, "queries"), query_file), "path string, queries long"), "query-files")
    asked, parallel = files.agg(F.sum("queries")).first()[0] or 0, spark.sparkContext.defaultParallelism
    most = lot_queries(asked, docs // (task_shards * shard_docs) + 1, query_file, parallel)
    right = stored(_lots(files, "queries", most, "query"), "query-lots")
    lots = (right.agg(F.max("query")).first()[0] or 0) + 1

    def answers(some: DataFrame, size: int, held: int, floors: str | None) -> DataFrame:
        """A task answers a lot of queries from a lot of shards; lots are numbered from 0, some may be empty."""
        shard_lots, left = held // size + 1, _lots(some, "docs", size, "shard")
        pairs = left.withColumn("query", F.explode(F.sequence(F.lit(0), F.lit(lots - 1)))).join(right, "query").withColumn("task", F.col("shard") * lots + F.col("query"))
        laid = pairs.repartitionById(shard_lots * lots, "task").select("shard_path", "query_path")
        return laid.mapInArrow(_searcher(docs, total / docs, k, floors), result)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")

    def ranks(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    heads = head_shards(n)
    if heads:
        # The k best of a few shards, spread over all, are where the thresholds of all other tasks start.
        shards = stored(shards.withColumn("head", F.row_number().over(Window.orderBy("path")) % (n // heads) == 0), "shards-by-head")
        head, rest = shards.filter("head"), shards.filter("not head")
        sizes = {h: x for h, x in shards.groupBy("head").agg(F.sum("docs")).collect()}
        early = stored(answers(head, shard_docs, sizes[True], None), "head")
        floors = stored(ranks(early).filter(F.col("rank") == k).select("query_id", "score"), "floors")
        found = answers(rest, task_shards * shard_docs, sizes[False], floors.scratch_path).union(early)
    else:
        found = answers(shards, task_shards * shard_docs, docs, None)
    ranked = ranks(found)
    return ranked.select("query_id", F.col("rank").cast("int"), "doc_id", (F.col("score") / UNIT).alias("score"))
