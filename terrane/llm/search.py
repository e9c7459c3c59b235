"""Exact top-k by BM25 over an inverted index with block-max pruning.

The words of the queries are numbered, and each text is read once: a table keeps a row for each document
with its numbers and their counts, so texts are never shuffled, and no group of queries reads them again.
Numbers of documents, lengths and document frequencies are counted over the whole corpus first, so a score
is the same in every shard and the shards' best k merge to the exact best k.

Documents are ordered so that neighbours are alike, cut into shards of PART_DOCS, and these into blocks
of BLOCK_DOCS that all posting lists of a shard share; a list keeps the greatest contribution of its term
in each block. A query that cannot reach its k-th best score with the greatest contributions of the shard
leaves it; others walk over the blocks in order. A query's pivot is the next block
whose maxima, summed over the query's terms, reach the k-th best score so far; the blocks before
it are skipped without a look at their documents. Rare terms have few postings, so their sums per
document are exact and tighten the bound; common terms are held as one small matrix per shard.
A number of queries walks side by side, so that maxima and scores are products of matrices.
Only the k best rows of a query leave a shard.

Each query starts from the k-th best score of an eighth of the corpus, which no better result
can be below, so most shards return next to nothing for it.

Contributions are multiples of a power of two, small enough that their sums are exact in double
precision: a score does not depend on the order or the place of its summation, and equal texts tie.

Queries go in groups of a bounded number of terms; each group is one pass over the table of numbers, with
the group's terms sent to all tasks. Groups share a table as long as their words are of a bounded number.
Memory of a task: SHARD_POSTINGS postings, a few times GROUP_CELLS numbers, and
the postings of rare terms, POSTINGS at a time; while texts are read, the words of the queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.text import WORD, slices, text_bytes, word_bounds
from terrane.session import Workspace

K1, B = 1.2, 0.75
BLOCK_TERMS = 6_000_000  # terms of a group of queries, all queries counted
VOCABULARY = 4_000_000  # distinct words of the groups that share a table
SHARD_BYTES = 12 << 20  # of text, read at once
SHARD_POSTINGS = 700_000  # read at once
TASK_POSTINGS = 2_000_000
PART_DOCS = 2048
BLOCK_DOCS = 16
CHUNK = 16  # blocks between two looks at the k-th best scores
TELLING = 256  # terms by which documents are compared
SIDES = 4
COMMON = 64  # a term may be common if more than one document of so many has it
MATRIX_ROWS = 1024  # common terms of a shard
SEEDS = 8  # one document of so many is searched first
RATE = 250  # cells of the matrix that cost as much as one posting
TILE = 512  # queries
GROUP_CELLS = 1 << 20  # documents times queries that walk side by side
POSTINGS = 1 << 16  # postings of rare terms that are summed at once, or those of one query

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _terms(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words in order, first word of each text); A-Z folded."""
    data, rows = text_bytes(column)
    starts, ends, first = word_bounds(data, rows)
    length = ends - starts
    inside = np.zeros(len(data) + 1, dtype=np.int32)
    inside[starts] += 1
    inside[ends] -= 1
    solid = _FOLD[data[np.cumsum(inside[:-1]) > 0]]
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(solid)]), first


def quantum(idf: np.ndarray, queries: list[np.ndarray]) -> float:
    """A power of two of which all contributions are multiples, so that no query's sum is rounded."""
    most = max((float(idf[terms].sum()) for terms in queries), default=1.0) * (K1 + 1)
    return 2.0 ** (math.ceil(math.log2(max(most, 1.0))) - 52)


class Shard:
    """Posting lists of some documents over the terms of a group of queries, with maxima per block."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, length: np.ndarray, ids: np.ndarray, idf: np.ndarray, mean_length: float, unit: float, tf: np.ndarray | None = None):
        """`tf`: how often a document has a term, if pairs of both come once; else they come as often."""
        n = len(length)
        doc, self.present, self.first, tf = _lists(doc, term, tf, n)
        size = np.diff(self.first)
        order = _alike_together(doc, np.repeat(np.arange(len(size)), size), length, len(size))
        self.n, self.blocks, self.width = n, -(-n // BLOCK_DOCS), len(idf)
        # Documents of a block stand `blocks` apart, so that maxima of all blocks are those of whole rows.
        rank = np.arange(n)
        place = np.empty(n, dtype=np.int64)
        place[order] = rank % BLOCK_DOCS * self.blocks + rank // BLOCK_DOCS
        self.doc = place[doc]
        self.ids, at = np.full(self.blocks * BLOCK_DOCS, NO_ID), length
        self.ids[place], length = ids, np.zeros(len(self.ids))
        length[place] = at
        norm = K1 * (1 - B + B * length / mean_length)
        self.value = np.rint(np.repeat(idf[self.present], size) * tf * (K1 + 1) / (tf + norm[self.doc]) / unit) * unit
        common = np.flatnonzero(size * COMMON > n)
        common = common[np.argsort(-size[common], kind="stable")[:MATRIX_ROWS]]
        self.place = np.full(len(self.present), -1)
        self.place[common] = np.arange(len(common))
        self.size = size[common]
        self.dense = np.zeros((len(common), self.blocks * BLOCK_DOCS))
        row = np.repeat(self.place, size)
        held = np.flatnonzero(row >= 0)
        self.dense[row[held], self.doc[held]] = self.value[held]
        self.dense = self.dense.reshape(len(common), BLOCK_DOCS, self.blocks)
        self.greatest = self.dense.max(axis=1)
        self.most = np.maximum.reduceat(self.value, self.first[:-1]) if len(self.value) else np.zeros(0)
        self.scored = self.skipped = 0

    def best(self, queries: list[np.ndarray], floors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, ids, scores) of the k best from the floor up, by score and then id; queries as sorted terms."""
        for who, ids, scores in self.found(queries, floors, k):
            bounds = np.flatnonzero(np.diff(who, prepend=-1, append=-1))
            yield from ((int(who[a]), ids[a:b], scores[a:b]) for a, b in zip(bounds, bounds[1:]))

    def found(self, queries: list[np.ndarray], floors: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same as rows, some queries at a time, ordered by query, score and id."""
        known = np.full(self.width, -1, dtype=np.int32)
        known[self.present] = np.arange(len(self.present))
        step = max(1, min(TILE, GROUP_CELLS // max(1, self.n)))
        for a in range(0, len(queries), step):
            who, docs, scores = self._walk(queries[a : a + step], np.asarray(floors[a : a + step], dtype=float), k, known)
            if len(who):
                yield who + a, self.ids[docs], scores

    def _walk(self, queries: list[np.ndarray], floors: np.ndarray, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        of = np.repeat(np.arange(len(queries)), [len(t) for t in queries])
        at = known[np.concatenate(queries)]
        here = np.flatnonzero(at >= 0)
        of, at = of[here], at[here]
        # Sums of exact multiples are exact, so bounds need no margin.
        least = np.maximum(floors, np.nextafter(0, 1))
        reach = np.bincount(of, self.most[at], len(queries)) >= least
        who = np.flatnonzero(reach)
        m = len(who)
        self.skipped += self.blocks * (len(queries) - m)
        if not m:
            return none
        if m < len(queries):
            here = np.flatnonzero(reach[of])
            of, at, least = (np.cumsum(reach) - 1)[of[here]], at[here], least[who]
        # A row of the matrix costs the same for all pairs, a posting only where a query asks for it.
        place = self.place[at]
        often = np.bincount(place[place >= 0], minlength=len(self.dense)) * self.size
        taken = np.flatnonzero(often * RATE >= self.n * m)
        row = np.full(len(self.dense) + 1, -1)
        row[taken] = np.arange(len(taken))
        place = row[place]
        asked = np.zeros((m, len(taken)))
        asked[of[place >= 0], place[place >= 0]] = 1
        sums = self._rare(of[place < 0], at[place < 0], m).reshape(m, BLOCK_DOCS, self.blocks)
        bound = asked @ self.greatest[taken] + sums.max(axis=1)
        held = none
        for a in range(0, self.blocks, CHUNK):
            live = bound[:, a : a + CHUNK] >= least[:, None]
            scored = 0
            for first, last, own in self._rectangles(live):
                blocks = slice(a + first, a + last)
                scores = (asked if len(own) == m else asked[own]) @ self.dense[taken, :, blocks].reshape(len(taken), BLOCK_DOCS * (last - first))
                scores += (sums[:, :, blocks] if len(own) == m else sums[own, :, blocks]).reshape(scores.shape)
                scored += (last - first) * len(own)
                q, docs = np.divmod(np.flatnonzero(scores >= least[own, None]), scores.shape[1])
                docs_at = docs // (last - first) * self.blocks + docs % (last - first) + a + first
                held = tuple(np.concatenate(x) for x in zip(held, (own[q], docs_at, scores[q, docs])))
            self.scored += scored * BLOCK_DOCS
            self.skipped += live.size - scored
            if len(held[0]) > k * m:
                held = self._first(*held, k)
                full = np.flatnonzero(np.bincount(held[0], minlength=m) == k)
                least[full] = np.maximum(least[full], held[2][np.searchsorted(held[0], full, "right") - 1])
        held = self._first(*held, k)
        return who[held[0]], held[1], held[2]

    @staticmethod
    def _rectangles(live: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first block, end, queries) that cover all live pairs: one, if most of it is live, or one a block."""
        blocks, queries = np.flatnonzero(live.any(axis=0)), np.flatnonzero(live.any(axis=1))
        if not len(blocks):
            return
        first, end = int(blocks[0]), int(blocks[-1]) + 1
        if (end - first) * len(queries) <= 2 * np.count_nonzero(live):
            yield first, end, queries
        else:
            yield from ((int(b), int(b) + 1, np.flatnonzero(live[:, b])) for b in blocks)

    def _rare(self, of: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
        """Every posting of the lists `at` of queries `of`, which are in order, summed per query and document."""
        rows = self.blocks * BLOCK_DOCS
        start, size = self.first[at], self.first[at + 1] - self.first[at]
        until = np.append(0, np.cumsum(np.bincount(of, size, m)).astype(np.int64))  # postings before each query
        bounds = np.searchsorted(of, np.arange(m + 1))
        sums = np.zeros((m, rows))
        a = 0
        while a < m:
            b = max(a + 1, int(np.searchsorted(until, until[a] + POSTINGS, "right")) - 1)
            own = slice(bounds[a], bounds[b])
            if own.start < own.stop:
                # One on from posting to posting, but where a list begins.
                posting = np.ones(until[b] - until[a], dtype=np.int64)
                ends = start[own] + size[own]
                posting[np.cumsum(size[own]) - size[own]] = start[own] - np.append(1, ends[:-1]) + 1
                posting[0] = start[own.start]
                np.cumsum(posting, out=posting)
                doc, value = self.doc.take(posting, mode="clip"), self.value.take(posting, mode="clip")
                for q in range(a, b):
                    some = slice(until[q] - until[a], until[q + 1] - until[a])
                    if some.start < some.stop:
                        sums[q] = np.bincount(doc[some], value[some], rows)
            a = b
        return sums

    def _first(self, who: np.ndarray, docs: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best rows of each query, by query, score and id."""
        order = np.lexsort((self.ids[docs], -scores, who))
        starts = np.flatnonzero(np.diff(who[order], prepend=-1))
        rank = np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order)))
        order = order[rank < k]
        return who[order], docs[order], scores[order]


def _lists(doc: np.ndarray, term: np.ndarray, tf: np.ndarray | None, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs by term, then document: (documents, terms in order, first pair of each and the end, counts)."""
    keys = term.astype(np.int64) * max(n, 1) + doc
    if tf is None:
        keys, tf = np.unique(keys, return_counts=True)
    else:
        order = np.argsort(keys)
        keys, tf = keys[order], tf[order]
    term, doc = np.divmod(keys, max(n, 1))
    first = np.flatnonzero(np.diff(term, prepend=-1))
    return doc, term[first], np.append(first, len(term)), tf


def _basis(doc: np.ndarray, term: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By what documents are compared: (column of each term or -1, mean, widest directions); pairs come once.

    Documents are points over the terms that split them best.
    """
    share = np.bincount(term, minlength=width) / max(n, 1)
    spread = share * (share - 1)
    telling = np.sort(np.argpartition(spread, TELLING)[:TELLING]) if width > TELLING else np.arange(width)
    column = np.full(width, -1, dtype=np.int32)
    column[telling] = np.arange(len(telling))
    points = _points(doc, term, n, column)
    mean = points.sum(axis=0) / max(n, 1)
    points -= mean
    return column, mean, np.linalg.eigh(points.T @ points)[1][:, ::-1][:, :SIDES]


def _points(doc: np.ndarray, term: np.ndarray, n: int, column: np.ndarray) -> np.ndarray:
    at = column[term]
    points = np.zeros((n, int(column.max(initial=-1)) + 1), dtype=np.float32)
    points[doc[at >= 0], at[at >= 0]] = 1
    points /= np.sqrt(np.maximum(points.sum(axis=1, keepdims=True), 1))
    return points


def _sides(doc: np.ndarray, term: np.ndarray, n: int, basis: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """On which side of the mean each document is along each direction, as one number."""
    column, mean, directions = basis
    groups = np.zeros(n, dtype=np.int64)
    for side in ((_points(doc, term, n, column) - mean) @ directions > 0).T:
        groups = groups * 2 + side
    return groups


def _alike_together(doc: np.ndarray, term: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """An order of the documents in which neighbours share common terms and are of like length; pairs come once."""
    n = len(length)
    return np.lexsort((length, _sides(doc, term, n, _basis(doc, term, n, width))))


NO_ID = np.iinfo(np.int64).max  # stands for a missing id: after all others
NUMBERED = "doc_id long, seed boolean, size long, side long, terms binary, counts binary"


def _rows_of(numbers: np.ndarray, first: np.ndarray) -> pa.Array:
    """Runs of numbers as one binary value each; `first` has the start of each run and the end."""
    offsets = (first * numbers.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(numbers))])


def _numbers_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers end to end, how many each row has) of `_rows_of`."""
    data, first = text_bytes(column)
    return data.view(np.int32), np.diff(first) // 4


def _numbered(docs: DataFrame, vocabulary, basis) -> DataFrame:
    """A row for each document: how many words it has, its side, the numbers of its words in the vocabulary, in order, and their counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        def rows(held: list[tuple[pa.RecordBatch, pa.Array, np.ndarray]]) -> pa.RecordBatch:
            # The lookup sorts in all words of the vocabulary at each call, so a call has many words.
            term = pc.index_in(pa.chunked_array([words for _, words, _ in held]), value_set=vocabulary.value)
            known = np.flatnonzero(pc.is_valid(term).to_numpy())
            size = np.concatenate([size for _, _, size in held])
            width = max(len(vocabulary.value), 1)
            keys = np.repeat(np.arange(len(size)), size)[known] * width + pc.drop_null(term).to_numpy()
            keys, counts = np.unique(keys, return_counts=True)
            first = np.searchsorted(keys, np.arange(len(size) + 1) * width)
            doc, term = np.divmod(keys, width)
            side = pa.array(_sides(doc, term, len(size), basis.value))
            ids, seeds = (pa.concat_arrays([b.column(i) for b, _, _ in held]) for i in (0, 2))
            columns = [ids, seeds, pa.array(size, pa.int64()), side, _rows_of(term.astype(np.int32), first), _rows_of(counts.astype(np.int32), first)]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "seed", "size", "side", "terms", "counts"])

        held, n = [], 0
        for batch in slices(batches):
            words, first = _terms(batch.column(1))
            held.append((batch, words, np.diff(first)))
            n += batch.column(1).nbytes
            if n >= SHARD_BYTES:
                yield rows(held)
                held, n = [], 0
        if held:
            yield rows(held)

    return docs.mapInArrow(run, NUMBERED)


def _frequencies(numbered: DataFrame, width: int) -> tuple[int, int, np.ndarray]:
    """(documents, all words, documents that hold each term)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n, total = np.zeros(width, dtype=np.int64), 0, 0
        for batch in batches:
            counts += np.bincount(_numbers_of(batch.column(1))[0], minlength=width)
            n, total = n + batch.num_rows, total + int(batch.column(0).to_numpy(zero_copy_only=False).sum())
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, [-1, -2])), pa.array(np.append(counts[seen], [n, total]))], names=["term", "n"])

    rows = numbered.select("size", "terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    terms, n = rows["term"].to_numpy(), rows["n"].to_numpy()
    frequency = np.zeros(width)
    frequency[terms[terms >= 0]] = n[terms >= 0]
    return int(n[terms == -1].sum()), int(n[terms == -2].sum()), frequency


def _shards(batches: Iterable[pa.RecordBatch], idf: np.ndarray, mean_length: float, unit: float) -> Iterator[Shard]:
    """Shards of rows of `_numbered`, about SHARD_POSTINGS at a time dealt so that a shard's documents are alike."""
    import pyarrow.compute as pc

    def dealt(held: list[tuple[np.ndarray, ...]]) -> Iterator[Shard]:
        ids, length, size, term, tf = (np.concatenate(x) for x in zip(*held))
        order = _alike_together(np.repeat(np.arange(len(ids)), size), term, length, len(idf))
        start = np.cumsum(size) - size
        for a in range(0, len(order), PART_DOCS):
            own = order[a : a + PART_DOCS]
            some = size[own]
            at = np.repeat(start[own] - np.cumsum(some) + some, some) + np.arange(some.sum())
            yield Shard(np.repeat(np.arange(len(own)), some), term[at], length[own], ids[own], idf, mean_length, unit, tf[at])

    held, n = [], 0
    for batch in slices(batches, "terms"):
        ids, length = pc.fill_null(batch.column(0), NO_ID).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        (term, size), (tf, _) = _numbers_of(batch.column(2)), _numbers_of(batch.column(3))
        held.append((ids, length, size, term, tf))
        n += len(term)
        if n >= SHARD_POSTINGS:
            yield from dealt(held)
            held, n = [], 0
    if held:
        yield from dealt(held)


def _alike(numbered: DataFrame, postings: float) -> DataFrame:
    """Rows of `_numbered` in tasks of about TASK_POSTINGS of so many postings, alike ones together."""
    return numbered.repartitionByRange(max(1, math.ceil(postings / TASK_POSTINGS)), "side", "size", "doc_id")


def _vocabulary(asked: DataFrame) -> pa.Array:
    """The distinct words of queries, in order."""
    words = asked.select(F.explode("terms").alias("word")).distinct().toArrow()["word"]
    return words.cast(pa.large_binary()).combine_chunks().sort()


def _asked(asked: DataFrame, vocabulary) -> tuple[np.ndarray, list[np.ndarray]]:
    """(ids, sorted numbers of the words) of a group of queries, alike ones next to each other."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            term = pc.index_in(batch.column(1).flatten().cast(pa.large_binary()), value_set=vocabulary.value).to_numpy(zero_copy_only=False)
            size = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            first = np.append(0, np.cumsum(size))
            numbers = np.sort(np.repeat(np.arange(len(size)), size) * len(vocabulary.value) + term) % len(vocabulary.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), _rows_of(numbers.astype(np.int32), first)], names=["query_id", "terms"])

    rows = asked.select("query_id", "terms").mapInArrow(run, "query_id long, terms binary").toArrow().sort_by("query_id").combine_chunks()
    ids = rows["query_id"].to_numpy()
    terms, size = _numbers_of(rows["terms"].combine_chunks())
    order = _alike_together(np.repeat(np.arange(len(size)), size), terms, size, len(vocabulary.value))
    queries = np.split(terms, np.cumsum(size)[:-1])
    return ids[order], [queries[i] for i in order]


def _searched(numbered: DataFrame, group: tuple[np.ndarray, list[np.ndarray]], counts: tuple[int, int, np.ndarray], ws: Workspace, k: int) -> DataFrame:
    """The best k of every shard for one group of queries."""
    spark = numbered.sparkSession
    (asked, queries), (n, total, frequency) = group, counts
    idf = np.log1p((n - frequency + 0.5) / (frequency + 0.5))
    ends = np.cumsum([len(t) for t in queries])
    sent = spark.sparkContext.broadcast((asked, np.concatenate(queries), ends, idf, max(total / max(n, 1), 1e-9), quantum(idf, queries)))

    def scanned(rows: DataFrame, floors: np.ndarray) -> DataFrame:
        known = spark.sparkContext.broadcast(floors)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, terms, ends, idf, mean_length, unit = sent.value
            queries, least = np.split(terms, ends[:-1]), known.value.copy()
            # No shard is held while the next is made.
            for found in map(lambda shard: list(shard.found(queries, least, k)), _shards(batches, idf, mean_length, unit)):
                if not found:
                    continue
                who, ids, scores = (np.concatenate(x) for x in zip(*found))
                # No better result can be below the k-th best of any k documents.
                full = np.flatnonzero(np.bincount(who, minlength=len(least)) == k)
                least[full] = np.maximum(least[full], scores[np.searchsorted(who, full, "right") - 1])
                yield pa.RecordBatch.from_arrays([pa.array(asked[who]), pa.array(ids, mask=ids == NO_ID), pa.array(scores)], names=["query_id", "doc_id", "score"])

        return rows.select("doc_id", "size", "terms", "counts").mapInArrow(run, "query_id long, doc_id long, score double")

    # The seeds are gathered in as few tasks as they fill.
    seeds = _alike(numbered.where("seed"), float(frequency.sum()) / SEEDS)
    first = ws.save(scanned(seeds, np.zeros(len(asked))), "seeds")
    # One number for each query of the group.
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"))))
    best = ranked.where(F.col("rank") == k).select("query_id", "score").toArrow()
    floors, order = np.zeros(len(asked)), np.argsort(asked)
    floors[order[np.searchsorted(asked, best["query_id"].to_numpy(), sorter=order)]] = best["score"].to_numpy()
    return ws.save(scanned(numbered.where("NOT seed"), floors), "others").unionByName(first)


def top_k(docs: DataFrame, queries: DataFrame, ws: Workspace, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(query_id, rank, doc_id, score) of the best k of `docs` for each row of `queries` (query_id, text).

    Terms are the distinct words with A-Z folded; ties go to the smaller id, missing ids last.
    Documents without any term of the query are not returned, so a query without words, or an
    empty table, gives no rows. Repeated documents are each returned; queries must have distinct,
    non-null ids, others are left out or merged to their first.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("seed", F.pmod(F.xxhash64("doc_id", "text"), F.lit(SEEDS)) == 0)
    folded = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = queries.where("query_id IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), F.array_distinct(F.regexp_extract_all(folded, F.lit(WORD), F.lit(0))).alias("terms"))
    asked = ws.save(asked.where(F.size("terms") > 0).groupBy("query_id").agg(F.min("terms").alias("terms")), "queries")
    found = None
    for number, groups in enumerate(_sharing(asked, _groups(asked, block_terms))):
        send = docs.sparkSession.sparkContext.broadcast
        vocabulary = send(_vocabulary(_between(asked, groups)))
        _, some = _asked(_between(asked, groups[:1]), vocabulary)
        size = [len(terms) for terms in some]
        basis = send(_basis(np.repeat(np.arange(len(some)), size), np.concatenate(some), len(some), len(vocabulary.value)))
        numbered = ws.save(_numbered(texts, vocabulary, basis), f"numbered-{number}")
        counts = _frequencies(numbered, len(vocabulary.value))
        # Tasks get documents that are alike.
        ordered = ws.save(_alike(numbered, float(counts[2].sum())), f"ordered-{number}")
        ws.drop(f"numbered-{number}")
        for group in groups:
            some = _asked(_between(asked, [group]), vocabulary)
            part = _searched(ordered, some, counts, ws.child(f"found-{number}"), k)
            found = part if found is None else found.unionByName(part)
        ws.drop(f"ordered-{number}")
    if found is None:
        found = docs.sparkSession.createDataFrame([], "query_id long, doc_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def _groups(asked: DataFrame, block_terms: int) -> list[tuple[int, int]]:
    """Ranges of query ids with at most `block_terms` terms each, or one longer query."""
    rows = asked.select("query_id", F.size("terms").cast("long").alias("n")).toArrow().sort_by("query_id")
    ids, until = rows["query_id"].to_numpy(), np.cumsum(rows["n"].to_numpy())
    groups, a = [], 0
    while a < len(ids):
        b = max(a + 1, int(np.searchsorted(until, (until[a - 1] if a else 0) + block_terms, "right")))
        groups.append((int(ids[a]), int(ids[b - 1])))
        a = b
    return groups


def _between(asked: DataFrame, groups: list[tuple[int, int]]) -> DataFrame:
    return asked.where(F.col("query_id").between(groups[0][0], groups[-1][1]))


def _sharing(asked: DataFrame, groups: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Runs of groups whose distinct words number at most VOCABULARY, or one group alone."""
    if len(groups) > 1 and _between(asked, groups).select(F.explode("terms").alias("word")).distinct().count() > VOCABULARY:
        yield from _sharing(asked, groups[: len(groups) // 2])
        yield from _sharing(asked, groups[len(groups) // 2 :])
    elif groups:
        yield groups
