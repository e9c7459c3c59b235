"""Vectors as short codes: product quantisation with exact nearest entries by intersected bit masks.

A vector of integers is cut into equal parts, and each part is replaced by the number of the nearest entry
of its position's codebook. A codebook has at most 64 entries, so a set of entries is one number
of 64 bits. For every dimension of a part the entries' coordinates are sorted, with the set of
the first i of them for each i. A part finds its entry so:

1. The entries next to it along each dimension give a first distance; the least of these is the
   initial radius, and no nearer entry lies outside it.
2. In each dimension the radius selects a range of the sorted coordinates; the set of its entries
   is the difference of two prefix sets.
3. The sets of all dimensions are ANDed. What is left are all candidates; their distances are
   computed, the lowest number first, so that ties go to it.

Codebooks are refined in rounds: every task sums the parts of its rows per entry, the sums are
combined by Spark, and at most parts x entries rows come to the driver. All numbers are integers,
so results do not depend on the order of the sums.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.session import Workspace

PARTS = 16
ENTRIES = 64  # of a codebook: the bits of a set
ROUNDS = 2
SCALE = 256
BATCH = 4096  # rows worked on at a time
HOT = 256  # a label with more than one row of so many is joined by broadcast: fewer than so many labels


def _by_id(kept: DataFrame) -> DataFrame:
    return kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector")


@dataclass
class Codebook:
    """Entries of one part position, in their order, and the sorted coordinates with prefix sets."""

    entries: np.ndarray  # (entries, width) integers

    def __post_init__(self):
        n, width = self.entries.shape
        order = np.argsort(self.entries, axis=0, kind="stable")
        self.order = order
        self.sorted = np.take_along_axis(self.entries, order, axis=0)
        self.prefix = np.zeros((n + 1, width), dtype=np.uint64)
        for i in range(n):
            self.prefix[i + 1] = self.prefix[i] | (np.uint64(1) << order[i].astype(np.uint64))

    def distances(self, parts: np.ndarray, entry: np.ndarray) -> np.ndarray:
        gap = parts - self.entries[entry]
        return (gap * gap).sum(axis=1)

    def radius(self, parts: np.ndarray) -> np.ndarray:
        """The squared distance to the best of the entries next to the part along each dimension."""
        n, width = self.entries.shape
        best = None
        for d in range(width):
            at = np.searchsorted(self.sorted[:, d], parts[:, d])
            for side in (np.minimum(at, n - 1), np.maximum(at - 1, 0)):
                found = self.distances(parts, self.order[side, d])
                best = found if best is None else np.minimum(best, found)
        return best

    def candidates(self, parts: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """The set of entries within the squared radius along every dimension."""
        reach = np.sqrt(radius.astype(np.float64)).astype(np.int64) + 1
        left = np.full(len(parts), np.uint64(0xFFFFFFFFFFFFFFFF))
        for d in range(parts.shape[1]):
            low = np.searchsorted(self.sorted[:, d], parts[:, d] - reach, side="left")
            high = np.searchsorted(self.sorted[:, d], parts[:, d] + reach, side="right")
            left &= self.prefix[high, d] & ~self.prefix[low, d]
        return left

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every part; of equal distances the lowest entry."""
        left = self.candidates(parts, self.radius(parts))
        entry = np.zeros(len(parts), dtype=np.int64)
        best = np.full(len(parts), np.iinfo(np.int64).max)
        rows = np.arange(len(parts))
        while len(rows):
            sets = left[rows]
            lowest = sets & (~sets + np.uint64(1))
            number = np.bitwise_count(lowest - np.uint64(1)).astype(np.int64)
            found = self.distances(parts[rows], number)
            nearer = found < best[rows]
            entry[rows[nearer]], best[rows[nearer]] = number[nearer], found[nearer]
            left[rows] = sets ^ lowest
            rows = rows[left[rows] != 0]
        return entry, best


def integers(column: pa.Array) -> np.ndarray:
    """floor(SCALE * x) of equally long vectors, as (rows, length); held within `largest`."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    length = len(values) // len(column) if len(column) else 0
    scaled = np.clip(np.floor(values * SCALE), -largest(length), largest(length))
    return scaled.astype(np.int64).reshape(len(column), length)


def largest(length: int) -> int:
    """The largest size of a component with which no sum of squared differences of a vector overflows."""
    return math.isqrt((1 << 62) // max(length, 1)) // 2


def _cut(vectors: np.ndarray, parts: int) -> np.ndarray:
    """(rows, parts, width); a length that `parts` does not divide is filled up with zeros."""
    width = -(-vectors.shape[1] // parts)
    filled = np.zeros((len(vectors), parts * width), dtype=np.int64)
    filled[:, : vectors.shape[1]] = vectors
    return filled.reshape(len(vectors), parts, width)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vector) of the rows whose vector is there and has only finite components."""
    v = F.col("embedding").cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col("embedding").isNotNull()).where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("vector"))


def start_books(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> list[Codebook]:
    """The parts of the `entries` vectors with the smallest ids, which all have the same length."""
    rows = _by_id(kept).limit(entries).select("vector").collect()
    if not rows or not len(rows[0]["vector"]):
        return []
    found = _cut(integers(pa.array([r["vector"] for r in rows], pa.list_(pa.float64()))), parts)
    return [Codebook(found[:, p]) for p in range(parts)]


def refined(fitting: DataFrame, books: list[Codebook]) -> list[Codebook]:
    """Each entry replaced by the floored mean of the parts nearest to it; unused entries stay."""
    shared = fitting.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        sums = [np.zeros((len(b.entries), b.entries.shape[1] + 1), dtype=np.int64) for b in books]
        for batch in _small(batches):
            cut = _cut(integers(batch.column(0)), len(books))
            for p, book in enumerate(books):
                entry, _ = book.nearest(cut[:, p])
                np.add.at(sums[p], entry, np.concatenate([cut[:, p], np.ones((len(cut), 1), np.int64)], axis=1))
        used = [(p, e, s[e]) for p, s in enumerate(sums) for e in np.flatnonzero(s[:, -1])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _, _ in used], pa.int32()), pa.array([int(e) for _, e, _ in used], pa.int32()), pa.array([s.tolist() for _, _, s in used], pa.list_(pa.int64()))],
            names=["part", "entry", "sums"],
        )

    width = books[0].entries.shape[1] + 1
    found = fitting.select("vector").mapInArrow(run, "part int, entry int, sums array<bigint>")
    # Sums of integers in decimals: exact however many rows there are.
    totals = found.groupBy("part", "entry").agg(*[F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)])
    entries = [b.entries.copy() for b in books]
    for row in totals.collect():  # at most parts x entries rows
        entries[row["part"]][row["entry"]] = [int(row[f"s{i}"]) // int(row[f"s{width - 1}"]) for i in range(width - 1)]
    return [Codebook(e) for e in entries]


def _small(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, BATCH):
            yield batch.slice(first, BATCH)


def digest(books: list[Codebook]) -> str:
    """SHA-256 of all entries' components by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.entries.ravel()).encode()).hexdigest()


def assigned(kept: DataFrame, books: list[Codebook]) -> DataFrame:
    """(vec_id, label, code, error) of every row; all vectors have the codebooks' length."""
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in _small(batches):
            cut = _cut(integers(batch.column(2)), len(books))
            error = np.zeros(len(cut), dtype=np.int64)
            codes = np.empty((len(cut), len(books)), dtype=np.uint8)
            for p, book in enumerate(books):
                entry, found = book.nearest(cut[:, p])
                codes[:, p] = entry
                error += found
            names = ["vec_id", "label", "code", "error"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], names=names)

    kind = kept.schema["label"].dataType.simpleString()
    return kept.select("vec_id", "label", "vector").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def with_label_error(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """`rows` and the summed error of their label. Hot labels, fewer than `hot`, are broadcast; the others are spread."""
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")).withColumnRenamed("label", "_label")
    every = rows.agg(F.count("*")).scalar()
    same = F.col("label").eqNullSafe(F.col("_label"))
    often = sums.where(F.col("_n") * hot > every)
    seldom = sums.where(F.col("_n") * hot <= every)
    found = rows.join(F.broadcast(often), same, "inner").unionByName(rows.join(F.broadcast(often), same, "left_anti").join(seldom, same, "inner"))
    return found.drop("_label", "_n")


def compressed(vectors: DataFrame, ws: Workspace, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) per usable row of `vectors` (vec_id, embedding, label).

    Rows whose vector is null, or holds null or non-finite components, are dropped. The length is that
    of the vector with the smallest id (missing ids last; repeated ids by the vector's value); rows
    of another length have a null code and error and take no part. A length that `parts` does not
    divide is filled up with zeros. Integers beyond `largest` in size (2**27 for 64 components) count as that. With fewer rows
    than `entries` a codebook has one entry a row, repeated vectors included. Equal rows get equal
    results. Empty vectors, if the first is one, have an empty code and no error. An empty table
    gives an empty one. Other columns are not read.
    """
    if not 1 <= entries <= 64:
        raise ValueError("a codebook has 1 to 64 entries")
    kept = ws.save(usable(vectors), "kept")
    first = _by_id(kept).limit(1).select(F.size("vector").alias("n")).first()
    length = first["n"] if first else 0
    fitting = kept.where(F.size("vector") == length)
    books = start_books(fitting, parts, entries)
    for _ in range(rounds if books else 0):
        books = refined(fitting, books)
    other = kept.where(F.size("vector") != length).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if books:
        coded = assigned(fitting, books).unionByName(other)
    else:
        coded = fitting.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).unionByName(other)
    coded = ws.save(coded, "coded")
    return with_label_error(coded).withColumn("codebooks_sha256", F.lit(digest(books))).select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")
