"""Removal of passages of `window` words that an earlier document holds, by super-k-mers.

Every window has a minimiser: the least hash of the `GRAM`-word runs in it. Consecutive windows
with one minimiser are packed into one string, a super-k-mer, that travels to the minimiser's
bucket. Equal windows have equal minimisers, so a bucket sees all places of its windows. It
numbers words, then runs of 2, 4, 8 ... words by pairs of numbers, and sorts the windows'
numbers: no hash decides there whether two windows are equal.

1. Minimisers of all texts, without the texts; those of one document alone are done with.
2. The texts of the other documents, each with its shared minimisers, are packed.
3. Buckets find, for each window, the first document that holds it.
4. Documents learn which windows of their super-k-mers an earlier document holds.

Copies: a super-k-mer is sent once for each slice of texts, with the least and greatest
document, so that a group of copies does not gather in its buckets. A minimiser that is shared
by many documents with differing surroundings, as in a widespread passage, is split: its windows
travel singly and are dealt by a hash of the whole window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.text import PrefixHash, mixed, sliding_min, slices, text_bytes, word_bounds
from terrane.session import Workspace

WINDOW = 50
GRAM = 8  # a power of two
LONGEST = 1024  # windows of a super-k-mer
BUSY = 2048  # documents of a minimiser, beyond which it is split
BUCKET_BYTES = 3 << 20  # of packed strings that a bucket task works on at once, beyond whole groups

_LAST = np.iinfo(np.int64).max  # place of documents without an id: after all others


class Runs:
    """The super-k-mers of a slice of texts: row, first word, windows, minimiser, hash of the words."""

    def __init__(self, column: pa.Array, window: int):
        self.data, rows = text_bytes(column)
        self.starts, self.ends, self.first = word_bounds(self.data, rows)
        words = PrefixHash(self.data).of(self.starts, self.ends)
        grams, size = words, 1
        while size < GRAM:
            grams = mixed(grams[: max(0, len(grams) - size)] * np.uint64(0x9E3779B97F4A7C15) + grams[size:])
            size *= 2
        least = sliding_min(grams, window - GRAM + 1) if len(grams) > window - GRAM else np.zeros(0, np.uint64)
        per_row = np.diff(self.first)
        row = np.repeat(np.arange(len(per_row)), per_row)
        place = np.arange(len(words))
        valid = place + window <= self.first[1:][row] if len(words) else np.zeros(0, bool)
        at = np.flatnonzero(valid)
        least, row = least[at], row[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
        heads = np.flatnonzero(new)
        length = np.diff(np.concatenate([heads, [len(at)]]))
        # Long runs, as in repetitive text, are cut.
        cuts = (length + LONGEST - 1) // LONGEST
        nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        heads, length = np.repeat(heads, cuts) + nth * LONGEST, np.repeat(length, cuts) - nth * LONGEST
        self.windows = np.minimum(length, LONGEST)
        self.row, self.word, self.minimiser = row[heads], at[heads], least[heads].view(np.int64)
        sums = np.zeros(len(words) + 1, dtype=np.uint64)
        powers = np.multiply.accumulate(np.full(len(words) + 1, 0xD6E8FEB86659FD93, dtype=np.uint64))
        np.cumsum(words * powers[:-1], out=sums[1:])
        back = np.multiply.accumulate(np.full(len(words) + 1, pow(0xD6E8FEB86659FD93, -1, 1 << 64), dtype=np.uint64))
        self._range = lambda a, b: mixed((sums[b] - sums[a]) * back[a])
        self.window = window

    def hashes(self) -> np.ndarray:
        return self._range(self.word, self.word + self.windows + self.window - 1).view(np.int64)

    def packed(self, word: int, count: int) -> bytes:
        """`count` words from `word` on, with one space between."""
        return b" ".join(self.data[self.starts[word] : self.ends[word + count - 1]].tobytes().split())


def _keyed(docs: DataFrame) -> DataFrame:
    """Texts with `_key` to join on and `_rank` to compare: the id, or for a missing id a hash and the last place."""
    own = F.col("doc_id").cast("long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(own.alias("doc_id"), F.coalesce(own, F.xxhash64("text")).alias("_key"), F.coalesce(own, F.lit(_LAST)).alias("_rank"), text.alias("text"))


def _minimisers(keyed: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            runs = Runs(batch.column(2), window)
            key, rank = (batch.column(i).to_numpy(zero_copy_only=False)[runs.row] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(runs.minimiser), pa.array(runs.hashes()), pa.array(key), pa.array(rank)], names=["m", "h", "_key", "_rank"])

    return keyed.select("_key", "_rank", "text").mapInArrow(run, "m long, h long, _key long, _rank long")


_PACKED = "m long, salt int, digest binary, _key long, _rank long, packed string, low long, high long"


def _pack(flagged: DataFrame, window: int) -> DataFrame:
    """The shared super-k-mers: `packed` only at the first of a slice, with the slice's least and greatest rank."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            runs = Runs(batch.column(batch.schema.get_field_index("text")), window)
            key, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("_key", "_rank"))
            shared = [{x["m"]: x["parts"] for x in row} for row in batch.column(batch.schema.get_field_index("shared")).to_pylist()]
            out: list[list] = [[] for _ in range(8)]
            known: dict[bytes, int] = {}
            for row, word, windows, m in zip(runs.row.tolist(), runs.word.tolist(), runs.windows.tolist(), runs.minimiser.tolist()):
                parts = shared[row].get(m)
                if parts is None:
                    continue
                step = windows if parts == 1 else 1
                for at in range(word, word + windows, step):
                    packed = runs.packed(at, step + window - 1)
                    digest = hashlib.blake2b(packed, digest_size=16).digest()
                    seen = known.get(digest)
                    if seen is None:
                        known[digest] = seen = len(out[0])
                    else:
                        out[6][seen] = min(out[6][seen], int(rank[row]))
                        out[7][seen] = max(out[7][seen], int(rank[row]))
                    salt = int.from_bytes(digest[:4], "little") % parts
                    first = seen == len(out[0])
                    for column, value in zip(out, (m, salt, digest, int(key[row]), int(rank[row]), packed.decode() if first else None, int(rank[row]), int(rank[row]))):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            names = ["m", "salt", "digest", "_key", "_rank", "packed", "low", "high"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    return flagged.mapInArrow(run, _PACKED)


def window_numbers(words: np.ndarray, window: int) -> np.ndarray:
    """A number for the `window` words from each place on: equal numbers, equal words."""
    import pandas as pd

    numbers, size = words.astype(np.int64), 1
    while len(numbers) and size < window:
        step = min(size, window - size)
        numbers = pd.factorize(numbers[: len(numbers) - step] * (numbers.max() + 1) + numbers[step:])[0]
        size += step
    return numbers


def _buckets(window: int):
    """Per super-k-mer, runs of windows with the first document that holds them, where that matters to any document."""
    import pyarrow.compute as pc

    def solve(part: pa.Table) -> pa.RecordBatch | None:
        words = pc.split_pattern(part.column("packed").combine_chunks(), " ")
        size = np.diff(words.offsets.to_numpy())
        ids = words.flatten().dictionary_encode().indices.to_numpy()
        numbers = window_numbers(ids, window)
        begin, count = np.cumsum(size) - size, size - window + 1
        of = np.repeat(np.arange(len(size)), count)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        numbers = numbers[begin[of] + nth]
        low = part.column("low").to_numpy()
        order = np.argsort(numbers, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], np.diff(numbers[order]) != 0]))
        least = np.minimum.reduceat(low[of][order], heads)
        first = np.empty(len(of), dtype=np.int64)
        first[order] = np.repeat(least, np.diff(np.concatenate([heads, [len(of)]])))
        high: dict[bytes, int] = {}
        digests = part.column("digest").to_pylist()
        for digest, greatest in zip(digests, part.column("high").to_pylist()):
            high[digest] = max(high.get(digest, greatest), greatest)
        found, runs, ends = [], [], np.cumsum(count)
        lowest = np.minimum.reduceat(first, ends - count)
        for i, digest in enumerate(digests):
            greatest = high.pop(digest, None)
            if greatest is not None and greatest > lowest[i]:
                own = first[ends[i] - count[i] : ends[i]]
                cuts = np.flatnonzero(np.concatenate([[True], np.diff(own) != 0]))
                length = np.diff(np.concatenate([cuts, [len(own)]]))
                found.append(digest)
                runs.append([{"at": int(a), "n": int(n), "first": int(own[a])} for a, n in zip(cuts, length)])
        if not found:
            return None
        kind = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("first", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(runs, kind)], names=["digest", "runs"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        held = 0
        for batch in _small(batches):
            rest.append(batch)
            held += batch.nbytes
            if held < BUCKET_BYTES:
                continue
            part = pa.Table.from_batches(rest)
            m, salt = part.column("m").to_numpy(), part.column("salt").to_numpy()
            other = np.flatnonzero((m != m[-1]) | (salt != salt[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut and (done := solve(part.slice(0, cut))):
                yield done
            rest = part.slice(cut).combine_chunks().to_batches()
            held = sum(b.nbytes for b in rest) if cut else 0
        if rest and sum(b.num_rows for b in rest) and (done := solve(pa.Table.from_batches(rest))):
            yield done

    return run


def _small(batches: Iterable[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def _kept(window: int, keep_text: bool):
    """Texts without the words that covered windows hold: count, digest, and on request the text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names = batch.schema.names
            runs = Runs(batch.column(names.index("text")), window)
            rank = batch.column(names.index("_rank")).to_numpy(zero_copy_only=False)
            earlier = [{x["digest"]: x["runs"] for x in row or ()} for row in batch.column(names.index("earlier")).to_pylist()]
            split = [{x["m"]: x["parts"] for x in row or ()} for row in batch.column(names.index("shared")).to_pylist()]
            marks = np.zeros(len(runs.starts) + 1, dtype=np.int64)
            for row, word, windows, m in zip(runs.row.tolist(), runs.word.tolist(), runs.windows.tolist(), runs.minimiser.tolist()):
                parts = split[row].get(m)
                if parts is None or not earlier[row]:
                    continue
                step = windows if parts == 1 else 1
                for at in range(word, word + windows, step):
                    digest = hashlib.blake2b(runs.packed(at, step + window - 1), digest_size=16).digest()
                    for x in earlier[row].get(digest, ()):
                        if x["first"] < rank[row]:
                            marks[at + x["at"]] += 1
                            marks[at + x["at"] + x["n"] + window - 1] -= 1
            covered = np.cumsum(marks[:-1]) > 0
            texts, removed = [], []
            for row in range(batch.num_rows):
                a, b = int(runs.first[row]), int(runs.first[row + 1])
                keep = np.flatnonzero(~covered[a:b]) + a
                texts.append(b" ".join([runs.data[s:e].tobytes() for s, e in zip(runs.starts[keep], runs.ends[keep])]).decode())
                removed.append(b - a - len(keep))
            whole = [t.as_py().encode().split() for t in batch.column(names.index("text"))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(names.index("_key")),
                    pa.array([hashlib.sha256(b" ".join(t)).hexdigest() for t in whole], pa.string()),
                    pa.array(removed, pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                    pa.array(texts if keep_text else [None] * len(texts), pa.string()),
                ],
                names=["_key", "whole_sha256", "n_removed", "kept_sha256", "kept"],
            )

    return run


def _whole(keep_text: bool):
    """Every text as if nothing were removed: words, digest, and on request the words themselves."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = [t.as_py().encode().split() for t in batch.column(2)]
            texts = [b" ".join(w) for w in words]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                    pa.array([t.decode() if keep_text else None for t in texts], pa.string()),
                ],
                names=["doc_id", "_key", "n_words", "whole_sha256", "whole"],
            )

    return run


def without_repeats(docs: DataFrame, ws: Workspace, window: int = WINDOW, busy: int = BUSY, keep_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) per row of `docs`; `kept` is null unless asked for.

    A word goes if a window covers it that also starts in a document with a smaller id. Windows
    are judged on the input. Null texts are empty. Rows that share an id are one document for
    this purpose, so none of them removes words of another; a missing id comes after all others,
    and documents without one keep what only they share. An empty table gives an empty one.
    """
    keyed = _keyed(docs)
    seen = ws.save(_minimisers(keyed, window), "minimisers")
    by = seen.groupBy("m").agg(F.min("_rank").alias("low"), F.max("_rank").alias("high"), F.count("*").alias("n"), (F.min("h") != F.max("h")).alias("vary"))
    parts = F.when(F.col("vary"), F.ceil(F.col("n") / busy)).otherwise(1).cast("int")
    shared = by.where("low < high").select("m", parts.alias("parts"))
    per_document = seen.join(shared, "m").groupBy("_key").agg(F.collect_set(F.struct("m", "parts")).alias("shared"))
    # A document's list is bounded by its own length.
    flagged = ws.save(keyed.join(per_document, "_key"), "flagged")
    packed = ws.save(_pack(flagged.select("_key", "_rank", "text", "shared"), window), "packed")
    bucketed = packed.where("packed IS NOT NULL").select("m", "salt", "digest", "packed", "low", "high")
    bucketed = bucketed.repartition("m", "salt").sortWithinPartitions("m", "salt")
    first = bucketed.mapInArrow(_buckets(window), "digest binary, runs array<struct<at:int,n:int,first:bigint>>")
    first = ws.save(first, "first")
    hit = packed.select("digest", "_key", "_rank").join(first, "digest").where(F.exists("runs", lambda x: x["first"] < F.col("_rank")))
    earlier = hit.groupBy("_key").agg(F.collect_set(F.struct("digest", "runs")).alias("earlier"))
    touched = flagged.join(earlier, "_key").mapInArrow(_kept(window, keep_text), "_key long, whole_sha256 string, n_removed long, kept_sha256 string, kept string")
    # Rows with one id and one text are told apart by nothing and get one result.
    touched = touched.dropDuplicates(["_key", "whole_sha256"]).withColumn("_hit", F.lit(True))
    every = keyed.select("doc_id", "_key", "text").mapInArrow(_whole(keep_text), "doc_id long, _key long, n_words long, whole_sha256 string, whole string")
    hit = F.col("_hit")
    return every.join(touched, ["_key", "whole_sha256"], "left").select(
        "doc_id",
        "n_words",
        F.when(hit, F.col("n_removed")).otherwise(F.lit(0)).alias("n_removed"),
        F.when(hit, F.col("kept_sha256")).otherwise(F.col("whole_sha256")).alias("kept_sha256"),
        F.when(hit, F.col("kept")).otherwise(F.col("whole")).alias("kept"),
    )
