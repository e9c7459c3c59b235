"""Text quality by a factorisation machine.

Inputs of a score are the text's hashed words and statistics of its structure and size, never
its label, language, source or id. The pairwise part of the machine is computed in linear time:
the sum over all pairs x_i x_j <v_i, v_j> is half of |sum x_i v_i|^2 - sum x_i^2 |v_i|^2.

Fitting reads a bounded sample of labelled documents (`Settings.sample_rows`), in one task;
scoring reads every text in full, in Arrow batches cut to bounded slices.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from terrane.llm.text import PrefixHash, slices, text_bytes, word_bounds


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 14
    rank: int = 8
    sample_rows: int = 6000  # labelled documents used for fitting, smallest hashes of the id first
    epochs: int = 12
    batch: int = 128
    rate: float = 0.02
    decay: float = 1e-5
    threshold: float = 0.3
    seed: int = 7


STATISTICS = (
    "upper", "digits", "marks", "bars", "shouts", "stops", "lines", "high_bytes", "word_length", "long_words",
    "repeats_before", "distinct", "marked_words", "words", "bytes", "one_byte_words", "top_word", "shouting_words",
)


def statistics(data: np.ndarray, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One line of STATISTICS per text; all are 0 for an empty text."""
    n = len(rows) - 1
    size, words = np.diff(rows).astype(np.float64), np.diff(first).astype(np.float64)

    def bytes_in(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[rows[1:]] - total[rows[:-1]]) / np.maximum(size, 1)

    def words_in(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(values.astype(np.float64))])
        return (total[first[1:]] - total[first[:-1]]) / np.maximum(words, 1)

    of = np.repeat(np.arange(n), np.diff(first))
    before = np.zeros(len(hashes), dtype=bool)
    before[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((hashes, of))
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
    runs = np.flatnonzero(new)
    top = np.zeros(n)
    np.maximum.at(top, of[order][runs], np.diff(np.concatenate([runs, [len(hashes)]])))
    distinct = np.bincount(of[order][runs], minlength=n)
    mark = np.isin(data, np.frombuffer(b"#*$%&|<>", dtype=np.uint8))
    shout = np.isin(data, np.frombuffer(b"!?", dtype=np.uint8))
    upper = (data >= 65) & (data <= 90)
    uppers, length = np.concatenate([[0], np.cumsum(upper)]), ends - starts
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    with np.errstate(divide="ignore"):
        columns = [
            bytes_in(upper), bytes_in((data >= 48) & (data <= 57)), bytes_in(mark), bytes_in(data == 124), bytes_in(shout), bytes_in(data == 46),
            bytes_in(data == 10), bytes_in(data >= 128), words_in(length) / 10, words_in(length > 20), words_in(before), distinct / np.maximum(words, 1),
            words_in(np.isin(last, np.frombuffer(b"#*$%&|<>", dtype=np.uint8))), np.log1p(words) / 10, np.log1p(size) / 10, words_in(length == 1), top / np.maximum(words, 1),
            words_in((uppers[ends] - uppers[starts] > 1) if len(ends) else np.zeros(0)),
        ]
    return np.stack(columns, axis=1)


def sliced_features(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`features` of a long column, by slices, so that memory follows the entries and not the bytes."""
    parts = [features(b.column(0), buckets) for b in slices([pa.RecordBatch.from_arrays([column], names=["text"])])]
    ends = np.cumsum([p[2][-1] for p in parts])
    first = np.concatenate([[0], *(p[2][1:] + e - p[2][-1] for p, e in zip(parts, ends))])
    bucket, share, stats = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 3))
    return bucket.astype(np.int32), share, first, stats


def features(batch: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, share of the text's words, first entry per text, statistics) of a column of texts."""
    data, rows = text_bytes(batch)
    starts, ends, first = word_bounds(data, rows)
    hashes = PrefixHash(data).of(starts, ends)
    stats = statistics(data, rows, starts, ends, first, hashes)
    of = np.repeat(np.arange(len(rows) - 1), np.diff(first))
    keys, counts = np.unique(of * np.int64(buckets) + (hashes % np.uint64(buckets)).astype(np.int64), return_counts=True)
    texts = keys // buckets
    share = counts / np.maximum(np.diff(first), 1)[texts] if len(texts) else np.zeros(0)
    return keys % buckets, share, np.searchsorted(texts, np.arange(len(rows))), stats


@dataclass
class Machine:
    """w0 + sum w_i x_i + pairs; the statistics follow the buckets as further inputs."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    centre: np.ndarray
    spread: np.ndarray

    def inputs(self, bucket: np.ndarray, share: np.ndarray, first: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(input, value, text) of all non-zero inputs."""
        n, width = stats.shape
        texts = np.concatenate([np.repeat(np.arange(n), np.diff(first)), np.repeat(np.arange(n), width)])
        which = np.concatenate([bucket, np.tile(np.arange(width), n) + len(self.weights) - width])
        scaled = np.clip((stats - self.centre) / self.spread, -4, 4)
        return which, np.concatenate([np.sqrt(share), scaled.ravel() / math.sqrt(width)]), texts

    def margin(self, which: np.ndarray, value: np.ndarray, texts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The machine's value per text, and the summed factors its gradient needs."""
        linear = np.bincount(texts, self.weights[which] * value, n)
        sums, squares = np.empty((n, self.factors.shape[1])), np.zeros(n)
        for k in range(self.factors.shape[1]):
            part = self.factors[which, k] * value
            sums[:, k] = np.bincount(texts, part, n)
            squares += np.bincount(texts, part * part, n)
        return self.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def scores(self, column: pa.Array) -> np.ndarray:
        buckets = len(self.weights) - len(STATISTICS)
        found = features(column, buckets)
        margin, _ = self.margin(*self.inputs(*found), len(column))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit(column: pa.Array, target: np.ndarray, settings: Settings) -> Machine:
    """Logistic loss, adaptive moments, in shuffled batches. No rows or one class: a constant machine."""
    rng = np.random.default_rng(settings.seed)
    width = settings.buckets + len(STATISTICS)
    machine = Machine(0.0, np.zeros(width), rng.normal(0, 0.05, (width, settings.rank)), np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    if len(target) == 0:
        return machine
    share = (target.sum() + 0.5) / (len(target) + 1)
    machine.bias = math.log(share / (1 - share))
    if target.min() == target.max():
        machine.factors[:] = 0
        return machine
    bucket, value, first, stats = sliced_features(column, settings.buckets)
    machine.centre, machine.spread = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-3)
    which, value, texts = machine.inputs(bucket, value, first, stats)
    order = np.argsort(texts, kind="stable")
    which, value, texts = which[order].astype(np.int32), value[order].astype(np.float32), texts[order].astype(np.int32)
    del bucket, first, stats, order
    bounds = np.searchsorted(texts, np.arange(len(target) + 1))
    theta = np.concatenate([machine.weights[:, None], machine.factors], axis=1)
    mean, var, step = np.zeros_like(theta), np.zeros_like(theta), 0
    for _ in range(settings.epochs):
        shuffled = rng.permutation(len(target))
        for at in range(0, len(target), settings.batch):
            rows = shuffled[at : at + settings.batch]
            size = bounds[rows + 1] - bounds[rows]
            pick = np.repeat(bounds[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            i, x, t = which[pick], value[pick], np.repeat(np.arange(len(rows)), size)
            machine.weights, machine.factors = theta[:, 0], theta[:, 1:]
            margin, sums = machine.margin(i, x, t, len(rows))
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target[rows]) / len(rows)
            grad = np.empty_like(theta)
            push = error[t] * x
            grad[:, 0] = np.bincount(i, push, width)
            for k in range(settings.rank):
                grad[:, 1 + k] = np.bincount(i, push * (sums[t, k] - theta[i, 1 + k] * x), width)
            grad += settings.decay * theta
            step += 1
            mean += 0.1 * (grad - mean)
            var += 0.01 * (grad * grad - var)
            theta -= settings.rate * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
            machine.bias -= settings.rate * float(error.sum())
    machine.weights, machine.factors = theta[:, 0].copy(), theta[:, 1:].copy()
    return machine


def held_out(id_column: str = "doc_id"):
    """Rows that are never learnt from: a fifth, by checksum of the id. A missing id is held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Machine:
    """The machine fitted on a bounded sample of labelled documents that are not held out.

    A document with several labels counts as good if any of them is 1. Null labels and labels
    without a document are ignored; documents that share an id are all used.
    """
    marked = labels.select("doc_id", "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out())
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("quality").alias("_good"))
    sample = marked.orderBy(F.xxhash64("_id"), "_id").limit(settings.sample_rows)
    # At most `sample_rows` pairs of numbers: a bounded side.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id").cast("long") == F.col("_id")).select("_id", F.xxhash64("text").alias("_hash"), F.col("text").cast("string").alias("text"), "_good")
    rows = rows.orderBy(F.xxhash64("_id"), "_id", "_hash").limit(settings.sample_rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        got = [b for b in batches if b.num_rows]
        texts = pa.concat_arrays([b.column(2).cast(pa.large_string()) for b in got]) if got else pa.array([], pa.large_string())
        target = np.concatenate([b.column(3).to_numpy(zero_copy_only=False) for b in got]).astype(np.float64) if got else np.zeros(0)
        parts = fit(texts, target, settings)
        state = pickle.dumps((parts.bias, parts.weights.astype(np.float32), parts.factors.astype(np.float32), parts.centre, parts.spread))
        yield pa.RecordBatch.from_arrays([pa.array([state], pa.binary())], names=["state"])

    import pickle

    fitted = rows.coalesce(1).mapInArrow(run, "state binary").collect()
    # A fixed number of weights, whatever the corpus.
    state = pickle.loads(bytes(fitted[0]["state"])) if fitted else None
    if state is None:
        return fit(pa.array([], pa.string()), np.zeros(0), settings)
    return Machine(state[0], state[1].astype(np.float64), state[2].astype(np.float64), state[3], state[4])


def score(docs: DataFrame, machine: Machine, columns: list[str], text_column: str = "text") -> DataFrame:
    """`columns` of `docs` and `score`, the likelihood of label 1. A null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    rows = docs.select(*columns, F.col(text_column).cast("string").alias("_scored_text"))
    kept = StructType([*docs.select(*columns).schema.fields, StructField("score", DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_scored_text"):
            found = pa.array(shared.value.scores(batch.column("_scored_text")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*batch.schema.names[:-1], "score"])

    return rows.mapInArrow(run, kept)


def good_documents(docs: DataFrame, machine: Machine, settings: Settings = Settings()) -> DataFrame:
    """`docs` without the documents that the machine rejects; all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array(shared.value.scores(batch.column(batch.schema.get_field_index("text"))) >= settings.threshold))

    return docs.mapInArrow(run, docs.schema)
