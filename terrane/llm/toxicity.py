"""Toxicity of a text by a linear classifier over character n-grams.

A feature is the presence of a run of `sizes` characters, A-Z folded and white space alike. Its
value is the naive Bayes log-count ratio: the logarithm of how much more often toxic documents
hold it than others, with pseudo-counts in the proportion of the classes, so that an unseen
n-gram has 0. A logistic regression learns on top how far each ratio is to be trusted.

1. A bounded sample of the labelled documents that are not held out is stored (`sample_rows`).
2. Its documents that hold each n-gram are counted per class, combined within a task before the shuffle.
3. N-grams whose ratio is `least_z` standard errors from 0 are features, at most `features`.
4. The weights are fitted on the sample, in one task.
5. Every text is scored in whole. A small table of bits sorts out most of its n-grams before the
   features are searched.

Features are told apart by a hash of 52 bits of their bytes. Presence does not grow with length, so a
long clean text collects nothing from its length alone.
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

from terrane.llm.fm import held_out
from terrane.llm.text import PrefixHash, slices, text_bytes
from terrane.session import Workspace


@dataclass(frozen=True)
class Settings:
    sizes: tuple[int, ...] = (3, 4, 5)
    least_z: float = 4.0
    features: int = 1 << 12  # of the model, those furthest from 0 first
    sample_rows: int = 6000  # labelled documents used for fitting, smallest hashes of the id first
    pseudo: float = 1.0
    rounds: int = 80
    rate: float = 0.05
    decay: float = 1e-3
    threshold: float = 0.5


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32

_BITS = 22  # of the table that sorts out n-grams
ROWS = 1 << 12  # texts counted at a time; hashes leave so many low bits free


def grams(column: pa.Array, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, hash) of every character n-gram, one size after the other; n-grams never cross texts."""
    data, rows = text_bytes(column)
    folded = _FOLD[data]
    starts = np.flatnonzero((folded & 0xC0) != 0x80)
    first = np.searchsorted(starts, rows)
    per_row = np.diff(first)
    row = np.repeat(np.arange(len(per_row)), per_row)
    last = first[1:][row]
    bounds = np.append(starts, len(folded))
    prefix = PrefixHash(folded)
    for size in sizes:
        at = np.flatnonzero(np.arange(len(starts)) + size <= last)
        yield row[at], prefix.of(bounds[at], bounds[at + size]) & ~np.uint64(ROWS - 1)


def _presence(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (text, key) once, sorted by key; texts are numbered below ROWS, so one sort of numbers does."""
    both = np.sort(key | text.astype(np.uint64))
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    low = np.uint64(ROWS - 1)
    return (both & low).astype(np.int64), both & ~low


@dataclass
class Classifier:
    """`keys` are sorted hashes of n-grams; a text's margin is the bias and the weights of those it holds."""

    sizes: tuple[int, ...]
    keys: np.ndarray
    ratios: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.ratios = self.ratios.astype(np.float64)
        self.table = np.zeros(1 << _BITS, dtype=bool)
        self.table[(self.keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def present(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) for every feature a text holds, each once."""
        texts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for text, key in grams(column, self.sizes) if len(self.keys) else ():
            maybe = np.flatnonzero(self.table[(key >> np.uint64(64 - _BITS)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, key[maybe]), len(self.keys) - 1)
            hit = self.keys[at] == key[maybe]
            pairs = np.unique(text[maybe][hit] * np.int64(len(self.keys)) + at[hit])
            texts.append(pairs // max(len(self.keys), 1))
            found.append(pairs % max(len(self.keys), 1))
        return np.concatenate(texts), np.concatenate(found)

    def scores(self, column: pa.Array) -> np.ndarray:
        text, feature = self.present(column)
        margin = self.bias + np.bincount(text, self.ratios[feature] * self.weights[feature], len(column))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def marked(labels: DataFrame) -> DataFrame:
    """(_id, _toxic) of the labelled documents that may be learnt from; of several labels the greatest counts."""
    rows = labels.select("doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out())
    return rows.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("_toxic"))


def sampled(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """(_id, text, _toxic) of at most `sample_rows` documents that may be learnt from."""
    sample = marked(labels).orderBy(F.xxhash64("_id"), "_id").limit(settings.sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # At most `sample_rows` pairs of numbers: a bounded side, so that no other text is moved.
    rows = texts.join(F.broadcast(sample), "_id")
    rows = rows.orderBy(F.xxhash64("_id"), "_id", F.xxhash64("text")).limit(settings.sample_rows)
    return rows.repartition("_id")


def counted(sample: DataFrame, settings: Settings) -> DataFrame:
    """(key, toxic, other): documents of each class that hold an n-gram; key null: all documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> pa.RecordBatch:
            key = np.concatenate([h[0] for h in held])
            order = np.argsort(key, kind="stable")
            heads = np.flatnonzero(np.concatenate([[True], np.diff(key[order].view(np.int64)) != 0])) if len(key) else np.zeros(0, np.int64)
            sums = [np.add.reduceat(np.concatenate([h[i] for h in held])[order], heads) if len(heads) else np.zeros(0, np.int64) for i in (1, 2)]
            held[:] = [(key[order][heads], *sums)]
            return pa.RecordBatch.from_arrays([pa.array(key[order][heads].view(np.int64)), pa.array(sums[0]), pa.array(sums[1])], names=["key", "toxic", "other"])

        for batch in (b.slice(at, ROWS) for b in slices(batches) for at in range(0, b.num_rows, ROWS)):
            mark = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([int(mark.sum())]), pa.array([int(len(mark) - mark.sum())])], names=["key", "toxic", "other"])
            for text, key in grams(batch.column(0), settings.sizes):
                text, key = _presence(text, key)
                heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                toxic = np.add.reduceat(mark[text], heads) if len(heads) else np.zeros(0, np.int64)
                held.append((key[heads], toxic, np.diff(np.append(heads, len(key))) - toxic))
                size += len(heads)
            # Counts are combined within the task; a table that stays large is passed on.
            if size > 1 << 21:
                whole = merged()
                size = whole.num_rows
                if size > 1 << 20:
                    yield whole
                    held.clear()
                    size = 0
        if held:
            yield merged()

    sums = sample.select("text", "_toxic").mapInArrow(run, "key long, toxic long, other long")
    return sums.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def ratios(counts: DataFrame, settings: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """(keys, log-count ratios, log odds of a toxic document) of the features: at most `settings.features` rows are collected."""
    whole = counts.where("key IS NULL").first()
    toxic, other = (whole["toxic"] or 0, whole["other"] or 0) if whole else (0, 0)
    if not toxic or not other:
        return np.zeros(0, np.uint64), np.zeros(0), math.log((toxic + 0.5) / (other + 0.5))
    a = settings.pseudo * toxic / (toxic + other)
    b = settings.pseudo * other / (toxic + other)
    have, lack = F.col("toxic") + F.lit(a), F.col("other") + F.lit(b)
    ratio = F.log(have / lack) - F.lit(math.log(toxic / other))
    z = F.abs(ratio) / F.sqrt(1 / have + 1 / lack)
    # Where one class lacks an n-gram its error is that of a count of one.
    error = F.sqrt(1 / F.greatest(F.col("toxic"), F.lit(1)) + 1 / F.greatest(F.col("other"), F.lit(1)))
    z = F.greatest(z, F.abs(ratio) / error)
    rows = counts.where("key IS NOT NULL").select("key", ratio.alias("ratio"), z.alias("z")).where(F.col("z") >= settings.least_z)
    rows = rows.orderBy(F.desc("z"), "key").limit(settings.features).toPandas()
    keys = rows["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], rows["ratio"].to_numpy(float)[order], math.log(toxic / other)


def fit(column: pa.Array, target: np.ndarray, start: Classifier, settings: Settings) -> Classifier:
    """Logistic loss with weight decay, whole-sample gradient steps with adaptive moments, from naive Bayes on."""
    if not len(target) or not len(start.keys) or target.min() == target.max():
        return start
    text, feature = [], []
    done = 0
    for part in slices([pa.RecordBatch.from_arrays([column], names=["text"])]):
        t, f = start.present(part.column(0))
        text.append(t + done)
        feature.append(f)
        done += part.num_rows
    text, feature = np.concatenate(text), np.concatenate(feature)
    value = start.ratios[feature]
    theta = np.append(start.weights, start.bias)
    mean, var = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, settings.rounds + 1):
        margin = theta[-1] + np.bincount(text, theta[feature] * value, len(target))
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target) / len(target)
        grad = np.append(np.bincount(feature, error[text] * value, len(theta) - 1) + settings.decay * theta[:-1], error.sum())
        mean += 0.1 * (grad - mean)
        var += 0.01 * (grad * grad - var)
        theta = theta - settings.rate * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-9)
    return Classifier(start.sizes, start.keys, start.ratios, theta[:-1], float(theta[-1]))


def train(docs: DataFrame, labels: DataFrame, ws: Workspace, settings: Settings = Settings()) -> Classifier:
    """The classifier fitted on a bounded sample of labelled documents that are not held out.

    A document with several labels is toxic if any of them is 1. Null labels, and labels without
    a document, are ignored; a null text is empty; documents that share an id, and repeated rows,
    are all used. Without labels, or with one class only, every text gets the same score. Other
    columns, whatever their names, are never read.
    """
    sample = ws.save(sampled(docs, labels, settings), "sample")
    counts = ws.save(counted(sample, settings), "counts")
    keys, ratio, odds = ratios(counts, settings)
    start = Classifier(settings.sizes, keys, ratio, np.full(len(keys), 1.0 / max(1, len(keys)) ** 0.5), odds)
    shared = docs.sparkSession.sparkContext.broadcast(start)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        texts = pa.concat_arrays([b.column(1).cast(pa.large_string()) for b in got]) if got else pa.array([], pa.large_string())
        target = np.concatenate([b.column(2).to_numpy(zero_copy_only=False) for b in got]).astype(np.float64) if got else np.zeros(0)
        fitted = fit(texts, target, shared.value, settings)
        yield pa.RecordBatch.from_arrays([pa.array([fitted.weights.tolist()], pa.list_(pa.float64())), pa.array([fitted.bias])], names=["weights", "bias"])

    # A bounded number of weights, whatever the corpus.
    fitted = sample.coalesce(1).sortWithinPartitions("_id", "text").mapInArrow(run, "weights array<double>, bias double").first()
    if fitted is None:
        return start
    return Classifier(settings.sizes, keys, ratio, np.array(fitted["weights"], dtype=float), fitted["bias"])


def score(docs: DataFrame, classifier: Classifier, columns: list[str], text_column: str = "text") -> DataFrame:
    """`columns` of `docs` and `score`, the likelihood of a toxic text, for every row.

    A null text is scored as an empty one, which holds no n-gram. Repeated rows get equal scores;
    an empty table gives an empty one. `columns` must not name `score`; the text travels under a
    name of its own, so that other columns never clash with it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    rows = docs.select(*columns, F.col(text_column).cast("string").alias("_scored_text"))
    kept = StructType([*docs.select(*columns).schema.fields, StructField("score", DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_scored_text"):
            found = pa.array(shared.value.scores(batch.column("_scored_text")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*batch.schema.names[:-1], "score"])

    return rows.mapInArrow(run, kept)
