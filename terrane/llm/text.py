"""Helpers shared by the text operators: words as bytes, vectorised hashes, table readers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# A word is a run of characters outside space and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

# Texts are worked on in slices of about so many bytes, so that memory does not follow the batch.
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about SLICE_BYTES of text; a longer text stands alone."""
    for batch in batches:
        ends = np.cumsum(np.asarray(text_lengths(batch.column(column))))
        first = 0
        while first < batch.num_rows:
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + SLICE_BYTES, "right")))
            yield batch.slice(first, last - first)
            first = last


def text_lengths(column: pa.Array) -> np.ndarray:
    return np.diff(_layout(column)[1])


def _layout(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; a null is an empty text."""
    column = column.cast(pa.large_binary()) if column.null_count == 0 else column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows end to end, and where each row starts (one more entry for the end)."""
    return _layout(column)


def word_bounds(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each row) of all words; words never cross rows."""
    solid = ~_SPACE[data]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    inner = rows[1:-1]
    inner = inner[inner < len(data)]
    opens[inner] = solid[inner]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    before = inner[inner > 0] - 1
    closes[before] = solid[before]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, rows)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads differences to all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class PrefixHash:
    """Hash of any byte range in constant time, from prefix sums modulo 2**64.

    Equal ranges hash alike; different ranges may too, so users confirm equality on the bytes.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        powers = np.full(n + 1, _BASE, dtype=np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        self._sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=self._sums[1:])
        powers = np.full(n + 1, _INVERSE, dtype=np.uint64)
        powers[0] = 1
        self._shift = np.multiply.accumulate(powers)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self._sums[ends] - self._sums[starts]) * self._shift[starts])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, in about log2(width) passes."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out
