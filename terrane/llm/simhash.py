"""Near-duplicate groups by SimHash, with multi-index hashing to find close fingerprints.

Fingerprints of 64 bits are cut into two segments of 32. Two that differ in at most three bits
agree in one segment up to one bit. So every fingerprint is entered in a table under both
segment values and looks up the Hamming ball of radius one around them; what meets under a
value is verified over all 64 bits. A pair that differs in one bit of a segment is met from the
side that has this bit set, so only set bits need to be flipped and half the ball suffices.

Equal fingerprints are one node. Within a value, links are returned as a spanning forest, which
is linear in the number of fingerprints, and all links are joined to components.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.components import components
from terrane.session import Workspace

SHINGLE_WORDS = 3
DISTANCE = 3
SEED = 42

# A segment value under which more fingerprints than this are entered is looked up by (value,
# byte of the other segment): of four bytes that differ in at most three bits one is equal.
BUSY = 4096


def text_fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The fingerprint as an unsigned number; zero for a text without words."""
    import xxhash

    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = [e + i for i, e in enumerate(accumulate(map(len, tokens)))]
    span = min(words, len(tokens))
    starts = [0] + [e + 1 for e in ends[: len(tokens) - span]]
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    ones, n = np.zeros(64, dtype=np.int64), len(starts)
    for first in range(0, n, 1 << 16):
        some = zip(starts[first : first + (1 << 16)], ends[first + span - 1 : first + span - 1 + (1 << 16)])
        hashes = np.array([digest(view[a:b], SEED) for a, b in some], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text_hash, fingerprint: long) per row. A null text counts as empty.

    text_hash tells rows with a missing or repeated id apart.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([text_fingerprint(t.as_py()) for t in batch.column(2)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["doc_id", "text_hash", "fingerprint"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text_column).alias("text_hash"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fingerprint long")


def close_pairs(nodes: DataFrame, busy: int = BUSY) -> DataFrame:
    """Links (a, b) between distinct fingerprints that differ in at most DISTANCE bits.

    `nodes` has distinct, non-null fingerprints. The links have the same components as the set
    of all close pairs, and every link is a close pair.
    """
    x = F.col("fingerprint")
    low, high = x.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(x, 32)

    def ball(own: Column, other: Column, segment: int) -> Column:
        def entry(value: Column, entered: bool) -> Column:
            return F.struct((value + F.lit(segment << 32)).alias("key"), F.lit(entered).alias("entered"), other.alias("other"))

        bits = F.filter(F.array(*[F.lit(1 << j) for j in range(32)]), lambda b: own.bitwiseAND(b) != 0)
        return F.concat(F.array(entry(own, True)), F.transform(bits, lambda b: entry(own - b, False)))

    looked_up = nodes.select(x, F.explode(F.concat(ball(low, high, 0), ball(high, low, 1))).alias("at")).select("fingerprint", "at.*")
    entries = nodes.select(F.explode(F.array(low, high + F.lit(1 << 32))).alias("key"))
    hot = entries.groupBy("key").count().where(F.col("count") > busy).select("key", F.lit(True).alias("hot"))
    pieces = F.array(*[(F.shiftrightunsigned("other", 8 * k).bitwiseAND(F.lit(255)) + F.lit(256 * k)).cast("int") for k in range(4)])
    placed = looked_up.join(hot, "key", "left").select(
        "key", "fingerprint", "entered", F.explode(F.when(F.col("hot"), pieces).otherwise(F.array(F.lit(-1)))).alias("piece")
    )
    met = placed.repartition("key", "piece").sortWithinPartitions("key", "piece")
    return met.mapInArrow(_links, "a long, b long").distinct()


def _links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the runs of equal (key, piece); a run may go on in the next batch."""
    rest = np.zeros((4, 0), dtype=np.int64)

    def forest(part: np.ndarray) -> list[tuple[int, int]]:
        links: list[tuple[int, int]] = []
        edges = np.flatnonzero(np.any(np.diff(part[:2], axis=1) != 0, axis=0)) + 1
        bounds = np.concatenate([[0], edges, [part.shape[1]]])
        entered = np.add.reduceat(part[3], bounds[:-1]) if part.shape[1] else np.zeros(0)
        for k in np.flatnonzero((np.diff(bounds) > 1) & (entered > 0)) if part.shape[1] else ():
            links += _forest(np.unique(part[2, bounds[k] : bounds[k + 1]]))
        return links

    def table(links: list[tuple[int, int]]) -> pa.RecordBatch:
        pairs = np.array(links, dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        now = np.array([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "piece", "fingerprint", "entered")])
        rest = np.concatenate([rest, now], axis=1)
        if rest.shape[1] == 0:
            continue
        last = np.flatnonzero(np.any(rest[:2] != rest[:2, -1:], axis=0))
        cut = int(last[-1]) + 1 if len(last) else 0
        yield table(forest(rest[:, :cut]))
        rest = rest[:, cut:]
    yield table(forest(rest))


def _forest(values: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the close pairs among distinct values; memory stays linear."""
    left, links = values.view(np.uint64), []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = np.bitwise_count(left ^ x) <= DISTANCE
            if near.any():
                found = left[near]
                left = left[~near]
                frontier += list(found)
                links += [(int(np.int64(x.view(np.int64))), int(y)) for y in found.view(np.int64)]
    return links


def groups(docs: DataFrame, ws: Workspace, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text_hash, fingerprint, component_id, kept) per row of `docs`.

    component_id is the smallest doc_id among all documents reachable over links; it is null only
    if no document of the component has an id. `kept` marks the rows equal to the one
    representative (smallest id, then text hash; missing ids last). Repeated rows get a row each.
    An empty table gives an empty one.
    """
    prints = ws.save(fingerprints(docs, id_column, text_column), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_hash")
    nodes = ws.save(prints.groupBy("fingerprint").agg(F.min(order).alias("first")), "nodes")
    links = ws.save(close_pairs(nodes.select("fingerprint")), "links")
    stars = components(links, ws.child("components")).select(F.col("node").alias("fingerprint"), "root")
    joined = nodes.join(stars, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    firsts = joined.groupBy("root").agg(F.min("first").alias("group_first"))
    lookup = joined.join(firsts, "root").select("fingerprint", "group_first")
    known = prints.join(lookup, "fingerprint")
    return known.select("doc_id", "text_hash", "fingerprint", F.col("group_first.doc_id").alias("component_id"), (order == F.col("group_first")).alias("kept"))


def hexadecimal(fingerprint: str | Column = "fingerprint") -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def one_of_each(docs: DataFrame, ws: Workspace, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`docs` with one row of each group: its representative, once even if the row is repeated."""
    return representatives(docs, groups(docs, ws, id_column, text_column), id_column, text_column)


def representatives(docs: DataFrame, grouped: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of `docs` that `grouped` (doc_id, text_hash, kept) keeps, each once."""
    keep = grouped.where("kept")
    keep = keep.select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), F.col("text_hash").alias("_hash")).distinct()
    own_id = F.col(id_column).cast("long")
    # The row travels as one struct, so that its column names meet no others.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(own_id, F.lit(0)).alias("_id"), own_id.isNull().alias("_none"), F.xxhash64(text_column).alias("_hash"))
    # Plain keys on both sides: the rows that the join has brought together are not dealt out again.
    return rows.join(keep, ["_id", "_none", "_hash"], "left_semi").dropDuplicates(["_id", "_none", "_hash"]).select("row.*")
