"""Near copies: a similarity of 0.8 over five-word shingles, by wide SimHash fingerprints.

At that similarity 64 bits over shingles differ in about ten, too many for small Hamming balls.
So a text gets two fingerprints. One of 256 bits over its distinct words, which an edited word
moves little, is cut into eight segments of 32 bits; tables under the segment values are looked
up with the Hamming balls of radius one (multi-index hashing as in `simhash`, half the ball from
either side). What meets under a value is verified over the complete distance of the other, 1024
bits over the distinct shingles. Shingle sets with Jaccard similarity 0.8 have a cosine of 8/9,
so 155 of these bits differ on average, with a deviation of 11.5; `DISTANCE` is 1.5 of these
more, so links are certain well above 0.8 and fade out towards 0.7.

Equal fingerprints are one node, and links of a value are returned as a spanning forest, linear
in its nodes. A value with more than `BUSY` nodes is walked in chunks of about so many, dealt by
hash. Each chunk's groups go on as a root and its reach, the distance of the farthest member; the
roots meet in pairs of blocks of about `BUSY`. Two groups whose roots do not link can only have a
link between other members if the roots are within `DISTANCE` and both reaches of each other (the
distance is a metric), so only such groups are compared member by member. No link is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.components import components
from terrane.llm.simhash import representatives
from terrane.llm.text import PrefixHash, mixed, slices, text_bytes, word_bounds
from terrane.session import Workspace

SHINGLE_WORDS = 5
SEGMENTS = 8
SHINGLE_BITS = 1024
DISTANCE = 172
BUSY = 4096
BATCH_ROWS = 10_000  # of output

_ODD = np.uint64(0xC2B2AE3D27D4EB4F)


def _majority(hashes: np.ndarray, bits: int) -> bytes:
    """The bits set in over half of the hashes, each spread to `bits` bits; zeros for no hash."""
    ones = np.zeros(bits, dtype=np.int64)
    steps = np.arange(1, bits // 64 + 1, dtype=np.uint64) * _ODD
    for first in range(0, len(hashes), 255):  # a byte counts to 255
        spread = mixed(hashes[first : first + 255, None] + steps)
        ones += np.unpackbits(spread.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def _shingles(words: np.ndarray) -> np.ndarray:
    """A hash for each run of SHINGLE_WORDS words; of all words where there are fewer."""
    width = min(SHINGLE_WORDS, len(words))
    if width == 0:
        return words
    runs = len(words) - width + 1
    out = words[:runs]
    for k in range(1, width):
        out = mixed(out * _ODD + words[k : k + runs])
    return out


def prints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text_hash, node, words: binary, shingles: binary) per row.

    A-Z are folded; a null text counts as empty, and a text without words has zeros. `node` is a
    hash of both fingerprints. text_hash tells rows with a missing or repeated id apart.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, rows = text_bytes(batch.column(2))
            data = data + 32 * ((data >= 65) & (data <= 90)).astype(np.uint8)
            starts, ends, first = word_bounds(data, rows)
            hashes = PrefixHash(data).of(starts, ends)
            own = [hashes[a:b] for a, b in zip(first[:-1], first[1:])]
            words = [_majority(np.unique(w), 32 * SEGMENTS) for w in own]
            shingles = [_majority(np.unique(_shingles(w)), SHINGLE_BITS) for w in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.binary()), pa.array(shingles, pa.binary())], names=["doc_id", "text_hash", "words", "shingles"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text_column).alias("text_hash"), F.col(text_column).cast("string").alias("text"))
    found = rows.mapInArrow(run, "doc_id long, text_hash long, words binary, shingles binary")
    return found.withColumn("node", F.xxhash64("words", "shingles"))


def _balls(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, entered): each segment's value, and those with one set bit less."""
    for batch in batches:
        nodes = batch.column(0).to_numpy()
        values = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u4").reshape(-1, SEGMENTS).astype(np.int64)
        keys = values + (np.arange(SEGMENTS, dtype=np.int64) << 32)
        for j in range(-1, 32):
            bit = 0 if j < 0 else 1 << j
            row, segment = np.nonzero((values & bit) == bit)
            yield pa.RecordBatch.from_arrays([pa.array(keys[row, segment] - bit), pa.array(nodes[row]), pa.array(np.full(len(row), j < 0))], names=["key", "node", "entered"])


def _meeting(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node) of the keys with several nodes, one of them entered; entered ones come first.

    Only the first row of the key that goes on is held, so a key may have any number of rows.
    """
    held, given = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)], False
    for batch in batches:
        if batch.num_rows == 0:
            continue
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        key, node, entered = (np.concatenate([h, n]) for h, n in zip(held, now))
        starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
        sizes = np.diff(np.append(starts, len(key)))
        good = entered[starts] & (sizes > 1)
        take = np.repeat(good, sizes)
        take[0] &= not given
        last = starts[-1]
        given = bool(good[-1]) or (given and last == 0)
        held = [c[last : last + 1] for c in (key, node, entered)]
        yield pa.RecordBatch.from_arrays([pa.array(key[take]), pa.array(node[take])], names=["key", "node"])


Rows = list[np.ndarray]  # columns


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[Rows]:
    """The columns of each run of equal first three columns, whole; the last column as rows of 64-bit words."""
    rest: Rows = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        now = [batch.column(i).to_numpy() for i in range(batch.num_columns - 1)]
        now.append(np.frombuffer(b"".join(batch.column(batch.num_columns - 1).to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1))
        rest = [np.concatenate([r, n]) for r, n in zip(rest, now)] if rest else now
        edges = np.flatnonzero((np.diff(rest[0]) != 0) | (np.diff(rest[1]) != 0) | (np.diff(rest[2]) != 0)) + 1
        for lo, hi in zip(np.append(0, edges), edges):
            yield [c[lo:hi] for c in rest]
        rest = [c[edges[-1] if len(edges) else 0 :] for c in rest]
    if rest:
        yield rest


def _apart(bits: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits ^ one).sum(axis=1, dtype=np.int64)


def _forest(bits: np.ndarray, seen: Callable[[int, np.ndarray, np.ndarray], None] = lambda x, left, d: None) -> tuple[np.ndarray, np.ndarray]:
    """(parent, root) of each row in a spanning forest of the links; a root is its own parent.

    `seen` gets each row's distances to all that are not yet reached, so every two rows of different trees once.
    """
    parent, root = np.arange(len(bits)), np.arange(len(bits))
    left = np.arange(len(bits))
    while len(left):
        first, left = left[0], left[1:]
        frontier = [first]
        while frontier and len(left):
            x = frontier.pop()
            d = _apart(bits[left], bits[x])
            found, left, d = left[d <= DISTANCE], left[d > DISTANCE], d[d > DISTANCE]
            parent[found], root[found] = x, first
            frontier += list(found)
            seen(x, left, d)
    return parent, root


TREES = "key long, chunk long, tree long, a long, b long, reach long"


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the runs of equal (key, chunk): each node b with its tree's root and the node a that it links to.

    A root has no a, but its reach (0 where its key has one chunk only, so that nobody asks).
    """
    held: list[Rows] = []

    def batch() -> pa.RecordBatch:
        key, chunk, tree, a, b, reach = (np.concatenate(c) for c in zip(*held))
        held.clear()
        own = reach >= 0
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(chunk), pa.array(tree), pa.array(a, mask=own), pa.array(b), pa.array(reach, mask=~own)], names=["key", "chunk", "tree", "a", "b", "reach"])

    size = 0
    for key, chunks, chunk, node, bits in _runs(batches):
        parent, root = _forest(bits)
        reach = np.where(parent == np.arange(len(node)), 0, -1)
        if chunks[0] > 1:
            np.maximum.at(reach, root, np.bitwise_count(bits ^ bits[root]).sum(axis=1, dtype=np.int64))
            reach[parent != np.arange(len(node))] = -1
        held.append([key, chunk, node[root], node[parent], node, reach])
        size += len(node)
        if size >= BATCH_ROWS:
            yield batch()
            size = 0
    if held:
        yield batch()


def _roots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, a, b, linked) of the trees' roots: links as a spanning forest, and those of other trees and
    chunks that links between other members could join."""
    for key, _, _, chunk, node, reach, bits in _runs(batches):
        near: list[tuple[int, np.ndarray]] = []

        def seen(x: int, left: np.ndarray, d: np.ndarray) -> None:
            near.append((x, left[(d <= DISTANCE + reach[x] + reach[left]) & (chunk[left] != chunk[x])]))

        parent, root = _forest(bits, seen)
        own = np.flatnonzero(parent != np.arange(len(node)))
        yield pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(node[parent[own]]), pa.array(node[own]), pa.array(np.ones(len(own), bool))], names=["key", "a", "b", "linked"])
        for x, others in near:
            others = others[root[others] != root[x]]
            if len(others):
                a, b = np.minimum(node[others], node[x]), np.maximum(node[others], node[x])
                yield pa.RecordBatch.from_arrays([pa.array(key[others]), pa.array(a), pa.array(b), pa.array(np.zeros(len(others), bool))], names=["key", "a", "b", "linked"])


def _between(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One link (a, b) of each pair of trees that has any; a run holds the members of both trees."""
    for _, _, _, side, node, bits in _runs(batches):
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        for x in left:
            at = np.flatnonzero(_apart(bits[right], bits[x]) <= DISTANCE)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(node[[x]]), pa.array(node[right[at[:1]]])], names=["a", "b"])
                break


def close_pairs(nodes: DataFrame, ws: Workspace, busy: int = BUSY) -> DataFrame:
    """Links (a, b) between distinct nodes (node, words, shingles) whose shingles are at most DISTANCE apart.

    Nodes under a common value are linked, over others or directly, if and only if all pairs compared would link them.
    """
    balls = nodes.select("node", "words").mapInArrow(_balls, "key long, node long, entered boolean")
    met = ws.save(balls.repartition("key").sortWithinPartitions("key", F.desc("entered")).mapInArrow(_meeting, "key long, node long"), "met")
    shingles = nodes.select("node", "shingles")

    def runs(rows: DataFrame, *columns: str) -> DataFrame:
        return rows.repartition(*columns).sortWithinPartitions(*columns)

    def walked(rows: DataFrame) -> DataFrame:
        dealt = rows.select("key", "chunks", F.pmod(F.xxhash64("node", "key"), "chunks").alias("chunk"), "node").join(shingles, "node")
        return runs(dealt.select("key", "chunks", "chunk", "node", "shingles"), "key", "chunks", "chunk").mapInArrow(_walk, TREES)

    def busy_keys(rows: DataFrame, name: str) -> DataFrame:
        return ws.save(rows.groupBy("key").count().where(F.col("count") > busy).select("key", F.ceil(F.col("count") / busy).alias("chunks")), name)

    one = F.lit(1).cast("long").alias("chunks")
    hot = busy_keys(met, "hot")
    whole = walked(met.join(hot, "key", "left_anti").select("key", one, "node"))
    trees = ws.save(walked(met.join(hot, "key")), "trees")

    # The roots of a key meet at once, or in all pairs of its blocks if they are too many.
    roots = trees.where("a IS NULL").select("key", "chunk", F.col("b").alias("node"), "reach")
    many = busy_keys(roots, "many")
    together = roots.join(many, "key", "left_anti").withColumns({"first": F.lit(0).cast("long"), "second": F.lit(0).cast("long")})
    blocks = roots.join(many, "key").withColumn("block", F.pmod(F.xxhash64("node", "key", F.lit(1)), "chunks"))
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).where("block <> other")
    blocks = blocks.withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")}).select(*together.columns)
    paired = together.unionByName(blocks).join(shingles, "node").select("key", "first", "second", "chunk", "node", "reach", "shingles")
    met_roots = ws.save(runs(paired, "key", "first", "second").mapInArrow(_roots, "key long, a long, b long, linked boolean"), "roots")

    # Members of the trees whose roots do not link.
    open_pairs = met_roots.where("NOT linked").select("key", "a", "b").distinct()
    members = trees.select("key", "tree", F.col("b").alias("node"))
    sides = open_pairs.select("key", "a", "b", F.posexplode(F.array("a", "b")).alias("side", "tree"))
    sides = sides.join(members, ["key", "tree"]).join(shingles, "node").select("key", "a", "b", F.col("side").cast("long").alias("side"), "node", "shingles")
    between = runs(sides, "key", "a", "b").mapInArrow(_between, "a long, b long")
    linked = whole.unionAll(trees).where("a IS NOT NULL").select("a", "b").unionAll(met_roots.where("linked").select("a", "b")).unionAll(between)
    return linked.distinct()


def groups(docs: DataFrame, ws: Workspace, id_column: str = "doc_id", text_column: str = "text", busy: int = BUSY) -> DataFrame:
    """(doc_id, text_hash, node, component_id, kept) per row of `docs`.

    component_id is the smallest doc_id among the documents reachable over links, null only if
    none of them has an id. `kept` marks the rows equal to the one representative (smallest id,
    then text hash; missing ids last). Repeated rows get a row each; texts without words are one
    group. An empty table gives an empty one.
    """
    rows = ws.save(prints(docs, id_column, text_column), "prints")
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_hash")
    nodes = ws.save(rows.groupBy("node").agg(F.min(order).alias("first"), F.first("words").alias("words"), F.first("shingles").alias("shingles")), "nodes")
    links = ws.save(close_pairs(nodes, ws, busy), "links")
    stars = components(links, ws.child("components"))
    joined = nodes.select("node", "first").join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = joined.groupBy("root").agg(F.min("first").alias("group_first"))
    lookup = joined.join(firsts, "root").select("node", "group_first")
    known = rows.select("doc_id", "text_hash", "node").join(lookup, "node")
    return known.select("doc_id", "text_hash", "node", F.col("group_first.doc_id").alias("component_id"), (order == F.col("group_first")).alias("kept"))


def one_of_each(docs: DataFrame, ws: Workspace, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`docs` with one row of each group: its representative, once even if the row is repeated."""
    return representatives(docs, groups(docs, ws, id_column, text_column), id_column, text_column)
