"""Spelling variants: words that differ by one inserted, deleted or replaced character, and their usual form.

A forward trie has a node for every beginning of a word, a reversed trie for every ending. With all nodes
numbered, a word with the character at place i left out is the pair (node of what comes before,
node of what comes after), and a word with a gap at place i the pair around the gap. Two words
differ by a replaced character where they share a left-out pair, and by an inserted one where a
left-out pair of the longer is a gap pair of the shorter. The numbers are exact, so no words are
compared. At most one word has a given gap pair, and words with one left-out pair differ in that one
character, so a group is never larger than the alphabet, however frequent its words are.

Numbering: words are sorted over range partitions, where the words of a node are neighbours. A
partition numbers its own nodes in one walk. Only nodes on the way to the last word of a partition
can go on in the next one; they are numbered once, from the partitions' last words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.text import slices
from terrane.session import Workspace

LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LENGTH = 6
LEAST_COUNT = 5
FACTOR = 5  # how much more frequent the usual form is
MISSPELT = 199  # one occurrence of so many, by its checksum, loses a character; 0: none

HELD_WORDS = 1 << 18  # distinct words a task counts before it passes the counts on
OWN = 40  # bits of a number below the partition's

GAP, SKIP, SKIP_FIRST = 0, 1, 2


def folded(run: str) -> str:
    """Only A-Z in lower case."""
    return run.lower() if run.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), run)


def written(run: str, start: int, misspelt: int) -> str:
    """A folded run as it counts: without one character if `misspelt` divides its checksum, started from `start`."""
    h = zlib.crc32(run.encode(), start) if misspelt else 0
    if misspelt and h % misspelt == 0:
        at = h % len(run)
        return run[:at] + run[at + 1 :]
    return run


def counted_words(docs: DataFrame, misspelt: int = MISSPELT, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, held: int = HELD_WORDS) -> DataFrame:
    """(word, n): words of the whole texts with at least `least_length` characters and `least_count` occurrences.

    Words are maximal runs of LETTERS, folded. The checksum is that of `<doc_id>:<run>`; a missing id is
    written as nothing. A null text has no words; every repeated row counts. Each task sums its
    words before they are shuffled, so a frequent word is one row a task.
    """
    pattern = re.compile(f"[{LETTERS}]{{{least_length},}}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def passed_on() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return found

        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for raw, n in Counter(pattern.findall(text.as_py())).items():
                    word = written(folded(raw), start, misspelt)
                    if len(word) >= least_length:
                        counts[word] += n
                if len(counts) >= held:
                    yield passed_on()
        yield passed_on()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sums = texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return sums.where(F.col("n") >= least_count)


def shared_length(a: str, b: str) -> int:
    """Characters of the common beginning."""
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def boundary_nodes(lasts: list[str]) -> list[list[int]]:
    """Numbers of all beginnings of each partition's last word, in order of partitions; equal beginnings have one number."""
    found: list[list[int]] = []
    count = 1  # 0 is the root
    for i, word in enumerate(lasts):
        same = shared_length(lasts[i - 1], word) if i else 0
        nodes = (found[-1][: same + 1] if i else [0]) + list(range(count, count + len(word) - same))
        count += len(word) - same
        found.append(nodes)
    return found


def trie_nodes(words: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """`words` (word, n; distinct) with `id`, in the order of the words, and `nodes`: the number of each beginning, the empty one first."""

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, before, count, row = [0], "", 1, 0
        for batch in batches:
            nodes, ids = [], []
            for word in batch.column(0).to_pylist():
                same = shared_length(before, word)
                path = path[: same + 1] + list(range(count, count + len(word) - same))
                count += len(word) - same
                nodes.append(path)
                ids.append(row)
                before, row = word, row + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64()), pa.array(nodes, pa.list_(pa.int64()))], names=["word", "n", "part", "row", "own"])

    # No number is given: adaptive execution may join small partitions, in their order, before the sort.
    ordered = words.select("word", "n").repartitionByRange("word").sortWithinPartitions("word").withColumn("part", F.spark_partition_id())
    walked = ws.save(ordered.mapInArrow(walk, "word string, n long, part int, row long, own array<bigint>"), f"{name}-walked")
    # One word a partition.
    last = {r["part"]: r["word"] for r in walked.groupBy("part").agg(F.max("word").alias("word")).collect()}
    parts = sorted(last)
    numbers = dict(zip(parts, boundary_nodes([last[p] for p in parts])))
    ends = {p: ((last[p], numbers[p]), (last[q], numbers[q]) if q is not None else None) for p, q in zip(parts, [None, *parts])}
    shared = words.sparkSession.sparkContext.broadcast(ends)

    def numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for word, part, own in zip(*(batch.column(c).to_pylist() for c in ("word", "part", "own"))):
                nodes = [((part + 1) << OWN) + x for x in own]
                for end in shared.value[part]:
                    if end is not None:
                        same = shared_length(word, end[0]) + 1
                        nodes[:same] = end[1][:same]
                out.append(nodes)
            ids = [((part + 1) << OWN) + row for part, row in zip(*(batch.column(c).to_pylist() for c in ("part", "row")))]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["word", "n", "id", "nodes"])

    return walked.mapInArrow(numbered, "word string, n long, id long, nodes array<bigint>")


def node_pairs(words: DataFrame) -> DataFrame:
    """(p, s, kind, n, id): the left-out and the gap pairs of every word (word, n, id, nodes, back).

    Of equal characters in a row, leaving out any gives the same word; SKIP_FIRST marks the first.
    """
    length, letters = F.size("nodes") - 1, F.split("word", "")
    nodes, back = F.col("nodes"), F.col("back")

    def pair(i, after, kind):
        return F.struct(F.get(nodes, i).alias("p"), F.get(back, after).alias("s"), kind.cast("byte").alias("kind"))

    skips = F.transform(
        F.filter(F.sequence(F.lit(0), length), lambda i: i < length),  # none for the empty word
        lambda i: pair(i, length - 1 - i, F.when((i == 0) | (F.get(letters, i) != F.get(letters, i - 1)), F.lit(SKIP_FIRST)).otherwise(F.lit(SKIP))),
    )
    gaps = F.transform(F.sequence(F.lit(0), length), lambda i: pair(i, length - i, F.lit(GAP)))
    return words.select("n", "id", F.explode(F.concat(skips, gaps)).alias("at")).select("at.*", "n", "id")


def _met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (p, s, n descending, id) to (id, near, best_n, best): near words in the group and the most frequent that may be a usual form.

    A word that is itself the most frequent of a left-out group needs none of it as a usual form.
    """
    names = ("p", "s", "kind", "n", "id")
    rest = np.zeros((5, 0), dtype=np.int64)

    def solve(part: np.ndarray) -> pa.RecordBatch:
        p, s, kind, n, word = part
        heads = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1])])) if len(p) else np.zeros(0, np.int64)
        size = np.diff(np.append(heads, len(p)))
        keep = np.repeat(size > 1, size)
        kind, n, word, size = kind[keep], n[keep], word[keep], size[size > 1]
        if not len(size):
            return table(*[np.zeros(0, np.int64)] * 4)
        heads = np.cumsum(size) - size
        here, none = np.arange(len(kind)), len(kind)
        group = np.repeat(np.arange(len(size)), size)
        skips, firsts = (np.add.reduceat((kind >= least).astype(np.int64), heads)[group] for least in (SKIP, SKIP_FIRST))
        top, top_first, gap = (np.minimum.reduceat(np.where(which, here, none), heads)[group] for which in (kind >= SKIP, kind == SKIP_FIRST, kind == GAP))
        is_gap, has_gap = kind == GAP, gap < none
        joined = (kind == SKIP_FIRST) & has_gap
        near = np.where(is_gap, firsts, skips - 1 + joined)
        n_of, word_of = np.append(n, -1), np.append(word, -1)
        best = np.where(is_gap, top_first, np.where(top == here, none, top))
        other = np.where(joined, gap, none)
        better = (n_of[other] > n_of[best]) | ((n_of[other] == n_of[best]) & (word_of[other] < word_of[best]))
        best = np.where(better, other, best)
        some = near > 0
        return table(word[some], near[some], n_of[best][some], word_of[best][some])

    def table(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "near", "best_n", "best"])

    for batch in batches:
        now = np.array([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in names])
        rest = np.concatenate([rest, now], axis=1)
        if rest.shape[1] == 0:
            continue
        other = np.flatnonzero((rest[0] != rest[0, -1]) | (rest[1] != rest[1, -1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        yield solve(rest[:, :cut])
        rest = rest[:, cut:]
    yield solve(rest)


def roots(links: DataFrame, ws: Workspace) -> DataFrame:
    """(id, root): where the links (id, to) of each id end. Every round doubles the steps taken; links have no cycles."""
    now = ws.save(links.select("id", F.col("to").alias("root")), "roots-0")
    turn = 0
    while True:
        onward = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = now.join(onward, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        turn += 1
        moved = ws.save(moved, f"roots-{turn}")
        now = moved.select("id", "root")
        if moved.where("moved").isEmpty():
            return now


def variants(words: DataFrame, ws: Workspace, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per distinct word of `words` (word, n).

    n_near counts the words at distance one. form is the most frequent of them, ties to the smallest
    by code points, if it is at least `factor` (2 or more) times as frequent as the word, else null. root is
    where following forms ends, the word itself if it has none. Counts of a repeated word are
    added up; null words and words without a positive count are left out. Long words cost as many rows as they have
    characters. Other columns are not read; an empty table gives an empty one.
    """
    if factor < 2:
        raise ValueError("a usual form is at least twice as frequent")
    plain = words.where("word IS NOT NULL").groupBy(F.col("word").cast("string").alias("word")).agg(F.sum(F.col("n").cast("long")).alias("n"))
    plain = ws.save(plain.where("n > 0"), "words")
    ahead = ws.save(trie_nodes(plain, ws, "ahead"), "ahead")
    turned = trie_nodes(plain.select(F.reverse("word").alias("word"), "n"), ws, "back")
    both = ahead.join(turned.select(F.reverse("word").alias("word"), F.col("nodes").alias("back")), "word")
    pairs = node_pairs(both).repartition("p", "s").sortWithinPartitions("p", "s", F.desc("n"), "id")
    met = pairs.mapInArrow(_met, "id long, near long, best_n long, best long")
    # Of two candidates the more frequent one, then the smaller id, which is the smaller word.
    found = met.groupBy("id").agg(F.sum("near").alias("n_near"), F.max(F.struct("best_n", (-F.col("best")).alias("least"))).alias("best"))
    known = ahead.select("id", "word", "n").join(found, "id", "left")
    usual = F.col("best.best_n") >= F.col("n") * factor
    known = known.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(usual, -F.col("best.least")).alias("to"), F.when(usual, F.col("best.best_n")).alias("form_n"))
    known = ws.save(known, "known")
    ends = roots(known.where("to IS NOT NULL").select("id", "to"), ws)
    names = known.select(F.col("id").alias("named"), F.col("word").alias("name"))
    moved = known.where("to IS NOT NULL").join(ends, "id")
    moved = moved.join(names.withColumnRenamed("name", "form"), F.col("to") == F.col("named")).drop("named")
    moved = moved.join(names.withColumnRenamed("name", "end"), F.col("root") == F.col("named")).drop("named")
    columns = ["word", "form", F.col("end").alias("root"), "n", "n_near", "form_n"]
    alone = known.where("to IS NULL").withColumns({"form": F.lit(None).cast("string"), "end": F.col("word")})
    return moved.select(*columns).unionByName(alone.select(*columns))
