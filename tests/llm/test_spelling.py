"""Spelling variants against all pairs: near words, usual forms, roots, and the numbering of the tries."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from terrane.llm import spelling


def near(a: str, b: str) -> bool:
    """One inserted, deleted or replaced character."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def expected(counts: dict[str, int], factor: int = 5) -> set[tuple]:
    form, found = {}, {}
    for word, n in counts.items():
        others = [w for w in counts if near(word, w)]
        best = min(others, key=lambda w: (-counts[w], w), default=None)
        form[word] = best if best is not None and counts[best] >= factor * n else None
        found[word] = len(others)

    def root(word: str) -> str:
        return word if form[word] is None else root(form[word])

    return {(w, form[w], root(w), n, found[w], None if form[w] is None else counts[form[w]]) for w, n in counts.items()}


def got(spark, ws, counts, partitions=3) -> set[tuple]:
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(partitions)
    rows = spelling.variants(words, ws).collect()
    assert len(rows) == len(counts)
    return {tuple(r) for r in rows}


def random_words(seed: int, n: int, letters: str = "abé", length: int = 6) -> dict[str, int]:
    random.seed(seed)
    return {"".join(random.choice(letters) for _ in range(random.randint(1, length))): random.choice((5, 6, 25, 30, 150, 800)) for _ in range(n)}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, llm_ws, seed):
    counts = random_words(seed, 400)
    assert got(spark, llm_ws, counts) == expected(counts)


def test_over_many_partitions(spark, llm_ws):
    """Nodes that several partitions share have one number; adaptive execution must not join the partitions here."""
    counts = random_words(5, 300, "ab", 9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert got(spark, llm_ws, counts) == expected(counts)
        words = spark.createDataFrame(list(counts.items()), "word string, n long")
        rows = spelling.trie_nodes(words, llm_ws, "check").collect()
        assert len({r.id >> spelling.OWN for r in rows}) > 5
        numbers = {}
        for r in rows:
            for i, node in enumerate(r.nodes):
                assert numbers.setdefault(r.word[:i], node) == node
        assert len(set(numbers.values())) == len(numbers)
        assert [r.word for r in sorted(rows, key=lambda r: r.id)] == sorted(counts)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_ties_runs_and_chains(spark, llm_ws):
    counts = {
        "balloon": 5, "baloon": 30, "ballon": 30, "balon": 200, "baalon": 1000,  # a chain, ties, equal letters in a row
        "aaaa": 5, "aaaaa": 25, "aaaaaa": 125, "alone": 9, "": 50, "é": 10, "x": 10,
    }
    assert got(spark, llm_ws, counts) == expected(counts)


def test_groups_are_bounded_by_the_alphabet(spark, llm_ws):
    """One pattern with a different letter each: all are near each other, found without listing pairs."""
    counts = {f"pattern{c}end": i + 5 for i, c in enumerate("abcdefghijklmnopqrstuvwxyzàâçèéêëîïôùûü")}
    counts["patternend"] = 500
    assert got(spark, llm_ws, counts) == expected(counts)


def test_very_long_words(spark, llm_ws):
    counts = {"ab" * 3000: 5, "ab" * 2999 + "a": 50, "ab" * 1500 + "c" + "ab" * 1500: 7}
    rows = {r.n: r for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), llm_ws).collect()}
    assert rows[5].form == "ab" * 2999 + "a" and rows[5].n_near == 2 and rows[7].n_near == 1 and rows[7].form is None and rows[50].n_near == 1


def test_odd_rows(spark, llm_ws):
    words = spark.createDataFrame([("same", 3), ("same", 4), (None, 9), ("sane", None), ("sale", 0), ("sames", 60)], "word string, n long")
    words = words.withColumns({c: F.lit(1) for c in ("id", "p", "form", "root", "part", "nodes")})
    assert {tuple(r) for r in spelling.variants(words, llm_ws).collect()} == {("same", "sames", "sames", 7, 1, 60), ("sames", None, "sames", 60, 1, None)}
    assert spelling.variants(words.limit(0), llm_ws).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(words, llm_ws, factor=1)


def test_counted_words(spark, docs_of, odd_docs):
    random.seed(4)
    vocabulary = ["Wörterbuch", "ÉCOLES", "written", "WRITTEN", "short", "lengthy", "a×b÷cde", "sixsix"]
    texts = [(i, " ".join(random.choice(vocabulary) + random.choice(("", ".", "1", "-")) for _ in range(200))) for i in range(60)]
    rows = [*texts, texts[0], (None, "Wörterbuch " * 300), (None, None), (7, "")]
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    found = {r.word: r.n for r in spelling.counted_words(docs_of(rows)).collect()}
    assert found == {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    assert any(w not in {v.lower() for v in vocabulary} for w in found) or len(found) >= 5
    assert spelling.counted_words(odd_docs.limit(0)).collect() == []
    assert all(r.n >= 1 for r in spelling.counted_words(odd_docs, least_count=1).collect())


def test_counts_are_passed_on(spark, docs_of):
    rows = [(i, " ".join(f"{'abcdefgh'[i % 8]}{'xyzuvw'[j % 6]}ordinary" for j in range(30))) for i in range(40)]
    assert sum(r.n for r in spelling.counted_words(docs_of(rows), misspelt=0, held=10).collect()) == 1200
