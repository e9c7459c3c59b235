"""Fingerprints, links and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from terrane.llm import simhash
from terrane.llm.components import components
from terrane.session import Workspace


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", None, " ", "A b", "A b C d É", "x " * 40, "Wörter, Wörter und mehr\nals ÄÖ"])
def test_fingerprint(text):
    assert simhash.text_fingerprint(text) == plain_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    row = spark.sql("SELECT xxhash64('one two three') AS h").first()
    assert row.h % (1 << 64) == simhash.text_fingerprint("One two THREE")


def reachable(prints):
    """Group of each fingerprint over links of at most three bits."""
    values, group = sorted(set(prints)), {}
    for v in values:
        if v in group:
            continue
        todo, group[v] = [v], v
        while todo:
            x = todo.pop()
            for y in values:
                if y not in group and (x ^ y).bit_count() <= 3:
                    group[y] = v
                    todo.append(y)
    return group


@pytest.mark.parametrize("busy", [4096, 3])
def test_close_pairs_keep_components(spark, llm_ws, busy):
    random.seed(5)
    seeds = [random.getrandbits(64) for _ in range(30)] + [0, (1 << 64) - 1]
    prints = {s ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 4))) for s in seeds for _ in range(9)}
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    nodes = spark.createDataFrame([(s,) for s in signed], "fingerprint long").repartition(4)
    links = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.close_pairs(nodes, busy).collect()]
    assert links and all((a ^ b).bit_count() <= 3 and a != b for a, b in links)
    stars = {r.node % (1 << 64): r.root for r in components(spark.createDataFrame([(int(np.uint64(a).view(np.int64)), int(np.uint64(b).view(np.int64))) for a, b in links], "a long, b long"), llm_ws).collect()}
    group = reachable(prints)
    by_root, by_group = {}, {}
    for p in prints:
        by_root.setdefault(stars.get(p, ("alone", p)), set()).add(p)
        by_group.setdefault(group[p], set()).add(p)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_group.values()))


def test_components_of_a_chain_and_nothing(spark, llm_ws):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    found = {r.node: r.root for r in components(chain, llm_ws).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(chain.limit(0), llm_ws.child("none")).count() == 0


def test_groups_and_one_of_each(docs_of, llm_ws):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(9, base), (4, base), (12, base.replace("word200", "other")), (20, "something else entirely"), (None, base), (20, "something else entirely"), (31, ""), (30, None)]
    found = simhash.groups(docs_of(rows), llm_ws).collect()
    prints = {plain_fingerprint(t): None for _, t in rows}
    group = reachable(prints)
    for r in found:
        own = group[r.fingerprint % (1 << 64)]
        assert r.component_id == min(i for i, t in rows if i is not None and group[plain_fingerprint(t)] == own)
    assert len(found) == len(rows)
    kept = simhash.one_of_each(docs_of(rows), Workspace(llm_ws.spark, "one")).collect()
    assert sorted(r.doc_id for r in kept) == [4, 20, 30] and kept[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}


def test_odd_rows(odd_docs, llm_ws):
    assert simhash.groups(odd_docs, llm_ws).count() == 11
    kept = simhash.one_of_each(odd_docs, llm_ws.child("odd"))
    assert kept.columns == odd_docs.columns
    texts = sorted(r.text or "" for r in kept.select("text").collect())
    assert texts.count("same words here again") == 1 and texts.count("one two three four") == 1
    assert simhash.one_of_each(odd_docs.limit(0), llm_ws.child("none")).count() == 0


def test_plan_has_no_cross_join(docs_of, llm_ws):
    nodes = docs_of([(1, "a")]).select(F.col("doc_id").alias("fingerprint"))
    plan = simhash.close_pairs(nodes)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
