"""The registered queries against their SQL, and the pipeline against its stages done plainly."""

import hashlib
import importlib.util

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from checks.compare import duckdb_rows, rows_of
from terrane.llm import bpe, fm, registry, secrets
from terrane.llm.text import table
from terrane.session import Workspace
from tests.conftest import SF_DIR
from tests.llm.test_near_copies import similar_pairs

NUMBERS = {int(n[2:].split("_")[0]) for n in registry.queries()}


def test_all_operators_are_registered():
    assert NUMBERS == set(range(1, 14)) and "pipeline" in entry.queries()
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    df = registry.queries()[name](spark, SF_DIR)
    columns, expected = duckdb_rows(SF_DIR, registry.oracle_sql()[name])
    assert sorted(df.columns) == columns and rows_of(df.columns, df.collect()) == expected


def test_stages_take_effect(spark):
    ws = Workspace(spark, "stages")
    docs = table(spark, SF_DIR, "documents")
    columns = docs.columns
    results = [{(r.doc_id, r.text) for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES:
        last = docs
        docs = ws.save(stage(spark, docs, SF_DIR), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            results.append(sorted((r.doc_id, r.text) for r in docs.collect()))
    raw, good, single, masked, mixed = results
    machine = fm.train(table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels"))
    scores = fm.score(table(spark, SF_DIR, "documents"), machine, ["doc_id"]).collect()
    assert {d for d, _ in good} == {r.doc_id for r in scores if r.score >= 0.3} and set(good) <= raw
    pairs, left = similar_pairs(dict(good)), {d for d, _ in single}
    near = [p for p, s in pairs.items() if s >= 0.8]
    assert set(single) <= set(good) and near and sum(left.issuperset(p) for p in near) <= 0.1 * len(near)
    partners = {d for p, s in pairs.items() if s >= 0.6 for d in p}
    assert all(d in left or d in partners for d, t in good if t and t.strip())
    assert [d for d, _ in masked] == [d for d, _ in single]
    assert not secrets.scan(last.sparkSession.createDataFrame(masked, "doc_id long, text string")).where("size(base) > 0").count()
    texts = dict(masked)
    assert mixed and all(t == texts[d] for d, t in mixed)
    tokenizer = bpe.load(registry.word_vocabulary())
    rows = docs.collect()
    assert sorted(r.doc_id for r in rows) == [d for d, _ in mixed]
    for r in rows:
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_pipeline_takes_odd_rows_and_empty_tables(spark, odd_docs, tmp_path):
    for name, docs in (("odd", odd_docs), ("empty", odd_docs.limit(0))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        table(spark, SF_DIR, "labels").write.parquet(str(tmp_path / name / "labels.parquet"))
        rows = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert bool(rows) == (name == "odd")


def test_entry_works_without_the_subpackage(monkeypatch):
    found = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name == "terrane.llm" else found(name, *a))
    spec = found("__spark_entry__")
    alone = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(alone)
    assert "visitors_by_geo" in alone.queries() and not any(n.startswith("op") and n[2].isdigit() for n in alone.queries())
    assert "pipeline" not in alone.queries()
