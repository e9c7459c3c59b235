"""Refresh, freshness and export."""

from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from terrane.params import Params
from terrane.plans import features, refresh, segments
from terrane.sources.tables import SOURCE_TABLES, catalog_tables, parquet_tables

P = Params(start_key=20240103, end_key=20240128, start_date=date(2024, 1, 3), end_date=date(2024, 1, 28))


def test_refresh_only_when_needed(spark, derived, tmp_path):
    sink = refresh.FolderSink(spark, str(tmp_path / "out"))
    assert refresh.refresh_if_needed(derived, P, sink)
    assert not refresh.refresh_if_needed(derived, P, sink)
    stored = sink.read("search_sessions")
    assert stored.where(F.col("session_search_date_key") == 20240110).count() > 0
    before = stored.count()
    shorter = replace(P, end_key=20240110, end_date=date(2024, 1, 10))
    assert refresh.refresh_if_needed(derived, shorter, sink)
    assert sink.read("search_sessions").count() < before
    # Files tell nothing about a reader without definitions: it goes by the content, where that was recorded.
    sink.replace("refresh_state", spark.createDataFrame(refresh.source_state(derived, shorter), refresh.STATE))
    emptied = lambda table: derived(table).limit(0) if table == "dma_district" else derived(table)
    status = {r["source"]: r["needs_refresh"] for r in refresh.refresh_status(emptied, shorter, sink).collect()}
    assert [name for name, stale in status.items() if stale] == ["dma_district"] and len(status) == 16


def test_unchanged_files_are_not_read(spark, tmp_path):
    """Sources with a definition are told by their files alone; only a changed one is counted."""
    for name in SOURCE_TABLES:
        spark.range(5).write.parquet(str(tmp_path / name))
    src = parquet_tables(spark, str(tmp_path))
    first = {r["source"]: r for r in refresh.source_state(src, P)}
    assert all(r["files"] and r["row_count"] == 5 for s, r in first.items() if s != refresh.WINDOW)
    spark.range(2).write.mode("append").parquet(str(tmp_path / "order_flow"))
    again = {r["source"]: r for r in refresh.source_state(src, P, first)}
    assert [s for s in SOURCE_TABLES if again[s] != first[s]] == ["order_flow"] and again["order_flow"]["row_count"] == 7
    lazy = {r["source"]: r for r in refresh.source_state(src, P, contents=False)}
    assert all(r["checksum"] is None and r["files"] == again[s]["files"] for s, r in lazy.items() if s != refresh.WINDOW)
    assert refresh._stale(lazy["order_flow"], first["order_flow"]) and not refresh._stale(lazy["session"], first["session"])
    # Rewritten with the same rows: other files, equal content.
    spark.range(5).write.mode("overwrite").parquet(str(tmp_path / "session"))
    now = {r["source"]: r for r in refresh.source_state(src, P, first)}
    assert now["session"]["files"] != first["session"]["files"] and not refresh._stale(now["session"], first["session"])


def test_empty_tables_read_back_and_two_writers_are_refused(spark, tmp_path):
    sink = refresh.FolderSink(spark, str(tmp_path / "out"))
    df = spark.createDataFrame([(1, "a", 2)], "k int, name string, n int")
    sink.replace("t", df.limit(0), "k")
    assert sink.read("t").schema == df.schema and sink.read("t").isEmpty()
    marker = spark.createDataFrame([(1, "other", df.schema.json())], refresh.VERSION)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        marker.write.mode("errorifexists").json(str(tmp_path / "out" / "t" / "_versions" / f"{1:09d}"))
    marker.write.json(str(tmp_path / "out" / "t" / "_versions" / "elsewhere"))
    with pytest.raises(RuntimeError, match="two writers"):
        sink.read("t")


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    sink = refresh.FolderSink(spark, str(tmp_path / "out"))
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, name string")
    sink.replace("t", df)
    with pytest.raises(Exception, match="no such row"):
        sink.replace("t", df.withColumn("name", F.when(F.col("k") == 2, F.raise_error(F.lit("no such row"))).otherwise(F.col("name"))))
    assert [tuple(r) for r in sink.read("t").orderBy("k").collect()] == [(1, "a"), (2, "b")]
    for n in range(3):
        sink.replace("t", df.where(f"k > {n}"))
    assert sink.read("t").count() == 0
    folders = [p.name for p in (tmp_path / "out" / "t").iterdir() if not p.name.startswith((".", "_"))]
    assert len(folders) <= 3  # two versions, and what the failed job left


def test_replace_overwrites_and_keeps_column_order(spark, tmp_path):
    sink = refresh.FolderSink(spark, str(tmp_path / "out"))
    df = spark.createDataFrame([(1, "a", 2), (2, "b", 3)], "k int, name string, n int")
    sink.replace("t", df, "k")
    back = sink.replace("t", df.where("k = 2"), "k")
    assert back.columns == ["k", "name", "n"] and [tuple(r) for r in back.collect()] == [(2, "b", 3)]
    assert sink.read("missing") is None


def test_catalog_sink_and_qualified_names(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS segments_test LOCATION '{tmp_path}'")
    try:
        sink = refresh.CatalogSink(spark, "segments_test")
        df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, name string")
        sink.replace("t", df)
        assert sink.replace("t", df.where("k = 1"), "k").count() == 1
        assert sink.read("missing") is None
        src = catalog_tables(spark, {"calendar": "spark_catalog.segments_test.t"})
        assert src("calendar").columns == ["name", "k"]
    finally:
        spark.sql("DROP DATABASE segments_test CASCADE")


def test_csv_export_reads_back(spark, tmp_path):
    mapping = spark.createDataFrame([(501, 1, 'a,"b'), (502, 0, None)], "geo int, segment int, name string")
    refresh.export_csv(mapping, str(tmp_path / "csv"))
    back = spark.read.schema(mapping.schema).option("header", True).csv(str(tmp_path / "csv"))
    assert sorted(map(str, back.collect())) == sorted(map(str, mapping.collect()))


def test_a_new_variable_is_one_registry_row(spark, derived):
    extra = features.Feature("activity", features.ORDERS, "activity_label")
    long = features.feature_long(derived, P, [*features.REGISTRY, extra]).persist()
    assert long.where("family = 'activity'").count() > 0
    shares = features.feature_shares(long, [*features.REGISTRY, extra])
    assert shares.where("family = 'activity' AND (value <= 0 OR value > 1)").isEmpty()
    assert shares.where("family = 'activity' AND feature = '(none)'").count() > 0
    long.unpersist()


def test_map_keeps_regions_without_orders(spark, derived):
    labels = spark.createDataFrame([(505, 1), (999, 2)], "geo int, segment int")
    found = {r["geo"]: (r["segment"], r["dma_name"]) for r in segments.segment_map(labels, derived, P).collect()}
    assert found == {505: (1, "DMA_NATION_5"), 999: (2, None)}
