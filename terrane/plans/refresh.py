"""Full refresh of the output tables, freshness check, and export of the mapping."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from functools import partial
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terrane.params import Params
from terrane.plans import orders, sessions
from terrane.session import in_parallel, remove_folder
from terrane.sources.tables import SOURCE_TABLES, Tables

# Partition column of each stored fact.
FACTS = {"search_sessions": "session_search_date_key", "order_facts": "fiscal_date"}

KEPT_VERSIONS = 2  # the current one, and the one before for readers that still use it


class FolderSink:
    """Output tables as Parquet folders below one root.

    A replaced table is written to a folder of its own. Only when that is complete, one small
    file is added to the table's list of versions, which makes it current. So a reader sees the
    old or the new table, and a failed job leaves the old one. The file holds the schema too, so
    an empty table reads back like any other. One writer at a time: a second one that takes the
    same number is refused.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def replace(self, name: str, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        """Replace a table by a result and read it back."""
        versions = self._versions(name)
        number, version = (versions[0]["number"] if versions else 0) + 1, uuid.uuid4().hex
        writer = _laid_out(df, partition_by).write
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(f"{self.root}/{name}/{version}")
        row = self.spark.createDataFrame([(number, version, df.schema.json())], VERSION).coalesce(1)
        # A number that is taken already is an error.
        row.write.mode("errorifexists").json(f"{self.root}/{name}/_versions/{number:09d}")
        for old in versions[KEPT_VERSIONS - 1 :]:
            remove_folder(self.spark, f"{self.root}/{name}/{old['folder']}")
        return self._read(name, version, df.schema)

    def read(self, name: str) -> DataFrame | None:
        versions = self._versions(name)
        if not versions:
            return None
        return self._read(name, versions[0]["folder"], StructType.fromJson(json.loads(versions[0]["schema"])))

    def _read(self, name: str, version: str, schema: StructType) -> DataFrame:
        # Partition columns come last from a folder; the table's own order is kept.
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{version}").select(*schema.names)

    def _versions(self, name: str) -> list[Row]:
        """All versions, the current one first."""
        try:
            stored = self.spark.read.schema(VERSION).option("recursiveFileLookup", True).json(f"{self.root}/{name}/_versions")
            rows = sorted(stored.collect(), key=lambda r: r["number"], reverse=True)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        if len({r["number"] for r in rows}) < len(rows):
            raise RuntimeError(f"two writers have replaced {name} at the same time")
        return rows


VERSION = "number long, folder string, schema string"


class CatalogSink:
    """Output tables in a database of the session catalog.

    A name is a view on the current version's table; replacing the view is one step.
    """

    def __init__(self, spark: SparkSession, database: str):
        self.spark, self.database = spark, database

    def replace(self, name: str, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        """Replace a table by a result and read it back."""
        stored = [t.name for t in self.spark.catalog.listTables(self.database, f"{name}__*")]
        number = max([int(t.rpartition("__")[2]) for t in stored], default=0) + 1
        writer = _laid_out(df, partition_by).write.format("parquet")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        version = f"{self.database}.{name}__{number:06d}"
        writer.saveAsTable(version)
        self.spark.sql(f"CREATE OR REPLACE VIEW {self.database}.{name} AS SELECT * FROM {version}")
        for old in sorted(stored, reverse=True)[KEPT_VERSIONS - 1 :]:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.database}.{old}")
        return self.spark.table(version).select(*df.columns)

    def read(self, name: str) -> DataFrame | None:
        table = f"{self.database}.{name}"
        return self.spark.table(table) if self.spark.catalog.tableExists(table) else None


Sink = FolderSink | CatalogSink


def _laid_out(df: DataFrame, partition_by: str | None) -> DataFrame:
    """Few, even files: rows gather by partition value, and a hot value is split over several tasks."""
    return df.hint("rebalance", F.col(partition_by)) if partition_by else df


def refresh_tables(src: Tables, p: Params, sink: Sink, state: list[Row] | None = None) -> dict[str, DataFrame]:
    """Replace all 12 tables. Each branch stores its fact first; its roll-ups read the stored fact.

    `state` is what `source_state` gave, if it has been asked for already.
    """
    spark = src("calendar").sparkSession
    # Read before the facts, so that rows that arrive meanwhile count as not yet refreshed.
    state = source_state(src, p, contents=False) if state is None else state

    def session_branch() -> dict[str, DataFrame]:
        stored = sink.replace("search_sessions", sessions.search_sessions(src, p), FACTS["search_sessions"])
        rollups = {
            "visitors_by_geo": sessions.visitors_by_geo,
            "nav_theme_visitors_by_geo": sessions.nav_theme_visitors_by_geo,
            "outlet_visitors_by_geo": sessions.outlet_visitors_by_geo,
        }
        made = {name: partial(rollup, src, p, sessions=stored) for name, rollup in rollups.items()}
        return {"search_sessions": stored, **_replaced(sink, made)}

    def order_branch() -> dict[str, DataFrame]:
        facts = sink.replace("order_facts", orders.order_facts(src, p), FACTS["order_facts"])
        keys = {
            "subclass_orders_by_geo": "subclass_desc",
            "brand_orders_by_geo": "brand_desc",
            "flow_orders_by_geo": "order_flow_desc",
            "price_orders_by_geo": "price_flag",
            "color_orders_by_geo": "color_family",
        }
        made = {name: partial(orders.orders_by, src, p, key, facts=facts) for name, key in keys.items()}
        made["geo_map"] = partial(orders.geo_map, src, p, facts)
        return {"order_facts": facts, **_replaced(sink, made)}

    window = {"run_window": sink.replace("run_window", sessions.run_window(spark, p))}
    branches = in_parallel({"sessions": session_branch, "orders": order_branch})
    sink.replace("refresh_state", spark.createDataFrame(state, STATE))
    return {**window, **branches["sessions"], **branches["orders"]}


def _replaced(sink: Sink, made: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
    return in_parallel({name: partial(_replace_one, sink, name, build) for name, build in made.items()})


def _replace_one(sink: Sink, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    return sink.replace(name, build())


STATE = "source string, row_count long, checksum string, files string"
WINDOW = "(window)"


def source_files(src: Tables) -> dict[str, str]:
    """Per source that can say how it is read: a digest of that, and of the path, size and time of each file behind it.

    Files are listed, not opened. A source without a definition, or without files, has none.
    """
    if not hasattr(src, "definition"):
        return {}
    spark = src("calendar").sparkSession
    behind = {source: sorted(src(source).inputFiles()) for source in SOURCE_TABLES}
    every = sorted({path for paths in behind.values() for path in paths})
    if not every:
        return {}
    # Of this source only the listing is read: no column of it is the content.
    listed = spark.read.format("binaryFile").load(every).select("path", F.col("modificationTime").cast("double").alias("at"), "length")
    facts = {r["path"]: f"{r['path']} {r['length']} {r['at']}" for r in listed.collect()}

    def bare(path: str) -> str:
        """A path as listed: the two interfaces differ in how they write a scheme and special characters."""
        return unquote(path).replace("///", "/", 1)

    known = {bare(path): fact for path, fact in facts.items()}
    found = {}
    for source, paths in behind.items():
        if paths and all(bare(path) in known for path in paths):
            text = "\n".join([src.definition(source), *(known[bare(path)] for path in paths)])
            found[source] = hashlib.sha256(text.encode()).hexdigest()
    return found


def source_state(src: Tables, p: Params, last: dict[str, Row] | None = None, contents: bool = True) -> list[Row]:
    """One row of STATE per source, and one for the window of the run.

    A source whose files are those of its row in `last` keeps this row: none of its columns is
    read. Of the others, rows and an order-free checksum are computed, unless `contents` is off
    and the source has files to go by.
    """
    last = last or {}
    files = source_files(src)
    window = f"{p.start_key} {p.end_key} {p.start_date} {p.end_date}"
    state = {WINDOW: Row(source=WINDOW, row_count=1, checksum=window, files=None)}
    union = None
    for source in SOURCE_TABLES:
        known = files.get(source)
        if known is not None and source in last and last[source]["files"] == known and (last[source]["checksum"] is not None or not contents):
            state[source] = last[source]
        elif known is not None and not contents:
            state[source] = Row(source=source, row_count=None, checksum=None, files=known)
        else:
            df = src(source)
            content = F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).cast("string")
            counted = df.agg(F.lit(source).alias("source"), F.count("*").alias("row_count"), F.coalesce(content, F.lit("empty")).alias("checksum"))
            union = counted if union is None else union.unionAll(counted)
    if union is not None:
        for r in union.collect():  # one row a source
            state[r["source"]] = Row(**r.asDict(), files=files.get(r["source"]))
    return list(state.values())


def _stored_state(sink: Sink) -> dict[str, Row]:
    stored = sink.read("refresh_state")
    return {r["source"]: r for r in stored.collect()} if stored is not None else {}


def _stale(now: Row, last: Row | None) -> bool:
    if last is None:
        return True
    if now["files"] is not None and now["files"] == last["files"]:
        return False
    return now["checksum"] is None or now["checksum"] != last["checksum"] or now["row_count"] != last["row_count"]


def refresh_status(src: Tables, p: Params, sink: Sink) -> DataFrame:
    """Per source, and for the window: rows now and at the last refresh, and whether it calls for a refresh.

    Any row that was added, removed or altered does, whatever its date, and so does another window.
    Sources are first told by their files; only where these have changed, or are unknown, by content.
    A source whose content was not recorded, and whose files have changed, calls for a refresh.
    """
    last = _stored_state(sink)
    found = []
    for now in source_state(src, p, last, contents=any(r["checksum"] is not None for r in last.values() if r["source"] != WINDOW)):
        before = last.get(now["source"])
        found.append((now["source"], now["row_count"], before["row_count"] if before else None, _stale(now, before)))
    return src("calendar").sparkSession.createDataFrame(found, "source string, row_count long, stored_count long, needs_refresh boolean")


def refresh_if_needed(src: Tables, p: Params, sink: Sink) -> bool:
    """Run the full refresh only if a source or the window has changed since the stored tables were made."""
    last = _stored_state(sink)
    state = source_state(src, p, last, contents=False)
    needed = any(_stale(now, last.get(now["source"])) for now in state)
    if needed:
        refresh_tables(src, p, sink, state)
    return needed


def export_csv(mapping: DataFrame, path: str) -> None:
    """Write the cluster mapping as CSV with a header."""
    mapping.write.mode("overwrite").option("header", True).csv(path)
