"""Where the source tables come from. A step asks for a table by its logical name."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

Tables = Callable[[str], DataFrame]

SOURCE_TABLES = (
    "session_search",
    "calendar",
    "clickstream_session_bot",
    "session",
    "order_line",
    "merch_product",
    "merch_sku",
    "order_flow",
    "price_sub_type",
    "digital_shop",
    "merch_sku_attribute",
    "merch_hier_activity_xref",
    "address",
    "dma_geo_dim",
    "dma_district",
)


class NamedTables:
    """A reader of tables by logical name that can say how it reads each of them.

    As long as a table's definition and the files behind it are the same, so are its rows. A plain
    function will do as well where tables are only read; freshness then goes by their content.
    """

    def __init__(self, read: Tables, definition: Callable[[str], str]):
        self.read, self.definition = read, definition

    def __call__(self, table: str) -> DataFrame:
        return self.read(table)


def catalog_tables(spark: SparkSession, names: Mapping[str, str] | None = None) -> Tables:
    """Tables of the session catalog; `names` maps a logical to a qualified name
    (`catalog.schema.table`) where the two differ. A view is read as it stands at the time, so it
    has no definition of its own and is judged by its content."""
    names = names or {}
    return lambda table: spark.table(names.get(table, table))


def parquet_tables(spark: SparkSession, root: str) -> Tables:
    """Tables stored as `root/<name>`."""
    return NamedTables(lambda table: spark.read.parquet(f"{root}/{table}"), lambda table: f"parquet {root}/{table}")
