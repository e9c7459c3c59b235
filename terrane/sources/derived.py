"""The 15 source tables derived from the generated test tables.

COLUMNS holds each table's column expressions as FIXTURES.md specifies them, in syntax that
Spark and DuckDB both accept. The row sources are built below as DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TS_KEY = "CAST(year(ts)*10000+month(ts)*100+day(ts) AS INT)"
_SESSION_KEY = f"user_id*100000000+{_TS_KEY}"
_MOVED = "(user_id + CASE WHEN event_id % 8 = 0 THEN 1 ELSE 0 END) % 21"

COLUMNS: dict[str, dict[str, str]] = {
    "session_search": {
        "session_search_date_key": _TS_KEY,
        "visitor_key": "user_id",
        "session_key": _SESSION_KEY,
        "site_id": "CASE WHEN event_id % 4 = 0 THEN 'outlet' ELSE 'main' END",
        "page_name": "CASE WHEN event_id % 23 = 0 THEN '' ELSE event_type END",
        "page_name_key": "CAST(length(event_type) AS INT)",
        "page_template": "CASE WHEN event_id % 10 < 8 THEN 'nav_search' ELSE 'product' END",
        "clickstream_visit_page_num": "CAST(event_id % 12 AS INT)",
        "user_search_results_returned_count": "CASE WHEN event_id % 7 = 0 THEN 0 "
        "WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 50 AS INT) END",
        "navigation_search_term": "CASE WHEN event_id % 13 = 0 THEN '' "
        "WHEN event_id % 17 = 0 THEN NULL ELSE concat('  ', p_name, ' ') END",
        "user_search_term": "CASE event_id % 3 WHEN 0 THEN p_name WHEN 1 THEN '' ELSE NULL END",
        "breadcrumb": "CASE event_id % 5 WHEN 0 THEN concat(p_type,'|',p_brand) WHEN 1 THEN NULL "
        "WHEN 2 THEN '' WHEN 3 THEN p_type ELSE concat('|',p_brand) END",
        "search_refinement_type": "CASE WHEN event_id % 6 = 0 THEN NULL ELSE p_type END",
        "navigation_category_type": "CASE WHEN event_id % 9 < 4 THEN 'cat' "
        "WHEN event_id % 9 < 7 THEN 'query' ELSE 'brand' END",
    },
    "calendar": {
        "date_key": "CAST(20240101 + o_orderkey % 30 AS INT)",
        "fiscal_date": "CAST(concat('2024-01-', lpad(CAST(1 + o_orderkey % 30 AS STRING),2,'0')) AS DATE)",
        "fiscal_month": "CASE WHEN o_orderkey % 30 < 14 THEN 202312 ELSE 202401 END",
    },
    "clickstream_session_bot": {
        "session_key": _SESSION_KEY,
        "session_bot_flag": "CASE WHEN user_id % 10 = 0 THEN 1 ELSE 0 END",
        "session_start_date": "CASE WHEN user_id % 20 = 0 THEN DATE '2023-12-31' ELSE CAST(ts AS DATE) END",
    },
    "session": {
        "visitor_key": "user_id",
        "session_start_date_key": _TS_KEY,
        "dma_code": f"CASE WHEN user_id % 14 = 3 THEN NULL ELSE CAST(503 + {_MOVED} AS INT) END",
        "cbsa_name": "CASE WHEN user_id % 14 = 3 THEN NULL "
        f"ELSE concat('CBSA_NATION_', CAST(3 + {_MOVED} AS STRING)) END",
    },
    "order_line": {
        "order_id": "l_orderkey",
        "order_date_key": "CAST(20240101 + l_orderkey % 30 AS INT)",
        "product_key": "l_partkey",
        "sku_key": "l_partkey*10 + l_linenumber % 2",
        "sku": "CASE WHEN l_partkey % 97 = 0 THEN '9000000000' WHEN l_partkey % 89 = 0 THEN NULL "
        "ELSE CAST(l_partkey*10 + l_linenumber % 2 AS STRING) END",
        "order_flow_key": "CAST(1 + l_orderkey % 12 AS INT)",
        "price_sub_type_key": "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END",
        "line_qty": "CAST(l_quantity AS INT)",
        "net_amt": "CAST(l_extendedprice AS DECIMAL(12,2))",
        "current_corp_price": "CASE WHEN l_partkey % 6 = 0 THEN NULL "
        "ELSE CAST(10 + l_partkey % 100 AS DECIMAL(12,2)) END",
        "cancelled_qty": "CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linestatus = 'O' THEN 1 ELSE 0 END",
        "cogs_flag": "CASE WHEN l_discount > 0.05 THEN 1 WHEN l_linenumber = 3 THEN NULL ELSE 0 END",
        "adjusted_moving_average_price": "CAST(5 + l_partkey % 50 AS DECIMAL(12,2))",
        "billto_address_key": "CASE WHEN o_custkey % 31 = 0 THEN NULL ELSE o_custkey END",
        "origination_channel_key": "CAST(100 + o_custkey % 4 AS INT)",
        "order_entry_group_key": "CASE substring(o_orderpriority,1,1) WHEN '1' THEN 1 WHEN '2' THEN 2 "
        "WHEN '3' THEN -2 WHEN '4' THEN 4 ELSE 9 END",
        "order_entry_application_key": "CASE WHEN o_orderstatus = 'P' THEN 4 ELSE 3 END",
    },
    "merch_product": {
        "product_key": "p_partkey",
        "department_key": "CAST(p_size % 5 AS INT)",
        "department_desc": "concat('DEPT_', CAST(p_size % 5 AS STRING))",
        "brand_desc": "p_brand",
    },
    "merch_sku": {
        "product_key": "p_partkey",
        "sku_key": "p_partkey*10 + n_nationkey",
        "department_key": "CAST(CASE WHEN p_partkey % 19 = 0 THEN 99 ELSE p_size % 5 END AS INT)",
        "product": "p_name",
        "shop_desc": "p_type",
        "subclass_desc": "concat('SUB_', CAST(p_size % 12 AS STRING))",
        "color_family": "split_part(p_name,' ',1)",
        "department_id": "CAST(p_size % 5 AS INT)",
        "class_id": "CAST(p_size % 10 AS INT)",
        "subclass_id": "CAST(p_size % 12 AS INT)",
        "dona_id": "n_nationkey",
    },
    "order_flow": {
        "order_flow_key": "CAST(1 + o_orderkey % 12 AS INT)",
        "order_flow_desc": "concat('FLOW_', CAST(1 + o_orderkey % 12 AS STRING))",
    },
    "price_sub_type": {
        "price_sub_type_key": "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END",
        "price_sub_type_desc": "concat('PRICE_', l_returnflag)",
    },
    "digital_shop": {
        "department_desc": "concat('DEPT_', CAST(n_nationkey % 3 AS STRING))",
        "digital_shop": "CASE WHEN n_nationkey % 3 = 2 THEN NULL "
        "ELSE concat('DSHOP_', CAST(n_nationkey AS STRING)) END",
    },
    "merch_sku_attribute": {
        "product_key": "p_partkey",
        "attribute_name": "CASE WHEN n_nationkey = 0 THEN 'PRIMARY_ACTIVITY_CODE' ELSE 'FABRIC' END",
        "attribute_value": "concat('ACT_', CAST(p_size % 7 AS STRING))",
    },
    "merch_hier_activity_xref": {
        "shop_desc": "p_type",
        "department_id": "CAST(p_size % 5 AS INT)",
        "class_id": "CAST(p_size % 10 AS INT)",
        "subclass_id": "CAST(p_size % 12 AS INT)",
        "dona_id": "n_nationkey",
        "activity_desc": "concat('ACTDESC_', CAST(p_size % 4 AS STRING))",
    },
    "address": {
        "address_key": "c_custkey",
        "dma_geo_key": "c_nationkey",
    },
    "dma_geo_dim": {
        "dma_geo_key": "n_nationkey",
        "dma_code": "CASE n_nationkey WHEN 0 THEN 'N/A' WHEN 1 THEN 'UNK' WHEN 2 THEN NULL "
        "ELSE CAST(500 + n_nationkey AS STRING) END",
        "dma_name": "concat('DMA_', n_name)",
        "cbsa_code": "CAST(10000 + 10*n_nationkey AS INT)",
        "cbsa_name": "concat('CBSA_', n_name)",
        "dma_zip_code": "lpad(CAST(n_nationkey AS STRING),5,'0')",
        "state_name": "concat('STATE_', CAST(n_regionkey AS STRING))",
    },
    "dma_district": {
        "dma_code": "CASE WHEN n_nationkey = 0 THEN 1 ELSE 500 + n_nationkey END",
        "dma_short_desc": "concat('SD_', n_name)",
        "district_name": "r_name",
    },
}

DISTINCT_TABLES = ("calendar", "session", "order_flow", "price_sub_type", "merch_hier_activity_xref")


# Schemas of the generated tables, given so that no job infers them.
RAW_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


class DerivedTables:
    """The source tables over the Parquet files in `sf_dir`; called with a table name.

    The method named after a table gives its row source.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __call__(self, table: str) -> DataFrame:
        columns = [F.expr(text).alias(name) for name, text in COLUMNS[table].items()]
        df = getattr(self, table)().select(*columns)
        return df.distinct() if table in DISTINCT_TABLES else df

    def definition(self, table: str) -> str:
        """How a table is made; with the files behind it, this fixes its rows."""
        return f"derived {self.sf_dir} {table} {sorted(COLUMNS[table].items())}"

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(RAW_SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    def part_variants(self) -> DataFrame:
        """Every part once for variant 0 and once for variant 1, without a join."""
        return self.raw("part").withColumn("n_nationkey", F.explode(F.array(F.lit(0), F.lit(1))))

    def session_search(self) -> DataFrame:
        # One scan: every tenth event gives two equal rows. All parts take part, in turn.
        copies = F.when(F.expr("event_id % 10 = 0"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        parts = self.raw("part").agg(F.count("*")).scalar()
        twice = self.raw("events").withColumn("copy", F.explode(copies)).withColumn("part_number", F.col("event_id") % parts)
        return twice.join(self.raw("part"), F.expr("p_partkey = part_number"))

    def calendar(self) -> DataFrame:
        return self.raw("orders").where("o_orderkey % 30 <> 19")

    def clickstream_session_bot(self) -> DataFrame:
        return self.raw("events")

    def session(self) -> DataFrame:
        return self.raw("events").where("user_id % 15 <> 1")

    def order_line(self) -> DataFrame:
        return self.raw("lineitem").join(self.raw("orders"), F.expr("l_orderkey = o_orderkey"))

    def merch_product(self) -> DataFrame:
        return self.raw("part")

    def merch_sku(self) -> DataFrame:
        return self.part_variants()

    def order_flow(self) -> DataFrame:
        return self.raw("orders")

    def price_sub_type(self) -> DataFrame:
        return self.raw("lineitem")

    def digital_shop(self) -> DataFrame:
        return self.raw("nation").where("n_nationkey IN (0,1,2,4)")

    def merch_sku_attribute(self) -> DataFrame:
        return self.part_variants().where("(n_nationkey = 1 OR p_partkey % 5 <> 0) AND p_partkey % 13 <> 0")

    def merch_hier_activity_xref(self) -> DataFrame:
        return self.part_variants().where("p_size % 2 = 0")

    def address(self) -> DataFrame:
        return self.raw("customer")

    def dma_geo_dim(self) -> DataFrame:
        return self.raw("nation")

    def dma_district(self) -> DataFrame:
        joined = self.raw("nation").join(self.raw("region"), F.expr("n_regionkey = r_regionkey"))
        return joined.where("n_nationkey NOT IN (1,2,24)")
