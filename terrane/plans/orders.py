"""Order branch: enriched order facts and order counts per region."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.expressions import cost, demand, region_code
from terrane.operators.bitmaps import distinct_bits
from terrane.operators.joins import join_nullable
from terrane.operators.rollup import distinct_count, distinct_count_sets
from terrane.params import (
    ACTIVITY_ATTRIBUTE,
    EXCLUDED_ORDER_FLOWS,
    EXCLUDED_SKUS,
    ORDER_ENTRY_APPLICATION,
    ORDER_ENTRY_GROUPS,
    ORIGINATION_CHANNELS,
    Params,
)
from terrane.sources.tables import Tables

FACT_KEYS = (
    "fiscal_date",
    "dma_code",
    "dma_name",
    "dma_short_desc",
    "district_name",
    "state_name",
    "cbsa_code",
    "cbsa_name",
    "dma_zip_code",
    "order_id",
    "product",
    "digital_shop",
    "subclass_desc",
    "brand_desc",
    "color_family",
    "order_flow_desc",
    "price_flag",
    "activity_product",
    "activity_label",
)
GEO_COLUMNS = (
    "dma_code",
    "dma_name",
    "dma_short_desc",
    "dma_zip_code",
    "cbsa_code",
    "cbsa_name",
    "district_name",
    "state_name",
)
LABELS = ("digital_shop", "activity_product", "activity_label")
ACTIVITY_KEYS = ["shop_desc", "department_id", "class_id", "subclass_id", "dona_id"]
ORDER_KEYS = ("subclass_desc", "brand_desc", "order_flow_desc", "price_flag", "color_family")
DEFAULT_GRAIN = ("dma_code",)


def geo_lookup(src: Tables) -> DataFrame:
    """Address with its region block. Addresses without a region code or district drop out."""
    regions = src("dma_geo_dim").withColumn("dma_code", region_code(F.col("dma_code")))
    placed = src("address").join(regions, ["dma_geo_key"])
    return placed.join(src("dma_district"), ["dma_code"]).select("address_key", "dma_geo_key", *GEO_COLUMNS)


def product_activity(src: Tables) -> DataFrame:
    """One attribute of the attribute table per product; products without it keep a NULL row."""
    value = F.when(F.col("attribute_name") == ACTIVITY_ATTRIBUTE, F.col("attribute_value"))
    return src("merch_sku_attribute").groupBy("product_key").agg(F.max(value).alias("activity_product"))


def digital_shop_lookup(src: Tables) -> DataFrame:
    """Product with the digital shops of its department, and how many rows the lookup makes of it."""
    shops = src("digital_shop")
    sizes = shops.groupBy("department_desc").agg(F.count("*").alias("shop_rows"))
    products = src("merch_product").select("product_key", "department_desc")
    joined = products.join(shops, ["department_desc"], "left").join(sizes, ["department_desc"], "left")
    return joined.select(
        "product_key", "department_desc", "digital_shop", F.coalesce("shop_rows", F.lit(1)).alias("shop_rows")
    )


def activity_labels(src: Tables) -> DataFrame:
    return src("merch_hier_activity_xref").select(*ACTIVITY_KEYS, F.col("activity_desc").alias("activity_label"))


def activity_label_lookup(src: Tables) -> DataFrame:
    """Activity label per sku, by the five-column hierarchy key; NULL where there is none."""
    joined = src("merch_sku").join(activity_labels(src), ACTIVITY_KEYS, "left")
    return joined.select("product_key", "sku_key", "activity_label")


def sku_lookup(src: Tables, labels: Collection[str] = LABELS) -> DataFrame:
    """Everything the order line looks up by product and sku, as one table.

    All these joins hang on the product side only, so doing them here leaves a single join
    with the order lines instead of five. Only the asked-for labels are joined.
    """
    columns = ["product_key", "sku_key", "product", "shop_desc", "subclass_desc", "brand_desc", "color_family"]
    skus = src("merch_sku").join(src("merch_product"), ["product_key", "department_key"])
    if "digital_shop" in labels:
        shops = src("digital_shop").withColumnRenamed("digital_shop", "department_shop")
        skus = skus.join(shops, ["department_desc"], "left")
        skus = skus.withColumn("digital_shop", F.coalesce("department_shop", "shop_desc"))
    if "activity_product" in labels:
        skus = skus.join(product_activity(src), "product_key", "left")
    if "activity_label" in labels:
        skus = skus.join(activity_labels(src), ACTIVITY_KEYS, "left")
    return skus.select(*columns, *[label for label in LABELS if label in labels])


def kept_order_lines(src: Tables, p: Params) -> DataFrame:
    """Order lines in the window that pass the filters; NULL sku or flow drops out."""
    return (
        src("order_line")
        .where(F.col("order_date_key").between(p.start_key, p.end_key))
        .where(~F.col("sku").isin(*EXCLUDED_SKUS))
        .where(~F.col("order_flow_key").isin(*EXCLUDED_ORDER_FLOWS))
        .where(F.col("origination_channel_key").isin(*ORIGINATION_CHANNELS))
        .where(F.col("order_entry_group_key").isin(*ORDER_ENTRY_GROUPS))
        .where(F.col("order_entry_application_key") == ORDER_ENTRY_APPLICATION)
    )


def order_lines(src: Tables, p: Params, labels: Collection[str] = LABELS) -> DataFrame:
    """Order lines with all lookups, before the aggregation.

    The small lookups come first: they are broadcast and drop rows, so the two joins that may
    shuffle (sku and address) move fewer lines. The broadcast is asked for: by the size of what a
    lookup is made of, Catalyst would shuffle all lines by a key of a few values.
    """
    calendar = (
        src("calendar")
        .where(F.col("date_key").between(p.start_key, p.end_key))
        .select(F.col("date_key").alias("order_date_key"), "fiscal_date")
    )
    prices = src("price_sub_type").withColumnRenamed("price_sub_type_desc", "price_flag")
    geo = geo_lookup(src).drop("dma_geo_key").withColumnRenamed("address_key", "billto_address_key")

    lines = kept_order_lines(src, p).join(F.broadcast(calendar), ["order_date_key"])
    lines = lines.join(F.broadcast(src("order_flow")), ["order_flow_key"])
    lines = lines.join(F.broadcast(prices), ["price_sub_type_key"])
    lines = lines.join(sku_lookup(src, labels), ["product_key", "sku_key"])
    return join_nullable(lines, geo, "billto_address_key", F.col("order_id"))


def order_facts(src: Tables, p: Params) -> DataFrame:
    """Units, demand and cost over 19 keys."""
    return (
        order_lines(src, p)
        .groupBy(*FACT_KEYS)
        .agg(
            F.sum("line_qty").cast("bigint").alias("units"),
            F.sum(demand("net_amt", "current_corp_price", "cancelled_qty")).cast("decimal(18,2)").alias("demand"),
            F.sum(cost("cogs_flag", "line_qty", "adjusted_moving_average_price"))
            .cast("decimal(18,2)")
            .alias("cost"),
        )
    )


def orders_by(
    src: Tables, p: Params, key: str, grain: Sequence[str] = DEFAULT_GRAIN, facts: DataFrame | None = None
) -> DataFrame:
    """Distinct orders per region and one key.

    `facts` is the stored fact table. Without it the lines are used as they are: a distinct
    count does not see the 19-key aggregation, nor the fan-out of lookups it does not use.
    """
    rows = facts if facts is not None else order_lines(src, p, [key] if key in LABELS else [])
    return distinct_count(rows, [*grain, key], "order_id", "order_count")


def order_features_one_pass(src: Tables, p: Params, facts: DataFrame | None = None) -> DataFrame:
    """The five order roll-ups by region in one pass."""
    rows = facts if facts is not None else order_lines(src, p, [])
    return distinct_count_sets(rows, "dma_code", ORDER_KEYS, "order_id", "order_count")


ORDER_BIT_KEYS = ("fiscal_date", "dma_code", "cbsa_name", *ORDER_KEYS)


def order_bits(src: Tables, p: Params, facts: DataFrame | None = None) -> DataFrame:
    """Orders per day, region and the five keys as bitmaps: one table for all order roll-ups."""
    rows = facts if facts is not None else order_lines(src, p, [])
    return distinct_bits(rows, ORDER_BIT_KEYS, "order_id")


def geo_map(src: Tables, p: Params, facts: DataFrame | None = None) -> DataFrame:
    """Distinct region attributes that occur with an order, the empty block included."""
    rows = facts if facts is not None else order_lines(src, p, [])
    return rows.select(*GEO_COLUMNS).distinct()


def addresses_by_region_code(src: Tables) -> DataFrame:
    """Region codes as stored and as mapped, with the number of addresses."""
    regions = src("dma_geo_dim").select(
        "dma_geo_key", F.col("dma_code").alias("dma_code_text"), region_code(F.col("dma_code")).alias("region_code")
    )
    joined = src("address").join(regions, ["dma_geo_key"])
    return joined.groupBy("dma_code_text", "region_code").agg(F.count("*").alias("addresses"))
