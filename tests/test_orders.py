"""Hand-made rows for the traps of the order branch."""

from datetime import date
from decimal import Decimal

import pytest

from terrane.params import EXCLUDED_SKUS, Params
from terrane.plans import orders

P = Params(start_key=20240101, end_key=20240131, start_date=date(2024, 1, 1), end_date=date(2024, 1, 31))
LINE = (
    "order_id long, order_date_key int, product_key long, sku_key long, sku string, order_flow_key int, "
    "price_sub_type_key int, line_qty int, net_amt decimal(12,2), current_corp_price decimal(12,2), "
    "cancelled_qty int, cogs_flag int, adjusted_moving_average_price decimal(12,2), billto_address_key long, "
    "origination_channel_key int, order_entry_group_key int, order_entry_application_key int"
)


def line(**changes):
    row = {
        "order_id": 1,
        "order_date_key": 20240110,
        "product_key": 10,
        "sku_key": 100,
        "sku": "100",
        "order_flow_key": 1,
        "price_sub_type_key": 1,
        "line_qty": 2,
        "net_amt": Decimal("50.00"),
        "current_corp_price": Decimal("10.00"),
        "cancelled_qty": 1,
        "cogs_flag": 1,
        "adjusted_moving_average_price": Decimal("4.00"),
        "billto_address_key": 7,
        "origination_channel_key": 101,
        "order_entry_group_key": -2,
        "order_entry_application_key": 3,
    }
    row.update(changes)
    return tuple(row.values())


@pytest.fixture()
def build(spark):
    def make(lines, shops=(), products=((10, 1, "D1", "B"),), geos=((70, "501"),)):
        make_df = spark.createDataFrame
        tables = {
            "order_line": make_df(list(lines), LINE),
            "calendar": make_df(
                [(20240110, date(2024, 1, 10), 202312)], "date_key int, fiscal_date date, fiscal_month int"
            ),
            "merch_product": make_df(
                list(products), "product_key long, department_key int, department_desc string, brand_desc string"
            ),
            "merch_sku": make_df(
                [(10, 100, 1, "prod", "shop", "sub", "red", 1, 1, 1, 0), (11, 110, 9, "q", "shop", "sub", "red", 1, 1, 1, 1)],
                "product_key long, sku_key long, department_key int, product string, shop_desc string, "
                "subclass_desc string, color_family string, department_id int, class_id int, subclass_id int, dona_id int",
            ),
            "order_flow": make_df([(k, f"F{k}") for k in range(1, 13)], "order_flow_key int, order_flow_desc string"),
            "price_sub_type": make_df([(1, "reg")], "price_sub_type_key int, price_sub_type_desc string"),
            "digital_shop": make_df(list(shops), "department_desc string, digital_shop string"),
            "merch_sku_attribute": make_df(
                [(10, "FABRIC", "wool"), (10, "PRIMARY_ACTIVITY_CODE", "hike"), (11, "FABRIC", "wool")],
                "product_key long, attribute_name string, attribute_value string",
            ),
            "merch_hier_activity_xref": make_df(
                [("shop", 1, 1, 1, 0, "label")],
                "shop_desc string, department_id int, class_id int, subclass_id int, dona_id int, activity_desc string",
            ),
            "address": make_df([(7, 70), (8, 71), (9, 72)], "address_key long, dma_geo_key int"),
            "dma_geo_dim": make_df(
                [(k, code, f"N{k}", k, f"C{k}", f"Z{k}", f"S{k}") for k, code in geos],
                "dma_geo_key int, dma_code string, dma_name string, cbsa_code int, cbsa_name string, "
                "dma_zip_code string, state_name string",
            ),
            "dma_district": make_df(
                [(501, "s", "west"), (1, "none", "none")], "dma_code int, dma_short_desc string, district_name string"
            ),
        }
        return tables.__getitem__

    return make


def test_filters(build):
    src = build(
        [
            line(order_id=1),
            line(order_id=2, sku=None),
            line(order_id=3, sku=EXCLUDED_SKUS[2]),
            line(order_id=4, order_flow_key=8),
            line(order_id=5, order_flow_key=None),
            line(order_id=6, origination_channel_key=100),
            line(order_id=7, order_entry_group_key=9),
            line(order_id=8, order_entry_application_key=4),
            line(order_id=9, order_date_key=20240111),  # no calendar day
            line(order_id=10, product_key=11, sku_key=110),  # department mismatch
            line(order_id=11, order_date_key=20231231),
        ],
        products=((10, 1, "D1", "B"), (11, 1, "D1", "B")),
    )
    assert [r["order_id"] for r in orders.order_facts(src, P).collect()] == [1]


def test_sums(build):
    src = build(
        [
            line(),
            line(current_corp_price=None),
            line(cancelled_qty=None),  # out of the demand, not of units and cost
            line(cogs_flag=None),  # no cost
        ]
    )
    row = orders.order_facts(src, P).first()
    assert (row["units"], row["demand"], row["cost"]) == (8, Decimal("170.00"), Decimal("24.00"))
    assert (row["activity_product"], row["activity_label"], row["dma_code"]) == ("hike", "label", 501)


def test_two_shops_double_the_sums_but_not_the_orders(build):
    src = build([line()], shops=[("D1", "A"), ("D1", "B")])
    facts = orders.order_facts(src, P).collect()
    assert sorted((r["digital_shop"], r["units"]) for r in facts) == [("A", 2), ("B", 2)]
    assert orders.orders_by(src, P, "brand_desc").first()["order_count"] == 1
    lookup = orders.digital_shop_lookup(src).collect()
    assert [r["shop_rows"] for r in lookup] == [2, 2]


def test_null_or_absent_shop_falls_back_to_the_shop_description(build):
    for shops in ([("D1", None)], [("D2", "A")]):
        assert orders.order_facts(build([line()], shops=shops), P).first()["digital_shop"] == "shop"


def test_addresses_without_a_region_keep_their_orders(build):
    src = build(
        [line(order_id=i, billto_address_key=a) for i, a in enumerate((7, 8, 9, 99, None), start=1)],
        geos=((70, "UNK"), (71, None), (72, "999")),
    )
    found = {r["order_id"]: r["dma_code"] for r in orders.order_facts(src, P).collect()}
    assert found == {1: 1, 2: None, 3: None, 4: None, 5: None}
    assert [r["address_key"] for r in orders.geo_lookup(src).collect()] == [7]
    assert {r["dma_code"]: r["order_count"] for r in orders.orders_by(src, P, "brand_desc").collect()} == {1: 1, None: 4}
    assert orders.geo_map(src, P).count() == 2


def test_attribute_pivot_keeps_products_without_the_attribute(build):
    found = {r["product_key"]: r["activity_product"] for r in orders.product_activity(build([line()])).collect()}
    assert found == {10: "hike", 11: None}


def test_one_pass_equals_five_rollups(derived):
    p = Params(start_key=20240103, end_key=20240128, start_date=date(2024, 1, 3), end_date=date(2024, 1, 28))
    one = orders.order_features_one_pass(derived, p).collect()
    for key in orders.ORDER_KEYS:
        five = orders.orders_by(derived, p, key).collect()
        expected = sorted(str((r["dma_code"], r[key], r["order_count"])) for r in five)
        assert sorted(str((r["dma_code"], r["feature"], r["order_count"])) for r in one if r["family"] == key) == expected


def test_one_pass_tells_null_keys_from_left_out_keys(build):
    src = build([line(order_id=1), line(order_id=2)], products=((10, 1, "D1", None),))
    rows = {(r["family"], r["feature"]): r["order_count"] for r in orders.order_features_one_pass(src, P).collect()}
    assert rows[("brand_desc", None)] == 2 and len(rows) == 5


def test_stored_facts_give_the_same_counts(derived):
    p = Params(start_key=20240103, end_key=20240128, start_date=date(2024, 1, 3), end_date=date(2024, 1, 28))
    facts = orders.order_facts(derived, p).persist()
    for key in ("brand_desc", "activity_label"):
        a, b = orders.orders_by(derived, p, key), orders.orders_by(derived, p, key, facts=facts)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    facts.unpersist()
