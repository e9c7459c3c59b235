"""Hand-made rows for the traps of the session branch."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from terrane.functions.expressions import nav_theme, null_search_flag, region_code
from terrane.params import Params
from terrane.plans import sessions

P = Params(start_key=20240101, end_key=20240131, start_date=date(2024, 1, 1), end_date=date(2024, 1, 31))

SEARCH = (
    "session_search_date_key int, visitor_key long, session_key long, site_id string, page_name string, "
    "page_name_key int, page_template string, clickstream_visit_page_num int, "
    "user_search_results_returned_count int, navigation_search_term string, user_search_term string, "
    "breadcrumb string, search_refinement_type string, navigation_category_type string"
)


def search_row(**changes):
    row = {
        "session_search_date_key": 20240110,
        "visitor_key": 1,
        "session_key": 100,
        "site_id": "main",
        "page_name": "p",
        "page_name_key": 1,
        "page_template": "nav_search",
        "clickstream_visit_page_num": 1,
        "user_search_results_returned_count": 5,
        "navigation_search_term": "boots",
        "user_search_term": "boots",
        "breadcrumb": "shoes|boots",
        "search_refinement_type": None,
        "navigation_category_type": "cat",
    }
    row.update(changes)
    return tuple(row.values())


@pytest.fixture()
def build(spark):
    def make(searches, bots=(), regions=(), days=((20240110, 202312), (20240111, 202312))):
        tables = {
            "session_search": spark.createDataFrame(list(searches), SEARCH),
            "calendar": spark.createDataFrame(list(days), "date_key int, fiscal_month int"),
            "clickstream_session_bot": spark.createDataFrame(
                list(bots), "session_key long, session_bot_flag int, session_start_date date"
            ),
            "session": spark.createDataFrame(
                list(regions), "visitor_key long, session_start_date_key int, dma_code int, cbsa_name string"
            ),
        }
        return tables.__getitem__

    return make


def kept(src, column="visitor_key"):
    return sorted(r[column] for r in sessions.search_sessions(src, P).collect())


def test_either_term_keeps_a_row_and_null_does_not_block(build):
    src = build(
        [
            search_row(visitor_key=1, navigation_search_term=None, user_search_term="x"),
            search_row(visitor_key=2, navigation_search_term="x", user_search_term=None),
            search_row(visitor_key=3, navigation_search_term=None, user_search_term=""),
            search_row(visitor_key=4, navigation_search_term="", user_search_term=""),
            search_row(visitor_key=5, navigation_search_term=None, user_search_term=None),
        ]
    )
    assert kept(src) == [1, 2]


def test_filters_drop_other_rows(build):
    src = build(
        [
            search_row(visitor_key=1),
            search_row(visitor_key=2, navigation_category_type="brand"),
            search_row(visitor_key=3, navigation_category_type=None),
            search_row(visitor_key=4, page_template="product"),
            search_row(visitor_key=5, page_name=""),
            search_row(visitor_key=6, page_name=None),
            search_row(visitor_key=7, session_search_date_key=20240115),  # no calendar day
            search_row(visitor_key=8, session_search_date_key=20230110),
        ]
    )
    assert kept(src) == [1]


def test_exact_copies_count_once(build):
    assert kept(build([search_row()] * 3)) == [1]


def test_only_bots_that_start_in_the_window_are_excluded(build):
    src = build(
        [search_row(visitor_key=v, session_key=k) for v, k in ((1, 100), (2, 200), (3, 300), (4, None))],
        bots=[
            (100, 1, date(2024, 1, 10)),
            (100, 1, date(2024, 1, 11)),
            (200, 0, date(2024, 1, 10)),
            (300, 1, date(2023, 12, 31)),
            (None, 1, date(2024, 1, 10)),
        ],
    )
    assert kept(src) == [2, 3, 4]


def test_anti_join_equals_left_join_with_null_test(derived):
    p = Params(start_key=20240103, end_key=20240128, start_date=date(2024, 1, 3), end_date=date(2024, 1, 28))
    rows = sessions.search_rows(derived, p).distinct()
    bots = sessions.bot_sessions(derived, p).withColumn("is_bot", F.lit(1))
    long_way = rows.join(bots, "session_key", "left").where(F.col("is_bot").isNull()).select(*rows.columns)
    short_way = sessions.search_sessions(derived, p)
    assert short_way.exceptAll(long_way).isEmpty() and long_way.exceptAll(short_way).isEmpty()


@pytest.mark.parametrize(
    ("crumb", "term", "theme"),
    [
        ("a|b", " t ", "a"),
        ("|b", " t ", ""),
        (" a |b", " t ", " a "),
        (" a ", " t ", " a "),
        ("", " t ", "t"),
        (None, " t ", "t"),
        (None, "\tt ", "\tt"),
        ("", None, None),
        ("a|b|c", None, "a"),
    ],
)
def test_theme(spark, crumb, term, theme):
    df = spark.createDataFrame([(crumb, term)], "crumb string, term string")
    assert df.select(nav_theme("crumb", "term")).first()[0] == theme


@pytest.mark.parametrize(("count", "flag"), [(None, 1), (0, 1), (1, 0), (-1, 1)])
def test_null_search_flag(spark, count, flag):
    df = spark.createDataFrame([(count,)], "n int")
    assert df.select(null_search_flag("n")).first()[0] == flag


def test_region_code(spark):
    df = spark.createDataFrame([("N/A",), ("UNK",), (None,), ("501",)], "c string")
    assert [r[0] for r in df.select(region_code(F.col("c"))).collect()] == [1, 1, None, 501]
    bad = spark.createDataFrame([("x1",)], "c string")
    assert bad.select(region_code(F.col("c"), lenient=True)).first()[0] is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        bad.select(region_code(F.col("c"))).collect()


def test_only_the_total_keeps_visitors_without_a_session(build):
    src = build(
        [search_row(visitor_key=v, session_key=v, site_id="outlet") for v in (1, 2, 3)],
        regions=[(1, 20240110, 501, "A"), (2, 20240110, None, None)],
    )
    total = {r["dma_code"]: r["visitor_count_total"] for r in sessions.visitors_by_geo(src, P).collect()}
    themes = {r["dma_code"]: r["visitor_count"] for r in sessions.nav_theme_visitors_by_geo(src, P).collect()}
    outlet = {r["dma_code"]: r["visitor_count"] for r in sessions.outlet_visitors_by_geo(src, P).collect()}
    assert total == {501: 1, None: 2}
    assert themes == {501: 1, None: 1}
    assert outlet == {501: 1, None: 1}


def test_a_visitor_with_two_regions_counts_in_both(build):
    src = build(
        [search_row(visitor_key=1), search_row(visitor_key=None, session_key=7)],
        regions=[(1, 20240110, 501, "A"), (1, 20240110, 502, "B"), (1, 20240110, 502, "B")],
    )
    total = {r["dma_code"]: r["visitor_count_total"] for r in sessions.visitors_by_geo(src, P).collect()}
    assert total == {501: 1, 502: 1, None: 0}  # a NULL visitor makes a group but is not counted


def test_stored_and_derived_sessions_give_the_same_counts(derived):
    p = Params(start_key=20240103, end_key=20240128, start_date=date(2024, 1, 3), end_date=date(2024, 1, 28))
    stored = sessions.search_sessions(derived, p)
    for rollup in (sessions.visitors_by_geo, sessions.nav_theme_visitors_by_geo, sessions.outlet_visitors_by_geo):
        a, b = rollup(derived, p), rollup(derived, p, sessions=stored)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_literal_and_subquery_window_agree(derived):
    p = Params(start_key=20240103, end_key=20240128)
    literal = (
        derived("session_search")
        .where(F.col("session_search_date_key").between(p.start_key, p.end_key))
        .groupBy("session_search_date_key")
        .agg(F.count("*").alias("search_rows"))
    )
    by_subquery = sessions.sessions_in_window_by_subquery(derived, p)
    assert sorted(map(str, literal.collect())) == sorted(map(str, by_subquery.collect()))
