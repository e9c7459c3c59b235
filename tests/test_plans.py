"""The plans are the ones meant for large inputs."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from checks import oracles, queries
from checks.compare import duckdb_rows, rows_of
from terrane.operators import joins, nmf
from terrane.params import Params
from terrane.plans import features, orders, segments, sessions
from terrane.session import shared_folder
from terrane.sources.tables import SOURCE_TABLES, parquet_tables
from tests.conftest import SF_DIR

P = Params(start_key=20240103, end_key=20240128, start_date=date(2024, 1, 3), end_date=date(2024, 1, 28))


@pytest.fixture(autouse=True)
def whole_plan_text(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, derived, tmp_path_factory):
    """The source tables as plain Parquet folders, as a warehouse would hold them."""
    root = str(tmp_path_factory.mktemp("sources"))
    for table in SOURCE_TABLES:
        derived(table).write.parquet(f"{root}/{table}")
    return parquet_tables(spark, root)


def test_filters_and_columns_reach_the_scan(stored):
    plan = plan_of(sessions.visitors_by_geo(stored, P))
    assert "GreaterThanOrEqual(session_search_date_key,20240103)" in plan
    assert "LessThanOrEqual(session_search_date_key,20240128)" in plan
    assert "EqualTo(page_template,nav_search)" in plan
    assert "GreaterThanOrEqual(session_start_date_key,20240103)" in plan
    assert "clickstream_visit_page_num" not in plan and "breadcrumb" not in plan
    plan = plan_of(orders.orders_by(stored, P, "brand_desc"))
    assert "LessThanOrEqual(order_date_key,20240128)" in plan and "net_amt" not in plan
    assert "digital_shop" not in plan and "merch_sku_attribute" not in plan


def test_bounds_read_from_a_table_reach_the_scan(stored):
    plan = plan_of(sessions.sessions_in_window_by_subquery(stored, P))
    assert "session_search_date_key" in plan and "PushedFilters" in plan


def test_no_all_pairs_joins(stored, derived):
    for src in (stored, derived):
        for df in (
            sessions.search_sessions(src, P),
            sessions.nav_theme_visitors_by_geo(src, P),
            orders.order_facts(src, P),
            orders.order_features_one_pass(src, P),
        ):
            plan = plan_of(df)
            assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_anti_join_is_planned_as_such(stored):
    assert "LeftAnti" in plan_of(sessions.search_sessions(stored, P))


@pytest.fixture()
def no_auto_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_plans_are_built_without_jobs(spark, derived):
    """No job measures a table before the action; what is small shows at run time."""
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "plans only")
    try:
        sessions.search_sessions(derived, P)
        orders.order_facts(derived, P)
        orders.orders_by(derived, P, "brand_desc")
        assert list(jobs.getJobIdsForGroup("planning")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_null_keys_are_spread_and_kept(spark, no_auto_broadcast):
    fact = spark.range(4000).select(F.when(F.col("id") % 4 == 0, F.col("id") % 8).alias("k"), "id")
    dim = spark.range(5).select(F.col("id").alias("k"), F.col("id").alias("found"))
    joined = joins.join_nullable(fact, dim, "k", F.col("id"))
    assert joined.count() == 4000
    assert joined.where("found IS NULL").count() == 3000
    assert sorted(joined.columns) == ["found", "id", "k"]
    plan = plan_of(joined)
    assert "Exchange hashpartitioning(k" in plan
    shuffled = [text for text in plan.splitlines() if "Exchange hashpartitioning(k" in text]
    assert all("_salt" in text for text in shuffled)


@pytest.mark.parametrize("threshold", ["-1", str(64 << 20)])
@pytest.mark.parametrize(
    "name", ["search_sessions", "nav_theme_visitors_by_geo", "order_facts", "feature_shares", "cluster_metrics"]
)
def test_results_do_not_depend_on_the_join_strategy(spark, no_auto_broadcast, name, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    df = queries.registered()[name](spark, SF_DIR)
    _, expected = duckdb_rows(SF_DIR, oracles.texts()[name])
    assert rows_of(df.columns, df.collect()) == expected


def test_top_features_are_cut_before_the_shuffle(spark):
    rows = spark.range(100).select(F.concat(F.lit("f"), "id").alias("label"), *[F.rand(i).alias(f"w{i}") for i in range(2)])
    top = segments.theme_top_features(nmf.Factors(rows, rows, ()), Params(nmf_rank=2, themes_top=3))
    assert plan_of(top).count("WindowGroupLimit") == 2 and top.count() == 6


def test_shared_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = shared_folder(spark)
    assert folder == (named or spark.sparkContext.getCheckpointDir())


def test_weights_are_drawn_once_a_unit(derived):
    """In the grouping by unit, and not once for each entry of a unit."""
    found = features.share_intervals(derived, queries.PARAMS, 3)
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    drawn = [i for i, line in enumerate(lines) if "md5(" in line]
    assert drawn and all("Aggregate [unit#" in lines[i] for i in drawn)


def test_no_shuffle_by_the_few_values_of_a_small_lookup(stored, derived, spark):
    """Where the estimates are beyond the broadcast threshold, as they are at size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for src in (stored, derived):
            plan = plan_of(features.feature_long(src, P))
            for key in ("order_date_key", "order_flow_key", "price_sub_type_key", "session_search_date_key"):
                assert not re.search(rf"Exchange hashpartitioning\({key}#\d+, \d+\), ENSURE", plan), key
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
