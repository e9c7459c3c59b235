"""Clickstream branch: cleaned search sessions and visitor counts per region."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.expressions import has_text, nav_theme, null_search_flag
from terrane.operators.bitmaps import distinct_bits
from terrane.operators.rollup import distinct_count
from terrane.params import CATEGORY_TYPES, OUTLET_SITE, SEARCH_TEMPLATE, Params
from terrane.sources.tables import Tables

SESSION_COLUMNS = (
    "session_search_date_key",
    "visitor_key",
    "fiscal_month",
    "session_key",
    "site_id",
    "page_name",
    "page_name_key",
    "page_template",
    "clickstream_visit_page_num",
    "user_search_results_returned_count",
    "nav_search_term",
    "nav_breadcrumb",
    "search_refinement_type",
    "null_search_flag",
)
DEFAULT_GRAIN = ("dma_code",)


def bot_sessions(src: Tables, p: Params) -> DataFrame:
    """Keys of sessions flagged as bots that started inside the window."""
    return (
        src("clickstream_session_bot")
        .where(F.col("session_bot_flag") == 1)
        .where(F.col("session_start_date").between(F.lit(p.start_date), F.lit(p.end_date)))
        .select("session_key")
        .distinct()
    )


def without_bots(df: DataFrame, src: Tables, p: Params) -> DataFrame:
    """Rows whose session is no bot; rows without a session key stay."""
    return df.join(bot_sessions(src, p), "session_key", "left_anti")


def human_sessions(src: Tables, p: Params) -> DataFrame:
    """Search rows per session that is no bot. Counted first, so the anti join sees one row a session."""
    counted = src("session_search").groupBy("session_key", "visitor_key").agg(F.count("*").alias("search_rows"))
    return without_bots(counted, src, p)


def search_rows(src: Tables, p: Params) -> DataFrame:
    """Search rows in the window that pass the filters, with theme and flag, before deduplication."""
    calendar = (
        src("calendar")
        .where(F.col("date_key").between(p.start_key, p.end_key))
        .select(F.col("date_key").alias("session_search_date_key"), "fiscal_month")
    )
    kept = (
        src("session_search")
        .where(F.col("session_search_date_key").between(p.start_key, p.end_key))
        .where(has_text("navigation_search_term") | has_text("user_search_term"))
        .where(F.col("navigation_category_type").isin(*CATEGORY_TYPES))
        .where(F.col("page_template") == SEARCH_TEMPLATE)
        .where(has_text("page_name"))
        .withColumn("nav_search_term", F.trim("navigation_search_term"))
        .withColumn("nav_breadcrumb", nav_theme("breadcrumb", "navigation_search_term"))
        .withColumn("null_search_flag", null_search_flag("user_search_results_returned_count"))
    )
    # A row a day: asked for, as a shuffle by day would send all rows to as many tasks as there are days.
    return kept.join(F.broadcast(calendar), ["session_search_date_key"]).select(*SESSION_COLUMNS)


def search_sessions(src: Tables, p: Params, columns: Sequence[str] = SESSION_COLUMNS) -> DataFrame:
    """Distinct cleaned session rows without bots, over all columns or only those asked for.

    The distinct comes first: its map-side combine removes copies before any shuffle, so the
    anti join meets each copy once. A distinct count over fewer columns gives the same result
    as one over all, and shuffles less.
    """
    needed = list(dict.fromkeys([*columns, "session_key"]))
    return without_bots(search_rows(src, p).select(*needed).distinct(), src, p).select(*columns)


def session_regions(src: Tables, p: Params, grain: Sequence[str]) -> DataFrame:
    """Region of each visitor and day; several regions a day stay several rows."""
    return (
        src("session")
        .where(F.col("session_start_date_key").between(p.start_key, p.end_key))
        .select(
            "visitor_key",
            F.col("session_start_date_key").alias("session_search_date_key"),
            *grain,
        )
        .distinct()
    )


def with_region(
    sessions: DataFrame, src: Tables, p: Params, grain: Sequence[str], how: str, mark: str | None = None
) -> DataFrame:
    """Attach the region columns to session rows; `mark` names a flag for matched rows."""
    regions = session_regions(src, p, [g for g in grain if g != "fiscal_month"])
    if mark:
        regions = regions.withColumn(mark, F.lit(True))
    return sessions.join(regions, ["visitor_key", "session_search_date_key"], how)


def _session_columns(grain: Sequence[str], extra: Sequence[str] = ()) -> list[str]:
    month = [g for g in grain if g == "fiscal_month"]
    return ["visitor_key", "session_search_date_key", *month, *extra]


def _cleaned(
    src: Tables, p: Params, sessions: DataFrame | None, grain: Sequence[str], extra: Sequence[str] = ()
) -> DataFrame:
    columns = _session_columns(grain, extra)
    if sessions is None:
        return search_sessions(src, p, columns)
    return sessions.select(*columns).distinct()


def visitors_by_geo(
    src: Tables, p: Params, grain: Sequence[str] = DEFAULT_GRAIN, sessions: DataFrame | None = None
) -> DataFrame:
    """Distinct visitors per region; visitors without a session row count in the NULL region.

    `sessions` is the stored session table; without it the rows are derived on the way.
    """
    located = with_region(_cleaned(src, p, sessions, grain), src, p, grain, "left")
    return distinct_count(located, grain, "visitor_key", "visitor_count_total")


def nav_theme_visitors_by_geo(
    src: Tables, p: Params, grain: Sequence[str] = DEFAULT_GRAIN, sessions: DataFrame | None = None
) -> DataFrame:
    """Distinct visitors per region and navigation theme, located visitors only."""
    rows = _cleaned(src, p, sessions, grain, ["nav_breadcrumb"])
    located = with_region(rows, src, p, grain, "inner").withColumnRenamed("nav_breadcrumb", "nav_theme")
    return distinct_count(located, [*grain, "nav_theme"], "visitor_key", "visitor_count")


def outlet_visitors_by_geo(
    src: Tables, p: Params, grain: Sequence[str] = DEFAULT_GRAIN, sessions: DataFrame | None = None
) -> DataFrame:
    """Distinct visitors per region on the outlet site, located visitors only."""
    rows = _cleaned(src, p, sessions, grain, ["site_id"]).where(F.col("site_id") == OUTLET_SITE)
    located = with_region(rows, src, p, grain, "inner")
    return distinct_count(located, [*grain, "site_id"], "visitor_key", "visitor_count")


BIT_KEYS = ("session_search_date_key", "fiscal_month", "dma_code", "cbsa_name", "nav_theme", "site_id", "located")


def visitor_bits(src: Tables, p: Params, sessions: DataFrame | None = None) -> DataFrame:
    """Visitors per day, region, theme and site as bitmaps: one table for all visitor roll-ups.

    `located` is null for visitors without a session row for the day; themes and sites count only where it is not.
    """
    grain = ("dma_code", "cbsa_name")
    rows = _cleaned(src, p, sessions, ["fiscal_month"], ["nav_breadcrumb", "site_id"])
    placed = with_region(rows, src, p, grain, "left", mark="located").withColumnRenamed("nav_breadcrumb", "nav_theme")
    return distinct_bits(placed, BIT_KEYS, "visitor_key")


def sessions_in_window_by_subquery(src: Tables, p: Params) -> DataFrame:
    """Search rows per day, the window bounds read from a one-row table by scalar subqueries."""
    searches = src("session_search")
    bounds = run_window(searches.sparkSession, p)
    return searches.sparkSession.sql(
        """
        SELECT session_search_date_key, count(*) AS search_rows
        FROM {searches}
        WHERE session_search_date_key BETWEEN (SELECT start_key FROM {bounds}) AND (SELECT end_key FROM {bounds})
        GROUP BY session_search_date_key
        """,
        searches=searches,
        bounds=bounds,
    )


def run_window(spark, p: Params) -> DataFrame:
    """The window as a one-row table: integer keys and ISO dates as text."""
    return spark.range(1).select(
        F.lit(p.start_key).alias("start_key"),
        F.lit(p.end_key).alias("end_key"),
        F.lit(p.start_date.isoformat()).alias("start_date"),
        F.lit(p.end_date.isoformat()).alias("end_date"),
    )
