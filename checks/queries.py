"""Every registered query: a function of (spark, sf_dir) that returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.expressions import nav_theme, null_search_flag
from terrane.operators import bitmaps, clusters, kmeans, matching, neighbours, nmf, tsne
from terrane.params import Params
from terrane.plans import features, orders, refresh, run, segments, sessions
from terrane.session import Workspace
from terrane.sources.derived import DerivedTables

PARAMS = Params(start_key=20240103, end_key=20240128, start_date=date(2024, 1, 3), end_date=date(2024, 1, 28))

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def rounded(column: str | Column, digits: int = 6) -> Column:
    """Rounded for comparison; adding 0 turns -0.0 into 0.0."""
    return F.round(column, digits) + F.lit(0.0)


def query(build: Callable[[SparkSession, DerivedTables], DataFrame]) -> Query:
    """Register a function of the session and the derived tables under its own name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(spark, DerivedTables(spark, sf_dir))

    _QUERIES[build.__name__] = run
    return run


def registered() -> dict[str, Query]:
    return dict(_QUERIES)


# --- sessions ---


@query
def run_params(spark, src):
    """The window, with the rows of both facts that fall into it."""
    p = PARAMS
    searches = src("session_search").where(F.col("session_search_date_key").between(p.start_key, p.end_key))
    lines = src("order_line").where(F.col("order_date_key").between(p.start_key, p.end_key))
    counted = searches.select(F.lit(1).alias("search"), F.lit(0).alias("line")).unionAll(
        lines.select(F.lit(0).alias("search"), F.lit(1).alias("line"))
    )
    return counted.agg(F.sum("search").alias("search_rows"), F.sum("line").alias("order_lines")).select(
        F.lit(p.start_key).alias("start_key"),
        F.lit(p.end_key).alias("end_key"),
        F.lit(p.start_date.isoformat()).alias("start_date"),
        F.lit(p.end_date.isoformat()).alias("end_date"),
        "search_rows",
        "order_lines",
    )


@query
def bot_sessions(spark, src):
    return sessions.bot_sessions(src, PARAMS)


@query
def human_sessions(spark, src):
    return sessions.human_sessions(src, PARAMS)


@query
def nav_theme_expr(spark, src):
    """Search rows per combination of breadcrumb, term and derived theme."""
    return (
        src("session_search")
        .groupBy(
            "breadcrumb",
            "navigation_search_term",
            F.trim("navigation_search_term").alias("nav_search_term"),
            nav_theme("breadcrumb", "navigation_search_term").alias("nav_theme"),
        )
        .agg(F.count("*").alias("search_rows"))
    )


@query
def null_search_expr(spark, src):
    return (
        src("session_search")
        .groupBy(
            "user_search_results_returned_count",
            null_search_flag("user_search_results_returned_count").alias("null_search_flag"),
        )
        .agg(F.count("*").alias("search_rows"))
    )


@query
def search_sessions(spark, src):
    return sessions.search_sessions(src, PARAMS)


@query
def window_filter_subquery(spark, src):
    return sessions.sessions_in_window_by_subquery(src, PARAMS)


@query
def visitors_by_geo(spark, src):
    return sessions.visitors_by_geo(src, PARAMS)


@query
def nav_theme_visitors_by_geo(spark, src):
    return sessions.nav_theme_visitors_by_geo(src, PARAMS)


@query
def outlet_visitors_by_geo(spark, src):
    return sessions.outlet_visitors_by_geo(src, PARAMS)


@query
def visitors_by_geo_month(spark, src):
    return sessions.visitors_by_geo(src, PARAMS, ["dma_code", "fiscal_month"])


@query
def visitors_by_cbsa(spark, src):
    return sessions.visitors_by_geo(src, PARAMS, ["cbsa_name"])


@query
def nav_theme_visitors_by_cbsa_month(spark, src):
    return sessions.nav_theme_visitors_by_geo(src, PARAMS, ["cbsa_name", "fiscal_month"])


@query
def outlet_visitors_by_cbsa_month(spark, src):
    return sessions.outlet_visitors_by_geo(src, PARAMS, ["cbsa_name", "fiscal_month"])


def _stored_visitor_bits(spark, src) -> DataFrame:
    return Workspace(spark, "bits").save(sessions.visitor_bits(src, PARAMS), "visitors")


@query
def visitors_by_geo_from_bits(spark, src):
    """The roll-ups below come from one stored table of bitmaps per day, region, theme and site."""
    return bitmaps.rolled_up(_stored_visitor_bits(spark, src), ["dma_code"], "visitor_count_total")


@query
def visitors_by_geo_month_from_bits(spark, src):
    return bitmaps.rolled_up(_stored_visitor_bits(spark, src), ["dma_code", "fiscal_month"], "visitor_count_total")


@query
def nav_theme_visitors_by_geo_from_bits(spark, src):
    return bitmaps.rolled_up(_stored_visitor_bits(spark, src).where("located"), ["dma_code", "nav_theme"], "visitor_count")


@query
def outlet_visitors_by_cbsa_month_from_bits(spark, src):
    bits = _stored_visitor_bits(spark, src).where("located AND site_id = 'outlet'")
    return bitmaps.rolled_up(bits, ["cbsa_name", "fiscal_month", "site_id"], "visitor_count")


# --- orders ---


@query
def region_code_expr(spark, src):
    return orders.addresses_by_region_code(src)


@query
def geo_lookup(spark, src):
    return orders.geo_lookup(src)


@query
def product_activity(spark, src):
    return orders.product_activity(src)


@query
def digital_shop_lookup(spark, src):
    return orders.digital_shop_lookup(src)


@query
def activity_label_lookup(spark, src):
    return orders.activity_label_lookup(src)


@query
def order_facts(spark, src):
    return orders.order_facts(src, PARAMS)


@query
def subclass_orders_by_geo(spark, src):
    return orders.orders_by(src, PARAMS, "subclass_desc")


@query
def brand_orders_by_geo(spark, src):
    return orders.orders_by(src, PARAMS, "brand_desc")


@query
def flow_orders_by_geo(spark, src):
    return orders.orders_by(src, PARAMS, "order_flow_desc")


@query
def price_orders_by_geo(spark, src):
    return orders.orders_by(src, PARAMS, "price_flag")


@query
def color_orders_by_geo(spark, src):
    return orders.orders_by(src, PARAMS, "color_family")


@query
def activity_orders_by_geo(spark, src):
    return orders.orders_by(src, PARAMS, "activity_label")


@query
def brand_orders_by_cbsa(spark, src):
    return orders.orders_by(src, PARAMS, "brand_desc", ["cbsa_name"])


@query
def subclass_orders_by_dma_name(spark, src):
    return orders.orders_by(src, PARAMS, "subclass_desc", ["dma_code", "dma_name", "dma_short_desc"])


@query
def order_features_one_pass(spark, src):
    return orders.order_features_one_pass(src, PARAMS)


@query
def brand_orders_by_cbsa_from_bits(spark, src):
    bits = Workspace(spark, "bits").save(orders.order_bits(src, PARAMS), "orders")
    return bitmaps.rolled_up(bits, ["cbsa_name", "brand_desc"], "order_count")


@query
def color_orders_by_geo_from_bits(spark, src):
    bits = Workspace(spark, "bits").save(orders.order_bits(src, PARAMS), "orders")
    return bitmaps.rolled_up(bits, ["dma_code", "color_family"], "order_count")


@query
def geo_map(spark, src):
    return orders.geo_map(src, PARAMS)


# --- refresh ---


def _content(table: DataFrame) -> DataFrame:
    """Rows and a checksum that SQL repeats: the sum of the first 32 bits of each row's MD5."""
    texts = []
    for name, kind in sorted(table.dtypes):
        value = F.col(name) * 100 if kind.startswith("decimal") else F.col(name)
        text = (value.cast("bigint") if kind.startswith("decimal") else value).cast("string")
        texts.append(F.coalesce(text, F.lit("~")))
    number = F.conv(F.substring(F.md5(F.concat_ws("|", *texts)), 1, 8), 16, 10).cast("bigint")
    return table.agg(F.count("*").alias("row_count"), F.coalesce(F.sum(number), F.lit(0)).alias("checksum"))


@query
def refresh_tables(spark, src):
    """Rows and content of each of the 12 tables after a full refresh, read back."""
    sink = refresh.FolderSink(spark, Workspace(spark, "refresh").root)
    contents = None
    for name, table in refresh.refresh_tables(src, PARAMS, sink).items():
        content = _content(table).select(F.lit(name).alias("table_name"), "row_count", "checksum")
        contents = content if contents is None else contents.unionAll(content)
    return contents


@query
def refresh_status(spark, src):
    """Freshness after a recorded state: unchanged, another window, a dimension emptied, a late row with an old date."""
    sink = refresh.FolderSink(spark, Workspace(spark, "status").root)
    sink.replace("refresh_state", spark.createDataFrame(refresh.source_state(src, PARAMS), refresh.STATE))
    late = src("order_line").orderBy("order_date_key", "order_id", "sku_key").limit(1)
    changed = {
        "unchanged": (src, PARAMS),
        "window": (src, replace(PARAMS, end_key=20240110, end_date=date(2024, 1, 10))),
        "dimension": (lambda t: src(t).limit(0) if t == "dma_district" else src(t), PARAMS),
        "late row": (lambda t: src(t).unionByName(late) if t == "order_line" else src(t), PARAMS),
    }
    union = None
    for case, (tables, params) in changed.items():
        status = refresh.refresh_status(tables, params, sink).select(F.lit(case).alias("change"), "*")
        union = status if union is None else union.unionAll(status)
    return union


# --- features ---


@query
def feature_long(spark, src):
    return features.feature_long(src, PARAMS)


@query
def feature_matrix(spark, src):
    """The wide matrix, its columns turned to rows for comparison: SQL cannot name columns that the data decide."""
    long = Workspace(spark, "matrix").save(features.feature_long(src, PARAMS), "feature_long")
    wide = features.feature_matrix(long)
    return wide.unpivot("geo", [c for c in wide.columns if c != "geo"], "name", "value")


def _shares(spark, src) -> tuple[DataFrame, Workspace]:
    ws = Workspace(spark, "model")
    return features.stored_shares(src, PARAMS, ws), ws


@query
def feature_shares(spark, src):
    shares, _ = _shares(spark, src)
    return shares.withColumn("value", rounded("value"))


# --- model ---


@query
def nmf_step(spark, src):
    """Both factors after one round, as rows."""
    shares, ws = _shares(spark, src)
    factors = nmf.factorise(segments.model_cells(shares), "geo", "label", PARAMS.nmf_rank, 1, 1, ws)
    w = segments.themes_long(factors.w.withColumn("geo", F.col("geo").cast("string")), "geo", PARAMS.nmf_rank)
    h = segments.themes_long(factors.h, "label", PARAMS.nmf_rank)
    rows = w.select(F.lit("region").alias("side"), F.col("geo").alias("key"), "theme", "weight").unionAll(
        h.select(F.lit("feature").alias("side"), F.col("label").alias("key"), "theme", "weight")
    )
    return rows.withColumn("weight", rounded("weight"))


@query
def nmf_factors(spark, src):
    """Theme weights per region of the settled fit."""
    shares, ws = _shares(spark, src)
    w = segments.settled_factors(shares, PARAMS, ws).w
    return segments.themes_long(w, "geo", PARAMS.nmf_rank).withColumn("weight", rounded("weight"))


@query
def nmf_loss(spark, src):
    """Squared error before the first and after each round."""
    shares, ws = _shares(spark, src)
    losses = segments.theme_factors(shares, PARAMS, ws, trace=True).losses
    return spark.createDataFrame(list(enumerate(losses)), "round int, loss double").withColumn("loss", rounded("loss"))


@query
def theme_top_features(spark, src):
    shares, ws = _shares(spark, src)
    top = segments.theme_top_features(segments.settled_factors(shares, PARAMS, ws), PARAMS)
    return top.withColumn("weight", rounded("weight"))


def _points(spark, src) -> tuple[DataFrame, list[str], Workspace]:
    shares, ws = _shares(spark, src)
    coords = nmf.components(PARAMS.nmf_rank)
    points = segments.region_points(segments.settled_factors(shares, PARAMS, ws))
    return neighbours.distinct_points(points, coords), coords, ws


def _neighbours(spark, src) -> DataFrame:
    points, coords, ws = _points(spark, src)
    return neighbours.nearest_neighbours(points, coords, round(3 * PARAMS.perplexity), ws)


@query
def nearest_regions(spark, src):
    """Each region's nearest regions by theme weights."""
    return _neighbours(spark, src).withColumn("distance", rounded("distance"))


@query
def tsne_affinities(spark, src):
    """Weights of each region's neighbours at the set perplexity."""
    conditional = tsne.conditional_affinities(_neighbours(spark, src), PARAMS.perplexity)
    return conditional.withColumn("p", rounded("p"))


def _new_layout(spark, src) -> tuple[DataFrame, Workspace]:
    shares, ws = _shares(spark, src)
    return segments.layout(segments.settled_factors(shares, PARAMS, ws), PARAMS, ws), ws


@query
def tsne_2d(spark, src):
    return _new_layout(spark, src)[0]


@query
def kmeans_segments(spark, src):
    placed, ws = _new_layout(spark, src)
    return segments.segment_labels(placed, PARAMS, ws)


def _theme_points(spark, src) -> tuple[DataFrame, Workspace]:
    shares, ws = _shares(spark, src)
    points = segments.region_points(segments.settled_factors(shares, PARAMS, ws))
    return ws.save(kmeans.as_points(points, nmf.components(PARAMS.nmf_rank)), "theme_points"), ws


def _centre_rows(spark, centres: kmeans.Centres) -> DataFrame:
    rows = [(s, i, x) for s, centre in enumerate(centres[0, 0]) for i, x in enumerate(centre)]
    return spark.createDataFrame(rows, "segment int, theme int, value double").withColumn("value", rounded("value"))


_FIT = [kmeans.Fit(0, 0, PARAMS.segments, PARAMS.seed)]


@query
def kmeans_step(spark, src):
    """Centres in theme space after the start was drawn and moved once."""
    points, _ = _theme_points(spark, src)
    return _centre_rows(spark, kmeans.moved_centres(points, _FIT, kmeans.start_centres(points, _FIT))[0])


@query
def kmeans_themes(spark, src):
    """Segments of the regions by k-means on their theme weights, settled."""
    shares, ws = _shares(spark, src)
    return segments.theme_labels(segments.settled_factors(shares, PARAMS, ws), PARAMS, ws)


@query
def segment_count_gap(spark, src):
    """Gap statistic of the regions on their two leading theme weights."""
    shares, ws = _shares(spark, src)
    points = segments.region_points(segments.settled_factors(shares, PARAMS, ws))
    leading = points.select("id", F.col("w0").alias("x"), F.col("w1").alias("y"))
    found = segments.segment_count_gap(ws.save(leading, "leading"), PARAMS, ws)
    return found.withColumns({c: rounded(c) for c in ("cost", "gap", "error")})


@query
def new_region_segments(spark, src):
    """Every fifth region left out of the fit and given a segment afterwards."""
    shares, ws = _shares(spark, src)
    fitted = ws.save(shares.where("geo % 5 <> 0"), "fitted")
    factors = segments.settled_factors(fitted, PARAMS, ws)
    labels = ws.save(segments.theme_labels(factors, PARAMS, ws), "labels")
    return segments.new_region_labels(shares.where("geo % 5 = 0"), factors, labels, PARAMS)


@query
def share_intervals(spark, src):
    found = features.share_intervals(src, PARAMS, PARAMS.bootstrap_replicates)
    return found.withColumns({c: rounded(c) for c in ("value", "low", "high")})


@query
def renumbered_segments(spark, src):
    """Region code modulo 3, numbered as in an earlier mapping that has other numbers and a fifth of its regions elsewhere."""
    shares, _ = _shares(spark, src)
    labels = _fixed_labels(shares)
    moved = F.when(F.pmod("geo", F.lit(5)) == 0, F.pmod(F.col("geo"), F.lit(2))).otherwise(F.pmod(F.col("geo") + 1, F.lit(3)))
    return matching.renumbered(labels, labels.withColumn("segment", moved))


@query
def segment_history(spark, src):
    """The mapping's history after two runs, the second with every fourth region moved."""
    shares, _ = _shares(spark, src)
    labels = _fixed_labels(shares)
    moved = labels.withColumn("segment", F.when(F.pmod("geo", F.lit(4)) == 0, F.lit(0)).otherwise(F.col("segment")))
    first = matching.with_history(labels, None, "2024-01-28")
    return matching.with_history(moved, first, "2024-02-28")


def _fixed_labels(long: DataFrame) -> DataFrame:
    """A labelling that SQL can repeat: region code modulo 3."""
    return long.where(F.col("geo").isNotNull()).select("geo").distinct().withColumn("segment", F.pmod("geo", F.lit(3)))


@query
def cluster_metrics(spark, src):
    """Metrics of the fixed labelling on the share matrix."""
    shares, _ = _shares(spark, src)
    labels = _fixed_labels(shares).select(F.lit(1).alias("run"), F.col("geo").alias("id"), "segment")
    cells = segments.model_cells(shares).select(F.col("geo").alias("id"), F.col("label").alias("feature"), "value")
    metrics = clusters.cluster_metrics(cells, labels)
    exact = ("run", "points", "segments")
    return metrics.select(*[c if c in exact else rounded(c).alias(c) for c in metrics.columns])


@query
def k_sweep(spark, src):
    """Metrics on the share matrix of a labelling for each number of segments (region code modulo k), and the count chosen."""
    shares, ws = _shares(spark, src)
    regions = shares.select("geo").distinct()
    labels = regions.select(F.explode(F.array(*map(F.lit, PARAMS.segment_counts))).alias("run"), F.col("geo").alias("id"))
    labels = labels.withColumn("segment", F.pmod("id", "run"))
    cells = segments.model_cells(shares).select(F.col("geo").alias("id"), F.col("label").alias("feature"), "value")
    metrics = ws.save(clusters.cluster_metrics(cells, labels), "metrics")
    chosen = segments.chosen_count(metrics)
    return metrics.select("run", "points", "segments", rounded("within_cost").alias("within_cost"), rounded("silhouette").alias("silhouette"), (F.col("segments") == chosen).alias("chosen"))


@query
def cluster_stability(spark, src):
    """Adjusted Rand index between labellings: region code modulo 3, 4 and 5 against modulo 3."""
    shares, _ = _shares(spark, src)
    regions = shares.select(F.col("geo").alias("id")).distinct()
    labels = regions.select(F.explode(F.array(*map(F.lit, (3, 4, 5)))).alias("run"), "id").withColumn("segment", F.pmod("id", "run"))
    found = clusters.adjusted_rand(labels, labels.where("run = 3"))
    return found.withColumn("adjusted_rand", rounded("adjusted_rand"))


@query
def segment_run(spark, src):
    """A whole run into a folder of its own: the published mapping, which has every region once."""
    sink = refresh.FolderSink(spark, Workspace(spark, "published").root)
    return run.run(src, PARAMS, sink)["segment_map"]


def _theme_segments(spark, src) -> tuple[DataFrame, DataFrame]:
    """Shares, and the labels of a settled fit."""
    shares, ws = _shares(spark, src)
    labels = segments.theme_labels(segments.settled_factors(shares, PARAMS, ws), PARAMS, ws)
    return shares, ws.save(labels, "theme_labels")


@query
def segment_map_themes(spark, src):
    return segments.segment_map(_theme_segments(spark, src)[1], src, PARAMS)


@query
def sessions_with_segment_themes(spark, src):
    return segments.sessions_with_segment(_theme_segments(spark, src)[1], src, PARAMS)


@query
def segment_profile_themes(spark, src):
    profile = segments.segment_profile(*_theme_segments(spark, src))
    return profile.withColumn("mean_share", rounded("mean_share")).withColumn("lift", rounded("lift"))


@query
def segment_map(spark, src):
    shares, _ = _shares(spark, src)
    return segments.segment_map(_fixed_labels(shares), src, PARAMS)


@query
def segment_map_csv(spark, src):
    """The mapping written as CSV and read back."""
    shares, ws = _shares(spark, src)
    mapping = segments.segment_map(_fixed_labels(shares), src, PARAMS)
    refresh.export_csv(mapping, ws.path("segment_map_csv"))
    return spark.read.schema(mapping.schema).option("header", True).csv(ws.path("segment_map_csv"))


@query
def sessions_with_segment(spark, src):
    shares, _ = _shares(spark, src)
    return segments.sessions_with_segment(_fixed_labels(shares), src, PARAMS)


@query
def segment_profile(spark, src):
    shares, _ = _shares(spark, src)
    profile = segments.segment_profile(shares, _fixed_labels(shares))
    return profile.withColumn("mean_share", rounded("mean_share")).withColumn("lift", rounded("lift"))
