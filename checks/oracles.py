"""DuckDB SQL for every registered query that SQL can express.

The SQL is a second formulation, apart from the Spark code: NOT EXISTS for the anti join, plain
joins, FILTER and USING, long factors with self joins, all pairs of regions where Spark avoids them.
Only the expressions of the derived source tables are shared (see FIXTURES.md).
"""

from __future__ import annotations

import math
import re

from checks.queries import PARAMS
from terrane.params import EXCLUDED_ORDER_FLOWS, EXCLUDED_SKUS, ORDER_ENTRY_GROUPS, ORIGINATION_CHANNELS
from terrane.sources.derived import COLUMNS, DISTINCT_TABLES

P = PARAMS
TWICE = "(SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 10 = 0)"

ROW_SOURCES = {
    "session_search": f"{TWICE} x JOIN part ON p_partkey = event_id % (SELECT count(*) FROM part)",
    "calendar": "orders WHERE o_orderkey % 30 <> 19",
    "clickstream_session_bot": "events",
    "session": "events WHERE user_id % 15 <> 1",
    "order_line": "lineitem JOIN orders ON l_orderkey = o_orderkey",
    "merch_product": "part",
    "merch_sku": "part CROSS JOIN nation WHERE n_nationkey < 2",
    "order_flow": "orders",
    "price_sub_type": "lineitem",
    "digital_shop": "nation WHERE n_nationkey IN (0,1,2,4)",
    "merch_sku_attribute": "part CROSS JOIN nation WHERE n_nationkey < 2 "
    "AND (n_nationkey = 1 OR p_partkey % 5 <> 0) AND p_partkey % 13 <> 0",
    "merch_hier_activity_xref": "part CROSS JOIN nation WHERE n_nationkey < 2 AND p_size % 2 = 0",
    "address": "customer",
    "dma_geo_dim": "nation",
    "dma_district": "nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey NOT IN (1,2,24)",
}

# Derived source tables carry a prefix, so that none hides a raw table.
STEPS: dict[str, str] = {}
for _table, _columns in COLUMNS.items():
    _distinct = "DISTINCT " if _table in DISTINCT_TABLES else ""
    _list = ", ".join(f"{text} AS {name}" for name, text in _columns.items())
    STEPS[f"src_{_table}"] = f"SELECT {_distinct}{_list} FROM {ROW_SOURCES[_table]}"


def _in(values) -> str:
    return ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)


THEME = """CASE WHEN strpos(breadcrumb, '|') > 0 THEN split_part(breadcrumb, '|', 1)
      WHEN coalesce(breadcrumb, '') <> '' THEN breadcrumb
      ELSE trim(navigation_search_term) END"""
NULL_FLAG = "CAST(NOT coalesce(user_search_results_returned_count > 0, false) AS INT)"
REGION = "CASE WHEN dma_code IN ('N/A', 'UNK') THEN 1 ELSE CAST(dma_code AS INT) END"

STEPS["bots"] = f"""
SELECT DISTINCT session_key FROM src_clickstream_session_bot
WHERE session_bot_flag = 1 AND session_start_date >= DATE '{P.start_date}' AND session_start_date <= DATE '{P.end_date}'"""

STEPS["visits"] = f"""
SELECT DISTINCT session_search_date_key, visitor_key, fiscal_month, session_key, site_id, page_name, page_name_key,
  page_template, clickstream_visit_page_num, user_search_results_returned_count,
  trim(navigation_search_term) AS nav_search_term, {THEME} AS nav_breadcrumb, search_refinement_type,
  {NULL_FLAG} AS null_search_flag
FROM src_session_search s JOIN src_calendar c ON c.date_key = s.session_search_date_key
WHERE session_search_date_key >= {P.start_key} AND session_search_date_key <= {P.end_key}
  AND NOT (coalesce(navigation_search_term, '') = '' AND coalesce(user_search_term, '') = '')
  AND navigation_category_type IN ('cat', 'query') AND page_template = 'nav_search' AND length(page_name) > 0
  AND NOT EXISTS (SELECT 1 FROM bots b WHERE b.session_key = s.session_key)"""

STEPS["placed_visits"] = """
SELECT v.*, r.dma_code, r.cbsa_name, r.visitor_key IS NOT NULL AS located
FROM visits v LEFT JOIN src_session r
  ON r.visitor_key = v.visitor_key AND r.session_start_date_key = v.session_search_date_key"""

STEPS["regions"] = f"""
SELECT dma_geo_key, {REGION} AS dma_code, dma_name, cbsa_code, cbsa_name, dma_zip_code, state_name FROM src_dma_geo_dim"""

STEPS["places"] = """
SELECT a.address_key, a.dma_geo_key, g.dma_code, g.dma_name, d.dma_short_desc, g.dma_zip_code, g.cbsa_code,
  g.cbsa_name, d.district_name, g.state_name
FROM src_address a JOIN regions g USING (dma_geo_key) JOIN src_dma_district d ON d.dma_code = g.dma_code"""

STEPS["activities"] = """
SELECT product_key, max(attribute_value) FILTER (WHERE attribute_name = 'PRIMARY_ACTIVITY_CODE') AS activity_product
FROM src_merch_sku_attribute GROUP BY product_key"""

STEPS["labelled_skus"] = """
SELECT s.product_key, s.sku_key, x.activity_desc AS activity_label
FROM src_merch_sku s LEFT JOIN src_merch_hier_activity_xref x
  ON (x.shop_desc, x.department_id, x.class_id, x.subclass_id, x.dona_id)
   = (s.shop_desc, s.department_id, s.class_id, s.subclass_id, s.dona_id)"""

STEPS["lines"] = f"""
SELECT c.fiscal_date, g.dma_code, g.dma_name, g.dma_short_desc, g.district_name, g.state_name, g.cbsa_code,
  g.cbsa_name, g.dma_zip_code, l.order_id, s.product, coalesce(h.digital_shop, s.shop_desc) AS digital_shop,
  s.subclass_desc, p.brand_desc, s.color_family, f.order_flow_desc, t.price_sub_type_desc AS price_flag,
  a.activity_product, k.activity_label, l.line_qty, l.cogs_flag,
  l.net_amt + coalesce(l.current_corp_price, 0) * l.cancelled_qty AS line_demand,
  CASE WHEN l.cogs_flag = 1 THEN l.line_qty * l.adjusted_moving_average_price ELSE 0 END AS line_cost
FROM src_order_line l
  JOIN src_order_flow f USING (order_flow_key)
  JOIN src_price_sub_type t USING (price_sub_type_key)
  JOIN src_calendar c ON c.date_key = l.order_date_key
  JOIN src_merch_product p ON p.product_key = l.product_key
  JOIN src_merch_sku s ON s.sku_key = l.sku_key AND s.product_key = p.product_key AND s.department_key = p.department_key
  JOIN labelled_skus k ON k.product_key = s.product_key AND k.sku_key = s.sku_key
  LEFT JOIN src_digital_shop h ON h.department_desc = p.department_desc
  LEFT JOIN activities a ON a.product_key = s.product_key
  LEFT JOIN places g ON g.address_key = l.billto_address_key
WHERE l.order_date_key >= {P.start_key} AND l.order_date_key <= {P.end_key}
  AND l.sku NOT IN ({_in(EXCLUDED_SKUS)}) AND f.order_flow_key NOT IN ({_in(EXCLUDED_ORDER_FLOWS)})
  AND l.origination_channel_key IN ({_in(ORIGINATION_CHANNELS)})
  AND l.order_entry_group_key IN ({_in(ORDER_ENTRY_GROUPS)}) AND l.order_entry_application_key = 3"""

STEPS["facts"] = """
SELECT fiscal_date, dma_code, dma_name, dma_short_desc, district_name, state_name, cbsa_code, cbsa_name, dma_zip_code,
  order_id, product, digital_shop, subclass_desc, brand_desc, color_family, order_flow_desc, price_flag,
  activity_product, activity_label, CAST(sum(line_qty) AS BIGINT) AS units,
  CAST(sum(line_demand) AS DECIMAL(18,2)) AS demand, CAST(sum(line_cost) AS DECIMAL(18,2)) AS cost
FROM lines GROUP BY ALL"""

STEPS["geos"] = """
SELECT DISTINCT dma_code, dma_name, dma_short_desc, dma_zip_code, cbsa_code, cbsa_name, district_name, state_name
FROM lines"""


def _visitors(keys: str, name: str = "visitor_count", where: str = "located") -> str:
    return f"SELECT {keys}, count(DISTINCT visitor_key) AS {name} FROM placed_visits WHERE {where} GROUP BY ALL"


def _orders(keys: str) -> str:
    return f"SELECT {keys}, count(DISTINCT order_id) AS order_count FROM lines GROUP BY ALL"


ORDER_FAMILIES = {
    "subclass": "subclass_desc",
    "brand": "brand_desc",
    "flow": "order_flow_desc",
    "price": "price_flag",
    "color": "color_family",
}


def _long(family: str, feature: str, measure: str, rows: str, where: str = "true") -> str:
    return (
        f"SELECT dma_code AS geo, '{family}' AS family, {feature} AS feature, "
        f"CAST(count(DISTINCT {measure}) AS DOUBLE) AS value FROM {rows} WHERE {where} GROUP BY 1, 2, 3"
    )


STEPS["long_features"] = " UNION ALL ".join(
    [
        _long("total", "'visitors'", "visitor_key", "placed_visits"),
        _long("theme", "nav_breadcrumb", "visitor_key", "placed_visits", "located"),
        _long("outlet", "site_id", "visitor_key", "placed_visits", "located AND site_id = 'outlet'"),
        _long("total", "'orders'", "order_id", "lines"),
        *[_long(family, key, "order_id", "lines") for family, key in ORDER_FAMILIES.items()],
    ]
)

STEPS["shares"] = """
SELECT f.geo, f.family, coalesce(f.feature, '(none)') AS feature, f.value / t.value AS value
FROM long_features f JOIN long_features t ON t.geo = f.geo AND t.family = 'total'
  AND t.feature = CASE WHEN f.family IN ('theme', 'outlet') THEN 'visitors' ELSE 'orders' END
WHERE f.family <> 'total'"""

def _units(family: str, feature: str, measure: str, rows: str, where: str = "true") -> str:
    return (
        f"SELECT DISTINCT dma_code AS geo, '{family}' AS family, {feature} AS feature, {measure} AS unit FROM {rows} "
        f"WHERE {where} AND dma_code IS NOT NULL AND {measure} IS NOT NULL"
    )


# Weights from one table for all: the same visitor has the same weight everywhere.
_BOUNDS = [sum(math.exp(-1) / math.factorial(j) for j in range(n + 1)) for n in range(9)]
STEPS["draws"] = f"""
SELECT geo, family, feature, r, count(*)::DOUBLE AS value, sum({" + ".join(f"(u > {b!r}::DOUBLE)::INT" for b in _BOUNDS)}) AS drawn
FROM (SELECT *, (CAST('0x' || substr(md5(unit || '|' || r), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE AS u
  FROM ({" UNION ALL ".join([
    _units("total", "'visitors'", "visitor_key", "placed_visits"),
    _units("theme", "nav_breadcrumb", "visitor_key", "placed_visits", "located"),
    _units("outlet", "site_id", "visitor_key", "placed_visits", "located AND site_id = 'outlet'"),
    _units("total", "'orders'", "order_id", "lines"),
    *[_units(family, key, "order_id", "lines") for family, key in ORDER_FAMILIES.items()],
  ])}), unnest(range(1, {P.bootstrap_replicates + 1})) AS t(r))
GROUP BY ALL"""

STEPS["fixed_labels"] = "SELECT DISTINCT geo, geo % 3 AS segment FROM shares"

STEPS["map"] = """
SELECT geo, any_value(segment) AS segment, min(dma_name) AS dma_name, min(dma_short_desc) AS dma_short_desc,
  min(district_name) AS district_name
FROM fixed_labels LEFT JOIN geos ON geos.dma_code = fixed_labels.geo GROUP BY geo"""

# Factorisation, unrolled: w<i> (geo, theme, weight), h<i> (label, theme, weight).
STEPS["cells"] = "SELECT geo, family || ':' || feature AS label, value FROM shares"
STEPS["numbers"] = f"SELECT CAST(range AS INT) AS theme FROM range({P.nmf_rank})"


def _start(key: str) -> str:
    text = f"{key} || '|' || theme"
    return (
        f"SELECT {key}, theme, 0.1::DOUBLE + CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS weight "
        f"FROM (SELECT DISTINCT {key} FROM cells) CROSS JOIN numbers"
    )


STEPS["w0"], STEPS["h0"] = _start("geo"), _start("label")


def _update(key: str, factor: str, other_key: str, other: str) -> str:
    return f"""
SELECT f.{key}, f.theme, f.weight * n.v / (d.v + 1e-12) AS weight
FROM {factor} f
JOIN (SELECT {key}, theme, sum(value * weight) AS v FROM cells JOIN {other} USING ({other_key}) GROUP BY ALL) n
  ON n.{key} = f.{key} AND n.theme = f.theme
JOIN (SELECT x.{key}, g.b AS theme, sum(x.weight * g.v) AS v FROM {factor} x
      JOIN (SELECT p.theme AS a, q.theme AS b, sum(p.weight * q.weight) AS v
            FROM {other} p JOIN {other} q USING ({other_key}) GROUP BY ALL) g ON g.a = x.theme GROUP BY ALL) d
  ON d.{key} = f.{key} AND d.theme = f.theme"""


def _round_of(key: str, name: str, number: int, other_key: str, other: str) -> None:
    """The inner updates of one factor in one round; the last one is <name><number>."""
    before = f"{name}{number - 1}"
    for inner in range(1, P.nmf_inner + 1):
        after = f"{name}{number}" if inner == P.nmf_inner else f"{name}{number}i{inner}"
        STEPS[after] = _update(key, before, other_key, other)
        before = after


for _number in range(1, P.nmf_rounds + 1):
    _round_of("geo", "w", _number, "label", f"h{_number - 1}")
    _round_of("label", "h", _number, "geo", f"w{_number}")
STEPS["one_w"] = _update("geo", "w0", "label", "h0")
STEPS["one_h"] = _update("label", "h0", "geo", "one_w")

# A whole fit, a half-round a step: side 'w' moves in even steps, side 'h' in odd ones, which end a round.
_R = P.nmf_rank
STEPS["fit_cells"] = """
SELECT 'w' AS side, CAST(geo AS VARCHAR) AS key, label AS across, value FROM cells
UNION ALL SELECT 'h', label, CAST(geo AS VARCHAR), value FROM cells"""
STEPS["fit_start"] = """
SELECT 'w' AS side, CAST(geo AS VARCHAR) AS key, list(weight ORDER BY theme) AS w FROM w0 GROUP BY geo
UNION ALL SELECT 'h', label, list(weight ORDER BY theme) FROM h0 GROUP BY label"""


def _gram(rows: str) -> str:
    pairs = f"unnest(range(1, {_R + 1})) AS a(i), unnest(range(1, {_R + 1})) AS b(j)"
    return f"SELECT list(g ORDER BY i, j) AS g FROM (SELECT i, j, sum(w[i] * w[j]) AS g FROM {rows}, {pairs} GROUP BY i, j)"


_SWEEPS = [[float(c)] for _ in range(P.nmf_sweeps) for c in range(1, _R + 1)]
_INNER = f"list_sum(list_transform(range(1, {_R + 1}), lambda e: g[(d - 1) * {_R} + e] * a[e]))"
_COORDINATE = f"greatest(0, a[d] + (n[d] - {_INNER}) / g[(d - 1) * {_R} + d])"
STEPS["fit"] = f"""
SELECT 0 AS step, side, key, w, 'inf'::DOUBLE AS loss, 'inf'::DOUBLE AS before FROM fit_start
UNION ALL
(WITH n_last AS (SELECT * FROM fit WHERE step = 0 OR step % 2 = 1 OR before - loss > {P.nmf_tolerance} * loss),
n_side AS (SELECT any_value(CASE WHEN step % 2 = 0 THEN 'w' ELSE 'h' END) AS name FROM n_last),
n_across AS (SELECT key AS across, w FROM n_last, n_side WHERE side <> name),
n_gram AS ({_gram("n_across")}),
n_sums AS (SELECT key, [{", ".join(f"sum(value * w[{c}])" for c in range(1, _R + 1))}] AS n
  FROM fit_cells JOIN n_side ON side = name JOIN n_across USING (across) GROUP BY key),
n_moved AS (
  SELECT key, n, list_reduce(list_prepend(w, {_SWEEPS}), lambda a, x: list_transform(range(1, {_R + 1}), lambda d: CASE WHEN d = x[1] THEN {_COORDINATE} ELSE a[d] END)) AS w
  FROM n_last JOIN n_sums USING (key), n_gram, n_side WHERE side = name),
n_own AS ({_gram("n_moved")}),
n_loss AS (
  SELECT (SELECT sum(value * value) FROM cells) - 2 * (SELECT sum(list_sum(list_transform(list_zip(n, w), lambda z: z[1] * z[2]))) FROM n_moved)
    + (SELECT list_sum(list_transform(list_zip(n_gram.g, n_own.g), lambda z: z[1] * z[2])) FROM n_gram, n_own) AS now)
SELECT step + 1, side, n_last.key, coalesce(n_moved.w, n_last.w), CASE WHEN step % 2 = 1 THEN now ELSE loss END, CASE WHEN step % 2 = 1 THEN loss ELSE before END
FROM n_last CROSS JOIN n_side CROSS JOIN n_loss LEFT JOIN n_moved ON n_moved.key = n_last.key AND side = name)"""
_LAST = "SELECT * FROM fit WHERE step = (SELECT max(step) FROM fit)"
STEPS["themes_w"] = f"SELECT CAST(key AS INT) AS geo, theme, w[theme + 1] AS weight FROM ({_LAST}) CROSS JOIN numbers WHERE side = 'w'"
STEPS["themes_h"] = f"SELECT key AS label, theme, w[theme + 1] AS weight FROM ({_LAST}) CROSS JOIN numbers WHERE side = 'h'"

W, H = "themes_w", "themes_h"


def _loss(number: int) -> str:
    return f"""SELECT {number} AS round, round(sum(power(coalesce(c.value, 0) - m.v, 2)), 6) AS loss
FROM (SELECT geo, label, sum(w.weight * h.weight) AS v FROM w{number} w JOIN h{number} h USING (theme) GROUP BY ALL) m
LEFT JOIN cells c ON c.geo = m.geo AND c.label = m.label"""


# k-means on the themes: a start drawn point by point, then moves until the centres stay.
def _apart(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: power(z[1] - z[2], 2)))"


STEPS["theme_vectors"] = f"SELECT geo, list(weight ORDER BY theme) AS v FROM {W} GROUP BY geo"
for _drawn in range(P.segments):
    _u = f"((CAST('0x' || substr(md5(geo || '|' || {P.seed * 1000 + _drawn}), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE)"
    _d2 = f"list_min(list_transform(c, lambda x: {_apart('x', 'v')}))" if _drawn else "1"
    STEPS[f"drawn{_drawn}"] = f"""
SELECT list_append(c, v) AS c FROM (SELECT *, -ln({_u}) / nullif({_d2}, 0) AS race FROM theme_vectors, {f"drawn{_drawn - 1}" if _drawn else "(SELECT CAST([] AS DOUBLE[][]) AS c)"})
ORDER BY race NULLS LAST, geo LIMIT 1"""
_MEANS = ", ".join(f"avg(v[{c}])" for c in range(1, P.nmf_rank + 1))
STEPS["lloyd"] = f"""
SELECT 0 AS step, c, 'inf'::DOUBLE AS moved FROM drawn{P.segments - 1}
UNION ALL
SELECT step + 1, list(coalesce(mean, c[n]) ORDER BY n), max(coalesce({_apart("mean", "c[n]")}, 0))
FROM (SELECT any_value(step) AS step, any_value(c) AS c FROM lloyd WHERE moved > {P.kmeans_tolerance**2}) l, unnest(range(1, {P.segments + 1})) AS s(n)
LEFT JOIN (
  SELECT segment, [{_MEANS}] AS mean FROM (
    SELECT v, list_position(d, list_min(d)) AS segment FROM (SELECT v, list_transform(c, lambda x: {_apart("x", "v")}) AS d FROM theme_vectors, lloyd)
  ) GROUP BY segment) m ON m.segment = n
WHERE step IS NOT NULL GROUP BY step"""
STEPS["theme_segments"] = f"""
SELECT geo, CAST(list_position(d, list_min(d)) - 1 AS INT) AS segment
FROM (SELECT geo, list_transform(c, lambda x: {_apart("x", "v")}) AS d FROM theme_vectors, (SELECT c FROM lloyd WHERE step = (SELECT max(step) FROM lloyd)))"""

K = round(3 * P.perplexity)
STEPS["near"] = f"""
SELECT id, other, rank, distance FROM (
  SELECT a.geo AS id, b.geo AS other, sqrt(sum(power(a.weight - b.weight, 2))) AS distance,
    row_number() OVER (PARTITION BY a.geo ORDER BY sum(power(a.weight - b.weight, 2)), b.geo) AS rank
  FROM {W} a JOIN {W} b ON b.theme = a.theme AND b.geo <> a.geo GROUP BY a.geo, b.geo)
WHERE rank <= {K}"""

# Bandwidth by bisection of its logarithm: the entropy falls as beta grows.
STEPS["spreads"] = "SELECT id, list(distance * distance) AS d2 FROM near GROUP BY id"
STEPS["search"] = f"""
SELECT id, d2, 0 AS step, -60.0::DOUBLE AS low, 60.0::DOUBLE AS high FROM spreads
UNION ALL
SELECT id, d2, step + 1, CASE WHEN entropy > ln({P.perplexity}) THEN middle ELSE low END,
  CASE WHEN entropy > ln({P.perplexity}) THEN high ELSE middle END
FROM (SELECT *, (low + high) / 2 AS middle, ln(list_sum(list_transform(d2, lambda d: exp(-(d - list_min(d2)) * exp((low + high) / 2)))))
        + exp((low + high) / 2)
        * list_sum(list_transform(d2, lambda d: (d - list_min(d2)) * exp(-(d - list_min(d2)) * exp((low + high) / 2))))
        / list_sum(list_transform(d2, lambda d: exp(-(d - list_min(d2)) * exp((low + high) / 2)))) AS entropy
      FROM search WHERE step < 100)"""
STEPS["betas"] = "SELECT id, exp(low) AS beta, list_min(d2) AS least FROM search WHERE step = 100"

# Metrics over all pairs of regions.
STEPS["dense"] = """
SELECT g.geo, g.segment, l.label, coalesce(c.value, 0) AS value
FROM fixed_labels g CROSS JOIN (SELECT DISTINCT label FROM cells) l
LEFT JOIN cells c ON c.geo = g.geo AND c.label = l.label"""
STEPS["centres"] = "SELECT segment, label, avg(value) AS value FROM dense GROUP BY ALL"
STEPS["off_centre"] = """
SELECT d.geo, d.segment, sum(power(d.value - c.value, 2)) AS d2
FROM dense d JOIN centres c ON c.segment = d.segment AND c.label = d.label GROUP BY ALL"""
STEPS["spread"] = "SELECT segment, avg(sqrt(d2)) AS s, count(*) AS n, sum(d2) AS cost FROM off_centre GROUP BY ALL"
STEPS["apart"] = """
SELECT a.segment, b.segment AS other, sqrt(sum(power(a.value - b.value, 2))) AS d
FROM centres a JOIN centres b ON a.label = b.label AND a.segment <> b.segment GROUP BY ALL"""
STEPS["worst"] = """
SELECT a.segment, max((x.s + y.s) / a.d) AS r FROM apart a JOIN spread x ON x.segment = a.segment
JOIN spread y ON y.segment = a.other GROUP BY ALL"""
STEPS["pair_distance"] = """
SELECT a.geo, a.segment, b.geo AS other, b.segment AS other_segment, sum(power(a.value - b.value, 2)) AS d2
FROM dense a JOIN dense b ON a.label = b.label AND a.geo <> b.geo GROUP BY ALL"""
STEPS["point_quality"] = """
SELECT geo, max(d) FILTER (WHERE segment = other_segment) AS a, min(d) FILTER (WHERE segment <> other_segment) AS b
FROM (SELECT geo, segment, other_segment, avg(d2) AS d FROM pair_distance GROUP BY ALL) GROUP BY geo"""
STEPS["total_centre"] = "SELECT label, avg(value) AS value FROM dense GROUP BY ALL"
STEPS["total_cost"] = """
SELECT sum(power(d.value - t.value, 2)) AS cost FROM dense d JOIN total_centre t ON t.label = d.label"""


# One column per feature that occurs; names are made in SQL, apart from the Spark code.
STEPS["named_cells"] = """
SELECT geo, trim(regexp_replace(lower(family || '_' || coalesce(feature, '(none)')), '[^a-z0-9]+', '_', 'g'), '_') AS name, value
FROM long_features WHERE geo IS NOT NULL"""


def _contents() -> str:
    """Rows and checksum of each table: columns by name, decimals in hundredths, a mark for NULL."""
    tables = {
        "run_window": (
            "start_key end_key start_date end_date",
            f"SELECT {P.start_key} AS start_key, {P.end_key} AS end_key, '{P.start_date}' AS start_date, '{P.end_date}' AS end_date",
        ),
        "search_sessions": (
            "session_search_date_key visitor_key fiscal_month session_key site_id page_name page_name_key page_template "
            "clickstream_visit_page_num user_search_results_returned_count nav_search_term nav_breadcrumb "
            "search_refinement_type null_search_flag",
            "SELECT * FROM visits",
        ),
        "visitors_by_geo": ("dma_code visitor_count_total", _visitors("dma_code", "visitor_count_total", "true")),
        "nav_theme_visitors_by_geo": ("dma_code nav_theme visitor_count", _visitors("dma_code, nav_breadcrumb AS nav_theme")),
        "outlet_visitors_by_geo": ("dma_code site_id visitor_count", _visitors("dma_code, site_id", where="located AND site_id = 'outlet'")),
        "order_facts": (
            "fiscal_date dma_code dma_name dma_short_desc district_name state_name cbsa_code cbsa_name dma_zip_code order_id product "
            "digital_shop subclass_desc brand_desc color_family order_flow_desc price_flag activity_product activity_label units demand cost",
            "SELECT * FROM facts",
        ),
        **{f"{family}_orders_by_geo": (f"dma_code {key} order_count", _orders(f"dma_code, {key}")) for family, key in ORDER_FAMILIES.items()},
        "geo_map": ("dma_code dma_name dma_short_desc dma_zip_code cbsa_code cbsa_name district_name state_name", "SELECT * FROM geos"),
    }

    def text(column: str) -> str:
        return f"coalesce(CAST({f'CAST({column} * 100 AS BIGINT)' if column in ('demand', 'cost') else column} AS VARCHAR), '~')"

    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS row_count, "
        f"CAST(coalesce(sum(CAST('0x' || substr(md5(concat_ws('|', {', '.join(text(c) for c in sorted(columns.split()))})), 1, 8) AS BIGINT)), 0) AS BIGINT) "
        f"AS checksum FROM ({rows}) AS t"
        for name, (columns, rows) in tables.items()
    )


def _status() -> str:
    """Counts of every source now and as recorded, for each of the four changes."""
    rows = []
    for change, changed in (("unchanged", ""), ("window", "(window)"), ("dimension", "dma_district"), ("late row", "order_line")):
        rows.append(f"SELECT '{change}' AS change, '(window)' AS source, 1 AS row_count, 1 AS stored_count, {changed == '(window)'} AS needs_refresh")
        for table in COLUMNS:
            now = {"dimension": "0", "late row": "n + 1"}.get(change, "n") if table == changed else "n"
            rows.append(f"SELECT '{change}', '{table}', {now}, n, {table == changed} FROM (SELECT count(*) AS n FROM src_{table})")
    return " UNION ALL ".join(rows)


QUERIES: dict[str, str] = {
    "run_params": f"""SELECT {P.start_key} AS start_key, {P.end_key} AS end_key, '{P.start_date}' AS start_date,
  '{P.end_date}' AS end_date,
  (SELECT count(*) FROM src_session_search WHERE session_search_date_key BETWEEN {P.start_key} AND {P.end_key}) AS search_rows,
  (SELECT count(*) FROM src_order_line WHERE order_date_key BETWEEN {P.start_key} AND {P.end_key}) AS order_lines""",
    "bot_sessions": "SELECT session_key FROM bots",
    "human_sessions": """SELECT session_key, visitor_key, count(*) AS search_rows FROM src_session_search
WHERE session_key NOT IN (SELECT session_key FROM bots) GROUP BY ALL""",
    "nav_theme_expr": f"""SELECT breadcrumb, navigation_search_term, trim(navigation_search_term) AS nav_search_term,
  {THEME} AS nav_theme, count(*) AS search_rows FROM src_session_search GROUP BY ALL""",
    "null_search_expr": f"""SELECT user_search_results_returned_count, {NULL_FLAG} AS null_search_flag,
  count(*) AS search_rows FROM src_session_search GROUP BY ALL""",
    "search_sessions": "SELECT * FROM visits",
    "window_filter_subquery": f"""SELECT session_search_date_key, count(*) AS search_rows FROM src_session_search
WHERE session_search_date_key BETWEEN {P.start_key} AND {P.end_key} GROUP BY ALL""",
    "visitors_by_geo": _visitors("dma_code", "visitor_count_total", "true"),
    "nav_theme_visitors_by_geo": _visitors("dma_code, nav_breadcrumb AS nav_theme"),
    "outlet_visitors_by_geo": _visitors("dma_code, site_id", where="located AND site_id = 'outlet'"),
    "visitors_by_geo_month": _visitors("dma_code, fiscal_month", "visitor_count_total", "true"),
    "visitors_by_cbsa": _visitors("cbsa_name", "visitor_count_total", "true"),
    "nav_theme_visitors_by_cbsa_month": _visitors("cbsa_name, fiscal_month, nav_breadcrumb AS nav_theme"),
    "outlet_visitors_by_cbsa_month": _visitors(
        "cbsa_name, fiscal_month, site_id", where="located AND site_id = 'outlet'"
    ),
    "region_code_expr": f"""SELECT dma_code AS dma_code_text, {REGION} AS region_code, count(*) AS addresses
FROM src_address JOIN src_dma_geo_dim USING (dma_geo_key) GROUP BY ALL""",
    "geo_lookup": "SELECT * FROM places",
    "product_activity": "SELECT * FROM activities",
    "digital_shop_lookup": """SELECT p.product_key, p.department_desc, d.digital_shop,
  greatest(1, (SELECT count(*) FROM src_digital_shop x WHERE x.department_desc = p.department_desc)) AS shop_rows
FROM src_merch_product p LEFT JOIN src_digital_shop d ON d.department_desc = p.department_desc""",
    "activity_label_lookup": "SELECT * FROM labelled_skus",
    "order_facts": "SELECT * FROM facts",
    **{f"{family}_orders_by_geo": _orders(f"dma_code, {key}") for family, key in ORDER_FAMILIES.items()},
    "activity_orders_by_geo": _orders("dma_code, activity_label"),
    "brand_orders_by_cbsa": _orders("cbsa_name, brand_desc"),
    "subclass_orders_by_dma_name": _orders("dma_code, dma_name, dma_short_desc, subclass_desc"),
    "order_features_one_pass": " UNION ALL ".join(
        f"SELECT dma_code, '{key}' AS family, {key} AS feature, count(DISTINCT order_id) AS order_count "
        f"FROM lines GROUP BY 1, 2, 3"
        for key in ORDER_FAMILIES.values()
    ),
    "visitors_by_geo_from_bits": _visitors("dma_code", "visitor_count_total", "true"),
    "visitors_by_geo_month_from_bits": _visitors("dma_code, fiscal_month", "visitor_count_total", "true"),
    "nav_theme_visitors_by_geo_from_bits": _visitors("dma_code, nav_breadcrumb AS nav_theme"),
    "outlet_visitors_by_cbsa_month_from_bits": _visitors("cbsa_name, fiscal_month, site_id", where="located AND site_id = 'outlet'"),
    "brand_orders_by_cbsa_from_bits": _orders("cbsa_name, brand_desc"),
    "color_orders_by_geo_from_bits": _orders("dma_code, color_family"),
    "geo_map": "SELECT * FROM geos",
    "refresh_tables": _contents(),
    "refresh_status": _status(),
    "feature_long": "SELECT * FROM long_features",
    "feature_matrix": """SELECT geo, name, coalesce(max(value), 0) AS value
FROM (SELECT DISTINCT geo FROM named_cells) CROSS JOIN (SELECT DISTINCT name FROM named_cells) LEFT JOIN named_cells USING (geo, name) GROUP BY ALL""",
    "feature_shares": "SELECT geo, family, feature, round(value, 6) AS value FROM shares",
    "nmf_step": """SELECT 'region' AS side, CAST(geo AS VARCHAR) AS key, theme, round(weight, 6) AS weight FROM one_w
UNION ALL SELECT 'feature', label, theme, round(weight, 6) FROM one_h""",
    "nmf_factors": f"SELECT geo, theme, round(weight, 6) AS weight FROM {W}",
    "nmf_loss": " UNION ALL ".join(_loss(number) for number in range(P.nmf_rounds + 1)),
    "theme_top_features": f"""SELECT theme, position, label, round(weight, 6) AS weight
FROM (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY round(weight, 9) DESC, label) AS position FROM {H})
WHERE position <= {P.themes_top}""",
    "nearest_regions": "SELECT id, other, rank, round(distance, 6) AS distance FROM near",
    "tsne_affinities": """SELECT n.id, n.other, round(exp(-(n.distance * n.distance - b.least) * b.beta)
  / sum(exp(-(n.distance * n.distance - b.least) * b.beta)) OVER (PARTITION BY n.id), 6) AS p
FROM near n JOIN betas b USING (id)""",
    "cluster_metrics": """SELECT 1 AS run, CAST(sum(n) AS BIGINT) AS points, count(*) AS segments,
  round(sum(s.cost), 6) AS within_cost, round(any_value(t.cost) - sum(s.cost), 6) AS between_cost,
  round(((any_value(t.cost) - sum(s.cost)) / (count(*) - 1)) / (sum(s.cost) / (sum(n) - count(*))), 6) AS calinski_harabasz,
  round(avg(w.r), 6) AS davies_bouldin,
  round((SELECT avg(coalesce((b - a) / greatest(a, b), 0)) FROM point_quality), 6) AS silhouette
FROM spread s JOIN worst w USING (segment) CROSS JOIN total_cost t""",
    "k_sweep": """WITH labels AS (SELECT k, geo, geo % k AS segment FROM (SELECT DISTINCT geo FROM shares), unnest([3, 4, 5, 6]) AS t(k)),
vectors AS (SELECT k, l.geo, l.segment, label, coalesce(c.value, 0) AS value FROM labels l CROSS JOIN (SELECT DISTINCT label FROM cells) x
  LEFT JOIN cells c USING (geo, label)),
middles AS (SELECT k, segment, label, avg(value) AS value FROM vectors GROUP BY ALL),
costs AS (SELECT v.k, sum(power(v.value - m.value, 2)) AS cost FROM vectors v JOIN middles m USING (k, segment, label) GROUP BY ALL),
far AS (SELECT a.geo, b.geo AS other, sum(power(a.value - b.value, 2)) AS d2 FROM vectors a JOIN vectors b USING (k, label) WHERE k = 3 GROUP BY ALL),
means AS (SELECT l.k, l.geo, l.segment, o.segment AS other_segment, avg(d2) AS d FROM far JOIN labels l ON l.geo = far.geo JOIN labels o ON o.geo = far.other AND o.k = l.k
  WHERE far.geo <> far.other GROUP BY ALL),
quality AS (SELECT k, geo, max(d) FILTER (segment = other_segment) AS a, min(d) FILTER (segment <> other_segment) AS b FROM means GROUP BY ALL),
marks AS (SELECT k, avg(coalesce((b - a) / greatest(a, b), 0)) AS silhouette FROM quality GROUP BY ALL)
SELECT labels.k AS run, count(DISTINCT geo) AS points, count(DISTINCT segment) AS segments, round(any_value(cost), 6) AS within_cost,
  round(any_value(silhouette), 6) AS silhouette,
  labels.k = (SELECT arg_max(k, round(silhouette, 9) - k * 1e-12) FROM marks) AS chosen
FROM labels JOIN costs USING (k) JOIN marks USING (k) GROUP BY labels.k""",
    "cluster_stability": """WITH labels AS (SELECT k, geo, geo % k AS segment FROM (SELECT DISTINCT geo FROM shares), unnest([3, 4, 5]) AS t(k)),
pairs AS (SELECT a.k, a.segment, b.segment AS base, count(*) AS n FROM labels a JOIN labels b ON b.geo = a.geo AND b.k = 3 GROUP BY ALL),
cells2 AS (SELECT k, sum(n * (n - 1) / 2) AS v, sum(n) AS points FROM pairs GROUP BY ALL),
own AS (SELECT k, sum(n * (n - 1) / 2) AS v FROM (SELECT k, segment, count(*) AS n FROM labels GROUP BY ALL) GROUP BY ALL),
ref AS (SELECT v FROM own WHERE k = 3),
e AS (SELECT cells2.k, cells2.v, points, own.v AS one, ref.v AS two, own.v * ref.v / (points * (points - 1) / 2) AS expected FROM cells2 JOIN own USING (k), ref)
SELECT k AS run, CAST(points AS BIGINT) AS points, round((v - expected) / ((one + two) / 2 - expected), 6) AS adjusted_rand FROM e""",
    "segment_map": "SELECT * FROM map",
    "segment_map_csv": "SELECT * FROM map",
    "sessions_with_segment": """SELECT p.* EXCLUDE (cbsa_name, located), f.segment
FROM (SELECT DISTINCT * FROM (SELECT * FROM placed_visits)) p LEFT JOIN fixed_labels f ON f.geo = p.dma_code""",
    "segment_profile": """SELECT s.segment, s.family, s.feature, round(s.total / r.n, 6) AS mean_share,
  round((s.total / r.n) / (o.total / (SELECT count(*) FROM fixed_labels)), 6) AS lift
FROM (SELECT segment, family, feature, sum(value) AS total FROM shares JOIN fixed_labels USING (geo) GROUP BY ALL) s
JOIN (SELECT segment, count(*) AS n FROM fixed_labels GROUP BY ALL) r ON r.segment = s.segment
JOIN (SELECT family, feature, sum(value) AS total FROM shares GROUP BY ALL) o
  ON o.family = s.family AND o.feature = s.feature""",
    "segment_profile_themes": """SELECT s.segment, s.family, s.feature, round(s.total / r.n, 6) AS mean_share,
  round((s.total / r.n) / (o.total / (SELECT count(*) FROM theme_segments)), 6) AS lift
FROM (SELECT segment, family, feature, sum(value) AS total FROM shares JOIN theme_segments USING (geo) GROUP BY ALL) s
JOIN (SELECT segment, count(*) AS n FROM theme_segments GROUP BY ALL) r ON r.segment = s.segment
JOIN (SELECT family, feature, sum(value) AS total FROM shares GROUP BY ALL) o
  ON o.family = s.family AND o.feature = s.feature""",
    "segment_map_themes": """SELECT geo, any_value(segment) AS segment, min(dma_name) AS dma_name, min(dma_short_desc) AS dma_short_desc,
  min(district_name) AS district_name FROM theme_segments LEFT JOIN geos ON geos.dma_code = theme_segments.geo GROUP BY geo""",
    "sessions_with_segment_themes": """SELECT p.* EXCLUDE (cbsa_name, located), f.segment
FROM (SELECT DISTINCT * FROM (SELECT * FROM placed_visits)) p LEFT JOIN theme_segments f ON f.geo = p.dma_code""",
    "kmeans_step": "SELECT CAST(s - 1 AS INT) AS segment, CAST(t - 1 AS INT) AS theme, round(c[s][t], 6) AS value FROM lloyd, "
    f"unnest(range(1, {P.segments + 1})) AS a(s), unnest(range(1, {P.nmf_rank + 1})) AS b(t) WHERE step = 1",
    "kmeans_themes": "SELECT geo, segment FROM theme_segments",
    "renumbered_segments": """WITH both_labels AS (SELECT geo, segment, CASE WHEN geo % 5 = 0 THEN geo % 2 ELSE (geo + 1) % 3 END AS old FROM fixed_labels),
orders3 AS (SELECT * FROM (VALUES (0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)) AS v(a, b, c)),
ranked3 AS (SELECT a, b, c, count(*) AS kept FROM orders3 JOIN both_labels ON old = CASE segment WHEN 0 THEN a WHEN 1 THEN b ELSE c END GROUP BY ALL)
SELECT geo, CAST(CASE segment WHEN 0 THEN a WHEN 1 THEN b ELSE c END AS INT) AS segment FROM fixed_labels, (SELECT * FROM ranked3 ORDER BY kept DESC LIMIT 1)""",
    "segment_history": """WITH two AS (SELECT geo, segment AS s1, CASE WHEN geo % 4 = 0 THEN 0 ELSE segment END AS s2 FROM fixed_labels)
SELECT geo, s1 AS segment, DATE '2024-01-28' AS valid_from, CASE WHEN s1 <> s2 THEN DATE '2024-02-28' END AS valid_to FROM two
UNION ALL SELECT geo, s2, DATE '2024-02-28', NULL FROM two WHERE s1 <> s2""",
    "share_intervals": f"""SELECT geo, family, coalesce(feature, '(none)') AS feature, round(value / total, 6) AS value,
  round(shares_drawn[{P.bootstrap_replicates // 20 + 1}], 6) AS low, round(shares_drawn[{P.bootstrap_replicates - P.bootstrap_replicates // 20}], 6) AS high
FROM (SELECT d.geo, d.family, d.feature, any_value(d.value) AS value, any_value(t.value) AS total,
        list_sort(list(CASE WHEN t.drawn > 0 THEN d.drawn / t.drawn ELSE 0 END)) AS shares_drawn
      FROM draws d JOIN draws t ON t.geo = d.geo AND t.r = d.r AND t.family = 'total'
        AND t.feature = CASE WHEN d.family IN ('theme', 'outlet') THEN 'visitors' ELSE 'orders' END
      WHERE d.family <> 'total' GROUP BY d.geo, d.family, d.feature)""",
}


RECURSIVE = {"search", "fit", "lloyd"}


def _with_steps(sql: str) -> str:
    """Put the steps a query needs in front of it, in the order they are defined."""
    needed: set[str] = set()
    pending = [sql]
    while pending:
        words = set(re.findall(r"\w+", pending.pop()))
        for name in words & STEPS.keys() - needed:
            needed.add(name)
            pending.append(STEPS[name])
    recursive = "RECURSIVE " if needed & RECURSIVE else ""
    parts = [f"{name} AS {'' if name in RECURSIVE else 'MATERIALIZED '}({STEPS[name].strip()})" for name in STEPS if name in needed]
    own = sql.removeprefix("WITH ")  # a query's own steps come after
    return f"WITH {recursive}{', '.join(parts)}{' ' if own == sql else ', '}{own}"


def texts() -> dict[str, str]:
    return {name: _with_steps(sql) for name, sql in QUERIES.items()}
