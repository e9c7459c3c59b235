"""Region x feature table: one registry row per explanatory variable."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.expressions import region_code, uniform
from terrane.params import OUTLET_SITE, Params
from terrane.plans import orders, sessions
from terrane.session import Workspace
from terrane.sources.tables import Tables

SESSIONS, ORDERS = "sessions", "orders"
NO_LABEL = "(none)"
MAX_MATRIX_COLUMNS = 10_000  # Spark's own default limit of pivot values


@dataclass(frozen=True)
class Feature:
    """One explanatory variable: distinct visitors or orders per region and value of `key`.

    `label` stands in for a key (totals). `only` keeps one value. `located` restricts to
    visitors that have a session row for the day.
    """

    family: str
    branch: str
    key: str | None = None
    label: str | None = None
    only: str | None = None
    located: bool = False

    def entry(self) -> Column:
        """Struct (family, feature), or NULL where the row does not count for this variable."""
        value = F.lit(self.label) if self.key is None else F.col(self.key).cast("string")
        entry = F.struct(F.lit(self.family).alias("family"), value.alias("feature"))
        applies = F.lit(True)
        if self.only is not None:
            applies = applies & F.col(self.key).eqNullSafe(self.only)
        if self.located:
            applies = applies & F.col("_located").isNotNull()
        return F.when(applies, entry)


REGISTRY = (
    Feature("total", SESSIONS, label="visitors"),
    Feature("theme", SESSIONS, "nav_breadcrumb", located=True),
    Feature("outlet", SESSIONS, "site_id", only=OUTLET_SITE, located=True),
    Feature("total", ORDERS, label="orders"),
    Feature("subclass", ORDERS, "subclass_desc"),
    Feature("brand", ORDERS, "brand_desc"),
    Feature("flow", ORDERS, "order_flow_desc"),
    Feature("price", ORDERS, "price_flag"),
    Feature("color", ORDERS, "color_family"),
)


def _entries(rows: DataFrame, variables: Sequence[Feature], measure: str) -> DataFrame:
    """All variables of one branch in one pass: each row is expanded to its entries (geo, unit, family, feature)."""
    entries = F.array_compact(F.array(*[v.entry() for v in variables]))
    geo = region_code(F.col("dma_code").cast("string")).alias("geo")
    long = rows.select(geo, F.col(measure).alias("unit"), F.explode(entries).alias("entry"))
    return long.select("geo", "unit", "entry.family", "entry.feature")


def _branches(src: Tables, p: Params, registry: Sequence[Feature], stored_sessions: DataFrame | None, stored_facts: DataFrame | None) -> list[DataFrame]:
    parts = []
    visits = [v for v in registry if v.branch == SESSIONS]
    if visits:
        keys = list(dict.fromkeys(v.key for v in visits if v.key))
        columns = ["visitor_key", "session_search_date_key", *keys]
        rows = (
            stored_sessions.select(*columns).distinct()
            if stored_sessions is not None
            else sessions.search_sessions(src, p, columns)
        )
        located = sessions.with_region(rows, src, p, sessions.DEFAULT_GRAIN, "left", mark="_located")
        parts.append(_entries(located, visits, "visitor_key"))
    bought = [v for v in registry if v.branch == ORDERS]
    if bought:
        labels = [v.key for v in bought if v.key in orders.LABELS]
        rows = stored_facts if stored_facts is not None else orders.order_lines(src, p, labels)
        parts.append(_entries(rows, bought, "order_id"))
    return parts


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def feature_long(
    src: Tables,
    p: Params,
    registry: Sequence[Feature] = REGISTRY,
    stored_sessions: DataFrame | None = None,
    stored_facts: DataFrame | None = None,
) -> DataFrame:
    """Counts (geo, family, feature, value) of all registered variables, NULL region included.

    Region codes of both branches pass through the same sentinel map and cast.
    """
    keys = ("geo", "family", "feature")
    parts = _branches(src, p, registry, stored_sessions, stored_facts)
    return _union([part.groupBy(*keys).agg(F.count_distinct("unit").cast("double").alias("value")) for part in parts])


# Upper ends of the chances of a Poisson number with mean 1: weight n is drawn from the n-th interval.
_POISSON = [sum(math.exp(-1.0) / math.factorial(j) for j in range(n + 1)) for n in range(9)]


def poisson_weights(unit: Column, replicates: int) -> Column:
    """How often each replicate draws a unit: Poisson numbers from the hash of both, 9 at most."""
    bounds = F.lit(_POISSON)
    numbers = F.transform(F.sequence(F.lit(1), F.lit(replicates)), lambda r: uniform(unit, r))
    return F.transform(numbers, lambda u: F.size(F.filter(bounds, lambda bound: u > bound)))


def share_intervals(
    src: Tables,
    p: Params,
    replicates: int,
    registry: Sequence[Feature] = REGISTRY,
    stored_sessions: DataFrame | None = None,
    stored_facts: DataFrame | None = None,
) -> DataFrame:
    """(geo, family, feature, value, low, high): shares and the range they keep when visitors and orders are redrawn.

    A Poisson bootstrap (Hanley & MacGibbon, 2006): in each replicate a visitor or order counts as
    often as its hash says, the same in all regions and variables. `low` and `high` leave out a twentieth of the replicates on either side; a replicate that
    draws nothing of a region counts as 0.
    """
    keys = ("geo", "family", "feature")
    parts = []
    for part in _branches(src, p, registry, stored_sessions, stored_facts):
        # Grouped by unit first, so that its weights are drawn once; the sums are combined before the shuffle.
        units = part.where("geo IS NOT NULL AND unit IS NOT NULL").groupBy("unit").agg(F.collect_set(F.struct(*keys)).alias("entries"))
        weighted = units.select("entries", poisson_weights(F.col("unit"), replicates).alias("weights"))
        drawn = weighted.select("weights", F.explode("entries").alias("entry"))  # a select of its own: weights come before the rows multiply
        sums = [F.sum(F.get("weights", F.lit(r))).alias(f"r{r}") for r in range(replicates)]
        found = drawn.select("entry.*", "weights").groupBy(*keys).agg(F.count("*").cast("double").alias("value"), *sums)
        parts.append(found.select(*keys, "value", F.array(*[f"r{r}" for r in range(replicates)]).alias("drawn")))
    counts = _union(parts).withColumn("base", _base(registry))
    totals = counts.where("family = 'total'").select("geo", F.col("feature").alias("base"), F.col("value").alias("total"), F.col("drawn").alias("drawn_total"))
    joined = counts.where("family <> 'total'").join(totals, ["geo", "base"])
    ranked = F.array_sort(F.zip_with("drawn", "drawn_total", lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))))
    cut = replicates // 20
    return joined.select(
        "geo", "family", F.coalesce("feature", F.lit(NO_LABEL)).alias("feature"), (F.col("value") / F.col("total")).alias("value"),
        F.get(ranked, F.lit(cut)).alias("low"), F.get(ranked, F.lit(replicates - 1 - cut)).alias("high"),
    )


def _base(registry: Sequence[Feature]) -> Column:
    """The total that a family's counts are divided by."""
    base = F.lit(None).cast("string")
    for variable in registry:
        if variable.key is not None:
            total = "visitors" if variable.branch == SESSIONS else "orders"
            base = F.when(F.col("family") == variable.family, total).otherwise(base)
    return base


def feature_shares(long: DataFrame, registry: Sequence[Feature] = REGISTRY) -> DataFrame:
    """Counts divided by the region's distinct visitors or orders, the NULL region left out.

    `long` is read twice, so pass a stored table. A NULL value of a key is labelled.
    """
    known = long.where(F.col("geo").isNotNull())
    totals = known.where(F.col("family") == "total").select(
        "geo", F.col("feature").alias("base"), F.col("value").alias("total")
    )
    counts = known.where(F.col("family") != "total").withColumn("base", _base(registry))
    return counts.join(totals, ["geo", "base"]).select(
        "geo",
        "family",
        F.coalesce("feature", F.lit(NO_LABEL)).alias("feature"),
        (F.col("value") / F.col("total")).alias("value"),
    )


def column_name(family: str, feature: str) -> str:
    """Column of a (family, feature) pair in the wide matrix."""
    return re.sub(r"[^a-z0-9]+", "_", f"{family}_{feature}".lower()).strip("_")


def matrix_columns(long: DataFrame) -> list[tuple[str, str]]:
    """The (family, feature) pairs that occur, at most MAX_MATRIX_COLUMNS; more, or equal column names, are an error."""
    pairs = long.where(F.col("geo").isNotNull()).select("family", F.coalesce("feature", F.lit(NO_LABEL)).alias("feature")).distinct()
    found = [(r["family"], r["feature"]) for r in pairs.limit(MAX_MATRIX_COLUMNS + 1).collect()]
    if len(found) > MAX_MATRIX_COLUMNS:
        raise ValueError("too many columns for one wide row: use the long form")
    names: dict[str, tuple[str, str]] = {}
    for pair in sorted(found):
        if names.setdefault(column_name(*pair), pair) != pair:
            raise ValueError(f"{pair} and {names[column_name(*pair)]} would share the column {column_name(*pair)}")
    return sorted(found)


def feature_matrix(long: DataFrame) -> DataFrame:
    """One row per region, one column per (family, feature) that occurs; absent cells are 0.

    `long` is read twice, so pass a stored table. Vocabularies beyond Spark's limit of pivot
    values stay in the long form, which is what the model steps read.
    """
    features = matrix_columns(long)
    labels = [f"{family}:{feature}" for family, feature in features]
    keyed = long.where(F.col("geo").isNotNull()).select(
        "geo", F.concat_ws(":", "family", F.coalesce("feature", F.lit(NO_LABEL))).alias("label"), "value"
    )
    wide = keyed.groupBy("geo").pivot("label", labels).agg(F.first("value"))
    columns = [
        F.coalesce(F.col(f"`{label}`"), F.lit(0.0)).alias(column_name(*feature))
        for label, feature in zip(labels, features, strict=True)
    ]
    return wide.select("geo", *columns)


def stored_shares(src: Tables, p: Params, ws: Workspace, registry: Sequence[Feature] = REGISTRY) -> DataFrame:
    """Shares over a stored feature table, written once."""
    return feature_shares(ws.child("features").save(feature_long(src, p, registry), "feature_long"), registry)
