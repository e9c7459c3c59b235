"""Scalar expressions of the two feature branches, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrane.params import REGION_SENTINEL_CODE, REGION_SENTINELS


def nav_theme(breadcrumb: str, term: str) -> Column:
    """First breadcrumb level; the trimmed search term where there is no breadcrumb.

    The breadcrumb itself is not trimmed, and a leading bar gives an empty theme.
    """
    crumb = F.col(breadcrumb)
    return (
        F.when(F.contains(crumb, F.lit("|")), F.split_part(crumb, F.lit("|"), F.lit(1)))
        .when(crumb.isNull() | (crumb == ""), F.trim(F.col(term)))
        .otherwise(crumb)
    )


def null_search_flag(result_count: str) -> Column:
    """0 where the search returned something, else 1 (a NULL count included)."""
    return F.when(F.col(result_count) > 0, 0).otherwise(1)


def has_text(column: str) -> Column:
    """Not-empty test under three-valued logic: NULL for NULL, never coalesced."""
    return F.col(column) != ""


def region_code(code: Column, lenient: bool = False) -> Column:
    """Sentinel texts become code 1, the rest is cast to integer.

    The cast raises on other text; `lenient` turns such text into NULL instead.
    """
    mapped = F.when(code.isin(*REGION_SENTINELS), REGION_SENTINEL_CODE).otherwise(code)
    return mapped.try_cast("int") if lenient else mapped.cast("int")


def demand(net: str, price: str, cancelled: str) -> Column:
    """Net amount plus the value of cancelled units.

    Only the price is defaulted: a NULL cancelled quantity leaves the row out of the sum.
    """
    return F.col(net) + F.coalesce(F.col(price), F.lit(0)) * F.col(cancelled)


def cost(flag: str, quantity: str, price: str) -> Column:
    """Quantity at moving average price where the flag is 1, else 0."""
    return F.when(F.col(flag) == 1, F.col(quantity) * F.col(price)).otherwise(0)


def key_fraction(key: Column, component: int) -> Column:
    """A repeatable number in [0.1, 1.1) from the text of a key and a component index."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f"|{component}")))
    return F.lit(0.1) + F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform(key: Column, number: Column) -> Column:
    """A repeatable number inside (0, 1) from the text of a key and a number."""
    digest = F.md5(F.concat(key.cast("string"), F.lit("|"), number.cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
