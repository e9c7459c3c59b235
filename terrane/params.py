"""All settings of a run in one frozen object."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

# Order filters.
EXCLUDED_SKUS = (
    "9000000000",
    "6485920018",
    "6485930017",
    "9990490006",
    "9000000208",
    "9000000006",
    "6486000018",
)
EXCLUDED_ORDER_FLOWS = (8, 10, 11, 12)  # fulfilment that is no regular sale
ORIGINATION_CHANNELS = (102, 101)
ORDER_ENTRY_GROUPS = (1, -2, 4, 2, 3)
ORDER_ENTRY_APPLICATION = 3

# Session filters.
CATEGORY_TYPES = ("cat", "query")
SEARCH_TEMPLATE = "nav_search"
OUTLET_SITE = "outlet"

# Attribute pivot and region codes.
ACTIVITY_ATTRIBUTE = "PRIMARY_ACTIVITY_CODE"
REGION_SENTINELS = ("N/A", "UNK")
REGION_SENTINEL_CODE = "1"


@dataclass(frozen=True)
class Params:
    """One date window for both branches, plus the model settings.

    The window defaults are fixed values. The model settings are our defaults.
    """

    start_key: int = 20200201
    end_key: int = 20210102
    start_date: date = date(2020, 2, 1)
    end_date: date = date(2021, 1, 2)

    nmf_rank: int = 4
    nmf_rounds: int = 8  # of the query that shows the loss of the first rounds
    nmf_tolerance: float = 1e-4  # a run stops when a round lowers the loss by less than this share
    nmf_limit: int = 5000  # rounds after which a run that has not converged is an error
    nmf_inner: int = 3
    nmf_sweeps: int = 10  # passes over a row's weights in a round of a whole fit
    themes_top: int = 5
    perplexity: float = 5.0
    tsne_tolerance: float = 1e-3  # a run stops when points move by less than this share of the layout's span
    tsne_early: int = 50  # rounds of a run with exaggerated attraction
    tsne_limit: int = 10_000
    kmeans_limit: int = 500
    kmeans_tolerance: float = 1e-6
    segments: int = 4
    segment_counts: tuple[int, ...] = (3, 4, 5, 6)
    seeds: tuple[int, ...] = (1, 2, 3, 4)
    gap_references: int = 10
    bootstrap_replicates: int = 40
    seed: int = 1
