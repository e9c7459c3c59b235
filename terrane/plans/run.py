"""One run: refresh if needed, features, themes, layout, segments, and the published mapping."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from terrane.operators import matching
from terrane.params import Params
from terrane.plans import features, refresh, segments
from terrane.session import Workspace
from terrane.sources.tables import Tables


def run(src: Tables, p: Params, sink: refresh.Sink, csv_path: str | None = None, day: str | None = None) -> dict[str, DataFrame]:
    """Everything from the sources to the published mapping; the stored results by name.

    The tables are refreshed only if a source or the window has changed. The number of segments
    is the one of `segment_counts` with the best silhouette. Segments are numbered as in the
    mapping published before, where most of their regions are; `segment_history` holds every
    region's segments with the days they were valid (`day`, else the end of the window). Tables
    of the steps are removed.
    """
    refresh.refresh_if_needed(src, p, sink)
    facts = sink.read("order_facts")
    ws = Workspace(facts.sparkSession, "run")
    try:
        long = ws.save(features.feature_long(src, p, stored_sessions=sink.read("search_sessions"), stored_facts=facts), "features")
        shares = ws.save(features.feature_shares(long), "shares")
        factors = segments.settled_factors(shares, p, ws)
        placed = segments.layout(factors, p, ws)
        metrics = sink.replace("segment_metrics", segments.segment_count_sweep(placed, p, ws))
        chosen = replace(p, segments=segments.chosen_count(metrics))
        # Segments keep the numbers that the ranking program knows them by.
        earlier = sink.read("segment_map")
        labels = ws.save(matching.renumbered(segments.segment_labels(placed, chosen, ws), earlier), "labels")
        history = sink.read("segment_history")
        published = {
            "segment_metrics": metrics,
            "segment_stability": sink.replace("segment_stability", segments.segment_stability(placed, chosen, ws)),
            "segment_profile": sink.replace("segment_profile", segments.segment_profile(shares, labels)),
            "theme_top_features": sink.replace("theme_top_features", segments.theme_top_features(factors, p)),
            "segment_history": sink.replace("segment_history", matching.with_history(labels, history, day or p.end_date.isoformat())),
            "segment_map": sink.replace("segment_map", segments.segment_map(labels, src, p, facts)),
        }
    finally:
        ws.clear()
    if csv_path:
        refresh.export_csv(published["segment_map"], csv_path)
    return published
