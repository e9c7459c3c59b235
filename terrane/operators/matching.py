"""Numbers of groups that stay the same from one run to the next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_assignment(gain: Sequence[Sequence[float]]) -> list[int]:
    """The column of each row, all different, with the greatest total gain: the Hungarian method on a square matrix."""
    n = len(gain)
    cost = [[-g for g in row] for row in gain]
    row_price, column_price, row_of = [0.0] * (n + 1), [0.0] * (n + 1), [n] * (n + 1)
    for row in range(n):
        row_of[n], at = row, n
        slack, via, used = [float("inf")] * n, [n] * n, [False] * (n + 1)
        while row_of[at] != n:
            used[at] = True
            here, step, after = row_of[at], float("inf"), n
            for c in range(n):
                if not used[c]:
                    left = cost[here][c] - row_price[here] - column_price[c]
                    if left < slack[c]:
                        slack[c], via[c] = left, at
                    if slack[c] < step:
                        step, after = slack[c], c
            for c in range(n + 1):
                if used[c]:
                    row_price[row_of[c]] += step
                    column_price[c] -= step
                elif c < n:
                    slack[c] -= step
            at = after
        while at != n:
            row_of[at], at = row_of[via[at]], via[at]
    found = [0] * n
    for c in range(n):
        found[row_of[c]] = c
    return found


def renumbered(labels: DataFrame, earlier: DataFrame | None, key: str = "geo") -> DataFrame:
    """`labels` (key, segment) with the segment numbers of `earlier` where the members are the same.

    New segments are matched one to one with the old ones, so that as many keys as possible keep
    their number; a segment that none is left for takes the smallest numbers not in use. The
    table of counts, old by new segments, is all that comes to the driver. Keys with a null
    segment keep it.
    """
    if earlier is None:
        return labels
    old = earlier.select(key, F.col("segment").alias("_old")).where("_old IS NOT NULL").dropDuplicates([key])
    counted = labels.where("segment IS NOT NULL").join(old, key, "left").groupBy("segment", "_old").agg(F.count("*").alias("n")).collect()
    new_numbers = sorted({r["segment"] for r in counted})
    old_numbers = sorted({r["_old"] for r in counted if r["_old"] is not None})
    size = max(len(new_numbers), len(old_numbers))
    gain = [[0.0] * size for _ in range(size)]
    for r in counted:
        if r["_old"] is not None:
            gain[new_numbers.index(r["segment"])][old_numbers.index(r["_old"])] = float(r["n"])
    chosen = best_assignment(gain)
    named: dict[int, int] = {}
    for i, number in enumerate(new_numbers):
        if chosen[i] < len(old_numbers):
            named[number] = old_numbers[chosen[i]]
    taken = set(named.values())
    spare = (n for n in range(size + len(taken) + 1) if n not in taken)
    for number in new_numbers:
        if number not in named:
            named[number] = next(spare)
    if not named:
        return labels
    pairs = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])
    return labels.withColumn("segment", F.element_at(pairs, F.col("segment")).cast(labels.schema["segment"].dataType))


HISTORY = ("valid_from", "valid_to")


def with_history(labels: DataFrame, history: DataFrame | None, day: str, key: str = "geo") -> DataFrame:
    """(key, segment, valid_from, valid_to): the history with the labels of `day` entered.

    Rows in force have a null `valid_to`. A key whose segment is unchanged keeps its row; otherwise the
    row ends on `day`, and a new one starts if the key still has a segment.
    """
    today = F.lit(day).cast("date")
    now = labels.where("segment IS NOT NULL").select(key, "segment")
    started = lambda rows: rows.select(key, "segment", today.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    if history is None:
        return started(now)
    ended = history.where("valid_to IS NOT NULL")
    current = history.where("valid_to IS NULL")
    same = current.join(now, [key, "segment"], "left_semi")
    gone = current.join(now, [key, "segment"], "left_anti").withColumn("valid_to", today)
    fresh = started(now.join(current.select(key, "segment"), [key, "segment"], "left_anti"))
    return ended.unionByName(same).unionByName(gone).unionByName(fresh)
