"""Non-negative matrix factorisation of a long table.

Single rounds by multiplicative updates (Lee & Seung, 2001); whole fits by coordinate updates (HALS:
Cichocki & Phan, 2009), which settle in far fewer rounds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from terrane.functions.expressions import key_fraction
from terrane.session import Workspace

EPSILON = 1e-12

Gram = list[list[float]]


def components(rank: int) -> list[str]:
    return [f"w{c}" for c in range(rank)]


def initial_factor(cells: DataFrame, key: str, rank: int) -> DataFrame:
    """Repeatable positive start, from the text of each key."""
    start = [key_fraction(F.col(key), c).alias(name) for c, name in enumerate(components(rank))]
    return cells.select(key).distinct().select(key, *start)


def _inner_products(rank: int) -> list[str]:
    return [f"sum(w{i} * w{j})" for i in range(rank) for j in range(i, rank)]


def _symmetric(values: Sequence[float], rank: int) -> Gram:
    row = iter(values)
    matrix = [[0.0] * rank for _ in range(rank)]
    for i in range(rank):
        for j in range(i, rank):
            matrix[i][j] = matrix[j][i] = next(row) or 0.0
    return matrix


def saved_with_gram(factor: DataFrame, name: str, rank: int, ws: Workspace, drop: Sequence[str] = ()) -> tuple[DataFrame, Gram, float]:
    """Write a factor and collect, on the way, the rank x rank inner products of its columns.

    With the numerators still there (named in `drop`), also the inner product of the cells
    with both factors, of which the loss is made.
    """
    observed = Observation()
    sums = [F.expr(text).alias(f"g{n}") for n, text in enumerate(_inner_products(rank))]
    dot = " + ".join(f"w{c} * n{c}" for c in range(rank)) if drop else "0D"
    stored = ws.save(factor.observe(observed, *sums, F.expr(f"sum({dot})").alias("dot")).drop(*drop), name)
    return stored, _symmetric([observed.get[f"g{n}"] for n in range(len(sums))], rank), observed.get["dot"] or 0.0


def projected(cells: DataFrame, other: DataFrame, key: str, other_key: str, rank: int) -> DataFrame:
    """Per `key`: sum of cell value times the other factor's row.

    Absent cells are zeros and need no rows. The other factor is a stored table, so Catalyst
    knows its size and broadcasts it only below the threshold. The sums are combined before
    the shuffle, so a hot region or feature sends one row per task.
    """
    sums = [F.expr(f"sum(value * w{c}) AS n{c}") for c in range(rank)]
    return cells.join(other, other_key).groupBy(key).agg(*sums)


def updated_factor(
    cells: DataFrame, factor: DataFrame, other: DataFrame, other_gram: Gram, key: str, other_key: str, rank: int, inner: int
) -> DataFrame:
    """Multiplicative updates of `factor` with `other` held fixed.

    The numerators do not change while `other` is fixed, so further updates in the same round
    are projections only (accelerated updates: Gillis & Glineur, 2012).
    """
    numerators = [f"n{c}" for c in range(rank)]
    current = _with_numerators(cells, factor, other, key, other_key, rank)
    for _ in range(inner):
        updates = []
        for c in range(rank):
            denominator = " + ".join(f"w{d} * {other_gram[d][c]!r}D" for d in range(rank))
            updates.append(f"w{c} * n{c} / ({EPSILON!r}D + {denominator}) AS w{c}")
        current = current.selectExpr(key, *numerators, *updates)
    return current


def _with_numerators(cells: DataFrame, factor: DataFrame, other: DataFrame, key: str, other_key: str, rank: int) -> DataFrame:
    """Each key's weights, and the sums of its cells times the other factor's rows."""
    # One group-by sums the products of a key, map-side first, and carries its weights: no second join.
    weights, numerators = components(rank), [f"n{c}" for c in range(rank)]
    products = cells.join(other, other_key).selectExpr(
        key, *[f"value * w{c} AS n{c}" for c in range(rank)], *[f"CAST(NULL AS DOUBLE) AS {w}" for w in weights]
    )
    carried = factor.selectExpr(key, *[f"0D AS {n}" for n in numerators], *weights)
    totals = [*[f"sum({n}) AS {n}" for n in numerators], *[f"max({w}) AS {w}" for w in weights]]
    return products.unionAll(carried).groupBy(key).agg(*[F.expr(text) for text in totals])


def gram_of(factor: DataFrame, rank: int) -> Gram:
    """Inner products of the columns of a stored factor."""
    row = factor.agg(*[F.expr(text).alias(f"g{n}") for n, text in enumerate(_inner_products(rank))]).first()
    return _symmetric([row[f"g{n}"] for n in range(len(row))], rank)


def folded_in(cells: DataFrame, h: DataFrame, row: str, column: str, rank: int, sweeps: int = 500) -> DataFrame:
    """(row, w0, ...): the weights of rows that were not in the fit, by non-negative least squares on its column factor `h`.

    Columns that the fit has not seen do not count; a row without any other has weights of zero.
    """
    names = components(rank)
    known = cells.select(row).distinct().join(projected(cells, h, row, column, rank), row, "left")
    numerators = _array([f"coalesce(n{c}, 0D)" for c in range(rank)])
    start = _array(["0D"] * rank)
    solved = known.select(row, swept(start, numerators, gram_of(h, rank), sweeps).alias("_w"))
    return solved.select(row, *[F.get("_w", F.lit(c)).alias(w) for c, w in enumerate(names)])


def squared_norm(cells: DataFrame) -> float:
    return cells.agg(F.expr("sum(value * value)")).first()[0] or 0.0


def loss(
    cells: DataFrame, w: DataFrame, h: DataFrame, grams: tuple[Gram, Gram], row: str, column: str, rank: int, norm: float
) -> float:
    """Squared Frobenius distance of the cells and the product, zeros included, without building the product."""
    dot = " + ".join(f"w{c} * n{c}" for c in range(rank))
    inner = w.join(projected(cells, h, row, column, rank), row).agg(F.expr(f"sum({dot})")).first()[0] or 0.0
    crossed = sum(grams[0][i][j] * grams[1][i][j] for i in range(rank) for j in range(rank))
    return norm - 2.0 * inner + crossed


def _array(values: Sequence[str]) -> str:
    return f"array({', '.join(values)})"


def swept(weights: str, numerators: str, gram: Gram, sweeps: int) -> Column:
    """A row's weights after `sweeps` passes of coordinate updates against a fixed other factor.

    Each update is the exact minimum in its coordinate, held at zero. `weights` and `numerators` are
    SQL arrays. The inner products are one constant array of the plan, so every round runs the same
    compiled code, and the whole is one text, as building it call by call took longer than running it.
    """
    rank = len(gram)
    flat = _array([f"CAST('{x!r}' AS DOUBLE)" for row in gram for x in row])
    c = f"step % {rank}"
    own = f"get({flat}, ({c}) * {rank + 1})"
    inner = f"aggregate(sequence(0, {rank - 1}), 0D, (total, e) -> total + get({flat}, ({c}) * {rank} + e) * get(w, e))"
    moved = f"get(w, {c}) + (get({numerators}, {c}) - {inner}) / {own}"
    value = f"if({own} > CAST('{EPSILON!r}' AS DOUBLE), greatest({moved}, 0D), 0D)"
    return F.expr(f"aggregate(sequence(0, {rank * sweeps - 1}), {weights}, (w, step) -> transform(w, (x, d) -> if(d = {c}, {value}, x)))")


def swept_factor(
    cells: DataFrame, factor: DataFrame, other: DataFrame, other_gram: Gram, key: str, other_key: str, rank: int, sweeps: int
) -> DataFrame:
    """Coordinate updates of `factor` with `other` held fixed; the numerators stay beside the weights."""
    weights, numerators = components(rank), [f"n{c}" for c in range(rank)]
    current = _with_numerators(cells, factor, other, key, other_key, rank)
    packed = current.select(key, *numerators, swept(_array(weights), _array(numerators), other_gram, sweeps).alias("_w"))
    return packed.select(key, *numerators, *[F.get("_w", F.lit(c)).alias(w) for c, w in enumerate(weights)])


@dataclass(frozen=True)
class Factors:
    """Stored factors: `w` per row key, `h` per column key, and the loss before and after each round if traced."""

    w: DataFrame
    h: DataFrame
    losses: tuple[float, ...]


def factorise(cells: DataFrame, row: str, column: str, rank: int, rounds: int, inner: int, ws: Workspace, trace: bool = False) -> Factors:
    """A number of rounds of multiplicative updates of both factors.

    Each factor is written after its update, which cuts the lineage; only the two newest versions are kept.
    """
    return _alternated(cells, row, column, rank, rounds, inner, ws, updated_factor, trace)


def settled(cells: DataFrame, row: str, column: str, rank: int, limit: int, sweeps: int, ws: Workspace, tolerance: float) -> Factors:
    """Rounds of coordinate updates until one lowers the loss by less than `tolerance` of it.

    `limit` is a safety net, and reaching it is an error. The losses after each round are kept.
    """
    return _alternated(cells, row, column, rank, limit, sweeps, ws, swept_factor, False, tolerance)


def _alternated(cells, row, column, rank, rounds, inner, ws, update, trace, tolerance=None) -> Factors:
    ws = ws.child("factors")
    numerators = [f"n{c}" for c in range(rank)]
    cells = ws.save(cells.select(row, column, "value"), "cells")
    w, gram_w, _ = saved_with_gram(initial_factor(cells, row, rank), "w0", rank, ws)
    h, gram_h, _ = saved_with_gram(initial_factor(cells, column, rank), "h0", rank, ws)
    norm = squared_norm(cells) if trace or tolerance is not None else 0.0
    losses = [loss(cells, w, h, (gram_w, gram_h), row, column, rank, norm)] if trace else []
    for step in range(1, rounds + 1):
        moved = update(cells, w, h, gram_h, row, column, rank, inner)
        w, gram_w, _ = saved_with_gram(moved, f"w{step}", rank, ws, numerators)
        moved = update(cells, h, w, gram_w, column, row, rank, inner)
        h, gram_h, dot = saved_with_gram(moved, f"h{step}", rank, ws, numerators)
        ws.drop(f"w{step - 1}")
        ws.drop(f"h{step - 1}")
        losses.append(norm - 2.0 * dot + sum(gram_w[i][j] * gram_h[i][j] for i in range(rank) for j in range(rank)))
        if tolerance is not None and len(losses) > 1 and losses[-2] - losses[-1] <= tolerance * max(losses[-1], EPSILON):
            return Factors(w, h, tuple(losses))
    if tolerance is not None:
        raise RuntimeError(f"the factors have not settled after {rounds} rounds")
    return Factors(w, h, tuple(losses))
