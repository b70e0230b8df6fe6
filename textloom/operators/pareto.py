"""Dominance, Pareto fronts and the crowding of their members."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.session import materialize

from .ordered import ranked, with_neighbours

BLOCK = 512
CELLS = 1 << 22
PER_CELL = 4096  # vectors of a cell of the grid, about
MOST_STEPS = 1024
MOST_CELLS = 20_000


def dominates(x: Sequence[Column], y: Sequence[Column], maximise: Sequence[bool]) -> Column:
    """x is as good as y in every objective and better in one; a NaN compares false."""
    as_good, better = F.lit(True), F.lit(False)
    for a, b, up in zip(x, y, maximise, strict=True):
        clean = ~F.isnan(a) & ~F.isnan(b)
        as_good = as_good & clean & ((a >= b) if up else (a <= b))
        better = better | (clean & ((a > b) if up else (a < b)))
    return as_good & better


def local_front(points: np.ndarray) -> np.ndarray:
    """Which rows no other row dominates, all objectives maximised; equal rows stay together. Rows with a NaN stay and beat none."""
    keep = np.isnan(points).any(axis=1)
    clean = np.flatnonzero(~keep)
    if len(clean):
        distinct, group = np.unique(points[clean], axis=0, return_inverse=True)
        good = _front_of_two(distinct) if points.shape[1] == 2 else _front_of_many(distinct)
        keep[clean] = good[group.reshape(-1)]
    return keep


def _front_of_two(points: np.ndarray) -> np.ndarray:
    """Of distinct points in ascending order: those whose second value is above those of all points behind."""
    behind = np.append(np.maximum.accumulate(points[::-1, 1])[::-1][1:], -np.inf)
    return (points[:, 1] > behind) | ((points[:, 1] == behind) & np.isneginf(behind) & (np.arange(len(points)) == len(points) - 1))


def _front_of_many(points: np.ndarray) -> np.ndarray:
    """Of distinct points, by falling sum in blocks: a point that beats another has the larger sum, so it stands before (or, where sums
    are rounded alike, in reach of the second comparison)."""
    order = np.argsort(-np.clip(points, -1e300, 1e300).sum(axis=1), kind="stable")
    front = np.zeros((0, points.shape[1]))
    places = np.zeros(0, int)
    for begin in range(0, len(order), BLOCK):
        block = order[begin : begin + BLOCK]
        block = block[undominated(points[block], front)]
        block = block[undominated(points[block], points[block])]
        places = np.append(places[undominated(front, points[block])], block)
        front = points[places]
    good = np.zeros(len(points), bool)
    good[places] = True
    return good


def undominated(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which points none of the others dominates, without a NaN; the comparison holds about CELLS truth values at a time."""
    good = np.ones(len(points), bool)
    step = max(1, CELLS // max(len(others), 1))
    for begin in range(0, len(points) if len(others) else 0, step):
        some = points[begin : begin + step, None, :]
        worse = np.ones((len(some), len(others)), bool)
        better = np.zeros((len(some), len(others)), bool)
        for d in range(points.shape[1]):
            worse &= others[None, :, d] >= some[:, :, d]
            better |= others[None, :, d] > some[:, :, d]
        good[begin : begin + step] = ~(worse & better).any(axis=1)
    return good


def _cut_to_front(batches, at: list[int], signs: list[float]):
    """Of each batch its own front: any point of the whole front is in it."""
    for batch in batches:
        if len(batch):
            points = _points(batch, at) * signs
            yield batch.filter(pa.array(local_front(points)))


def _points(batch: pa.RecordBatch, at: Sequence[int]) -> np.ndarray:
    """The columns as doubles, a null as NaN."""
    return np.stack([batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float) for i in at], axis=1)


# A grid over the objectives: cuts[d] are quantiles of objective d, a cell is a vector of numbers of cuts below a value. Points of a cell that
# is above another in every number beat all of its points; otherwise only points of cells that are nowhere below can beat one.
def _cell(points: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, points[:, d], side="left") for d, c in enumerate(cuts)], axis=1)


def _beaten_cells(cells: np.ndarray) -> np.ndarray:
    """Which cells another one is above of in every number."""
    beaten = np.zeros(len(cells), bool)
    step = max(1, CELLS // max(len(cells), 1))
    for begin in range(0, len(cells), step):
        some = cells[begin : begin + step]
        above = np.ones((len(some), len(cells)), bool)
        for d in range(cells.shape[1]):
            above &= cells[None, :, d] > some[:, None, d]
        beaten[begin : begin + step] = above.any(axis=1)
    return beaten


def _number_cells(batches, cuts: list[np.ndarray], cells: dict[tuple, int] | None):
    """Vectors with the number of their cell, or with its numbers as text where `cells` is None; those of cells that are not in `cells` go."""
    for batch in batches:
        if len(batch):
            at = list(map(tuple, _cell(_points(batch, range(len(cuts))), cuts).tolist()))
            if cells is None:
                yield pa.RecordBatch.from_arrays([pa.array([",".join(map(str, c)) for c in at], pa.string())], names=["cell"])
            else:
                numbers = pa.array([cells.get(c) for c in at], pa.int32())
                whole = pa.RecordBatch.from_arrays([numbers, *batch.columns], names=["cell", *batch.schema.names])
                yield whole.filter(numbers.is_valid())


def _to_cells(batches, cells: np.ndarray):
    """Each vector for its own cell, and for each other one that it may beat a point of."""
    below: dict[int, np.ndarray] = {}
    for batch in batches:
        numbers = batch.column(0).to_numpy()
        for own in np.unique(numbers):
            if own not in below:
                at = np.flatnonzero((cells <= cells[own]).all(axis=1))
                below[own] = at[at != own]
            some = batch.filter(pa.array(numbers == own))
            for cell in (own, *below[own].tolist()):
                marks = [pa.array(np.full(len(some), cell, np.int32)), pa.array(np.full(len(some), cell == own))]
                yield pa.RecordBatch.from_arrays([*marks, *some.columns[1:]], names=["cell", "own", *some.schema.names[1:]])


def _front_of_cell(group: pa.Table) -> pa.Table:
    """The front of a cell's own vectors, less those that vectors of other cells beat."""
    own = group.column("own").to_numpy()
    points = np.stack([group.column(i).to_numpy() for i in range(2, group.num_columns)], axis=1)
    good = own.copy()
    good[own] = local_front(points[own])
    good[good] = undominated(points[good], points[~own])
    return group.filter(pa.array(good)).drop_columns(["cell", "own"])


def _front_in_cell(group: pa.Table) -> pa.Table:
    points = np.stack([group.column(i).to_numpy() for i in range(1, group.num_columns)], axis=1)
    return group.filter(pa.array(local_front(points)))


def front_vectors(vectors: DataFrame) -> DataFrame:
    """The front of distinct vectors (columns of doubles without NaN, all maximised), by a grid of quantiles: cells that another beats go,
    the fronts of the others are compared with those of the cells that are nowhere below. No task sees the whole front."""
    n, dims = vectors.count(), len(vectors.columns)
    if n <= PER_CELL:
        return vectors.select(F.lit(0).alias("cell"), "*").groupBy("cell").applyInArrow(_front_in_cell, _with("cell int", vectors)).drop("cell")
    steps = min(max(2, math.ceil((n / PER_CELL) ** (1 / max(dims - 1, 1)))), MOST_STEPS)
    while True:
        wanted = [i / steps for i in range(1, steps)]
        cuts = [np.unique(np.array(c, float)) for c in vectors.agg(*[F.percentile_approx(F.col(f"`{c}`"), wanted, 20 * steps) for c in vectors.columns]).first()]
        few = vectors.mapInArrow(partial(_number_cells, cuts=cuts, cells=None), "cell string").groupBy("cell").count()
        found = [r["cell"] for r in few.limit(MOST_CELLS + 1).select("cell").collect()]
        if len(found) <= MOST_CELLS or steps == 2:
            break
        steps = max(2, steps // 2)
    cells = np.array([list(map(int, c.split(","))) for c in found]).reshape(-1, dims)
    cells = cells[~_beaten_cells(cells)]
    numbers = {tuple(c): i for i, c in enumerate(cells.tolist())}
    own = vectors.mapInArrow(partial(_number_cells, cuts=cuts, cells=numbers), _with("cell int", vectors))
    fronts = own.groupBy("cell").applyInArrow(_front_in_cell, own.schema)
    sent = fronts.mapInArrow(partial(_to_cells, cells=cells), _with("cell int, own boolean", vectors))
    return sent.groupBy("cell").applyInArrow(_front_of_cell, vectors.schema)


def _with(more: str, vectors: DataFrame) -> str:
    return more + ", " + ", ".join(f"`{c}` double" for c in vectors.columns)


def pareto_front(rows: DataFrame, objectives: Sequence[str], maximise: Sequence[bool]) -> DataFrame:
    """Rows that no row dominates; equal rows are all kept, as are rows with a null or NaN in an objective, which beat none.

    Each Arrow batch is first cut to its own front. What is left is written, its distinct vectors are cut to the front by
    front_vectors(), and its rows are matched with them by value. Nothing is broadcast that Spark doesn't know to be small."""
    at = [rows.columns.index(o) for o in objectives]
    signs = [1.0 if up else -1.0 for up in maximise]
    few = materialize(rows.mapInArrow(partial(_cut_to_front, at=at, signs=signs), rows.schema), "fronts")
    values = [(F.col(f"`{o}`").cast("double") * s + 0.0).alias(f"__{i}") for i, (o, s) in enumerate(zip(objectives, signs, strict=True))]
    names = [f"__{i}" for i in range(len(signs))]
    odd = " or ".join(f"{c} is null or isnan({c})" for c in names)
    known = few.select("*", *values)
    front = front_vectors(known.where(f"not ({odd})").select(*names).distinct())
    return known.where(f"not ({odd})").join(front, names, "left_semi").unionByName(known.where(odd)).drop(*names)


def crowding_distance(front: DataFrame, objectives: Sequence[str], bounds: Sequence[tuple[float, float]], key: str) -> DataFrame:
    """front with distance: the largest double for a row at an end of any objective, else the sum over objectives of the gap
    between its neighbours, by the width of the configured bounds. Ties go by key. Neighbours are found in ranges of each objective."""
    rows, gaps, end = front, [], F.lit(False)
    for i, (o, (low, high)) in enumerate(zip(objectives, bounds, strict=True)):
        near = with_neighbours(rows, [o, key], [o])
        before, after = F.col(f"before_{o}"), F.col(f"after_{o}")
        gap = F.when(before.isNotNull() & after.isNotNull(), (after - before) / F.lit(float(high - low)))
        rows = near.withColumn(f"__gap{i}", gap).drop(f"before_{o}", f"after_{o}")
        gaps.append(F.coalesce(F.col(f"__gap{i}"), F.lit(0.0)))
        end = end | F.col(f"__gap{i}").isNull()
    total = reduce(lambda a, b: a + b, gaps, F.lit(0.0))
    return rows.withColumn("distance", F.when(end, F.lit(1.7976931348623157e308)).otherwise(total)).drop(*[f"__gap{i}" for i in range(len(gaps))])


def leader_weights(crowded: DataFrame, key: str) -> DataFrame:
    """crowded with rank (1 for the most crowded) and weight = rank / (l * (l + 1) / 2), so that sparse regions are favoured."""
    rows = materialize(ranked(crowded, ["distance", key]), "ranked")
    n = rows.count()
    return rows.withColumn("weight", F.col("rank") * F.lit(2.0) / F.lit(float(max(n, 1) * (n + 1))))
