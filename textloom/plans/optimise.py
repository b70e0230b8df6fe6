"""Swarm loops. The state is as small as the swarm, so it stays on the driver between cycles; fitness is evaluated by Spark for all
particles at once, by a function from a table (particle, pos) to (particle, fitness and more)."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.pareto import local_front

from .swarm import Coefficients

Fitness = Callable[[DataFrame], DataFrame]
Callback = Callable[[int, pd.DataFrame], None]


@dataclass
class Result:
    position: list[float] | None
    log: pd.DataFrame
    archive: pd.DataFrame | None = None
    expand: Callable[[], DataFrame] | None = field(default=None, repr=False)

    @cached_property
    def replay(self) -> DataFrame | None:
        """The words that the winner expands to, made when they are asked for."""
        return self.expand and self.expand()


def _frame(spark: SparkSession, pos: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(pos)], "particle long, pos array<double>")


def _evaluate(spark: SparkSession, fitness: Fitness, pos: np.ndarray, names: Sequence[str]) -> np.ndarray:
    """Values by particle; a particle without a row has zeros. A fitness that has `values` gives them without a table of particles."""
    if hasattr(fitness, "values"):
        return fitness.values(pos, names)
    rows = fitness(_frame(spark, pos)).select("particle", *[F.col(n).cast("double") for n in names]).collect()  # one row a particle
    out = np.zeros((len(pos), len(names)))
    for r in rows:
        out[r[0]] = [np.nan if v is None else v for v in r[1:]]
    return out


def _rows(cycle: int, pos, vel, best, fit, best_fit, names) -> pd.DataFrame:
    d = {"icycle": cycle, "iparticle": np.arange(len(pos))}
    d |= {f"pos{i + 1}": pos[:, i] for i in range(pos.shape[1])} | {n: fit[:, i] for i, n in enumerate(names)}
    d |= {f"vel{i + 1}": vel[:, i] for i in range(pos.shape[1])} | {f"pbest{i + 1}": best[:, i] for i in range(pos.shape[1])} | {f"pbest_{n}": best_fit[:, i] for i, n in enumerate(names[: best_fit.shape[1]])}
    return pd.DataFrame(d)


class Cycles:
    """Where a swarm's state is written after each cycle, a Parquet folder for each, so that a run that was stopped can go on. Numbers
    are kept exactly, the random numbers' state too, so a resumed run equals an unbroken one."""

    def __init__(self, spark: SparkSession, path: str | None):
        self.spark, self.path = spark, path and path.rstrip("/")

    def save(self, cycle: int, rng: np.random.Generator, state: dict, rows: pd.DataFrame) -> None:
        if self.path:
            arrays = {k: np.asarray(v).tolist() for k, v in state.items()}
            text = json.dumps({"rng": rng.bit_generator.state, "state": arrays, "rows": rows.to_dict("list")}, default=lambda v: v.item())
            self.spark.createDataFrame([(cycle, text)], "cycle int, state string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/cycle={cycle}")

    def load(self, rng: np.random.Generator) -> tuple[int, dict, list[pd.DataFrame]]:
        """(last cycle, state, logs of all cycles), the random numbers set to go on from there; (-1, {}, []) if there is none. Cycles
        behind a missing one don't count."""
        if not self.path:
            return -1, {}, []
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return -1, {}, []
        stored = self.spark.read.schema("cycle int, state string").option("recursiveFileLookup", "true").parquet(self.path)
        found = {r["cycle"]: r["state"] for r in stored.collect()}  # a swarm for each cycle, as the log
        logs, last = [], -1
        while last + 1 in found:
            last += 1
            kept = json.loads(found[last])
            logs.append(pd.DataFrame(kept["rows"]))
        if last < 0:
            return -1, {}, []
        rng.bit_generator.state = kept["rng"]
        return last, {k: np.array(v) for k, v in kept["state"].items()}, logs


def pso(spark: SparkSession, fitness: Fitness, bounds: Sequence[tuple[float, float]], size: int = 100, cycles: int = 100, coefficients: Coefficients = Coefficients(), worst: float = -1.0, seed: int = 0, payload: Sequence[str] = (), callback: Callback | None = None, store: str | None = None) -> Result:
    """Maximises the column fitness; payload names further columns to keep. The result is the last leader's position. With a store (a
    folder) each cycle's state is written there, and a run goes on behind the last one that it holds."""
    rng, lo, hi = np.random.default_rng(seed), *np.array(bounds, float).T
    names = ["fitness", *payload]
    pos = rng.uniform(lo, hi, (size, len(lo)))
    vel, best, best_fit, lead = np.zeros_like(pos), np.zeros_like(pos), np.full((size, 1), worst), 0
    done = Cycles(spark, store)
    last, kept, logs = done.load(rng)
    if last >= 0:
        pos, vel, best, best_fit, lead = *[kept[k].astype(float) for k in ("pos", "vel", "best", "best_fit")], int(kept["lead"])
    for cycle in range(last + 1, cycles + 1):
        if cycle:
            r1, r2 = rng.random(pos.shape), rng.random(pos.shape)
            vel = coefficients.omega * vel + coefficients.c1 * r1 * (best - pos) + coefficients.c2 * r2 * (pos[lead] - pos)
            pos = np.clip(pos + vel, lo, hi)
        fit = _evaluate(spark, fitness, pos, names)
        f = fit[:, 0]
        better = ~np.isnan(f) & (f >= best_fit[:, 0])
        best[better], best_fit[better, 0] = pos[better], f[better]
        lead = 0 if np.isnan(f).all() else int(np.flatnonzero(f == np.nanmax(f))[-1])
        logs.append(_rows(cycle, pos, vel, best, fit, best_fit, names))
        done.save(cycle, rng, {"pos": pos, "vel": vel, "best": best, "best_fit": best_fit, "lead": lead}, logs[-1])
        if callback:
            callback(cycle, logs[-1])
    return Result(pos[lead].tolist(), pd.concat(logs, ignore_index=True))


def crowding(points: np.ndarray, widths: np.ndarray) -> np.ndarray:
    total, end = np.zeros(len(points)), np.zeros(len(points), bool)
    for d in range(points.shape[1]):
        order = np.argsort(points[:, d], kind="stable")
        end[order[[0, -1]]] = True
        total[order[1:-1]] += (points[order[2:], d] - points[order[:-2], d]) / widths[d]
    return np.where(end, np.finfo(float).max, total)


def mopso(spark: SparkSession, fitness: Fitness, objectives: Sequence[str], bounds: Sequence[tuple[float, float]], fitness_bounds: Sequence[tuple[float, float]], maximise: Sequence[bool], size: int = 100, cycles: int = 100, coefficients: Coefficients = Coefficients(), seed: int = 0, dedupe: bool = False, callback: Callback | None = None, store: str | None = None) -> Result:
    """Keeps an archive of non-dominated particles, from which each particle draws a leader in each dimension, sparse regions first.
    A member keeps the velocity, best position and best fitness that its particle had when it came in. With dedupe members of equal
    position and fitness are kept once; a store works as for pso()."""
    rng, lo, hi = np.random.default_rng(seed), *np.array(bounds, float).T
    sign, widths = np.where(maximise, 1.0, -1.0), np.array([b - a for a, b in fitness_bounds], float)
    pos = rng.uniform(lo, hi, (size, len(lo)))
    vel, best = np.zeros_like(pos), np.zeros_like(pos)
    best_fit = np.tile([a if up else b for (a, b), up in zip(fitness_bounds, maximise, strict=True)], (size, 1)).astype(float)
    dims, k = len(lo), len(objectives)
    archive = np.zeros((0, 3 * dims + 2 * k))  # of each member: position, velocity, best position, fitness, best fitness
    done = Cycles(spark, store)
    last, kept, logs = done.load(rng)
    if last >= 0:
        pos, vel, best, best_fit, archive = (kept[n].astype(float) for n in ("pos", "vel", "best", "best_fit", "archive"))
    parts = lambda rows: np.split(rows, [dims, 2 * dims, 3 * dims, 3 * dims + k], axis=1)
    for cycle in range(last + 1, cycles + 1):
        if cycle:
            archive_pos, _, _, archive_fit, _ = parts(archive)
            rank = np.empty(len(archive_fit), int)
            rank[np.argsort(crowding(archive_fit, widths), kind="stable")] = np.arange(1, len(archive_fit) + 1)
            drawn = rng.choice(len(rank), pos.shape, p=rank / rank.sum())
            lead = archive_pos[drawn, np.arange(pos.shape[1])]
            vel = coefficients.omega * vel + coefficients.c1 * rng.random(pos.shape) * (best - pos) + coefficients.c2 * rng.random(pos.shape) * (lead - pos)
            pos = np.clip(pos + vel, lo, hi)
        fit = _evaluate(spark, fitness, pos, objectives)
        a, b = best_fit * sign, fit * sign
        beaten = (a >= b).all(axis=1) & (a > b).any(axis=1)
        best[~beaten], best_fit[~beaten] = pos[~beaten], fit[~beaten]
        archive = np.vstack([archive, np.hstack([pos, vel, best, fit, best_fit])])
        archive = archive[local_front(parts(archive)[3] * sign)]
        if dedupe:
            _, first = np.unique(np.hstack([parts(archive)[0], parts(archive)[3]]), axis=0, return_index=True)
            archive = archive[np.sort(first)]
        at, speed, own, value, own_value = parts(archive)
        logs.append(_rows(cycle, at, speed, own, value, own_value, list(objectives)))
        done.save(cycle, rng, {"pos": pos, "vel": vel, "best": best, "best_fit": best_fit, "archive": archive}, logs[-1])
        if callback:
            callback(cycle, logs[-1])
    return Result(None, pd.concat(logs, ignore_index=True), logs[-1])
