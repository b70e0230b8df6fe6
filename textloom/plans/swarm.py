"""Single steps of particle swarms, set-at-a-time over a table of particles.

A swarm is a table (particle long, pos, vel, pbest array<double>, fitness, pbest_fitness, ...); a step is one expression over
all particles, with the leader as one broadcast row. Random numbers are columns, so a step can be repeated.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators.pareto import dominates


@dataclass(frozen=True)
class Coefficients:
    c1: float = 0.2
    c2: float = 0.2
    omega: float = 0.02


def uniform(key: Column, salt: int, dim: Column) -> Column:
    """A number in [0, 1) from a particle, a salt and a dimension; the same on every run."""
    return F.pmod(F.xxhash64(key.cast("long"), F.lit(salt), dim.cast("int")), F.lit(1 << 30)) / F.lit(float(1 << 30))


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))


def bounds_column(bounds: Sequence[tuple[float, float]]) -> Column:
    return F.array(*[F.struct(F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for a, b in bounds])


def initial(spark: SparkSession, size: int, bounds: Sequence[tuple[float, float]], seed: int = 0) -> DataFrame:
    """particle, pos (uniform in the bounds), vel (0) and pbest (0)."""
    zeros = F.array(*[F.lit(0.0)] * len(bounds))
    pos = F.transform(bounds_column(bounds), lambda b, i: b["lo"] + (b["hi"] - b["lo"]) * uniform(F.col("id"), seed, i))
    return spark.range(size).select(F.col("id").alias("particle"), pos.alias("pos"), zeros.alias("vel"), zeros.alias("pbest"))


def personal_best(swarm: DataFrame) -> DataFrame:
    """Position and fitness become the particle's best where fitness is as good; a NaN changes nothing."""
    better = ~F.isnan("fitness") & (F.col("fitness") >= F.col("pbest_fitness"))
    return swarm.withColumns({"pbest": F.when(better, F.col("pos")).otherwise(F.col("pbest")), "pbest_fitness": F.when(better, F.col("fitness")).otherwise(F.col("pbest_fitness"))})


def leader(swarm: DataFrame) -> DataFrame:
    """One row, leader: the particle with the largest current fitness, the last of equals; 0 if all are NaN."""
    ranked = F.when(~F.isnan("fitness"), F.struct("fitness", "particle"))
    return swarm.agg(F.coalesce(F.max(ranked)["particle"], F.lit(0)).cast("long").alias("leader"))


def move(swarm: DataFrame, towards: DataFrame, coefficients: Coefficients, bounds: Sequence[tuple[float, float]], r1: Column | None = None, r2: Column | None = None, salt: int = 0) -> DataFrame:
    """Velocity and position of all particles after one step towards their best and a leader's position (column lpos of the one
    row `towards`, or of a column of that name in swarm). r1 and r2 are arrays of random numbers; positions are clamped, velocities not."""
    n = len(bounds)
    r1 = F.array(*[uniform(F.col("particle"), 2 * salt + 1, F.lit(d)) for d in range(n)]) if r1 is None else r1
    r2 = F.array(*[uniform(F.col("particle"), 2 * salt + 2, F.lit(d)) for d in range(n)]) if r2 is None else r2
    rows = swarm
    if "lpos" not in swarm.columns:
        rows = swarm.withColumn("one", F.lit(1)).join(F.broadcast(towards.withColumn("one", F.lit(1))), "one").drop("one")  # one row
    at = lambda c, d: F.get(F.col(c), d)
    vel = [F.lit(coefficients.omega) * at("vel", d) + F.lit(coefficients.c1) * F.get(r1, d) * (at("pbest", d) - at("pos", d)) + F.lit(coefficients.c2) * F.get(r2, d) * (at("lpos", d) - at("pos", d)) for d in range(n)]
    rows = rows.withColumn("vel", F.array(*vel))
    pos = [clamp(at("pos", d) + at("vel", d), F.lit(float(lo)), F.lit(float(hi))) for d, (lo, hi) in enumerate(bounds)]
    return rows.withColumn("pos", F.array(*pos)).drop("lpos")


def personal_best_pareto(swarm: DataFrame, maximise: Sequence[bool]) -> DataFrame:
    """As personal_best, for vectors of fitness: unless the best dominates the current, the current becomes the best."""
    n = len(maximise)
    beaten = dominates([F.get("pbest_fitness", d) for d in range(n)], [F.get("fitness", d) for d in range(n)], maximise)
    return swarm.withColumns({"pbest": F.when(~beaten, F.col("pos")).otherwise(F.col("pbest")), "pbest_fitness": F.when(~beaten, F.col("fitness")).otherwise(F.col("pbest_fitness"))})


def draw_leaders(weighted: DataFrame, particles: DataFrame, dims: int, salt: int = 0) -> DataFrame:
    """particle, lpos: in each dimension the position of a member of the archive (pos, weight) drawn by weight, anew for each
    particle and dimension. The archive is one row of cumulative weights, so drawing is a look-up in an array."""
    w = Window.orderBy("rank")
    table = weighted.withColumn("upto", F.sum("weight").over(w)).agg(F.sort_array(F.collect_list(F.struct("upto", "rank", "pos"))).alias("members"))
    rows = particles.select("particle").withColumn("one", F.lit(1)).join(F.broadcast(table.withColumn("one", F.lit(1))), "one")  # one row

    def drawn(d: int) -> Column:
        r = uniform(F.col("particle"), 1_000_003 + salt, F.lit(d))
        first = F.get(F.filter("members", lambda m: m["upto"] > r), 0)
        return F.get(F.coalesce(first, F.element_at("members", -1))["pos"], d)

    return rows.select("particle", F.array(*[drawn(d) for d in range(dims)]).alias("lpos"))
