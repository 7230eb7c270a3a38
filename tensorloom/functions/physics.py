"""Closed forms of the models."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def nishimori_beta(p: Column) -> Column:
    """Inverse temperature at which the random-bond model describes error rate p."""
    return -0.5 * F.log(p / (1 - p))


def bethe_critical_beta(q: Column) -> Column:
    """Where belief propagation leaves the paramagnetic fixed point, for coordination q."""
    return 0.5 * F.log(q / (q - 2))


CRITICAL_BETA = math.log(1 + math.sqrt(2)) / 2


def spin(k: Column) -> Column:
    """Index 1, 2 as spin +1, -1."""
    return 3 - 2 * k


def flipped_spin(k: Column) -> Column:
    """Index 1, 2 as spin -1, +1."""
    return 2 * k - 3


def bethe_free_energy(beta: Column) -> Column:
    """Free energy per spin times beta at uniform messages on the square lattice."""
    t = F.tanh(beta)
    return -(F.log(F.lit(2.0)) + 2 * F.log(F.cosh(beta)) + 0.5 * F.log(1 + t * t * t * t))


def onsager(spark: SparkSession, betas: DataFrame, points: int = 400) -> DataFrame:
    """(beta, f_exact): the exact 2D free energy per spin times beta, by the midpoint rule of the double integral."""
    step = math.pi / points
    grid = spark.range(points * points).select(((F.floor(F.col("id") / points) + 0.5) * step).alias("x"), ((F.col("id") % points + 0.5) * step).alias("y"))
    lattice = grid.select((F.cos("x") + F.cos("y")).alias("c"))
    k = F.cosh(2 * F.col("beta")) * F.cosh(2 * F.col("beta"))
    term = F.log(k - F.sinh(2 * F.col("beta")) * F.col("c"))
    return lattice.join(F.broadcast(betas), how="cross").groupBy("beta").agg((-(F.log(F.lit(2.0)) + F.avg(term) / 2)).alias("f_exact"))


def completion_seconds(L: Column) -> Column:
    """A rough upper bound of the seconds to enumerate the clusters of an L x L lattice; null where none is known."""
    return F.when(L <= 4, 1).when(L <= 6, 10).when(L <= 8, 60).when(L <= 10, 300)
