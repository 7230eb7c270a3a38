"""From a lattice to a free energy: belief propagation, loops, clusters, and the exact values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import physics
from ..operators import bp, clusters, loops, series
from ..session import table
from ..sources import catalog, lattices, tensors


def bethe(spark: SparkSession, L: int, betas: list[float], rounds: int = 1) -> DataFrame:
    """(beta, f_bp): free energy per spin times beta, 2 L^2 spins, from messages after so many rounds of updates."""
    return bethe_at(spark, L, betas, rounds).withColumnRenamed("g", "beta")


def bethe_at(spark: SparkSession, L: int, points: list[float] | DataFrame, rounds: int = 1) -> DataFrame:
    """(g, f_bp): bethe() at parameter points, couplings or a table (g, beta)."""
    t, s = tensors.ising(spark, L, points)
    m = bp.start(t, s)
    for _ in range(rounds):
        m = bp.step(t, s, m)
    return bp.log_partition(bp.local_z(t, s, m)).select("g", (-F.col("logz") / (2 * L * L)).alias("f_bp"))


def compare(spark: SparkSession, L: int, betas: list[float]) -> DataFrame:
    """(beta, f_bp, f_exact, abs_err) against the exact free energy of the infinite lattice."""
    points = spark.createDataFrame([(float(b),) for b in betas], "beta double")
    j = bethe(spark, L, betas).join(physics.onsager(spark, points), "beta")
    return j.select("beta", "f_bp", "f_exact", F.abs(F.col("f_bp") - F.col("f_exact")).alias("abs_err"))


def compare_at(spark: SparkSession, L: int, points: DataFrame) -> DataFrame:
    """(g, beta, f_bp, f_exact) of a table (g, beta)."""
    exact = physics.onsager(spark, points.select("beta").distinct())
    return bethe_at(spark, L, points).join(points, "g").join(exact, "beta").select("g", "beta", "f_bp", "f_exact")


def one_site_clusters(spark: SparkSession, L: int, weight: int) -> tuple[DataFrame, DataFrame]:
    """(loops of the whole torus, clusters through one site): loops are found at one site and moved over the torus."""
    one = loops.find(lattices.square(spark, L), weight, at=1)
    every = table(loops.numbered(loops.translates(one, L)))
    return every, table(clusters.numbered(clusters.grow(every, table(clusters.interactions(every)), weight, at=1)))


def from_clusters(spark: SparkSession, L: int, betas: list[float], every: DataFrame, found: DataFrame) -> DataFrame:
    """(beta, weight, f): free energy per spin with the clusters of each weight and below, each one part in its number of sites."""
    t, s = tensors.ising(spark, L, betas)
    m = table(bp.step(t, s, bp.start(t, s)))
    z = table(bp.loop_contributions(t, s, m, every.join(found.select(F.explode("members.loop_id").alias("loop_id")).distinct(), "loop_id", "left_semi")))
    c = clusters.contributions(found, clusters.ursell(found, table(clusters.interactions(every))), z)
    size = clusters.sites(found, every).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    rows = c.join(size, "cluster_id").join(found.select("cluster_id", "total_loops"), "cluster_id")
    upto = series.cumulative(series.one_site_total(rows, per=2), "at")
    base = bp.log_partition(bp.local_z(t, s, m)).select("g", (-F.col("logz") / (2 * L * L)).alias("f0"))
    return upto.join(base, "g").select(F.col("g").alias("beta"), "weight", (F.col("f0") + F.col("upto")).alias("f"))


def corrected(spark: SparkSession, L: int, betas: list[float], weight: int) -> DataFrame:
    """(beta, weight, f): free energy per spin with all clusters of loops up to each weight; loops of the whole torus."""
    return from_clusters(spark, L, betas, *one_site_clusters(spark, L, weight))


def save_clusters(spark: SparkSession, root: str, L: int, weight: int, run: str) -> None:
    """Enumerate once and save loops and clusters as a run of the catalogue."""
    every, found = one_site_clusters(spark, L, weight)
    catalog.save_run(spark, root, {"loops": every, "clusters": found}, L=L, max_weight=weight, bc="periodic", run=run)


def from_saved(spark: SparkSession, root: str, L: int, betas: list[float], weight: int) -> DataFrame:
    """from_clusters of the latest saved run of that lattice and weight whose files can be read."""
    load = lambda name: catalog.load_latest(spark, root, name, L=L, max_weight=weight, bc="periodic")
    return from_clusters(spark, L, betas, table(load("loops")), table(load("clusters")))
