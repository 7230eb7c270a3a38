"""Series of loop and cluster contributions by weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def cumulative(rows: DataFrame, value: str = "c", by: list[str] | None = None) -> DataFrame:
    """(by..., weight, at, upto): sum of each weight and of all weights up to it. Sums by weight come before the window."""
    by = by if by is not None else ["g"]
    at = rows.groupBy(*by, "weight").agg(F.sum(value).alias("at"))
    return at.withColumn("upto", F.sum("at").over(W.partitionBy(*by).orderBy("weight").rangeBetween(W.unboundedPreceding, 0)))


def z_series(loops: DataFrame, z: DataFrame, touching: DataFrame, log: bool = False) -> DataFrame:
    """(g, weight, at): order by order the loop sum of Z / Z_bp, or of its logarithm.

    Two loops contribute to Z where they share no vertex: half the square of sums less touching pairs and squares. To
    the logarithm they contribute where they touch, with a minus, and each loop with half its square.
    """
    lz = loops.select("loop_id", "weight").join(z, "loop_id").select("g", "loop_id", "weight", "z")
    single = lz.select("g", "weight", F.col("z").alias("c"))
    a, b = lz.alias("a"), lz.alias("b")
    t = touching.where("loop_a < loop_b").join(a, F.col("loop_a") == F.col("a.loop_id")).join(b, (F.col("loop_b") == F.col("b.loop_id")) & (F.col("a.g") == F.col("b.g")))
    pairs = t.select(F.col("a.g").alias("g"), (F.col("a.weight") + F.col("b.weight")).alias("weight"), (-F.col("a.z") * F.col("b.z")).alias("c"))
    squares = lz.select("g", (2 * F.col("weight")).alias("weight"), (-F.col("z") * F.col("z") / 2).alias("c"))
    rows = single.union(pairs).union(squares)
    if not log:
        sums = lz.groupBy("g", "weight").agg(F.sum("z").alias("s"))
        p, q = sums.alias("p"), sums.alias("q")
        rows = rows.union(p.join(q, F.col("p.g") == F.col("q.g")).select("p.g", F.col("p.weight") + F.col("q.weight"), F.col("p.s") * F.col("q.s") / 2))
    return rows.groupBy("g", "weight").agg(F.sum("c").alias("at"))


def polygon_free_energy(walks: DataFrame, betas: DataFrame) -> DataFrame:
    """(beta, f): -(log 2 + 2 log cosh beta + sum over n of polygons per site tanh(beta)^n); 2n closed walks are one polygon per site."""
    p = walks.select("steps", (F.col("n") / (2 * F.col("steps"))).alias("a"))
    s = p.join(F.broadcast(betas)).groupBy("beta").agg(F.sum(F.col("a") * F.pow(F.tanh("beta"), F.col("steps"))).alias("s"))
    return s.select("beta", (-(F.log(F.lit(2.0)) + 2 * F.log(F.cosh("beta")) + F.col("s"))).alias("f"))


def template_loops(spark, L: int) -> DataFrame:
    """(i, j, di, dj): origin and extent of the plaquette and the two dominoes at each site, the loops of weights 4 and 6."""
    shapes = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "di int, dj int")
    at = spark.range(L * L).select((F.floor(F.col("id") / L) + 1).cast("int").alias("i"), (F.col("id") % L + 1).cast("int").alias("j"))
    return at.join(F.broadcast(shapes))


def relative_error(f: Column, exact: Column) -> Column:
    return (f - exact) / F.abs(exact)


def one_site_total(c: DataFrame, per: int, compat: bool = False) -> DataFrame:
    """(g, weight, at): contributions of clusters through one site as a correction of -f, over `per` spins a site.

    A cluster counts 1 / (its number of sites); rows are (g, weight, total_loops, size, c). compat counts each whole and
    multiplies the two-loop clusters of weight 8 by 9 and of weight 10 by 12.
    """
    fix = F.when((F.col("weight") == 8) & (F.col("total_loops") == 2), 9.0).when((F.col("weight") == 10) & (F.col("total_loops") == 2), 12.0).otherwise(1.0)
    value = -F.col("c") * fix if compat else -F.col("c") / F.col("size") / per
    return c.groupBy("g", "weight").agg(F.sum(value).alias("at"))
