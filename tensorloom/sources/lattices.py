"""Square lattices as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coords as C


def sites(spark: SparkSession, L: int) -> DataFrame:
    """(v, i, j) for every site."""
    v = (F.col("id") + 1).cast("int")
    return spark.range(L * L).select(v.alias("v"), C.row_of(v, L).alias("i"), C.col_of(v, L).alias("j"))


def square(spark: SparkSession, L: int, boundary: str = "periodic") -> DataFrame:
    """(u, w), u < w: right and down neighbours; periodic wraps around, open stops. On an L = 2 torus parallel edges merge."""
    if boundary not in ("periodic", "open"):
        raise ValueError(f"boundary must be 'periodic' or 'open', not {boundary!r}")
    v = F.col("v")
    ends = F.explode(F.array(C.translate(v, 0, 1, L, boundary), C.translate(v, 1, 0, L, boundary))).alias("x")
    e = sites(spark, L).select("v", ends).where((F.col("x") > 0) & (F.col("x") != v))
    return e.select(F.least("v", "x").alias("u"), F.greatest("v", "x").alias("w")).distinct()


def directed(edges: DataFrame) -> DataFrame:
    """(src, dst) both ways."""
    return edges.select(F.col("u").alias("src"), F.col("w").alias("dst")).union(edges.select(F.col("w").alias("src"), F.col("u").alias("dst")))


def graph_of(links: DataFrame, left: str, right: str) -> DataFrame:
    """A bipartite edge table from two key columns: right keys are numbered after the largest left key."""
    pairs = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct()
    top = pairs.agg(F.max("a").alias("top"))
    return pairs.join(F.broadcast(top)).select(F.col("a").alias("u"), (F.col("b") + F.col("top") + 1).alias("w"))
