"""Codes as tables of support: pcm (chk, bit), edge sets (set_id, e), bits (sample_id, bit, x)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coords as C


def h_edge(i: Column, j: Column, L: int) -> Column:
    """Edge of the first group at (i, j), around the torus."""
    return C.site(C.wrap(i, L), C.wrap(j, L), L)


def v_edge(i: Column, j: Column, L: int) -> Column:
    """Edge of the second group at (i, j)."""
    return (h_edge(i, j, L) + L * L).cast("int")


def _cells(spark: SparkSession, L: int) -> DataFrame:
    v = (F.col("id") + 1).cast("int")
    return spark.range(L * L).select(v.alias("k"), C.row_of(v, L).alias("i"), C.col_of(v, L).alias("j"))


def toric(spark: SparkSession, L: int) -> DataFrame:
    """(chk, bit): each vertex checks the first-group edges of its row and the one above, the second-group edges of its column and the one before."""
    i, j = F.col("i"), F.col("j")
    star = F.array(h_edge(i - 1, j, L), h_edge(i, j, L), v_edge(i, j - 1, L), v_edge(i, j, L))
    return _cells(spark, L).select(F.col("k").alias("chk"), F.explode(star).alias("bit"))


def plaquettes(spark: SparkSession, L: int) -> DataFrame:
    """(p, bit): the four edges around each plaquette."""
    i, j = F.col("i"), F.col("j")
    ring = F.array(h_edge(i, j, L), h_edge(i, j + 1, L), v_edge(i, j, L), v_edge(i + 1, j, L))
    return _cells(spark, L).select(F.col("k").alias("p"), F.explode(ring).alias("bit"))


def cycle(spark: SparkSession, L: int, group: str, at: int = 1) -> DataFrame:
    """(e): "h": first-group edges of a column, "v": second-group edges of a row; both go around the torus."""
    k = (F.col("id") + 1).cast("int")
    return spark.range(L).select((h_edge(k, F.lit(at), L) if group == "h" else v_edge(F.lit(at), k, L)).alias("e"))


def logicals(spark: SparkSession, L: int) -> DataFrame:
    """(op, bit): the two logical operators."""
    return cycle(spark, L, "h").select(F.lit(1).alias("op"), F.col("e").alias("bit")).union(cycle(spark, L, "v").select(F.lit(2), "e"))


def shuffled(seed: int, *cols: Column) -> Column:
    """A pseudo-random number in 0..999982 from small whole numbers, alike in every engine: two rounds of modular mixing."""
    x = F.lit(seed).cast("long")
    for c in cols:
        x = F.pmod((x * 7919 + c.cast("long") * 104729 + 12345) * ((x + c.cast("long")) % 997 + 1), F.lit(999983))
    return F.pmod(x * x + 3 * x + 17, F.lit(999983))


def gallager(spark: SparkSession, n: int, d_v: int, d_c: int, seed: int = 1) -> DataFrame:
    """(chk, bit) of a regular code: d_v times the bits in another order, cut into checks of d_c. ValueError unless d_c divides n."""
    if n * d_v % d_c or n % d_c:
        raise ValueError("d_c must divide n and n * d_v")
    from pyspark.sql.window import Window as W

    rows = spark.range(n * d_v).select(F.floor(F.col("id") / n).cast("int").alias("layer"), (F.col("id") % n + 1).cast("int").alias("bit"))
    rank = F.row_number().over(W.partitionBy("layer").orderBy(shuffled(seed, F.col("layer"), F.col("bit")), "bit")) - 1
    return rows.select((F.col("layer") * (n // d_c) + F.floor(rank / d_c) + 1).cast("int").alias("chk"), "bit")


def bch(spark: SparkSession, m: int, t: int) -> DataFrame:
    """(chk, bit): binary parity checks of the BCH code of length 2^m - 1 that corrects t errors, row-reduced.

    The field is given by its least primitive polynomial; the table has under 2^m * m * t entries.
    """
    n = (1 << m) - 1

    def powers(poly: int) -> list[int]:
        out, x = [], 1
        for _ in range(n):
            out.append(x)
            x = (x << 1) ^ (poly if x >> (m - 1) & 1 else 0)
        return out

    field = next(p for p in map(powers, range((1 << m) + 1, 2 << m, 2)) if len(set(p)) == n)
    rows = []
    for k in range(1, 2 * t, 2):
        for b in range(m):
            rows.append(sum(((field[k * j % n] >> b) & 1) << j for j in range(n)))
    reduced: list[int] = []
    for r in rows:
        for q in reduced:
            r = min(r, r ^ q)
        if r:
            reduced = sorted([min(q, q ^ r) for q in reduced] + [r], reverse=True)
    return spark.createDataFrame([(c + 1, j + 1) for c, r in enumerate(reduced) for j in range(n) if r >> j & 1], "chk int, bit int")


def errors(spark: SparkSession, samples: int, bits: int, p: float, seed: int = 1) -> DataFrame:
    """(sample_id, bit, x): independent flips of probability p, reproducible in any engine."""
    rows = spark.range(samples * bits).select((F.floor(F.col("id") / bits) + 1).cast("long").alias("sample_id"), (F.col("id") % bits + 1).cast("int").alias("bit"))
    return rows.select("sample_id", "bit", (shuffled(seed, F.col("sample_id"), F.col("bit")) < int(p * 999983)).cast("int").alias("x"))


def fixed_weight(spark: SparkSession, samples: int, bits: int, weight: int, seed: int = 1) -> DataFrame:
    """(sample_id, bit, x) with exactly `weight` ones in each sample."""
    from pyspark.sql.window import Window as W

    rows = errors(spark, samples, bits, 0.0, seed).drop("x")
    rank = F.row_number().over(W.partitionBy("sample_id").orderBy(shuffled(seed, F.col("sample_id"), F.col("bit")), "bit"))
    return rows.select("sample_id", "bit", (rank <= weight).cast("int").alias("x"))
