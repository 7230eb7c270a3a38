"""Statistics of runs: pooling, fits, derivatives, look-ups on parameter grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def error_stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., n, mean, std): sample standard deviation, null for one value."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def batch_stats(rows: DataFrame, by: list[str], batch: str, value: str) -> DataFrame:
    """(by..., batches, mean, std) of the batches' means."""
    means = rows.groupBy(*by, batch).agg(F.avg(value).alias("m"))
    return means.groupBy(*by).agg(F.count("m").alias("batches"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("std"))


def pooled(runs: DataFrame, by: list[str]) -> DataFrame:
    """(by..., total, mean, std, se) of runs (n, mean, std): within and between runs; one grouped pass over sums."""
    n, m, s = F.col("n").cast("double"), F.col("mean"), F.coalesce("std", F.lit(0.0))
    agg = runs.groupBy(*by).agg(F.sum("n").alias("total"), F.sum(n * m).alias("s1"), F.sum(n * m * m).alias("s2"), F.sum((n - 1) * s * s).alias("within"))
    mean = F.col("s1") / F.col("total")
    var = (F.col("within") + F.greatest(F.col("s2") - F.col("total") * mean * mean, F.lit(0.0))) / (F.col("total") - 1)
    std = F.when(F.col("total") > 1, F.sqrt(var)).otherwise(0.0)
    return agg.select(*by, "total", mean.alias("mean"), std.alias("std"), (std / F.sqrt("total")).alias("se"))


def decay_fit(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by..., rate, intercept, r2) of log y = intercept - rate x; null with fewer than three points or a y not positive."""
    logy = F.when(F.col(y) > 0, F.log(y))
    agg = rows.groupBy(*by).agg(F.count(y).alias("n"), F.min(y).alias("least"), F.regr_slope(logy, F.col(x)).alias("slope"), F.regr_intercept(logy, F.col(x)).alias("intercept"), F.regr_r2(logy, F.col(x)).alias("r2"))
    ok = (F.col("n") >= 3) & (F.col("least") > 0)
    return agg.select(*by, F.when(ok, -F.col("slope")).alias("rate"), F.when(ok, F.col("intercept")).alias("intercept"), F.when(ok, F.col("r2")).alias("r2"))


def first_derivative(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """rows with `d1`: central differences, one-sided at the ends."""
    w = W.partitionBy(*by).orderBy(x)
    lo, hi = F.struct(F.coalesce(F.lag(x).over(w), F.col(x)).alias("x"), F.coalesce(F.lag(y).over(w), F.col(y)).alias("y")), F.struct(F.coalesce(F.lead(x).over(w), F.col(x)).alias("x"), F.coalesce(F.lead(y).over(w), F.col(y)).alias("y"))
    return rows.withColumns({"_lo": lo, "_hi": hi}).withColumn("d1", F.when(F.col("_hi.x") > F.col("_lo.x"), (F.col("_hi.y") - F.col("_lo.y")) / (F.col("_hi.x") - F.col("_lo.x")))).drop("_lo", "_hi")


def second_derivative(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """rows with `d2` on an even grid: central, the ends take the neighbouring stencil; null below three points."""
    w = W.partitionBy(*by).orderBy(x)
    at = lambda c, k: F.col(c) if k == 0 else (F.lead(c, k).over(w) if k > 0 else F.lag(c, -k).over(w))
    stencil = lambda k: (at(y, k - 1) - 2 * at(y, k) + at(y, k + 1)) / F.pow(at(x, k + 1) - at(x, k), F.lit(2))
    return rows.withColumn("d2", F.coalesce(stencil(0), stencil(1), stencil(-1)))


def peak(rows: DataFrame, by: list[str], x: str, d2: str) -> DataFrame:
    """(by..., peak): where the absolute value is largest, the smallest x of ties."""
    return rows.where(F.col(d2).isNotNull()).groupBy(*by).agg(F.max(F.struct(F.abs(d2).alias("a"), (-F.col(x)).alias("x"))).alias("m")).select(*by, (-F.col("m.x")).alias("peak"))


def nearest(rows: DataFrame, targets: DataFrame, x: str, target: str, tolerance: float) -> DataFrame:
    """targets with the columns of the row whose x is nearest and within the tolerance; the smaller x of ties.

    The axis is cut into cells of the tolerance, so that a target only meets rows of its own and neighbouring cells.
    """
    cell = lambda c: F.floor(F.col(c) / tolerance)
    t = targets.withColumn("_cell", F.explode(F.array(cell(target) - 1, cell(target), cell(target) + 1)))
    j = t.join(rows.withColumn("_cell", cell(x)), "_cell").where(F.abs(F.col(x) - F.col(target)) <= tolerance)
    rest = [c for c in rows.columns if c != x]
    best = j.groupBy(target).agg(F.min(F.struct(F.abs(F.col(x) - F.col(target)).alias("_d"), F.col(x), *rest)).alias("b"))
    return best.select(target, *[F.col(f"b.{c}").alias(c) for c in [x, *rest]])


def missing(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """The expected combinations that were not found."""
    return expected.select(*keys).distinct().join(found.select(*keys).distinct(), keys, "left_anti")


def completion(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(expected, found, rate)."""
    e = expected.select(*keys).distinct().join(found.select(*keys).distinct().withColumn("_f", F.lit(1)), keys, "left")
    return e.agg(F.count(F.lit(1)).alias("expected"), F.count("_f").alias("found")).withColumn("rate", F.col("found") / F.col("expected"))


def improvement(without: Column, with_: Column) -> Column:
    """without / with, 1 where the denominator is 0."""
    return F.when(with_ == 0, 1.0).otherwise(without / with_)


def first_known(rows: DataFrame, names: list[str]) -> Column:
    """The first of the columns that the table has and that is not null."""
    return F.coalesce(*[F.col(n) for n in names if n in rows.columns], F.lit(None).cast("double"))


def grid(spark, axes: dict[str, list]) -> DataFrame:
    """(task, axes...): every combination, the last axis fastest, tasks numbered from 1."""
    size = reduce(lambda a, b: a * len(b), axes.values(), 1)
    cols, step = [], size
    for name, values in axes.items():
        step //= len(values)
        cols.append(F.get(F.array(*map(F.lit, values)), (F.floor(F.col("id") / step) % len(values)).cast("int")).alias(name))
    return spark.range(size).select((F.col("id") + 1).alias("task"), *cols)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
