"""Incremental pooling of result files as they arrive; an extension, no counterpart of a batch operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def result_files(spark: SparkSession, path: str, schema: str, format: str = "parquet", files: int = 100) -> DataFrame:
    """A stream of the rows of result files in a folder."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return r.option("header", True).csv(path) if format == "csv" else r.format(format).load(path)


def pooled(stream: DataFrame, by: list[str]) -> DataFrame:
    """Running pooled mean and deviation of runs (n, mean, std): sums only, so state is one row for each group."""
    n, m, s = F.col("n").cast("double"), F.col("mean"), F.coalesce("std", F.lit(0.0))
    agg = stream.groupBy(*by).agg(F.sum("n").alias("total"), F.sum(n * m).alias("s1"), F.sum(n * m * m).alias("s2"), F.sum((n - 1) * s * s).alias("within"))
    mean = F.col("s1") / F.col("total")
    var = (F.col("within") + F.greatest(F.col("s2") - F.col("total") * mean * mean, F.lit(0.0))) / (F.col("total") - 1)
    return agg.select(*by, "total", mean.alias("mean"), F.when(F.col("total") > 1, F.sqrt(var)).otherwise(0.0).alias("std"))
