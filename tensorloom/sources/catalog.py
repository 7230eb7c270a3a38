"""Saved runs: tables partitioned by lattice, weight and boundary, and the latest of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import manifest

KEYS = ["L", "max_weight", "bc"]
META = "L int, max_weight int, bc string, run string, total_sites int, seconds double, ts timestamp, saved map<string, struct<files bigint, length bigint, digest string>>"


def save(df: DataFrame, root: str, table: str, *, L: int, max_weight: int, bc: str, run: str) -> None:
    """Append a table of a run, partitioned by its parameters."""
    df.withColumns({"L": F.lit(L), "max_weight": F.lit(max_weight), "bc": F.lit(bc), "run": F.lit(run)}).write.mode("append").partitionBy(*KEYS, "run").parquet(f"{root}/{table}")


def _place(root: str, table: str, L: int, max_weight: int, bc: str, run: str) -> str:
    return f"{root}/{table}/L={L}/max_weight={max_weight}/bc={bc}/run={run}"


def save_run(spark: SparkSession, root: str, tables: dict[str, DataFrame], *, L: int, max_weight: int, bc: str, run: str, seconds: float = 0.0) -> None:
    """Save the tables of a run, then its row in run_meta, which makes it visible and says what files the tables have."""
    for name, df in tables.items():
        save(df, root, name, L=L, max_weight=max_weight, bc=bc, run=run)
    meta = spark.range(1).select(F.lit(L).alias("L"), F.lit(max_weight).alias("max_weight"), F.lit(bc).alias("bc"), F.lit(run).alias("run"), F.lit(L * L).alias("total_sites"), F.lit(float(seconds)).alias("seconds"), F.current_timestamp().alias("ts"))
    row = [(name, *manifest.summary(spark, _place(root, name, L, max_weight, bc, run))) for name in tables]
    saved = spark.createDataFrame(row, "name string, files bigint, length bigint, digest string").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("files", "length", "digest")))).alias("saved"))
    meta = meta.join(F.broadcast(saved))
    meta.write.mode("append").parquet(f"{root}/run_meta")


def runs(spark: SparkSession, root: str, **where) -> DataFrame:
    """The saved runs that match, latest first."""
    out = spark.read.schema(META).parquet(f"{root}/run_meta")
    for k, v in where.items():
        out = out.where(F.col(k) == v)
    return out.orderBy(F.desc("ts"), F.desc("run"))


def load(spark: SparkSession, root: str, table: str, **where) -> DataFrame:
    """A saved table of the runs that match; parameters prune partitions."""
    out = spark.read.parquet(f"{root}/{table}")
    for k, v in where.items():
        out = out.where(F.col(k) == v)
    return out


def load_latest(spark: SparkSession, root: str, table: str, **where) -> DataFrame:
    """A table of the latest run that matches and is whole: a run that lacks a file or has a broken one is passed over for the one before.

    FileNotFoundError if there is none. Runs saved before files were noted count as whole.
    """
    for r in runs(spark, root, **where).toLocalIterator():  # newest first, a row a run
        noted = (r["saved"] or {}).get(table)
        if noted is None and r["saved"] is not None:
            continue
        if noted is None or manifest.unchanged(spark, _place(root, table, r["L"], r["max_weight"], r["bc"], r["run"]), tuple(noted)):
            return spark.read.parquet(f"{root}/{table}").where((F.col("L") == r["L"]) & (F.col("max_weight") == r["max_weight"]) & (F.col("bc") == r["bc"]) & (F.col("run") == r["run"])).drop(*KEYS, "run")
    raise FileNotFoundError(f"no whole run with {where} in {root}")


def summary(clusters: DataFrame, cluster_sites: DataFrame) -> DataFrame:
    """(weight, clusters, least, most, mean): counts by weight, and over sites."""
    per = cluster_sites.join(clusters.select("cluster_id", "weight"), "cluster_id").groupBy("weight", "site").agg(F.count(F.lit(1)).alias("n"))
    sites = per.groupBy("weight").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"))
    return clusters.groupBy("weight").agg(F.count(F.lit(1)).alias("clusters")).join(sites, "weight")


def write_results(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Append result rows; CSV with a header."""
    w = df.write.mode("append")
    w.option("header", True).csv(path) if format == "csv" else w.format(format).save(path)


def read_results(spark: SparkSession, paths: list[str], schema: str, format: str = "parquet") -> DataFrame:
    """Union of result files, by column name, with the file of each row; missing columns are null."""
    out = None
    for p in paths:
        r = spark.read.schema(schema)
        part = (r.option("header", True).csv(p) if format == "csv" else r.format(format).load(p)).withColumn("file", F.input_file_name())
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def missing_tasks(results: DataFrame, first: int, last: int, task: str = "task") -> DataFrame:
    """(task) of first..last without a row."""
    spark = results.sparkSession
    return spark.range(first, last + 1).withColumnRenamed("id", task).join(results.select(F.col(task).cast("long").alias(task)).distinct(), task, "left_anti")
