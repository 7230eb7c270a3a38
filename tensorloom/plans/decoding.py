"""Decoding sweeps over code sizes and error rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import codes
from ..session import table
from ..sources import codes as sources


def toric(spark: SparkSession, L: int, p: float, samples: int, order: int = 0, rounds: int = 20, keep: float = 0.3) -> DataFrame:
    """(L, p, samples, logical, failure): rates of wrong homology and of a syndrome left over; order > 0 corrects by loops."""
    pcm = sources.toric(spark, L)
    truth = table(sources.errors(spark, samples, 2 * L * L, p))
    s = table(codes.syndrome(pcm, truth))
    out = codes.decode_loops(pcm, s, p, order, rounds) if order else codes.decode_bp(pcm, s, p, rounds, keep)
    both = out.where("x = 1").select("sample_id", "bit").union(truth.where("x = 1").select("sample_id", "bit"))
    ids = truth.select(F.col("sample_id").alias("set_id")).distinct()
    checked = codes.check_decoding(both.select(F.col("sample_id").alias("set_id"), F.col("bit").alias("e")), ids, L)
    rate = lambda ok: F.avg(1 - ok.cast("int"))
    return checked.agg(F.count(F.lit(1)).alias("samples"), rate(F.col("syndrome_zero") & F.col("homology_trivial")).alias("logical"), rate(F.col("syndrome_zero")).alias("failure")).select(F.lit(L).alias("L"), F.lit(p).alias("p"), "samples", "logical", "failure")


def regular(spark: SparkSession, n: int, d_v: int, d_c: int, p: float, batches: int, per_batch: int, rounds: int = 20) -> DataFrame:
    """(batch, bit_error, word_error) of a Gallager code decoded by belief propagation."""
    pcm = table(sources.gallager(spark, n, d_v, d_c))
    truth = table(sources.errors(spark, batches * per_batch, n, p))
    out = codes.decode_bp(pcm, codes.syndrome(pcm, truth), p, rounds)
    wrong = truth.join(out.select("sample_id", "bit", F.col("x").alias("y")), ["sample_id", "bit"]).withColumn("w", (F.col("x") != F.col("y")).cast("int"))
    words = wrong.groupBy("sample_id").agg(F.avg("w").alias("b"), F.max("w").alias("any"))
    return words.groupBy(F.floor((F.col("sample_id") - 1) / per_batch).alias("batch")).agg(F.avg("b").alias("bit_error"), F.avg("any").alias("word_error"))


def maximum_likelihood(spark: SparkSession, L: int, p: float, samples: int, exact: bool | None = None, rounds: int = 500) -> DataFrame:
    """(sample_id, class, best, true, wrong): the likeliest class of each sample, its logarithm, that of the class of the
    true error, and whether they differ. Exact for L <= 4 unless `exact` says otherwise, else by belief propagation."""
    truth = table(sources.errors(spark, samples, 2 * L * L, p))
    s = codes.syndrome(sources.toric(spark, L), truth)
    matched = table(codes.match_syndrome(s, L))
    chains = table(codes.logical_classes(matched, truth, L))
    exact = L <= 4 if exact is None else exact
    w = table(codes.class_weights(spark, chains, truth, L, p) if exact else codes.class_energies(spark, chains, truth, L, p, rounds=rounds))
    best = codes.argmax_decide(w, ["sample_id"], "logw", "class").join(w, ["sample_id", "class"]).withColumnRenamed("logw", "best")
    each = truth.select("sample_id").distinct().join(spark.range(4).select(F.col("id").cast("int").alias("class")))
    name = lambda c: (4 * F.col("sample_id") + c).alias("set_id")
    sets = chains.select(name(F.col("class")), "e").union(truth.where("x = 1").join(spark.range(4)).select(name(F.col("id")), "bit"))
    same = codes.check_decoding(sets, each.select(name(F.col("class"))), L).where("homology_trivial")
    true = same.select(F.floor(F.col("set_id") / 4).alias("sample_id"), (F.col("set_id") % 4).cast("int").alias("class")).join(w, ["sample_id", "class"]).select("sample_id", F.col("logw").alias("true"))
    return best.join(true, "sample_id").select("sample_id", "class", "best", "true", (F.col("best") - F.col("true") > 1e-9).cast("int").alias("wrong"))
