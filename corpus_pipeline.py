"""From documents to tokens: quality rules, toxicity, near-duplicates, benchmark leaks, SentencePiece ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm import decontaminate, near_dedup, quality_rules, queries, sentencepiece_codec, toxicity
from tensorloom.llm.common import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the adaptive cutoffs of their language and source."""
    return quality_rules.judge(docs).where("quality.kept").select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose worst sentence scores below the threshold; trained on labels of what came in."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score(docs, toxicity.fit(docs, labels)).where(F.col("toxicity.score") < toxicity.THRESHOLD).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates (five words, 80 percent)."""
    return near_dedup.deduplicate(docs)


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that is 80 percent similar to a benchmark item of its size."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.mark(docs, benchmark).where(~F.col("leak.contaminated")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids, and digests of ids and of decoded text, of what is left."""
    return queries.codec_digest(sentencepiece_codec.encode_decode(docs.select("doc_id", "text"), queries.piece_model(), keep=["doc_id"]))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("toxicity", clean),
    ("minhash near-dedup", distinct),
    ("benchmark decontamination", unleaked),
    ("sentencepiece", tokens),
]

#: SQL cannot express the toxicity stage; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else table(docs), sf_dir)
    return docs
