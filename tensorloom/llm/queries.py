"""The thin queries opN_<name>: whole tables in, contract columns out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, filter_audit, html_extract, importance, license_scan, lm_score, near_dedup, pack, preference, quality_rules, sentencepiece_codec, toxicity, url_filter
from .common import bucket, table


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    """Where the public 32k piece model lies on each machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return found.select("doc_id", F.size("licence.identifiers").cast("long").alias("n_known"), join("licence.identifiers").alias("identifiers"), join("licence.rules").alias("rules"), join("licence.licences").alias("licences"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_codec.encode_decode(_read(spark, sf_dir, "documents").select("doc_id", "text"), piece_model(), keep=["doc_id"])
    return codec_digest(coded)


def codec_digest(coded: DataFrame) -> DataFrame:
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"))


#: The rules that decide a URL before the trees do.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: Terms in a host that label a URL as to be blocked when the trees are trained; hosts without one are labelled allowed.
BLOCK_TERMS = "casino bets betting poker pills pharma viagra loans spam scam porn xxx warez crack torrent ads adserver track tracker click malware phish".split()


def labelled_urls(pages: DataFrame) -> DataFrame:
    """(url, block): each URL labelled by whether its host holds one of BLOCK_TERMS as a whole part."""
    host = url_filter.host(F.col("url"))
    return pages.where(host != "").select("url", host.rlike(rf"(^|[.-])({'|'.join(BLOCK_TERMS)})([.-]|$)").cast("int").alias("block"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge(pages, URL_RULES, url_filter.fit(labelled_urls(pages)))
    return judged.select("page_id", "link.host", "link.path", "link.rule", "link.verdict", "link.probability")


def op4_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = preference.format_turns(preference.swapped_answers(_read(spark, sf_dir, "conversations")))
    mask = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"], F.lit("-"), s["end"])), ",").alias(c)
    return found.select("pair", "chosen_id", "rejected_id", F.col("shared").cast("long").alias("shared"), "prompt", "chosen", "rejected", mask("chosen_mask"), mask("rejected_mask"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)
    return found.withColumnRenamed("id", "doc_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    value = F.col("toxicity.score")
    return scored.select("doc_id", (bucket(F.col("doc_id"), 3) == 1).alias("held_out"), value.alias("score"), (value >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_read(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "leak.contaminated", F.size("leak.item_ids").cast("long").alias("n_items"), F.array_join(F.col("leak.item_ids").cast("array<string>"), ",").alias("item_ids"), "leak.similarity")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), keep=["doc_id"])
    return judged.select("doc_id", *[f"quality.{k}" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    cut = pack.pieces(docs, public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    # The digest of a piece stands for its ids from here on.
    digests = table(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return pack.place(digests, ties=["doc_id", "piece"])


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark")
    return importance.resample(docs, target)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_url_filters": op3_url_filters,
    "op4_preference_formatting": op4_preference_formatting,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_html_extraction": op9_html_extraction,
    "op10_quality_rules": op10_quality_rules,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_filter_audit": op13_filter_audit,
}
