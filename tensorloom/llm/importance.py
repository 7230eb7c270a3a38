"""Target-distribution importance resampling over hashed runs of words, with identical texts handled once.

Texts are grouped by their full text; features and weight are computed once for each distinct text, counts are
multiplied by how often it occurs, and the weight is joined back to each document before its own noise is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, carried, numbered, released, table

#: What stands between words: every ASCII character but digits and letters.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A text that more than one document in so many has is looked up by broadcast: there are fewer such texts than this.
HOT = 1000


def features(text: Column, longest: int = 1) -> Column:
    """All runs of 1 to longest consecutive words, joined by one space; null has none."""
    words = F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")
    if longest == 1:
        return words
    runs = lambda w, k: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(F.array(words), lambda w: F.flatten(F.array(w, *[runs(w, k) for k in range(2, longest + 1)]))))


def hashed(text: Column, buckets: int, longest: int = 1) -> Column:
    """The features' buckets, repeats kept."""
    return F.transform(features(text, longest), lambda f: F.pmod(F.crc32(f.cast("binary")), F.lit(buckets)).cast("int"))


def collapse(docs: DataFrame, buckets: int = 10_000, longest: int = 1) -> DataFrame:
    """(digest, copies, buckets) of each distinct text, grouped by the text itself; written, as all later steps read it."""
    texts = docs.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.count(F.lit(1)).alias("copies"))
    return table(texts.select(F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "copies", hashed(F.col("text"), buckets, longest).alias("buckets")))


def gains(texts: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 1) -> DataFrame:
    """(bucket, gain): one row a bucket, 1000 times the log ratio of its smoothed shares in target (text) and in all documents, rounded down."""
    count = lambda df, n, name: df.groupBy("bucket").agg(F.sum(n).alias(name))
    own = count(texts.select(F.explode("buckets").alias("bucket"), "copies"), "copies", "s")
    wanted = count(target.select(F.explode(hashed(F.col("text"), buckets, longest)).alias("bucket")), F.lit(1), "t")
    every = texts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = table(every.join(own, "bucket", "left").join(wanted, "bucket", "left").na.fill(0, ["s", "t"]))
    S, T = both.agg(F.sum("s"), F.sum("t")).first()
    ratio = (F.col("t") + 1).cast("double") * F.lit(float(S + buckets)) / ((F.col("s") + 1).cast("double") * F.lit(float(T + buckets)))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weights(texts: DataFrame, gain: DataFrame) -> DataFrame:
    """(digest, copies, n_features, weight) of each distinct text; gain has one row a bucket, a number that doesn't grow with the texts."""
    each = texts.select("digest", "copies", F.explode_outer("buckets").alias("bucket")).join(F.broadcast(gain), "bucket", "left")
    return each.groupBy("digest").agg(F.first("copies").alias("copies"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))


def noise(doc_id: Column, seed: int) -> Column:
    """1000 times a Gumbel variate, rounded down, from the digest of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least: int = 20, buckets: int = 10_000, longest: int = 1, seed: int = 2024, keep: list[str] | None = None) -> DataFrame:
    """docs (doc_id, text; the columns to keep, all but text by default) with n_features, weight, score and rank.

    rank counts from 1 in the order of falling score, ties to the smaller doc_id, over the percent of the documents of at
    least so many words that are drawn; null for the others. A null text counts as empty: no features, weight 0, never
    drawn; a null doc_id has the noise of an empty one and is the smallest. Repeated rows are documents of their own, with
    equal noise. An empty table gives no rows, an empty target gains from the documents alone. Columns of the result's
    names are replaced, others pass through.
    """
    texts = collapse(docs, buckets, longest)
    weighed = table(weights(texts, gains(texts, target, buckets, longest)))
    kept = [c for c in docs.columns if c != "text"] if keep is None else keep
    rows = carried(docs, kept, doc_id=F.col("doc_id"), digest=F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    n = weighed.agg(F.sum("copies")).first()[0] or 0
    # Fewer than HOT texts can each have more than a HOT-th of the rows; no text of the others can fill a task.
    known = F.struct("n_features", "weight")
    hot = weighed.where(F.col("copies") * HOT > n).select("digest", known.alias("hot"))
    cold = weighed.where(F.col("copies") * HOT <= n).select(F.col("digest").alias("key"), known.alias("cold"))
    found = rows.join(F.broadcast(hot), "digest", "left").withColumn("key", F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))).join(cold, "key", "left")
    scored = table(found.withColumn("known", F.coalesce("hot", "cold")).select("row", "doc_id", "known.*", (F.col("known.weight") + noise(F.col("doc_id"), seed)).alias("score")))
    # A run of n words has n features of one word, n - 1 of two and so on.
    words = least * longest - longest * (longest - 1) // 2 if least >= longest else least * (least + 1) // 2
    enough = F.col("n_features") >= words
    ranked, total = numbered(scored.where(enough), F.desc("score"), F.asc("doc_id"))
    drawn = ranked.withColumn("rank", F.when(F.col("number") < percent * total // 100, F.col("number") + 1)).drop("number")
    out = drawn.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))
    return released(out, n_features=F.col("n_features"), weight=F.col("weight"), score=F.col("score"), rank=F.col("rank"))
