"""Filter interaction audit: what each of five filters removes in each order, from one count of every combination of failures.

Words are exploded and counted by (document, word), then by document; the other flags are joined to that, and one
aggregation per part counts the 32 combinations of failed filters. Every order's steps are sums of those counts.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS

FILTERS = "ABCDE"
#: Combinations of failures: filter k is bit k.
MASKS = 1 << len(FILTERS)
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SYMBOLS = 200, 50, 2, r"[#$%&*|]"
MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def word_totals(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n_words, n_distinct): one row for each distinct pair of id and text, h the text's 64-bit hash.

    Each row brings one null beside its words, which counts how often the pair occurs; rows without words are kept by it.
    Whole texts are dealt out by id and hash first, so that both groupings find their rows in one task and no word is shuffled.
    """
    texts = docs.select("doc_id", _text().alias("t"), F.xxhash64(_text()).alias("h")).repartition("doc_id", "h")
    tokens = texts.select("doc_id", "h", F.explode(F.array_append(F.split("t", WS + "+"), F.lit(None).cast("string"))).alias("w")).where("w IS NULL OR w <> ''")
    by_word = tokens.groupBy("doc_id", "h", "w").agg(F.count(F.lit(1)).alias("n"))
    per = by_word.groupBy("doc_id", "h").agg(F.sum(F.when(F.col("w").isNull(), F.col("n"))).alias("copies"), F.sum(F.when(F.col("w").isNotNull(), F.col("n"))).alias("total"), F.count("w").alias("n_distinct"))
    return per.select("doc_id", "h", F.expr("coalesce(total, 0) div copies").alias("n_words"), "n_distinct")


def flags(docs: DataFrame) -> DataFrame:
    """(doc_id, part, n_words, n_distinct, mask) of each row of docs (doc_id, text, source): bit k of mask is set if it fails filter k.

    A: under 200 words; B: less than half of the words distinct; C: over 2 percent capitals; D: a symbol; E: the text is
    that of a row with a smaller doc_id. A null text counts as empty and fails A, and E where a smaller id has an empty
    text; a null source gives the part ""; a null doc_id is neither smaller nor larger than another one, so fails no E.
    Rows repeated with their id are rows of their own and no copies of each other. Only the named columns are read.
    """
    n, upper = F.length(_text()), F.size(F.split(_text(), "[A-Z]")) - 1
    bit = lambda k, c: F.when(c, F.lit(1 << k)).otherwise(0)
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.xxhash64(_text()).alias("h"), F.sha2(_text().cast("binary"), 256).alias("digest"), (bit(2, 100 * upper > UPPER_PERCENT * n) + bit(3, _text().rlike(SYMBOLS))).alias("own"))
    # The first id of each text; a row finds itself there or is a copy, so no row of a large group meets the others.
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    words = word_totals(docs).withColumnsRenamed({"doc_id": "_id", "h": "_h"})
    joined = rows.join(words, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left").join(first, ["digest", "doc_id"], "left")
    mask = F.col("own") + bit(0, F.col("n_words") < MIN_WORDS) + bit(1, 100 * F.col("n_distinct") < DISTINCT_PERCENT * F.col("n_words")) + bit(4, F.col("doc_id").isNotNull() & F.col("first").isNull())
    return joined.select("doc_id", "part", "n_words", "n_distinct", mask.alias("mask"))


def combinations(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, n, good, toxic): per part three arrays of 32 counts, one for each combination of failures: rows, rows labelled of good quality, rows labelled toxic.

    A doc_id that labels name twice is good or toxic if any of its rows says so.
    """
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(is_one("quality").alias("is_good"), is_one("toxic").alias("is_toxic"))
    rows = flagged.select("doc_id", "part", "mask").join(known, "doc_id", "left")
    counts = {"n": F.lit(True), "good": F.col("is_good"), "toxic": F.col("is_toxic")}
    columns = [F.count(F.when((F.col("mask") == m) & also, 1)).alias(f"{name}{m}") for name, also in counts.items() for m in range(MASKS)]
    return rows.groupBy("part").agg(*columns).select("part", *[F.array(*[f"{name}{m}" for m in range(MASKS)]).alias(name) for name in counts])


def steps(counts: DataFrame) -> DataFrame:
    """(part, filter_order, step, MEASURES...): every order of the filters, step by step, from combinations().

    What a step does depends only on its filter and on which filters came before, in any order: 80 cases. A fixed relation
    says for each combination what becomes of its rows in each case, and the 600 steps look their case up.
    """
    k = len(FILTERS)
    cases = [(f, before) for f in range(k) for before in range(MASKS) if not before >> f & 1]
    # In how many orders filter f removes a row that fails mask: those where none of its other failures stands before f.
    removals = lambda mask, f: sum(factorial(b.bit_count()) * factorial(k - 1 - b.bit_count()) for g, b in cases if g == f and mask >> f & 1 and not mask & b)
    fates = [
        (mask, f, before, not mask & (before | 1 << f), bool(mask >> f & 1 and not mask & before), bool(mask >> f & 1 and mask & before), mask == 1 << f, removals(mask, f))
        for mask in range(MASKS) for f, before in cases
    ]
    spark = counts.sparkSession
    fate = spark.createDataFrame(fates, "mask int, f int, before int, kept boolean, removed boolean, redundant boolean, unique boolean, orders long")
    orders = [("".join(FILTERS[f] for f in order), i + 1, f, sum(1 << e for e in order[:i])) for order in permutations(range(k)) for i, f in enumerate(order)]
    lookup = spark.createDataFrame(orders, "filter_order string, step int, f int, before int")
    rows = counts.select("part", F.posexplode(F.arrays_zip("n", "good", "toxic")).alias("mask", "c")).select("part", "mask", "c.*")
    when = lambda c, n: F.sum(F.when(F.col(c), F.col(n)).otherwise(0))
    values = [when("kept", "n"), when("removed", "n"), when("redundant", "n"), when("unique", "n"), when("removed", "good"), when("removed", "toxic"), F.sum(F.col("n") * F.col("orders"))]
    by_case = rows.join(F.broadcast(fate), "mask").groupBy("part", "f", "before").agg(*[v.alias(m) for v, m in zip(values, MEASURES, strict=True)])
    return by_case.join(F.broadcast(lookup), ["f", "before"]).select("part", "filter_order", "step", *MEASURES)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """steps() of the flags of docs; no rows for an empty table."""
    return steps(combinations(flags(docs), labels))
