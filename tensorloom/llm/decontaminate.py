"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact weighted-shingle similarity.

A window of as many words as an item is similar to it if its WIDTH-word shingles, weighted by how often they occur,
share enough: 100 * sum of minima >= percent * sum of maxima. Only windows that begin at a shingle of the item, or end
the text, are fingerprinted, and of these only those that hold enough shingles of the item: sliding a window up to the
next such shingle loses none, so the best window is among them. A 64-bit SimHash of each goes through a multi-index of
the item: of BLOCKS blocks, one differs in at most RADIUS // BLOCKS bits where all differ in at most RADIUS, so an item
is entered under all values that near to its own. The candidates are verified on the full bags. The SimHash is over
(shingle, which occurrence of it): such elements are distinct and two bags share as many as the sum of minima, so the
angle follows from the similarity however often a shingle repeats. Everything is DataFrame expressions.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bounded, carried, let, released, table, words

WIDTH = 5
PERCENT = 80
#: At the threshold a bit differs with probability arccos(8/9)/pi = 0.15: 24 or more of 64 in about 3 of a million windows.
RADIUS, BLOCKS = 23, 8
#: Shingles and index entries of the benchmark, and documents with hits, that may be broadcast; more are joined by a shuffle.
BROADCAST_SHINGLES, BROADCAST_KEYS = 2_000_000, 200_000


def _shingles(w: Column, width: Column) -> Column:
    """Hashes of all runs of width words, in order; none if there are fewer words."""
    grams = lambda h: F.when(F.size(h) >= width, F.transform(F.sequence(F.lit(1), F.size(h) - width + 1), lambda i: F.xxhash64(F.slice(h, i, width)))).otherwise(F.array().cast("array<bigint>"))
    return let(F.transform(w, lambda x: F.xxhash64(x)), grams)


def _simhash(h: Column) -> Column:
    """One bit for each of 64 positions: whether more than half of the hashes have it."""
    bit = lambda k: (2 * F.aggregate(h, F.lit(0), lambda a, x: a + F.call_function("shiftright", x, k).bitwiseAND(F.lit(1)).cast("int")) > F.size(h)).cast("bigint")
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("shiftleft", bit(k), k)), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))


def _block(fp: Column, k: int) -> Column:
    width = 64 // BLOCKS
    return F.shiftrightunsigned(fp, k * width).bitwiseAND(F.lit((1 << width) - 1).cast("bigint")).cast("int")


def _blocks(fp: Column) -> Column:
    """(block, value) of each block."""
    return F.array(*[F.struct(F.lit(k).alias("block"), _block(fp, k).alias("value")) for k in range(BLOCKS)])


def _entries(fp: Column) -> Column:
    """(block, value) of each block and each value within RADIUS // BLOCKS bits of it."""
    flips = [sum(1 << i for i in bits) for n in range(RADIUS // BLOCKS + 1) for bits in combinations(range(64 // BLOCKS), n)]
    one = lambda k: F.transform(F.array(*map(F.lit, flips)), lambda x: F.struct(F.lit(k).alias("block"), x.bitwiseXOR(_block(fp, k)).alias("value")))
    return F.concat(*[one(k) for k in range(BLOCKS)])


def _numbered(h: Column) -> Column:
    """For each element of the array a hash of it and of how many equal ones stand before it, in no particular order."""
    one = lambda x, k: F.xxhash64(x, k)
    # Among sorted ones an equal element d places before means d or more before it: found by halving steps.
    steps = F.array(*[F.lit(1 << k) for k in range(24, -1, -1)])
    before = lambda s, x, i: F.aggregate(steps, F.lit(0), lambda d, b: F.when(F.get(s, i - d - b) == x, d + b).otherwise(d))
    repeats = let(F.array_sort(h), lambda s: F.transform(s, lambda x, i: one(x, before(s, x, i))))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.transform(h, lambda x: one(x, F.lit(0)))).otherwise(repeats)


def _items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(item, words, width, h): the items with a word, of as many words and their shingles' hashes."""
    w = benchmark.select(F.col(item).alias("item"), words(ascii_lower(F.col(text))).alias("w")).where("size(w) > 0")
    width = F.least(F.size("w"), F.lit(WIDTH))
    return w.select("item", F.size("w").alias("words"), width.alias("width"), _shingles(F.col("w"), width).alias("h"))


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", ident: str = "doc_id", item: str = "item_id", item_text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(_id, _hash, item, start, words, similarity): the best window of each text and item that are similar.

    _id and _hash (xxhash64 of the text) name a row of docs; start counts words from 0. A text shorter than an item is
    one window. Null and empty texts and items match nothing; an item of fewer than WIDTH words is one shingle; texts
    and items of any length are compared whole; of windows that are equally similar the first is returned; equal rows
    give one result, a null id or item is one like any other.
    """
    items = table(_items(benchmark, item, item_text))
    widths = [r["width"] for r in items.select("width").distinct().orderBy("width").collect()] or [WIDTH]
    known = items.select("item", "words", "width", F.explode("h").alias("x")).distinct()
    base = docs.select(F.col(ident).alias("_id"), F.xxhash64(text).alias("_hash"), words(ascii_lower(F.col(text))).alias("w"))

    def hits(width: int) -> DataFrame:
        at = base.select("_id", "_hash", F.size("w").alias("n"), F.posexplode(_shingles(F.col("w"), F.lit(width))).alias("p", "x"))
        return at.join(bounded(known.where(F.col("width") == width), BROADCAST_SHINGLES), "x").select("_id", "_hash", "n", "p", "item", "words", "width")

    found = hits(widths[0])
    for width in widths[1:]:
        found = found.union(hits(width))
    runs = found.groupBy("_id", "_hash", "n", "item", "words", "width").agg(F.array_sort(F.collect_set("p")).alias("at"))
    # Window and item have k and own shingles: so many must be shared, and so many places lie close enough together.
    own = F.col("words") - F.col("width") + 1
    k = F.least(own, F.col("n") - F.col("width") + 1)
    need = F.ceil(percent * (k + own) / F.lit(100 + percent)).cast("int")
    end = F.greatest(F.col("n") - F.col("words"), F.lit(0))
    starts = F.filter("at", lambda p, j: (p <= end) & F.coalesce(F.get("at", j + need - 1) < p + k, F.lit(False)))
    last = F.when(F.size(F.filter("at", lambda p: p >= end)) >= need, F.array(end)).otherwise(F.array().cast("array<int>"))
    windows = table(runs.select("_id", "_hash", "item", "words", "width", k.alias("k"), F.explode(F.array_union(starts, last)).alias("start")))

    keys = windows.select("_id", "_hash").distinct()
    texts = base.join(bounded(keys, BROADCAST_KEYS), base["_id"].eqNullSafe(keys["_id"]) & (base["_hash"] == keys["_hash"]), "left_semi").dropDuplicates(["_id", "_hash"])
    w2 = windows.select("words", "width", "k", "start", F.col("_id").alias("_i"), F.col("_hash").alias("_h")).distinct()
    near = texts.join(w2, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h"))).select("_id", "_hash", "words", "start", "width", F.slice("w", F.col("start") + 1, F.col("k") + F.col("width") - 1).alias("w"))
    near = near.select("_id", "_hash", "words", "start", _numbered(_shingles(F.col("w"), F.col("width"))).alias("bag"))
    printed = table(near.select("*", _simhash(F.col("bag")).alias("fp")))
    target = items.select(F.col("item").alias("_item"), _numbered(F.col("h")).alias("own")).select("*", _simhash(F.col("own")).alias("own_fp"))
    entries = table(target.select("_item", "own_fp", F.explode(_entries(F.col("own_fp"))).alias("b")).select("_item", "own_fp", "b.block", "b.value"))
    of_item = windows.select("item", F.col("_id").alias("_i"), F.col("_hash").alias("_h"), F.col("words").alias("_w"), F.col("start").alias("_s"))
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h")) & (F.col("words") == F.col("_w")) & (F.col("start") == F.col("_s"))
    asked = printed.select("_id", "_hash", "words", "start", "fp").join(of_item, same).select("_id", "_hash", "words", "start", "item", "fp", F.explode(_blocks(F.col("fp"))).alias("b")).select("*", F.col("b.block").alias("_block"), F.col("b.value").alias("_value"))
    close = asked.join(bounded(entries, BROADCAST_SHINGLES), F.col("item").eqNullSafe(F.col("_item")) & (F.col("_block") == F.col("block")) & (F.col("_value") == F.col("value")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("own_fp"))) <= RADIUS))
    pairs = close.select("item", F.col("_id").alias("_i"), F.col("_hash").alias("_h"), F.col("words").alias("_w"), F.col("start").alias("_s")).distinct()
    full = printed.join(pairs, same).join(bounded(table(target.select("_item", "own")), BROADCAST_KEYS), F.col("item").eqNullSafe(F.col("_item")))
    scored = full.select("_id", "_hash", "item", "start", "words", F.size(F.array_intersect("bag", "own")).alias("m"), (F.size("bag") + F.size("own")).alias("total"))
    scored = scored.where(100 * F.col("m") >= percent * (F.col("total") - F.col("m"))).withColumn("similarity", F.col("m") / (F.col("total") - F.col("m")))
    best = scored.groupBy("_id", "_hash", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("first"), "words")).alias("b"))
    return best.select("_id", "_hash", "item", (-F.col("b.first")).alias("start"), "b.words", "b.similarity")


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", ident: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """docs with `leak`: struct of contaminated, item_ids (ascending) and similarity (of the most similar; null without any).

    Null and empty texts are clean; repeated rows are marked alike, rows of one id and other texts apart; nulls, long
    texts and ties are as in find. A column named leak is replaced, any other name passes through; empty tables are fine.
    """
    hit = find(docs, benchmark, text, ident, percent=percent).groupBy("_id", "_hash").agg(F.array_sort(F.collect_set("item")).alias("items"), F.max("similarity").alias("similarity"))
    hit = table(hit)
    j = carried(docs, id=F.col(ident), key=F.xxhash64(text)).join(bounded(hit, BROADCAST_KEYS), F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_hash")), "left")
    none = F.array().cast(hit.schema["items"].dataType)
    return released(j, leak=F.struct(F.col("_hash").isNotNull().alias("contaminated"), F.coalesce("items", none).alias("item_ids"), "similarity"))
