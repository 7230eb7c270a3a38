"""Quality rules whose cutoffs adapt to each language and source.

Five features of a text are whole numbers. For each (lang, source) every feature has a quantile sketch: counts of
log-linear bins (six significant bits, so a bin is at most 1/32 of its value wide). Sketches merge by adding counts,
hence the partial aggregation before the shuffle. A group's quartiles are drawn towards those of its language, and
these towards those of all documents, the more the smaller the group. The quartile on a cutoff's side counts no farther
from the median than twice the other one does, and a bit: up to half of a group may be junk without moving its cutoff
out of reach. A cutoff lies `reach` inter-quartile ranges and a fixed slack outside the middle half.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import bounded, carried, let, once, released, table, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "[#*$%&|<>]"
#: feature -> (slack below, slack above); None: that side has no cutoff.
SLACK: dict[str, tuple[int | None, int | None]] = {
    "word_length": (300, 300),
    "symbol_share": (None, 50),
    "upper_share": (None, 150),
    "dup_line_share": (None, 500),
}
REACH = 6
#: A group's quartiles are averaged with so many rows of its parent.
PRIOR = 20
#: How far a quartile may lie beyond twice the other one's distance from the median: this part of the slack, and two bins.
ALLOWANCE, TWO_BINS = 20, 16
#: Rows of the table of cutoffs that may be broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000


def _covered(starts: Column) -> Column:
    """How many positions the windows at these ascending starts cover."""
    step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"))
    return F.aggregate(starts, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")), step, lambda acc: acc["n"])


def _repeat_words(w: Column) -> Column:
    """Words in windows that occur twice or more. Hashes only clear texts without repeats; the count is on the words."""
    at = lambda: F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))
    hashes = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(at(), lambda i: F.xxhash64(F.slice(h, i, WINDOW))))
    repeats = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    ordered = F.array_sort(F.transform(at(), lambda i: F.struct(F.array_join(F.slice(w, i, WINDOW), " ").alias("w"), i.alias("i"))))
    same = lambda s, j, k: F.coalesce(F.get(s, j + k)["w"] == F.get(s, j)["w"], F.lit(False))
    twice = let(ordered, lambda s: F.transform(F.filter(s, lambda x, j: same(s, j, -1) | same(s, j, 1)), lambda x: x["i"]))
    return F.when(F.size(w) <= WINDOW, 0).when(repeats, _covered(F.array_sort(twice))).otherwise(0)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(part * 1000 / whole)).otherwise(0).cast("long")


def features(rows: DataFrame) -> DataFrame:
    """rows with the text column `t` replaced by a struct column `q`: the base counts and the adaptive features of each text."""
    t = F.coalesce(F.col("t"), F.lit(""))
    w = F.col("w")
    lines = lambda: F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n, chars = F.size(w).cast("long"), F.length(F.array_join(w, "")).cast("long")
    symbols = (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long")
    upper = (F.length(t) - F.length(F.regexp_replace(t, "[A-Z]", ""))).cast("long")
    dup = let(lines(), lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n"), F.size(x).cast("long").alias("of")))
    others = [c for c in rows.columns if c != "t"]
    counts = rows.withColumn("w", once(words(F.col("t")))).select(*others, n.alias("n"), chars.alias("chars"), symbols.alias("sym"), upper.alias("up"), dup.alias("dup"), _repeat_words(w).cast("long").alias("rep"))
    c = F.col
    failed = (c("n") < MIN_WORDS) | (100 * c("rep") > MAX_REPEAT_PERCENT * c("n"))
    fields = {
        "n_words": c("n"), "word_chars": c("chars"), "n_symbols": c("sym"), "n_dup_lines": c("dup.n"), "n_repeat_words": c("rep"), "base_failed": failed,
        "word_length": _share(c("chars"), c("n")), "symbol_share": _share(c("sym"), c("chars")), "upper_share": _share(c("up"), c("chars")), "dup_line_share": _share(c("dup.n"), c("dup.of")),
    }
    return counts.select(*others, once(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("q"))


def _bin(v: Column) -> Column:
    """The lower end of v's log-linear bin."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketches(feats: DataFrame) -> DataFrame:
    """(lang, source, feature, bin, n): the mergeable sketch of each group."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), _bin(F.col(f"q.{k}")).alias("bin")) for k in SLACK]))
    return feats.select("lang", "source", pairs.alias("p")).groupBy("lang", "source", "p.feature", "p.bin").agg(F.count(F.lit(1)).alias("n"))


def cutoffs(sketch: DataFrame, reach: int = REACH, prior: int = PRIOR) -> DataFrame:
    """(lang, source, feature, low, high) for every group of the sketch."""

    def quartiles(level: str, keys: list[str]) -> DataFrame:
        bins = sketch.groupBy(*keys, "feature", "bin").agg(F.sum("n").alias("n"))
        part = W.partitionBy(*keys, "feature")
        run = bins.select("*", F.sum("n").over(part.orderBy("bin")).alias("upto"), F.sum("n").over(part).alias("total"))
        at = lambda q: F.min(F.when(100 * F.col("upto") >= q * F.col("total"), F.col("bin")))
        return run.groupBy(*keys, "feature").agg(F.struct(F.max("total").alias("n"), *[at(q).alias(f"q{q}") for q in (25, 50, 75)]).alias(level))

    own, by_lang, whole = quartiles("own", ["lang", "source"]), quartiles("by_lang", ["lang"]), quartiles("whole", [])
    by_lang, whole = by_lang.withColumnRenamed("lang", "_lang").withColumnRenamed("feature", "_f1"), whole.withColumnRenamed("feature", "_f2")
    j = own.join(by_lang, own["lang"].eqNullSafe(by_lang["_lang"]) & (own["feature"] == by_lang["_f1"])).join(whole, own["feature"] == whole["_f2"])
    drawn = lambda level, up, q: f"({level}.n * {level}.q{q} + {prior} * {up}) div ({level}.n + {prior})"
    j = j.select("lang", "source", "feature", *[F.expr(drawn("own", drawn("by_lang", f"whole.q{q}", q), q)).alias(f"q{q}") for q in (25, 50, 75)])
    pick = lambda side: reduce(lambda acc, kv: acc.when(F.col("feature") == kv[0], F.lit(kv[1][side]).cast("long")), SLACK.items(), F)
    less = lambda side: F.floor(F.coalesce(pick(side), F.lit(0)) / ALLOWANCE)
    q1, q2, q3 = F.col("q25"), F.col("q50"), F.col("q75")
    bins = F.floor(q2 / TWO_BINS)
    j = j.select("lang", "source", "feature", F.greatest(q1, 3 * q2 - 2 * q3 - less(0) - bins).alias("q1"), F.least(q3, 3 * q2 - 2 * q1 + less(1) + bins).alias("q3"), "q25", "q75")
    low, high = F.col("q1") - reach * (F.col("q75") - F.col("q1")) - pick(0), F.col("q3") + reach * (F.col("q3") - F.col("q25")) + pick(1)
    return j.select("lang", "source", "feature", low.alias("low"), high.alias("high"))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", reach: int = REACH, prior: int = PRIOR, keep: list[str] | None = None) -> DataFrame:
    """docs with a struct column `quality`: base counts, features, base_failed, failed_features (beyond a cutoff) and kept.

    Features are computed once and written with the columns to keep: all, or those of `keep`. A null text counts as
    empty (0 words, base_failed); null lang or source form groups of their own; texts of any length are read whole; of
    equal windows, lines or rows each counts as stated, and repeated rows are judged alike; an empty table gives an
    empty result. A column named quality is replaced, any other name passes through.
    """
    feats = table(features(carried(docs, keep, t=F.col(text), lang=F.col(lang), source=F.col(source))))
    cut = cutoffs(sketches(feats), reach, prior).select(F.col("lang").alias("l"), F.col("source").alias("s"), "feature", F.struct("low", "high").alias("c"))
    cut = cut.groupBy("l", "s").agg(F.struct(*[F.max(F.when(F.col("feature") == k, F.col("c"))).alias(k) for k in SLACK]).alias("cut"))
    j = feats.join(bounded(table(cut), BROADCAST_ROWS), F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    out = lambda k: F.coalesce(F.col(f"q.{k}") < F.col(f"cut.{k}.low"), F.lit(False)) | F.coalesce(F.col(f"q.{k}") > F.col(f"cut.{k}.high"), F.lit(False))
    j = j.withColumn("failed", F.array_compact(F.array(*[F.when(out(k), F.lit(k)) for k in SLACK])))
    return released(j, quality=F.col("q").withField("failed_features", F.col("failed")).withField("kept", ~F.col("q.base_failed") & (F.size("failed") == 0)))
