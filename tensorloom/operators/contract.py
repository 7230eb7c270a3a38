"""Sum-product: links of a network, and contraction as join, product, grouped sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import table
from .overlap import overlaps


def edges_of(slots: DataFrame, key: str = "link") -> DataFrame:
    """(u, w, n): pairs of vertices that share a link, and how many different ones they share; slots are (v, link)."""
    shared = overlaps(slots.select(F.col("v").alias("set_id"), F.col(key).alias("e")), 1)
    return shared.select(F.col("a").alias("u"), F.col("b").alias("w"), F.col("shared").alias("n"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(v, nbrs): ascending neighbours of each vertex."""
    both = edges.select(F.col("u").alias("v"), F.col("w").alias("x")).union(edges.select(F.col("w").alias("v"), F.col("u").alias("x")))
    return both.groupBy("v").agg(F.array_sort(F.collect_set("x")).alias("nbrs"))


def contract(a: DataFrame, b: DataFrame, on: list[str], value: str = "re") -> DataFrame:
    """Sum over the shared index columns of the product of two relations; the other columns stay free."""
    free = [c for c in a.columns if c not in (*on, value)] + [c for c in b.columns if c not in (*on, value)]
    j = a.withColumnRenamed(value, "_a").join(b.withColumnRenamed(value, "_b"), on)
    return j.groupBy(*free).agg(F.sum(F.col("_a") * F.col("_b")).alias(value))


def contract_complex(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """contract() with values in the columns re and im."""
    free = [c for c in a.columns + b.columns if c not in (*on, "re", "im")]
    j = a.withColumnsRenamed({"re": "ar", "im": "ai"}).join(b.withColumnsRenamed({"re": "br", "im": "bi"}), on)
    return j.groupBy(*free).agg(F.sum(F.col("ar") * F.col("br") - F.col("ai") * F.col("bi")).alias("re"), F.sum(F.col("ar") * F.col("bi") + F.col("ai") * F.col("br")).alias("im"))


def complex_log(re: Column, im: Column) -> Column:
    """Principal logarithm as struct (re, im)."""
    return F.struct((0.5 * F.log(re * re + im * im)).alias("re"), F.atan2(im, re).alias("im"))


def contract_network(tensors: DataFrame, slots: DataFrame, every: int = 4) -> DataFrame:
    """(g, re): the full contraction of a network of a few dozen tensors, vertex by vertex in their order.

    Two vertices may share several links; the n-th slot of one towards the other meets the n-th of the other. The state keeps one row for each index of the links still open, so the cost is exponential in the width of the
    cut: the network's shape, read from slots, is small by nature. Each absorbed vertex sums out what it closes.
    """
    shape: dict[int, list[int]] = {}
    for r in slots.orderBy("v", "slot").collect():
        shape.setdefault(r["v"], []).append(r["nbr"])
    open_: list[tuple[int, int, int]] = []
    state = tensors.select("g").distinct().withColumn("re", F.lit(1.0)).withColumn("key", F.array().cast("array<int>"))
    for n, (v, nbrs) in enumerate(sorted(shape.items())):
        links = [(min(v, x), max(v, x), nbrs[:k].count(x)) for k, x in enumerate(nbrs)]
        closing = [k for k, link in enumerate(links) if link in open_]
        rest = [k for k in range(len(links)) if k not in closing]
        kept = [k for k, link in enumerate(open_) if link not in links]
        at = F.array(*[F.col("key")[open_.index(links[k])] for k in closing]) if closing else F.array().cast("array<int>")
        left = state.select("g", F.col("re").alias("_a"), at.alias("_on"), (F.array(*[F.col("key")[k] for k in kept]) if kept else F.array().cast("array<int>")).alias("_kept"))
        on = F.array(*[F.col("idx")[k] for k in closing]) if closing else F.array().cast("array<int>")
        right = tensors.where(F.col("v") == v).select("g", F.col("re").alias("_b"), on.alias("_on"), (F.array(*[F.col("idx")[k] for k in rest]) if rest else F.array().cast("array<int>")).alias("_new"))
        state = left.join(F.broadcast(right), ["g", "_on"]).groupBy("g", F.concat("_kept", "_new").alias("key")).agg(F.sum(F.col("_a") * F.col("_b")).alias("re"))
        open_ = [open_[k] for k in kept] + [links[k] for k in rest]
        if n % every == every - 1:
            state = table(state)
    return state.select("g", "re")
