"""Connected sets of vertices, each made once, from its parent alone; and their signed sums over connected subgraphs.

A connected set has one order: its smallest vertex first, then always the smallest vertex that touches those before. Its
parent is the set without the last one. A vertex that touches a set is its next one exactly if it is larger than the
first vertex and than all that came after the first one it touches; a row holds what that takes, so no set is made twice
and none has to be compared with others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import let, table

#: Vertices that connected_sum takes at most: its arrays have an entry for each of their subsets.
MOST = 10


def _neighbourhoods(vertices: DataFrame, edges: DataFrame, weight: int) -> DataFrame:
    """(v, weight, nbrs): vertices of at most that weight with their neighbours (v, w) of that kind."""
    own = vertices.where("v IS NOT NULL AND weight IS NOT NULL").groupBy("v").agg(F.min("weight").cast("long").alias("weight")).where(F.col("weight") <= weight)
    both = edges.where("u <> w").select(F.col("u").alias("v"), F.col("w").alias("nbr")).union(edges.where("u <> w").select("w", "u")).distinct()
    near = both.join(own.select(F.col("v").alias("nbr"), F.col("weight").alias("w")), "nbr").groupBy("v").agg(F.array_sort(F.collect_list(F.struct(F.col("nbr").alias("v"), "w"))).alias("nbrs"))
    return own.join(near, "v", "left").select("v", "weight", F.coalesce("nbrs", F.array().cast(near.schema["nbrs"].dataType)).alias("nbrs"))


def _seen(nbrs: Column, first: Column, at: Column) -> Column:
    """Neighbours after the first vertex, with the place of the member that they touch."""
    return F.transform(F.filter(nbrs, lambda x: x["v"] > first), lambda x: F.struct(x["v"].alias("v"), x["w"].alias("w"), at.cast("int").alias("at")))


def grown(sets: DataFrame, near: DataFrame, weight: int) -> DataFrame:
    """The children of sets (members, weight, seen): one join with the new member's neighbours, nothing to compare afterwards."""
    ends = lambda x: F.forall(F.slice("members", x["at"] + 1, F.size("members")), lambda m: m < x["v"])
    fits = lambda x: F.col("weight") + x["w"] <= weight
    to = sets.select("members", "weight", "seen", F.explode(F.filter("seen", lambda x: fits(x) & ends(x))).alias("next"))
    to = to.withColumns({"first": F.col("members")[0], "at": F.size("members") + 1})
    on = to.join(near.select(F.col("v").alias("_v"), "nbrs"), F.col("next.v") == F.col("_v"))
    # Vertices once seen stay, even those that can no longer follow, so that they don't come back at a later place.
    fresh = F.filter("nbrs", lambda x: ~F.exists("seen", lambda s: s["v"] == x["v"]) & ~F.array_contains("members", x["v"]))
    rest = F.filter("seen", lambda s: s["v"] != F.col("next.v"))
    more = on.withColumn("more", F.concat(rest, _seen(fresh, F.col("first"), F.col("at"))))
    return more.select(F.array_append("members", F.col("next.v")).alias("members"), (F.col("weight") + F.col("next.w")).alias("weight"), F.col("more").alias("seen"))


def connected_sets(vertices: DataFrame, edges: DataFrame, weight: int) -> DataFrame:
    """(members, weight): every set of vertices (v, weight) of at most that weight that the edges (u, w) connect, once, in its order.

    Weights are whole numbers of one or more; a vertex named twice has its smaller weight; edges to absent or heavier
    vertices are left out. A row holds the neighbours of its set, and the result has a row for each set: both grow with
    the degrees. Each size is written.
    """
    near = table(_neighbourhoods(vertices, edges, weight))
    now = table(near.select(F.array("v").alias("members"), "weight", _seen(F.col("nbrs"), F.col("v"), F.lit(1)).alias("seen")))
    found = now.select("members", "weight")
    while not now.isEmpty():
        now = table(grown(now, near, weight))
        found = found.union(now.select("members", "weight"))
    return found


def with_links(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """sets with `links`, for each member in order a bit mask of the places of the members it touches."""
    both = edges.where("u <> w").select("u", "w").union(edges.where("u <> w").select("w", "u")).distinct()
    named = sets.withColumn("_id", F.array_join(F.col("members").cast("array<string>"), ","))
    at = named.select("_id", "members", F.posexplode("members").alias("place", "u"))
    inside = at.join(both, "u").where(F.array_contains("members", F.col("w"))).select("_id", "place", F.call_function("shiftleft", F.lit(1).cast("long"), F.array_position("members", F.col("w")).cast("int") - 1).alias("bit"))
    masks = inside.groupBy("_id", "place").agg(F.bit_or("bit").alias("mask")).groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "mask"))).alias("masks"))
    links = F.transform(F.sequence(F.lit(0), F.size("members") - 1), lambda k: F.coalesce(F.try_element_at("masks", k), F.lit(0).cast("long")))
    return named.join(masks, "_id", "left").select(*sets.columns, links.alias("links"))


def connected_sum(links: Column) -> Column:
    """The sum of (-1)^edges over the connected spanning subgraphs of a graph of at most MOST vertices given by its link masks; null beyond that.

    For each subset of the vertices its independent sets are counted by size, by adding over subsets a vertex at a time. n
    times the n-th coefficient of that polynomial's logarithm, summed over all subsets with alternating signs, is n times
    the sum: whole numbers throughout.
    """
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    shift = lambda k: F.call_function("shiftleft", F.lit(1), k.cast("int"))
    has = lambda m, k: F.call_function("shiftright", m, k.cast("int")).bitwiseAND(F.lit(1)) == 1

    def total(adj: Column) -> Column:
        n = F.size(adj)
        places, masks = F.sequence(F.lit(0), n - 1), F.sequence(F.lit(0), shift(n) - 1)
        independent = lambda m: F.forall(places, lambda k: ~has(m, k) | (F.get(adj, k).bitwiseAND(m.cast("long")) == 0))
        own = F.transform(masks, lambda m: F.transform(F.sequence(F.lit(0), n), lambda k: F.when((F.bit_count(m) == k) & independent(m), one).otherwise(zero)))
        added = lambda rows, j: F.transform(rows, lambda row, m: F.when(has(m, j), F.zip_with(row, F.get(rows, m - shift(j)), lambda a, b: a + b)).otherwise(row))
        counts = F.aggregate(places, own, added)

        def log_term(row: Column) -> Column:
            # l[k] = k a[k] - sum of a[k - j] l[j] over j below k, a[0] being 1.
            term = lambda l, k: F.aggregate(F.sequence(F.lit(0), F.size(l)), k * F.get(row, k), lambda s, j: s - F.when(j == 0, zero).otherwise(F.get(row, k - j) * F.coalesce(F.get(l, j - 1), zero)))
            return F.aggregate(F.sequence(F.lit(1), n), F.array().cast("array<bigint>"), lambda l, k: F.array_append(l, term(l, k)), lambda l: F.element_at(l, -1))

        signed = F.transform(counts, lambda row, m: log_term(row) * F.when((n - F.bit_count(m)) % 2 == 0, one).otherwise(-one))
        return F.aggregate(signed, zero, lambda s, x: s + x) / n

    return F.when((F.size(links) <= MOST) & (F.size(links) > 0), let(links.cast("array<bigint>"), total).cast("long"))
