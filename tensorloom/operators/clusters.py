"""Clusters: multisets of loops that hang together in the interaction graph.

loops (loop_id, edges, vertices, weight); interaction (loop_a, loop_b) of loops that share a vertex, each with itself;
clusters (members, weight, total_loops), members an ascending array of (loop_id, mult).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import table

MEMBERS = "array<struct<loop_id:bigint,mult:int>>"


def interactions(loops: DataFrame) -> DataFrame:
    """(loop_a, loop_b) both ways, by an equi-join on vertices."""
    at = loops.select("loop_id", F.explode("vertices").alias("v"))
    return at.select(F.col("loop_id").alias("loop_a"), "v").join(at.select(F.col("loop_id").alias("loop_b"), "v"), "v").select("loop_a", "loop_b").distinct()


def shared_vertices(loops: DataFrame) -> DataFrame:
    """(loop_a, loop_b, n) for loop_a < loop_b: how many vertices touching loops share."""
    at = loops.select("loop_id", F.explode("vertices").alias("v"))
    j = at.select(F.col("loop_id").alias("loop_a"), "v").join(at.select(F.col("loop_id").alias("loop_b"), "v"), "v").where("loop_a < loop_b")
    return j.groupBy("loop_a", "loop_b").agg(F.count(F.lit(1)).alias("n"))


def disjoint_pairs(left: DataFrame, right: DataFrame, touching: DataFrame) -> DataFrame:
    """Number of pairs a < b (one from each side, either way round) that share no vertex: all pairs less those that touch."""
    n = left.select("loop_id").join(F.broadcast(right.agg(F.count(F.lit(1)).alias("n"))))
    own = left.join(right.select("loop_id"), "loop_id", "left_semi").agg(F.count(F.lit(1)).alias("own"))
    both = touching.where("loop_a < loop_b").select(F.col("loop_a").alias("a"), F.col("loop_b").alias("b"))
    l, r = left.select(F.col("loop_id").alias("a")), right.select(F.col("loop_id").alias("b"))
    one = both.join(l, "a").join(r, "b")
    other = both.join(l.withColumnRenamed("a", "b"), "b").join(r.withColumnRenamed("b", "a"), "a")
    t = one.select("a", "b").union(other.select("a", "b")).distinct().agg(F.count(F.lit(1)).alias("touch"))
    total = n.agg(F.sum("n").alias("total"))
    return total.join(F.broadcast(own)).join(F.broadcast(t)).select(((F.col("total") - F.col("own")) / F.when(F.col("own") > 0, 2).otherwise(1) - F.col("touch")).cast("long").alias("disjoint"), F.col("touch").alias("touching"))


def grow(loops: DataFrame, interaction: DataFrame, weight: int, at: int | None = None) -> DataFrame:
    """(members, weight, total_loops): all connected clusters of at most that weight, or of those with a loop on the vertex `at`."""
    small = table(loops.where(F.col("weight") <= weight).select("loop_id", "vertices", "weight"))
    seed = small if at is None else small.where(F.array_contains("vertices", at))
    now = seed.select(F.array("loop_id").alias("ids"), "weight")
    found, lightest = now, small.agg(F.min("weight")).first()[0] or weight
    by_loop = small.select(F.col("loop_id").alias("loop_b"), F.col("weight").alias("wb"))
    for _ in range(weight // lightest - 1):
        ends = now.select("ids", "weight", F.explode(F.array_distinct("ids")).alias("loop_a"))
        new = ends.join(interaction, "loop_a").join(by_loop, "loop_b").where(F.col("weight") + F.col("wb") <= weight)
        now = table(new.select(F.array_sort(F.array_append("ids", F.col("loop_b"))).alias("ids"), (F.col("weight") + F.col("wb")).alias("weight")).distinct())
        found = found.union(now)
    members = F.transform(F.array_distinct("ids"), lambda k: F.struct(k.alias("loop_id"), F.size(F.filter("ids", lambda x: x == k)).alias("mult")))
    return found.distinct().select(members.cast(MEMBERS).alias("members"), F.col("weight"), F.size("ids").alias("total_loops"))


def key(members: Column) -> Column:
    """Text key of a cluster, the same for equal multisets."""
    return F.array_join(F.transform(F.array_sort(members), lambda m: F.concat_ws("*", m["loop_id"].cast("string"), m["mult"].cast("string"))), ";")


def numbered(clusters: DataFrame) -> DataFrame:
    """Clusters with cluster_id, a digest of their members, each once."""
    return clusters.select(F.xxhash64(key(F.col("members"))).alias("cluster_id"), "members", "weight", "total_loops").dropDuplicates(["cluster_id"])


def sites(clusters: DataFrame, loops: DataFrame) -> DataFrame:
    """(cluster_id, site): every vertex that a cluster touches."""
    m = clusters.select("cluster_id", F.explode("members").alias("m")).select("cluster_id", "m.loop_id")
    return m.join(loops.select("loop_id", F.explode("vertices").alias("site")), "loop_id").select("cluster_id", "site").distinct()


def connected(clusters: DataFrame, interaction: DataFrame) -> DataFrame:
    """The clusters whose distinct loops are connected in the interaction graph, for clusters that were not grown here."""
    from .graph import components

    m = clusters.select("cluster_id", F.explode("members.loop_id").alias("l"))
    name = lambda c: F.concat_ws(":", F.col("cluster_id").cast("string"), F.col(c).cast("string"))
    pairs = m.withColumnRenamed("l", "loop_a").join(interaction, "loop_a").join(m.withColumnRenamed("l", "loop_b"), ["cluster_id", "loop_b"])
    label = components(pairs.select(name("loop_a").alias("a"), name("loop_b").alias("b")))
    parts = m.select("cluster_id", name("l").alias("id")).join(label, "id", "left").groupBy("cluster_id").agg(F.count_distinct(F.coalesce("component", "id")).alias("n"))
    return clusters.join(parts.where("n = 1"), "cluster_id", "left_semi")


def translation_classes(clusters: DataFrame, loops: DataFrame, L: int) -> DataFrame:
    """(key, weight, n): classes of clusters under joint translations, offsets between loops kept, and their sizes."""
    from . import loops as loop_ops
    from ..functions import coords as C

    spark = clusters.sparkSession
    m = clusters.select("cluster_id", "weight", F.explode("members").alias("m")).select("cluster_id", "weight", "m.loop_id", "m.mult").join(loops.select("loop_id", "edges"), "loop_id")
    grid = spark.range(L * L).select(F.floor(F.col("id") / L).cast("int").alias("di"), (F.col("id") % L).cast("int").alias("dj"))
    moved = m.join(F.broadcast(grid)).select("cluster_id", "weight", "di", "dj", F.concat_ws("*", C.edge_key(loop_ops._moved(F.col("edges"), F.col("di"), F.col("dj"), L, "periodic")), F.col("mult").cast("string")).alias("k"))
    whole = moved.groupBy("cluster_id", "weight", "di", "dj").agg(F.array_join(F.array_sort(F.collect_list("k")), "|").alias("k"))
    return whole.groupBy("cluster_id", "weight").agg(F.min("k").alias("key")).groupBy("key", "weight").agg(F.count(F.lit(1)).alias("n"))


def _spanning_sum(n: int, edges: list[tuple[int, int]]) -> int:
    """Sum of (-1)^edges over the connected spanning subgraphs, by deleting and merging one edge."""
    if n == 1:
        return 1
    if not edges:
        return 0
    (a, b), rest = edges[0], edges[1:]
    merged = [(min(x, y), max(x, y)) for x, y in (((a if x == b else x), (a if y == b else y)) for x, y in rest)]
    if any(x == y for x, y in merged):
        # Parallel edges: those with and without the loop that they become cancel.
        return _spanning_sum(n, rest)
    return _spanning_sum(n, rest) - _spanning_sum(n - 1, merged)


def ursell(clusters: DataFrame, interaction: DataFrame, compat: bool = False) -> DataFrame:
    """(cluster_id, phi): connected spanning subgraphs of the cluster's loops, signed by their edges, over the factorials of multiplicities.

    Copies of a loop touch each other. compat gives 1 for a single loop and -1/2 for every other cluster.
    """
    if compat:
        return clusters.select("cluster_id", F.when(F.col("total_loops") == 1, 1.0).otherwise(-0.5).alias("phi"))
    m = clusters.select("cluster_id", "members", F.explode("members.loop_id").alias("loop_a"))
    inside = m.join(interaction, "loop_a").where(F.array_contains(F.col("members.loop_id"), F.col("loop_b")) & (F.col("loop_a") < F.col("loop_b")))
    pairs = inside.groupBy("cluster_id").agg(F.collect_list(F.struct("loop_a", "loop_b")).alias("pairs"))

    many = clusters.join(pairs, "cluster_id", "left").select("cluster_id", "members", "total_loops", "pairs")
    two = F.when(F.size("members") == 1, -0.5).otherwise(F.when(F.col("pairs").isNotNull(), -1.0).otherwise(0.0))
    few = many.where("total_loops <= 2").select("cluster_id", F.when(F.col("total_loops") == 1, 1.0).otherwise(two).alias("phi"))
    return few.union(many.where("total_loops > 2").select("cluster_id", "members", "pairs").mapInPandas(_phi, "cluster_id long, phi double"))


def _phi(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """phi of clusters of three loops or more; clusters of one shape, which are most, are computed once."""
    known: dict[tuple, float] = {}

    def value(members, pairs) -> float:
        place = {int(m["loop_id"]): k for k, m in enumerate(members)}
        mult = tuple(int(m["mult"]) for m in members)
        touch = frozenset((place[int(p["loop_a"])], place[int(p["loop_b"])]) for p in (() if pairs is None else pairs))
        touch = frozenset((min(x), max(x)) for x in touch)
        if (mult, touch) not in known:
            nodes = [k for k, n in enumerate(mult) for _ in range(n)]
            edges = [(x, y) for (x, a), (y, b) in itertools.combinations(enumerate(nodes), 2) if a == b or (a, b) in touch]
            known[mult, touch] = _spanning_sum(len(nodes), edges) / math.prod(map(math.factorial, mult))
        return known[mult, touch]

    for f in frames:
        yield pd.DataFrame({"cluster_id": f["cluster_id"], "phi": [value(m, p) for m, p in zip(f["members"], f["pairs"], strict=True)]})


def first_clusters(clusters: DataFrame, n: int) -> DataFrame:
    """The n lightest clusters, by weight and key: for a quick look, where a sum over all isn't wanted."""
    return clusters.orderBy("weight", key(F.col("members"))).limit(n)


def contributions(clusters: DataFrame, phi: DataFrame, z: DataFrame) -> DataFrame:
    """(g, cluster_id, weight, c): phi times the loops' z to their multiplicities; without a finite value no row."""
    m = clusters.select("cluster_id", "weight", F.explode("members").alias("m")).select("cluster_id", "weight", "m.loop_id", "m.mult")
    logs = m.join(z, "loop_id").groupBy("g", "cluster_id", "weight").agg(F.sum(F.col("mult") * F.log(F.abs("z"))).alias("l"), F.sum(F.when(F.col("z") < 0, F.col("mult")).otherwise(0)).alias("neg"), F.max((F.col("z") == 0).cast("int")).alias("zero"))
    c = F.when(F.col("zero") == 1, 0.0).otherwise(F.exp("l") * (1 - 2 * (F.col("neg") % 2)))
    out = logs.join(phi, "cluster_id").select("g", "cluster_id", "weight", (F.col("phi") * c).alias("c"))
    return out.where(~F.isnan("c") & (F.abs("c") < float("inf")))
