"""Connected sets against all subsets, and their signed sums against all subgraphs."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tensorloom.operators import connected_sets as C


def joined(members, edges):
    left, reach = set(members), {min(members)}
    while True:
        more = {w for u, w in edges if u in reach and w in left} | {u for u, w in edges if w in reach and u in left}
        if more <= reach:
            return reach == left
        reach |= more


def made(seed, n, m):
    rng = random.Random(seed)
    return [(v * 10, rng.randrange(1, 4)) for v in range(n)], [tuple(x * 10 for x in rng.sample(range(n), 2)) for _ in range(m)]


@pytest.mark.parametrize(("seed", "n", "m", "most"), [(1, 9, 14, 8), (2, 8, 28, 30), (3, 10, 9, 12)])
def test_every_connected_set_once(spark, seed, n, m, most):
    vertices, edges = made(seed, n, m)
    edges += [(10, 10), edges[0], (edges[1][1], edges[1][0]), (0, 999), (None, 10)]
    weight = dict(vertices)
    real = [e for e in edges if None not in e and 999 not in e]
    want = {s: sum(weight[v] for v in s) for k in range(1, n + 1) for s in combinations(sorted(weight), k) if sum(weight[v] for v in s) <= most and joined(s, real)}
    got = C.connected_sets(spark.createDataFrame(vertices, "v long, weight long"), spark.createDataFrame(edges, "u long, w long"), most).collect()
    assert len(got) == len(want) and {tuple(sorted(r["members"])): r["weight"] for r in got} == want


def test_nothing_is_compared_to_avoid_repeats(spark):
    vertices, edges = made(1, 9, 14)
    near = C.table(C._neighbourhoods(spark.createDataFrame(vertices, "v long, weight long"), spark.createDataFrame(edges, "u long, w long"), 9))
    now = C.table(near.select(F.array("v").alias("members"), "weight", C._seen(F.col("nbrs"), F.col("v"), F.lit(1)).alias("seen")))
    plan = C.grown(now, near, 9)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Join") == 1


def plain_sum(n, edges):
    total = 0
    for k in range(len(edges) + 1):
        for chosen in combinations(edges, k):
            if joined(range(n), chosen):
                total += (-1) ** k
    return total


def test_sums_against_all_subgraphs(spark):
    rng = random.Random(4)
    graphs = [(1, []), (2, []), (2, [(0, 1)]), (3, [(0, 1), (1, 2), (0, 2)]), (4, list(combinations(range(4), 2))), (5, list(combinations(range(5), 2)))]
    graphs += [(n, rng.sample(list(combinations(range(n), 2)), min(m, n * (n - 1) // 2))) for n, m in [(4, 4), (5, 7), (6, 9), (7, 10), (8, 11), (10, 12)]]
    masks = lambda n, e: [sum(1 << (b if a == v else a) for a, b in e if v in (a, b)) for v in range(n)]
    df = spark.createDataFrame([(k, masks(n, e)) for k, (n, e) in enumerate(graphs)] + [(-1, [0] * 11), (-2, []), (-3, None)], "k int, links array<bigint>")
    got = {r["k"]: r["s"] for r in df.select("k", C.connected_sum(F.col("links")).alias("s")).collect()}
    assert got == {-1: None, -2: None, -3: None} | {k: plain_sum(n, e) for k, (n, e) in enumerate(graphs)}
    # A complete graph of n gives (-1)^(n - 1) (n - 1)!, a ring of n gives (-1)^(n - 1) (n - 1).
    ring = spark.createDataFrame([([1 << (v + 1) % 10 | 1 << (v - 1) % 10 for v in range(10)],), ([1023 ^ 1 << v for v in range(10)],)], "links array<bigint>")
    assert [r[0] for r in ring.select(C.connected_sum(F.col("links"))).collect()] == [-9, -362880]


def test_links_and_empty(spark):
    sets, edges = spark.createDataFrame([([5, 7, 9],), ([5],)], "members array<bigint>"), spark.createDataFrame([(5, 7), (9, 7), (7, 5), (9, 11)], "u long, w long")
    assert {tuple(r["members"]): r["links"] for r in C.with_links(sets, edges).collect()} == {(5, 7, 9): [2, 5, 2], (5,): [0]}
    none = spark.createDataFrame([], "v long, weight long")
    assert C.connected_sets(none, edges, 5).count() == 0
    assert C.connected_sets(spark.createDataFrame([(1, 2)], "v long, weight long"), edges.limit(0), 5).count() == 1
