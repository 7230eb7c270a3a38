"""Golden counts and identities of lattices, loops and clusters."""

import pytest
from pyspark.sql import functions as F

from tensorloom.functions import coords as C
from tensorloom.operators import clusters, loops
from tensorloom.session import table
from tensorloom.sources import lattices


def by_weight(df):
    return {r["weight"]: r["count"] for r in df.groupBy("weight").count().collect()}


def test_boundaries(spark):
    assert lattices.square(spark, 4).count() == 32 and lattices.square(spark, 4, "open").count() == 24
    assert lattices.square(spark, 2).count() == 4
    with pytest.raises(ValueError):
        lattices.square(spark, 4, "twisted")


def test_coordinates(spark):
    s = lattices.sites(spark, 5)
    back = s.select("v", C.site(F.col("i"), F.col("j"), 5).alias("b"), C.translate(C.translate(F.col("v"), 2, 3, 5), -2, -3, 5).alias("t"))
    assert all(r["v"] == r["b"] == r["t"] for r in back.collect())
    assert s.where(C.translate(F.col("v"), 0, 5, 5, "open") != -1).count() == 0


@pytest.mark.parametrize(("L", "weight", "expected"), [(10, 7, {4: 4, 6: 12, 7: 12}), (3, 4, {3: 2, 4: 4}), (4, 6, None)])
def test_loops_at_a_vertex(spark, L, weight, expected):
    found = loops.find(lattices.square(spark, L), weight, at=1)
    assert found.count() == (54 if expected is None else sum(expected.values()))
    if expected:
        assert by_weight(found) == expected
    assert found.where(~F.array_contains("vertices", 1)).count() == 0


def test_all_loops_and_translates_agree(spark):
    e = lattices.square(spark, 8)
    every = table(loops.find(e, 6))
    assert every.count() == 192
    moved = loops.translates(loops.find(e, 6, at=1), 8)
    assert moved.select("edges").exceptAll(every.select("edges")).count() == 0 and moved.count() == 192
    assert by_weight(loops.translation_classes(every, 8)) == {4: 1, 6: 2}


def test_loop_predicate(spark):
    sets = [(1, 1, 2), (1, 2, 3), (1, 1, 3), (2, 1, 2), (2, 2, 3), (3, 1, 2), (3, 2, 3), (3, 1, 3), (3, 7, 8), (3, 8, 9), (3, 7, 9)]
    got = {r["set_id"]: r["valid"] for r in loops.is_loop(spark.createDataFrame(sets, "set_id int, u int, w int")).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_clusters_on_the_torus(spark):
    found = table(loops.numbered(loops.find(lattices.square(spark, 6), 8)))
    inter = table(clusters.interactions(found))
    grown = table(clusters.numbered(clusters.grow(found, inter, 8)))
    counts = {(r["weight"], r["total_loops"]): r["count"] for r in grown.groupBy("weight", "total_loops").count().collect()}
    assert counts == {(4, 1): 36, (6, 1): 84, (7, 1): 72, (8, 1): 684, (8, 2): 180}
    assert clusters.connected(grown, inter).count() == grown.count()
    site = clusters.sites(grown, found).groupBy("site").count().agg(F.min("count"), F.max("count")).first()
    assert site[0] == site[1]


def test_ursell_values(spark):
    chain = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4), (1, 2), (2, 1), (2, 3), (3, 2)], "loop_a long, loop_b long")
    rows = [(1, [(1, 1)], 4, 1), (2, [(1, 2)], 8, 2), (3, [(1, 1), (2, 1)], 8, 2), (4, [(1, 1), (4, 1)], 8, 2), (5, [(1, 1), (2, 1), (3, 1)], 12, 3), (6, [(1, 3)], 12, 3)]
    c = spark.createDataFrame(rows, "cluster_id long, members array<struct<loop_id:bigint,mult:int>>, weight int, total_loops int")
    got = {r["cluster_id"]: r["phi"] for r in clusters.ursell(c, chain).collect()}
    assert got == pytest.approx({1: 1.0, 2: -0.5, 3: -1.0, 4: 0.0, 5: 1.0, 6: 1 / 3})
    assert {r["phi"] for r in clusters.ursell(c, chain, compat=True).collect()} == {1.0, -0.5}


def test_loop_predicate_tests_few_sets_for_being_connected(spark, monkeypatch):
    from tensorloom.operators import graph

    seen = []
    whole = graph.components
    monkeypatch.setattr(graph, "components", lambda e: seen.append(e.count()) or whole(e))
    sets = [(s, 1, k) for s in range(2, 30) for k in (2, 3, 4)] + [(1, 1, 2), (1, 2, 3), (1, 1, 3)]
    got = {r["set_id"]: r["valid"] for r in loops.is_loop(spark.createDataFrame(sets, "set_id int, u int, w int")).collect()}
    assert got == {1: True, **dict.fromkeys(range(2, 30), False)} and seen == [3]
