"""Sums of products against all assignments, and the size of what lies between."""

import itertools
import random

import pytest

from tensorloom.operators import sumproduct
from tensorloom.operators.skew import hot_keys, lookup
from tensorloom.operators.sumproduct import MAX, MIN_SUM, SUM, Factor
from tensorloom.plans import graph_queries


def plain(factors, free, how):
    """All assignments of all variables, one after the other."""
    names = sorted({v for vs, _ in factors for v in vs})
    values = {v: sorted({r[vs.index(v)] for vs, rows in factors if v in vs for r in rows if r[vs.index(v)] is not None}) for v in names}
    out = {}
    for point in itertools.product(*[values[v] for v in names]):
        at = dict(zip(names, point, strict=True))
        found = [[r[-1] for r in rows if all(r[k] == at[v] for k, v in enumerate(vs))] for vs, rows in factors]
        if all(found):
            for chosen in itertools.product(*found):
                x = sum(chosen) if how is MIN_SUM else 1.0
                if how is not MIN_SUM:
                    for c in chosen:
                        x *= c
                out.setdefault(tuple(at[v] for v in free), []).append(x)
    fold = {SUM.plus: sum, MAX.plus: max, MIN_SUM.plus: min}[how.plus]
    return {k: pytest.approx(fold(v)) for k, v in out.items()}


SHAPES = {
    "chain": ["ab", "bc", "cd"], "star": ["abc", "a", "bd", "ce"], "cycle": ["ab", "bc", "cd", "da"], "triangle": ["ab", "bc", "ac", "cd"],
    "apart": ["ab", "cd", "d"], "same": ["ab", "ab", "b"], "one": ["abc"], "two cycles": ["ab", "bc", "ca", "cd", "de", "ec"],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_against_all_assignments(spark, shape):
    rng = random.Random(shape)
    made = [(tuple(vs), [(*[rng.randrange(3) for _ in vs], round(rng.uniform(0.1, 2), 3)) for _ in range(rng.randrange(4, 9))]) for vs in SHAPES[shape]]
    frames = [Factor(f"f{k}", spark.createDataFrame(rows, ", ".join(f"{v} int" for v in vs) + ", re double"), vs) for k, (vs, rows) in enumerate(made)]
    letters = sorted({v for vs, _ in made for v in vs})
    for free in [(), (letters[0],), ("a", "b")]:
        for ring in (SUM, MAX, MIN_SUM) if free == () else (SUM,):
            got = sumproduct.sum_product(frames, free, ring)
            assert got.columns == [*free, "re"]
            assert {tuple(r)[:-1]: r["re"] for r in got.collect()} == plain(made, free, ring)


def test_nulls_repeats_and_empty_factors(spark):
    a = spark.createDataFrame([(1, 2.0), (1, 3.0), (None, 5.0), (2, None)], "a int, w double")
    b = spark.createDataFrame([(1, 10.0), (2, 1.0), (3, 7.0)], "a int, re double")
    assert sumproduct.sum_product([Factor("x", a, ("a",), "w"), Factor("y", b, ("a",))]).collect() == [(50.0,)]
    assert sumproduct.sum_product([Factor("x", a, ("a",), "w"), Factor("y", b.limit(0), ("a",))]).collect() == []
    with pytest.raises(ValueError):
        sumproduct.sum_product([Factor("x", a, ("a",), "w")], ("z",))
    with pytest.raises(ValueError):
        sumproduct.sum_product([Factor("x", a, ("a",), "w"), Factor("y", b.withColumnRenamed("a", "c"), ("c",))], ("a", "c"))


def test_nothing_between_is_larger_than_input_and_output(spark, sf_dir):
    f = graph_queries._business(spark, sf_dir, "region")
    f["supplier"] = Factor("supplier", f["supplier"].rows, ("suppkey",))
    steps = []
    out = sumproduct.sum_product(list(f.values()), ("region",), steps=steps).count()
    assert {s.kind for s in steps} == {"sum", "absorb"} and sum(s.kind == "absorb" for s in steps) == 6
    for s in steps:
        assert s.result.count() <= max(x.count() for x in s.inputs) + out, s.name


def test_selections_travel_before_sums(spark, sf_dir):
    f = graph_queries._business(spark, sf_dir)
    f["region"].rows = f["region"].rows.where("regionkey = 2")
    f["supplier"] = Factor("supplier", f["supplier"].rows, ("suppkey",))
    steps = []
    sumproduct.sum_product(list(f.values()), steps=steps)
    reduced = [s for s in steps if s.kind == "reduce"]
    assert {"nation by region", "customer by nation", "orders by customer", "lineitem by orders"} <= {s.name for s in reduced}
    assert all(s.result.count() < s.inputs[0].count() for s in reduced if s.name != "supplier by lineitem")


def test_a_cycle_is_closed_through_keys(spark, sf_dir):
    f = graph_queries._business(spark, sf_dir, "nation")
    steps = []
    sumproduct.sum_product(list(f.values()), ("nation",), steps=steps)
    most = max(f[k].rows.count() for k in f)
    assert any(s.kind == "merge" for s in steps) and all(s.result.count() <= most for s in steps)


def test_hot_keys_are_looked_up_by_broadcast(spark):
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN id ELSE NULL END AS k", "id")
    unique = spark.range(2000).selectExpr("id AS k", "id * 2 AS x")
    assert [r["k"] for r in hot_keys(rows.where("k IS NOT NULL"), ["k"], 10).collect()] == [7]
    got = lookup(rows, unique, ["k"], 10)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(unique, "k").collect()))
