"""Rank and solvability mod 2 against elimination on whole rows."""

import random

import numpy as np
import pytest

from tensorloom.operators import elimination
from tensorloom.plans import graph_queries


def plain(entries, sides=()):
    """Rank, and the right-hand sides without a solution, one whole row after the other."""
    rows, b = {}, {}
    for r, c in entries:
        if r is not None and c is not None:
            rows[r] = rows.get(r, 0) ^ (1 << c)
    for r, x in sides:
        b[r] = b.get(r, 0) ^ x
    basis, bad = [], 0
    for r in set(rows) | set(b):
        m, x = rows.get(r, 0), b.get(r, 0)
        for q, y in basis:
            if m ^ q < m:
                m, x = m ^ q, x ^ y
        if m:
            basis.append((m, x))
            basis.sort(reverse=True)
        else:
            bad |= x
    return len(basis), bad


@pytest.mark.parametrize(("seed", "n_rows", "n_cols", "n"), [(1, 40, 30, 70), (2, 60, 20, 300), (3, 20, 60, 200), (4, 300, 130, 2500), (5, 12, 12, 20)])
def test_against_whole_rows(spark, seed, n_rows, n_cols, n):
    rng = random.Random(seed)
    entries = [(rng.randrange(n_rows), rng.randrange(n_cols)) for _ in range(n)] + [(1, 1), (1, 1), (None, 2), (3, None)]
    x = {c for c in range(n_cols) if rng.random() < 0.5}
    good = {}
    for r, c in entries:
        if r is not None and c in x:
            good[r] = good.get(r, 0) ^ 1
    sides = [(r, v) for r, v in good.items() if v] + [(r, 2 * rng.randrange(2) + (1 << 63 if rng.random() < 0.1 else 0)) for r in range(n_rows)] + [(n_rows + 5, 4)]
    signed = [(r, b - (1 << 64) if b >= 1 << 63 else b) for r, b in sides]
    got = elimination.eliminate(spark.createDataFrame(entries, "row long, col long").repartition(3), spark.createDataFrame(signed, "row long, b long"))
    assert got == plain(entries, sides) and not got[1] & 1 and got[1] & 4


def test_echelon():
    rng = np.random.default_rng(0)
    rows = np.zeros((50, 2), dtype=np.uint64)
    rows[:, 0] = rng.integers(0, 1 << 20, 50)
    form = elimination.echelon(rows, 20)
    leads = [int(r) & -int(r) for r in form[:, 0]]
    assert leads == sorted(leads) and len(set(leads)) == len(form) == plain([(i, k) for i, r in enumerate(rows[:, 0].tolist()) for k in range(20) if r >> k & 1])[0]


def test_a_tree_peels_away(spark):
    trace = []
    edges = [(v, v) for v in range(1, 60)] + [(v, v // 2) for v in range(1, 60)]
    assert elimination.eliminate(spark.createDataFrame(edges, "row long, col long"), trace=trace) == (59, 0)
    assert sum(map(sum, trace)) == 59


def test_a_graph_contracts(spark, monkeypatch):
    # Every column has three entries or more: only rows of two make columns one, and no core is left.
    monkeypatch.setattr(elimination, "MOST_COLUMNS", 0)
    rng = random.Random(8)
    pairs = {tuple(sorted(rng.sample(range(k, k + 40), 2))) for k in (0, 40) for _ in range(200)}
    entries = [(i, c) for i, e in enumerate(sorted(pairs)) for c in e]
    x = {c: rng.randrange(2) for c in range(80)}
    sides = [(i, x[a] ^ x[b] | 2 * rng.randrange(2)) for i, (a, b) in enumerate(sorted(pairs))]
    got = elimination.eliminate(spark.createDataFrame(entries, "row long, col long"), spark.createDataFrame(sides, "row long, b long"))
    assert got == plain(entries, sides) == (78, 2)


def test_empty(spark):
    none = spark.createDataFrame([], "row long, col long")
    assert elimination.eliminate(none) == (0, 0)
    assert elimination.eliminate(none, spark.createDataFrame([(1, 2)], "row long, b long")) == (0, 2)


def test_orders_and_parts(spark, sf_dir):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey AS row", "l_partkey AS col")
    sides = graph_queries.order_part_sides(spark, sf_dir)
    want = plain([tuple(r) for r in line.collect()], [tuple(r) for r in sides.collect()])
    assert elimination.eliminate(line, sides) == want and want[1] & 1 == 0


def test_rows_of_two_entries_by_forests(spark):
    import random

    rng = random.Random(2)
    pairs = [(rng.randrange(60), 100 + rng.randrange(40)) for _ in range(70)] + [(3, 3), (None, 4), (5, None), (200, 201), (201, 202), (200, 202)]
    df = spark.createDataFrame(pairs, "a long, b long")
    rows = df.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct().selectExpr("concat(a, '-', b) AS row", "a", "b")
    entries = rows.selectExpr("row", "a AS col").union(rows.selectExpr("row", "b AS col"))
    assert elimination.pairs_rank(df) == elimination.eliminate(entries)[0]
    assert elimination.pairs_rank(df.limit(0)) == 0


def test_a_forest_hands_on_fewer_links(spark, sf_dir):
    pairs = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("2 * l_partkey + 1 AS a", "2 * l_suppkey AS b").distinct()
    columns = pairs.select("a").union(pairs.select("b")).distinct().count()
    for lot in (50, 10**6):
        links = elimination.forest(pairs, lot)
        assert elimination.pairs_rank(links) == elimination.pairs_rank(pairs) and links.count() < 4 * columns
