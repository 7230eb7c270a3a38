"""Messages that only move where their inputs did, against whole rounds of all messages."""

import math
import random

import pytest

from tensorloom.operators import delta
from tensorloom.plans import graph_queries
from tensorloom.session import setting


def plain(fields, edges, rounds=400):
    """All messages of all rounds, in Python."""
    h, j = {}, {}
    for v, x in fields:
        h[v] = h.get(v, 0.0) + (x or 0.0)
    for u, w, x in edges:
        if u is not None and w is not None and x is not None and u != w:
            j[min(u, w), max(u, w)] = j.get((min(u, w), max(u, w)), 0.0) + x
    both = {**j, **{(w, u): x for (u, w), x in j.items()}}
    nbrs = {}
    for u, w in both:
        nbrs.setdefault(u, []).append(w)
    m = dict.fromkeys(both, 0.0)
    for _ in range(rounds):
        total = {v: h.get(v, 0.0) + sum(m[k, v] for k in ks) for v, ks in nbrs.items()}
        m = {(u, w): math.atanh(math.tanh(both[u, w]) * math.tanh(total[u] - m[w, u])) for u, w in both}
    total = {v: h.get(v, 0.0) + sum(m[k, v] for k in ks) for v, ks in nbrs.items()}
    return {v: pytest.approx(1 / (1 + math.exp(-2 * x)), abs=1e-9) for v, x in total.items()}


def made(seed, n, edges):
    rng = random.Random(seed)
    return [(v, rng.uniform(-0.5, 0.5)) for v in range(n)], [(*rng.sample(range(n), 2), rng.uniform(-0.2, 0.3)) for _ in range(edges)]


@pytest.mark.parametrize("slice_size", [1000, 3])
def test_against_whole_rounds(spark, slice_size):
    fields, edges = made(3, 30, 60)
    edges += [(0, v, 0.05) for v in range(1, 30)] + [(4, 4, 9.0), (None, 3, 0.1), (5, 6, None), (7, 8, 0.1), (8, 7, 0.1)]
    fields += [(0, 0.1), (1, None)]
    f, e = spark.createDataFrame(fields, "v long, h double"), spark.createDataFrame(edges, "u long, w long, j double")
    got = {r["v"]: r["p"] for r in delta.fixed_point(f, e, slice_size=slice_size).collect()}
    assert got == plain(fields, edges)


def test_edges_without_fields_and_none(spark):
    f, e = spark.createDataFrame([], "v long, h double"), spark.createDataFrame([(1, 2, 0.3)], "u long, w long, j double")
    assert {r["v"]: r["p"] for r in delta.fixed_point(f, e).collect()} == {1: 0.5, 2: 0.5}
    assert delta.fixed_point(f, e.limit(0)).collect() == []


def test_a_late_change_travels_alone(spark):
    # A long chain with one field at its end: each round moves one message on, and that is all that a round handles.
    n = 12
    f = spark.createDataFrame([(0, 1.0)], "v long, h double")
    e = spark.createDataFrame([(v, v + 1, 0.7) for v in range(n)], "u long, w long, j double")
    trace = []
    got = {r["v"]: r["p"] for r in delta.fixed_point(f, e, trace=trace).collect()}
    assert trace == [1] * n + [0] and got == plain([(0, 1.0)], [(v, v + 1, 0.7) for v in range(n)])


def test_changes_fall_on_the_data(spark, sf_dir):
    fields, edges = graph_queries.supplier_part_model(spark, sf_dir)
    trace = []
    got = {r["v"]: r["p"] for r in delta.fixed_point(fields, edges, tolerance=1e-8, trace=trace).collect()}
    links = 2 * edges.count()
    assert trace[0] <= links and trace[-1] == 0 and sorted(trace[1:], reverse=True) == trace[1:] and sum(trace) < 0.8 * len(trace) * links
    want = plain([tuple(r) for r in fields.collect()], [tuple(r) for r in edges.collect()], rounds=60)
    assert set(got) == set(want) and all(abs(got[v] - want[v].expected) < 1e-6 for v in want)


def test_a_round_shuffles_changes_only(spark):
    fields, edges = made(5, 40, 80)
    state = delta.start(spark.createDataFrame(fields, "v long, h double"), spark.createDataFrame(edges, "u long, w long, j double"), 4)
    moved = delta.table(delta._changes(state, 1e-9))
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"), setting(spark, *delta.CO_PARTITIONED):
        plan = delta._received(state, moved, 1e-9)._jdf.queryExecution().executedPlan().toString()
    # Every exchange deals out rows of the changes; the state is read in its buckets.
    assert "Bucketed: true" in plan and all("moved" in x or "more" in x for x in plan.split("Exchange hashpartitioning")[1:])
    lines = plan.splitlines()
    scan = next(k for k, x in enumerate(lines) if "Bucketed: true" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-|"))
    above = depth(lines[scan])
    for k in range(scan, -1, -1):
        if depth(lines[k]) < above:
            above = depth(lines[k])
            assert "Exchange" not in lines[k]


def test_totals_of_vertices_give_the_same_fixed_point(spark):
    fields, edges = made(3, 30, 60)
    edges += [(0, v, 0.05) for v in range(1, 30)] + [(4, 4, 9.0), (None, 3, 0.1), (5, 6, None), (7, 8, 0.1), (8, 7, 0.1)]
    fields += [(0, 0.1), (1, None)]
    f, e = spark.createDataFrame(fields, "v long, h double"), spark.createDataFrame(edges, "u long, w long, j double")
    assert {r["v"]: r["p"] for r in delta.by_totals(f, e, tolerance=1e-11).collect()} == plain(fields, edges)
    assert delta.by_totals(f, e.limit(0)).collect() == []


def test_rounds_on_the_data_write_no_edges_and_leave_nothing(spark, sf_dir, monkeypatch):
    written, dropped = [], []
    keep, away = delta.bucketed, delta.drop
    monkeypatch.setattr(delta, "bucketed", lambda df, *a: written.append(keep(df, *a)) or written[-1])
    monkeypatch.setattr(delta, "drop", lambda df: dropped.append(df) or away(df))
    fields, edges = graph_queries.supplier_part_model(spark, sf_dir)
    assert delta.by_totals(fields, edges, rounds=3).count() == 210
    # The edges once, the vertices once, then the totals at the start and of each round, of which only the last stay.
    assert len(written) == 6 and written[1].count() < written[0].count() == edges.count()
    assert all(any(d is t for d in dropped) for t in written[2:-1]) and not any(d is written[-1] for d in dropped)


def test_rounds_keep_totals_of_shared_vertices_only(spark, sf_dir, monkeypatch):
    written = []
    keep = delta.bucketed
    monkeypatch.setattr(delta, "bucketed", lambda df, *a: written.append(keep(df, *a)) or written[-1])
    assert delta.by_totals(*graph_queries.supplier_part_model(spark, sf_dir), rounds=1).count() == 210
    # The ten suppliers: each part's edges lie in one place, where its total is worked out from theirs.
    assert [df.count() for df in (written[1], written[-1])] == [10, 10]


@pytest.mark.parametrize("j", [0.02, -0.4, 1.5, -3.0])
def test_packed_messages_solve_their_equations(j):
    """A star of one vertex that owns its edges: what it sends is its total less what it got, and the same the other way round."""
    import numpy as np
    import pyarrow as pa

    v, total, h = np.array([1, 2, 3]), np.array([0.3, -0.7, 1.1]), 0.2
    rows = {"deal": [0] * 3, "part": [0] * 3, "low": [9] * 3, "high": [1, 2, 3], "t": [math.tanh(j * k) for k in (1, 0.5, 0.8)], "n": [3] * 3, "h": [h] * 3}
    row = delta._pack(pa.table(rows)).to_pylist()[0]
    shared, inc, _, low, near, moved = delta._worked(row, v, total, 1e-13)
    assert shared.tolist() == [1, 2, 3] and low.tolist() == [9] and moved <= 1e-13
    got = [math.atanh(t * math.tanh(x - m)) for t, x, m in zip(rows["t"], total, inc, strict=True)]
    assert near[0] == pytest.approx(h + sum(got), abs=1e-10)
    assert inc.tolist() == pytest.approx([math.atanh(t * math.tanh(near[0] - m)) for t, m in zip(rows["t"], got, strict=True)], abs=1e-10)
