"""Belief propagation, loop contributions and exact contraction against closed forms."""

import math

import pytest
from pyspark.sql import functions as F

from tensorloom.operators import bp, clusters, contract, exact, loops
from tensorloom.plans import ising
from tensorloom.session import table
from tensorloom.sources import lattices, tensors


def test_bethe_and_exact_free_energy(spark):
    got = {r["beta"]: r for r in ising.compare(spark, 4, [0.1, 0.2, 0.3, 0.35]).collect()}
    bethe = {0.1: -0.70317990, 0.2: -0.73364157, 0.3: -0.78541668, 0.35: -0.81958558}
    true = {0.1: -0.70323124, 0.2: -0.73453081, 0.3: -0.79055907, 0.35: -0.83001878}
    for b in bethe:
        assert got[b]["f_bp"] == pytest.approx(bethe[b], abs=1e-8) and got[b]["f_exact"] == pytest.approx(true[b], abs=1e-7)


@pytest.mark.parametrize(("order", "z"), [("cyclic", 0.00969328), ("sorted", 0.00279576)])
def test_plaquette(spark, order, z):
    t, s = tensors.ising(spark, 6, [0.3], order=order)
    one = loops.numbered(loops.find(lattices.square(spark, 6), 4, at=15))
    got = [r["z"] for r in bp.loop_contributions(t, s, bp.start(t, s), one).collect()]
    assert len(got) == 4 and got == pytest.approx([z] * 4, abs=1e-8)


def test_corrected_free_energy_comes_closer(spark):
    f = {r["weight"]: r["f"] for r in ising.corrected(spark, 8, [0.3], 6).collect()}
    assert f[4] == pytest.approx(-0.790263, abs=1e-6) and abs(f[6] + 0.79055907) < 3e-5


def test_fixed_point_of_a_tree_is_exact(spark):
    pcm = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3)], "chk int, bit int")
    from tensorloom.operators import codes

    t, s = codes.factor_graph(pcm, spark.createDataFrame([(1, 1), (2, 0)], "chk int, s int"), 0.1)
    m = table(bp.fixed_point(t, s, bp.start(t, s, noise=0.1), rounds=10))
    assert bp.residual(t, s, m).first()["total"] < 1e-9
    full = contract.contract_network(t, s).first()["re"]
    assert bp.log_partition(bp.local_z(t, s, m)).first()["logz"] == pytest.approx(math.log(full))


def test_selective_update_rejects_foreign_links(spark):
    t, s = tensors.ising(spark, 3, [0.3])
    with pytest.raises(ValueError):
        bp.step(t, s, bp.start(t, s), only=spark.createDataFrame([(1, 99)], "u int, w int"))


def test_excited_edges_kill_messages(spark):
    t, s = tensors.ising(spark, 3, [0.3])
    e = bp.excited(bp.start(t, s))
    assert e.groupBy("u", "w", "a").agg(F.sum("re").alias("x")).agg(F.max(F.abs("x"))).first()[0] < 1e-12


def test_rows_and_network_agree(spark):
    rows = exact.ising_rows(spark, 3, [0.4]).first()["logz"]
    plain = sum(
        math.exp(0.4 * sum(h[3 * i + j] * (h[3 * i + (j + 1) % 3] + h[3 * ((i + 1) % 3) + j]) for i in range(3) for j in range(3)))
        for h in ([1 - 2 * (k >> b & 1) for b in range(9)] for k in range(512))
    )
    assert rows == pytest.approx(math.log(plain))


def test_random_sheet_without_noise_is_a_product(spark):
    t, s = tensors.random_peps(spark, 2, 2, 0.0, 3)
    m = bp.fixed_point(t, s, bp.start(t, s), rounds=20)
    assert bp.log_partition(bp.local_z(t, s, m)).first()["logz"] == pytest.approx(math.log(contract.contract_network(t, s).first()["re"]))


def test_loop_completes_a_square_exactly(spark):
    t, s = tensors.random_peps(spark, 2, 2, 0.5, 9)
    m = table(bp.fixed_point(t, s, bp.start(t, s), rounds=80, keep=0.1))
    one = loops.numbered(loops.find(lattices.square(spark, 2, "open"), 4))
    z = bp.loop_contributions(t, s, m, one).first()["z"]
    vacuum = math.exp(bp.log_partition(bp.local_z(t, s, m)).first()["logz"])
    assert vacuum * (1 + z) == pytest.approx(contract.contract_network(t, s).first()["re"], rel=1e-6)


def test_corner_matrices_against_a_ring(spark):
    from tensorloom.operators.exact import _double_tensor

    import numpy as np

    t = _double_tensor(math.sqrt(1.5), math.sqrt(6))
    v = np.ones((4,) * 6)
    for _ in range(40):
        x = np.tensordot(t, v, axes=([1], [0]))
        for k in range(1, 6):
            x = np.moveaxis(np.tensordot(t, x, axes=([0, 1], [1, 2 + k])), [0, 1, 2], [1, 2 + k, 0])
        w = np.trace(x, axis1=0, axis2=1)
        growth = np.linalg.norm(w) / np.linalg.norm(v)
        v = w / np.linalg.norm(w)
    points = spark.createDataFrame([(math.sqrt(1.5), math.sqrt(6))], "a1 double, a2 double")
    assert exact.corner_free_energy(points, chi=16, steps=40).first()["log_kappa"] == pytest.approx(math.log(growth) / 6, abs=0.01)


def test_ursell_of_three_loops(spark):
    """A triangle of touching loops has three trees and one cycle, a chain one tree; two copies touch each other."""
    member = lambda *ms: [{"loop_id": k, "mult": m} for k, m in ms]
    rows = [(1, member((1, 1), (2, 1), (3, 1)), 3), (2, member((1, 1), (2, 1), (4, 1)), 3), (3, member((1, 2), (2, 1)), 3), (4, member((5, 1), (6, 1), (7, 1)), 3), (5, member((1, 3)), 3), (6, member((1, 1)), 1), (7, member((1, 1), (2, 1)), 2), (8, member((1, 2)), 2)]
    found = spark.createDataFrame(rows, f"cluster_id long, members {clusters.MEMBERS}, total_loops int")
    touch = [(1, 2), (2, 3), (1, 3), (2, 4), (5, 6), (6, 7), (5, 7)]
    inter = spark.createDataFrame([p for a, b in touch for p in ((a, b), (b, a))] + [(k, k) for k in range(1, 8)], "loop_a long, loop_b long")
    got = {r["cluster_id"]: r["phi"] for r in clusters.ursell(found, inter).collect()}
    assert got == {1: 2.0, 2: 1.0, 3: 1.0, 4: 2.0, 5: 2.0 / 6, 6: 1.0, 7: -1.0, 8: -0.5}


def test_pairs_that_share_links_are_not_counted_in_words(spark, monkeypatch):
    """Forty copies of a small network, far apart from each other: links name a few vertices, words would hold about one each."""
    from tensorloom.operators import contract, overlap

    slots = [(10 * k + v, 100 * k + e) for k in range(40) for e in range(9) for v in ((e % 4), (e % 3) + 4)]
    monkeypatch.setattr(overlap, "_by_words", None)
    got = {tuple(r) for r in contract.edges_of(spark.createDataFrame(slots, "v long, link long")).collect()}
    shared = {}
    for k in range(40):
        for e in range(9):
            pair = (10 * k + e % 4, 10 * k + e % 3 + 4)
            shared[pair] = shared.get(pair, 0) + 1
    assert got == {(*pair, n) for pair, n in shared.items()}
