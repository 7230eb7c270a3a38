"""Codes, homology, decoders."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.operators import codes
from tensorloom.plans import decoding
from tensorloom.sources import codes as S


def test_toric_shape(spark):
    t = S.toric(spark, 3)
    assert t.count() == 36 and t.groupBy("bit").count().where("count <> 2").count() == 0
    # Plaquettes and logical operators have no syndrome.
    for sets in (S.plaquettes(spark, 3).select(F.col("p").alias("sample_id"), "bit"), S.logicals(spark, 3).select(F.col("op").alias("sample_id"), "bit")):
        assert codes.syndrome(t, sets.withColumn("x", F.lit(1))).where("s = 1").count() == 0


@pytest.mark.parametrize("L", [3, 5])
def test_homology_agrees_with_elimination(spark, L):
    sets = []
    for k in range(30):
        sets += [(k, 1 + (7 * k * j + j * j) % (2 * L * L)) for j in range(1 + k % 7)]
    for p in range(1, L + 1):
        sets += [(100 + p, r["e"]) for r in S.cycle(spark, L, "h", p).collect()]
        sets += [(200 + p, r["bit"]) for r in S.plaquettes(spark, L).where(F.col("p") <= p).collect()]
    df = spark.createDataFrame(sets, "set_id int, e int")
    a = {r["set_id"]: r["homology_trivial"] for r in codes.check_decoding(df, df, L).collect()}
    b = {r["set_id"]: r["solvable"] for r in codes.solvable(S.plaquettes(spark, L), df).collect()}
    assert a == b and any(a.values()) and not all(a.values())


def test_regular_code(spark):
    t = S.gallager(spark, 24, 3, 4)
    assert t.groupBy("bit").count().where("count <> 3").count() == 0 and t.groupBy("chk").count().where("count <> 4").count() == 0
    with pytest.raises(ValueError):
        S.gallager(spark, 10, 3, 4)


def test_bch_corrects_two_errors(spark):
    checks = {}
    for c, b in S.bch(spark, 4, 2).collect():
        checks.setdefault(b, set()).add(c)
    syndromes = {frozenset()}
    for n in (1, 2):
        for bits in itertools.combinations(range(1, 16), n):
            s = frozenset()
            for b in bits:
                s ^= frozenset(checks.get(b, ()))
            assert s not in syndromes
            syndromes.add(s)


def test_decoders_on_a_tree(spark):
    pcm = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3)], "chk int, bit int")
    for s1, s2 in itertools.product((0, 1), repeat=2):
        s = spark.createDataFrame([(1, 1, s1), (1, 2, s2)], "sample_id long, chk int, s int")
        w = {x: 0.1 ** sum(x) * 0.9 ** (3 - sum(x)) for x in itertools.product((0, 1), repeat=3) if (x[0] ^ x[1], x[1] ^ x[2]) == (s1, s2)}
        p = {r["bit"]: r["p1"] for r in codes.decode_bp(pcm, s, 0.1, 10).collect()}
        assert p == pytest.approx({b: sum(v for x, v in w.items() if x[b - 1]) / sum(w.values()) for b in (1, 2, 3)})


def test_matching_restores_the_syndrome(spark):
    truth = S.errors(spark, 40, 50, 0.1)
    s = codes.syndrome(S.toric(spark, 5), truth)
    found = codes.match_syndrome(s, 5).withColumnRenamed("sample_id", "set_id")
    both = found.union(truth.where("x = 1").select("sample_id", "bit"))
    assert codes.check_decoding(both, truth.select(F.col("sample_id").alias("set_id")), 5).where("NOT syndrome_zero").count() == 0
    with pytest.raises(ValueError):
        codes.match_syndrome(spark.createDataFrame([(1, 3, 1)], "sample_id long, chk int, s int"), 5)


def test_sweeps_run(spark):
    r = decoding.toric(spark, 3, 0.05, 20).first()
    assert r["samples"] == 20 and 0 <= r["failure"] <= r["logical"] <= 1
    r = decoding.toric(spark, 3, 0.02, 10, order=6, rounds=10).first()
    assert r["samples"] == 10 and r["logical"] <= 0.5
    m = decoding.maximum_likelihood(spark, 3, 0.05, 20)
    assert m.agg(F.avg("wrong")).first()[0] < 0.4


def plain_decode(rows, loops, syn, bias, rounds):
    """decode_loops for one sample, step by step."""
    checks, bits = sorted({c for c, _ in rows}), sorted({b for _, b in rows})
    support = {c: sorted(b for k, b in rows if k == c) for c in checks}
    of_bit = {b: sorted(k for k, x in rows if x == b) for b in bits}
    by_bit = {b: [x for x in loops if b in x[0]] for b in bits}
    prior = {b: np.array([1 - bias, bias]) for b in bits}
    down = {(c, b): np.array([0.5, 0.5]) for c in checks for b in support[c]}
    up = {(b, c): prior[b].copy() for b in bits for c in of_bit[b]}
    for _ in range(rounds):
        for c in checks:
            for b in support[c]:
                t = np.prod([up[x, c][0] - up[x, c][1] for x in support[c] if x != b]) * (1 - 2 * syn[c])
                down[c, b] = np.array([1 + t, 1 - t]) / 2
        for b in bits:
            for c in of_bit[b]:
                m = prior[b] * np.prod([down[k, b] for k in of_bit[b] if k != c], axis=0)
                up[b, c] = m / m.sum()
    decided: dict[int, int] = {}
    for d in bits:
        base = prior[d] * np.prod([down[c, d] for c in of_bit[d]], axis=0)
        p = base / base.sum()
        for lb, lc in by_bit[d]:
            # Around the loop each link carries what the messages leave out; fixed bits enter as decided.
            ring = list(zip(lb, lc, strict=True))
            k = lb.index(d)
            ring = ring[k:] + ring[:k]
            n = len(ring)
            chain = np.eye(2)
            for q in range(n):
                b, c = ring[q]
                nxt = ring[(q + 1) % n][0]
                rest = np.prod([up[x, c][0] - up[x, c][1] for x in support[c] if x not in (b, nxt)]) * (1 - 2 * syn[c])
                factor = np.array([[1 + rest, 1 - rest], [1 - rest, 1 + rest]]) / 2
                a, e = up[b, c], up[nxt, c]
                da, de = down[c, b], down[c, nxt]
                pa = np.eye(2) - np.outer(a, da) / (a @ da)
                pe = np.eye(2) - np.outer(de, e) / (de @ e)
                chain = chain @ (pa.T @ factor @ pe.T / max(a @ factor @ e, 1e-300))
                if q + 1 < n:
                    w = prior[nxt] * np.prod([down[x, nxt] for x in of_bit[nxt] if x not in (c, ring[(q + 1) % n][1])], axis=0)
                    if nxt in decided:
                        w = w * np.eye(2)[decided[nxt]]
                    chain = chain @ np.diag(w / max((w * down[c, nxt] * down[ring[(q + 1) % n][1], nxt]).sum(), 1e-300))
            w = prior[d] * np.prod([down[x, d] for x in of_bit[d] if x not in (ring[0][1], ring[-1][1])], axis=0)
            p = p + np.diag(chain) * w / base.sum()
        decided[d] = int(p[1] > p[0])
    return decided


def test_batches_of_samples_are_decoded_as_one_by_one(spark):
    for pcm, n, p in ((S.toric(spark, 3), 18, 0.08), (S.gallager(spark, 12, 3, 4), 12, 0.1)):
        s = codes.syndrome(pcm, S.errors(spark, 12, n, p))
        rows = sorted((r["chk"], r["bit"]) for r in pcm.distinct().collect())
        loops = [(r["bits"], r["checks"]) for r in codes.tanner_loops(pcm, 6).collect()]
        syn = {}
        for r in s.collect():
            syn.setdefault(r["sample_id"], {})[r["chk"]] = r["s"]
        got = {}
        for r in codes.decode_loops(pcm, s, p, 6, 12).collect():
            got.setdefault(r["sample_id"], {})[r["bit"]] = r["x"]
        assert got == {k: plain_decode(rows, loops, x, p, 12) for k, x in syn.items()}
