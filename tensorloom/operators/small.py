"""Networks that fit one task: belief propagation and loops in complex arithmetic, one group for each parameter point.

tensors (g, v, idx, re, im) and slots (v, slot, nbr); two vertices share at most one link. All rounds of a point run
inside its group, so a scan over many small networks is one job without a shuffle between rounds. Overlaps are bilinear,
without conjugation; messages have norm 1 and a positive largest entry, which fixes their phase.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _unit(x: np.ndarray) -> np.ndarray:
    top = x[np.argmax(np.abs(x))]
    x = x / top if top else x
    return x / max(np.linalg.norm(x), 1e-300)


class Network:
    """Dense tensors with their neighbours in slot order, and the messages on the links."""

    def __init__(self, pack: pd.DataFrame, noise: float = 0.0, seed: int = 1):
        self.nbrs = {int(r.v): [int(s["nbr"]) for s in sorted(r.legs, key=lambda s: s["slot"])] for r in pack.itertuples()}
        dim: dict[tuple[int, int], int] = {}
        for r in pack.itertuples():
            for k, n in enumerate(self.nbrs[int(r.v)]):
                link = (min(int(r.v), n), max(int(r.v), n))
                dim[link] = max(dim.get(link, 1), *(int(e["idx"][k]) for e in r.entries))
        self.tensor = {}
        for r in pack.itertuples():
            v = int(r.v)
            t = np.zeros([dim[min(v, n), max(v, n)] for n in self.nbrs[v]], complex)
            for e in r.entries:
                t[tuple(int(i) - 1 for i in e["idx"])] += complex(e["re"], e["im"])
            self.tensor[v] = t
        rng = np.random.default_rng(seed)
        links = sorted((n, v) for v, ns in self.nbrs.items() for n in ns)
        self.m = {(n, v): _unit(1 + noise * rng.standard_normal(dim[min(v, n), max(v, n)]) + 0j) for n, v in links}

    def absorb(self, v: int, without: set[int] = frozenset()) -> np.ndarray:
        """v's tensor with the incoming messages of all neighbours but some."""
        t = self.tensor[v]
        for k in range(len(self.nbrs[v]) - 1, -1, -1):
            if self.nbrs[v][k] not in without:
                t = np.tensordot(t, self.m[self.nbrs[v][k], v], axes=([k], [0]))
        return t

    def run(self, keep: float, tolerance: float, rounds: int) -> float:
        """Rounds of all messages at once until none changes by more than the tolerance; the last change."""
        change = np.inf
        for _ in range(rounds):
            new = {(v, n): _unit(self.absorb(v, {n})) for v, ns in self.nbrs.items() for n in ns}
            new = {k: _unit((1 - keep) * x + keep * self.m[k]) for k, x in new.items()}
            change = max((float(np.abs(new[k] - self.m[k]).max()) for k in new), default=0.0)
            self.m = new
            if change <= tolerance:
                break
        return change

    def gauge(self) -> None:
        """Scale messages to overlap 1 on each link, tensors to 1 on their messages; the logarithm of the vacuum stays in `vacuum`."""
        for (a, b), x in list(self.m.items()):
            if a < b:
                root = np.sqrt(x @ self.m[b, a] + 0j)
                self.m[a, b], self.m[b, a] = x / root, self.m[b, a] / root
        self.vacuum = 0j
        for v in self.tensor:
            z = complex(self.absorb(v))
            self.tensor[v] = self.tensor[v] / z
            self.vacuum += np.log(z)

    def loop(self, edges: list[tuple[int, int]]) -> complex:
        """The loop's links excited, everything else on its messages, relative to the vacuum."""
        on = {(min(e), max(e)) for e in edges}
        names: dict[tuple[int, int], int] = {}
        operands: list = []
        for v in sorted({x for e in on for x in e}):
            inside = [n for n in self.nbrs[v] if (min(v, n), max(v, n)) in on]
            operands += [self.absorb(v, set(inside)), [names.setdefault((v, n), len(names)) for n in inside]]
        for u, w in on:
            at_u, at_w = self.m[w, u], self.m[u, w]
            operands += [np.eye(len(at_u)) - np.outer(at_u, at_w), [names[u, w], names[w, u]]]
        return complex(np.einsum(*operands, [], optimize="greedy"))


def solve(tensors: DataFrame, slots: DataFrame, loops: DataFrame | None = None, keep: float = 0.0, tolerance: float = 1e-12, rounds: int = 1000, noise: float = 0.0, seed: int = 1) -> DataFrame:
    """(g, loop_id, re, im, change): for loop_id null the logarithm of the vacuum, else each loop's contribution relative to it.

    loops are (loop_id, edges); one with a link that the network lacks has no row. Messages start uniform, with noise times
    a normal deviate, the same at each point. change is what messages still moved.
    """
    spark = tensors.sparkSession
    full = tensors if "im" in tensors.columns else tensors.withColumn("im", F.lit(0.0))
    legs = slots.groupBy("v").agg(F.collect_list(F.struct("slot", "nbr")).alias("legs"))
    pack = full.groupBy("g", "v").agg(F.collect_list(F.struct("idx", "re", "im")).alias("entries")).join(legs, "v")
    none = spark.createDataFrame([], "loop_id long, edges array<struct<u:int,w:int>>")
    each = tensors.select(F.col("g").alias("point")).distinct().join((none if loops is None else loops).select("loop_id", "edges"))

    def run(key: tuple, pack: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        net = Network(pack, noise, seed)
        change = net.run(keep, tolerance, rounds)
        net.gauge()
        out = [(key[0], None, net.vacuum.real, float(np.angle(np.exp(1j * net.vacuum.imag))), change)]
        for r in asked.itertuples():
            edges = [(int(e["u"]), int(e["w"])) for e in r.edges]
            if all(w in net.nbrs.get(u, ()) for u, w in edges):
                z = net.loop(edges)
                out.append((key[0], int(r.loop_id), z.real, z.imag, change))
        g, ids, re, im, moved = zip(*out, strict=True)
        # Ids are 64-bit numbers and one is missing: never through floats.
        return pd.DataFrame({"g": g, "loop_id": pd.array(ids, dtype="Int64"), "re": re, "im": im, "change": moved})

    return pack.groupBy("g").cogroup(each.groupBy("point")).applyInPandas(run, "g double, loop_id long, re double, im double, change double")


def by_order(solved: DataFrame, loops: DataFrame) -> DataFrame:
    """(g, weight, re, im): logarithm of Z in the vacuum (weight 0), and of Z times 1 + the sum of the loops of each weight alone."""
    z = solved.where("loop_id IS NOT NULL").join(loops.select("loop_id", "weight"), "loop_id").groupBy("g", "weight").agg(F.sum("re").alias("a"), F.sum("im").alias("b"))
    v = solved.where("loop_id IS NULL").select("g", F.col("re").alias("x"), F.col("im").alias("y"))
    rows = z.union(v.select("g", F.lit(0).cast(z.schema["weight"].dataType), F.lit(0.0), F.lit(0.0)))
    a, b = 1 + F.col("a"), F.col("b")
    return rows.join(v, "g").select("g", "weight", (F.col("x") + 0.5 * F.log(a * a + b * b)).alias("re"), (F.col("y") + F.atan2(b, a)).alias("im"))


def naive_correction(solved: DataFrame, sites: int) -> DataFrame:
    """(g, re, im): log(1 + the sum of all loops) over the sites, which counts no two loops together."""
    z = solved.groupBy("g").agg((1 + F.coalesce(F.sum(F.when(F.col("loop_id").isNotNull(), F.col("re"))), F.lit(0.0))).alias("a"), F.coalesce(F.sum(F.when(F.col("loop_id").isNotNull(), F.col("im"))), F.lit(0.0)).alias("b"))
    return z.select("g", (0.5 * F.log(F.col("a") * F.col("a") + F.col("b") * F.col("b")) / sites).alias("re"), (F.atan2("b", "a") / sites).alias("im"))
