"""Tensor networks as relations: tensors (g, v, idx, re), one row for each entry, and slots (v, slot, nbr).

g names a parameter point, so that one table holds a whole scan; idx counts from 1; slot s of vertex v is the leg to
the vertex nbr. Slots are shared by all parameter points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coords as C
from ..functions.physics import spin
from .codes import shuffled
from .lattices import sites

CYCLIC = ((-1, 0), (0, 1), (1, 0), (0, -1))


def index_rows(spark: SparkSession, legs: int, dim: int) -> DataFrame:
    """(idx): every index tuple of so many legs."""
    digit = lambda k: (F.floor(F.col("id") / dim**k) % dim + 1).cast("int")
    return spark.range(dim**legs).select(F.array(*[digit(k) for k in range(legs)]).alias("idx"))


def square_slots(spark: SparkSession, L: int, order: str = "cyclic") -> DataFrame:
    """(v, slot, nbr) on the torus, L >= 3: legs up, right, down, left, or by ascending neighbour if order is "sorted"."""
    if L < 3:
        raise ValueError("a torus of L < 3 has parallel edges")
    nbrs = F.array(*[C.translate(F.col("v"), di, dj, L) for di, dj in CYCLIC])
    return sites(spark, L).select("v", F.posexplode(F.array_sort(nbrs) if order == "sorted" else nbrs).alias("slot", "nbr"))


def ising_entry(idx: Column, beta: Column, h: float = 0.0) -> Column:
    """exp(-beta (s1 s2 + s2 s3 + s3 s4 + s4 s1 + h (s1 + s2 + s3 + s4) / 2)) with spins on the bonds.

    The sign of the couplings makes neighbours differ; on even lattices this equals the ferromagnet at h = 0.
    """
    s = [spin(idx[k]) for k in range(4)]
    ring = s[0] * s[1] + s[1] * s[2] + s[2] * s[3] + s[3] * s[0]
    return F.exp(-beta * (ring + h * (s[0] + s[1] + s[2] + s[3]) / 2))


def ising(spark: SparkSession, L: int, betas: list[float] | DataFrame, h: float = 0.0, order: str = "cyclic") -> tuple[DataFrame, DataFrame]:
    """(tensors, slots) of the torus at each beta; g is beta, unless betas are a table (g, beta)."""
    grid = betas if isinstance(betas, DataFrame) else F.broadcast(spark.createDataFrame([(float(b), float(b)) for b in betas], "g double, beta double"))
    entries = grid.join(index_rows(spark, 4, 2)).select("g", "idx", ising_entry(F.col("idx"), F.col("beta"), h).alias("re"))
    return sites(spark, L).select("v").join(entries if isinstance(betas, DataFrame) else F.broadcast(entries)).select("g", "v", "idx", "re"), square_slots(spark, L, order)


def ising_open(spark: SparkSession, rows: int, cols: int, beta: float | DataFrame, h: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(tensors, slots) of an open sheet: spins on bonds, pairs up-left, up-right, down-left, down-right, where both exist.

    beta is one coupling, which is g, too, or a table (g, v, beta) of each site's at each parameter point.
    """
    v = spark.range(rows * cols).select((F.col("id") + 1).cast("int").alias("v"), (F.floor(F.col("id") / cols) + 1).cast("int").alias("i"), (F.col("id") % cols + 1).cast("int").alias("j"))
    legs = {"u": (F.col("i") > 1, -cols), "d": (F.col("i") < rows, cols), "l": (F.col("j") > 1, -1), "r": (F.col("j") < cols, 1)}
    nbrs = F.array_compact(F.array(*[F.when(ok, F.struct(F.lit(n).alias("leg"), (F.col("v") + d).cast("int").alias("nbr"))) for n, (ok, d) in legs.items()]))
    at = v.select("v", nbrs.alias("legs"))
    slots = at.select("v", F.posexplode("legs").alias("slot", "x")).select("v", "slot", "x.nbr")
    full = at.join(index_rows(spark, 4, 2)).where(F.forall(F.sequence(F.lit(0), F.lit(3)), lambda k: (k < F.size("legs")) | (F.get("idx", k) == 1)))

    def on(name: str) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.size("legs") - 1), F.lit(0), lambda a, k: a + F.when(F.get("legs", k)["leg"] == name, spin(F.get("idx", k))).otherwise(0))

    s = {n: on(n) for n in legs}
    energy = -(s["u"] * s["l"] + s["u"] * s["r"] + s["d"] * s["l"] + s["d"] * s["r"]) - h * (s["u"] + s["d"] + s["l"] + s["r"])
    if not isinstance(beta, DataFrame):
        beta = full.select("v").distinct().select(F.lit(float(beta)).alias("g"), "v", F.lit(float(beta)).alias("beta"))
    return full.join(beta, "v").select("g", "v", F.slice("idx", 1, F.size("legs")).alias("idx"), F.exp(-F.col("beta") * energy).alias("re")), slots


def aklt_tensor(spark: SparkSession, a1: float = math.sqrt(1.5), a2: float = math.sqrt(6.0)) -> DataFrame:
    """(phys, l, b, r, t, re): four spins 1/2 projected on spin 2, singlets on l and b, and weights a1, a2 of Sz = 1, 2 scaled so that the defaults leave the tensor as it is."""
    point = spark.range(1).select(F.lit(0.0).alias("g"), F.lit(float(a1)).alias("a1"), F.lit(float(a2)).alias("a2"))
    return aklt_tensors(spark, F.broadcast(point)).drop("g")


def aklt_tensors(spark: SparkSession, points: DataFrame) -> DataFrame:
    """(g, phys, l, b, r, t, re): the tensor at each parameter point (g, a1, a2)."""
    idx = index_rows(spark, 4, 2).select(*[F.col("idx")[k].alias(n) for k, n in enumerate("lbrt")])
    flip, sign = lambda k: 3 - k, lambda k: F.when(k == 1, 1.0).otherwise(-1.0)  # noqa: E731  the singlet matrix [[0, 1], [-1, 0]]
    downs = (flip(F.col("l")) - 1) + (flip(F.col("b")) - 1) + (F.col("r") - 1) + (F.col("t") - 1)
    ways = F.when(downs.isin(0, 4), 1.0).when(downs.isin(1, 3), 4.0).otherwise(6.0)
    weight = F.when(downs.isin(0, 4), F.col("a2") / math.sqrt(6.0)).when(downs.isin(1, 3), F.col("a1") / math.sqrt(1.5)).otherwise(1.0)
    # The dummy leg of a singlet is its other index; rows of the singlet matrix belong to the outer leg.
    return points.join(idx).select("g", (5 - downs).cast("int").alias("phys"), "l", "b", "r", "t", (sign(F.col("l")) * sign(F.col("b")) * weight / F.sqrt(ways)).alias("re"))


def aklt_double(spark: SparkSession, a1: float = math.sqrt(1.5), a2: float = math.sqrt(6.0), sz: bool = False) -> DataFrame:
    """(idx, re): ket and bra contracted over the spin, legs l, b, r, t of dimension 4 = (ket, bra); with sz weighted by the magnetisation, on entries whose ket and bra agree on l and b."""
    return aklt_doubles(aklt_tensor(spark, a1, a2).withColumn("g", F.lit(0.0)), sz).drop("g")


def aklt_doubles(tensors: DataFrame, sz: bool = False) -> DataFrame:
    """(g, idx, re): aklt_double() of the tensors (g, phys, l, b, r, t, re) of each parameter point."""
    ket, bra = (tensors.alias(n) for n in ("k", "q"))
    both = ket.join(bra, (F.col("k.g") == F.col("q.g")) & (F.col("k.phys") == F.col("q.phys")))
    leg = lambda n: (2 * (F.col(f"k.{n}") - 1) + F.col(f"q.{n}")).cast("int")
    weight = (F.col("k.phys") - 3).cast("double") if sz else F.lit(1.0)
    if sz:
        both = both.where((F.col("k.l") == F.col("q.l")) & (F.col("k.b") == F.col("q.b")))
    return both.groupBy(F.col("k.g").alias("g"), F.array(*map(leg, "lbrt")).alias("idx")).agg(F.sum(weight * F.col("k.re") * F.col("q.re")).alias("re"))


def aklt(spark: SparkSession, L: int, a1: float = math.sqrt(1.5), a2: float = math.sqrt(6.0), sz_site: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(tensors, slots) of the norm on a torus, or of Sz at one site; legs l, b, r, t lead up, left, down, right."""
    moves = ((-1, 0), (0, -1), (1, 0), (0, 1))
    slots = sites(spark, L).select("v", F.posexplode(F.array(*[C.translate(F.col("v"), di, dj, L) for di, dj in moves])).alias("slot", "nbr"))
    rows = sites(spark, L).select("v").join(F.broadcast(aklt_double(spark, a1, a2)))
    if sz_site is not None:
        rows = rows.where(F.col("v") != sz_site).union(aklt_double(spark, a1, a2, True).select(F.lit(sz_site).alias("v"), "idx", "re"))
    return rows.select(F.lit(0.0).alias("g"), "v", "idx", "re"), slots


def orthogonalise(tensor: DataFrame, vector: list[float]) -> DataFrame:
    """(idx, re): the tensor without its component along the vector on any leg, of norm 1; legs share the vector's dimension."""
    n = math.sqrt(sum(x * x for x in vector))
    legs = len(tensor.first()["idx"])
    comp = F.array(*[F.lit(x / n) for x in vector])
    for k in range(legs):
        rest = F.array(*[F.lit(0) if i == k else F.col("idx")[i] for i in range(legs)])
        along = tensor.groupBy(rest.alias("rest")).agg(F.sum(F.col("re") * F.get(comp, F.col("idx")[k] - 1)).alias("a"))
        tensor = tensor.withColumn("rest", rest).join(along, "rest").select("idx", (F.col("re") - F.col("a") * F.get(comp, F.col("idx")[k] - 1)).alias("re"))
        norm = tensor.agg(F.sqrt(F.sum(F.col("re") * F.col("re"))).alias("n"))
        tensor = tensor.join(F.broadcast(norm)).select("idx", (F.col("re") / F.col("n")).alias("re"))
    return tensor


def random_tensor(spark: SparkSession, eta: float, seed: int, kind: str = "positive", orthogonal: bool = False) -> DataFrame:
    """(idx, re): a unit rank-one tensor plus eta times a unit random one on four legs of dimension 2."""
    if kind not in ("positive", "real"):
        raise ValueError("kind must be 'positive' or 'real'")
    import random

    rng = random.Random(seed)
    v = [rng.gauss(0, 1) for _ in range(2)]
    v = [abs(x) if kind == "positive" else x for x in v]
    size = math.sqrt(sum(x * x for x in v))
    v = [x / size for x in v]
    noise = index_rows(spark, 4, 2).coalesce(1).select("idx", F.randn(seed).alias("re"))
    if orthogonal:
        noise = orthogonalise(noise, v)
    if kind == "positive":
        noise = noise.select("idx", F.abs("re").alias("re"))
    norm = noise.agg(F.sqrt(F.sum(F.col("re") * F.col("re"))).alias("n"))
    comp = F.array(*map(F.lit, v))
    one = F.aggregate("idx", F.lit(1.0), lambda a, k: a * F.get(comp, k - 1))
    return noise.join(F.broadcast(norm)).select("idx", (one + eta * F.col("re") / F.col("n")).alias("re"))


def random_peps(spark: SparkSession, rows: int, cols: int, eta: float, seed: int, kind: str = "positive", orthogonal: bool = False, uniform: bool = True) -> tuple[DataFrame, DataFrame]:
    """(tensors, slots) of an open sheet of random tensors; legs over the edge are closed with (1, 1) / sqrt 2."""
    v = spark.range(rows * cols).select((F.col("id") + 1).cast("int").alias("v"), (F.floor(F.col("id") / cols) + 1).cast("int").alias("i"), (F.col("id") % cols + 1).cast("int").alias("j"))
    nbrs = F.array(F.when(F.col("i") > 1, F.col("v") - cols), F.when(F.col("i") < rows, F.col("v") + cols), F.when(F.col("j") > 1, F.col("v") - 1), F.when(F.col("j") < cols, F.col("v") + 1))
    at = v.select("v", nbrs.alias("nbrs"))
    if uniform:
        full = at.join(F.broadcast(random_tensor(spark, eta, seed, kind, orthogonal)))
    else:
        full = None
        for k in range(rows * cols):
            part = at.where(F.col("v") == k + 1).join(random_tensor(spark, eta, seed + k, kind, orthogonal))
            full = part if full is None else full.union(part)
    open_ = F.filter(F.sequence(F.lit(0), F.lit(3)), lambda k: F.get("nbrs", k).isNotNull())
    closed = full.groupBy("v", F.transform(open_, lambda k: F.get("idx", k)).alias("idx"), F.size(open_).alias("n")).agg(F.sum("re").alias("re"))
    tensors = closed.select(F.lit(float(eta)).alias("g"), "v", "idx", (F.col("re") * F.pow(F.lit(2.0), -(4 - F.col("n")) / 2)).alias("re"))
    slots = at.select("v", F.posexplode(F.transform(open_, lambda k: F.get("nbrs", k).cast("int"))).alias("slot", "nbr"))
    return tensors, slots


def complex_peps(spark: SparkSession, rows: int, cols: int, etas: list[float], seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(tensors (g, v, idx, re, im), slots) of an open sheet: a rank-one complex tensor plus eta times noise, g is eta.

    The noise is uniform in both parts and alike in every engine; a vertex at the edge has fewer legs.
    """
    v = spark.range(rows * cols).select((F.col("id") + 1).cast("int").alias("v"), (F.floor(F.col("id") / cols) + 1).cast("int").alias("i"), (F.col("id") % cols + 1).cast("int").alias("j"))
    nbrs = F.array_compact(F.array(F.when(F.col("i") > 1, F.col("v") - cols), F.when(F.col("i") < rows, F.col("v") + cols), F.when(F.col("j") > 1, F.col("v") - 1), F.when(F.col("j") < cols, F.col("v") + 1)))
    at = v.select("v", nbrs.alias("nbrs"))
    n = F.size("nbrs")
    each = at.select("v", n.alias("n"), F.explode(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), n) - 1)).alias("k"))
    bit = lambda leg: F.call_function("shiftright", F.col("k"), leg).bitwiseAND(F.lit(1))
    # A unit vector with components 0.8 and 0.48 + 0.36 i.
    times = lambda a, leg: F.when(bit(leg) == 0, F.struct((0.8 * a["re"]).alias("re"), (0.8 * a["im"]).alias("im"))).otherwise(F.struct((0.48 * a["re"] - 0.36 * a["im"]).alias("re"), (0.36 * a["re"] + 0.48 * a["im"]).alias("im")))
    legs = F.sequence(F.lit(0), F.col("n") - 1)
    one = F.aggregate(legs, F.struct(F.lit(1.0).alias("re"), F.lit(0.0).alias("im")), times)
    noise = lambda s: shuffled(s, F.col("v"), F.col("k")) / 999983 - 0.5
    full = each.select("v", F.transform(legs, lambda leg: (bit(leg) + 1).cast("int")).alias("idx"), one.alias("one"), noise(seed).alias("x"), noise(seed + 1).alias("y"))
    points = spark.createDataFrame([(float(e),) for e in etas], "g double")
    tensors = full.join(F.broadcast(points)).select("g", "v", "idx", (F.col("one.re") + F.col("g") * F.col("x")).alias("re"), (F.col("one.im") + F.col("g") * F.col("y")).alias("im"))
    return tensors, at.select("v", F.posexplode("nbrs").alias("slot", "nbr"))


def _pauli_rotation(step: float) -> list[list[float]]:
    """How exp(-i step ZZ) turns pairs of Paulis I, X, Y, Z: entry [out][in], pairs numbered 4 * first + second."""
    import numpy as np

    paulis = [np.eye(2), np.array([[0, 1], [1, 0]]), np.array([[0, -1j], [1j, 0]]), np.diag([1, -1])]
    pairs = [np.kron(a, b) for a in paulis for b in paulis]
    u = np.diag(np.exp(-1j * step * np.diag(pairs[15])))
    return [[float((np.trace(a @ u @ b @ u.conj().T) / 4).real) for b in pairs] for a in pairs]


def operator_dynamics(spark: SparkSession, sites: int, steps: int, initial: list[int], final: list[int], p: float = 0.0, step: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(tensors, slots) of the overlap of two Pauli strings (0 to 3 for I, X, Y, Z on each site) after a brick-wall circuit.

    Layers t = 1, 2, ... by t mod 4: 1 and 3 depolarise each site with probability p, 2 turns pairs from the second site
    on, 0 pairs from the first. The number of sites is even. Legs have dimension 4; vertices are numbered in time order.
    """
    if sites % 2:
        raise ValueError("the number of sites must be even")
    turn = _pauli_rotation(step)
    entries: list[tuple[int, list[int], float]] = []
    legs: dict[int, list[int | None]] = {}
    tip: list[tuple[int, int]] = []

    def vertex(values: list[tuple[list[int], float]], inputs: list[int], outputs: int) -> int:
        v = len(legs) + 1
        legs[v] = [tip[x][0] for x in inputs] + [None] * outputs
        for k, x in enumerate(inputs):
            owner, slot = tip[x]
            legs[owner][slot] = v
            tip[x] = (v, len(inputs) + k)
        entries.extend((v, idx, re) for idx, re in values if re)
        return v

    for x in range(sites):
        tip.append((vertex([([initial[x] + 1], 1.0)], [], 1), 0))
    pair = [([i + 1, j + 1, k + 1, m + 1], turn[4 * k + m][4 * i + j]) for i in range(4) for j in range(4) for k in range(4) for m in range(4)]
    noise = [([k + 1, k + 1], 1.0 if k == 0 else 1 - 4 * p / 3) for k in range(4)]
    for t in range(1, steps + 1):
        if t % 2:
            for x in range(sites):
                vertex(noise, [x], 1)
        else:
            for x in range(0 if t % 4 == 0 else 1, sites - 1, 2):
                vertex(pair, [x, x + 1], 2)
    for x in range(sites):
        vertex([([final[x] + 1], 1.0)], [x], 0)
    slots = [(v, k, n) for v, ns in legs.items() for k, n in enumerate(ns)]
    tensors = spark.createDataFrame(entries, "v int, idx array<int>, re double").select(F.lit(0.0).alias("g"), "v", "idx", "re")
    return tensors, spark.createDataFrame(slots, "v int, slot int, nbr int")
