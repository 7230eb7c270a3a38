"""Syndromes, Tanner graphs, homology and decoders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions import coords as C
from ..session import table
from ..sources import codes as S
from . import bp
from .overlap import overlaps


def syndrome(pcm: DataFrame, bits: DataFrame) -> DataFrame:
    """(sample_id, chk, s): parity of the bits under each check."""
    return bits.join(pcm, "bit").groupBy("sample_id", "chk").agg(F.bit_xor(F.col("x").cast("int")).alias("s"))


def symmetric_difference(sets: DataFrame) -> DataFrame:
    """(set_id, e): elements that occur an odd number of times."""
    return sets.groupBy("set_id", "e").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").select("set_id", "e")


def as_bits(sets: DataFrame, n: int) -> DataFrame:
    """(set_id, bit, x): each set as n bits, repeated elements toggle."""
    spark = sets.sparkSession
    ids = sets.select("set_id").distinct()
    full = ids.join(spark.range(n).select((F.col("id") + 1).cast("int").alias("bit")))
    odd = symmetric_difference(sets).select("set_id", F.col("e").alias("bit"), F.lit(1).alias("x"))
    return full.join(odd, ["set_id", "bit"], "left").select("set_id", "bit", F.coalesce("x", F.lit(0)).alias("x"))


def parity_on(sets: DataFrame, support: DataFrame) -> DataFrame:
    """(set_id, parity) of the elements within the support (e)."""
    inside = sets.join(F.broadcast(support.select("e").distinct().withColumn("_in", F.lit(1))), "e", "left")
    return inside.groupBy("set_id").agg((F.coalesce(F.sum("_in"), F.lit(0)) % 2).cast("int").alias("parity"))


def check_decoding(sets: DataFrame, ids: DataFrame, L: int) -> DataFrame:
    """(set_id, syndrome_zero, homology_trivial) for each of the ids (set_id), of which sets (set_id, e) may hold nothing.

    A cycle is a sum of plaquettes exactly if it crosses both a row of first-group edges and a column of second-group
    edges an even number of times; a set with a syndrome is not.
    """
    spark = sets.sparkSession
    odd = symmetric_difference(sets)
    s = odd.select("set_id", F.col("e").alias("bit")).join(S.toric(spark, L), "bit").groupBy("set_id", "chk").agg((F.count(F.lit(1)) % 2).alias("s")).groupBy("set_id").agg(F.max("s").alias("any"))
    k = (F.col("id") + 1).cast("int")
    across = spark.range(L).select(S.h_edge(F.lit(1), k, L).alias("e"), F.lit(1).alias("h")).union(spark.range(L).select(S.v_edge(k, F.lit(1), L), F.lit(0)))
    p = odd.join(F.broadcast(across), "e").groupBy("set_id").agg((F.sum("h") % 2).alias("ph"), (F.sum(1 - F.col("h")) % 2).alias("pv"))
    zero = F.coalesce("any", F.lit(0)) == 0
    trivial = zero & (F.coalesce("ph", F.lit(0)) == 0) & (F.coalesce("pv", F.lit(0)) == 0)
    return ids.select("set_id").distinct().join(s, "set_id", "left").join(p, "set_id", "left").select("set_id", zero.alias("syndrome_zero"), trivial.alias("homology_trivial"))


def _eliminate(rows: list[int]) -> list[int]:
    basis: list[int] = []
    for r in rows:
        for q in basis:
            r = min(r, r ^ q)
        if r:
            basis = sorted([min(q, q ^ r) for q in basis] + [r], reverse=True)
    return basis


def solvable(columns: DataFrame, targets: DataFrame) -> DataFrame:
    """(set_id, solvable): whether each target (set_id, e) is a sum mod 2 of columns (p, e), by elimination on bit masks.

    The columns are one small matrix, broadcast; targets are tested one by one.
    """
    masks: dict[int, int] = {}
    for r in columns.collect():
        masks[r[0]] = masks.get(r[0], 0) ^ (1 << r[1])
    basis = _eliminate(list(masks.values()))

    def run(it):
        for pdf in it:
            out = []
            for es in pdf["es"]:
                x = 0
                for e in es:
                    x ^= 1 << int(e)
                for q in basis:
                    x = min(x, x ^ q)
                out.append(x == 0)
            yield pd.DataFrame({"set_id": pdf["set_id"], "solvable": out})

    kind = targets.schema["set_id"].dataType.simpleString()
    return targets.groupBy("set_id").agg(F.collect_list("e").alias("es")).mapInPandas(run, f"set_id {kind}, solvable boolean")


def row_reduce(matrix: DataFrame) -> DataFrame:
    """(row, bit): reduced row echelon form mod 2 of (chk, bit) without zero rows; one small matrix."""
    masks: dict[int, int] = {}
    top = 0
    for c, b in matrix.select("chk", "bit").collect():
        masks[c] = masks.get(c, 0) ^ (1 << b)
        top = max(top, b)
    flip = lambda m: int(format(m, f"0{top + 1}b")[::-1], 2)
    basis = [flip(r) for r in _eliminate([flip(m) for m in masks.values()])]
    return matrix.sparkSession.createDataFrame([(k + 1, b) for k, r in enumerate(basis) for b in range(top + 1) if r >> b & 1], "row int, bit int")


def tanner_neighbours(pcm: DataFrame) -> DataFrame:
    """(bit, checks, bits): the checks of each bit and the other bits that they reach."""
    a, b = pcm.select("bit", "chk"), pcm.select(F.col("bit").alias("other"), "chk")
    checks = pcm.groupBy("bit").agg(F.array_sort(F.collect_set("chk")).alias("checks"))
    two = a.join(b, "chk").where("bit <> other").groupBy("bit").agg(F.array_sort(F.collect_set("other")).alias("bits"))
    return checks.join(two, "bit", "left").select("bit", "checks", F.coalesce("bits", F.array().cast(two.schema["bits"].dataType)).alias("bits"))


def four_cycles(pcm: DataFrame) -> DataFrame:
    """(chk_a, chk_b, shared, cycles): pairs of checks with two bits or more in common, and the four-cycles they close.

    Checks meet by pairs of bits, or by bitmaps where they have many (overlap.overlaps); cycles are pairs of shared bits.
    """
    n = overlaps(pcm.select(F.col("chk").alias("set_id"), F.col("bit").alias("e")))
    return n.select(F.col("a").alias("chk_a"), F.col("b").alias("chk_b"), "shared", F.expr("shared * (shared - 1) div 2").alias("cycles"))


def tanner_loops(pcm: DataFrame, length: int, through: str | None = None, at: int | None = None) -> DataFrame:
    """(bits, checks, length): simple cycles of the Tanner graph of at most so many edges, each once, or those through one bit or check.

    Paths alternate bits and checks from their smallest bit and close on it; the check after the start is smaller than
    the one before the end, so that one of both directions stays.
    """
    p = table(pcm.distinct())
    now = p.select(F.array("bit").alias("bits"), F.array("chk").alias("checks"))
    found = None
    for n in range(2, length // 2 + 1):
        to = now.select("bits", "checks", F.element_at("checks", -1).alias("chk")).join(p.withColumnRenamed("bit", "to"), "chk")
        to = to.where((F.col("to") > F.col("bits")[0]) & ~F.array_contains("bits", F.col("to"))).select(F.array_append("bits", F.col("to")).alias("bits"), "checks")
        on = to.select("bits", "checks", F.element_at("bits", -1).alias("bit")).join(p.withColumnRenamed("chk", "next"), "bit").where(~F.array_contains("checks", F.col("next")))
        now = table(on.select("bits", F.array_append("checks", F.col("next")).alias("checks")))
        ends = now.select("bits", "checks", F.element_at("checks", -1).alias("chk")).join(p.withColumnRenamed("bit", "home"), "chk").where((F.col("home") == F.col("bits")[0]) & (F.col("checks")[0] < F.element_at("checks", -1)))
        here = ends.select("bits", "checks", F.lit(2 * n).alias("length"))
        found = here if found is None else found.union(here)
    if at is not None:
        found = found.where(F.array_contains("bits" if through != "check" else "checks", at))
    return found


def loops_of_sets(loops: DataFrame) -> DataFrame:
    """One loop for each set of bits and checks."""
    return loops.select(F.array_sort("bits").alias("bits"), F.array_sort("checks").alias("checks"), "length").distinct()


def through_both(loops: DataFrame, a: int, b: int) -> DataFrame:
    """The loops that hold both bits, one for each set of bits and checks."""
    return loops_of_sets(loops.where(F.array_contains("bits", a) & F.array_contains("bits", b)))


def parity_tensor(spark: SparkSession, legs: int, parity: int) -> DataFrame:
    """(idx, re): 1 where the bits of the legs (index 1 for 0, 2 for 1) have the parity; other entries are left out."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(legs - 1)), lambda k: F.call_function("shiftright", F.col("id"), k).bitwiseAND(F.lit(1)).cast("int"))
    rows = spark.range(1 << legs).where(F.bit_count("id") % 2 == parity)
    return rows.select(F.transform(bits, lambda x: x + 1).alias("idx"), F.lit(1.0).alias("re"))


def one_hot(x: Column) -> Column:
    """A known bit as [1, 0] or [0, 1], an unknown (null) one as [1/2, 1/2]."""
    return F.when(x == 0, F.array(F.lit(1.0), F.lit(0.0))).when(x == 1, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(0.5), F.lit(0.5)))


def messages(pcm: DataFrame, s: DataFrame, bias: float, rounds: int = 50, keep: float = 0.0) -> DataFrame:
    """(sample_id, chk, bit, s, down, up): log odds of a 0 from checks to bits and back, given syndromes (sample_id, chk, s).

    A check's message to a bit only depends on the product of (1 - 2p) over its other bits, so the factor graph's
    tensors need not be written out: messages are one number, and a round is two grouped products.
    """
    start = float(np.log((1 - bias) / bias))
    now = table(pcm.join(s, "chk").select("sample_id", "chk", "bit", "s")).select("*", F.lit(0.0).alias("down"), F.lit(start).alias("up"))
    of_check, of_bit = W.partitionBy("sample_id", "chk"), W.partitionBy("sample_id", "bit")
    for n in range(rounds):
        t = F.tanh(F.col("up") / 2)
        now = now.withColumns({"l": F.log(F.greatest(F.abs(t), F.lit(1e-300))), "neg": (t < 0).cast("int")})
        now = now.withColumns({"others": F.sum("l").over(of_check) - F.col("l"), "flips": F.sum("neg").over(of_check) - F.col("neg") + F.col("s")})
        size = F.least(F.exp("others"), F.lit(1 - 1e-15))
        down = (1 - keep) * (1 - 2 * (F.col("flips") % 2)) * (F.log1p(size) - F.log1p(-size)) + keep * F.col("down")
        now = now.select("sample_id", "chk", "bit", "s", down.alias("down"))
        now = now.withColumn("up", start + F.sum("down").over(of_bit) - F.col("down"))
        if n % 5 == 4:
            now = table(now)
    return now


def decode_bp(pcm: DataFrame, s: DataFrame, bias: float, rounds: int = 50, keep: float = 0.0) -> DataFrame:
    """(sample_id, bit, p1, x): bit marginals by belief propagation, and the likelier value; ties go to 0."""
    start = float(np.log((1 - bias) / bias))
    out = messages(pcm, s, bias, rounds, keep).groupBy("sample_id", "bit").agg((start + F.sum("down")).alias("l"))
    return out.select("sample_id", "bit", (1 / (1 + F.exp("l"))).alias("p1"), (F.col("l") < 0).cast("int").alias("x"))


def pair_marginals(pcm: DataFrame, s: DataFrame, bias: float, rounds: int = 50, keep: float = 0.0) -> DataFrame:
    """(sample_id, a, b, p00, p01, p10, p11): joint marginals of each two bits a < b that share two checks or more.

    The short cycles through both are summed exactly, everything else is on its messages.
    """
    start = float(np.log((1 - bias) / bias))
    m = table(messages(pcm, s, bias, rounds, keep))
    p = pcm.distinct()
    both = p.select("chk", F.col("bit").alias("a")).join(p.select("chk", F.col("bit").alias("b")), "chk").where("a < b")
    pairs = both.join(both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b"), ["a", "b"])
    total = m.groupBy("sample_id", "bit").agg((start + F.sum("down")).alias("l"))
    end = lambda c: pairs.join(m.select("sample_id", "chk", F.col("bit").alias(c), "down"), ["chk", c]).groupBy("sample_id", "a", "b").agg(F.sum("down").alias(f"d{c}"))
    odds = end("a").join(end("b"), ["sample_id", "a", "b"])
    for c in ("a", "b"):
        odds = odds.join(total.select("sample_id", F.col("bit").alias(c), F.col("l").alias(f"l{c}")), ["sample_id", c]).withColumn(f"o{c}", F.col(f"l{c}") - F.col(f"d{c}"))
    t = F.when((F.col("bit") == F.col("a")) | (F.col("bit") == F.col("b")), 1.0).otherwise(F.tanh(F.col("up") / 2))
    rest = pairs.join(m, "chk").withColumn("t", t).groupBy("sample_id", "a", "b", "chk").agg(F.exp(F.sum(F.log(F.greatest(F.abs("t"), F.lit(1e-300))))).alias("r"), F.sum((F.col("t") < 0).cast("int")).alias("neg"), F.max("s").alias("s"))
    r = F.col("r") * (1 - 2 * ((F.col("neg") + F.col("s")) % 2))
    logs = rest.groupBy("sample_id", "a", "b").agg(F.sum(F.log(F.greatest(1 + r, F.lit(1e-300)))).alias("same"), F.sum(F.log(F.greatest(1 - r, F.lit(1e-300)))).alias("differ"))
    j = odds.join(logs, ["sample_id", "a", "b"])
    w = {f"p{x}{y}": F.exp(F.col("same" if x == y else "differ") - x * F.col("oa") - y * F.col("ob")) for x in (0, 1) for y in (0, 1)}
    norm = w["p00"] + w["p01"] + w["p10"] + w["p11"]
    return j.select("sample_id", "a", "b", *[(v / norm).alias(k) for k, v in w.items()])


def argmax_decide(p: DataFrame, keys: list[str], value: str = "p", choice: str = "k") -> DataFrame:
    """(keys..., choice): of each group the choice of the largest value, the smallest of ties; one partial aggregate."""
    best = p.groupBy(*keys).agg(F.max(value).alias("_top"))
    return p.join(best, keys).where(F.col(value) == F.col("_top")).groupBy(*keys).agg(F.min(choice).alias(choice))


def decode_loops(pcm: DataFrame, s: DataFrame, bias: float, order: int, rounds: int = 50) -> DataFrame:
    """(sample_id, bit, x): bits decided one after the other, marginals corrected by the loops of the Tanner graph.

    Each bit sees the decisions before it, so that samples, not bits, run side by side: a batch of samples takes each
    step at once, as arrays whose last axis is the sample. The code and its loops, constants of the job, are broadcast.
    A check without a row in a sample has syndrome 0.
    """
    rows = sorted((r["chk"], r["bit"]) for r in pcm.select("chk", "bit").distinct().collect())
    loops = [(r["bits"], r["checks"]) for r in tanner_loops(pcm, order).collect()]
    shipped = pcm.sparkSession.sparkContext.broadcast((rows, loops))
    lists = s.groupBy("sample_id").agg(F.collect_list(F.struct("chk", "s")).alias("syn"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        links, rings = shipped.value
        for f in frames:
            if len(f):
                bits, x = _decided(links, rings, [{int(e["chk"]): int(e["s"]) for e in syn} for syn in f["syn"]], bias, rounds)
                yield pd.DataFrame({"sample_id": np.repeat(f["sample_id"].to_numpy(), len(bits)), "bit": np.tile(bits, len(f)).astype("int32"), "x": x.T.reshape(-1).astype("int32")})

    return lists.mapInPandas(run, "sample_id long, bit int, x int")


def _decided(rows: list[tuple[int, int]], loops: list[tuple[list[int], list[int]]], syndromes: list[dict[int, int]], bias: float, rounds: int) -> tuple[list[int], np.ndarray]:
    """The bits in order and their decisions, a row for each bit and a column for each sample."""
    n = len(syndromes)
    edge = {e: k for k, e in enumerate(rows)}
    checks, bits = sorted({c for c, _ in rows}), sorted({b for _, b in rows})
    of_check = {c: [e for e in rows if e[0] == c] for c in checks}
    of_bit = {b: [e for e in rows if e[1] == b] for b in bits}
    sign = {c: 1 - 2 * np.array([y.get(c, 0) for y in syndromes], float) for c in checks}
    prior = np.repeat(np.array([[1 - bias], [bias]]), n, axis=1)
    down, up = np.full((len(rows), 2, n), 0.5), np.repeat(prior[None], len(rows), axis=0)

    def bit_side(b: int, without: tuple) -> np.ndarray:
        return np.prod([prior, *(down[edge[e]] for e in of_bit[b] if e not in without)], axis=0)

    def check_side(c: int, without: tuple) -> np.ndarray:
        return np.prod([sign[c], *(up[edge[e], 0] - up[edge[e], 1] for e in of_check[c] if e not in without)], axis=0)

    for _ in range(rounds):
        for e in rows:
            t = check_side(e[0], (e,))
            down[edge[e]] = (1 + t) / 2, (1 - t) / 2
        for e in rows:
            m = bit_side(e[1], (e,))
            up[edge[e]] = m / m.sum(axis=0)
    by_bit: dict[int, list] = {}
    for lb, lc in loops:
        for b in lb:
            by_bit.setdefault(b, []).append((lb, lc))
    decided: dict[int, np.ndarray] = {}
    eye = np.eye(2)[:, :, None]
    for d in bits:
        base = bit_side(d, ())
        p = base / base.sum(axis=0)
        for lb, lc in by_bit.get(d, ()):
            # Around the loop each link carries what the messages leave out; fixed bits enter as decided.
            k = lb.index(d)
            ring = [*zip(lb, lc, strict=True)][k:] + [*zip(lb, lc, strict=True)][:k]
            chain = np.repeat(eye, n, axis=2)
            for q, (b, c) in enumerate(ring):
                nxt, after = ring[(q + 1) % len(ring)]
                rest = check_side(c, ((c, b), (c, nxt)))
                factor = np.array([[1 + rest, 1 - rest], [1 - rest, 1 + rest]]) / 2
                a, z = up[edge[c, b]], up[edge[c, nxt]]
                da, dz = down[edge[c, b]], down[edge[c, nxt]]
                pa = eye - da[:, None] * a[None] / (a * da).sum(axis=0)
                pz = eye - z[:, None] * dz[None] / (z * dz).sum(axis=0)
                whole = np.maximum(np.einsum("is,ijs,js->s", a, factor, z), 1e-300)
                chain = np.einsum("ijs,jks,kls,lms->ims", chain, pa, factor, pz, optimize=True) / whole
                if q + 1 < len(ring):
                    w = bit_side(nxt, ((c, nxt), (after, nxt)))
                    if nxt in decided:
                        w = w * np.eye(2)[decided[nxt]].T
                    chain = chain * (w / np.maximum((w * dz * down[edge[after, nxt]]).sum(axis=0), 1e-300))[None]
            w = bit_side(d, ((ring[0][1], d), (ring[-1][1], d)))
            p = p + np.einsum("iis->is", chain) * w / base.sum(axis=0)
        decided[d] = (p[1] > p[0]).astype(int)
    return bits, np.array([decided[b] for b in bits])


def match_syndrome(s: DataFrame, L: int) -> DataFrame:
    """(sample_id, e): edges, with repetitions, that join consecutive excitations: first along rows, then along columns.

    An odd number of excitations raises ValueError.
    """
    hot = s.where("s = 1")
    if hot.groupBy("sample_id").count().where("count % 2 = 1").limit(1).count():
        raise ValueError("a sample has an odd number of excitations")
    rank = F.row_number().over(W.partitionBy("sample_id").orderBy("chk")) - 1
    at = hot.select("sample_id", rank.alias("r"), C.row_of(F.col("chk"), L).alias("i"), C.col_of(F.col("chk"), L).alias("j"))
    pair = at.groupBy("sample_id", F.floor(F.col("r") / 2).alias("pair")).agg(F.min(F.struct("r", "i", "j")).alias("a"), F.max(F.struct("r", "i", "j")).alias("b"))
    span = lambda x, y: F.when(x == y, F.array().cast("array<int>")).otherwise(F.sequence(F.least(x, y), F.greatest(x, y) - 1))
    h = F.transform(span(F.col("a.i"), F.col("b.i")), lambda i: S.h_edge(i, F.col("a.j"), L))
    v = F.transform(span(F.col("a.j"), F.col("b.j")), lambda j: S.v_edge(F.col("b.i"), j, L))
    return pair.select("sample_id", F.explode(F.concat(h, v)).alias("e"))


def logical_classes(matched: DataFrame, ids: DataFrame, L: int) -> DataFrame:
    """(sample_id, class, e): the chain without its logical part (class 0) and with each product of logical operators (1, 2, 3)."""
    spark = matched.sparkSession
    logical = S.logicals(spark, L).withColumnRenamed("bit", "e")
    odd = symmetric_difference(matched.withColumnRenamed("sample_id", "set_id")).withColumnRenamed("set_id", "sample_id")
    has = odd.join(F.broadcast(logical), "e").groupBy("sample_id", "op").agg((F.count(F.lit(1)) % 2).cast("int").alias("odd"))
    ops = ids.select("sample_id").distinct().join(spark.range(1, 3).select(F.col("id").cast("int").alias("op"))).join(has, ["sample_id", "op"], "left").select("sample_id", "op", F.coalesce("odd", F.lit(0)).alias("odd"))
    classes = spark.range(4).select(F.col("id").cast("int").alias("class"))
    want = F.call_function("shiftright", F.col("class"), F.col("op") - 1).bitwiseAND(F.lit(1))
    extra = ops.join(classes).where((F.col("odd") + want) % 2 == 1).join(F.broadcast(logical), "op").select("sample_id", "class", "e")
    every = odd.join(classes).select("sample_id", "class", "e").union(extra)
    return every.groupBy("sample_id", "class", "e").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").select("sample_id", "class", "e")


def bond_energy(x: Column, beta: Column) -> Column:
    """exp(beta J) and exp(-beta J) for equal and different spins: J = -1 without an error on the bond, +1 with one."""
    j = F.when(x == 1, 1.0).otherwise(-1.0)
    return F.array(F.exp(beta * j), F.exp(-beta * j))


def class_weights(spark: SparkSession, chains: DataFrame, ids: DataFrame, L: int, p: float) -> DataFrame:
    """(sample_id, class, logw): logarithm of the probability of each class, up to a factor common to all.

    Exact: the sum over all 2^(L * L - 1) sums of plaquettes of (p / (1 - p)) to the weight of chain plus sum, on bit
    masks; for L <= 4.
    """
    if L > 4:
        raise ValueError("the exact sum is for L <= 4")
    mask = lambda c: F.bit_xor(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(c) - 1))
    ring = S.plaquettes(spark, L).groupBy("p").agg(mask("bit").alias("m")).where(F.col("p") < L * L)
    masks = F.array(*[F.lit(r["m"]) for r in ring.orderBy("p").collect()])
    bit = lambda k: F.call_function("shiftright", F.col("id"), k).bitwiseAND(F.lit(1)) == 1
    sums = spark.range(1 << (L * L - 1)).select(F.aggregate(F.sequence(F.lit(0), F.lit(L * L - 2)), F.lit(0).cast("long"), lambda a, k: F.when(bit(k), a.bitwiseXOR(F.get(masks, k))).otherwise(a)).alias("s"))
    grid = ids.select("sample_id").distinct().join(spark.range(4).select(F.col("id").cast("int").alias("class")))
    own = grid.join(chains.groupBy("sample_id", "class").agg(mask("e").alias("m")), ["sample_id", "class"], "left").withColumn("m", F.coalesce("m", F.lit(0).cast("long")))
    w = F.pow(F.lit(p / (1 - p)), F.bit_count(F.col("m").bitwiseXOR(F.col("s"))))
    return own.join(F.broadcast(sums)).groupBy("sample_id", "class").agg(F.log(F.sum(w)).alias("logw"))


def random_bond(spark: SparkSession, chains: DataFrame, L: int, beta: float, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(tensors, slots) of the random-bond Ising model of each class: a delta tensor at each site, a bond tensor on each edge.

    g is the class of the one sample, or 4 * sample_id + class for the samples of `ids`.

    Edge (i, j) of the first group joins site (i, j) and the one below, of the second group the one to the right; bond
    tensors are vertices L * L + e.
    """
    n = L * L
    cell = spark.range(n).select((F.col("id") + 1).cast("int").alias("v"))
    down, right = C.translate(F.col("v"), 1, 0, L), C.translate(F.col("v"), 0, 1, L)
    ends = cell.select((n + F.col("v")).alias("b"), F.col("v").alias("x"), down.alias("y")).union(cell.select((2 * n + F.col("v")).alias("b"), "v", right))
    legs = ends.select("b", F.explode(F.array("x", "y")).alias("v"))
    site = legs.groupBy("v").agg(F.array_sort(F.collect_list("b")).alias("l")).select("v", F.posexplode("l").alias("slot", "nbr"))
    bond = ends.select(F.col("b").alias("v"), F.posexplode(F.array("x", "y")).alias("slot", "nbr"))
    kinds = spark.range(4).select(F.col("id").alias("class"))
    g = F.col("class").cast("double") if ids is None else (4 * F.col("sample_id") + F.col("class")).cast("double")
    points = (kinds if ids is None else ids.select("sample_id").distinct().join(kinds)).select(g.alias("g"))
    delta = cell.join(points).select("g", "v", F.explode(F.array(*[F.array(*[F.lit(k)] * 4) for k in (1, 2)])).alias("idx"), F.lit(1.0).alias("re"))
    on = chains.select(g.alias("g"), (n + F.col("e")).alias("b"), F.lit(1).alias("x"))
    energy = ends.select("b").join(points).join(on, ["g", "b"], "left").withColumn("w", bond_energy(F.coalesce("x", F.lit(0)), F.lit(beta)))
    entries = energy.select("g", F.col("b").alias("v"), F.explode(F.array(*[F.struct(F.array(F.lit(p), F.lit(q)).alias("idx"), F.get("w", F.lit(int(p != q))).alias("re")) for p in (1, 2) for q in (1, 2)])).alias("e"))
    return delta.union(entries.select("g", "v", "e.idx", "e.re")), site.union(bond)


def class_energies(spark: SparkSession, chains: DataFrame, ids: DataFrame, L: int, p: float, keep: float = 0.1, rounds: int = 500, seed: int = 1) -> DataFrame:
    """(sample_id, class, logw): belief propagation's log Z of the random-bond model of each class, at any L.

    beta is on the Nishimori line. Messages start off uniform by a little noise that is the same for all classes, as
    else the paramagnet's fixed point, which doesn't see the bonds, would hold. One group holds one class of one sample.
    """
    from . import small

    beta = 0.5 * float(np.log((1 - p) / p))
    t, s = random_bond(spark, chains, L, beta, ids)
    out = small.solve(t, s, keep=keep, tolerance=1e-9, rounds=rounds, noise=0.01, seed=seed)
    return out.where("loop_id IS NULL").select(F.floor(F.col("g") / 4).cast("long").alias("sample_id"), (F.col("g") % 4).cast("int").alias("class"), F.col("re").alias("logw"))


def factor_graph(pcm: DataFrame, s: DataFrame, bias: float, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(tensors, slots) of one syndrome (chk, s): bits first, then checks numbered after the largest bit.

    A bit's tensor is twice its prior on the diagonal, times its known value (bit, x) or one half each if unknown; a
    check's is the parity tensor of its syndrome bit.
    """
    spark = pcm.sparkSession
    p = pcm.distinct()
    top = p.agg(F.max("bit")).first()[0]
    links = p.select("bit", (F.col("chk") + top).cast("int").alias("c"))
    slot = lambda key, nbr: links.select(F.col(key).alias("v"), F.col(nbr).alias("nbr"), (F.row_number().over(W.partitionBy(key).orderBy(nbr)) - 1).alias("slot"))
    slots = slot("bit", "c").union(slot("c", "bit")).select("v", "slot", "nbr")
    degree = slots.groupBy("v").agg(F.count(F.lit(1)).cast("int").alias("n"))
    bits = degree.where(F.col("v") <= top)
    fixed = known.select(F.col("bit").alias("v"), "x") if known is not None else bits.select("v", F.lit(None).cast("int").alias("x"))
    both = bits.join(fixed, "v", "left").select("v", "n", F.posexplode(one_hot(F.col("x"))).alias("k", "hot"))
    prior = F.when(F.col("k") == 0, 1 - bias).otherwise(bias)
    data = both.select(F.lit(0.0).alias("g"), "v", F.transform(F.sequence(F.lit(1), F.col("n")), lambda _: F.col("k") + 1).alias("idx"), (2 * prior * F.col("hot")).alias("re"))
    wide = int(degree.where(F.col("v") > top).agg(F.max("n")).first()[0])
    parts = None
    for legs in range(1, wide + 1):
        for parity in (0, 1):
            t = parity_tensor(spark, legs, parity).select(F.lit(legs).alias("n"), F.lit(parity).alias("s"), "idx", "re")
            parts = t if parts is None else parts.union(t)
    check = degree.where(F.col("v") > top).join(s.select((F.col("chk") + top).cast("int").alias("v"), "s"), "v").join(F.broadcast(parts), ["n", "s"])
    return data.union(check.select(F.lit(0.0).alias("g"), "v", "idx", "re")), slots
