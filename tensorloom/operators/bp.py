"""Belief propagation as iterated join and aggregation.

tensors (g, v, idx, re) and slots (v, slot, nbr) as in sources.tensors; messages (g, src, dst, m), m the array over
the index of the leg at dst. All parameter points g step together. Updates are of all messages at once, so fixed
points agree with sequential sweeps, trajectories don't. Overlaps are bilinear, without conjugation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import table


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _unit(m: Column) -> Column:
    norm = F.sqrt(_dot(m, m))
    return F.transform(m, lambda x: x / norm)


def start(tensors: DataFrame, slots: DataFrame, dims: DataFrame | None = None, noise: float = 0.0, seed: int = 1) -> DataFrame:
    """Uniform unit messages both ways on each link, with noise times a normal deviate added before the norm is taken."""
    dim = dims or tensors.select("v", F.posexplode("idx").alias("slot", "k")).groupBy("v", "slot").agg(F.max("k").alias("dim"))
    ones = F.transform(F.sequence(F.lit(1), F.col("dim")), lambda k: F.lit(1.0))
    points = tensors.select("g").distinct()
    m = slots.join(dim, ["v", "slot"]).join(F.broadcast(points)).select("g", F.col("nbr").alias("src"), F.col("v").alias("dst"), ones.alias("m"), "dim")
    if noise:
        noisy = m.select("g", "src", "dst", F.posexplode("m").alias("k", "x")).withColumn("x", F.col("x") + noise * F.randn(seed))
        m = noisy.groupBy("g", "src", "dst").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("m"))
    return m.select("g", "src", "dst", _unit(F.col("m")).alias("m"))


def incoming(slots: DataFrame, messages: DataFrame) -> DataFrame:
    """(g, v, inc): for each vertex its incoming messages in slot order, as structs (slot, nbr, m)."""
    j = slots.join(messages, (slots["v"] == messages["dst"]) & (slots["nbr"] == messages["src"]))
    return j.groupBy("g", "v").agg(F.array_sort(F.collect_list(F.struct("slot", "nbr", "m"))).alias("inc"))


def _product(inc: Column, idx: Column, without: Column | None = None) -> Column:
    """Product over slots of the message at the tensor's index, without one slot."""
    factor = lambda s: F.get(s["m"], F.get(idx, s["slot"]) - 1)
    one = (lambda a, s: a * factor(s)) if without is None else (lambda a, s: a * F.when(s["slot"] == without, 1.0).otherwise(factor(s)))
    return F.aggregate(inc, F.lit(1.0), one)


def updates(tensors: DataFrame, slots: DataFrame, messages: DataFrame) -> DataFrame:
    """(g, src, dst, m): the unit messages that the tensors send on the incoming ones."""
    j = tensors.join(incoming(slots, messages), ["g", "v"])
    out = j.select("g", "v", "idx", "re", "inc", F.explode("inc").alias("o"))
    term = F.col("re") * _product(F.col("inc"), F.col("idx"), F.col("o.slot"))
    summed = out.groupBy("g", F.col("v").alias("src"), F.col("o.nbr").alias("dst"), F.get("idx", F.col("o.slot")).alias("k")).agg(F.sum(term).alias("x"))
    whole = summed.groupBy("g", "src", "dst").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("m"))
    return whole.select("g", "src", "dst", _unit(F.col("m")).alias("m"))


def step(tensors: DataFrame, slots: DataFrame, messages: DataFrame, keep: float = 0.0, only: DataFrame | None = None) -> DataFrame:
    """One round: (1 - keep) of the update and keep of the old message, of norm 1. only (u, w) restricts the links that change.

    Raises ValueError if a link of `only` carries no message.
    """
    new = updates(tensors, slots, messages).withColumnRenamed("m", "new")
    j = messages.join(new, ["g", "src", "dst"], "left")
    mixed = _unit(F.zip_with("new", "m", lambda x, y: (1 - keep) * x + keep * y))
    if only is not None:
        ends = messages.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("w")).distinct()
        if only.join(ends, ["u", "w"], "left_anti").limit(1).count():
            raise ValueError("links outside the network")
        sel = only.select("u", "w").distinct().withColumn("_on", F.lit(True))
        j = j.withColumns({"u": F.least("src", "dst"), "w": F.greatest("src", "dst")}).join(F.broadcast(sel), ["u", "w"], "left")
        mixed = F.when(F.col("_on"), mixed).otherwise(F.col("m"))
    return j.select("g", "src", "dst", mixed.alias("m"))


def residual(tensors: DataFrame, slots: DataFrame, messages: DataFrame) -> DataFrame:
    """(g, total, largest): distances of the messages from their updates."""
    new = updates(tensors, slots, messages).withColumnRenamed("m", "new")
    d = F.zip_with("m", "new", lambda x, y: x - y)
    return messages.join(new, ["g", "src", "dst"]).select("g", F.sqrt(_dot(d, d)).alias("d")).groupBy("g").agg(F.sum("d").alias("total"), F.max("d").alias("largest"))


def fixed_point(tensors: DataFrame, slots: DataFrame, messages: DataFrame, keep: float = 0.0, tolerance: float = 1e-12, rounds: int = 1000, every: int = 5, only: DataFrame | None = None) -> DataFrame:
    """Messages after rounds, or as soon as every point's residual is within the tolerance; checked every few rounds."""
    messages = table(messages)
    for n in range(0, rounds, every):
        for _ in range(min(every, rounds - n)):
            messages = table(step(tensors, slots, messages, keep, only))
        if only is None and not residual(tensors, slots, messages).where(~(F.col("total") <= tolerance)).limit(1).count():
            break
    return messages


def overlaps(messages: DataFrame) -> DataFrame:
    """(g, u, w, overlap): the product of the two messages on each link."""
    a, b = messages.alias("a"), messages.alias("b")
    j = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.src") == F.col("b.dst")) & (F.col("a.dst") == F.col("b.src")) & (F.col("a.src") < F.col("a.dst")))
    return j.select("a.g", F.col("a.src").alias("u"), F.col("a.dst").alias("w"), _dot(F.col("a.m"), F.col("b.m")).alias("overlap"))


def gauge(messages: DataFrame) -> DataFrame:
    """The messages scaled so that the two on each link have overlap 1."""
    o = overlaps(messages)
    j = messages.withColumns({"u": F.least("src", "dst"), "w": F.greatest("src", "dst")}).join(o, ["g", "u", "w"])
    scale = F.sqrt(F.abs("overlap")) * F.when(F.col("src") < F.col("dst"), 1.0).otherwise(F.signum("overlap"))
    return j.select("g", "src", "dst", F.transform("m", lambda x: x / scale).alias("m"))


def local_z(tensors: DataFrame, slots: DataFrame, messages: DataFrame) -> DataFrame:
    """(g, v, z): each tensor with all its incoming messages, over the square roots of its links' overlaps."""
    scaled = gauge(messages)
    return tensors.join(incoming(slots, scaled), ["g", "v"]).groupBy("g", "v").agg(F.sum(F.col("re") * _product(F.col("inc"), F.col("idx"))).alias("z"))


def normalise(tensors: DataFrame, z: DataFrame) -> DataFrame:
    """Tensors over their local z."""
    return tensors.join(z, ["g", "v"]).select("g", "v", "idx", (F.col("re") / F.col("z")).alias("re"))


def log_partition(z: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(g, logz, sign): logarithm of the product of local z over all vertices or those given."""
    z = z if vertices is None else z.join(F.broadcast(vertices.select("v").distinct()), "v", "left_semi")
    return z.groupBy("g").agg(F.sum(F.log(F.abs("z"))).alias("logz"), (1 - 2 * (F.sum((F.col("z") < 0).cast("int")) % 2)).alias("sign"))


def excited(messages: DataFrame) -> DataFrame:
    """(g, u, w, a, b, re): identity minus the messages' projector on each link, index a at u and b at w."""
    o = overlaps(messages)
    down = messages.select("g", F.col("src").alias("w"), F.col("dst").alias("u"), F.col("m").alias("at_u"))
    up = messages.select("g", F.col("src").alias("u"), F.col("dst").alias("w"), F.col("m").alias("at_w"))
    j = o.join(down, ["g", "u", "w"]).join(up, ["g", "u", "w"]).select("g", "u", "w", "overlap", "at_w", F.posexplode("at_u").alias("a", "x")).select("g", "u", "w", "overlap", "a", "x", F.posexplode("at_w").alias("b", "y"))
    return j.select("g", "u", "w", (F.col("a") + 1).alias("a"), (F.col("b") + 1).alias("b"), (F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0) - F.col("x") * F.col("y") / F.col("overlap")).alias("re"))


def marginals(tensors: DataFrame, slots: DataFrame, messages: DataFrame, leg: Column) -> DataFrame:
    """(g, v, k, p): tensors with an open last leg of index `leg` on the incoming messages, scaled to sum 1."""
    scaled = gauge(messages)
    raw = tensors.join(incoming(slots, scaled), ["g", "v"]).groupBy("g", "v", leg.alias("k")).agg(F.sum(F.col("re") * _product(F.col("inc"), F.col("idx"))).alias("x"))
    total = raw.groupBy("g", "v").agg(F.sum("x").alias("t"))
    return raw.join(total, ["g", "v"]).select("g", "v", "k", (F.col("x") / F.col("t")).alias("p"))


def _loop_sum(pdf):
    import numpy as np
    import pandas as pd

    names: dict[tuple[int, int], int] = {}
    operands = []
    loop = {(int(e["u"]), int(e["w"])) for e in pdf["edges"].iloc[0]}
    by_vertex = {int(r["v"]): r for _, r in pdf.iterrows()}
    for v, r in by_vertex.items():
        inc = sorted(r["inc"], key=lambda s: s["slot"])
        shape = [len(s["m"]) for s in inc]
        t = np.zeros(shape)
        for e in r["entries"]:
            t[tuple(int(k) - 1 for k in e["idx"])] = e["re"]
        legs = []
        for s in reversed(inc):
            if (min(v, s["nbr"]), max(v, s["nbr"])) in loop:
                legs.append(names.setdefault((v, int(s["nbr"])), len(names)))
            else:
                t = np.tensordot(t, np.asarray(s["m"], float), axes=([s["slot"]], [0]))
        operands += [t, legs[::-1]]
    m = {(int(s["nbr"]), v): np.asarray(s["m"], float) for v, r in by_vertex.items() for s in r["inc"]}
    for u, w in loop:
        a, b = m[(w, u)], m[(u, w)]
        operands += [np.eye(len(a)) - np.outer(a, b) / (a @ b), [names[(u, w)], names[(w, u)]]]
    return pd.DataFrame({"g": [pdf["g"].iloc[0]], "loop_id": [pdf["loop_id"].iloc[0]], "z": [float(np.einsum(*operands, [], optimize="greedy"))]})


def loop_contributions(tensors: DataFrame, slots: DataFrame, messages: DataFrame, loops: DataFrame) -> DataFrame:
    """(g, loop_id, z): each loop's links excited and everything else on its messages, relative to the vacuum.

    loops are (loop_id, edges); a loop with a link that the network lacks has no row. One group holds one loop's tensors.
    """
    scaled = gauge(messages)
    unit = normalise(tensors, local_z(tensors, slots, messages))
    packed = unit.groupBy("g", "v").agg(F.collect_list(F.struct("idx", "re")).alias("entries")).join(incoming(slots, scaled), ["g", "v"])
    links = slots.select(F.least("v", "nbr").alias("u"), F.greatest("v", "nbr").alias("w")).distinct()
    missing = loops.select("loop_id", F.explode("edges").alias("e")).select("loop_id", "e.u", "e.w").join(links, ["u", "w"], "left_anti").select("loop_id").distinct()
    inside = loops.join(missing, "loop_id", "left_anti")
    at = inside.select("loop_id", "edges", F.explode(F.array_distinct(F.flatten(F.transform("edges", lambda e: F.array(e["u"], e["w"]))))).alias("v"))
    return at.join(packed, "v").groupBy("g", "loop_id").applyInPandas(_loop_sum, "g double, loop_id long, z double")
