"""Belief propagation on large graphs of two-valued vertices, where only messages whose inputs moved are computed again.

A pairwise model has a field on each vertex and a coupling on each edge; a message is half the log odds that its sender
gives its receiver. The state has one row for each direction of an edge, kept at the receiver in buckets: what comes in,
what went out, and the receiver's total. A round takes the messages that moved, adds them up at their receivers, works
out what those send, and hands on what moved by more than the tolerance: these changes are all that is shuffled.

Where edges are too many to be written each round, by_totals() keeps the totals of vertices only: at the fixed point the
two messages of an edge follow from its coupling and the totals at its ends. Of these it keeps only those of vertices that
some edge of theirs is dealt away from; each other one's total follows from its neighbours'.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import session
from ..session import bucketed, drop, setting, table

#: A join on receiver, slice and sender may use buckets of the first two.
CO_PARTITIONED = ("spark.sql.requireAllClusterKeysForCoPartition", "false")
#: Links of one vertex that lie in one bucket at most, about; more are dealt over several.
SLICE = 100_000
#: Deals of edges in by_totals(): a vertex's total is sent to each deal that has edges of it, hence to so many at most.
DEALS = 16
#: Edges that by_totals() packs into one row and that it works out at once, about, and such rows: whole numbers and doubles as bytes.
PACKED = 1_000_000
BLOCK = 10_000
CHUNK = "deal int, shared binary, low binary, counts binary, pure binary, h binary, place binary, t binary"


def _sent(j: Column, rest: Column) -> Column:
    return F.atanh(F.tanh(j) * F.tanh(rest))


def start(fields: DataFrame, edges: DataFrame, buckets: int, slice_size: int = SLICE) -> DataFrame:
    """State of fields (v, h) and edges (u, w, j), each edge once: rows (v, slice, nbr, nbr_slice, slices, nbr_slices, j, total, inc, out), no message sent yet.

    A vertex with more links than slice_size is dealt over slices. Edges that occur twice, either way round, add their
    couplings; edges from a vertex to itself and edges with a null are left out; vertices without a field have 0.
    """
    once = edges.where("u <> w").select(F.least("u", "w").alias("u"), F.greatest("u", "w").alias("w"), "j").groupBy("u", "w").agg(F.sum("j").alias("j")).where("j IS NOT NULL")
    once = table(once)
    ends = once.select("u").union(once.select("w"))
    slices = ends.groupBy(F.col("u").alias("v")).agg(F.ceil(F.count(F.lit(1)) / slice_size).cast("int").alias("slices"))
    about = slices.join(fields.groupBy("v").agg(F.sum("h").alias("h")), "v", "left").select("v", "slices", F.coalesce("h", F.lit(0.0)).alias("total"))
    side = lambda v, prefix: about.select(F.col("v").alias(v), F.col("slices").alias(f"{prefix}slices"), F.col("total").alias(f"{prefix}total"))
    at = lambda other, n: F.pmod(F.xxhash64(other), F.col(n)).cast("int")
    known = once.join(side("u", "a_"), "u").join(side("w", "b_"), "w").withColumns({"a_slice": at("w", "a_slices"), "b_slice": at("u", "b_slices")})
    way = lambda v, w, a, b: known.select(F.col(v).alias("v"), F.col(f"{a}_slice").alias("slice"), F.col(w).alias("nbr"), F.col(f"{b}_slice").alias("nbr_slice"), F.col(f"{a}_slices").alias("slices"), F.col(f"{b}_slices").alias("nbr_slices"), "j", F.col(f"{a}_total").alias("total"))
    both = way("u", "w", "a", "b").union(way("w", "u", "b", "a"))
    return bucketed(both.withColumns({"inc": F.lit(0.0), "out": F.lit(0.0)}).repartition(buckets, "v", "slice"), buckets, "v", "slice")


def _changes(state: DataFrame, tolerance: float) -> DataFrame:
    """(v, slice, nbr, slices, moved): messages to v from nbr that have moved by more than the tolerance since they were sent."""
    now = _sent(F.col("j"), F.col("total") - F.col("inc"))
    return state.select(F.col("nbr").alias("v"), F.col("nbr_slice").alias("slice"), F.col("v").alias("nbr"), F.col("nbr_slices").alias("slices"), (now - F.col("out")).alias("moved")).where(F.abs("moved") > tolerance)


def _received(state: DataFrame, moved: DataFrame, tolerance: float) -> DataFrame:
    """state after its own messages of that round were sent and the moved ones came in."""
    now = _sent(F.col("j"), F.col("total") - F.col("inc"))
    out = F.when(F.abs(now - F.col("out")) > tolerance, now).otherwise(F.col("out"))
    sums = moved.groupBy("v", "slices").agg(F.sum("moved").alias("more")).select("v", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "more")
    sent = state.withColumn("out", out)
    joined = sent.join(sums, ["v", "slice"], "left").join(moved.select("v", "slice", "nbr", "moved"), ["v", "slice", "nbr"], "left")
    return joined.select("v", "slice", "nbr", "nbr_slice", "slices", "nbr_slices", "j", (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"), (F.col("inc") + F.coalesce("moved", F.lit(0.0))).alias("inc"), "out")


def run(state: DataFrame, buckets: int, tolerance: float = 1e-12, rounds: int = 200, trace: list[int] | None = None) -> DataFrame:
    """state when no message would move by more than the tolerance, or after so many rounds; trace takes the messages moved in each.

    State is rewritten in place of its buckets, not shuffled; a round's changes are written, so that a lost executor costs a task.
    """
    given = state
    for _ in range(rounds):
        moved = table(_changes(state, tolerance))
        n = moved.count()
        if trace is not None:
            trace.append(n)
        if n:
            with setting(state.sparkSession, *CO_PARTITIONED):
                was, state = state, bucketed(_received(state, moved, tolerance), buckets, "v", "slice")
            if was is not given:
                drop(was)
        drop(moved)
        if not n:
            break
    return state


def marginals(state: DataFrame) -> DataFrame:
    """(v, p): the probability of the upper value at each vertex that has an edge."""
    return state.groupBy("v").agg(F.max("total").alias("total")).select("v", (1 / (1 + F.exp(-2 * F.col("total")))).alias("p"))


def fixed_point(fields: DataFrame, edges: DataFrame, tolerance: float = 1e-12, rounds: int = 200, slice_size: int = SLICE, trace: list[int] | None = None) -> DataFrame:
    """marginals() of the model with fields (v, h) and edges (u, w, j) at the fixed point of its messages: exact on trees."""
    buckets = int(fields.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return marginals(run(start(fields, edges, buckets, slice_size), buckets, tolerance, rounds, trace))


def _pack(tables: pa.Table) -> pa.Table:
    """Edges (deal, part, low, high, t, n, h) of one part of a deal, with all that a low end owns, as one row of CHUNK."""
    low, high, t, n, h = (tables.column(c).to_numpy() for c in ("low", "high", "t", "n", "h"))
    order = np.argsort(low, kind="stable")
    low, high, t = low[order], high[order], t[order]
    begin = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    counts, at = np.diff(np.r_[begin, len(low)]), low[begin]
    pure = counts == n[order][begin]
    # All shared vertices of the chunk: high ends, and low ends that are high ones elsewhere, too.
    shared, place = np.unique(np.concatenate([high, at[~pure]]), return_inverse=True)
    made = {"shared": shared, "low": at, "counts": counts.astype(np.int32), "pure": pure, "h": h[order][begin], "place": place.astype(np.int32), "t": t}
    return pa.table({"deal": pa.array([tables.column("deal")[0].as_py()], pa.int32())} | {c: pa.array([x.tobytes()], pa.binary()) for c, x in made.items()})


def _worked(row: dict, v: np.ndarray, total: np.ndarray, exact: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Of a chunk, given totals of the vertices v, ascending: its shared vertices, what comes in there and how far that answers to their own totals; its pure vertices, their totals and the last move of these.

    With A and B the tanh of the totals at the ends of an edge and t that of its coupling, what A's end gets is atanh(t f)
    for f = 2 (B - t A) / (D + sqrt(D^2 - 4 t (A - t B) (B - t A))), D = 1 - t^2, and the other way round: both messages
    are then what their sender's total less the other one sends.
    """
    kinds = {"shared": np.int64, "low": np.int64, "counts": np.int32, "pure": bool, "h": np.float64, "place": np.int32, "t": np.float64}
    shared, low, counts, pure, h, place, t = (np.frombuffer(row[c], kind) for c, kind in kinds.items())
    high, own = place[: len(t)], np.full(len(low), -1)
    own[~pure] = place[len(t) :]
    known = np.tanh(total[np.searchsorted(v, shared)])
    begin = np.cumsum(counts) - counts
    near, sends, back, moved = np.where(pure, h, 0.0), np.empty(len(t)), np.empty(len(t)), 0.0
    gets, answers = np.empty(len(low)), np.empty(len(low))
    # Worked out by some thousand edges at once, which stay in a processor's cache.
    cut = np.flatnonzero(np.diff(np.r_[-1, begin // BLOCK])).tolist()
    for a, b in zip(cut, [*cut[1:], len(low)], strict=True):
        x, y = begin[a], begin[b - 1] + counts[b - 1]
        j, far, alone, at = t[x:y], known[high[x:y]], pure[a:b], begin[a:b] - x
        gap, fixed = (1 - j) * (1 + j), known[own[a:b]]
        least, most = np.full(b - a, -np.inf), np.full(b - a, np.inf)
        # A pure vertex meets shared ones only: given their totals, its own is where a falling function is 0.
        for _ in range(100):
            mine = np.repeat(np.where(alone, np.tanh(near[a:b]), fixed), counts[a:b])
            up, down = mine - j * far, far - j * mine
            scale = 2 / np.maximum(gap + np.sqrt(np.maximum(gap * gap - 4 * j * up * down, 0)), 1e-300)
            up, down = up * scale, down * scale
            to_far, to_near = j * up, j * down
            # How far each message answers to its receiver's total.
            both = (1 - up * up) * (1 - down * down) * j * j
            back[x:y] = both / np.maximum((1 - to_far * to_far) * (1 - to_near * to_near) - both, 1e-300)
            gets[a:b], answers[a:b] = np.add.reduceat(np.arctanh(to_near), at), np.add.reduceat(back[x:y], at)
            step = np.where(alone, (h[a:b] + gets[a:b] - near[a:b]) / (1 + answers[a:b]), 0.0)
            # No step leaves what earlier ones enclose: with strong couplings it would go to and fro.
            least, most = np.where(step > 0, near[a:b], least), np.where(step < 0, near[a:b], most)
            then = near[a:b] + step
            out = (np.abs(step) > exact) & ((then <= least) | (then >= most))
            then[out] = (least[out] + most[out]) / 2
            near[a:b] = then
            last = float(np.max(np.abs(step)))
            if not last > exact:
                break
        sends[x:y] = np.arctanh(to_far)
        moved = max(moved, last)
    inc, answer = np.bincount(high, sends, len(shared)), np.bincount(high, back, len(shared))
    if not pure.all():
        inc += np.bincount(own[~pure], gets[~pure], len(shared))
        answer += np.bincount(own[~pure], answers[~pure], len(shared))
    return shared, inc, answer, low[pure], near[pure], moved


def _each(batches: Iterator[pa.RecordBatch], exact: float) -> Iterator[tuple]:
    """Of each row of CHUNK with totals: its deal, the vertices of that deal, ascending, and what _worked() gives."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            flat = row.column("totals").flatten()
            v, total = (flat.field(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            order = np.argsort(v)
            cells = row.drop_columns(["totals"]).to_pylist()[0]
            yield cells["deal"], v[order], _worked(cells, v[order], total[order], exact)


def _adder(exact: float):
    """For chunks with totals: (v, inc, answer, moved), one row for each shared vertex of a deal."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple] = {}
        for deal, v, (shared, inc, answer, _, _, moved) in _each(batches, exact):
            of = sums.setdefault(deal, (v, np.zeros(len(v)), np.zeros(len(v)), np.zeros(len(v))))
            at = np.searchsorted(v, shared)
            of[1][at] += inc
            of[2][at] += answer
            np.maximum(of[3], moved, out=of[3])
        for of in sums.values():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in of], ["v", "inc", "answer", "moved"])

    return add


def _solver(exact: float):
    """For chunks with totals: (v, total) of their pure vertices."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, (_, _, _, v, total, _) in _each(batches, exact):
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(total)], ["v", "total"])

    return solve


def _dealt(fields: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(deal, low, high, t, n, h) of each edge once, dealt by its low end, that of fewer edges, which has n and the field h; (v, h, deals) of each shared vertex.

    A vertex is pure if it is the low end of all its edges; others are shared, and lie in each deal that has edges of theirs.
    """
    once = table(edges.where("u <> w").select(F.least("u", "w").cast("long").alias("u"), F.greatest("u", "w").cast("long").alias("w"), "j").groupBy("u", "w").agg(F.sum("j").alias("j")).where("j IS NOT NULL"))
    field = fields.groupBy(F.col("v").cast("long").alias("v")).agg(F.sum("h").cast("double").alias("h"))
    ends = once.select(F.explode(F.array("u", "w")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    about = table(ends.join(field, "v", "left").select("v", "n", F.coalesce("h", F.lit(0.0)).alias("h")))
    end = lambda v: about.select(F.col("v").alias(v), F.struct("n", "v", "h").alias(f"{v}_end"))
    first = F.struct("u_end.n", "u") < F.struct("w_end.n", "w")
    of = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    known = once.join(end("u"), "u").join(end("w"), "w").select(of("u", "w").alias("low"), of("w", "u").alias("high"), F.tanh("j").alias("t"), of("u_end.n", "w_end.n").alias("n"), of("u_end.h", "w_end.h").alias("h"))
    rows = bucketed(known.select(F.pmod(F.xxhash64("low"), F.lit(DEALS)).cast("int").alias("deal"), "*").repartition(DEALS, "deal"), DEALS, "deal")
    met = rows.groupBy("deal", F.col("high").alias("v")).agg(F.lit(True).alias("high")).union(rows.groupBy("deal", "low").agg(F.lit(False)))
    shared = met.groupBy("v").agg(F.collect_set("deal").alias("deals"), F.max("high").alias("high")).where("high")
    held = bucketed(shared.join(about, "v").select("v", "h", "deals").repartition(DEALS, "v"), DEALS, "v")
    drop(once)
    drop(about)
    return rows, held


def _chunks(rows: DataFrame) -> DataFrame:
    """The edges of _dealt() in rows of CHUNK, about PACKED of them each, in the buckets of their deals."""
    parts = max(1, round(rows.count() / DEALS / PACKED))
    part = F.pmod(F.xxhash64("low", F.lit(1)), F.lit(parts)).cast("int").alias("part")
    packed = rows.select("deal", part, "low", "high", "t", "n", "h").groupBy("deal", "part").applyInArrow(_pack, CHUNK)
    return session.bucketed(packed, DEALS, "deal")


def _with_totals(chunks: DataFrame, held: DataFrame, state: DataFrame) -> DataFrame:
    """chunks with the totals (v, total) of all shared vertices of their deal."""
    sent = state.join(held.select("v", "deals").hint("shuffle_hash"), "v").select(F.explode("deals").alias("deal"), F.struct("v", "total").alias("x"))
    return chunks.join(sent.groupBy("deal").agg(F.collect_list("x").alias("totals")).hint("shuffle_hash"), "deal")


def by_totals(fields: DataFrame, edges: DataFrame, tolerance: float = 1e-10, rounds: int = 400, trace: list[float] | None = None) -> DataFrame:
    """marginals of fixed_point(), for weak couplings on graphs of many more edges than vertices: a round reads the edges and writes shared vertices only.

    Edges are written once, in DEALS deals, packed by the vertices that own them. A vertex that owns all its edges is
    pure: each round works its total out from those of the shared vertices that it meets, and then what the edges of the
    chunk send to these. Sums over the deals move each shared total towards its field and messages, the less the more
    they answer to it. It ends when no total moves by more than the tolerance; trace takes the largest move of each
    round. The totals of the round before are deleted.
    """
    spark, exact = fields.sparkSession, tolerance / 100
    rows, held = _dealt(fields, edges)
    chunks = _chunks(rows)
    state = bucketed(held.select("v", F.col("h").alias("total")), DEALS, "v")
    # A row of a chunk is large: one at a time is read and handed to Python.
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "1"), setting(spark, "spark.sql.parquet.columnarReaderBatchSize", "1"):
        for _ in range(rounds):
            sums = _with_totals(chunks, held, state).mapInArrow(_adder(exact), "v long, inc double, answer double, moved double")
            sums = sums.groupBy("v").agg(F.sum("inc").alias("inc"), F.sum("answer").alias("answer"), F.max("moved").alias("moved"))
            now = sums.join(held.select("v", "h"), "v").join(state.select("v", F.col("total").alias("was")), "v")
            total = (F.col("h") + F.col("inc") + F.col("answer") * F.col("was")) / (1 + F.col("answer"))
            now = now.select("v", total.alias("total"), F.greatest("moved", F.abs(total - F.col("was"))).alias("moved"))
            was, state = state, bucketed(now.repartition(DEALS, "v"), DEALS, "v")
            moved = state.agg(F.max("moved")).first()[0] or 0.0
            drop(was)
            if trace is not None:
                trace.append(moved)
            if moved <= tolerance:
                break
        pure = table(_with_totals(chunks, held, state).mapInArrow(_solver(exact), "v long, total double"))
    drop(chunks)
    return marginals(state.select("v", "total").union(pure))
