"""Near-duplicates by an LSH forest over MinHash signatures.

Texts with equal shingle sets first fall into one class, which takes part once. Each class has TREES sorted orders of
DEPTH MinHash values. In every order the neighbours with the longest common prefix, at least MIN_DEPTH values, are
candidates: where many classes share a short prefix the sort itself goes deeper, where few do it stays shallow. Two
texts that share 85 percent of their shingles share a prefix in some order but for one pair in 100,000. Candidates are
confirmed on the full sets, in rounds, and only between classes that are still in different components: first the
likeliest neighbours, then all members of a large region with its centre, at every depth, then the likeliest again, then
all pairs of the regions of up to NEIGHBOURS + 1 classes. Large regions that are still split into several components
get an exact answer: a prefix-filtered set join, rarest shingles first, of classes from different components. It comes
last, when a large group of near copies has grown together. No region is cut off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators.graph import components
from .common import bounded, carried, lean, released, table
from .sentencepiece_codec import _pieces
from .shingles import WORDS, mix, shingle_sets

TREES, DEPTH, MIN_DEPTH, NEIGHBOURS, CLOSE = 16, 6, 4, 24, 8
#: MinHash values whose low bytes travel with the orders, to drop unlikely candidates early.
BITS = 64
#: Link at this percentage of shared shingles, unless the caller says otherwise.
PERCENT = 80
#: Candidates whose signatures agree this many standard deviations less than the threshold asks for are not confirmed.
SIGMAS = 6
#: Candidates of each class that are confirmed in a round, before components are looked at again.
PARTNERS = 2
#: Pairs of ids that may be broadcast to meet their first set.
BROADCAST_PAIRS = 2_000_000
#: Large regions whose sizes and centres may be broadcast.
BROADCAST_REGIONS = 500_000
#: Ids that may be broadcast to pick their texts; for more the texts are shuffled.
BROADCAST_IDS = 1_000_000
#: Characters of text that are hashed at once, unless one text is longer.
PIECE_CHARS = 2_000_000
#: Rows of the forest in one sorted partition.
ROWS_PER_PARTITION = 100_000
_A = mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """A row of TREES * DEPTH 32-bit MinHash values for each nonempty set."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), len(_A)), np.uint32)
    with np.errstate(over="ignore"):
        for k, a in enumerate(_A if len(sets) else ()):
            out[:, k] = np.minimum.reduceat((flat * a) >> np.uint64(32), starts)
    return out


def signatures(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(id, n, fp, sig): size of the shingle set, a 128-bit digest of it and the MinHash values, both empty for no shingles."""
    schema = "id long, n long, fp binary, sig binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _pieces(whole, 1, PIECE_CHARS):
                sets = shingle_sets(b.column(1).to_pylist())
                full = [i for i, s in enumerate(sets) if len(s)]
                sig, fp = [b""] * len(sets), [b""] * len(sets)
                with np.errstate(over="ignore"):
                    for i, m in zip(full, minhashes([sets[i] for i in full]).astype(">u4"), strict=True):
                        sig[i] = m.tobytes()
                        fp[i] = np.array([sets[i].sum(dtype=np.uint64), mix(sets[i]).sum(dtype=np.uint64)]).tobytes()
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary())], names=["id", "n", "fp", "sig"])

    return docs.select(F.col(ident).cast("long").alias("id"), F.col(text)).mapInArrow(lean(run), schema)


def _sets(docs: DataFrame) -> DataFrame:
    """(id, s): the whole shingle set of each (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _pieces(whole, 1, PIECE_CHARS):
                sets = [s.view(np.int64) for s in shingle_sets(b.column(1).to_pylist())]
                offsets = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets)))], names=["id", "s"])

    return docs.mapInArrow(lean(run), "id long, s array<long>")


def forest(classes: DataFrame) -> DataFrame:
    """(tree, key, id, n, bits): a row of each order for each class; key sorts as its DEPTH MinHash values do."""
    schema = "tree int, key binary, id long, n long, bits binary"
    width = 4 * DEPTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                c = b.slice(at, 2000)
                sig = [x.as_py() for x in c.column(2)]
                bits = [x[3 : 4 * BITS : 4] for x in sig]
                n = len(sig)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.arange(TREES, dtype=np.int32), n)), pa.array([x[t * width : (t + 1) * width] for t in range(TREES) for x in sig], pa.binary()), pa.concat_arrays([c.column(0)] * TREES), pa.concat_arrays([c.column(1)] * TREES), pa.array(bits * TREES, pa.binary())],
                    names=["tree", "key", "id", "n", "bits"],
                )

    return classes.select("id", "n", "sig").mapInArrow(lean(run), schema)


def _alike(bits_a: np.ndarray, bits_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether sizes allow a link and the low bytes of the MinHash values agree often enough, and how often they agree."""
    p = percent / 100 + (1 - percent / 100) / 256
    need = BITS * p - SIGMAS * np.sqrt(BITS * p * (1 - p))
    agree = (bits_a == bits_b).sum(axis=1)
    return (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)) & (agree >= need), agree


def _neighbours(ordered: DataFrame, percent: int) -> DataFrame:
    """From sorted partitions: candidates (a, b) with d = 1 for those next to each other in some order and whole for those of
    a region that is compared whole, and with d = 0 the regions with more classes than neighbours are looked at, or that a
    partition begins or ends in."""
    schema = "d int, a long, b long, agree int, whole boolean, region binary"
    prefix = 4 * MIN_DEPTH

    names = ["d", "a", "b", "agree", "whole", "region"]

    def rows(d: int, pairs: np.ndarray) -> pa.RecordBatch:
        n = len(pairs)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, d, np.int32)), pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64()), pa.array(pairs[:, 2], pa.int32()), pa.array(pairs[:, 3] > 0), pa.nulls(n, pa.binary())], names=names)

    def places(regions: set[bytes]) -> pa.RecordBatch:
        n = len(regions)
        return pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_()), pa.array(sorted(regions), pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, None
        for b in batches:
            if not b.num_rows:
                continue
            raw = np.frombuffer(b"".join(bytes([t]) + k.as_py()[:prefix] for t, k in zip(b.column(0).to_pylist(), b.column(1), strict=True)), f"V{prefix + 1}")
            bits = np.frombuffer(b"".join(x.as_py() for x in b.column(4)), np.uint8).reshape(-1, BITS)
            now = (raw, b.column(2).to_numpy(), b.column(3).to_numpy(), bits)
            large = {raw[0].tobytes()} if held is None else set()
            last = raw[-1].tobytes()
            old = 0 if held is None else len(held[0])
            r, ids, n, bits = now if held is None else tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            first = np.r_[True, r[1:] != r[:-1]]
            nth = np.cumsum(first) - 1
            size = np.bincount(nth)[nth]
            near, far = [], []
            for d in range(1, NEIGHBOURS + 1):
                i = np.arange(max(old, d), len(r))
                i = i[r[i] == r[i - d]]
                if d == NEIGHBOURS:
                    large.update(x.tobytes() for x in r[i])
                if d > CLOSE:
                    # Only regions small enough to be compared whole; the held rows make none look smaller than that.
                    i = i[size[i] <= NEIGHBOURS + 1]
                ok, agree = _alike(bits[i], bits[i - d], n[i], n[i - d], percent)
                i = i[ok]
                (near if d == 1 else far).append(np.c_[np.minimum(ids[i], ids[i - d]), np.maximum(ids[i], ids[i - d]), agree[ok], size[i] <= NEIGHBOURS + 1])
            yield rows(1, np.unique(np.vstack(near), axis=0))
            yield rows(2, np.unique(np.vstack(far), axis=0))
            yield places(large)
            held = tuple(x[-NEIGHBOURS:] for x in (r, ids, n, bits))
        if last is not None:
            yield places({last})

    return ordered.mapInArrow(lean(run), schema)


def _likeliest(pairs: DataFrame) -> DataFrame:
    """Of the candidates (a, b, agree), each once, those that are among the PARTNERS of either end whose signatures agree most."""
    ends = pairs.select("a", "b", "agree", F.explode(F.array("a", "b")).alias("end"))
    rank = F.row_number().over(W.partitionBy("end").orderBy(F.desc("agree"), "a", "b"))
    return ends.withColumn("rank", rank).where(F.col("rank") <= PARTNERS).select("a", "b").distinct()


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) whose ends are in different components."""
    of = lambda end: label.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")


def _region(depth: int):
    return F.concat(F.unhex(F.lpad(F.hex(F.col("tree")), 2, "0")), F.substring("key", 1, 4 * depth))


def _agree(left: str, right: str, percent: int):
    """_alike without Python for joined rows: sizes only, the full sets decide."""
    return 100 * F.least(left, right) >= percent * F.greatest(left, right)


def _stars(members: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b): at each depth every member of a region that is too large for its neighbours, with its centre.

    The centre of a region is the member that has the most company over all orders: the original of a group of edited
    copies keeps its MinHash values where each copy has lost some.
    """
    levels = members.select("id", "n", F.explode(F.array(*[_region(d) for d in range(MIN_DEPTH, DEPTH + 1)])).alias("r"))
    size = table(levels.groupBy("r").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > NEIGHBOURS))
    inside = table(levels.join(bounded(size, BROADCAST_REGIONS), "r"))
    company = inside.groupBy("id").agg(F.sum("size").alias("company"))
    centre = inside.join(company, "id").groupBy("r").agg(F.max(F.struct("company", -F.col("id"), "n")).alias("c"))
    centre = table(centre.select("r", (-F.col("c.col2")).alias("centre"), F.col("c.n").alias("nc")))
    pairs = inside.join(bounded(centre, BROADCAST_REGIONS), "r").where((F.col("id") != F.col("centre")) & _agree("n", "nc", percent))
    return pairs.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()


def _confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full shingle sets overlap enough."""
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    sets = table(_sets(texts.join(bounded(table(ends), BROADCAST_IDS), "id", "left_semi")))
    both = bounded(pairs, BROADCAST_PAIRS).join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    linked = both.select("a", "b", (F.size("sa") + F.size("sb")).alias("total"), shared.alias("shared"))
    return linked.where(100 * F.col("shared") >= percent * (F.col("total") - F.col("shared"))).select("a", "b")


def _rest(members: DataFrame, label: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The exact rest: candidates of different components that a region of several components holds.

    In any order of the shingles that is common to all sets, the first one that two linked sets share lies within the
    first n - ceil(2 * percent * n / (100 + percent)) + 1 of the smaller set and the first n - ceil(percent * n / 100)
    + 1 of the larger, and what follows it on either side must still allow the overlap. The rarest shingles come first;
    one whose holders are all in one component needs no pair.
    """
    m = members.select("id", _region(MIN_DEPTH).alias("r")).join(label, "id", "left").withColumn("c", F.coalesce("component", "id"))
    split = table(m.groupBy("r").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where(F.col("lo") != F.col("hi")).select("r"))
    ids = table(m.join(bounded(split, BROADCAST_REGIONS), "r", "left_semi").select("id", "c").distinct())
    sets = table(_sets(texts.join(bounded(ids, BROADCAST_IDS).select("id"), "id", "left_semi")).join(bounded(ids, BROADCAST_IDS), "id"))
    rows = sets.select("id", "c", F.size("s").alias("n"), F.explode("s").alias("x"))
    often = rows.groupBy("x").agg(F.count(F.lit(1)).alias("df"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("df > 1")
    # Shingles of one set only come first and need no row: a set's others are counted from behind.
    of_set = W.partitionBy("id")
    ranked = rows.join(often, "x").select("id", "c", "n", "x", "df", (F.col("lo") != F.col("hi")).alias("split"))
    ranked = ranked.withColumn("k", F.col("n") - F.count(F.lit(1)).over(of_set) + F.row_number().over(of_set.orderBy("df", "x")))
    n = F.col("n")
    probe = ranked.where((F.col("k") <= n - F.ceil(n * percent / 100) + 1) & F.col("split")).select("x", "id", "c", "n", "k")
    probe = table(probe)
    index = probe.where(F.col("k") <= n - F.ceil(n * 2 * percent / (100 + percent)) + 1)
    s, l = index.alias("s"), probe.alias("l")
    smaller = (F.col("s.n") < F.col("l.n")) | ((F.col("s.n") == F.col("l.n")) & (F.col("s.id") < F.col("l.id")))
    follow = F.least(F.col("s.n") - F.col("s.k"), F.col("l.n") - F.col("l.k")) + 1
    enough = (100 + percent) * follow >= percent * (F.col("s.n") + F.col("l.n"))
    pairs = s.join(l, (F.col("s.x") == F.col("l.x")) & smaller & (F.col("s.c") != F.col("l.c")) & _agree("s.n", "l.n", percent) & enough)
    return pairs.select(F.least("s.id", "l.id").alias("a"), F.greatest("s.id", "l.id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", ident: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of docs.

    A row's set holds the distinct WORDS-word shingles of its text, A-Z lower-cased; a shorter text is one shingle, a
    text without words or a null one none and stays alone. Rows with 100 * shared >= percent * all shingles are linked,
    component_id is the smallest id reachable, kept marks it. A row without an id stays alone, with a null component,
    and is kept. Repeated rows share their component, and of rows of one id that differ in text one stands for all when
    sets are confirmed; texts of any length are read whole; an empty table gives an empty result. Other columns are not
    read.
    """
    sigs = table(signatures(docs, text, ident))
    named = sigs.where(F.col("id").isNotNull() & (F.col("n") > 0))
    classes = table(named.groupBy("fp", "n").agg(F.min("id").alias("id"), F.first("sig").alias("sig")))
    partitions = max(1, min(int(classes.count()) * TREES // ROWS_PER_PARTITION + 1, 20_000))
    rows = forest(classes)
    ordered = rows.repartitionByRange(partitions, "tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    near = table(_neighbours(ordered, percent))
    texts = docs.select(F.col(ident).cast("long").alias("id"), F.col(text))
    if named.groupBy("id").count().where("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["id"])
    large = near.where("d = 0").select(F.col("region").alias("r")).distinct()
    members = table(rows.withColumn("r", _region(MIN_DEPTH)).join(large, "r", "left_semi").select("tree", "key", "id", "n"))
    # Likeliest partners first, then stars, then neighbours, each time only where components still differ. Pairs of large
    # regions need no more than that: what is still apart there is left to the exact rest, which comes last, when a large
    # group has grown together.
    pairs = table(near.where("d > 0").groupBy("a", "b").agg(F.min("d").alias("d"), F.max("agree").alias("agree"), F.max("whole").alias("whole")))
    first = table(_likeliest(pairs.where("d = 1")))
    label = table(components(_confirm(first, texts, percent)))

    def merged(candidates: DataFrame) -> DataFrame:
        more = table(_confirm(table(candidates), texts, percent))
        return table(components(label.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))) if more.limit(1).count() else label

    label = merged(_apart(_stars(members, percent), label))
    near_ = table(_likeliest(_apart(pairs.join(first, ["a", "b"], "left_anti"), label)))
    label = merged(near_)
    label = merged(_apart(pairs.where("whole").join(first.union(near_), ["a", "b"], "left_anti"), label).select("a", "b"))
    label = merged(_rest(members, label, texts, percent))
    of_class = classes.join(label, "id", "left").select("fp", "n", F.coalesce("component", "id").alias("c"))
    out = sigs.select("id", "n", "fp").join(of_class, ["fp", "n"], "left")
    alone = F.col("id").isNull() | (F.col("n") == 0)
    component = F.when(alone, F.col("id")).otherwise(F.col("c"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, text: str = "text", ident: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """The rows of docs of which their group keeps the smallest id, with the same columns; of repeated ids one row stays.

    Nulls, empty and long texts are as in near_duplicates; any column name passes through.
    """
    found = table(near_duplicates(docs, text, ident, percent).where("kept AND id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n")))
    rows = carried(docs, key=F.col(ident).cast("long"))
    # Few enough ids go to the texts; else the texts go to them.
    kept = rows.join(bounded(found.select(F.col("id").alias("key")), BROADCAST_IDS), "key", "left_semi")
    if found.where("n > 1").limit(1).count():
        kept = kept.dropDuplicates(["key"])
    return released(kept.union(rows.where("key IS NULL").select("key", "row")))
