"""Loops: connected sets of links in which every vertex has degree two at least.

Growth is a frontier of link sets. A set with a vertex of degree one only grows at the smallest such vertex, since no
loop can do without a second link there; others grow at any vertex. Each level joins the incidence table once and drops
repeated sets, and sets with more loose ends than the remaining links can mend are not carried on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coords as C
from ..session import let, small, table

_BASE = 1 << 24


def _code(u: Column, w: Column) -> Column:
    return u.cast("long") * _BASE + w


def _ends(codes: Column) -> Column:
    return F.flatten(F.transform(codes, lambda e: F.array(F.floor(e / _BASE).cast("int"), F.pmod(e, F.lit(_BASE)).cast("int"))))


def _loose(codes: Column) -> Column:
    """Vertices of degree one."""
    return let(_ends(codes), lambda x: F.filter(F.array_distinct(x), lambda v: F.size(F.filter(x, lambda y: y == v)) == 1))


def decode(codes: Column) -> Column:
    return F.transform(codes, lambda e: F.struct(F.floor(e / _BASE).cast("int").alias("u"), F.pmod(e, F.lit(_BASE)).cast("int").alias("w")))


def vertices_of(edges: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.transform(edges, lambda e: F.array(e["u"], e["w"])))))


def find(edges: DataFrame, weight: int, at: int | None = None) -> DataFrame:
    """(edges, vertices, weight) of all loops of at most so many links, or of those through the vertex `at`."""
    inc = edges.select(F.explode(F.array("u", "w")).alias("v"), _code(F.col("u"), F.col("w")).alias("e"))
    inc = small(table(inc), 2_000_000)
    seed = edges if at is None else edges.where((F.col("u") == at) | (F.col("w") == at))
    now = seed.select(F.array(_code(F.col("u"), F.col("w"))).alias("s")).distinct()
    found = None
    for n in range(2, weight + 1):
        grown = now.select("s", _loose(F.col("s")).alias("loose"))
        where = F.when(F.size("loose") > 0, F.slice(F.array_sort("loose"), 1, 1)).otherwise(F.array_distinct(_ends(F.col("s"))))
        new = grown.select("s", F.explode(where).alias("v")).join(inc, "v").where(~F.array_contains("s", F.col("e")))
        now = new.select(F.array_sort(F.array_append("s", F.col("e"))).alias("s")).distinct()
        now = table(now.where(F.size(_loose(F.col("s"))) <= 2 * (weight - n)))
        closed = now.where(F.size(_loose(F.col("s"))) == 0)
        found = closed if found is None else found.union(closed)
    e = decode(F.col("s"))
    return (found if found is not None else now.limit(0)).select(e.alias("edges"), vertices_of(e).alias("vertices"), F.size("s").alias("weight"))


def numbered(loops: DataFrame) -> DataFrame:
    """Loops with loop_id, a 64-bit digest of their links: the same loop has the same id in every run."""
    return loops.select(F.xxhash64(C.edge_key(F.col("edges"))).alias("loop_id"), "edges", "vertices", "weight")


def canonical(edges: Column) -> Column:
    """Links with the smaller end first, in ascending order."""
    return F.array_sort(F.transform(edges, lambda e: C.edge(e["u"], e["w"])))


def is_loop(edges: DataFrame) -> DataFrame:
    """(set_id, valid) of (set_id, u, w): two links at least, every degree two at least, connected.

    Only sets that links and degrees leave are tested for being connected.
    """
    from .graph import components

    ends = edges.select("set_id", F.explode(F.array("u", "w")).alias("v"))
    degree = ends.groupBy("set_id", "v").count().groupBy("set_id").agg(F.min("count").alias("least"), F.sum("count").alias("ends"))
    sets = table(degree.select("set_id", ((F.col("ends") >= 4) & (F.col("least") >= 2)).alias("able")))
    edges = table(edges.join(sets.where("able").select("set_id"), "set_id", "left_semi"))
    key = lambda c: F.concat_ws(":", F.col("set_id").cast("string"), F.col(c).cast("string"))
    parts = components(edges.select(key("u").alias("a"), key("w").alias("b")))
    pieces = edges.select("set_id", key("u").alias("id")).join(parts, "id").groupBy("set_id").agg(F.count_distinct("component").alias("parts"))
    return sets.join(pieces, "set_id", "left").select("set_id", F.coalesce(F.col("able") & (F.col("parts") == 1), F.lit(False)).alias("valid"))


def _moved(edges: Column, di, dj, L: int, boundary: str) -> Column:
    return F.array_sort(F.transform(edges, lambda e: C.edge(C.translate(e["u"], di, dj, L, boundary), C.translate(e["w"], di, dj, L, boundary))))


def _shifts(loops: DataFrame, L: int, low: int, high: int) -> DataFrame:
    spark = loops.sparkSession
    n = high - low
    grid = spark.range(n * n).select((F.floor(F.col("id") / n) + low).cast("int").alias("di"), (F.col("id") % n + low).cast("int").alias("dj"))
    return loops.join(F.broadcast(grid))


def translates(loops: DataFrame, L: int, boundary: str = "periodic", compat: bool = False) -> DataFrame:
    """All distinct translates of the loops; open boundaries keep those inside. compat tells translates apart by their vertices only."""
    periodic = boundary == "periodic"
    moved = _shifts(loops, L, 0 if periodic else -L, L if periodic else L + 1).select(_moved(F.col("edges"), F.col("di"), F.col("dj"), L, boundary).alias("edges"), "weight")
    inside = moved if periodic else moved.where(F.forall("edges", lambda e: e["u"] > 0))
    out = inside.select("edges", vertices_of(F.col("edges")).alias("vertices"), "weight")
    if compat:
        return out.groupBy("vertices").agg(F.min(F.struct("weight", "edges")).alias("x")).select("x.edges", "vertices", "x.weight")
    return out.distinct()


def translation_classes(loops: DataFrame, L: int) -> DataFrame:
    """(key, edges, vertices, weight): one loop of each class under translations of the torus, its least translate."""
    least = _shifts(loops.select("edges", "weight"), L, 0, L).groupBy("edges", "weight").agg(F.min(_moved(F.col("edges"), F.col("di"), F.col("dj"), L, "periodic")).alias("key"))
    return least.select("key", "weight").distinct().select(C.edge_key(F.col("key")).alias("key"), F.col("key").alias("edges"), vertices_of(F.col("key")).alias("vertices"), "weight")


def square_images(loops: DataFrame, L: int) -> DataFrame:
    """(edges, k, image): each loop under the eight symmetries of the torus about its origin."""
    def image(v: Column, k: int) -> Column:
        i, j = C.square_image(C.row_of(v, L) - 1, C.col_of(v, L) - 1, k)
        return C.site(C.wrap(i + 1, L), C.wrap(j + 1, L), L)

    def moved(k: int) -> Column:
        return F.array_sort(F.transform("edges", lambda e: C.edge(image(e["u"], k), image(e["w"], k))))

    images = [F.struct(F.lit(k).alias("k"), moved(k).alias("image")) for k in range(8)]
    return loops.select("edges", F.explode(F.array(*images)).alias("x")).select("edges", "x.k", "x.image")


def square_classes(loops: DataFrame, L: int) -> DataFrame:
    """(key, edges): each loop's least key under the eight symmetries."""
    return square_images(loops, L).groupBy("edges").agg(F.min(C.edge_key(F.col("image"))).alias("key"))


def unwrapped(vertices: Column, L: int) -> Column:
    """Coordinates moved to start at (0, 0) after the torus is cut at the widest gap of each axis, ascending."""
    def axis(of) -> Column:
        x = F.array_sort(F.array_distinct(F.transform(vertices, of)))
        # The largest gap ends at the start; the gap before the first value goes around.
        gaps = let(x, lambda s: F.transform(s, lambda v, k: F.struct((F.when(k == 0, v + L - F.get(s, F.size(s) - 1)).otherwise(v - F.get(s, k - 1))).alias("gap"), (-v).alias("v"))))
        return -F.array_max(gaps)["v"]

    return let(F.struct(axis(lambda v: C.row_of(v, L)).alias("i"), axis(lambda v: C.col_of(v, L)).alias("j")), lambda o: F.array_sort(F.transform(vertices, lambda v: F.struct(F.pmod(C.row_of(v, L) - o["i"], F.lit(L)).alias("i"), F.pmod(C.col_of(v, L) - o["j"], F.lit(L)).alias("j")))))


def within(edges: DataFrame, centre: int, reach: int, L: int, boundary: str = "periodic") -> DataFrame:
    """The links whose both ends are within the distance of a site."""
    near = lambda c: C.distance(F.col(c), F.lit(centre), L, boundary) <= reach
    return edges.where(near("u") & near("w"))


def statistics(loops: DataFrame) -> DataFrame:
    """(weight, n, mean_vertices, branched): loops by weight, and how many have a vertex of degree above two."""
    ends = F.flatten(F.transform("edges", lambda e: F.array(e["u"], e["w"])))
    return loops.withColumn("b", (F.size(ends) > 2 * F.size("vertices")).cast("int")).groupBy("weight").agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("vertices")).alias("mean_vertices"), F.sum("b").alias("branched"))


def walks(spark, length: int) -> DataFrame:
    """(steps, n): closed self-avoiding walks from the origin of the infinite square lattice, both directions counted."""
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))]))
    now = spark.range(1).select(F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"))).alias("path"))
    counts = None
    for n in range(1, length + 1):
        tip = F.element_at("path", -1)
        to = now.select("path", step.alias("s")).select("path", F.struct((tip["x"] + F.col("s.a")).alias("x"), (tip["y"] + F.col("s.b")).alias("y")).alias("to"))
        home = to.where((F.col("to.x") == 0) & (F.col("to.y") == 0)) if n > 2 else to.limit(0)
        here = home.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("steps"), "n")
        counts = here if counts is None else counts.union(here)
        left = length - n
        now = table(to.where(~F.array_contains("path", F.col("to")) & (F.abs(F.col("to.x")) + F.abs(F.col("to.y")) <= left)).select(F.array_append("path", F.col("to")).alias("path")))
    return counts.where("n > 0")


def feasible(vertices: Column, edges: Column) -> Column:
    """Whether so many edges may form a loop on so many vertices: each has two links or more, and on average six or fewer."""
    return (edges >= vertices) & (edges <= 3 * vertices)


def reasonable(vertices: Column, new: Column, L: int) -> Column:
    """Whether a vertex is near enough to extend a loop: any for up to four vertices, else within min(L / 2, 4) of the smallest."""
    return (F.size(vertices) <= 4) | (C.distance(F.array_min(vertices), new, L) <= min(L // 2, 4))
