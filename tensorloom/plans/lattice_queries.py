"""Queries on generated lattices, networks and codes: parameters instead of tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import coords as C
from ..functions import physics
from ..operators import bp, clusters, codes, contract, exact, loops, series, small, stats
from ..operators.graph import components
from ..session import shared_dir, table
from ..sources import codes as code_sources
from ..sources import lattices, tensors
from . import decoding, ising
from .registry import query, read

# Shared pieces of SQL: sites and edges of an L x L torus, its cyclic slots, Ising entries.
SITES = "sites AS (SELECT CAST(v AS INTEGER) AS v, CAST((v - 1) // {L} + 1 AS INTEGER) AS i, CAST((v - 1) % {L} + 1 AS INTEGER) AS j FROM range(1, {L} * {L} + 1) t(v))"
EDGES = SITES + """, hops AS (SELECT v, CAST((i - 1) * {L} + j % {L} + 1 AS INTEGER) AS x FROM sites UNION ALL SELECT v, CAST((i % {L}) * {L} + j AS INTEGER) FROM sites),
edges AS (SELECT DISTINCT least(v, x) AS u, greatest(v, x) AS w FROM hops)"""
SLOTS = SITES + """, slots AS (
  SELECT v, 0 AS slot, CAST(((i - 2 + {L}) % {L}) * {L} + j AS INTEGER) AS nbr FROM sites UNION ALL SELECT v, 1, CAST((i - 1) * {L} + j % {L} + 1 AS INTEGER) FROM sites
  UNION ALL SELECT v, 2, CAST((i % {L}) * {L} + j AS INTEGER) FROM sites UNION ALL SELECT v, 3, CAST((i - 1) * {L} + (j - 2 + {L}) % {L} + 1 AS INTEGER) FROM sites)"""
ENTRIES = """bits AS (SELECT a.k AS a, b.k AS b, c.k AS c, d.k AS d FROM range(1, 3) a(k), range(1, 3) b(k), range(1, 3) c(k), range(1, 3) d(k)),
entries AS (SELECT *, exp(-{beta} * ((3 - 2 * a) * (3 - 2 * b) + (3 - 2 * b) * (3 - 2 * c) + (3 - 2 * c) * (3 - 2 * d) + (3 - 2 * d) * (3 - 2 * a))) AS t FROM bits)"""

#: Loops of weight 4, 6 and 7 of an L x L torus, L > 6, or of those with a winding part at L = 6, as lists of sites from 0: (w, h, b, i, j, v); a domino with its middle link has weight 7.
SMALL = """home AS (SELECT i, j FROM range(0, {L}) a(i), range(0, {L}) b(j)),
small AS (
  SELECT k.w, k.h, k.b, i, j, list_transform(range(0, k.h * k.b), lambda x: (i + x // k.b) % {L} * {L} + (j + x % k.b) % {L}) AS v FROM home, (VALUES (4, 2, 2), (6, 2, 3), (6, 3, 2), (7, 2, 3), (7, 3, 2)) k(w, h, b)
  UNION ALL SELECT 6, 1, 6, i, 0, list_transform(range(0, 6), lambda x: i * 6 + x) FROM home WHERE j = 0 AND {L} = 6
  UNION ALL SELECT 6, 6, 1, 0, j, list_transform(range(0, 6), lambda x: x * 6 + j) FROM home WHERE i = 0 AND {L} = 6
)"""


def _flat(edges):
    return C.edge_key(edges)


@query("lattice_periodic", "WITH " + EDGES.format(L=6) + " SELECT u, w FROM edges")
def lattice_periodic(spark, sf_dir):
    return lattices.square(spark, 6)


@query("lattice_open", "WITH " + SITES.format(L=6) + " SELECT v AS u, v + 1 AS w FROM sites WHERE j < 6 UNION ALL SELECT v, v + 6 FROM sites WHERE i < 6")
def lattice_open(spark, sf_dir):
    return lattices.square(spark, 6, "open")


@query("centre_site", "SELECT CAST(L AS INTEGER) AS L, CAST(((L + 1) // 2 - 1) * L + (L + 1) // 2 AS INTEGER) AS centre FROM range(1, 13) t(L)")
def centre_site(spark, sf_dir):
    return spark.range(1, 13).select(F.col("id").cast("int").alias("L"), C.centre_site(F.col("id")).alias("centre"))


@query("site_coords", "WITH " + SITES.format(L=7) + " SELECT v, i, j, CAST((i - 1) * 7 + j AS INTEGER) AS back, CAST(CASE WHEN i < 7 THEN v + 7 ELSE -1 END AS INTEGER) AS below FROM sites")
def site_coords(spark, sf_dir):
    s = lattices.sites(spark, 7)
    return s.select("v", "i", "j", C.site(F.col("i"), F.col("j"), 7).alias("back"), C.translate(F.col("v"), 1, 0, 7, "open").alias("below"))


@query("lattice_distance", "WITH " + SITES.format(L=5) + " SELECT a.v AS a, b.v AS b, least(abs(a.i - b.i), 5 - abs(a.i - b.i)) + least(abs(a.j - b.j), 5 - abs(a.j - b.j)) AS periodic, abs(a.i - b.i) + abs(a.j - b.j) AS open FROM sites a, sites b")
def lattice_distance(spark, sf_dir):
    s = lattices.sites(spark, 5).select("v")
    j = s.withColumnRenamed("v", "a").join(s.withColumnRenamed("v", "b"), how="cross")
    return j.select("a", "b", C.distance(F.col("a"), F.col("b"), 5).alias("periodic"), C.distance(F.col("a"), F.col("b"), 5, "open").alias("open"))


@query("sites_within", "WITH " + SITES.format(L=9) + " SELECT v FROM sites WHERE least(abs(i - 5), 9 - abs(i - 5)) + least(abs(j - 5), 9 - abs(j - 5)) <= 3")
def sites_within(spark, sf_dir):
    return lattices.sites(spark, 9).where(C.distance(F.col("v"), F.lit(41), 9) <= 3).select("v")


@query("nishimori_beta", "SELECT CAST(k AS INTEGER) AS k, round(-0.5 * ln((k / 1000.0) / (1 - k / 1000.0)), 9) AS beta FROM range(1, 400) t(k)")
def nishimori(spark, sf_dir):
    return spark.range(1, 400).select(F.col("id").cast("int").alias("k"), F.round(physics.nishimori_beta(F.col("id") / 1000.0), 9).alias("beta"))


@query("bethe_critical_beta", "SELECT l_partkey AS part, CAST(count(DISTINCT l_suppkey) AS INTEGER) AS q, round(0.5 * ln(count(DISTINCT l_suppkey) / (count(DISTINCT l_suppkey) - 2.0)), 9) AS beta, round(0.5 * ln(1 + sqrt(2)), 9) AS exact FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 2")
def critical(spark, sf_dir):
    """The critical coupling at each part's number of suppliers, beside that of the square lattice."""
    q = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct().groupBy(F.col("l_partkey").alias("part")).agg(F.count("l_suppkey").cast("int").alias("q")).where("q > 2")
    return q.select("part", "q", F.round(physics.bethe_critical_beta(F.col("q").cast("double")), 9).alias("beta"), F.round(F.lit(physics.CRITICAL_BETA), 9).alias("exact"))


@query("param_grid", "SELECT row_number() OVER (ORDER BY n, w, eta) AS task, n, w, eta FROM (VALUES (5), (10)) a(n), (VALUES (4), (6), (8), (10)) b(w), (SELECT CAST(k AS DOUBLE) / 10 AS eta FROM range(1, 11) t(k)) c")
def param_grid(spark, sf_dir):
    return stats.grid(spark, {"n": [5, 10], "w": [4, 6, 8, 10], "eta": [k / 10 for k in range(1, 11)]})


@query("ising_tensors", "WITH " + SITES.format(L=3) + ", b(beta) AS (VALUES (0.1), (0.3)), " + ENTRIES.format(beta="CAST(0 AS DOUBLE)") + " SELECT CAST(beta AS DOUBLE) AS beta, v, concat_ws(',', a, b, c, d) AS idx, round(exp(-CAST(beta AS DOUBLE) * ((3 - 2 * a) * (3 - 2 * b) + (3 - 2 * b) * (3 - 2 * c) + (3 - 2 * c) * (3 - 2 * d) + (3 - 2 * d) * (3 - 2 * a))), 9) AS re FROM sites, b, bits")
def ising_tensors(spark, sf_dir):
    t, _ = tensors.ising(spark, 3, [0.1, 0.3])
    return t.select(F.col("g").alias("beta"), "v", F.array_join(F.col("idx").cast("array<string>"), ",").alias("idx"), F.round("re", 9).alias("re"))


@query("onsager", "WITH b(beta) AS (VALUES (0.1), (0.2), (0.3), (0.35)), g AS (SELECT cos((x + 0.5) * pi() / 400) + cos((y + 0.5) * pi() / 400) AS c FROM range(0, 400) a(x), range(0, 400) b(y)) SELECT CAST(beta AS DOUBLE) AS beta, round(-(ln(2) + avg(ln(cosh(2 * beta) * cosh(2 * beta) - sinh(2 * beta) * c)) / 2), 8) AS f FROM g, b GROUP BY beta")
def onsager(spark, sf_dir):
    points = spark.createDataFrame([(0.1,), (0.2,), (0.3,), (0.35,)], "beta double")
    return physics.onsager(spark, points).select("beta", F.round("f_exact", 8).alias("f"))


MEANS = "means AS (SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INTEGER) AS month, avg(l_quantity) / 100 AS beta FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1 HAVING count(l_quantity) > 0)"


def _months(spark, sf_dir):
    """(g, beta): the lines' mean quantity, in hundreds, for each month of shipment."""
    lines = read(spark, sf_dir, "lineitem").where("l_shipdate IS NOT NULL AND l_quantity IS NOT NULL")
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).cast("double")
    return table(lines.groupBy(month.alias("g")).agg((F.avg("l_quantity") / 100).alias("beta")))


@query("bethe_free_energy", "WITH " + MEANS + " SELECT month, round(beta, 9) AS beta, round(-(ln(2) + 2 * ln(cosh(beta)) + 0.5 * ln(1 + pow(tanh(beta), 4))), 8) AS f FROM means")
def bethe_free_energy(spark, sf_dir):
    """At the coupling of each month of shipment."""
    points = _months(spark, sf_dir)
    return ising.bethe_at(spark, 4, points).join(points, "g").select(F.col("g").cast("int").alias("month"), F.round("beta", 9).alias("beta"), F.round("f_bp", 8).alias("f"))


@query("bethe_vs_exact", "WITH " + MEANS + ", g AS (SELECT cos((x + 0.5) * pi() / 400) + cos((y + 0.5) * pi() / 400) AS c FROM range(0, 400) a(x), range(0, 400) b(y)), e AS (SELECT month, beta, -(ln(2) + avg(ln(cosh(2 * beta) * cosh(2 * beta) - sinh(2 * beta) * c)) / 2) AS f FROM g, means GROUP BY month, beta) SELECT month, round(-(ln(2) + 2 * ln(cosh(beta)) + 0.5 * ln(1 + pow(tanh(beta), 4))) - f, 7) AS gap FROM e")
def bethe_vs_exact(spark, sf_dir):
    """At the coupling of each month of shipment."""
    return ising.compare_at(spark, 4, _months(spark, sf_dir)).select(F.col("g").cast("int").alias("month"), F.round(F.col("f_bp") - F.col("f_exact"), 7).alias("gap"))


def _tilted(slots):
    """Messages that differ from link to link, for single steps."""
    a, b = F.lit(1.0), 0.3 + 0.1 * F.pmod(F.col("nbr") * 7 + F.col("v") * 3, F.lit(5))
    n = F.sqrt(a * a + b * b)
    return slots.select(F.lit(0.3).alias("g"), F.col("nbr").alias("src"), F.col("v").alias("dst"), F.array(a / n, b / n).alias("m"))


MESSAGES = """msg AS (SELECT nbr AS src, v AS dst, CASE k WHEN 1 THEN 1.0 ELSE 0.3 + 0.1 * ((nbr * 7 + v * 3) % 5) END / sqrt(1 + pow(0.3 + 0.1 * ((nbr * 7 + v * 3) % 5), 2)) AS m, k FROM slots, range(1, 3) r(k)),
inn AS (SELECT s.v, s.slot, s.nbr, m.k, m.m FROM slots s JOIN msg m ON m.src = s.nbr AND m.dst = s.v)"""
STEP = "WITH " + SLOTS.format(L=3) + ", " + ENTRIES.format(beta="CAST(0.3 AS DOUBLE)") + ", " + MESSAGES + """,
legs AS (SELECT e.t, v0.v, [a, b, c, d] AS idx, [v0.m, v1.m, v2.m, v3.m] AS m, [v0.nbr, v1.nbr, v2.nbr, v3.nbr] AS nbr FROM entries e
  JOIN inn v0 ON v0.slot = 0 AND v0.k = a JOIN inn v1 ON v1.v = v0.v AND v1.slot = 1 AND v1.k = b JOIN inn v2 ON v2.v = v0.v AND v2.slot = 2 AND v2.k = c JOIN inn v3 ON v3.v = v0.v AND v3.slot = 3 AND v3.k = d),
raw AS (SELECT v AS src, nbr[o] AS dst, idx[o] AS k, sum(t * m[1] * m[2] * m[3] * m[4] / m[o]) AS x FROM legs, range(1, 5) r(o) GROUP BY ALL),
new AS (SELECT src, dst, k, x / sqrt(sum(x * x) OVER (PARTITION BY src, dst)) AS x FROM raw)"""


# The 3 x 3 torus of the nine tax rates, a parameter point g for each year of shipment: a rate's mean quantity, in hundreds, is its coupling.
RATES = """cells AS (SELECT CAST(year(l_shipdate) AS DOUBLE) AS g, CAST((CAST(round(l_tax * 100) AS INTEGER) % 9 + 9) % 9 + 1 AS INTEGER) AS v, avg(l_quantity) / 100 AS beta FROM lineitem WHERE l_shipdate IS NOT NULL AND l_tax IS NOT NULL GROUP BY 1, 2),
points AS (SELECT DISTINCT g FROM cells)"""
RATES_STEP = "WITH " + SLOTS.format(L=3) + ", " + RATES + ", net AS (SELECT g, v, coalesce(beta, 0) AS beta FROM points CROSS JOIN sites LEFT JOIN cells USING (g, v)), " + ENTRIES.format(beta="beta").replace("FROM bits", "FROM net, bits") + ", " + MESSAGES + """,
legs AS (SELECT e.g, e.t, e.v, [a, b, c, d] AS idx, [v0.m, v1.m, v2.m, v3.m] AS m, [v0.nbr, v1.nbr, v2.nbr, v3.nbr] AS nbr FROM entries e
  JOIN inn v0 ON v0.v = e.v AND v0.slot = 0 AND v0.k = a JOIN inn v1 ON v1.v = e.v AND v1.slot = 1 AND v1.k = b JOIN inn v2 ON v2.v = e.v AND v2.slot = 2 AND v2.k = c JOIN inn v3 ON v3.v = e.v AND v3.slot = 3 AND v3.k = d),
raw AS (SELECT g, v AS src, nbr[o] AS dst, idx[o] AS k, sum(t * m[1] * m[2] * m[3] * m[4] / m[o]) AS x FROM legs, range(1, 5) r(o) GROUP BY ALL),
new AS (SELECT g, src, dst, k, x / sqrt(sum(x * x) OVER (PARTITION BY g, src, dst)) AS x FROM raw)"""
RATES_LOCAL = RATES_STEP + """, ov AS (SELECT a.src AS u, a.dst AS w, sum(a.m * b.m) AS o FROM msg a JOIN msg b ON a.src = b.dst AND a.dst = b.src AND a.k = b.k GROUP BY a.src, a.dst),
whole AS (SELECT g, v, sum(t * m[1] * m[2] * m[3] * m[4]) AS z FROM legs GROUP BY g, v),
norm AS (SELECT v, exp(sum(ln(o)) / 2) AS n FROM slots s JOIN ov ON ov.u = s.v AND ov.w = s.nbr GROUP BY v),
z AS (SELECT g, v, z / n AS z FROM whole JOIN norm USING (v))"""


def _cells(spark, sf_dir):
    """(g, v, beta): for each year of shipment and tax rate, rates counted from 1 to 9, the lines' mean quantity in hundreds."""
    rate = F.pmod(F.round(F.col("l_tax") * 100).cast("int"), F.lit(9)) + 1
    lines = read(spark, sf_dir, "lineitem").select(F.year("l_shipdate").cast("double").alias("g"), rate.cast("int").alias("v"), "l_quantity").where("g IS NOT NULL AND v IS NOT NULL")
    return table(lines.groupBy("g", "v").agg((F.avg("l_quantity") / 100).alias("beta")))


def _rates(spark, sf_dir):
    """(tensors, slots, messages): the torus of the tax rates for each year of shipment; a rate without lines has no coupling. Messages differ from link to link."""
    cells, slots = _cells(spark, sf_dir), tensors.square_slots(spark, 3)
    points = cells.select("g").distinct()
    net = points.join(lattices.sites(spark, 3).select("v")).join(cells, ["g", "v"], "left")
    entries = net.join(tensors.index_rows(spark, 4, 2)).select("g", "v", "idx", tensors.ising_entry(F.col("idx"), F.coalesce("beta", F.lit(0.0))).alias("re"))
    return table(entries), slots, points.join(_tilted(slots).drop("g"))


@query("bp_start", "WITH " + SLOTS.format(L=3) + " SELECT nbr AS src, v AS dst, CAST(k AS INTEGER) AS k, round(1 / sqrt(2), 9) AS m FROM slots, range(1, 3) r(k)")
def bp_start(spark, sf_dir):
    t, s = tensors.ising(spark, 3, [0.3])
    return bp.start(t, s).select("src", "dst", F.posexplode("m").alias("k", "m")).select("src", "dst", (F.col("k") + 1).alias("k"), F.round("m", 9).alias("m"))


@query("bp_step", STEP + " SELECT src, dst, CAST(k AS INTEGER) AS k, round(x, 9) AS m FROM new")
def bp_step(spark, sf_dir):
    t, s = tensors.ising(spark, 3, [0.3])
    out = bp.step(t, s, _tilted(s))
    return out.select("src", "dst", F.posexplode("m").alias("k", "m")).select("src", "dst", (F.col("k") + 1).alias("k"), F.round("m", 9).alias("m"))


@query("bp_selective", RATES_STEP + ", chosen AS (SELECT * FROM new WHERE least(src, dst) = 1) SELECT CAST(p.g AS INTEGER) AS year, m.src, m.dst, CAST(m.k AS INTEGER) AS k, round(coalesce(o.x, m.m), 9) AS m FROM points p CROSS JOIN msg m LEFT JOIN chosen o ON o.g = p.g AND o.src = m.src AND o.dst = m.dst AND o.k = m.k")
def bp_selective(spark, sf_dir):
    out = bp.step(*_rates(spark, sf_dir), only=lattices.square(spark, 3).where("u = 1"))
    return out.select(F.col("g").cast("int").alias("year"), "src", "dst", F.posexplode("m").alias("k", "m")).select("year", "src", "dst", (F.col("k") + 1).alias("k"), F.round("m", 9).alias("m"))


@query("bp_residual", RATES_STEP + ", d AS (SELECT g, sqrt(sum(pow(n.x - m.m, 2))) AS d FROM new n JOIN msg m ON m.src = n.src AND m.dst = n.dst AND m.k = n.k GROUP BY g, n.src, n.dst) SELECT CAST(g AS INTEGER) AS year, round(sum(d), 8) AS total, round(max(d), 8) AS largest FROM d GROUP BY g")
def bp_residual(spark, sf_dir):
    return bp.residual(*_rates(spark, sf_dir)).select(F.col("g").cast("int").alias("year"), F.round("total", 8).alias("total"), F.round("largest", 8).alias("largest"))


@query("bp_fixed_point", "WITH " + SLOTS.format(L=4) + " SELECT nbr AS src, v AS dst, round(1 / sqrt(2), 7) AS m1, round(1 / sqrt(2), 7) AS m2 FROM slots")
def bp_fixed_point(spark, sf_dir):
    t, s = tensors.ising(spark, 4, [0.1])
    a, b = F.lit(1.0), 0.8 + 0.05 * F.pmod(F.col("nbr") + F.col("v"), F.lit(3))
    n = F.sqrt(a * a + b * b)
    start = s.select(F.lit(0.1).alias("g"), F.col("nbr").alias("src"), F.col("v").alias("dst"), F.array(a / n, b / n).alias("m"))
    m = bp.fixed_point(t, s, start, tolerance=1e-9, rounds=60)
    return m.select("src", "dst", F.round(F.col("m")[0], 7).alias("m1"), F.round(F.col("m")[1], 7).alias("m2"))


LOCAL = STEP + """, ov AS (SELECT a.src AS u, a.dst AS w, sum(a.m * b.m) AS o FROM msg a JOIN msg b ON a.src = b.dst AND a.dst = b.src AND a.k = b.k GROUP BY a.src, a.dst),
whole AS (SELECT v, sum(t * m[1] * m[2] * m[3] * m[4]) AS z FROM legs GROUP BY v),
norm AS (SELECT v, exp(sum(ln(o)) / 2) AS n FROM slots s JOIN ov ON ov.u = s.v AND ov.w = s.nbr GROUP BY v),
z AS (SELECT v, z / n AS z FROM whole JOIN norm USING (v))"""


@query("bp_local_z", RATES_LOCAL + " SELECT CAST(g AS INTEGER) AS year, v, round(z, 8) AS z FROM z")
def bp_local_z(spark, sf_dir):
    return bp.local_z(*_rates(spark, sf_dir)).select(F.col("g").cast("int").alias("year"), "v", F.round("z", 8).alias("z"))


@query("bp_partition", RATES_LOCAL + " SELECT CAST(g AS INTEGER) AS year, round(sum(ln(z)), 7) AS logz, round(sum(CASE WHEN v <= 3 THEN ln(z) END), 7) AS row FROM z GROUP BY g")
def bp_partition(spark, sf_dir):
    z = table(bp.local_z(*_rates(spark, sf_dir)))
    row = spark.range(1, 4).select(F.col("id").cast("int").alias("v"))
    both = bp.log_partition(z).select("g", F.round("logz", 7).alias("logz")).join(bp.log_partition(z, row).select("g", F.round("logz", 7).alias("row")), "g")
    return both.select(F.col("g").cast("int").alias("year"), "logz", "row")


@query("normalised_tensors", LOCAL + " SELECT v, concat_ws(',', a, b, c, d) AS idx, round(t / z, 8) AS re FROM z, entries")
def normalised_tensors(spark, sf_dir):
    t, s = tensors.ising(spark, 3, [0.3])
    return bp.normalise(t, bp.local_z(t, s, _tilted(s))).select("v", F.array_join(F.col("idx").cast("array<string>"), ",").alias("idx"), F.round("re", 8).alias("re"))


@query("excited_edge", LOCAL + " SELECT a.dst AS u, a.src AS w, CAST(a.k AS INTEGER) AS a, CAST(b.k AS INTEGER) AS b, round((a.k = b.k)::INTEGER - a.m * b.m / o, 8) AS re FROM msg a JOIN msg b ON a.src = b.dst AND a.dst = b.src JOIN ov ON ov.u = a.dst AND ov.w = a.src WHERE a.dst < a.src")
def excited_edge(spark, sf_dir):
    _, s = tensors.ising(spark, 3, [0.3])
    return bp.excited(_tilted(s)).select("u", "w", "a", "b", F.round("re", 8).alias("re"))


PLAQUETTE = """WITH {entries}, p AS (SELECT a.k AS x, b.k AS y, (a.k = b.k)::INTEGER - 0.5 AS q FROM range(1, 3) a(k), range(1, 3) b(k)), z AS (SELECT sum(t) / 4 AS z FROM entries),
-- A corner keeps two neighbouring legs; the others are closed with uniform messages.
corner AS (SELECT a AS x, b AS y, sum(t) / 2 / (SELECT z FROM z) AS m FROM entries GROUP BY a, b),
half AS (SELECT c.x, p.y, sum(c.m * p.q) AS m FROM corner c JOIN p ON c.y = p.x GROUP BY c.x, p.y),
two AS (SELECT a.x, b.y, sum(a.m * b.m) AS m FROM half a JOIN half b ON a.y = b.x GROUP BY a.x, b.y)
SELECT round(sum(a.m * b.m), 8) AS z FROM two a JOIN two b ON a.y = b.x AND a.x = b.y"""


@query("loop_contribution", PLAQUETTE.format(entries=ENTRIES.format(beta="CAST(0.3 AS DOUBLE)")))
def loop_contribution(spark, sf_dir):
    one = loops.numbered(loops.find(lattices.square(spark, 6), 4, at=1)).limit(1)
    t, s = tensors.ising(spark, 6, [0.3])
    return bp.loop_contributions(t, s, bp.start(t, s), one).select(F.round("z", 8).alias("z"))


@query("contract_full", """WITH s AS (SELECT k, list_transform(range(0, 18), lambda x: 1 - 2 * ((k >> x) & 1)) AS h FROM range(0, 262144) t(k))
SELECT round(ln(sum(exp(-0.3 * e))), 7) AS logz FROM (SELECT (
""" + " + ".join(f"(h[{u}] * h[{r}] + h[{r}] * h[{d}] + h[{d}] * h[{l}] + h[{l}] * h[{u}])" for u, r, d, l in [(3 * ((i - 1) % 3) + j + 1, 9 + 3 * i + j + 1, 3 * i + j + 1, 9 + 3 * i + (j - 1) % 3 + 1) for i in range(3) for j in range(3)]) + ") AS e FROM s)")
def contract_full(spark, sf_dir):
    t, s = tensors.ising(spark, 3, [0.3])
    return contract.contract_network(t, s).select(F.round(F.log("re"), 7).alias("logz"))


@query("contract_rows", """WITH s AS (SELECT list_transform(range(0, 9), lambda x: 1 - 2 * ((k >> x) & 1)) AS h FROM range(0, 512) t(k)), b(beta) AS (VALUES (0.1), (0.4))
SELECT CAST(beta AS DOUBLE) AS beta, round(ln(sum(exp(CAST(beta AS DOUBLE) * (""" + " + ".join(f"h[{3 * i + j + 1}] * (h[{3 * i + (j + 1) % 3 + 1}] + h[{3 * ((i + 1) % 3) + j + 1}])" for i in range(3) for j in range(3)) + ")))), 7) AS logz FROM s, b GROUP BY beta")
def contract_rows(spark, sf_dir):
    return exact.ising_rows(spark, 3, [0.1, 0.4]).select("beta", F.round("logz", 7).alias("logz"))


GROW = """WITH RECURSIVE """ + EDGES + """,
grow AS (
  SELECT list_sort([u * 10000 + w]) AS s, 1 AS n FROM edges WHERE {seed}
  UNION
  SELECT list_sort(list_append(s, e.u * 10000 + e.w)) AS s, n + 1 AS n FROM grow, edges e
  WHERE n < {W} AND NOT list_contains(s, e.u * 10000 + e.w) AND list_has_any(list_concat(list_transform(s, lambda x: x // 10000), list_transform(s, lambda x: x % 10000)), [e.u, e.w])
),
found AS (SELECT s, n, list_concat(list_transform(s, lambda x: x // 10000), list_transform(s, lambda x: x % 10000)) AS ends FROM grow),
loops AS (SELECT s, n, ends FROM found WHERE len(list_filter(ends, lambda x: len(list_filter(ends, lambda y: y = x)) < 2)) = 0)"""
TEXT = "list_aggregate(list_transform(s, lambda x: (x // 10000)::VARCHAR || '-' || (x % 10000)::VARCHAR), 'string_agg', ';')"


@query("loops_on_vertex", GROW.format(L=4, W=5, seed="u = 1 OR w = 1") + f" SELECT DISTINCT {TEXT} AS edges, n AS weight FROM loops")
def loops_on_vertex(spark, sf_dir):
    return loops.find(lattices.square(spark, 4), 5, at=1).select(_flat(F.col("edges")).alias("edges"), "weight")


@query("all_loops", """WITH RECURSIVE cells AS (SELECT CAST(round(l_discount * 100) AS INTEGER) + 1 AS u, CAST(round(l_tax * 100) AS INTEGER) + 1001 AS w, avg(l_quantity) AS q FROM lineitem WHERE l_discount BETWEEN 0 AND 1 AND l_tax >= 0 GROUP BY 1, 2),
edges AS (SELECT u, w FROM cells WHERE q > (SELECT avg(l_quantity) FROM lineitem)),
""" + GROW[GROW.index("grow AS") :].format(W=4, seed="true") + f" SELECT DISTINCT {TEXT} AS edges, n AS weight FROM loops")
def all_loops(spark, sf_dir):
    """Loops of discounts and tax rates, in percent: linked where lines with both are of more than the mean quantity."""
    line = read(spark, sf_dir, "lineitem")
    percent = lambda c, first: (F.round(F.col(c) * 100).cast("int") + first).cast("int")
    cells = line.where("l_discount BETWEEN 0 AND 1 AND l_tax >= 0").groupBy(percent("l_discount", 1).alias("u"), percent("l_tax", 1001).alias("w")).agg(F.avg("l_quantity").alias("q"))
    edges = table(cells.join(F.broadcast(line.agg(F.avg("l_quantity").alias("mean")))).where("q > mean").select("u", "w"))
    return loops.find(edges, 4).select(_flat(F.col("edges")).alias("edges"), "weight")


@query("loop_counts", "SELECT * FROM (VALUES (10, 4, 4), (10, 6, 12), (10, 7, 12), (10, 8, 70)) t(L, weight, n)")
def loop_counts(spark, sf_dir):
    found = loops.find(lattices.square(spark, 10), 8, at=1)
    return found.groupBy("weight").agg(F.count(F.lit(1)).cast("int").alias("n")).select(F.lit(10).alias("L"), "weight", "n")


@query("loop_stats", "WITH " + SMALL.format(L=6) + " SELECT w AS weight, CAST(count(*) AS INTEGER) AS n, round(avg(len(v)), 1) AS mean_vertices, CAST(sum((w = 7)::INTEGER) AS INTEGER) AS branched FROM small GROUP BY w")
def loop_stats(spark, sf_dir):
    out = loops.statistics(loops.find(lattices.square(spark, 6), 7))
    return out.select("weight", F.col("n").cast("int").alias("n"), F.round("mean_vertices", 1).alias("mean_vertices"), F.col("branched").cast("int").alias("branched"))


@query("translation_classes", "SELECT * FROM (VALUES (4, 1), (6, 2), (7, 2), (8, 9)) t(weight, classes)")
def translation_classes(spark, sf_dir):
    one = loops.find(lattices.square(spark, 10), 8, at=1)
    return loops.translation_classes(one, 10).groupBy("weight").agg(F.count(F.lit(1)).cast("int").alias("classes"))


@query("translates_periodic", "WITH " + SMALL.format(L=11) + " SELECT w AS weight, CAST(count(*) AS INTEGER) AS n FROM small WHERE w < 7 GROUP BY w")
def translates_periodic(spark, sf_dir):
    one = loops.find(lattices.square(spark, 11), 6, at=1)
    return loops.translates(one, 11).groupBy("weight").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("translates_open", "WITH " + SMALL.format(L=6) + " SELECT w AS weight, CAST(count(*) AS INTEGER) AS n FROM small WHERE i + h <= 6 AND j + b <= 6 AND h > 1 AND b > 1 GROUP BY w")
def translates_open(spark, sf_dir):
    centre = loops.find(lattices.square(spark, 6, "open"), 7, at=15)
    return loops.translates(centre, 6, "open").groupBy("weight").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("square_classes", "SELECT * FROM (VALUES (4, 4, 1), (6, 12, 2)) t(weight, n, classes)")
def square_classes(spark, sf_dir):
    one = loops.find(lattices.square(spark, 7), 6, at=1)
    keys = loops.square_classes(one, 7).join(one.select("edges", "weight"), "edges")
    return keys.groupBy("weight").agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_distinct("key").cast("int").alias("classes"))


@query("unwrapped_loops", "SELECT * FROM (VALUES (4, 1, '0.0 0.1 1.0 1.1'), (6, 1, '0.0 0.1 0.2 1.0 1.1 1.2'), (6, 2, '0.0 0.1 1.0 1.1 2.0 2.1')) t(weight, rank, shape)")
def unwrapped_loops(spark, sf_dir):
    one = loops.find(lattices.square(spark, 7), 6, at=1)
    shape = F.array_join(F.transform(loops.unwrapped(F.col("vertices"), 7), lambda c: F.concat_ws(".", c["i"].cast("string"), c["j"].cast("string"))), " ")
    kinds = one.select("weight", shape.alias("shape")).distinct()
    return kinds.select("weight", F.row_number().over(W.partitionBy("weight").orderBy("shape")).alias("rank"), "shape")


@query("loops_within", "WITH " + SMALL.format(L=9) + " SELECT w AS weight, CAST(count(*) AS INTEGER) AS n FROM small WHERE w < 7 AND list_contains(v, 40) AND len(list_filter(v, lambda x: abs(x // 9 - 4) + abs(x % 9 - 4) > 3)) = 0 GROUP BY w")
def loops_within(spark, sf_dir):
    near = loops.within(lattices.square(spark, 9), 41, 3, 9)
    return loops.find(near, 6, at=41).groupBy("weight").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("template_loops", "SELECT i, j, di, dj FROM (SELECT CAST(a AS INTEGER) AS i, CAST(b AS INTEGER) AS j FROM range(1, 6) x(a), range(1, 6) y(b)), (VALUES (1, 1), (1, 2), (2, 1)) t(di, dj)")
def template_loops(spark, sf_dir):
    return series.template_loops(spark, 5)


@query("walks", """WITH RECURSIVE w AS (SELECT [[0, 0]] AS p, 0 AS n UNION ALL
  SELECT list_append(p, [p[len(p)][1] + a, p[len(p)][2] + b]), n + 1 FROM w, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) s(a, b)
  WHERE n < 8 AND (n = 0 OR p[len(p)] <> [0, 0]) AND NOT list_contains(p[2:], [p[len(p)][1] + a, p[len(p)][2] + b]) AND (n > 1 OR [p[len(p)][1] + a, p[len(p)][2] + b] <> [0, 0]))
SELECT n AS steps, count(*) AS n FROM w WHERE n > 2 AND p[len(p)] = [0, 0] GROUP BY n""")
def walks(spark, sf_dir):
    return loops.walks(spark, 8)


@query("polygon_series", """WITH RECURSIVE w AS (SELECT [[0, 0]] AS p, 0 AS n UNION ALL
  SELECT list_append(p, [p[len(p)][1] + a, p[len(p)][2] + b]), n + 1 FROM w, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) s(a, b)
  WHERE n < 8 AND (n = 0 OR p[len(p)] <> [0, 0]) AND NOT list_contains(p[2:], [p[len(p)][1] + a, p[len(p)][2] + b]) AND (n > 1 OR [p[len(p)][1] + a, p[len(p)][2] + b] <> [0, 0])),
a AS (SELECT n, count(*) / (2.0 * n) AS p FROM w WHERE n > 2 AND p[len(p)] = [0, 0] GROUP BY n), b(beta) AS (VALUES (0.2), (0.3))
SELECT CAST(beta AS DOUBLE) AS beta, round(-(ln(2) + 2 * ln(cosh(beta)) + sum(a.p * pow(tanh(beta), n))), 8) AS f FROM a, b GROUP BY beta""")
def polygon_series(spark, sf_dir):
    points = spark.createDataFrame([(0.2,), (0.3,)], "beta double")
    return series.polygon_free_energy(loops.walks(spark, 8), points).select("beta", F.round("f", 8).alias("f"))


def _clusters(spark, L, weight, at=None):
    found = table(loops.numbered(loops.find(lattices.square(spark, L), weight)))
    inter = table(clusters.interactions(found))
    return found, inter, table(clusters.numbered(clusters.grow(found, inter, weight, at)))


@query("cluster_counts", "SELECT * FROM (VALUES (4, 1, 36), (6, 1, 84), (7, 1, 72), (8, 1, 684), (8, 2, 180)) t(weight, total_loops, n)")
def cluster_counts(spark, sf_dir):
    _, _, found = _clusters(spark, 6, 8)
    return found.groupBy("weight", "total_loops").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("clusters_per_site", "WITH " + SMALL.format(L=11) + " SELECT CAST(site + 1 AS INTEGER) AS site, w AS weight, CAST(count(*) AS INTEGER) AS n FROM (SELECT w, unnest(v) AS site FROM small WHERE w < 7) GROUP BY ALL")
def clusters_per_site(spark, sf_dir):
    one = loops.find(lattices.square(spark, 11), 6, at=1)
    every = table(loops.numbered(loops.translates(one, 11)))
    found = table(clusters.numbered(clusters.grow(every, clusters.interactions(every), 6)))
    return clusters.sites(found, every).join(found.select("cluster_id", "weight"), "cluster_id").groupBy("site", "weight").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("enumeration_stats", "WITH " + SMALL.format(L=6) + ", per AS (SELECT w, site, count(*) AS n FROM (SELECT w, unnest(v) AS site FROM small WHERE w < 7) GROUP BY ALL), n AS (SELECT w, count(*) AS clusters FROM small GROUP BY w) SELECT w AS weight, CAST(clusters AS INTEGER) AS clusters, CAST(min(per.n) AS INTEGER) AS least, CAST(max(per.n) AS INTEGER) AS most, round(avg(per.n), 1) AS mean FROM per JOIN n USING (w) GROUP BY w, clusters")
def enumeration_stats(spark, sf_dir):
    from ..sources import catalog

    found, _, c = _clusters(spark, 6, 6)
    out = catalog.summary(c, clusters.sites(c, found))
    return out.select("weight", *[F.col(n).cast("int").alias(n) for n in ("clusters", "least", "most")], F.round("mean", 1).alias("mean"))


@query("saved_free_energy", """WITH """ + ENTRIES.format(beta="CAST(0.3 AS DOUBLE)") + """, z AS (SELECT sum(t) / 4 AS z FROM entries),
turn AS (SELECT sum(t * CASE WHEN a = b THEN 1 ELSE -1 END) / 4 / (SELECT z FROM z) AS c FROM entries)
SELECT CAST(0.3 AS DOUBLE) AS beta, 4 AS weight, round(-ln((SELECT z FROM z)) / 2 - pow(c, 4) / 2, 8) AS f FROM turn""")
def saved_free_energy(spark, sf_dir):
    """Clusters are saved twice, and the free energy comes from the latest run that can be read."""
    root = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    for run in ("a", "b"):
        ising.save_clusters(spark, root, 6, 4, run)
    return ising.from_saved(spark, root, 6, [0.3], 4).select("beta", "weight", F.round("f", 8).alias("f"))


@query("loop_predicates", "SELECT CAST(v AS INTEGER) AS v, CAST(e AS INTEGER) AS e, e >= v AND e <= 3 * v AS feasible, v <= 4 OR least((e - 1) % 10, 10 - (e - 1) % 10) + least((e - 1) // 10, 10 - (e - 1) // 10) <= 4 AS reasonable FROM range(3, 7) a(v), range(1, 41) b(e)")
def loop_predicates(spark, sf_dir):
    g = spark.range(160).select((F.floor(F.col("id") / 40) + 3).cast("int").alias("v"), (F.col("id") % 40 + 1).cast("int").alias("e"))
    vertices = F.sequence(F.lit(1), F.col("v"))
    return g.select("v", "e", loops.feasible(F.col("v"), F.col("e")).alias("feasible"), loops.reasonable(vertices, F.col("e"), 10).alias("reasonable"))


@query("first_clusters", "WITH " + SMALL.format(L=6) + ", r AS (SELECT w, row_number() OVER (ORDER BY w) AS k FROM small WHERE w < 7) SELECT w AS weight, CAST(count(*) AS INTEGER) AS n FROM r WHERE k <= 100 GROUP BY w")
def first_clusters(spark, sf_dir):
    """The hundred lightest clusters of a torus whose loops of weight 4 are its 36 faces."""
    _, _, found = _clusters(spark, 6, 6)
    return clusters.first_clusters(found, 100).groupBy("weight").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("completion_estimates", "SELECT CAST(L AS INTEGER) AS L, CASE WHEN L <= 4 THEN 1 WHEN L <= 6 THEN 10 WHEN L <= 8 THEN 60 WHEN L <= 10 THEN 300 END AS at_most FROM range(3, 13) t(L)")
def completion_estimates(spark, sf_dir):
    return spark.range(3, 13).select(F.col("id").cast("int").alias("L"), physics.completion_seconds(F.col("id")).alias("at_most"))


@query("clusters_on_site", "SELECT * FROM (VALUES (4, 1, 4), (6, 1, 14), (7, 1, 12)) t(weight, total_loops, n)")
def clusters_on_site(spark, sf_dir):
    _, _, found = _clusters(spark, 6, 7, at=1)
    return found.groupBy("weight", "total_loops").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("cluster_classes", "SELECT * FROM (VALUES (4, 1), (6, 2), (7, 2), (8, 14)) t(weight, classes)")
def cluster_classes(spark, sf_dir):
    one = loops.find(lattices.square(spark, 9), 8, at=1)
    every = table(loops.numbered(loops.translates(one, 9)))
    found = table(clusters.numbered(clusters.grow(every, table(clusters.interactions(every)), 8, at=1)))
    return clusters.translation_classes(found, every, 9).groupBy("weight").agg(F.count(F.lit(1)).cast("int").alias("classes"))


@query("ursell", "SELECT * FROM (VALUES (1, 1, 1.0, 16), (2, 1, -0.5, 16), (2, 2, -1.0, 64)) t(total_loops, distinct_loops, phi, n)")
def ursell(spark, sf_dir):
    one = loops.find(lattices.square(spark, 4), 4, at=1)
    # On this small torus rows and columns are loops of weight 4 too.
    face = F.size(F.array_distinct(F.transform("vertices", lambda v: C.row_of(v, 4)))) == 2
    plaquettes = table(loops.numbered(loops.translates(one, 4)).where(face))
    inter = table(clusters.interactions(plaquettes))
    found = table(clusters.numbered(clusters.grow(plaquettes, inter, 8)))
    phi = clusters.ursell(found, inter).join(found, "cluster_id")
    return phi.groupBy("total_loops", F.size("members").alias("distinct_loops"), "phi").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("cluster_sum", """WITH """ + ENTRIES.format(beta="CAST(0.3 AS DOUBLE)") + """, p AS (SELECT a.k AS x, b.k AS y, (a.k = b.k)::INTEGER - 0.5 AS q FROM range(1, 3) a(k), range(1, 3) b(k)), z AS (SELECT sum(t) / 4 AS z FROM entries),
corner AS (SELECT a AS x, b AS y, sum(t) / 2 / (SELECT z FROM z) AS m FROM entries GROUP BY a, b),
half AS (SELECT c.x, p.y, sum(c.m * p.q) AS m FROM corner c JOIN p ON c.y = p.x GROUP BY c.x, p.y),
two AS (SELECT a.x, b.y, sum(a.m * b.m) AS m FROM half a JOIN half b ON a.y = b.x GROUP BY a.x, b.y),
l AS (SELECT sum(a.m * b.m) AS z FROM two a JOIN two b ON a.y = b.x AND a.x = b.y)
SELECT CAST(0.3 AS DOUBLE) AS beta, 4 AS weight, round(-(ln(2) + 2 * ln(cosh(0.3)) + 0.5 * ln(1 + pow(tanh(0.3), 4))) - z / 2, 8) AS f FROM l""")
def cluster_sum(spark, sf_dir):
    return ising.corrected(spark, 6, [0.3], 4).select("beta", "weight", F.round("f", 8).alias("f"))


@query("cluster_free_energy")
def cluster_free_energy(spark, sf_dir):
    return ising.corrected(spark, 9, [0.2, 0.3], 8).select("beta", "weight", F.round("f", 8).alias("f"))


#: Loops of the torus of 6 x 6 up to weight 6 as sets of sites, their contributions, and which touch.
SERIES = """WITH """ + ENTRIES.format(beta="CAST(0.3 AS DOUBLE)") + """, z AS (SELECT sum(t) / 4 AS z FROM entries),
turn AS (SELECT sum(t * CASE WHEN a = b THEN 1 ELSE -1 END) / 4 / (SELECT z FROM z) AS c FROM entries),
pass AS (SELECT sum(t * CASE WHEN a = {third} THEN 1 ELSE -1 END) / 4 / (SELECT z FROM z) AS s FROM entries),
home AS (SELECT x AS i, y AS j FROM range(0, 6) a(x), range(0, 6) b(y)),
raw AS (
  SELECT 4 AS w, list_distinct(list_transform(range(0, 4), lambda k: (i + k // 2) % 6 * 6 + (j + k % 2) % 6)) AS v, (SELECT pow(c, 4) FROM turn) AS z FROM home
  UNION ALL SELECT 6, list_transform(range(0, 6), lambda k: (i + k // 3) % 6 * 6 + (j + k % 3) % 6), (SELECT pow(c, 4) FROM turn) * (SELECT pow(s, 2) FROM pass) FROM home
  UNION ALL SELECT 6, list_transform(range(0, 6), lambda k: (i + k // 2) % 6 * 6 + (j + k % 2) % 6), (SELECT pow(c, 4) FROM turn) * (SELECT pow(s, 2) FROM pass) FROM home
  UNION ALL SELECT 6, list_transform(range(0, 6), lambda k: i * 6 + k), (SELECT pow(s, 6) FROM pass) FROM home WHERE j = 0
  UNION ALL SELECT 6, list_transform(range(0, 6), lambda k: k * 6 + j), (SELECT pow(s, 6) FROM pass) FROM home WHERE i = 0
),
l AS (SELECT row_number() OVER () AS id, * FROM raw)"""
THIRD = "c"
ALL_TERMS = """, terms AS (SELECT w AS weight, z AS c FROM l UNION ALL SELECT 2 * w, -z * z / 2 FROM l UNION ALL SELECT a.w + b.w, -a.z * b.z FROM l a JOIN l b ON a.id < b.id AND list_has_any(a.v, b.v){products})
SELECT weight, round(sum(c), 8) AS "at" FROM terms GROUP BY weight"""


def _series(spark, log):
    t, s = tensors.ising(spark, 6, [0.3])
    found = table(loops.numbered(loops.find(lattices.square(spark, 6), 6)))
    z = table(bp.loop_contributions(t, s, bp.start(t, s), found))
    return series.z_series(found, z, clusters.interactions(found), log).select("weight", F.round("at", 8).alias("at"))


@query("z_series", SERIES.format(third=THIRD) + ALL_TERMS.format(products=" UNION ALL SELECT a.w + b.w, a.z * b.z / 2 FROM l a, l b"))
def z_series(spark, sf_dir):
    return _series(spark, False)


@query("logz_series", SERIES.format(third=THIRD) + ALL_TERMS.format(products=""))
def logz_series(spark, sf_dir):
    return _series(spark, True)


@query("orders_of_loops", SERIES.format(third=THIRD) + """, vacuum AS (SELECT 36 * ln((SELECT z FROM z)) AS x)
SELECT w AS weight, round(x + ln(1 + s), 7) AS logz, round(ln(1 + every) / 36, 9) AS naive FROM (SELECT w, sum(z) AS s FROM l GROUP BY w UNION ALL SELECT 0, 0), vacuum, (SELECT sum(z) AS every FROM l)""")
def orders_of_loops(spark, sf_dir):
    """log Z in the vacuum and with the loops of each weight alone, and the naive correction per site with all of them."""
    t, s = tensors.ising(spark, 6, [0.3])
    found = table(loops.numbered(loops.find(lattices.square(spark, 6), 6)))
    solved = table(small.solve(t, s, found))
    naive = small.naive_correction(solved, 36).select("g", F.round("re", 9).alias("naive"))
    return small.by_order(solved, found).join(naive, "g").select("weight", F.round("re", 7).alias("logz"), "naive")


@query("complex_peps", """WITH k AS (SELECT v, p, q, CAST(p + 2 * q AS BIGINT) AS k FROM range(1, 5) a(v), range(0, 2) b(p), range(0, 2) c(q)),
m1 AS (SELECT *, ((s::BIGINT * 7919 + v * 104729 + 12345) * ((s + v) % 997 + 1)) % 999983 AS x1 FROM k, (VALUES (3), (4)) t(s)),
m2 AS (SELECT *, ((x1 * 7919 + k * 104729 + 12345) * ((x1 + k) % 997 + 1)) % 999983 AS x2 FROM m1),
n AS (SELECT v, p, q, max(CASE WHEN s = 3 THEN (x2 * x2 + 3 * x2 + 17) % 999983 END) / 999983.0::DOUBLE - 0.5 AS x, max(CASE WHEN s = 4 THEN (x2 * x2 + 3 * x2 + 17) % 999983 END) / 999983.0::DOUBLE - 0.5 AS y FROM m2 GROUP BY ALL),
t AS (SELECT g, v, p, q, CASE p + q WHEN 0 THEN 0.64 WHEN 1 THEN 0.384 ELSE 0.1008 END::DOUBLE + g * x AS re, CASE p + q WHEN 0 THEN 0 WHEN 1 THEN 0.288 ELSE 0.3456 END::DOUBLE + g * y AS im FROM n, (VALUES (0.05::DOUBLE), (0.2::DOUBLE)) e(g)),
half AS (SELECT a.g, a.v, a.p AS i, b.p AS k, sum(a.re * b.re - a.im * b.im) AS re, sum(a.re * b.im + a.im * b.re) AS im FROM t a JOIN t b ON a.v = 1 AND b.v = 2 AND a.q = b.q AND a.g = b.g GROUP BY ALL
  UNION ALL SELECT a.g, a.v, a.p, b.p, sum(a.re * b.re - a.im * b.im), sum(a.re * b.im + a.im * b.re) FROM t a JOIN t b ON a.v = 3 AND b.v = 4 AND a.q = b.q AND a.g = b.g GROUP BY ALL)
SELECT a.g, round(sum(a.re * b.re - a.im * b.im), 8) AS re, round(sum(a.re * b.im + a.im * b.re), 8) AS im FROM half a JOIN half b ON a.g = b.g AND a.v = 1 AND b.v = 3 AND a.i = b.i AND a.k = b.k GROUP BY a.g""")
def complex_peps(spark, sf_dir):
    """On two by two sites the vacuum and the one loop are exact, complex tensors included."""
    t, s = tensors.complex_peps(spark, 2, 2, [0.05, 0.2], 3)
    one = spark.createDataFrame([(1, [(1, 2), (1, 3), (2, 4), (3, 4)], 4)], "loop_id long, edges array<struct<u:int,w:int>>, weight int")
    out = small.by_order(small.solve(t, s, one, tolerance=1e-13), one).where("weight = 4")
    return out.select("g", (F.round(F.exp("re") * F.cos("im"), 8) + 0.0).alias("re"), (F.round(F.exp("re") * F.sin("im"), 8) + 0.0).alias("im"))


@query("disjoint_and_touching", "WITH " + SMALL.format(L=6) + ", f AS (SELECT i * 6 + j AS id, v FROM small WHERE w = 4) SELECT count(*) FILTER (NOT list_has_any(a.v, b.v)) AS disjoint, count(*) FILTER (list_has_any(a.v, b.v)) AS touching FROM f a JOIN f b ON a.id < b.id")
def disjoint_and_touching(spark, sf_dir):
    found = table(loops.numbered(loops.find(lattices.square(spark, 6), 4)))
    return clusters.disjoint_pairs(found, found, clusters.interactions(found))


@query("shared_vertices", "WITH " + SMALL.format(L=6) + ", f AS (SELECT i * 6 + j AS id, v FROM small WHERE w = 4) SELECT CAST(len(list_intersect(a.v, b.v)) AS INTEGER) AS shared, CAST(count(*) AS INTEGER) AS pairs FROM f a JOIN f b ON a.id < b.id AND list_has_any(a.v, b.v) GROUP BY 1")
def shared_vertices(spark, sf_dir):
    found = table(loops.numbered(loops.find(lattices.square(spark, 6), 4)))
    return clusters.shared_vertices(found).groupBy(F.col("n").cast("int").alias("shared")).agg(F.count(F.lit(1)).cast("int").alias("pairs"))


@query("loop_decay")
def loop_decay(spark, sf_dir):
    t, s = tensors.random_peps(spark, 4, 4, 0.2, 11)
    m = bp.fixed_point(t, s, bp.start(t, s), keep=0.2, tolerance=1e-10, rounds=100)
    found = table(loops.numbered(loops.find(lattices.square(spark, 4, "open"), 8)))
    z = bp.loop_contributions(t, s, m, found).join(found.select("loop_id", "weight"), "loop_id").withColumn("size", F.abs("z"))
    return z.groupBy("weight").agg(F.count("size").alias("n"), F.avg("size").alias("mean"))


WEIGHTS = "weights AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, avg(l_quantity) / 20 AS a1, avg(l_linenumber) / 2 AS a2 FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1 HAVING count(l_quantity) > 0 AND count(l_linenumber) > 0)"
AKLT = "b AS (SELECT CAST(l.k AS INTEGER) AS l, CAST(b.k AS INTEGER) AS b, CAST(r.k AS INTEGER) AS r, CAST(t.k AS INTEGER) AS t FROM range(1, 3) l(k), range(1, 3) b(k), range(1, 3) r(k), range(1, 3) t(k)), d AS (SELECT *, (2 - l) + (2 - b) + (r - 1) + (t - 1) AS d FROM b), a AS (SELECT *, (3 - 2 * l) * (3 - 2 * b) * CASE d WHEN 0 THEN a2 / sqrt(6) WHEN 4 THEN a2 / sqrt(6) WHEN 2 THEN 1 ELSE a1 / sqrt(1.5) END / sqrt(CASE d WHEN 0 THEN 1 WHEN 4 THEN 1 WHEN 2 THEN 6 ELSE 4 END) AS re FROM d, weights)"


def _weights(spark, sf_dir):
    """(g, a1, a2): for each year of shipment the mean quantity in twenties and half the mean line number, weights of the spin's components."""
    lines = read(spark, sf_dir, "lineitem").where("l_shipdate IS NOT NULL").groupBy(F.year("l_shipdate").cast("double").alias("g"))
    return table(lines.agg((F.avg("l_quantity") / 20).alias("a1"), (F.avg("l_linenumber") / 2).alias("a2")).where("a1 IS NOT NULL AND a2 IS NOT NULL"))


@query("aklt_tensor", "WITH " + WEIGHTS + ", " + AKLT + " SELECT year, CAST(5 - d AS INTEGER) AS phys, l, b, r, t, round(re, 9) AS re FROM a")
def aklt_tensor(spark, sf_dir):
    """The deformed tensor of each year of shipment."""
    return tensors.aklt_tensors(spark, _weights(spark, sf_dir)).select(F.col("g").cast("int").alias("year"), "phys", "l", "b", "r", "t", F.round("re", 9).alias("re"))


@query("aklt_norm", "WITH " + WEIGHTS + ", " + AKLT + " SELECT x.year, concat_ws(',', 2 * (x.l - 1) + y.l, 2 * (x.b - 1) + y.b, 2 * (x.r - 1) + y.r, 2 * (x.t - 1) + y.t) AS idx, round(x.re * y.re, 9) AS re FROM a x JOIN a y ON x.year = y.year AND x.d = y.d")
def aklt_norm(spark, sf_dir):
    """The norm tensor of each year of shipment."""
    t = tensors.aklt_doubles(tensors.aklt_tensors(spark, _weights(spark, sf_dir)))
    return t.select(F.col("g").cast("int").alias("year"), F.array_join(F.col("idx").cast("array<string>"), ",").alias("idx"), F.round("re", 9).alias("re"))


@query("aklt_magnetisation", "SELECT 0.0 AS sz")
def aklt_magnetisation(spark, sf_dir):
    up = contract.contract_network(*tensors.aklt(spark, 3, sz_site=1)).select(F.col("re").alias("a"))
    norm = contract.contract_network(*tensors.aklt(spark, 3)).select(F.col("re").alias("b"))
    return up.join(norm).select((F.round(F.col("a") / F.col("b"), 6) + 0.0).alias("sz"))


@query("corner_matrices")
def corner_matrices(spark, sf_dir):
    points = stats.grid(spark, {"a1": [1.0, 1.5**0.5], "a2": [1.0, 6**0.5]})
    return exact.corner_free_energy(points, chi=16, steps=40).select("a1", "a2", F.round("log_kappa", 6).alias("log_kappa"))


@query("random_peps")
def random_peps(spark, sf_dir):
    t, s = tensors.random_peps(spark, 3, 3, 0.3, 5)
    m = bp.fixed_point(t, s, bp.start(t, s), keep=0.1, rounds=60, tolerance=1e-10)
    full = contract.contract_network(t, s)
    return bp.log_partition(bp.local_z(t, s, m)).join(full, "g").select(F.col("g").alias("eta"), F.round("logz", 6).alias("bp"), F.round(F.log("re"), 6).alias("exact"))


@query("contract_pair", "WITH a AS (SELECT CAST(i AS INTEGER) AS i, CAST(k AS INTEGER) AS k, (i * 3 + k * 5) % 7 + 0.5 AS re FROM range(1, 5) x(i), range(1, 4) y(k)), b AS (SELECT CAST(k AS INTEGER) AS k, CAST(j AS INTEGER) AS j, (k * 2 + j) % 5 - 1.25 AS re FROM range(1, 4) x(k), range(1, 6) y(j)) SELECT i, j, CAST(sum(a.re * b.re) AS DOUBLE) AS re FROM a JOIN b USING (k) GROUP BY i, j")
def contract_pair(spark, sf_dir):
    n = lambda c: F.col(c).cast("int")
    a = stats.grid(spark, {"i": [1, 2, 3, 4], "k": [1, 2, 3]}).select(n("i"), n("k"), ((F.col("i") * 3 + F.col("k") * 5) % 7 + F.lit(0.5)).alias("re"))
    b = stats.grid(spark, {"k": [1, 2, 3], "j": [1, 2, 3, 4, 5]}).select(n("k"), n("j"), ((F.col("k") * 2 + F.col("j")) % 5 - F.lit(1.25)).alias("re"))
    return contract.contract(a.withColumn("re", F.col("re").cast("double")), b.withColumn("re", F.col("re").cast("double")), ["k"])


# Codes.
TORIC = """cells AS (SELECT CAST(k AS INTEGER) AS k, (k - 1) // {L} + 1 AS i, (k - 1) % {L} + 1 AS j FROM range(1, {L} * {L} + 1) t(k)),
pcm AS (SELECT k AS chk, CAST(((i - 2 + {L}) % {L}) * {L} + j AS INTEGER) AS bit FROM cells UNION ALL SELECT k, k FROM cells UNION ALL SELECT k, {L} * {L} + k FROM cells UNION ALL SELECT k, CAST({L} * {L} + (i - 1) * {L} + (j - 2 + {L}) % {L} + 1 AS INTEGER) FROM cells)"""
RANDOM = """mixed AS (SELECT s AS sample_id, CAST(b AS INTEGER) AS bit, (({seed}::BIGINT * 7919 + s * 104729 + 12345) * (({seed} + s) % 997 + 1)) % 999983 AS x1, s, b FROM range(1, {samples} + 1) a(s), range(1, {bits} + 1) c(b)),
mixed2 AS (SELECT *, ((x1 * 7919 + b * 104729 + 12345) * ((x1 + b) % 997 + 1)) % 999983 AS x2 FROM mixed),
drawn AS (SELECT sample_id, bit, (x2 * x2 + 3 * x2 + 17) % 999983 AS r FROM mixed2)"""


@query("toric_pcm", "WITH " + TORIC.format(L=5) + " SELECT chk, bit FROM pcm")
def toric_pcm(spark, sf_dir):
    return code_sources.toric(spark, 5)


@query("toric_plaquettes", "WITH " + TORIC.format(L=5) + " SELECT k AS p, k AS bit FROM cells UNION ALL SELECT k, CAST((i - 1) * 5 + j % 5 + 1 AS INTEGER) FROM cells UNION ALL SELECT k, 25 + k FROM cells UNION ALL SELECT k, CAST(25 + (i % 5) * 5 + j AS INTEGER) FROM cells")
def toric_plaquettes(spark, sf_dir):
    return code_sources.plaquettes(spark, 5)


@query("toric_logicals", "SELECT 1 AS op, CAST((k - 1) * 5 + 1 AS INTEGER) AS bit FROM range(1, 6) t(k) UNION ALL SELECT 2, CAST(25 + k AS INTEGER) FROM range(1, 6) t(k)")
def toric_logicals(spark, sf_dir):
    return code_sources.logicals(spark, 5)


@query("gallager_code", "WITH rows AS (SELECT CAST(l AS INTEGER) AS l, CAST(b AS INTEGER) AS bit, ((7919 + l * 104729 + 12345) * ((1 + l) % 997 + 1)) % 999983 AS x FROM range(0, 3) a(l), range(1, 25) c(b)), m AS (SELECT l, bit, ((x * 7919 + bit * 104729 + 12345) * ((x + bit) % 997 + 1)) % 999983 AS x FROM rows), r AS (SELECT l, bit, row_number() OVER (PARTITION BY l ORDER BY (x * x + 3 * x + 17) % 999983, bit) - 1 AS k FROM m) SELECT CAST(l * 6 + k // 4 + 1 AS INTEGER) AS chk, bit FROM r")
def gallager_code(spark, sf_dir):
    return code_sources.gallager(spark, 24, 3, 4)


@query("bch_code", """WITH RECURSIVE pw(j, x) AS (SELECT 0, 1 UNION ALL SELECT j + 1, CASE WHEN x >= 8 THEN xor(x << 1, 19) ELSE x << 1 END FROM pw WHERE j < 14),
masks AS (SELECT k, b, CAST(sum(((p.x >> b) & 1) << a.j) AS BIGINT) AS m FROM (VALUES (1), (3)) q(k), range(0, 4) t(b), pw a JOIN pw p ON true WHERE p.j = (k * a.j) % 15 GROUP BY k, b),
lines AS (SELECT CAST(round(l_extendedprice * 100) AS BIGINT) & 32767 AS w, count(*) AS lines FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY 1),
words AS (SELECT w, lines FROM lines, masks GROUP BY w, lines HAVING max(bit_count(w & m) % 2) = 0)
SELECT CAST(bit_count(w) AS INTEGER) AS weight, count(*) AS n, CAST(sum(lines) AS BIGINT) AS lines FROM words GROUP BY 1""")
def bch_code(spark, sf_dir):
    """Words that the low fifteen bits of the lines' prices in cents make and that are in the code of length 15 that corrects two errors, by weight."""
    masks = code_sources.bch(spark, 4, 2).groupBy("chk").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit") - 1)).alias("m"))
    word = F.round(F.col("l_extendedprice") * 100).cast("long").bitwiseAND(F.lit(32767))
    lines = read(spark, sf_dir, "lineitem").where("l_extendedprice IS NOT NULL").groupBy(word.alias("w")).agg(F.count(F.lit(1)).alias("lines"))
    words = lines.join(F.broadcast(masks)).groupBy("w", "lines").agg(F.max(F.bit_count(F.col("w").bitwiseAND(F.col("m"))) % 2).alias("odd")).where("odd = 0")
    return words.groupBy(F.bit_count("w").alias("weight")).agg(F.count(F.lit(1)).alias("n"), F.sum("lines").alias("lines"))


@query("sampled_errors", "WITH " + RANDOM.format(seed=1, samples=20, bits=18) + " SELECT sample_id, bit, CAST(r < CAST(floor(0.1 * 999983) AS BIGINT) AS INTEGER) AS x FROM drawn")
def sampled_errors(spark, sf_dir):
    return code_sources.errors(spark, 20, 18, 0.1)


@query("fixed_weight_errors", "WITH " + RANDOM.format(seed=2, samples=10, bits=18) + " SELECT sample_id, bit, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY r, bit) <= 4 AS INTEGER) AS x FROM drawn")
def fixed_weight_errors(spark, sf_dir):
    return code_sources.fixed_weight(spark, 10, 18, 4, seed=2)


@query("syndrome", "WITH " + TORIC.format(L=3) + ", " + RANDOM.format(seed=1, samples=20, bits=18) + ", e AS (SELECT sample_id, bit, CAST(r < CAST(floor(0.1 * 999983) AS BIGINT) AS INTEGER) AS x FROM drawn) SELECT sample_id, chk, CAST(sum(x) % 2 AS INTEGER) AS s FROM e JOIN pcm USING (bit) GROUP BY sample_id, chk")
def syndrome(spark, sf_dir):
    return codes.syndrome(code_sources.toric(spark, 3), code_sources.errors(spark, 20, 18, 0.1))


@query("match_syndrome", "WITH " + TORIC.format(L=5) + ", " + RANDOM.format(seed=1, samples=50, bits=50) + ", s AS (SELECT sample_id, chk, sum(CAST(r < CAST(floor(0.08 * 999983) AS BIGINT) AS INTEGER)) % 2 AS s FROM drawn JOIN pcm USING (bit) GROUP BY sample_id, chk) SELECT count(*) AS excitations, CAST(0 AS BIGINT) AS unmatched FROM s WHERE s = 1")
def match_syndrome(spark, sf_dir):
    s = codes.syndrome(code_sources.toric(spark, 5), code_sources.errors(spark, 50, 50, 0.08))
    found = codes.symmetric_difference(codes.match_syndrome(s, 5).withColumnRenamed("sample_id", "set_id"))
    again = found.select(F.col("set_id").alias("sample_id"), F.col("e").alias("bit"), F.lit(1).alias("x"))
    left = codes.syndrome(code_sources.toric(spark, 5), again).where("s = 1").withColumnRenamed("s", "t")
    return s.where("s = 1").join(left, ["sample_id", "chk"], "full").agg(F.count(F.lit(1)).alias("excitations"), F.sum((F.col("s").isNull() | F.col("t").isNull()).cast("long")).alias("unmatched"))


CHECK_SETS = [("empty", []), ("h_cycle", [1, 4, 7]), ("two_h_cycles", [1, 4, 7, 2, 5, 8]), ("h_and_v", [1, 4, 7, 10, 11, 12]), ("open_h", [1, 4]), ("plaquette", [1, 2, 10, 13]), ("rectangle", [1, 3, 10, 11, 13, 14]), ("twice", [1, 4, 7, 1, 4, 7])]


@query("check_decode", "SELECT * FROM (VALUES ('empty', true, true), ('h_cycle', true, false), ('two_h_cycles', true, true), ('h_and_v', true, false), ('open_h', false, false), ('plaquette', true, true), ('rectangle', true, true), ('twice', true, true)) t(set_id, syndrome_zero, homology_trivial)")
def check_decode(spark, sf_dir):
    ids = spark.createDataFrame([(n,) for n, _ in CHECK_SETS], "set_id string")
    return codes.check_decoding(spark.createDataFrame([(n, e) for n, es in CHECK_SETS for e in es], "set_id string, e int"), ids, 3)


@query("gf2_solvable", "SELECT * FROM (VALUES ('h_cycle', false), ('two_h_cycles', true), ('h_and_v', false), ('open_h', false), ('plaquette', true), ('rectangle', true), ('twice', true)) t(set_id, solvable)")
def gf2_solvable(spark, sf_dir):
    sets = spark.createDataFrame([(n, e) for n, es in CHECK_SETS for e in es], "set_id string, e int")
    return codes.solvable(code_sources.plaquettes(spark, 3), sets)


@query("gf2_rank", "SELECT 24 AS rank, 25 AS checks")
def gf2_rank(spark, sf_dir):
    t = code_sources.toric(spark, 5)
    return codes.row_reduce(t).agg(F.count_distinct("row").cast("int").alias("rank")).join(t.agg(F.count_distinct("chk").cast("int").alias("checks")))


@query("parity_on", "SELECT * FROM (VALUES ('h_cycle', 1), ('two_h_cycles', 0), ('h_and_v', 1), ('open_h', 1), ('plaquette', 0), ('rectangle', 0), ('twice', 0)) t(set_id, parity)")
def parity_on(spark, sf_dir):
    sets = spark.createDataFrame([(n, e) for n, es in CHECK_SETS for e in es], "set_id string, e int")
    return codes.parity_on(sets, spark.range(1, 4).select(F.col("id").cast("int").alias("e")))


@query("edge_bits", "WITH s(set_id, e) AS (VALUES ('a', 1), ('a', 3), ('a', 3), ('b', 2)), ids AS (SELECT DISTINCT set_id FROM s) SELECT ids.set_id, CAST(b AS INTEGER) AS bit, CAST((SELECT count(*) FROM s WHERE s.set_id = ids.set_id AND e = b) % 2 AS INTEGER) AS x FROM ids, range(1, 5) t(b)")
def edge_bits(spark, sf_dir):
    return codes.as_bits(spark.createDataFrame([("a", 1), ("a", 3), ("a", 3), ("b", 2)], "set_id string, e int"), 4)


@query("parity_tensor", "SELECT concat_ws(',', 1 + (k & 1), 1 + ((k >> 1) & 1), 1 + ((k >> 2) & 1), 1 + ((k >> 3) & 1)) AS idx, 1.0::DOUBLE AS re FROM range(0, 16) t(k) WHERE bit_count(k) % 2 = 1")
def parity_tensor(spark, sf_dir):
    return codes.parity_tensor(spark, 4, 1).select(F.array_join(F.col("idx").cast("array<string>"), ",").alias("idx"), "re")


HAMMING = [(1, 1), (1, 2), (1, 4), (2, 2), (2, 3), (2, 5), (3, 1), (3, 3), (3, 6)]


@query("factor_graph", "WITH pcm(chk, bit) AS (VALUES (1, 1), (1, 2), (1, 4), (2, 2), (2, 3), (2, 5), (3, 1), (3, 3), (3, 6)), x AS (SELECT list_transform(range(0, 6), lambda b: (k >> b) & 1) AS x FROM range(0, 64) t(k)), ok AS (SELECT x FROM x WHERE (x[1] + x[2] + x[4]) % 2 = 1 AND (x[2] + x[3] + x[5]) % 2 = 0 AND (x[1] + x[3] + x[6]) % 2 = 0) SELECT round(sum(list_aggregate(list_transform(x, lambda b: CASE b WHEN 1 THEN 0.1 ELSE 0.9 END), 'product')), 9) AS z FROM ok")
def factor_graph(spark, sf_dir):
    pcm = spark.createDataFrame(HAMMING, "chk int, bit int")
    s = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "chk int, s int")
    return contract.contract_network(*codes.factor_graph(pcm, s, 0.1)).select(F.round("re", 9).alias("z"))


@query("pair_marginals", """WITH x AS (SELECT list_transform(range(0, 6), lambda b: (k >> b) & 1) AS x FROM range(0, 64) t(k)),
ok AS (SELECT x, list_aggregate(list_transform(x, lambda b: CASE b WHEN 1 THEN 0.1::DOUBLE ELSE 0.9::DOUBLE END), 'product') AS p FROM x WHERE (x[1] + x[2] + x[3]) % 2 = 1 AND (x[1] + x[2] + x[4]) % 2 = 0 AND (x[3] + x[5]) % 2 = 0 AND (x[1] + x[6]) % 2 = 1)
SELECT 1 AS a, 2 AS b, """ + ", ".join(f"round(coalesce(sum(CASE WHEN x[1] = {i} AND x[2] = {j} THEN p END), 0) / sum(p), 8) AS p{i}{j}" for i in (0, 1) for j in (0, 1)) + " FROM ok")
def pair_marginals(spark, sf_dir):
    """A graph whose only cycle is that of two bits and two checks: the pair's joint marginal is exact."""
    pcm = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 4), (3, 3), (3, 5), (4, 1), (4, 6)], "chk int, bit int")
    s = spark.createDataFrame([(1, 1, 1), (1, 2, 0), (1, 3, 0), (1, 4, 1)], "sample_id long, chk int, s int")
    out = codes.pair_marginals(pcm, s, 0.1, 30)
    return out.select("a", "b", *[F.round(c, 8).alias(c) for c in ("p00", "p01", "p10", "p11")])


@query("tanner_neighbours", "WITH " + TORIC.format(L=3) + " SELECT p.bit, (SELECT string_agg(c::VARCHAR, ',' ORDER BY c) FROM (SELECT DISTINCT chk AS c FROM pcm q WHERE q.bit = p.bit)) AS checks, (SELECT string_agg(b::VARCHAR, ',' ORDER BY b) FROM (SELECT DISTINCT r.bit AS b FROM pcm q JOIN pcm r ON q.chk = r.chk WHERE q.bit = p.bit AND r.bit <> p.bit)) AS bits FROM (SELECT DISTINCT bit FROM pcm) p")
def tanner_neighbours(spark, sf_dir):
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return codes.tanner_neighbours(code_sources.toric(spark, 3)).select("bit", join("checks"), join("bits"))


@query("tanner_loops", "WITH " + TORIC.format(L=3) + ", t AS (SELECT a.bit AS b1, a.chk AS c1, b.bit AS b2, c.chk AS c2, d.bit AS b3, e.chk AS c3 FROM pcm a JOIN pcm b ON a.chk = b.chk AND b.bit > a.bit JOIN pcm c ON c.bit = b.bit AND c.chk <> a.chk JOIN pcm d ON d.chk = c.chk AND d.bit > a.bit AND d.bit <> b.bit JOIN pcm e ON e.bit = d.bit AND e.chk NOT IN (a.chk, c.chk) AND e.chk > a.chk JOIN pcm f ON f.chk = e.chk AND f.bit = a.bit) SELECT array_to_string(list_sort([b1, b2, b3]), ',') AS bits, array_to_string(list_sort([c1, c2, c3]), ',') AS checks, 6 AS length FROM t")
def tanner_loops(spark, sf_dir):
    join = lambda c: F.array_join(F.array_sort(c).cast("array<string>"), ",").alias(c)
    return codes.tanner_loops(code_sources.toric(spark, 3), 6).select(join("bits"), join("checks"), "length")


@query("loops_through_two_bits", "WITH " + TORIC.format(L=3) + ", t AS (SELECT a.bit AS b1, a.chk AS c1, b.bit AS b2, c.chk AS c2, d.bit AS b3, e.chk AS c3 FROM pcm a JOIN pcm b ON a.chk = b.chk AND b.bit > a.bit JOIN pcm c ON c.bit = b.bit AND c.chk <> a.chk JOIN pcm d ON d.chk = c.chk AND d.bit > a.bit AND d.bit <> b.bit JOIN pcm e ON e.bit = d.bit AND e.chk NOT IN (a.chk, c.chk) AND e.chk > a.chk JOIN pcm f ON f.chk = e.chk AND f.bit = a.bit) SELECT array_to_string(list_sort([b1, b2, b3]), ',') AS bits FROM t WHERE list_contains([b1, b2, b3], 1) AND list_contains([b1, b2, b3], 4)")
def loops_through_two_bits(spark, sf_dir):
    found = codes.through_both(codes.tanner_loops(code_sources.toric(spark, 3), 6), 1, 4)
    return found.select(F.array_join(F.col("bits").cast("array<string>"), ",").alias("bits"))


@query("toric_loops", "WITH RECURSIVE " + TORIC.format(L=4) + """, links AS (SELECT a.chk AS x, b.chk AS y, a.bit FROM pcm a JOIN pcm b ON a.bit = b.bit AND a.chk <> b.chk),
w AS (SELECT x AS home, [x] AS p, y AS tip, [bit] AS bits FROM links UNION ALL SELECT home, list_append(p, tip), l.y, list_append(bits, l.bit) FROM w JOIN links l ON l.x = tip WHERE len(bits) < 4 AND tip <> home AND tip > home AND NOT list_contains(p, tip) AND NOT list_contains(bits, l.bit))
SELECT CAST(2 * len(bits) AS INTEGER) AS length, CAST(count(DISTINCT list_sort(bits)) AS BIGINT) AS n FROM w WHERE tip = home AND len(bits) > 1 GROUP BY len(bits)""")
def toric_loops(spark, sf_dir):
    found = codes.loops_of_sets(codes.tanner_loops(code_sources.toric(spark, 4), 8))
    return found.groupBy("length").agg(F.count_distinct("bits").alias("n"))


@query("loops_per_bit", "WITH " + TORIC.format(L=3) + ", t AS (SELECT a.bit AS b1, a.chk AS c1, b.bit AS b2, c.chk AS c2, d.bit AS b3, e.chk AS c3 FROM pcm a JOIN pcm b ON a.chk = b.chk AND b.bit > a.bit JOIN pcm c ON c.bit = b.bit AND c.chk <> a.chk JOIN pcm d ON d.chk = c.chk AND d.bit > a.bit AND d.bit <> b.bit JOIN pcm e ON e.bit = d.bit AND e.chk NOT IN (a.chk, c.chk) AND e.chk > a.chk JOIN pcm f ON f.chk = e.chk AND f.bit = a.bit) SELECT 6 AS length, round(3 * count(*) / 18, 6) AS mean FROM t")
def loops_per_bit(spark, sf_dir):
    found = codes.tanner_loops(code_sources.toric(spark, 3), 6)
    per = found.select("length", F.explode("bits").alias("bit")).groupBy("length", "bit").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("length").agg(F.round(F.sum("n") / 18, 6).alias("mean"))


@query("decode_bp")
def decode_bp(spark, sf_dir):
    return decoding.toric(spark, 5, 0.05, 100)


@query("decode_loops")
def decode_loops(spark, sf_dir):
    return decoding.toric(spark, 3, 0.05, 40, order=6, rounds=15)


@query("decode_regular")
def decode_regular(spark, sf_dir):
    return stats.error_stats(decoding.regular(spark, 48, 3, 4, 0.03, 5, 20).withColumn("k", F.lit(1)), ["k"], "word_error").drop("k")


CLASS_SUMS = "WITH " + TORIC.format(L=3) + ", " + RANDOM.format(seed=1, samples=60, bits=18) + """,
m AS (SELECT bit, CAST(sum(1 << (chk - 1)) + CASE WHEN bit IN (1, 2, 3) THEN 512 ELSE 0 END + CASE WHEN bit IN (10, 13, 16) THEN 1024 ELSE 0 END AS INTEGER) AS m FROM pcm GROUP BY bit),
ms AS (SELECT list(m ORDER BY bit) AS m FROM m),
sums AS (SELECT list_aggregate(list_transform(range(0, 18), lambda b: CASE WHEN (k >> b) & 1 = 1 THEN m[b + 1] ELSE 0 END), 'bit_xor') AS sig, sum(pow(CAST(0.08 AS DOUBLE) / 0.92, bit_count(k))) AS w FROM range(0, 262144) t(k), ms GROUP BY ALL),
e AS (SELECT sample_id, bit_xor(m) AS sig FROM (SELECT sample_id, CASE WHEN r < CAST(floor(0.08 * 999983) AS BIGINT) THEN m.m ELSE 0 END AS m FROM drawn JOIN m USING (bit)) GROUP BY sample_id)
SELECT e.sample_id, round(ln(max(o.w)), 7) AS best, round(ln(max(CASE WHEN o.sig = e.sig THEN o.w END)), 7) AS true, CAST(ln(max(o.w)) - ln(max(CASE WHEN o.sig = e.sig THEN o.w END)) > 1e-9 AS INTEGER) AS wrong
FROM e JOIN sums o ON o.sig & 511 = e.sig & 511 GROUP BY e.sample_id"""


@query("mld_classes", CLASS_SUMS)
def mld_classes(spark, sf_dir):
    out = decoding.maximum_likelihood(spark, 3, 0.08, 60)
    return out.select("sample_id", F.round("best", 7).alias("best"), F.round("true", 7).alias("true"), "wrong")


@query("mld_large")
def mld_large(spark, sf_dir):
    """Beyond the exact sum: classes of a code of L = 5 by the random-bond model's propagation."""
    out = decoding.maximum_likelihood(spark, 5, 0.05, 20, rounds=200)
    return out.agg(F.count(F.lit(1)).alias("samples"), F.avg("wrong").alias("wrong"))


@query("random_bond_bethe", "SELECT CAST(k AS DOUBLE) AS g, round(9 * ln(2) + 18 * ln(2 * cosh(0.2)) - 18 * ln(2), 7) AS logz FROM range(0, 4) t(k)")
def random_bond_bethe(spark, sf_dir):
    ids = spark.range(1, 2).select(F.col("id").alias("sample_id"))
    chains = codes.logical_classes(spark.createDataFrame([(1, 1), (1, 4)], "sample_id long, e int"), ids, 3)
    t, s = codes.random_bond(spark, chains, 3, 0.2)
    return bp.log_partition(bp.local_z(t, s, bp.start(t, s))).select("g", F.round("logz", 7).alias("logz"))


@query("connected_lattice_parts", "SELECT 1 AS component, 16 AS n")
def connected_lattice_parts(spark, sf_dir):
    e = lattices.square(spark, 4).select(F.col("u").alias("a"), F.col("w").alias("b"))
    return components(e).groupBy(F.col("component").cast("int").alias("component")).agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("interaction_graph", "WITH " + SMALL.format(L=6) + ", f AS (SELECT i * 6 + j AS id, v FROM small WHERE w = 4) SELECT CAST(count(DISTINCT a.id) AS INTEGER) AS loops, CAST(count(*) AS INTEGER) AS pairs FROM f a JOIN f b ON list_has_any(a.v, b.v)")
def interaction_graph(spark, sf_dir):
    found = table(loops.numbered(loops.find(lattices.square(spark, 6), 4)))
    return clusters.interactions(found).agg(F.count_distinct("loop_a").cast("int").alias("loops"), F.count(F.lit(1)).cast("int").alias("pairs"))


@query("loops_on_site", "WITH " + SMALL.format(L=6) + " SELECT CAST(site + 1 AS INTEGER) AS site, CAST(count(*) AS INTEGER) AS n FROM (SELECT unnest(v) AS site FROM small WHERE w = 4) GROUP BY site")
def loops_on_site(spark, sf_dir):
    found = loops.find(lattices.square(spark, 6), 4)
    return found.select(F.explode("vertices").alias("site")).groupBy("site").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("loops_in_network", "WITH " + SMALL.format(L=6) + " SELECT CAST(count(*) FILTER (i < 5 AND j < 5) AS INTEGER) AS inside, CAST(count(*) FILTER (i = 5 OR j = 5) AS INTEGER) AS outside FROM small WHERE w = 4")
def loops_in_network(spark, sf_dir):
    """Loops of the torus of which the open sheet lacks a link."""
    found = table(loops.numbered(loops.find(lattices.square(spark, 6), 4)))
    e = found.select("loop_id", F.explode("edges").alias("e")).select("loop_id", "e.u", "e.w")
    out = e.join(lattices.square(spark, 6, "open"), ["u", "w"], "left_anti").select("loop_id").distinct()
    n = found.agg(F.count(F.lit(1)).alias("n"))
    return n.join(out.agg(F.count(F.lit(1)).alias("o"))).select((F.col("n") - F.col("o")).cast("int").alias("inside"), F.col("o").cast("int").alias("outside"))


@query("d4_orbit", "WITH p AS (SELECT CAST(x AS INTEGER) AS i, CAST(y AS INTEGER) AS j FROM range(-2, 3) a(x), range(-2, 3) b(y)) SELECT i, j, (SELECT count(DISTINCT (x, y)) FROM (VALUES (i, j), (-i, -j), (j, -i), (-j, i), (i, -j), (-i, j), (j, i), (-j, -i)) t(x, y))::INTEGER AS images, least(i, -i, j, -j) AS least FROM p")
def d4_orbit(spark, sf_dir):
    p = spark.range(25).select((F.floor(F.col("id") / 5) - 2).cast("int").alias("i"), (F.col("id") % 5 - 2).cast("int").alias("j"))
    images = [C.square_image(F.col("i"), F.col("j"), k) for k in range(8)]
    return p.select("i", "j", F.size(F.array_distinct(F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in images]))).alias("images"), F.least(*[a for a, _ in images]).alias("least"))


@query("translate_loops", "WITH " + SITES.format(L=5) + " SELECT v, CAST((i % 5) * 5 + (j + 1) % 5 + 1 AS INTEGER) AS periodic, CAST(CASE WHEN i < 5 AND j < 4 THEN v + 7 ELSE -1 END AS INTEGER) AS open FROM sites")
def translate_loops(spark, sf_dir):
    return lattices.sites(spark, 5).select("v", C.translate(F.col("v"), 1, 2, 5).alias("periodic"), C.translate(F.col("v"), 1, 2, 5, "open").alias("open"))


@query("deformed_aklt", "SELECT CAST(phys AS INTEGER) AS phys, n::INTEGER AS n, round(w, 9) AS norm FROM (VALUES (1, 1, 1 / 6.0), (2, 4, 4 / 1.5 / 4), (3, 6, 1.0), (4, 4, 4 / 1.5 / 4), (5, 1, 1 / 6.0)) t(phys, n, w)")
def deformed_aklt(spark, sf_dir):
    return tensors.aklt_tensor(spark, 1.0, 1.0).groupBy("phys").agg(F.count(F.lit(1)).cast("int").alias("n"), F.round(F.sum(F.col("re") * F.col("re")), 9).alias("norm"))


@query("orthogonalised", "SELECT 16 AS entries, 1.0 AS norm, 0.0 AS along")
def orthogonalised(spark, sf_dir):
    t = tensors.orthogonalise(tensors.index_rows(spark, 4, 2).select("idx", F.aggregate("idx", F.lit(0.25), lambda a, k: a * (k + 0.5) + k).alias("re")), [0.6, 0.8])
    comp = F.array(F.lit(0.6), F.lit(0.8))
    t = table(t)
    along = t.groupBy(F.slice("idx", 1, 3)).agg(F.sum(F.col("re") * F.get(comp, F.col("idx")[3] - 1)).alias("a")).agg((F.round(F.max(F.abs("a")), 8) + 0.0).alias("along"))
    return t.agg(F.count(F.lit(1)).cast("int").alias("entries"), F.round(F.sqrt(F.sum(F.col("re") * F.col("re"))), 8).alias("norm")).join(along)


@query("open_sheet", """WITH s AS (SELECT list_transform(range(0, 12), lambda x: 1 - 2 * ((k >> x) & 1)) AS h FROM range(0, 4096) t(k))
SELECT round(ln(sum(exp(0.4 * (""" + " + ".join(
    f"h[{a}] * h[{b}]"
    for i in range(3)
    for j in range(3)
    for a, b in [(x, y) for x in ([3 * (i - 1) + j + 1] if i else []) + ([3 * i + j + 1] if i < 2 else []) for y in ([6 + 2 * i + j - 1 + 1] if j else []) + ([6 + 2 * i + j + 1] if j < 2 else [])]
) + ")))), 7) AS logz FROM s")
def open_sheet(spark, sf_dir):
    return exact.sheet(*tensors.ising_open(spark, 3, 3, 0.4)).select(F.round(F.log("re"), 7).alias("logz"))


@query("operator_dynamics", "SELECT round((1 - 0.04 / 3) * cos(0.1), 8) AS overlap")
def operator_dynamics(spark, sf_dir):
    """An X beside an identity on one pair: depolarised, then turned by ZZ, in which it keeps a cosine."""
    t, s = tensors.operator_dynamics(spark, 4, 2, [0, 1, 0, 0], [0, 1, 0, 0], p=0.01)
    return contract.contract_network(t, s).select(F.round("re", 8).alias("overlap"))


@query("boundary_state", "WITH " + RATES + """, b AS (SELECT g, [""" + ", ".join(f"coalesce(max(beta) FILTER (v = {v}), 0)" for v in range(1, 10)) + """] AS b FROM cells GROUP BY g),
s AS (SELECT list_transform(range(0, 12), lambda x: 1 - 2 * ((k >> x) & 1)) AS h FROM range(0, 4096) t(k))
SELECT CAST(g AS INTEGER) AS year, round(ln(sum(exp(""" + " + ".join(
    f"b[{3 * i + j + 1}] * h[{x}] * h[{y}]"
    for i in range(3)
    for j in range(3)
    for x, y in [(x, y) for x in ([3 * (i - 1) + j + 1] if i else []) + ([3 * i + j + 1] if i < 2 else []) for y in ([6 + 2 * i + j - 1 + 1] if j else []) + ([6 + 2 * i + j + 1] if j < 2 else [])]
) + "))), 7) AS logz FROM s, b GROUP BY g")
def boundary_state(spark, sf_dir):
    """The open sheet of the nine tax rates for each year of shipment, coupled by their lines' mean quantities."""
    cells = _cells(spark, sf_dir)
    net = cells.select("g").distinct().join(lattices.sites(spark, 3).select("v")).join(cells, ["g", "v"], "left")
    t, _ = tensors.ising_open(spark, 3, 3, net.select("g", "v", F.coalesce("beta", F.lit(0.0)).alias("beta")))
    return exact.boundary(t, 3, 3).select(F.col("g").cast("int").alias("year"), F.round("logz", 7).alias("logz"))
