"""Queries of the network operators on graphs that the tables hold: sums of products, messages, cycles, clusters, elimination."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import connected_sets, cycles, delta, elimination, overlap, singular, sumproduct
from ..operators.sumproduct import Factor
from ..session import shared_dir, table
from ..sources import manifest
from .registry import query, read


def _business(spark, sf_dir, *variables: str) -> dict[str, Factor]:
    """The seven tables as factors over their keys; lines weigh by revenue in millions, parts by size, suppliers by balance in ten thousands."""
    shapes = {
        "region": (("regionkey", "region"), F.lit(1.0)),
        "nation": (("nationkey", "regionkey", "nation"), F.lit(1.0)),
        "customer": (("custkey", "nationkey", "segment"), F.lit(1.0)),
        "orders": (("orderkey", "custkey"), F.when(F.col("o_orderstatus") == "F", 2.0).otherwise(1.0)),
        "lineitem": (("orderkey", "partkey", "suppkey"), F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1e6),
        "part": (("partkey",), F.col("p_size").cast("double")),
        "supplier": (("suppkey", "nationkey"), F.greatest(F.col("s_acctbal"), F.lit(0.0)) / 1e4),
    }
    names = {"region": "r_name", "nation": "n_name", "segment": "c_mktsegment"}
    out = {}
    for name, (vs, value) in shapes.items():
        kept = tuple(v for v in vs if v.endswith("key") or v in variables)
        column = lambda v, p=name[0]: names.get(v, f"{p}_{v}")
        out[name] = Factor(name, read(spark, sf_dir, name).select(*[F.col(column(v)).alias(v) for v in kept], value.alias("re")), kept)
    return out


REVENUE = "(CASE WHEN o_orderstatus = 'F' THEN 2.0 ELSE 1.0 END)::DOUBLE * (l_extendedprice * (1 - l_discount) / 1e6) * p_size * (greatest(s_acctbal, 0.0) / 1e4)"
JOINED = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query("sum_product", f"SELECT r_name AS region, round(sum({REVENUE}), 4) AS re {JOINED} GROUP BY 1")
def sum_product(spark, sf_dir):
    """A tree of seven tables: suppliers' nations are left out, so the customer's nation alone decides the region."""
    f = _business(spark, sf_dir, "region")
    f["supplier"] = Factor("supplier", f["supplier"].rows, ("suppkey",))
    return sumproduct.sum_product(list(f.values()), ("region",)).select("region", F.round("re", 4).alias("re"))


@query("sum_product_cycle", f"SELECT n_name AS nation, round(sum({REVENUE}), 4) AS re {JOINED} WHERE s_nationkey = c_nationkey AND r_name IN ('ASIA', 'EUROPE') GROUP BY 1")
def sum_product_cycle(spark, sf_dir):
    """Customer and supplier of one nation: customer, orders, lines and suppliers close a cycle; two regions' keys narrow the rest first."""
    f = _business(spark, sf_dir, "nation")
    f["region"] = Factor("region", read(spark, sf_dir, "region").where(F.col("r_name").isin("ASIA", "EUROPE")).select(F.col("r_regionkey").alias("regionkey"), F.lit(1.0).alias("re")), ("regionkey",))
    return sumproduct.sum_product(list(f.values()), ("nation",)).select("nation", F.round("re", 4).alias("re"))


@query("max_product", f"SELECT c_mktsegment AS segment, round(max({REVENUE}), 6) AS re {JOINED} GROUP BY 1")
def max_product(spark, sf_dir):
    """The same network under maximum and product: the best assignment's value in each segment."""
    f = _business(spark, sf_dir, "segment")
    f["supplier"] = Factor("supplier", f["supplier"].rows, ("suppkey",))
    return sumproduct.sum_product(list(f.values()), ("segment",), sumproduct.MAX).select("segment", F.round("re", 6).alias("re"))


#: Vertices of the region, nation and customer tree, numbered apart from each other.
TREE = """nodes AS (SELECT r_regionkey::BIGINT AS v, 0.1 * (r_regionkey - 2) AS h FROM region UNION ALL SELECT 1000 + n_nationkey, 0.0 FROM nation UNION ALL SELECT 1000000 + c_custkey, c_acctbal / 20000 FROM customer),
up AS (SELECT 1000000 + c_custkey AS v, 1000 + c_nationkey AS n, CASE c_mktsegment WHEN 'BUILDING' THEN 0.3 ELSE 0.1 END::DOUBLE AS j, c_acctbal / 20000 AS h FROM customer),
cn AS (SELECT v, n, j, h, atanh(tanh(j) * tanh(h)) AS m FROM up),
nat AS (SELECT 1000 + n_nationkey AS n, n_regionkey AS r, coalesce(sum(m), 0) AS inc FROM nation LEFT JOIN cn ON n = 1000 + n_nationkey GROUP BY ALL),
nr AS (SELECT n, r, inc, atanh(tanh(0.4::DOUBLE) * tanh(inc)) AS m FROM nat),
reg AS (SELECT r, 0.1 * (r - 2) + sum(m) AS total FROM nr GROUP BY r),
ntot AS (SELECT n, inc + atanh(tanh(0.4::DOUBLE) * tanh(total - m)) AS total FROM nr JOIN reg USING (r)),
totals AS (SELECT r::BIGINT AS v, total FROM reg UNION ALL SELECT n, total FROM ntot UNION ALL SELECT v, h + atanh(tanh(j) * tanh(total - m)) FROM cn JOIN ntot USING (n))"""


@query("tree_marginals", f"WITH {TREE} SELECT v, round(1 / (1 + exp(-2 * total)), 8) AS p FROM totals")
def tree_marginals(spark, sf_dir):
    """Two-valued regions, nations and customers: a tree, on which messages give the exact marginals."""
    region, nation, customer = (read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    r, n, c = F.col("r_regionkey").cast("long"), F.col("n_nationkey") + F.lit(1000).cast("long"), F.col("c_custkey") + F.lit(1_000_000).cast("long")
    fields = region.select(r.alias("v"), (0.1 * (F.col("r_regionkey") - 2)).alias("h")).union(customer.select(c, F.col("c_acctbal") / 20000))
    j = F.when(F.col("c_mktsegment") == "BUILDING", 0.3).otherwise(0.1)
    edges = nation.select(F.col("n_regionkey").cast("long").alias("u"), n.alias("w"), F.lit(0.4).alias("j")).union(customer.select(F.col("c_nationkey") + F.lit(1000).cast("long"), c, j))
    return delta.fixed_point(fields, edges).select("v", F.round("p", 8).alias("p"))


def _supplied_parts(spark, sf_dir):
    """A coupling (u, w, j) for each order line, of its supplier and part."""
    s, p = F.col("l_suppkey").cast("long") * 2, F.col("l_partkey").cast("long") * 2 + 1
    return read(spark, sf_dir, "lineitem").select(s.alias("u"), p.alias("w"), F.lit(0.005).cast("double").alias("j"))


def supplier_part_model(spark, sf_dir):
    """Fields and couplings of the graph of suppliers (even numbers) and parts (odd ones): balances and prices about their middle, and lines in common."""
    edges = _supplied_parts(spark, sf_dir).groupBy("u", "w").agg((0.005 * F.count(F.lit(1))).alias("j"))
    fields = read(spark, sf_dir, "supplier").select((F.col("s_suppkey").cast("long") * 2).alias("v"), (F.col("s_acctbal") / 10000).alias("h"))
    return fields.union(read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long") * 2 + 1, (F.col("p_retailprice") - 1400) / 2000)), edges


@query("graph_marginals")
def graph_marginals(spark, sf_dir):
    """Marginals on the supplier-part graph, whose cycles SQL cannot iterate over; tests hold them against whole rounds of all messages."""
    fields, _ = supplier_part_model(spark, sf_dir)
    # Lines of one supplier and part add their couplings, there as in the model, but are shuffled once.
    return delta.by_totals(fields, _supplied_parts(spark, sf_dir)).select("v", F.round("p", 5).alias("p"))


#: Parts and orders; two parts of one order; chains of three parts from the smallest on.
STEPS = """e AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
w AS (SELECT a.p AS p, a.o AS o, b.p AS q FROM e a JOIN e b ON a.o = b.o AND a.p <> b.p),
h AS (SELECT a.p AS p1, a.o AS o1, a.q AS p2, b.o AS o2, b.q AS p3 FROM w a JOIN w b ON a.q = b.p AND a.o <> b.o AND b.q <> a.p WHERE a.p < a.q AND a.p < b.q)"""


def _orders_of_parts(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chk"), F.col("l_partkey").alias("bit"))


@query("tanner_cycles", f"""WITH {STEPS}, six AS (SELECT p1, p2, p3 FROM h JOIN w ON w.p = p3 AND w.q = p1 AND w.o <> o1 AND w.o <> o2 WHERE p2 < p3)
SELECT bit, count(*) AS n FROM (SELECT unnest([p1, p2, p3]) AS bit FROM six) GROUP BY bit""")
def tanner_cycles(spark, sf_dir):
    """How many cycles of six edges of the graph of orders and their parts run through each part."""
    found = cycles.cycles(_orders_of_parts(spark, sf_dir), [6])
    return found.select(F.explode("bits").alias("bit")).groupBy("bit").agg(F.count(F.lit(1)).alias("n"))


@query("tanner_cycles_at", f"""WITH {STEPS}, t AS (SELECT min(p) AS least FROM e), g AS (SELECT * FROM h, t WHERE p1 = least),
six AS (SELECT p1, o1, p2, o2, p3, w.o AS o3 FROM g JOIN w ON w.p = p3 AND w.q = p1 AND w.o <> o1 AND w.o <> o2 WHERE o1 < w.o),
eight AS (SELECT x.p1, x.o1, x.p2, x.o2, x.p3, y.o2 AS o3, y.p2 AS p4, y.o1 AS o4 FROM g x JOIN g y ON x.p3 = y.p3 AND x.p2 <> y.p2 AND x.o1 NOT IN (y.o1, y.o2) AND x.o2 NOT IN (y.o1, y.o2) WHERE x.o1 < y.o1)
SELECT 6 AS length, p1 || ',' || p2 || ',' || p3 AS bits, o1 || ',' || o2 || ',' || o3 AS checks FROM six UNION ALL SELECT 8, p1 || ',' || p2 || ',' || p3 || ',' || p4, o1 || ',' || o2 || ',' || o3 || ',' || o4 FROM eight""")
def tanner_cycles_at(spark, sf_dir):
    """The cycles of six and eight edges through the smallest part, from paths that begin there."""
    pcm = _orders_of_parts(spark, sf_dir)
    least = pcm.agg(F.min("bit")).first()[0]
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return cycles.cycles(pcm, [6, 8], "bit", least).select("length", join("bits"), join("checks"))


@query("order_overlaps", "WITH e AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem) SELECT x.o AS a, y.o AS b, count(*) AS shared FROM e x JOIN e y ON x.p = y.p AND x.o < y.o GROUP BY 1, 2 HAVING count(*) >= 2")
def order_overlaps(spark, sf_dir):
    """Orders with two parts or more in common: orders are small sets and meet by pairs of parts."""
    return overlap.overlaps(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("set_id"), F.col("l_partkey").alias("e")))


@query("unequal_overlaps", "WITH e AS (SELECT DISTINCT 2 * l_orderkey + 1 AS s, l_partkey AS p FROM lineitem UNION SELECT DISTINCT 2 * l_suppkey, l_partkey FROM lineitem) SELECT x.s AS a, y.s AS b, count(*) AS shared FROM e x JOIN e y ON x.p = y.p AND x.s < y.s GROUP BY 1, 2 HAVING count(*) >= 4")
def unequal_overlaps(spark, sf_dir):
    """Sets of very unequal size, orders (odd numbers) and suppliers (even ones), with four parts or more in common."""
    line = read(spark, sf_dir, "lineitem")
    sets = line.select((2 * F.col("l_orderkey") + 1).alias("set_id"), F.col("l_partkey").alias("e")).union(line.select(2 * F.col("l_suppkey"), "l_partkey"))
    return overlap.overlaps(sets, 4)


#: Orders, weighed by their lines, and those that share two parts or more.
ORDER_GRAPH = """e AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
near AS (SELECT x.o AS u, y.o AS w FROM e x JOIN e y ON x.p = y.p AND x.o <> y.o GROUP BY 1, 2 HAVING count(*) >= 2),
v AS (SELECT l_orderkey AS v, count(*) AS weight FROM lineitem GROUP BY 1 HAVING count(*) <= {most}),
sets AS (SELECT [v] AS m, weight FROM v UNION SELECT list_sort(list_append(m, near.w)), sets.weight + v.weight FROM sets JOIN near ON list_contains(m, near.u) AND NOT list_contains(m, near.w) JOIN v ON v.v = near.w WHERE sets.weight + v.weight <= {most})"""


def _order_graph(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    near = overlap.overlaps(line.select(F.col("l_orderkey").alias("set_id"), F.col("l_partkey").alias("e")))
    return line.groupBy(F.col("l_orderkey").alias("v")).agg(F.count(F.lit(1)).alias("weight")), table(near.select(F.col("a").alias("u"), F.col("b").alias("w")))


@query("connected_orders", f"WITH RECURSIVE {ORDER_GRAPH.format(most=18)} SELECT array_to_string(m, ',') AS members, weight::BIGINT AS weight FROM sets WHERE len(m) > 1")
def connected_orders(spark, sf_dir):
    """Sets of two orders or more that hang together by shared parts, of at most 18 lines."""
    found = connected_sets.connected_sets(*_order_graph(spark, sf_dir), 18).where(F.size("members") > 1)
    return found.select(F.array_join(F.array_sort("members").cast("array<string>"), ",").alias("members"), "weight")


@query("connected_sums", f"""WITH RECURSIVE {ORDER_GRAPH.format(most=18)},
named AS (SELECT array_to_string(m, ',') AS members, m FROM sets WHERE len(m) BETWEEN 2 AND 5),
links AS (SELECT members, i, j FROM (SELECT members, m, unnest(range(1, len(m) + 1)) AS i FROM named) JOIN (SELECT members, unnest(range(1, len(m) + 1)) AS j FROM named) USING (members) JOIN near ON near.u = m[i] AND near.w = m[j] WHERE i < j),
parts AS (SELECT [0] AS r, 1 AS k UNION ALL SELECT list_append(r, c), greatest(k, c + 1) FROM parts, range(5) t(c) WHERE len(r) < 5 AND c <= k),
able AS (SELECT members, r, k FROM named JOIN parts ON len(r) = len(m) WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.members = named.members AND r[i] = r[j]))
SELECT members, sum(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * factorial((k - 1)::INT))::BIGINT AS total FROM able GROUP BY members""")
def connected_sums(spark, sf_dir):
    """The signed sums over connected subgraphs of those sets of up to five orders."""
    vertices, edges = _order_graph(spark, sf_dir)
    found = connected_sets.connected_sets(vertices, edges, 18).where(F.size("members").between(2, 5))
    linked = connected_sets.with_links(found.select(F.array_sort("members").alias("members")), edges)
    return linked.select(F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), connected_sets.connected_sum(F.col("links")).alias("total"))


@query("graph_rank", "WITH RECURSIVE e AS (SELECT DISTINCT 2 * l_suppkey AS s, 2 * l_partkey + 1 AS p FROM lineitem), near AS (SELECT s AS a, p AS b FROM e UNION SELECT p, s FROM e), reach AS (SELECT DISTINCT s AS root, s AS v FROM e UNION SELECT root, b FROM reach JOIN near ON a = reach.v), roots AS (SELECT v, min(root) AS root FROM reach GROUP BY v) SELECT (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM roots) AS vertices, ((SELECT count(*) FROM roots) - (SELECT count(DISTINCT root) FROM roots))::BIGINT AS rank")
def graph_rank(spark, sf_dir):
    """The edge-vertex matrix of the graph of suppliers and parts: its rank mod 2 is vertices less components."""
    edges = table(read(spark, sf_dir, "lineitem").select((2 * F.col("l_suppkey")).alias("s"), (2 * F.col("l_partkey") + 1).alias("p")).distinct())
    rank = elimination.pairs_rank(edges.select(F.col("p").alias("a"), F.col("s").alias("b")))
    return edges.agg(F.count(F.lit(1)).alias("edges"), (F.count_distinct("s") + F.count_distinct("p")).alias("vertices"), F.lit(rank).cast("long").alias("rank"))


def order_part_sides(spark, sf_dir):
    """Right-hand sides for the orders' parts: the parity of their dear parts, which those parts solve, and that of their lines."""
    line, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    dear = line.groupBy(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n")).join(part.where("p_retailprice > 1200").select("p_partkey"), "p_partkey")
    one = dear.groupBy("row").agg((F.sum("n") % 2).alias("b"))
    two = line.groupBy(F.col("l_orderkey").alias("row")).agg((2 * (F.max("l_linenumber") % 2)).cast("long").alias("b"))
    return one.union(two).where("b <> 0")


@query("order_part_solvable")
def order_part_solvable(spark, sf_dir):
    """Which parities of orders come from a choice of parts; SQL has no elimination, tests hold it against a plain one."""
    entries = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"))
    return elimination.solvable(entries, order_part_sides(spark, sf_dir), ["dear parts", "lines"])


@query("embedding_spectrum", "WITH e AS (SELECT row_number() OVER () AS r, embedding::DOUBLE[] AS x FROM embeddings), v AS (SELECT r, unnest(x) AS x, unnest(range(len(x))) AS k FROM e), g AS (SELECT a.k, b.k AS l, sum(a.x * b.x) AS g FROM v a JOIN v b ON a.r = b.r GROUP BY 1, 2) SELECT (SELECT max(len(x)) FROM e)::BIGINT AS n_values, round(sum(g) FILTER (k = l) / count(DISTINCT k), 6) AS mean_square, round(sum(g * g) / pow(sum(g) FILTER (k = l), 2), 8) AS concentration FROM g")
def embedding_spectrum(spark, sf_dir):
    """Singular values of the table of embeddings, seen by the trace of their squares and of their fourth powers."""
    s2 = singular.singular_values(read(spark, sf_dir, "embeddings"), "embedding") ** 2
    n, total = len(s2), float(s2.sum())
    return spark.createDataFrame([(n, round(total / n, 6), round(float((s2**2).sum()) / total**2, 8))] if n else [], "n_values long, mean_square double, concentration double")


@query("leading_singular_values")
def leading_singular_values(spark, sf_dir):
    """The five largest singular values of the embeddings from a random range; tests hold them against all of them."""
    found = singular.leading(read(spark, sf_dir, "embeddings"), "embedding", 5)
    return spark.createDataFrame([(k + 1, round(float(s), 4)) for k, s in enumerate(found)], "k int, value double")


@query("latest_whole_run", "SELECT o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice) / 1e6, 4) AS total FROM orders GROUP BY 1")
def latest_whole_run(spark, sf_dir):
    """Totals of orders saved twice, the second time only in part and then bereft of its files: the run before is what is loaded."""
    root = f"{shared_dir(spark)}/tensorloom-runs-{uuid.uuid4().hex}"
    totals = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    manifest.save(spark, root, {"totals": totals}, source="orders")
    broken = manifest.save(spark, root, {"totals": totals.where("n < 0")}, source="orders")
    manifest.drop(spark, root, broken)
    return manifest.load_latest(spark, root, "totals", source="orders").select("priority", "n", F.round(F.col("total") / 1e6, 4).alias("total"))
