"""Queries over the whole tables: networks, sets and statistics read from business data."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import bp, clusters, codes, contract, loops, series, stats
from ..operators.graph import components
from ..session import shared_dir, table
from ..sources import catalog, lattices
from ..streaming import pooled as pooled_stream
from ..streaming import result_files
from .registry import query, read

MONTH = lambda c: F.year(c) * 12 + F.month(c) - 1
MONTH_SQL = "(year({c}) * 12 + month({c}) - 1)"


@query("tn_edges", "WITH s AS (SELECT DISTINCT l_suppkey AS v, l_partkey AS p FROM lineitem) SELECT a.v AS u, b.v AS w, count(*) AS n FROM s a JOIN s b ON a.p = b.p AND a.v < b.v GROUP BY 1, 2")
def tn_edges(spark, sf_dir):
    return contract.edges_of(read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("v"), F.col("l_partkey").alias("link")))


@query("neighbours", "SELECT l_suppkey AS v, count(DISTINCT l_partkey) AS degree, min(l_partkey) AS least, max(l_partkey) AS most FROM lineitem GROUP BY 1")
def neighbours(spark, sf_dir):
    # Parts are numbered after the suppliers, so that the graph is bipartite.
    edges = lattices.graph_of(read(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey")
    top = read(spark, sf_dir, "lineitem").agg(F.max("l_suppkey").alias("top"))
    n = contract.neighbours(edges).join(F.broadcast(top)).where("v <= top")
    return n.select("v", F.size("nbrs").cast("long").alias("degree"), (F.array_min("nbrs") - F.col("top") - 1).alias("least"), (F.array_max("nbrs") - F.col("top") - 1).alias("most"))


@query("connected_components", "SELECT n_nationkey AS component, 1 + (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)")
def connected_components(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select((F.col("c_custkey") * 2 + 1_000_000).alias("a"), F.col("c_nationkey").cast("long").alias("b"))
    s = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2 + 1_000_001).alias("a"), F.col("s_nationkey").cast("long").alias("b"))
    return components(c.union(s)).groupBy(F.col("component").cast("int").alias("component")).agg(F.count(F.lit(1)).alias("n"))


@query("data_syndrome", "WITH pcm AS (SELECT DISTINCT l_suppkey AS chk, l_partkey AS bit FROM lineitem), x AS (SELECT p_partkey AS bit, CAST(p_retailprice > 1200 AS INTEGER) AS x FROM part) SELECT chk, CAST(sum(x) % 2 AS INTEGER) AS s FROM pcm JOIN x USING (bit) GROUP BY chk")
def data_syndrome(spark, sf_dir):
    pcm = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("chk"), F.col("l_partkey").alias("bit")).distinct()
    bits = read(spark, sf_dir, "part").select(F.lit(1).alias("sample_id"), F.col("p_partkey").alias("bit"), (F.col("p_retailprice") > 1200).cast("int").alias("x"))
    return codes.syndrome(pcm, bits).select("chk", "s")


@query("tanner_4cycles", "WITH pcm AS (SELECT DISTINCT l_orderkey AS chk, l_partkey AS bit FROM lineitem), n AS (SELECT a.chk AS chk_a, b.chk AS chk_b, count(*) AS shared FROM pcm a JOIN pcm b ON a.bit = b.bit AND a.chk < b.chk GROUP BY 1, 2) SELECT chk_a, chk_b, shared, shared * (shared - 1) // 2 AS cycles FROM n WHERE shared > 1")
def tanner_4cycles(spark, sf_dir):
    return codes.four_cycles(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chk"), F.col("l_partkey").alias("bit")))


@query("symdiff", "SELECT l_suppkey AS set_id, count(*) AS n, sum(l_partkey)::BIGINT AS total FROM (SELECT l_suppkey, l_partkey FROM lineitem GROUP BY 1, 2 HAVING count(*) % 2 = 1) GROUP BY 1")
def symdiff(spark, sf_dir):
    odd = codes.symmetric_difference(read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("set_id"), F.col("l_partkey").alias("e")))
    return odd.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("total"))


@query("cluster_dedup", "WITH m AS (SELECT l_orderkey, l_partkey AS p, count(*) AS k FROM lineitem GROUP BY 1, 2), c AS (SELECT l_orderkey, string_agg(p::VARCHAR || '*' || k::VARCHAR, ';' ORDER BY p) AS key, sum(k) AS total FROM m GROUP BY 1) SELECT count(*) AS clusters, count(DISTINCT key) AS classes, max(total)::BIGINT AS largest FROM c")
def cluster_dedup(spark, sf_dir):
    m = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count(F.lit(1)).cast("int").alias("k"))
    c = m.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_partkey").alias("loop_id"), F.col("k").alias("mult"))).alias("members"), F.sum("k").alias("total"))
    return c.select(clusters.key(F.col("members")).alias("key"), "total").agg(F.count(F.lit(1)).alias("clusters"), F.count_distinct("key").alias("classes"), F.max("total").alias("largest"))


@query("canonical_loops", "WITH e AS (SELECT DISTINCT l_orderkey AS id, least(l_partkey, l_suppkey) AS u, greatest(l_partkey, l_suppkey) AS w FROM lineitem) SELECT id, string_agg(u::VARCHAR || '-' || w::VARCHAR, ';' ORDER BY u, w) AS key, count(*) AS weight FROM e GROUP BY id")
def canonical_loops(spark, sf_dir):
    from ..functions import coords as C

    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(C.edge(F.col("l_partkey"), F.col("l_suppkey"))).alias("edges"))
    return lines.select("id", C.edge_key(loops.canonical(F.col("edges"))).alias("key"), F.size("edges").cast("long").alias("weight"))


@query("valid_loops", "WITH e AS (SELECT DISTINCT l_orderkey AS s, l_partkey AS u, 100000000 + l_suppkey AS w FROM lineitem), d AS (SELECT s, v, count(*) AS k FROM (SELECT s, u AS v FROM e UNION ALL SELECT s, w FROM e) GROUP BY 1, 2) SELECT s AS set_id, false AS valid FROM d GROUP BY s HAVING min(k) < 2")
def valid_loops(spark, sf_dir):
    e = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("set_id"), F.col("l_partkey").alias("u"), (F.col("l_suppkey") + 100_000_000).alias("w")).distinct()
    return loops.is_loop(e)


@query("argmax_decide", "WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM n) WHERE r = 1")
def argmax_decide(spark, sf_dir):
    n = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return codes.argmax_decide(n, ["user_id"], "n", "event_type")


@query("one_hot_bits", "SELECT p_partkey AS bit, CASE WHEN p_size > 30 THEN 0.0 WHEN p_size > 10 THEN 1.0 ELSE 0.5 END::DOUBLE AS p0, CASE WHEN p_size > 30 THEN 1.0 WHEN p_size > 10 THEN 0.0 ELSE 0.5 END::DOUBLE AS p1 FROM part")
def one_hot_bits(spark, sf_dir):
    x = F.when(F.col("p_size") > 30, 1).when(F.col("p_size") > 10, 0)
    hot = codes.one_hot(x)
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("bit"), hot[0].alias("p0"), hot[1].alias("p1"))


@query("pooled_stats", "SELECT l_returnflag, l_linestatus, count(*) AS total, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, round(stddev_samp(l_quantity) / sqrt(count(*)), 8) AS se FROM lineitem GROUP BY 1, 2")
def pooled_stats(spark, sf_dir):
    runs = stats.error_stats(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_suppkey"], "l_quantity")
    out = stats.pooled(runs, ["l_returnflag", "l_linestatus"])
    return out.select("l_returnflag", "l_linestatus", "total", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round("se", 8).alias("se"))


@query("pooled_stream", "SELECT l_returnflag, count(*) AS total, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std FROM lineitem GROUP BY 1")
def pooled_stream_query(spark, sf_dir):
    """The same pooling as result files arrive: two files, one after the other, through a file stream."""
    runs = stats.error_stats(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_suppkey"], "l_quantity")
    folder = f"{shared_dir(spark)}/tensorloom-stream-{uuid.uuid4().hex}"
    runs.repartition(2, "l_suppkey").write.parquet(f"{folder}/in")
    name = f"pooled_{uuid.uuid4().hex}"
    q = pooled_stream(result_files(spark, f"{folder}/in", "l_returnflag string, l_suppkey bigint, n bigint, mean double, std double", files=1), ["l_returnflag"])
    running = q.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table(name).select("l_returnflag", "total", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("batch_stats", "WITH b AS (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY 1, 2) SELECT event_type, count(m) AS batches, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS std FROM b GROUP BY 1")
def batch_stats(spark, sf_dir):
    out = stats.batch_stats(read(spark, sf_dir, "events"), ["event_type"], "user_id", "value")
    return out.select("event_type", "batches", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("error_stats", "SELECT o_orderpriority, count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std FROM orders GROUP BY 1")
def error_stats(spark, sf_dir):
    out = stats.error_stats(read(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice")
    return out.select("o_orderpriority", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("decay_fit", "WITH n AS (SELECT l_returnflag, l_linenumber AS x, count(*)::DOUBLE AS y FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, CASE WHEN count(*) >= 3 THEN round(-regr_slope(ln(y), x), 8) END AS rate, CASE WHEN count(*) >= 3 THEN round(regr_intercept(ln(y), x), 8) END AS intercept, CASE WHEN count(*) >= 3 THEN round(regr_r2(ln(y), x), 8) END AS r2 FROM n GROUP BY 1")
def decay_fit(spark, sf_dir):
    n = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.col("l_linenumber").cast("double").alias("x")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    out = stats.decay_fit(n, ["l_returnflag"], "x", "y")
    return out.select("l_returnflag", *[F.round(c, 8).alias(c) for c in ("rate", "intercept", "r2")])


@query("decay_ratio", "WITH n AS (SELECT l_returnflag, l_linenumber AS x, count(*)::DOUBLE AS y FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, CAST(arg_min(x, y) AS INTEGER) AS rarest, CAST(arg_max(x, y) AS INTEGER) AS commonest, round(max(y) / min(y), 8) AS ratio FROM n GROUP BY 1")
def decay_ratio(spark, sf_dir):
    n = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.col("l_linenumber").alias("x")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    return n.groupBy("l_returnflag").agg(F.min_by("x", "y").alias("rarest"), F.max_by("x", "y").alias("commonest"), F.round(F.max("y") / F.min("y"), 8).alias("ratio"))


@query("improvement_ratio", "SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, round(CASE WHEN sum(CASE WHEN l_returnflag = 'R' THEN l_discount ELSE 0 END) = 0 THEN 1 ELSE sum(CASE WHEN l_returnflag <> 'R' THEN l_discount ELSE 0 END) / sum(CASE WHEN l_returnflag = 'R' THEN l_discount ELSE 0 END) END, 5) AS ratio, round(sum(CASE WHEN l_returnflag <> 'R' THEN l_discount ELSE 0 END) / greatest(sum(CASE WHEN l_returnflag = 'R' THEN l_discount ELSE 0 END), 0.01), 5) AS bounded FROM lineitem GROUP BY 1")
def improvement_ratio(spark, sf_dir):
    d = lambda flag: F.sum(F.when(flag, F.col("l_discount")).otherwise(0.0))
    day = read(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")).agg(d(F.col("l_returnflag") == "R").alias("with_"), d(F.col("l_returnflag") != "R").alias("without"))
    return day.select("day", F.round(stats.improvement(F.col("without"), F.col("with_")), 5).alias("ratio"), F.round(F.col("without") / F.greatest("with_", F.lit(0.01)), 5).alias("bounded"))


@query("missing_combos", "SELECT u.user_id, t.event_type FROM (SELECT DISTINCT user_id FROM events) u, (SELECT DISTINCT event_type FROM events) t WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = t.event_type)")
def missing_combos(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    expected = e.select("user_id").distinct().join(e.select("event_type").distinct(), how="cross")
    return stats.missing(expected, e, ["user_id", "event_type"])


@query("completion_rate", "WITH x AS (SELECT u.user_id, t.event_type FROM (SELECT DISTINCT user_id FROM events) u, (SELECT DISTINCT event_type FROM events) t), f AS (SELECT DISTINCT user_id, event_type FROM events) SELECT count(*) AS expected, count(f.user_id) AS found, round(count(f.user_id) / count(*), 8) AS rate FROM x LEFT JOIN f ON x.user_id = f.user_id AND x.event_type = f.event_type")
def completion_rate(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    expected = e.select("user_id").distinct().join(e.select("event_type").distinct(), how="cross")
    return stats.completion(expected, e, ["user_id", "event_type"]).withColumn("rate", F.round("rate", 8))


MONTHS = "m AS (SELECT o_orderpriority AS k, " + MONTH_SQL.format(c="o_orderdate") + " AS x, count(*)::DOUBLE AS y FROM orders GROUP BY 1, 2)"


def _months(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("k"), MONTH("o_orderdate").cast("double").alias("x")).agg(F.count(F.lit(1)).cast("double").alias("y"))


@query("first_derivative", "WITH " + MONTHS + " SELECT k, x::DOUBLE AS x, round((coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y)) / nullif(coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x), 0), 8) AS d1 FROM m WINDOW w AS (PARTITION BY k ORDER BY x)")
def first_derivative(spark, sf_dir):
    return stats.first_derivative(_months(spark, sf_dir), ["k"], "x", "y").select("k", "x", F.round("d1", 8).alias("d1"))


D2 = MONTHS + """, s AS (SELECT k, x, (lag(y) OVER w - 2 * y + lead(y) OVER w) / pow(lead(x) OVER w - x, 2) AS d FROM m WINDOW w AS (PARTITION BY k ORDER BY x)),
d2 AS (SELECT k, x, coalesce(d, lead(d) OVER w, lag(d) OVER w) AS d2 FROM s WINDOW w AS (PARTITION BY k ORDER BY x))"""


@query("second_derivative", "WITH " + D2 + " SELECT k, x::DOUBLE AS x, round(d2, 8) AS d2 FROM d2")
def second_derivative(spark, sf_dir):
    return stats.second_derivative(_months(spark, sf_dir), ["k"], "x", "y").select("k", "x", F.round("d2", 8).alias("d2"))


@query("peak", "WITH " + D2 + " SELECT k, x::DOUBLE AS peak FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY abs(d2) DESC, x) AS r FROM d2 WHERE d2 IS NOT NULL) WHERE r = 1")
def peak(spark, sf_dir):
    return stats.peak(stats.second_derivative(_months(spark, sf_dir), ["k"], "x", "y"), ["k"], "x", "d2")


@query("cumulative_by_weight", "WITH a AS (SELECT l_returnflag AS g, l_linenumber AS weight, sum(l_quantity) AS own FROM lineitem GROUP BY 1, 2) SELECT g, weight, round(own, 3) AS own, round(sum(own) OVER (PARTITION BY g ORDER BY weight), 3) AS upto FROM a")
def cumulative_by_weight(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_linenumber").alias("weight"), "l_quantity")
    return series.cumulative(rows, "l_quantity").select("g", "weight", F.round("at", 3).alias("own"), F.round("upto", 3).alias("upto"))


@query("nearest_param", "WITH t AS (SELECT 900 + 10.5 * k AS target FROM range(0, 100) t(k)), p AS (SELECT p_retailprice AS x, min(p_partkey) AS k FROM part GROUP BY 1), j AS (SELECT target, x, k, row_number() OVER (PARTITION BY target ORDER BY abs(x - target), x) AS r FROM t JOIN p ON abs(x - target) <= 4) SELECT target::DOUBLE AS target, x, k FROM j WHERE r = 1")
def nearest_param(spark, sf_dir):
    prices = read(spark, sf_dir, "part").groupBy(F.col("p_retailprice").alias("x")).agg(F.min("p_partkey").alias("k"))
    targets = spark.range(100).select((900 + 10.5 * F.col("id")).alias("target"))
    return stats.nearest(prices, targets, "x", "target", 4.0)


@query("coalesce_metric", "SELECT c_custkey, round(coalesce(max(o_totalprice), c_acctbal), 4) AS metric FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_acctbal")
def coalesce_metric(spark, sf_dir):
    spent = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("newest"))
    rows = read(spark, sf_dir, "customer").join(spent, "c_custkey", "left")
    return rows.select("c_custkey", F.round(stats.first_known(rows, ["newest", "absent_key", "c_acctbal"]), 4).alias("metric"))


@query("finite_filter", "SELECT l_returnflag, count(*) AS n, round(sum(r), 6) AS total FROM (SELECT l_returnflag, l_quantity / l_discount AS r FROM lineitem WHERE l_discount <> 0) GROUP BY 1")
def finite_filter(spark, sf_dir):
    r = F.when(F.col("l_discount") == 0, float("inf")).otherwise(F.try_divide("l_quantity", "l_discount"))
    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", r.alias("r")).where(stats.finite(F.col("r")))
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("r"), 6).alias("total"))


@query("relative_error", "WITH m AS (SELECT c_mktsegment, avg(c_acctbal) AS f FROM customer GROUP BY 1), a AS (SELECT avg(c_acctbal) AS e FROM customer) SELECT c_mktsegment, round((f - e) / abs(e), 8) AS error FROM m, a")
def relative_error(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    exact = c.agg(F.avg("c_acctbal").alias("e"))
    return c.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("f")).join(F.broadcast(exact)).select("c_mktsegment", F.round(series.relative_error(F.col("f"), F.col("e")), 8).alias("error"))


@query("embedding_gram", "WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS k FROM embeddings), s AS (SELECT label, k, sum(x) AS x FROM e GROUP BY 1, 2) SELECT a.label AS a, b.label AS b, round(sum(a.x * b.x), 3) AS re FROM s a JOIN s b ON a.k = b.k GROUP BY 1, 2")
def embedding_gram(spark, sf_dir):
    """Overlaps of the labels' summed vectors: a two-leg contraction."""
    e = read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("k", "x")).groupBy("label", "k").agg(F.sum(F.col("x").cast("double")).alias("re"))
    e = table(e)
    return contract.contract(e.withColumnRenamed("label", "a"), e.withColumnRenamed("label", "b"), ["k"]).select("a", "b", F.round("re", 3).alias("re"))


@query("complex_product", "WITH a AS (SELECT l_linenumber AS k, l_returnflag AS i, sum(l_discount) AS re, sum(l_tax) AS im FROM lineitem GROUP BY 1, 2) SELECT x.i AS a, y.i AS b, round(sum(x.re * y.re - x.im * y.im), 3) AS re, round(sum(x.re * y.im + x.im * y.re), 3) AS im FROM a x JOIN a y ON x.k = y.k GROUP BY 1, 2")
def complex_product(spark, sf_dir):
    t = read(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("k"), F.col("l_returnflag").alias("i")).agg(F.sum("l_discount").alias("re"), F.sum("l_tax").alias("im"))
    out = contract.contract_complex(t.withColumnRenamed("i", "a"), t.withColumnRenamed("i", "b"), ["k"])
    return out.select("a", "b", F.round("re", 3).alias("re"), F.round("im", 3).alias("im"))


@query("bp_marginals", "WITH n AS (SELECT n_nationkey, n_regionkey, count(c_custkey) AS c FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL), s AS (SELECT n_regionkey, count(*) AS k, sum(c)::BIGINT % 2 AS s FROM n GROUP BY 1), o AS (SELECT n_nationkey, s, 0.1 * (1 - pow(0.8, k - 1) * CASE WHEN s = 1 THEN -1 ELSE 1 END) / 2 AS one, 0.9 * (1 + pow(0.8, k - 1) * CASE WHEN s = 1 THEN -1 ELSE 1 END) / 2 AS zero FROM n JOIN s USING (n_regionkey)) SELECT n_nationkey::BIGINT AS v, k, round(CASE k WHEN 1 THEN one ELSE zero END / (one + zero), 8) AS p FROM o, range(0, 2) t(k)")
def bp_marginals(spark, sf_dir):
    """Each nation is a bit and each region a check on the parity of its customers: a forest, on which the factor graph's messages are exact."""
    nation, customer = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer")
    pcm = nation.select((F.col("n_regionkey") + 1).cast("int").alias("chk"), (F.col("n_nationkey") + 1).cast("int").alias("bit"))
    per = nation.join(customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy((F.col("n_regionkey") + 1).cast("int").alias("chk")).agg((F.count("c_custkey") % 2).cast("int").alias("s"))
    t, s = codes.factor_graph(pcm, per, 0.1)
    m = bp.fixed_point(t, s, bp.start(t, s), rounds=4)
    p = bp.marginals(t, s, m, F.col("idx")[0]).join(F.broadcast(pcm.select(F.col("bit").alias("v"))), "v", "left_semi")
    return p.select((F.col("v") - 1).cast("long").alias("v"), (F.col("k") - 1).cast("long").alias("k"), F.round("p", 8).alias("p"))


@query("catalog_round_trip", "SELECT 36 AS n, 'b' AS run, 0 AS missing")
def catalog_round_trip(spark, sf_dir):
    """Two saved runs, the latest loaded; the tasks that no result file has."""
    root = f"{shared_dir(spark)}/tensorloom-catalog-{uuid.uuid4().hex}"
    found = loops.numbered(loops.find(lattices.square(spark, 6), 4))
    catalog.save_run(spark, root, {"loops": found.limit(0)}, L=6, max_weight=4, bc="periodic", run="a")
    catalog.save_run(spark, root, {"loops": found}, L=6, max_weight=4, bc="periodic", run="b")
    latest = catalog.runs(spark, root, L=6).limit(1).select("run")
    catalog.write_results(spark.range(1, 5).select(F.col("id").alias("task"), F.lit(0.5).alias("value")), f"{root}/results", "csv")
    left = catalog.missing_tasks(catalog.read_results(spark, [f"{root}/results"], "task bigint, value double", "csv"), 1, 4)
    n = catalog.load_latest(spark, root, "loops", L=6, bc="periodic").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return n.join(latest).join(left.agg(F.count(F.lit(1)).cast("int").alias("missing")))
