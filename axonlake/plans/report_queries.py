"""Selections, counters, rollouts and kernels over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from axonlake.functions import basic
from axonlake.operators import kernels, reports
from axonlake.plans.graph_queries import NR, nations
from axonlake.plans.registry import query, six, table


@query("SELECT c_custkey AS id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def metadata_selection(spark, d):
    return reports.by_metadata(table(spark, d, "customer").withColumnRenamed("c_custkey", "id"), "c_mktsegment", ["BUILDING", "MACHINERY"])


@query("WITH b AS (SELECT unnest(range(0, 100)) AS batch), o AS (SELECT o_orderkey AS abs_row FROM orders) SELECT abs_row, CAST(least(99, abs_row // 1000) AS INT) AS batch, abs_row - least(99, abs_row // 1000) * 1000 AS \"row\" FROM o")
def row_locations(spark, d):
    batches = table(spark, d, "region").select(F.explode(F.sequence(F.lit(0), F.lit(99))).alias("batch")).distinct().withColumn("start", F.col("batch").cast("long") * 1000)
    return reports.located(table(spark, d, "orders").select(F.col("o_orderkey").alias("abs_row")), batches)


@query(f"WITH {NR} SELECT src, dst, count(*) AS n FROM nr WHERE src IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND dst IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY 1, 2")
def edges_in_set(spark, d):
    members = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("id"))
    return reports.edges_within(nations(spark, d), members).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT text, CASE WHEN doc_id % 3 <> 0 THEN lang END AS answer FROM documents), h AS (SELECT DISTINCT sha256(text) AS s FROM documents WHERE doc_id % 50 = 0),
r AS (SELECT a.*, sha256(text) IN (SELECT s FROM h) AS held, row_number() OVER (PARTITION BY text ORDER BY answer IS NULL, answer) AS k FROM a)
SELECT count(*) AS asked, count(*) FILTER (held) AS held_out, count(*) FILTER (NOT held AND k > 1) AS deduplicated, count(*) FILTER (NOT held AND k = 1 AND answer IS NOT NULL) AS answered, count(*) FILTER (NOT held AND k = 1 AND answer IS NULL) AS no_answer FROM r""")
def collect_counters(spark, d):
    docs = table(spark, d, "documents")
    asked = docs.select("text", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("answer"))
    return reports.collect_counters(asked, docs.where("doc_id % 50 = 0").select(F.sha2(F.col("text").cast("binary"), 256).alias("sha256")))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, sqrt(pow(l_quantity - t, 2) + pow(l_discount * 100 - t, 2)) <= 5 AS hit FROM (SELECT *, 50 * least(1.0, greatest(0.0, (l_quantity * 50 + l_discount * 100 * 50) / 5000)) AS t FROM lineitem)""")
def segment_hits(spark, d):
    li = table(spark, d, "lineitem")
    hit = reports.segment_hit(F.col("l_quantity"), F.col("l_discount") * 100, F.lit(0.0), F.lit(0.0), F.lit(50.0), F.lit(50.0), 5.0)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", hit.alias("hit"))


@query("SELECT o_orderpriority, count(*) AS episodes, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 6) AS success_rate, round(avg(o_custkey % 40), 6) AS mean_steps, round(avg(o_totalprice), 4) AS mean_return FROM orders GROUP BY 1")
def rollout_summary(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", (F.col("o_orderstatus") == "F").alias("success"), (F.col("o_orderstatus") == "O").alias("timeout"), (F.col("o_custkey") % 40).alias("steps"), F.lit(0).alias("collisions"), F.col("o_totalprice").alias("reward"))
    out = reports.rollout_summary(o, ["o_orderpriority"])
    return out.select("o_orderpriority", "episodes", six("success_rate").alias("success_rate"), six("mean_steps").alias("mean_steps"), F.round("mean_return", 4).alias("mean_return"))


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS n_scored, round(sum(CASE WHEN l_linestatus = 'F' THEN pow(l_discount, 2) + pow(l_tax, 2) END) / nullif(2 * count(*) FILTER (l_linestatus = 'F'), 0), 6) AS mse FROM lineitem GROUP BY 1")
def masked_error(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", F.col("l_discount").alias("ex"), F.col("l_tax").alias("ey"), (F.col("l_linestatus") == "F").alias("scored"))
    return reports.masked_mse(li, ["l_returnflag"]).withColumn("mse", six("mse"))


@query("SELECT 'balanced:' || count(*) || ':' || sha256(string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey)) AS fingerprint FROM supplier WHERE s_nationkey < 13")
def selection_fingerprint(spark, d):
    return reports.selection_fingerprint(table(spark, d, "supplier").where("s_nationkey < 13"), "balanced", "s_suppkey")


@query("SELECT DISTINCT p_brand, p_size FROM part p WHERE p_partkey % 5 = 0 AND NOT EXISTS (SELECT 1 FROM part q WHERE q.p_partkey % 5 <> 0 AND q.p_brand = p.p_brand AND q.p_size = p.p_size)")
def unseen_combinations(spark, d):
    p = table(spark, d, "part")
    return reports.unseen_combinations(p.where("p_partkey % 5 = 0"), p.where("p_partkey % 5 <> 0"), ["p_brand", "p_size"]).select("p_brand", "p_size").distinct()


@query("SELECT o_orderkey, round(-least(r * a, least(greatest(r, 0.8), 1.2) * a), 6) AS loss, r < 0.8 OR r > 1.2 AS clipped FROM (SELECT o_orderkey, exp((o_custkey % 100 - 50) / 100.0) AS r, (o_orderkey % 21 - 10) / 10.0 AS a FROM orders)")
def clipped_objective(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", ((F.col("o_custkey") % 100 - 50) / 100.0).alias("log_p"), F.lit(0.0).alias("old_log_p"), ((F.col("o_orderkey") % 21 - 10) / 10.0).alias("advantage"))
    return reports.clipped_objective(o).select("o_orderkey", six("loss").alias("loss"), "clipped")


@query(f"WITH {NR}, e AS (SELECT src, dst, count(*) / 100.0 AS w FROM nr GROUP BY 1, 2), n AS (SELECT src AS id FROM e UNION SELECT dst FROM e) SELECT id, round((1 - exp(-0.5)) * coalesce(sum(w * (src % 5)), 0), 6) AS v, round(tanh((1 - exp(-0.5)) * coalesce(sum(w * (src % 5)), 0)), 6) AS y FROM n LEFT JOIN e ON id = dst GROUP BY 1")
def leaky_step(spark, d):
    e = nations(spark, d).groupBy("src", "dst").agg((F.count("*") / 100.0).alias("weight"))
    state = e.select(F.col("dst").alias("id")).union(e.select("src")).distinct().select("id", F.lit(0.0).alias("v"), (F.col("id") % 5).cast("double").alias("y"))
    drive = state.select("id", F.lit(0.0).alias("input"))
    return kernels.leaky_step(state, e, drive, 2.0).select("id", six("v").alias("v"), six("y").alias("y"))


@query(None)
def spiking_run(spark, d):
    """Two variants of the nation graph as a spiking network; tests check its rules."""
    e = nations(spark, d).groupBy("src", "dst").agg((F.count("*") / 50.0).alias("weight"))
    variants = e.withColumn("variant", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long")))).select("variant", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.when(F.col("variant") == 0, F.col("weight")).otherwise(-F.col("weight")).alias("weight"))
    return kernels.lif_run(variants, list(range(25)), dict.fromkeys(range(5), 12.0), 20)


@query(f"WITH {NR}, e AS (SELECT src, dst, count(*) / 100.0 AS w FROM nr GROUP BY 1, 2) SELECT src, dst, round(least(1.5, greatest(0.0, w + 0.1 * (0.5 * 0.2 + (src % 5) * (dst % 3)))), 6) AS weight, round(CAST(0.5 * 0.2 + (src % 5) * (dst % 3) AS DOUBLE), 6) AS eligibility FROM e")
def plasticity_step(spark, d):
    e = nations(spark, d).groupBy("src", "dst").agg((F.count("*") / 100.0).alias("weight")).withColumn("eligibility", F.lit(0.2))
    # activity before is id % 5 on one side and id % 3 on the other, so the sides are told apart by two calls' inputs
    pre, post = (e.select(F.col(c).alias("id")).distinct().withColumn("y", (F.col("id") % k).cast("double")) for c, k in (("src", 5), ("dst", 3)))
    joined = kernels.hebbian_step(e.withColumn("src", F.col("src") + 1000), pre.withColumn("id", F.col("id") + 1000).unionByName(post), 0.1, 0.5, 0.0, 1.5)
    return joined.select((F.col("src") - 1000).alias("src"), "dst", six("weight").alias("weight"), six("eligibility").alias("eligibility"))


@query("SELECT s_suppkey AS cell, CASE s_suppkey % 4 WHEN 0 THEN 0.0 WHEN 1 THEN NULL ELSE round(CASE WHEN s_acctbal <= 0 THEN 0 ELSE 1 / (1 + exp(-1.5 * (ln(s_acctbal) - ln(3000)))) END, 6) END AS occupancy, s_suppkey % 4 = 3 AS assumed FROM supplier")
def receptor_occupancy(spark, d):
    s = table(spark, d, "supplier")
    status = F.when(F.col("s_suppkey") % 4 == 0, "unresponsive").when(F.col("s_suppkey") % 4 == 1, "unknown").when(F.col("s_suppkey") % 4 == 3, "hypothesized").otherwise("known")
    r = s.select(F.col("s_suppkey").alias("cell"), F.col("s_suppkey").alias("region"), F.lit(3000.0).alias("half"), F.lit(1.5).alias("power"), status.alias("status"))
    return kernels.occupancy(r, s.select(F.col("s_suppkey").alias("region"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).otherwise(0.0).alias("concentration"))).select("cell", six("occupancy").alias("occupancy"), "assumed")


@query("WITH r AS (SELECT n_nationkey AS region, n_nationkey * 0.8 + 1 AS c FROM nation) SELECT (region + k) % 25 AS region, round(sum(CAST(c * CASE k WHEN 0 THEN 0.75 ELSE 0.25 END AS DOUBLE)), 6) AS concentration FROM r, (SELECT unnest([0, 1]) AS k) GROUP BY 1")
def regional_step(spark, d):
    n = table(spark, d, "nation")
    regions = n.select(F.col("n_nationkey").alias("region"), F.col("n_nationkey").cast("double").alias("concentration"), F.lit(1.0).alias("release"))
    moves = n.select(F.col("n_nationkey").alias("source"), F.explode(F.array(F.struct(F.col("n_nationkey").alias("target"), F.lit(0.75).alias("share")), F.struct(((F.col("n_nationkey") + 1) % 25).alias("target"), F.lit(0.25).alias("share")))).alias("m")).select("source", "m.target", "m.share")
    return kernels.regional_step(regions, moves, 0.8).withColumn("concentration", six("concentration"))


@query("SELECT doc_id, CAST(floor(doc_id / 128) * 128 AS BIGINT) AS start, n_chars // 64 AS step FROM documents")
def step_windows(spark, d):
    return table(spark, d, "documents").select("doc_id", basic.window_start(F.col("doc_id"), 128).alias("start"), basic.floor_steps(F.col("n_chars"), 64, 1).alias("step"))
