"""Statistics: quantiles, windowed measures, thresholds, comparisons of runs, benchmark verdicts.

Steps are days of the event table; a user is a node and an event of a type a spike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonlake.operators import metrics, reports, selection
from axonlake.plans.registry import micros, query, six, table

T = "trace AS (SELECT user_id AS id, CAST(floor((epoch_us(ts) - 1704067200000000) / 86400000000) AS BIGINT) AS step, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS spike, value AS output FROM events)"
S = "sets AS (SELECT DISTINCT 'even' AS set, user_id AS id FROM events WHERE user_id % 2 = 0 UNION SELECT DISTINCT 'third', user_id FROM events WHERE user_id % 3 = 0)"
W = "wins AS (SELECT * FROM (VALUES ('base', 0, 7), ('mid', 7, 14), ('late', 14, 100)) t(win, low, high))"
M = f"""{T}, {S}, {W}, got AS (SELECT set, win, count(DISTINCT CASE WHEN spike > 0 THEN id END) AS spiked, sum(spike) AS spikes, min(CASE WHEN spike > 0 THEN step END) AS first_step, sum(output) AS output FROM trace JOIN sets USING (id) JOIN wins ON step >= low AND step < high GROUP BY 1, 2),
m AS (SELECT s.set, w.win, low, high, members, coalesce(spiked, 0) AS spiked, CAST(coalesce(spikes, 0) AS BIGINT) AS spikes, first_step, coalesce(output, 0.0) AS output FROM (SELECT set, count(*) AS members FROM sets GROUP BY 1) s CROSS JOIN wins w LEFT JOIN got g ON g.set = s.set AND g.win = w.win)"""
L = f"""{M}, long AS (
 SELECT set, win AS "window", 'spike_fraction' AS metric, spiked / members AS value FROM m UNION ALL
 SELECT set, win, 'mean_rate', spikes / (members * (high - low)) FROM m UNION ALL
 SELECT set, win, 'latency_to_first_spike', CAST(first_step - low AS DOUBLE) FROM m UNION ALL
 SELECT set, win, 'mean_output', output / (members * (high - low)) FROM m UNION ALL
 SELECT a.set, a.win, 'activity_ratio_vs_baseline', (a.spikes / (a.high - a.low)) / nullif(b.spikes / (b.high - b.low), 0) FROM m a JOIN m b ON a.set = b.set AND b.win = 'base')"""


def trace(spark: SparkSession, d: str) -> DataFrame:
    step = F.floor((micros("ts") - 1704067200000000) / 86400000000).cast("long")
    return table(spark, d, "events").select(F.col("user_id").alias("id"), step.alias("step"), (F.col("event_type") == "click").cast("int").alias("spike"), F.col("value").alias("output"))


def measures(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "events").select(F.col("user_id").alias("id")).distinct()
    sets = users.where("id % 2 = 0").select(F.lit("even").alias("set"), "id").union(users.where("id % 3 = 0").select(F.lit("third"), "id"))
    windows = spark.createDataFrame([("base", 0, 7), ("mid", 7, 14), ("late", 14, 100)], "window string, low int, high int")
    return metrics.window_measures(trace(spark, d), sets, windows)


@query(f"WITH {M} SELECT set, win AS \"window\", members, spiked, spikes, first_step, round(output, 6) AS output FROM m")
def window_set_measurements(spark, d):
    return measures(spark, d).select("set", "window", "members", "spiked", "spikes", "first_step", six("output").alias("output"))


@query(f"WITH {L} SELECT set, \"window\", metric, round(value, 6) AS value, value IS NOT NULL AS defined FROM long WHERE metric <> 'activity_ratio_vs_baseline'")
def window_metrics(spark, d):
    return metrics.metrics(measures(spark, d)).select("set", "window", "metric", six("value").alias("value"), "defined")


@query(f"WITH {L} SELECT set, \"window\", round(value, 6) AS value FROM long WHERE metric = 'activity_ratio_vs_baseline'")
def activity_ratio_vs_baseline(spark, d):
    return metrics.metrics(measures(spark, d), "base").where("metric = 'activity_ratio_vs_baseline'").select("set", "window", six("value").alias("value"))


@query(f"WITH {L} SELECT set, \"window\", metric, coalesce(value >= 0.5, false) AS passed, CASE WHEN coalesce(value >= 0.5, false) THEN '' WHEN value IS NULL THEN 'undefined' ELSE 'threshold' END AS reason FROM long")
def thresholds(spark, d):
    return metrics.judged(metrics.metrics(measures(spark, d), "base"), ">=", 0.5).select("set", "window", "metric", "passed", "reason")


@query("SELECT l_returnflag, quantile_disc(l_extendedprice, 0.25) AS p25, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.75) AS p75, max(l_extendedprice) AS p100, min(l_extendedprice) AS p0 FROM lineitem GROUP BY 1")
def quantiles_nearest_rank(spark, d):
    return selection.nearest_ranks(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {f"p{round(100 * q)}": q for q in (0, 0.25, 0.5, 0.75, 1)})


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY 1")
def quantiles_linear(spark, d):
    names = {f"p{round(100 * q)}": q for q in (0.25, 0.5, 0.9)}
    rows = selection.linear_quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", names)
    return rows.select("l_returnflag", *(F.round(name, 4).alias(name) for name in names))


V = "cells AS (SELECT l_linenumber AS metric, l_suppkey % 10 AS kind, avg(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"


def _cells(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("metric"), (F.col("l_suppkey") % 10).alias("kind")).agg(F.avg("l_quantity").alias("value"))


@query(f"WITH {V} SELECT a.metric, a.kind, round(a.value - b.value, 6) AS delta FROM cells a LEFT JOIN cells b ON a.metric = b.metric AND b.kind = 0")
def delta_from_original(spark, d):
    return metrics.delta_from(_cells(spark, d), F.col("kind") == 0, ["metric"]).select("metric", "kind", six("delta").alias("delta"))


@query(f"""WITH {V}, r AS (SELECT a.metric, a.kind % 3 AS family, a.value, b.value AS ref FROM cells a LEFT JOIN cells b ON a.metric = b.metric AND b.kind = 0 WHERE a.kind <> 0)
SELECT metric, family, count(*) AS seeds, round(quantile_disc(value, 0.5), 6) AS p50, round((count(*) FILTER (value < ref) + 0.5 * count(*) FILTER (value = ref)) / count(*), 6) AS percentile FROM r GROUP BY 1, 2""")
def null_percentile(spark, d):
    cells = _cells(spark, d).withColumn("family", F.col("kind") % 3)
    return metrics.variant_summary(cells, F.col("kind") == 0, "family", ["metric"]).select("metric", "family", "seeds", six("p50").alias("p50"), six("percentile").alias("percentile"))


@query(f"WITH {T}, p AS (SELECT id, sum(spike) AS s, count(DISTINCT step) AS k FROM trace GROUP BY 1) SELECT count(*) AS nodes, count(*) FILTER (s = 0) AS silent, round(avg(s / k), 6) AS mean_rate, round(count(*) FILTER (s = 0) / count(*), 6) AS silent_fraction FROM p")
def stability_monitor(spark, d):
    t = trace(spark, d)
    return metrics.stability(t, t.select("id")).select("nodes", "silent", six("mean_rate").alias("mean_rate"), six("silent_fraction").alias("silent_fraction"))


@query(f"WITH {T}, n AS (SELECT count(DISTINCT id) AS n FROM trace) SELECT step, count(DISTINCT id) FILTER (spike > 0) AS spiking, round(count(DISTINCT id) FILTER (spike > 0) / max(n), 6) AS rate FROM trace, n GROUP BY 1")
def population_rates(spark, d):
    t = trace(spark, d)
    return metrics.population_rates(t, t.select("id")).withColumn("rate", six("rate"))


@query(f"WITH {T}, r AS (SELECT id, sum(spike) / 31.0 AS rate FROM trace GROUP BY 1) SELECT round(quantile_cont(rate, 0), 6) AS p0, round(quantile_cont(rate, 0.25), 6) AS p25, round(quantile_cont(rate, 0.5), 6) AS p50, round(quantile_cont(rate, 0.75), 6) AS p75, round(quantile_cont(rate, 1), 6) AS p100 FROM r")
def rate_quantiles(spark, d):
    t = trace(spark, d)
    out = metrics.rate_quantiles(t, t.select("id"), 31)
    return out.select(*(six(c).alias(c) for c in out.columns))


@query(f"WITH {T} SELECT step, CAST(sum(spike) AS BIGINT) AS spikes, round(avg(output), 6) AS mean_output, round(sum(spike) / count(DISTINCT id), 6) AS spike_fraction FROM trace GROUP BY 1")
def probe_reductions(spark, d):
    return trace(spark, d).groupBy("step").agg(F.sum("spike").alias("spikes"), six(F.avg("output")).alias("mean_output"), six(F.sum("spike") / F.countDistinct("id")).alias("spike_fraction"))


@query(f"""WITH {T}, m AS (SELECT DISTINCT id, id % 3 AS probe FROM trace), z AS (SELECT probe, count(*) AS n FROM m GROUP BY 1), x AS (SELECT id, step, sum(output) AS output, max(CASE WHEN spike > 0 THEN 1 ELSE 0 END) AS spiked FROM trace GROUP BY 1, 2)
SELECT probe, step, round(sum(output), 4) AS sum_output, round(sum(output) / max(n), 6) AS mean_output, CAST(sum(spiked) AS BIGINT) AS spike_count, round(sum(spiked) / max(n), 6) AS spike_fraction FROM x JOIN m USING (id) JOIN z USING (probe) GROUP BY 1, 2""")
def probe_series(spark, d):
    t = trace(spark, d)
    out = metrics.probe_series(t, t.select("id", (F.col("id") % 3).alias("probe")))
    return out.select("probe", "step", F.round("sum_output", 4).alias("sum_output"), six("mean_output").alias("mean_output"), "spike_count", six("spike_fraction").alias("spike_fraction"))


@query("SELECT event_type, count(*) FILTER (value >= 5) AS succeeded, count(*) FILTER (value < 5) AS failed_runs, round(avg(value) FILTER (value >= 5), 6) AS mean, round(stddev_pop(value) FILTER (value >= 5), 6) AS std FROM events GROUP BY 1")
def cell_stats(spark, d):
    e = table(spark, d, "events").withColumn("failed", F.col("value") < 5)
    return metrics.cell_stats(e, ["event_type"], "value").select("event_type", "succeeded", "failed_runs", six("mean").alias("mean"), six("std").alias("std"))


@query("""WITH s AS (SELECT user_id AS task, CAST(floor((epoch_us(ts) - 1704067200000000) / 432000000000) AS BIGINT) AS stage, round(avg(value), 6) AS score FROM events GROUP BY 1, 2)
SELECT task, stage, score, round(max(score) OVER (PARTITION BY task ORDER BY stage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - score, 6) AS forgetting FROM s""")
def forgetting(spark, d):
    s = table(spark, d, "events").groupBy(F.col("user_id").alias("task"), F.floor((micros("ts") - 1704067200000000) / 432000000000).cast("long").alias("stage")).agg(six(F.avg("value")).alias("score"))
    return metrics.forgetting(s, ["task"]).withColumn("forgetting", six("forgetting"))


@query("""WITH a AS (SELECT l_suppkey AS seed, avg(l_quantity) AS score, l_suppkey % 7 = 0 AS failed FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1), b AS (SELECT l_suppkey AS seed, avg(l_quantity) AS score, l_suppkey % 5 = 0 AS failed FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), j AS (SELECT seed, a.score - b.score AS difference, a.failed OR b.failed AS bad FROM a JOIN b USING (seed))
SELECT seed, round(difference, 6) AS difference, (SELECT count(*) FROM j WHERE bad) AS n_dropped FROM j WHERE NOT bad""")
def paired_differences(spark, d):
    side = lambda flag, k: table(spark, d, "lineitem").where(F.col("l_returnflag") == flag).groupBy(F.col("l_suppkey").alias("seed")).agg(F.avg("l_quantity").alias("score"), (F.first("l_suppkey") % k == 0).alias("failed"))
    return metrics.paired(side("N", 7), side("R", 5), ["seed"]).withColumn("difference", six("difference"))


@query(None)
def bootstrap_interval(spark, d):
    """95 % interval of the mean difference of quantities by supplier; draws are Spark's own hash."""
    side = lambda flag: table(spark, d, "lineitem").where(F.col("l_returnflag") == flag).groupBy(F.col("l_suppkey").alias("seed")).agg(F.avg("l_quantity").alias("score"), F.lit(False).alias("failed"))
    return metrics.bootstrap(metrics.paired(side("N"), side("R"), ["seed"]))


@query("SELECT l_linestatus, count(l_extendedprice) AS n, round(avg(l_extendedprice), 4) AS mean, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.9) AS p90, quantile_disc(l_extendedprice, 0.99) AS p99, min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem GROUP BY 1")
def latency_summary(spark, d):
    return metrics.latency_summary(table(spark, d, "lineitem"), ["l_linestatus"], "l_extendedprice").withColumn("mean", F.round("mean", 4))


@query("""WITH r AS (SELECT l_suppkey AS name, l_suppkey % 2 AS host, avg(l_extendedprice) AS latency, avg(l_quantity) AS quality FROM lineitem GROUP BY 1), c AS (SELECT * FROM r WHERE name >= 3), b AS (SELECT * FROM r WHERE name < 3)
SELECT c.name, b.name AS baseline, c.host = b.host AS comparable, CASE WHEN c.host = b.host THEN round(c.latency / b.latency, 6) END AS latency_ratio, CASE WHEN c.host = b.host THEN CAST(c.quality - b.quality >= -0.5 AND c.latency / b.latency < 1 AS INT) END AS wins FROM c CROSS JOIN b""")
def bench_verdict(spark, d):
    r = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("name")).agg(F.avg("l_extendedprice").alias("latency"), F.avg("l_quantity").alias("quality")).withColumn("host", F.col("name") % 2)
    return metrics.bench_verdicts(r.where("name >= 3"), r.where("name < 3"), ["host"], 0.5).select("name", "baseline", "comparable", six("latency_ratio").alias("latency_ratio"), F.col("wins").cast("int").alias("wins"))


@query("SELECT o_orderpriority, round(sqrt(sum(o_totalprice * o_totalprice)), 2) AS norm FROM orders GROUP BY 1")
def l2_norm(spark, d):
    return metrics.l2_norms(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice").withColumn("norm", F.round("norm", 2))


@query("""WITH p AS (SELECT l_returnflag, l_suppkey, avg(l_extendedprice) FILTER (l_linenumber % 2 = 0) AS a, avg(l_extendedprice) FILTER (l_linenumber % 2 = 1) AS b FROM lineitem GROUP BY 1, 2), q AS (SELECT l_returnflag, coalesce(a, 0) AS a, coalesce(b, 0) - coalesce(a, 0) AS d FROM p)
SELECT l_returnflag, round(sqrt(sum(d * d)), 3) AS norm, round(sqrt(sum(d * d)) / nullif(sqrt(sum(a * a)), 0), 6) AS relative FROM q GROUP BY 1""")
def update_norm(spark, d):
    """From the mean prices of even lines to those of odd lines, by supplier."""
    li = table(spark, d, "lineitem")
    mean = lambda k: li.where(F.col("l_linenumber") % 2 == k).groupBy("l_returnflag", "l_suppkey").agg(F.avg("l_extendedprice").alias("v"))
    return metrics.update_norms(mean(0), mean(1), ["l_returnflag"], ["l_suppkey"], "v").select("l_returnflag", F.round("norm", 3).alias("norm"), six("relative").alias("relative"))


@query("SELECT l_suppkey, round(sum(l_extendedprice * l_discount), 4) AS total FROM lineitem GROUP BY 1")
def ordered_fold(spark, d):
    from axonlake.functions.basic import in_order

    li = table(spark, d, "lineitem").withColumn("v", F.col("l_extendedprice") * F.col("l_discount"))
    return li.groupBy("l_suppkey").agg(F.round(in_order("v", ["l_orderkey", "l_linenumber", "l_partkey"]), 4).alias("total"))


@query("WITH q AS (SELECT l_returnflag, l_suppkey % 4 = l_partkey % 4 AS hit FROM lineitem) SELECT l_returnflag, count(*) AS n, round(avg(CASE WHEN hit THEN 1 ELSE 0 END), 6) AS accuracy FROM q GROUP BY 1")
def accuracy_by_group(spark, d):
    out = reports.accuracy(table(spark, d, "lineitem"), ["l_returnflag"], F.col("l_suppkey") % 4 == F.col("l_partkey") % 4)
    return out.select("l_returnflag", "n", six("accuracy").alias("accuracy"))


@query("WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c")
def class_weights(spark, d):
    from axonlake.operators.sampling import class_weights as weights

    return weights(table(spark, d, "events"), "event_type").withColumn("weight", six("weight"))


@query("WITH s AS (SELECT l_returnflag AS task, sum(l_quantity) AS n FROM lineitem GROUP BY 1) SELECT task, round(n / sum(n) OVER (), 6) AS share, abs(n / sum(n) OVER () - 1 / 3) <= 0.1 AS within FROM s")
def task_shares(spark, d):
    from pyspark.sql import Window

    s = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("task")).agg(F.sum("l_quantity").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    return s.select("task", six(share).alias("share"), (F.abs(share - 1 / 3) <= 0.1).alias("within"))


@query("""SELECT user_id, round(avg((value - 20) * (value - 20)), 6) AS mse, CASE WHEN count(*) FILTER (value > 1) > 0 THEN count(*) FILTER (value > 20) / count(*) END AS direction_match FROM events GROUP BY 1""")
def displacement_metrics(spark, d):
    v = F.col("value")
    return table(spark, d, "events").groupBy("user_id").agg(six(F.avg((v - 20) * (v - 20))).alias("mse"), F.when(F.count_if(v > 1) > 0, F.count_if(v > 20) / F.count("*")).alias("direction_match"))


@query("""WITH v AS (SELECT event_type, value - 20 AS px, CAST(event_id % 7 - 3 AS DOUBLE) AS py, CAST(event_id % 5 - 2 AS DOUBLE) AS tx, CAST(event_id % 11 - 5 AS DOUBLE) AS ty FROM events), n AS (SELECT *, px * px + py * py AS a, tx * tx + ty * ty AS b FROM v),
c AS (SELECT *, a > 1e-18 AND b > 1e-18 AS both_, CASE WHEN a > 1e-18 AND b > 1e-18 THEN greatest(-1.0, least(1.0, (px * tx + py * ty) / sqrt(a * b))) END AS c FROM n)
SELECT event_type, round(avg(((px - tx) * (px - tx) + (py - ty) * (py - ty)) / 2), 6) AS mse, round(avg(CASE WHEN both_ THEN acos(c) END), 6) AS mean_angle, round(count(*) FILTER (both_ AND c > 0) / count(*), 6) AS direction_match FROM c GROUP BY 1""")
def displacement_angles(spark, d):
    i = F.col("event_id")
    rows = table(spark, d, "events").select("event_type", (F.col("value") - 20).alias("px"), (i % 7 - 3).cast("double").alias("py"), (i % 5 - 2).cast("double").alias("tx"), (i % 11 - 5).cast("double").alias("ty"))
    out = reports.displacement(rows, ["event_type"])
    return out.select("event_type", six("mse").alias("mse"), six("mean_angle").alias("mean_angle"), six("direction_match").alias("direction_match"))
