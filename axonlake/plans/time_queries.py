"""Alignment of event streams to hourly grids, intervals, pulses, feedback and windows of samples. Ticks are microseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonlake.functions import arrays, basic
from axonlake.operators import temporal
from axonlake.plans.registry import micros, query, six, table

DAY, START = 86_400_000_000, 1_704_067_200_000_000
E = "e AS (SELECT user_id, epoch_us(ts) AS tick, event_id AS sequence, value, event_type FROM events)"
G = f"g AS (SELECT user_id, k AS step, CAST({START} + k * {DAY} AS BIGINT) AS tick FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(range(0, 31)) AS k))"


def samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", micros("ts").alias("tick"), F.col("event_id").alias("sequence"), "value", "event_type")


def grid(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "events").select("user_id").distinct()
    return users.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(30).cast("long")))).withColumn("tick", F.lit(START) + F.col("step") * DAY)


@query(f"WITH {E}, {G} SELECT g.user_id, step, g.tick, value FROM g ASOF LEFT JOIN e ON g.user_id = e.user_id AND g.tick >= e.tick")
def asof_hold(spark, d):
    return temporal.asof_hold(samples(spark, d).drop("event_type"), grid(spark, d), ["user_id"]).select("user_id", "step", "tick", "value")


@query(f"""WITH {E}, {G}, l AS (SELECT g.user_id, step, g.tick, e.tick AS lt, value AS lv FROM g ASOF LEFT JOIN e ON g.user_id = e.user_id AND g.tick >= e.tick),
r AS (SELECT l.*, e.tick AS rt, e.value AS rv FROM l ASOF LEFT JOIN e ON l.user_id = e.user_id AND l.tick < e.tick)
SELECT user_id, step, tick, round(CASE WHEN lt IS NULL THEN NULL WHEN rt IS NULL OR tick = lt THEN lv ELSE least(greatest(lv + (rv - lv) * (CAST(tick - lt AS DOUBLE) / CAST(rt - lt AS DOUBLE)), least(lv, rv)), greatest(lv, rv)) END, 6) AS value FROM r""")
def asof_linear(spark, d):
    return temporal.asof_linear(samples(spark, d).drop("event_type"), grid(spark, d), ["user_id"]).withColumn("value", six("value"))


@query(f"""WITH {E}, {G}, m AS (SELECT g.user_id, step, g.tick, e.tick AS start, value, row_number() OVER (PARTITION BY g.user_id, step ORDER BY e.tick DESC, sequence DESC) AS k FROM g JOIN e ON g.user_id = e.user_id AND e.tick <= g.tick AND g.tick < e.tick + (sequence % 5) * 14400000000) SELECT user_id, step, tick, start, value FROM m WHERE k = 1""")
def interval_resample(spark, d):
    intervals = samples(spark, d).withColumn("duration", (F.col("sequence") % 5) * 14_400_000_000)
    return temporal.interval_resample(intervals, grid(spark, d), ["user_id"], 21_600_000_000)


@query(f"WITH {E} SELECT sequence, CAST((tick - {START} + 3599999999) // 3600000000 AS BIGINT) AS step FROM e")
def pulse_align(spark, d):
    s = samples(spark, d).withColumn("tick", F.col("tick") - START)
    return temporal.pulse_align(s, 3_600_000_000, 1).select("sequence", "step")


@query(f"WITH {E} SELECT sequence FROM e WHERE tick + (sequence % 10) * {DAY} <= {START} + 15 * {DAY}")
def available_feedback(spark, d):
    f = samples(spark, d).select("sequence", (F.col("tick") + (F.col("sequence") % 10) * DAY).alias("available_at"), F.lit("us").alias("unit"))
    return temporal.available(f, START + 15 * DAY, "us").select("sequence")


@query(f"""WITH {E}, a AS (SELECT sequence AS action_id, user_id AS own, tick AS acted FROM e WHERE sequence % 2 = 0),
f AS (SELECT sequence AS feedback_id, sequence // 3 AS action_id, user_id, tick AS produced FROM e WHERE sequence % 3 <> 2),
j AS (SELECT f.*, own, acted, row_number() OVER (PARTITION BY f.action_id ORDER BY produced, feedback_id) AS k FROM f LEFT JOIN a USING (action_id))
SELECT CASE WHEN acted IS NULL THEN 'no_action' WHEN own <> user_id THEN 'other_experience' WHEN produced < acted THEN 'before_action' WHEN k > 1 THEN 'repeated' ELSE 'ok' END AS verdict, count(*) AS n FROM j GROUP BY 1""")
def feedback_correlation(spark, d):
    s = samples(spark, d)
    actions = s.where("sequence % 2 = 0").select(F.col("sequence").alias("action_id"), F.col("user_id").alias("experience"), F.col("tick").alias("step"))
    feedback = s.where("sequence % 3 <> 2").select(F.col("sequence").alias("feedback_id"), F.expr("sequence div 3").alias("action_id"), F.col("user_id").alias("experience"), F.col("tick").alias("produced_at"), F.lit("env").alias("source"))
    return temporal.correlated(actions, feedback).groupBy("verdict").agg(F.count("*").alias("n"))


@query(f"""WITH {E}, c AS (SELECT *, lag(tick) OVER w AS pt, lag(sequence % 1000) OVER w AS ps, count(*) OVER (PARTITION BY user_id, sequence % 1000) AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY tick)) SELECT coalesce(CASE WHEN tick < pt THEN 'time_regress' WHEN n > 1 THEN 'repeated_sequence' WHEN sequence % 1000 < ps THEN 'sequence_regress' END, 'none') AS problem, count(*) AS n FROM c GROUP BY 1""")
def chronology_check(spark, d):
    s = samples(spark, d).withColumn("ordinal", F.col("tick")).withColumn("sequence", F.col("sequence") % 1000)
    return temporal.chronology(s, ["user_id"]).groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count("*").alias("n"))


@query(f"WITH {E} SELECT sequence, round(coalesce(avg(value) OVER (PARTITION BY user_id ORDER BY tick ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0), 6) AS expected, round(greatest(value - coalesce(avg(value) OVER (PARTITION BY user_id ORDER BY tick ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0), 0), 6) AS applied FROM e")
def reward_baseline(spark, d):
    out = temporal.running_baseline(samples(spark, d), ["user_id"], ["tick"], 5, "value")
    return out.select("sequence", six("expected").alias("expected"), six(temporal.reward_map(F.col("surprise"))).alias("applied"))


@query(f"""WITH {E}, p AS (SELECT *, (tick - {START}) / 1e9 AS t, event_type AS segment FROM e), n AS (SELECT *, lag(t) OVER w AS pt, lead(t) OVER w AS nt, lag(value) OVER w AS pv, lead(value) OVER w AS nv, lag(segment) OVER w AS ps, lead(segment) OVER w AS ns FROM p WINDOW w AS (PARTITION BY user_id ORDER BY tick))
SELECT CASE WHEN pt IS NULL OR nt IS NULL THEN 'boundary' WHEN segment <> ps OR segment <> ns THEN 'relocation' WHEN t - pt > 40 OR nt - t > 40 THEN 'gap' WHEN abs(value - pv) > 30 OR abs(nv - value) > 30 THEN 'jump' ELSE 'kept' END AS reason, count(*) AS n FROM n GROUP BY 1""")
def causal_samples(spark, d):
    p = samples(spark, d).select(F.col("user_id").alias("trial"), F.col("tick").alias("ordinal"), F.col("event_type").alias("segment"), ((F.col("tick") - START) / 1e9).alias("t"), F.col("value").alias("x"), F.lit(0.0).alias("y"))
    return temporal.causal_samples(p, max_gap=40.0, max_step=30.0).groupBy("reason").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT user_id, CAST(floor((epoch_us(ts) - 1704067200000000) / 86400000000) AS BIGINT) AS day, count(*) AS n FROM events GROUP BY 1, 2), i AS (SELECT user_id, day, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS island FROM d WHERE n > 3) SELECT user_id, min(day) AS first, max(day) AS last, count(*) AS n FROM i GROUP BY user_id, island""")
def run_detection(spark, d):
    days = samples(spark, d).groupBy("user_id", F.floor((F.col("tick") - START) / DAY).cast("long").alias("day")).agg(F.count("*").alias("c"))
    return temporal.runs(days, ["user_id"], "day", F.col("c") > 3)


@query("SELECT o_orderkey, round(CASE WHEN o_orderkey % 1000 < 100 THEN 0.1 * (o_orderkey % 1000 + 1) / 100 ELSE 0.05 * (1 + cos(3.141592653589793 * least(1.0, (o_orderkey % 1000 - 100) / 900))) END, 6) AS rate FROM orders")
def learning_rate(spark, d):
    return table(spark, d, "orders").select("o_orderkey", six(basic.learning_rate(F.col("o_orderkey") % 1000, 0.1, "cosine", 100, 1000)).alias("rate"))


@query(None)
def gae_advantages(spark, d):
    """Advantages of each user's rollout of daily values; tests hold it against a loop."""
    days = samples(spark, d).groupBy("user_id", F.floor((F.col("tick") - START) / DAY).alias("day")).agg(F.avg("value").alias("r"), F.max(F.col("event_type") == "purchase").alias("done"))
    roll = days.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("day", "r", "done"))).alias("x"))  # at most a row a day
    return roll.select("user_id", arrays.gae(F.col("x.r"), F.transform("x.r", lambda v: v / 2), F.col("x.done"), F.lit(0.0), 0.99, 0.95).alias("advantages"))


@query(f"WITH {E}, h AS (SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY 1, 2) SELECT user_id, max(n) AS most, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1")
def event_counts(spark, d):
    h = samples(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return h.groupBy("user_id").agg(F.max("n").alias("most"), F.sum("n").alias("n"))


@query(f"""WITH {E}, p AS (SELECT sequence AS o, CASE WHEN sequence % 397 = 0 THEN '' ELSE CAST((sequence // 50) % 37 AS VARCHAR) END AS trial, CASE WHEN sequence % 211 = 5 THEN -1.0 ELSE CAST((sequence % 50) - (CASE WHEN sequence % 101 = 7 THEN 1 WHEN sequence % 103 = 9 THEN 3 ELSE 0 END) AS DOUBLE) + 10 END AS t FROM e),
b AS (SELECT *, lag(trial) OVER (ORDER BY o) AS pt, lag(t) OVER (ORDER BY o) AS pp FROM p), s AS (SELECT *, pt IS NULL OR pt <> trial AS begins FROM b), f AS (SELECT *, min(CASE WHEN begins THEN o END) OVER (PARTITION BY trial) AS first FROM s)
SELECT o AS ordinal, CASE WHEN trial = '' THEN 'no_trial' WHEN t < 0 THEN 'negative_time' WHEN begins THEN CASE WHEN o > first THEN 'not_contiguous' END WHEN t = pp THEN 'time_repeats' WHEN t < pp THEN 'time_regresses' END AS problem FROM f""")
def trial_problems(spark, d):
    """Events as points of trials of fifty, whose names come again."""
    i = F.col("sequence")
    t = F.when(i % 211 == 5, -1.0).otherwise((i % 50 - F.when(i % 101 == 7, 1).when(i % 103 == 9, 3).otherwise(0)).cast("double") + 10)
    points = samples(spark, d).select(i.alias("ordinal"), F.when(i % 397 == 0, "").otherwise(F.expr("(sequence div 50) % 37").cast("string")).alias("trial"), t.alias("t"), F.col("value").alias("x"), F.lit(0.0).alias("y"))
    return temporal.trial_problems(points).select("ordinal", "problem")


@query(f"""WITH {E}, p AS (SELECT sequence AS ordinal, user_id % 4 AS experience, event_type AS stream, sequence % 700 AS seq, CAST(sequence // 3 - CASE WHEN sequence % 89 = 0 THEN 2 ELSE 0 END AS BIGINT) AS tick FROM e)
SELECT ordinal, row_number() OVER (ORDER BY tick, seq, stream, ordinal) - 1 AS position, CASE WHEN tick < lag(tick) OVER (ORDER BY ordinal) THEN 'time_back' WHEN ordinal > min(ordinal) OVER (PARTITION BY experience, stream, seq) THEN 'repeated' END AS problem FROM p""")
def ordered_signals(spark, d):
    i = F.col("sequence")
    rows = samples(spark, d).select(i.alias("ordinal"), (F.col("user_id") % 4).alias("experience"), F.col("event_type").alias("stream"), F.lit("c").alias("channel"), (i % 700).alias("sequence"), (F.expr("sequence div 3") - F.when(i % 89 == 0, 2).otherwise(0)).alias("tick"))
    return temporal.ordered_signals(rows).select("ordinal", "position", "problem")
