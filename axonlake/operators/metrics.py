"""Windowed measures of named sets, thresholds, comparisons with variants, and statistics of repeated runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axonlake.functions.basic import divided, mid_rank, nearest_rank, passes
from axonlake.operators.order import few
from axonlake.operators.selection import linear_quantiles, nearest_ranks


def named_set(nodes: DataFrame, selectors: list[Column], key: str = "id", allow_empty: bool = True) -> DataFrame:
    """The ids that every selector takes (null: no). With allow_empty false an empty set is an error."""
    test = F.lit(True)
    for s in selectors:
        test = test & F.coalesce(s, F.lit(False))
    out = nodes.where(test).select(key).distinct()
    if not allow_empty and out.isEmpty():
        raise ValueError("the set has no members")
    return out


#: Windows up to which a table of them is written into the plan as constants.
WINDOWS = 1_000


def window_measures(trace: DataFrame, sets: DataFrame, windows: DataFrame) -> DataFrame:
    """For each set and window [low, high): members that spiked, spikes, first step, summed output.

    trace (id, step, spike, output), sets (set, id), windows (window, low, high). Windows are few, sets may be large;
    pairs without any row in a window still give a row of zeros with no first step. A row of the trace gets its windows from an expression, so no loop
    over windows joins them; ids are added up by window before they meet their sets.
    """
    declared = windows.select("window", "low", "high").limit(WINDOWS + 1).collect()
    if len(declared) > WINDOWS:
        raise ValueError(f"there are more than {WINDOWS} windows")
    kind = windows.select(F.struct("window", "low", "high").alias("w")).schema["w"].dataType
    every_window = F.array(*(F.struct(*(F.lit(r[c]).alias(c) for c in ("window", "low", "high"))).cast(kind) for r in declared)) if declared else F.array().cast(f"array<{kind.simpleString()}>")
    inside = trace.withColumn("w", F.explode(F.filter(every_window, lambda w: (F.col("step") >= w["low"]) & (F.col("step") < w["high"]))))
    spiked = F.col("spike") > 0
    by_id = inside.groupBy("id", F.col("w.window").alias("window")).agg(F.sum("spike").cast("long").alias("spikes"), F.max(spiked).cast("int").alias("spiked"), F.min(F.when(spiked, F.col("step"))).alias("first_step"), F.sum("output").alias("output"))
    got = by_id.join(sets.distinct(), "id").groupBy("set", "window").agg(F.sum("spiked").alias("spiked"), F.sum("spikes").alias("spikes"), F.min("first_step").alias("first_step"), F.sum("output").alias("output"))
    every = sets.groupBy("set").agg(F.countDistinct("id").alias("members")).withColumn("w", F.explode(every_window)).select("set", "members", "w.*")
    out = every.join(got, ["set", "window"], "left")
    return out.select("set", "window", "low", "high", "members", F.coalesce("spiked", F.lit(0)).alias("spiked"), F.coalesce("spikes", F.lit(0)).alias("spikes"), "first_step", F.coalesce("output", F.lit(0.0)).alias("output"))


def metrics(measured: DataFrame, baseline: str | None = None, step_seconds: float = 1.0) -> DataFrame:
    """Long form (set, window, metric, numerator, denominator, value, defined) of spike_fraction, mean_rate, latency_to_first_spike, mean_output and activity_ratio_vs_baseline."""
    steps = F.col("high") - F.col("low")
    parts = [("spike_fraction", F.col("spiked"), F.col("members")), ("mean_rate", F.col("spikes"), F.col("members") * steps * step_seconds), ("latency_to_first_spike", F.col("first_step") - F.col("low"), F.when(F.col("first_step").isNotNull(), 1)), ("mean_output", F.col("output"), F.col("members") * steps)]
    df = measured
    if baseline is not None:
        base = measured.where(F.col("window") == baseline).select("set", F.col("spikes").alias("base_spikes"), (F.col("high") - F.col("low")).alias("base_steps"))
        df = measured.join(base, "set", "left")
        parts.append(("activity_ratio_vs_baseline", F.col("spikes") / steps, F.col("base_spikes") / F.col("base_steps")))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), a.cast("double").alias("numerator"), b.cast("double").alias("denominator")) for n, a, b in parts)))
    long = df.select("set", "window", each.alias("m")).select("set", "window", "m.*")
    value = divided(F.col("numerator"), F.col("denominator"))
    return long.withColumn("value", value).withColumn("defined", F.col("value").isNotNull())


def judged(measured: DataFrame, op: str, limit: float) -> DataFrame:
    """measured with `passed` and a reason for a fail: undefined or threshold."""
    ok = passes(F.col("value"), op, F.lit(limit))
    return measured.withColumn("passed", ok).withColumn("reason", F.when(ok, "").when(F.col("value").isNull(), "undefined").otherwise("threshold"))


def delta_from(cells: DataFrame, original: Column, by: list[str]) -> DataFrame:
    """cells with `delta`: value less the original cell's, where both are defined."""
    base = cells.where(original).select(*by, F.col("value").alias("base_value"))
    return cells.join(base, by, "left").withColumn("delta", F.col("value") - F.col("base_value"))


def variant_summary(cells: DataFrame, original: Column, kind: str, by: list[str]) -> DataFrame:
    """For each metric and kind of variant: seeds, defined values, nearest-rank quantiles and the mid-rank percentile of the original."""
    base = cells.where(original).select(*by, F.col("value").alias("reference"))
    rest = cells.where(~original).join(base, by, "left")
    return rest.groupBy(*by, kind).agg(F.count("*").alias("seeds"), F.count("value").alias("n_defined"), *(nearest_rank("value", q).alias(f"p{round(q * 100)}") for q in (0, 0.25, 0.5, 0.75, 1)), mid_rank(F.col("value"), F.col("reference")).alias("percentile"))


def stability(trace: DataFrame, nodes: DataFrame, silent_limit: float = 0.9) -> DataFrame:
    """One row: nodes, silent nodes and their share, mean population rate a step, and whether the share passes its limit."""
    spikes = trace.groupBy("id").agg(F.sum("spike").alias("spikes"), F.countDistinct("step").alias("steps"))
    per = nodes.select("id").distinct().join(spikes, "id", "left")
    out = per.agg(F.count("*").alias("nodes"), F.count_if(F.coalesce(F.col("spikes"), F.lit(0)) == 0).alias("silent"), F.avg(F.col("spikes") / F.col("steps")).alias("mean_rate"))
    return out.withColumn("silent_fraction", divided(F.col("silent"), F.col("nodes"))).withColumn("mostly_silent", F.coalesce(F.col("silent_fraction") > silent_limit, F.lit(False)))


def probe_series(trace: DataFrame, members: DataFrame) -> DataFrame:
    """(probe, step, sum_output, mean_output, spike_count, spike_fraction) of the members (probe, id) of each probe, over all of them: one without a row adds nothing.

    A sum that isn't finite is an error. A hot step or probe is combined before the shuffle.
    """
    probes = members.select("probe", "id").distinct()
    sizes = probes.groupBy("probe").agg(F.count("*").alias("__n"))
    by_id = trace.groupBy("id", "step").agg(F.sum("output").alias("output"), F.max((F.col("spike") > 0).cast("int")).alias("spiked"))
    per = by_id.join(probes, "id").groupBy("probe", "step").agg(F.coalesce(F.sum("output"), F.lit(0.0)).alias("sum_output"), F.coalesce(F.sum("spiked"), F.lit(0)).alias("spike_count"))
    total = F.when(F.isnan("sum_output") | (F.abs("sum_output") == float("inf")), F.raise_error(F.lit("a probe's sum is not finite")).cast("double")).otherwise(F.col("sum_output"))
    return per.join(sizes, "probe").select("probe", "step", total.alias("sum_output"), (total / F.col("__n")).alias("mean_output"), "spike_count", divided(F.col("spike_count"), F.col("__n")).alias("spike_fraction"))


def l2_norms(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """by and `norm`, the root of the sum of squares; nulls count as nothing."""
    x = F.col(column).cast("double")
    return df.groupBy(*by).agg(F.sqrt(F.coalesce(F.sum(x * x), F.lit(0.0))).alias("norm"))


def update_norms(before: DataFrame, after: DataFrame, by: list[str], key: list[str], column: str) -> DataFrame:
    """by, `norm` of what changed from before to after, and its share of the norm before; a parameter that one side lacks counts as 0 there."""
    both = before.select(*by, *key, F.col(column).cast("double").alias("__a")).join(after.select(*by, *key, F.col(column).cast("double").alias("__b")), [*by, *key], "full")
    a, d = F.coalesce("__a", F.lit(0.0)), F.coalesce("__b", F.lit(0.0)) - F.coalesce("__a", F.lit(0.0))
    out = both.groupBy(*by).agg(F.sqrt(F.sum(d * d)).alias("norm"), F.sqrt(F.sum(a * a)).alias("__old"))
    return out.select(*by, "norm", divided(F.col("norm"), F.col("__old")).alias("relative"))


def population_rates(trace: DataFrame, nodes: DataFrame) -> DataFrame:
    """(step, spiking, rate): nodes that spike in each step, and their share of all nodes."""
    n = nodes.agg(F.count_distinct("id").alias("__n"))
    per = trace.join(nodes.select("id").distinct(), "id").groupBy("step").agg(F.count_distinct(F.when(F.col("spike") > 0, F.col("id"))).alias("spiking"))
    return per.crossJoin(F.broadcast(n)).select("step", "spiking", divided(F.col("spiking"), F.col("__n")).alias("rate"))  # one row


def rate_quantiles(trace: DataFrame, nodes: DataFrame, steps: int) -> DataFrame:
    """One row: interpolated quantiles p0, p25, p50, p75 and p100 of the nodes' spikes a step; a node without a row has rate 0."""
    spikes = trace.groupBy("id").agg(F.sum("spike").alias("s"))
    rates = nodes.select("id").distinct().join(spikes, "id", "left").select((F.coalesce("s", F.lit(0)) / F.lit(float(steps))).alias("rate"))
    return linear_quantiles(rates, [], "rate", {f"p{round(100 * q)}": q for q in (0, 0.25, 0.5, 0.75, 1)})


def stability_flags(rates: DataFrame, silent_fraction: float, most_rate: float = 0.0, least_active: float = 0.0) -> list[str]:
    """Which bounds are broken: a step's rate above most_rate, the active share below least_active; a bound of 0 is none."""
    over = most_rate > 0 and not rates.where(F.col("rate") > most_rate).isEmpty()
    under = least_active > 0 and 1 - silent_fraction < least_active
    return ["max_population_rate_exceeded"] * over + ["min_active_fraction_below"] * under


def cell_stats(cells: DataFrame, by: list[str], value: str = "score", failed: str = "failed") -> DataFrame:
    """Mean, population deviation, least and greatest of the runs that succeeded; zeros if none did."""
    v = F.when(~F.col(failed), F.col(value))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return cells.groupBy(*by).agg(F.count_if(~F.col(failed)).alias("succeeded"), F.count_if(F.col(failed)).alias("failed_runs"), zero(F.avg(v)).alias("mean"), zero(F.stddev_pop(v)).alias("std"), zero(F.min(v)).alias("min"), zero(F.max(v)).alias("max"))


def forgetting(scores: DataFrame, by: list[str], stage: str = "stage", value: str = "score") -> DataFrame:
    """scores with `forgetting`: the best score of the earlier stages less the present one; null at the first stage."""
    before = Window.partitionBy(*by).orderBy(stage).rowsBetween(Window.unboundedPreceding, -1)
    return scores.withColumn("forgetting", F.max(value).over(before) - F.col(value))


def paired(a: DataFrame, b: DataFrame, by: list[str], value: str = "score", failed: str = "failed") -> DataFrame:
    """Differences of runs with the same seed; pairs in which either failed are dropped and counted: (by.., difference) plus `n_dropped` on each row."""
    both = a.select(*by, F.col(value).alias("a"), F.col(failed).alias("fa")).join(b.select(*by, F.col(value).alias("b"), F.col(failed).alias("fb")), by)
    dropped = both.agg(F.count_if(F.col("fa") | F.col("fb")).alias("n_dropped"))
    return both.where(~F.col("fa") & ~F.col("fb")).select(*by, (F.col("a") - F.col("b")).alias("difference")).crossJoin(F.broadcast(dropped))  # one row


def bootstrap(differences: DataFrame, resamples: int = 200, seed: int = 0, level: float = 0.95, value: str = "difference") -> DataFrame:
    """Nearest-rank bounds of the mean over resamples drawn with replacement: one row (mean, low, high).

    Draws come from a hash of (seed, resample, draw), so reruns agree. Values are numbered, each resample
    draws as many numbers, and an equi-join fetches them: resamples * n rows, combined before the shuffle of means.
    """
    from axonlake.operators.order import dense_index

    rows = dense_index(differences.select(F.col(value).cast("double").alias("v")), ["v"], "at")
    n = rows.count()
    if not n:
        return differences.sparkSession.createDataFrame([], "mean double, low double, high double")
    draws = differences.sparkSession.range(resamples * n).select(F.expr(f"id div {n}").alias("resample"), F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(n)).alias("at"))
    means = draws.join(rows, "at").groupBy("resample").agg(F.avg("v").alias("m"))
    tail = (1 - level) / 2
    return means.agg(nearest_rank("m", tail).alias("low"), nearest_rank("m", 1 - tail).alias("high")).crossJoin(rows.agg(F.avg("v").alias("mean"))).select("mean", "low", "high")


def latency_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, nearest-rank p50, p90, p99, least and greatest."""
    plain = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    return plain.join(nearest_ranks(df, by, value, {"p50": 0.5, "p90": 0.9, "p99": 0.99}), by)


def bench_verdicts(candidate: DataFrame, baselines: DataFrame, settings: list[str], tolerance: float = 0.0) -> DataFrame:
    """candidate joined to baselines of the same settings: latency ratio, quality delta, within, faster, wins. Differing settings are refused: they give comparable = false and no verdict."""
    b = baselines.select(F.col("name").alias("baseline"), *(F.col(s).alias(f"b_{s}") for s in settings), F.col("latency").alias("b_latency"), F.col("quality").alias("b_quality"))
    both = candidate.crossJoin(few(b))  # every candidate meets every baseline
    same = F.lit(True)
    for s in settings:
        same = same & F.col(s).eqNullSafe(F.col(f"b_{s}"))
    rate, delta = divided(F.col("latency"), F.col("b_latency")), F.col("quality") - F.col("b_quality")
    within, faster = delta >= -tolerance, rate < 1
    return both.select("name", "baseline", same.alias("comparable"), F.when(same, rate).alias("latency_ratio"), F.when(same, delta).alias("quality_delta"), F.when(same, within).alias("within"), F.when(same, faster).alias("faster"), F.when(same, within & faster).alias("wins"))
