"""Alignment of irregular samples to steps: as-of, interpolating, interval and pulse semantics, and checks of their order.

Samples have (series columns, tick, sequence, value); grids have (series columns, step, tick). Ticks are integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axonlake.functions.basic import ceil_steps
from axonlake.operators.order import dense_index
from axonlake.operators.scan import RANGE, own, segmented


def latest(samples: DataFrame, by: list[str]) -> DataFrame:
    """Of simultaneous samples the one with the greatest sequence."""
    rest = [c for c in samples.columns if c not in (*by, "tick")]
    return samples.groupBy(*by, "tick").agg(F.max_by(F.struct(*rest), "sequence").alias("x")).select(*by, "tick", "x.*")


def _merged(samples: DataFrame, grid: DataFrame, by: list[str]):
    s = latest(samples, by).select(*by, "tick", F.lit(0).alias("__grid"), F.lit(None).cast("long").alias("step"), F.struct("tick", "value").alias("__s"))
    g = grid.select(*by, "tick", F.lit(1).alias("__grid"), "step", F.lit(None).cast(s.schema["__s"].dataType).alias("__s"))
    return s.unionByName(g)


def _counted(samples: DataFrame, grid: DataFrame, by: list[str]) -> DataFrame:
    return samples.select(*by).unionByName(grid.select(*by))


def asof_hold(samples: DataFrame, grid: DataFrame, by: list[str]) -> DataFrame:
    """Each grid row with the value of the latest sample at or before its tick; rows before the first sample have null.

    The union is sorted in ranges of (series, tick) and the last sample carried on, from one range to the next too, so no pair of rows
    is built and a series with most of the rows is many tasks.
    """
    rows = segmented(_merged(samples, grid, by), by, ["tick", "__grid"], before=1, keep=F.col("__grid") == 0, counted=_counted(samples, grid, by))
    w = Window.partitionBy(RANGE, *by).orderBy("tick", "__grid").rowsBetween(Window.unboundedPreceding, 0)
    out = own(rows.withColumn("__s", F.last("__s", ignorenulls=True).over(w)))
    return out.where("__grid = 1").select(*by, "step", "tick", F.col("__s.tick").alias("sample_tick"), F.col("__s.value").alias("value"))


def asof_linear(samples: DataFrame, grid: DataFrame, by: list[str]) -> DataFrame:
    """Each grid row between two samples with the value on the line between them, kept within their range; at or after the last sample it holds, before the first it is null."""
    rows = segmented(_merged(samples, grid, by), by, ["tick", "__grid"], before=1, after=1, keep=F.col("__grid") == 0, counted=_counted(samples, grid, by))
    back = Window.partitionBy(RANGE, *by).orderBy("tick", "__grid").rowsBetween(Window.unboundedPreceding, 0)
    # looks back from the end: a frame that grows is carried on row by row, one that shrinks would be read anew for each row
    ahead = Window.partitionBy(RANGE, *by).orderBy(F.desc("tick"), F.desc("__grid")).rowsBetween(Window.unboundedPreceding, -1)
    out = own(rows.withColumns({"__l": F.last("__s", ignorenulls=True).over(back), "__r": F.last("__s", ignorenulls=True).over(ahead)})).where("__grid = 1")
    left, right = F.col("__l.value").cast("double"), F.col("__r.value").cast("double")
    part = (F.col("tick") - F.col("__l.tick")).cast("double") / (F.col("__r.tick") - F.col("__l.tick")).cast("double")
    line = F.least(F.greatest(left + (right - left) * part, F.least(left, right)), F.greatest(left, right))
    return out.select(*by, "step", "tick", F.when(F.col("__l").isNull(), None).when(F.col("__r").isNull() | (F.col("tick") == F.col("__l.tick")), left).otherwise(line).alias("value"))


def interval_resample(intervals: DataFrame, grid: DataFrame, by: list[str], cell: int) -> DataFrame:
    """Each grid row inside an interval [tick, tick + duration) with the value of the one that began last, then has the greatest sequence; rows in no interval are left out.

    Both sides meet by series and by cells of `cell` ticks, so a range join becomes an equi-join; an interval is copied to the cells that it spans.
    """
    first, last = F.floor(F.col("tick") / cell), F.floor((F.col("tick") + F.col("duration") - 1) / cell)
    spread = intervals.where("duration > 0").select(*by, F.col("tick").alias("start"), "duration", "sequence", "value", F.explode(F.sequence(first, last)).alias("__cell"))
    at = grid.select(*by, "step", F.col("tick").alias("at"), F.floor(F.col("tick") / cell).alias("__cell"))
    met = at.join(spread, [*by, "__cell"]).where((F.col("start") <= F.col("at")) & (F.col("at") < F.col("start") + F.col("duration")))
    best = F.max_by(F.struct("start", "value"), F.struct("start", "sequence"))
    return met.groupBy(*by, "step", "at").agg(best.alias("x")).select(*by, "step", F.col("at").alias("tick"), F.col("x.start").alias("start"), F.col("x.value").alias("value"))


def pulse_align(events: DataFrame, source_ticks: int, steps: int) -> DataFrame:
    """Every event with the first step at or after it: ceil(tick * steps / source_ticks)."""
    return events.withColumn("step", ceil_steps(F.col("tick"), source_ticks, steps))


def available(feedback: DataFrame, now: int, unit: str) -> DataFrame:
    """Feedback that has arrived by now; a row of another unit is an error."""
    ok = F.when(F.col("unit") == unit, F.col("available_at") <= now).otherwise(F.raise_error(F.lit("feedback of another time unit")).cast("boolean"))
    return feedback.where(ok)


def correlated(actions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Feedback with a verdict: ok, no_action, before_action, other_experience, repeated (a second one of an action and source)."""
    a = actions.select("action_id", F.col("experience").alias("own"), F.col("step").alias("acted_at"))
    # the first of each action and source: a minimum, combined before the shuffle; feedback without an action takes no part
    firsts = feedback.join(a, "action_id", "left_semi").groupBy("action_id", "source").agg(F.min(F.struct("produced_at", "feedback_id")).alias("__first"))
    repeated = F.struct("produced_at", "feedback_id") > F.col("__first")
    verdict = F.when(F.col("acted_at").isNull(), "no_action").when(F.col("own") != F.col("experience"), "other_experience").when(F.col("produced_at") < F.col("acted_at"), "before_action").when(repeated, "repeated").otherwise("ok")
    return feedback.join(a, "action_id", "left").join(firsts, ["action_id", "source"], "left").withColumn("verdict", verdict).drop("own", "acted_at", "__first")


def chronology(samples: DataFrame, by: list[str]) -> DataFrame:
    """samples (in the order of `ordinal`) with `problem`: time_regress, repeated_sequence, sequence_regress or null."""
    w = Window.partitionBy(RANGE, *by).orderBy("ordinal")
    rows = own(segmented(samples, by, ["ordinal"], before=1).withColumns({"__tick": F.lag("tick").over(w), "__sequence": F.lag("sequence").over(w)}))
    key = F.struct(*by, "sequence")
    times = samples.groupBy(key.alias("__key")).agg(F.count("*").alias("__times"))
    met = rows.join(times, key.eqNullSafe(F.col("__key")))
    problem = F.when(F.col("tick") < F.col("__tick"), "time_regress").when(F.col("__times") > 1, "repeated_sequence").when(F.col("sequence") < F.col("__sequence"), "sequence_regress")
    return met.select(*samples.columns, problem.alias("problem"))


def running_baseline(rewards: DataFrame, by: list[str], order: list[str], window: int, value: str = "reward") -> DataFrame:
    """rewards with `expected`, the mean of at most `window` rewards before (0 if none), and `surprise`."""
    w = Window.partitionBy(RANGE, *by).orderBy(*order).rowsBetween(-window, -1)
    out = own(segmented(rewards, by, order, before=window).withColumn("expected", F.coalesce(F.avg(value).over(w), F.lit(0.0))))
    return out.withColumn("surprise", F.col(value) - F.col("expected"))


def reward_map(surprise: Column, split: bool = False) -> Column:
    """Positive part; with split, struct(positive, negative)."""
    up = F.greatest(surprise, F.lit(0.0))
    return F.struct(up.alias("positive"), F.greatest(-surprise, F.lit(0.0)).alias("negative")) if split else up


def causal_samples(points: DataFrame, order: str = "ordinal", trial: str = "trial", max_gap: float = 0.5, max_step: float = 5.0) -> DataFrame:
    """Each point with the ones before and after, and `reason`: boundary > relocation > gap > jump > kept.

    points (ordinal, trial, segment, t, x, y). Neighbours are those of the trial in source order; a change of segment is a relocation.
    """
    w = Window.partitionBy(RANGE, trial).orderBy(order)
    points = segmented(points, [trial], [order], before=1, after=1)
    p, n = (lambda c: F.lag(c).over(w)), (lambda c: F.lead(c).over(w))
    out = points.withColumns({"dx": F.col("x") - p("x"), "dy": F.col("y") - p("y"), "dt": F.col("t") - p("t"), "next_dx": n("x") - F.col("x"), "next_dy": n("y") - F.col("y"), "next_dt": n("t") - F.col("t"), "__moved": (F.col("segment") != p("segment")) | (F.col("segment") != n("segment"))})
    reason = (
        F.when(F.col("dt").isNull() | F.col("next_dt").isNull(), "boundary")
        .when(F.col("__moved"), "relocation")
        .when((F.col("dt") > max_gap) | (F.col("next_dt") > max_gap), "gap")
        .when((F.hypot("dx", "dy") > max_step) | (F.hypot("next_dx", "next_dy") > max_step), "jump")
        .otherwise("kept")
    )
    return own(out.withColumn("reason", reason)).drop("__moved")


def runs(df: DataFrame, by: list[str], order: str, test: Column) -> DataFrame:
    """Maximal runs of consecutive positions that pass: (by.., first, last, n). A repeated position counts once."""
    at = F.col(order)
    w = Window.partitionBy(RANGE, *by).orderBy(order)
    inside = segmented(df.where(test).select(*by, order).distinct(), by, [order], before=1, after=1)
    starts, ends = ~F.coalesce(F.lag(order).over(w) == at - 1, F.lit(False)), ~F.coalesce(F.lead(order).over(w) == at + 1, F.lit(False))
    borders = segmented(own(inside.withColumns({"__starts": starts, "__ends": ends})).where("__starts or __ends"), by, [order], after=1)
    last = F.when(F.col("__ends"), at).otherwise(F.lead(order).over(w))
    out = own(borders.withColumn("last", last)).where("__starts")
    return out.select(*by, at.alias("first"), "last", (F.col("last") - at + 1).cast("long").alias("n"))


def trial_problems(points: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """points (trial, t, x, y) in the order of `ordinal` with `problem`: no_trial, not_finite, negative_time, not_contiguous (a trial begins again), time_repeats, time_regresses or null.

    All points are one series, looked at in ranges: where a trial begins is seen from the row before, and whether it has begun before from the first of
    its beginnings.
    """
    line = points.withColumn("__all", F.lit(0))
    w = Window.partitionBy(RANGE, "__all").orderBy(ordinal)
    rows = own(segmented(line, ["__all"], [ordinal], before=1).withColumns({"__trial": F.lag(F.struct("trial")).over(w), "__t": F.lag("t").over(w)}))
    begins = F.col("__trial").isNull() | ~F.col("__trial.trial").eqNullSafe(F.col("trial"))
    rows = rows.withColumn("__begins", begins)
    firsts = rows.where("__begins").groupBy(F.struct("trial").alias("__key")).agg(F.min(ordinal).alias("__first"))
    rows = rows.join(firsts, F.struct("trial").eqNullSafe(F.col("__key")))
    finite = F.lit(True)
    for c in ("t", "x", "y"):
        finite = finite & F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    problem = (
        F.when(F.coalesce(F.col("trial").cast("string"), F.lit("")) == "", "no_trial")
        .when(~finite, "not_finite")
        .when(F.col("t") < 0, "negative_time")
        .when(F.col("__begins"), F.when(F.col(ordinal) > F.col("__first"), "not_contiguous"))
        .when(F.col("t") == F.col("__t"), "time_repeats")
        .when((F.col("t") < F.col("__t")) & ~F.isnan("__t"), "time_regresses")
    )
    return rows.select(*points.columns, problem.alias("problem"))


def ordered_signals(signals: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """signals (experience, stream, channel, sequence, tick) with `position`, from 0, by tick, sequence, stream and channel, and `problem`: time_back (the tick falls in the order of `ordinal`), repeated (the sequence has been in its stream) or null."""
    line = signals.withColumn("__all", F.lit(0))
    before = F.lag("tick").over(Window.partitionBy(RANGE, "__all").orderBy(ordinal))
    rows = own(segmented(line, ["__all"], [ordinal], before=1).withColumn("__tick", before)).drop("__all")
    key = F.struct("experience", "stream", "sequence")
    firsts = signals.groupBy(key.alias("__key")).agg(F.min(ordinal).alias("__first"))
    problem = F.when(F.col("tick") < F.col("__tick"), "time_back").when(F.col(ordinal) > F.col("__first"), "repeated")
    judged = rows.join(firsts, key.eqNullSafe(F.col("__key"))).select(*signals.columns, problem.alias("problem"))
    return dense_index(judged, ["tick", "sequence", "stream", "channel", ordinal], "position")
