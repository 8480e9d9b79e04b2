"""Selections, counters and report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axonlake.functions.basic import divided
from axonlake.operators.scan import RANGE, own, segmented


def by_metadata(nodes: DataFrame, column: str, values: list[str], key: str = "id") -> DataFrame:
    """Ids whose metadata is one of the values, ascending; empty metadata never matches."""
    return nodes.where(F.coalesce((F.trim(column) != "") & F.col(column).isin(*values), F.lit(False))).select(key).distinct().orderBy(key)


def by_ids(nodes: DataFrame, ids: list[int], key: str = "id") -> DataFrame:
    """(key, position) of explicit ids in their order; an unknown or repeated id is an error."""
    if len(set(ids)) != len(ids):
        raise ValueError("an id is repeated")
    wanted = nodes.sparkSession.createDataFrame(list(zip(ids, range(len(ids)), strict=True)), f"{key} long, position int")
    known = nodes.select(F.col(key).alias("__k"))
    both = wanted.join(known, F.col(key) == F.col("__k"), "left")
    return both.where(F.when(F.col("__k").isNull(), F.raise_error(F.lit("unknown id")).cast("boolean")).otherwise(True)).drop("__k")


def located(rows: DataFrame, batches: DataFrame) -> DataFrame:
    """rows (abs_row) with batch, that of the last start at or before the row, and row, the place in it: batches (batch, start), of any number.

    Starts and rows are one line, on which the last start is carried on, over ranges if it is long. A row before the first start, or without a number, has nulls.
    """
    start = F.struct("batch", "start")
    kind = batches.select(start.alias("s")).schema["s"].dataType
    at = rows.select(F.lit(0).alias("__all"), F.col("abs_row").alias("__at"), F.lit(1).alias("__row"), F.lit(None).cast(kind).alias("__start"), F.struct(*rows.columns).alias("__own"))
    own_kind = at.schema["__own"].dataType
    line = at.where("__at is not null").unionByName(batches.select(F.lit(0).alias("__all"), F.col("start").alias("__at"), F.lit(0).alias("__row"), start.alias("__start"), F.lit(None).cast(own_kind).alias("__own")))
    order = ["__at", "__row"]
    w = Window.partitionBy(RANGE, "__all").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = own(segmented(line, ["__all"], order, before=1, keep=F.col("__row") == 0).withColumn("__start", F.last("__start", ignorenulls=True).over(w))).where("__row = 1")
    out = met.unionByName(at.where("__at is null"))
    return out.select("__own.*", F.col("__start.batch").alias("batch"), (F.col("__at") - F.col("__start.start")).alias("row"))


def edges_within(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends in the set."""
    side = lambda c: members.select(F.col("id").alias(c)).distinct()
    return edges.join(side("src"), "src", "left_semi").join(side("dst"), "dst", "left_semi")


def collect_counters(asked: DataFrame, held: DataFrame, key: str = "text") -> DataFrame:
    """One row: asked, held_out, deduplicated (rows beyond the first of a text), answered, no_answer; held-out texts count first and once. asked (text, answer).

    A text is a digest with its rows and answers, combined before the shuffle, so a text that most rows ask costs no more than others.
    """
    texts = asked.groupBy(F.sha2(F.col(key).cast("binary"), 256).alias("__s")).agg(F.count("*").alias("n"), F.count("answer").alias("answers"))
    rows = texts.join(held.select(F.col("sha256").alias("__h")).distinct(), F.col("__s") == F.col("__h"), "left")
    out = F.col("__h").isNotNull()
    total = lambda test, v: F.coalesce(F.sum(F.when(test, v)), F.lit(0))
    return rows.agg(total(F.lit(True), F.col("n")).alias("asked"), total(out, F.col("n")).alias("held_out"), total(~out, F.col("n") - 1).alias("deduplicated"), F.count_if(~out & (F.col("answers") > 0)).alias("answered"), F.count_if(~out & (F.col("answers") == 0)).alias("no_answer"))


def segment_hit(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column, radius: float) -> Column:
    """Whether a point lies within radius of a segment: distance to its projection, clamped to the ends."""
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - ax) * dx + (y - ay) * dy) / n))).otherwise(0.0)
    return F.hypot(x - ax - t * dx, y - ay - t * dy) <= radius


def rollout_summary(rollouts: DataFrame, by: list[str]) -> DataFrame:
    """Episodes, success and timeout rates, mean steps, collisions and return."""
    return rollouts.groupBy(*by).agg(F.count("*").alias("episodes"), F.avg(F.col("success").cast("int")).alias("success_rate"), F.avg(F.col("timeout").cast("int")).alias("timeout_rate"), F.avg("steps").alias("mean_steps"), F.sum("collisions").alias("collisions"), F.avg("reward").alias("mean_return"))


def displacement(df: DataFrame, by: list[str]) -> DataFrame:
    """Mean squared error over both components, mean angle where both vectors have a direction, and matches of direction over all samples: df (px, py, tx, ty)."""
    n1, n2 = F.col("px") ** 2 + F.col("py") ** 2, F.col("tx") ** 2 + F.col("ty") ** 2
    both = (n1 > 1e-18) & (n2 > 1e-18)
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("px") * F.col("tx") + F.col("py") * F.col("ty")) / F.sqrt(n1 * n2)))
    return df.groupBy(*by).agg(F.avg(((F.col("px") - F.col("tx")) ** 2 + (F.col("py") - F.col("ty")) ** 2) / 2).alias("mse"), F.avg(F.when(both, F.acos(cos))).alias("mean_angle"), (F.count_if(both & (cos > 0)) / F.count("*")).alias("direction_match"))


def naive_baselines(df: DataFrame, train: Column) -> DataFrame:
    """df (lx, ly: the displacement before; tx, ty) with the forecasts zero, last, and last direction at the mean speed of the training rows."""
    speed = df.where(train).agg(F.avg(F.hypot("tx", "ty")).alias("__s"))
    n = F.hypot("lx", "ly")
    out = df.crossJoin(F.broadcast(speed))  # one row
    return out.withColumns({"zero_x": F.lit(0.0), "zero_y": F.lit(0.0), "last_x": F.col("lx"), "last_y": F.col("ly"), "persist_x": F.when(n > 0, F.col("lx") / n * F.col("__s")).otherwise(0.0), "persist_y": F.when(n > 0, F.col("ly") / n * F.col("__s")).otherwise(0.0)}).drop("__s")


def masked_mse(df: DataFrame, by: list[str], mask: str = "scored") -> DataFrame:
    """Squared errors (ex, ey) of the scored rows over twice their number; undefined without scored rows."""
    n = F.count_if(F.col(mask))
    return df.groupBy(*by).agg(n.alias("n_scored"), divided(F.sum(F.when(F.col(mask), F.col("ex") ** 2 + F.col("ey") ** 2)), 2 * n).alias("mse"))


def selection_fingerprint(chosen: DataFrame, policy: str, index: str = "index") -> DataFrame:
    """policy:count:SHA-256 of the comma-joined indices in order; a selection is of bounded size."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(index)), lambda i: i.cast("string")), ",")
    return chosen.agg(F.concat_ws(":", F.lit(policy), F.count("*").cast("string"), F.sha2(text.cast("binary"), 256)).alias("fingerprint"))


def unseen_combinations(held: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """Held-out rows whose combination of labels is in no training row."""
    return held.join(train.select(*columns).distinct(), columns, "left_anti")


def accuracy(df: DataFrame, by: list[str], hit: Column) -> DataFrame:
    """by, n, hits and accuracy; a hit that is null is none, no rows leave no row."""
    hits = F.count_if(F.coalesce(hit, F.lit(False)))
    return df.groupBy(*by).agg(F.count("*").alias("n"), hits.alias("hits"), (hits / F.count("*")).alias("accuracy"))


def agreement(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Share of rows in which two predictions agree."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("int")).alias("agreement"))


def clipped_objective(df: DataFrame, clip: float = 0.2) -> DataFrame:
    """df (log_p, old_log_p, advantage) with the ratio, the clipped surrogate loss and whether the clip holds."""
    rate = F.exp(F.col("log_p") - F.col("old_log_p"))
    kept = F.least(F.greatest(rate, F.lit(1 - clip)), F.lit(1 + clip))
    return df.withColumns({"ratio": rate, "loss": -F.least(rate * F.col("advantage"), kept * F.col("advantage")), "clipped": rate != kept})


def memory_estimate(items: DataFrame, limit: int) -> DataFrame:
    """items (item, count, bytes_each) with bytes, the total (exact in decimals) and whether it stays within the limit."""
    each = F.col("count").cast("decimal(38,0)") * F.col("bytes_each")
    total = F.sum(each).over(Window.partitionBy())
    return items.select("item", each.alias("bytes"), total.alias("total"), (total <= limit).alias("fits"))


def first_event_error(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Difference of the first event of two tracks (frame, on) of each clip; null if one has none."""
    first = lambda df, n: df.where("on").groupBy(*by).agg(F.min("frame").alias(n))
    return first(a, "a_first").join(first(b, "b_first"), by, "full").withColumn("error", F.abs(F.col("a_first") - F.col("b_first")))


def replayed(log: DataFrame, key: str = "input_hash", order: str = "line_no") -> DataFrame:
    """For each input the newest record and how many there were: a replayed answer is the last one."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x"), F.count("*").alias("n")).select(key, "x.*", "n")
