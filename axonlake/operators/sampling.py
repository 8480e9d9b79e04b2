"""Seeded splits, samples, evictions, pairings and text sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axonlake.operators.order import dense_index, last_rows, seeded
from axonlake.sources.shared import stash


def split_by(df: DataFrame, group: str, fraction: float, seed: int = 0) -> DataFrame:
    """df with `split`: the groups, in a seeded order, up to round(fraction * groups) (at least 1, at most all but 1) are held out.

    Groups are ranked as a slim table; rows only meet their group's verdict.
    """
    groups = dense_index(df.select(group).distinct().withColumn("__h", F.conv(F.substring(seeded(seed, group), 1, 15), 16, 10).cast("long")), ["__h", group], "__k").drop("__h")
    n = groups.agg(F.count("*").alias("__n"))
    # half away from zero, as the split sizes of the reference round
    held = F.greatest(F.lit(1), F.least(F.col("__n") - 1, F.floor(F.lit(fraction) * F.col("__n") + 0.5)))
    verdict = groups.crossJoin(F.broadcast(n)).select(F.col(group).alias("__g"), F.when(F.col("__k") < held, "validation").otherwise("train").alias("split"))  # one row
    return df.join(verdict, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def nearest_subset(counts: dict[int, int], target: float) -> dict[int, int]:
    """How many items of each size to take so that their sum comes nearest to the target, some but not all of them; of two sums equally near the smaller.

    counts says how many items of each size there are. A first choice takes the largest that fit; it misses the target by less than the greatest
    size M. Some best choice differs from it in at most 2 M + 1 items: put the differences in an order in which their sums stay within M of zero,
    then among more of them two sums are equal, and what lies between can be undone. So only sums as far from the first choice as so many items
    reach are followed, as bits of one number, a few shifts for each size; sizes of which there are many come first, and the search ends at the target itself.
    """
    total, sizes = sum(s * n for s, n in counts.items()), sorted((s for s, n in counts.items() if n and s > 0), reverse=True)
    first, left = {}, target
    for s in sizes:
        first[s] = int(min(counts[s], max(left, 0) // s))
        left -= s * first[s]
    base, items = sum(s * n for s, n in first.items()), 2 * max(sizes, default=0) + 2
    reach = min(total, items * max(sizes, default=0))
    mask, nearest = (1 << (2 * reach + 1)) - 1, round(target) - base
    sums, steps = 1 << reach, []  # bit reach + d: a sum of base + d
    for s in sorted(sizes, key=lambda s: (-counts[s], s)):
        less, more = min(first[s], items), min(counts[s] - first[s], items)
        steps.append((s, less, more, sums))
        sums >>= min(s * less, 2 * reach + 1)
        many, k = less + more, 1
        while many:
            k = min(k, many)
            sums |= sums << s * k & mask
            many, k = many - k, 2 * k
        if float(target).is_integer() and 0 < base + nearest < total and sums >> reach + nearest & 1:
            break
    best = None
    for away in range(2 * reach + 2):
        for d in sorted({nearest - away, nearest + away}):
            if -reach <= d <= reach and 0 < base + d < total and sums >> reach + d & 1:
                best = min([x for x in (best, (abs(base + d - target), d)) if x])
        if best and away > best[0] + 1:
            break
    if best is None:
        return {}
    taken, d = dict(first), best[1]
    for s, less, more, before in reversed(steps):
        for k in sorted(range(-less, more + 1), key=abs):
            if 0 <= reach + d - s * k <= 2 * reach and before >> reach + d - s * k & 1:
                taken[s], d = first[s] + k, d - s * k
                break
    return {s: n for s, n in taken.items() if n}


def group_safe_split(df: DataFrame, ends: tuple[str, str], fraction: float, checkpoint=None, seed: int = 0) -> DataFrame:
    """df with `split` such that no value of either column is on both sides: connected components of the values, held out so that their rows come nearest to the fraction.

    The driver gets how many components there are of each size (at most the square root of twice the rows) and says how many of each are held out;
    which ones is a seeded order within a size. A single component is not held out.
    """
    from axonlake.operators.graph import connected

    a, b = ends
    side = lambda c, p: F.when(F.col(c).isNull(), p + "-").otherwise(F.concat(F.lit(p + "+"), F.col(c).cast("string")))
    rows = df.withColumns({"__a": side(a, "a"), "__b": side(b, "b")})
    parts = connected(rows.select(F.col("__a").alias("src"), F.col("__b").alias("dst")).distinct(), checkpoint)
    placed = stash(rows.join(parts.select(F.col("id").alias("__a"), F.col("component").alias("__c")), "__a"), "components")
    sizes = stash(placed.groupBy("__c").agg(F.count("*").alias("__n")).withColumn("__h", seeded(seed, "__c")), "sizes")
    counts = {r["__n"]: r["k"] for r in sizes.groupBy("__n").agg(F.count("*").alias("k")).collect()}
    taken, before, quota = nearest_subset(counts, fraction * sum(s * n for s, n in counts.items())), 0, []
    for s in sorted(counts):
        quota.append((s, before + taken.get(s, 0)))
        before += counts[s]
    ranked = dense_index(sizes, ["__n", "__h", "__c"], "__k").join(F.broadcast(df.sparkSession.createDataFrame(quota, "__n long, __upto long")), "__n")  # as many rows as sizes
    held = ranked.where("__k < __upto").select(F.col("__c").alias("__held"))
    out = placed.join(held, F.col("__c") == F.col("__held"), "left")
    return out.withColumn("split", F.when(F.col("__held").isNotNull(), "validation").otherwise("train")).drop("__a", "__b", "__c", "__held")


def uniform_sample(df: DataFrame, n: int, key: list[str], seed: int = 0) -> DataFrame:
    """n rows without replacement, the first in a seeded order."""
    return df.orderBy(seeded(seed, *key), *key).limit(n)


def round_robin(df: DataFrame, group: str, n: int, order: list[str | Column]) -> DataFrame:
    """n rows, one of each group per round, groups by name within a round."""
    k = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("round", k).where(F.col("round") <= n).orderBy("round", group).limit(n)


def balanced_sample(df: DataFrame, group: str, n: int, key: list[str], seed: int = 0) -> DataFrame:
    """n rows without replacement, the groups in turn, each in a seeded order."""
    return round_robin(df, group, n, [seeded(seed, *key), *key])


def time_buckets(df: DataFrame, order: list[str]) -> DataFrame:
    """df with `bucket`: ceil(sqrt(n)) buckets of equal count by time, the rows of a bucket contiguous."""
    n = df.count()
    buckets = int(n**0.5) + (int(n**0.5) ** 2 < n)
    return dense_index(df, order, "__at").withColumn("bucket", F.floor(F.col("__at") * buckets / max(n, 1)).cast("int")).drop("__at")


def fifo(df: DataFrame, capacity: int, order: str = "sequence") -> DataFrame:
    """The last `capacity` rows by sequence."""
    return df.orderBy(F.col(order).desc()).limit(capacity)


def reservoir(df: DataFrame, capacity: int, key: list[str], seed: int = 0) -> DataFrame:
    """A uniform sample of `capacity` rows, as algorithm R would hold; by seeded order, so draws agree between reruns but not with another generator."""
    return uniform_sample(df, capacity, key, seed)


def replayable(df: DataFrame, split: str = "split") -> DataFrame:
    """df, in which a row of the test split is an error."""
    return df.where(F.when(F.col(split) == "test", F.raise_error(F.lit("test rows never enter replay")).cast("boolean")).otherwise(True))


def block_permutation(df: DataFrame, column: str, order: list[str], block: int, seed: int = 0) -> DataFrame:
    """df with the values of a column permuted within blocks of consecutive rows."""
    rows = dense_index(df, order, "__at").withColumn("__b", F.floor(F.col("__at") / block))
    own = rows.withColumn("__k", F.row_number().over(Window.partitionBy("__b").orderBy("__at")))
    new = own.select("__b", F.row_number().over(Window.partitionBy("__b").orderBy(seeded(seed, "__at"), "__at")).alias("__k"), F.col(column).alias("__new"))
    return own.join(new, ["__b", "__k"]).withColumn(column, F.col("__new")).drop("__at", "__b", "__k", "__new")


def prune(edges: DataFrame, fraction: float, weight: str = "weight") -> DataFrame:
    """edges without the smallest share by magnitude; ties to the smaller (src, dst)."""
    ranked = dense_index(edges.withColumn("__m", F.abs(F.col(weight)).cast("double")), ["__m", "src", "dst"], "__at")
    n = edges.agg(F.floor(F.count("*") * fraction).alias("__cut"))
    return ranked.crossJoin(F.broadcast(n)).where("__at >= __cut").drop("__m", "__at", "__cut")  # one row


def top_k_p(df: DataFrame, by: list[str], k: int, p: float, ident: str = "id", mass: str = "p") -> DataFrame:
    """Of each group the k most likely rows (ties to the lower id), cut to the smallest prefix with at least p of the mass, with `share` renormalised."""
    w = Window.partitionBy(*by).orderBy(F.desc(mass), ident)
    before = F.coalesce(F.sum(mass).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    kept = df.withColumns({"rank": F.row_number().over(w), "__before": before}).where((F.col("rank") <= k) & (F.col("__before") < p))
    return kept.withColumn("share", F.col(mass) / F.sum(mass).over(Window.partitionBy(*by))).drop("__before")


def pairs_same_event(samples: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of modalities a and b of one event with equal timestamps: samples (event_id, entity_id, modality, ts, sample_id)."""
    own = lambda m, p: samples.where(F.col("modality") == m).select("event_id", "ts", F.col("sample_id").alias(p))
    return own(a, "left_id").join(own(b, "right_id"), ["event_id", "ts"])


def pairs_other_event(samples: DataFrame) -> DataFrame:
    """Pairs of samples of one entity in different events, the smaller id first."""
    x, y = samples.alias("x"), samples.alias("y")
    return x.join(y, (F.col("x.entity_id") == F.col("y.entity_id")) & (F.col("x.event_id") != F.col("y.event_id")) & (F.col("x.sample_id") < F.col("y.sample_id"))).select(F.col("x.entity_id").alias("entity_id"), F.col("x.sample_id").alias("left_id"), F.col("y.sample_id").alias("right_id"))


def without_hashes(texts: DataFrame, hashes: DataFrame, column: str = "text") -> DataFrame:
    """texts whose SHA-256 is not held out."""
    return texts.join(hashes.select(F.col("sha256").alias("__h")), F.sha2(F.col(column).cast("binary"), 256) == F.col("__h"), "left_anti")


def newest(records: DataFrame, key: str, line: str = "line_no") -> DataFrame:
    """The last record of each key."""
    return last_rows(records, [key], line)


def token_windows(texts: DataFrame, size: int, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, window, n_tokens, n_scored): byte tokens with a begin and an end mark in windows by count; the first place of a window is not scored."""
    n = F.octet_length(F.coalesce(F.col(column), F.lit(""))) + 2
    each = texts.select(key, n.alias("n"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).alias("window"))
    tokens = F.least(F.lit(size), F.col("n") - F.col("window") * size)
    return each.select(key, "window", tokens.cast("long").alias("n_tokens"), (tokens - 1).cast("long").alias("n_scored"))


def perplexity(scored: DataFrame, by: list[str]) -> DataFrame:
    """Mean negative log-likelihood and its exponential over all tokens of a group; undefined without tokens."""
    out = scored.groupBy(*by).agg(F.sum("nll").alias("nll"), F.sum("tokens").alias("tokens"))
    mean = F.when(F.col("tokens") > 0, F.col("nll") / F.col("tokens"))
    return out.select(*by, "tokens", mean.alias("mean_nll"), F.exp(mean).alias("perplexity"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (classes * count) of each class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"), F.count("*").alias("k"))
    return counts.crossJoin(F.broadcast(total)).select(label, "n", (F.col("t") / (F.col("k") * F.col("n"))).alias("weight"))  # one row


def validate_partition(parts: DataFrame) -> DataFrame:
    """Problems of a hash split (split, sha256): malformed, repeated or in several splits."""
    seen = parts.groupBy("sha256").agg(F.count("*").alias("n"), F.countDistinct("split").alias("splits"))
    problem = F.when(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "malformed").when(F.col("splits") > 1, "several_splits").when(F.col("n") > 1, "repeated")
    return seen.withColumn("problem", problem).where("problem is not null").select("sha256", "problem")
