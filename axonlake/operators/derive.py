"""Evidence joined to edges, means by pair, and the rules of signs and strengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonlake.functions.arrays import argmax


def key_status(evidence: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    """One row a key: usable (one row, all channels known), null_probability, or ambiguous (several rows), with the channels of a usable key."""
    known = F.lit(True)
    for c in channels:
        known = known & F.col(c).isNotNull()
    out = evidence.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(~known).alias("unknown"), *(F.min(c).alias(c) for c in channels))
    status = F.when(F.col("n") > 1, "ambiguous").when(F.col("unknown") > 0, "null_probability").otherwise("usable")
    return out.select(*keys, status.alias("status"), *(F.when(status == "usable", F.col(c)).alias(c) for c in channels))


def join_evidence(events: DataFrame, keyed: DataFrame, keys: list[str]) -> DataFrame:
    """events with `outcome`: matched, unmatched, ambiguous or null_probability, and the channels of the matched."""
    out = events.join(keyed.withColumnRenamed("status", "__status"), keys, "left")
    outcome = F.when(F.col("__status").isNull(), "unmatched").when(F.col("__status") == "usable", "matched").otherwise(F.col("__status"))
    return out.withColumn("outcome", outcome).drop("__status")


def unused_keys(keyed: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that no event asks for."""
    return keyed.join(events.select(*keys).distinct(), keys, "left_anti")


def pair_means(matched: DataFrame, pair: list[str], channels: list[str], places: int | None = None) -> DataFrame:
    """Mean of each channel over a pair's matched events, the index of the largest (the first on ties) and its mean as a 32-bit float. With `places`, means are rounded to so many and compared as rounded."""
    means = matched.groupBy(*pair).agg(F.count("*").alias("matched"), *(F.avg(F.col(c).cast("double")).alias(c) for c in channels))
    if places is not None:
        means = means.withColumns({c: F.round(c, places) for c in channels})
    both = means.withColumn("__all", F.array(*channels))
    return both.withColumns({"best": argmax(F.col("__all")), "confidence": F.array_max("__all").cast("float")}).drop("__all")


def most_frequent(df: DataFrame, key: list[str], label: str, null_name: str | None = None) -> DataFrame:
    """The most frequent label of each key with its count; ties to the smallest label. Nulls count only under a name."""
    own = F.col(label) if null_name is None else F.coalesce(F.col(label), F.lit(null_name))
    counts = df.select(*key, own.alias("label")).where("label is not null").groupBy(*key, "label").agg(F.count("*").alias("n"))
    best = counts.groupBy(*key).agg(F.min_by(F.struct("label", "n"), F.struct(-F.col("n"), F.col("label"))).alias("x"))
    return best.select(*key, "x.label", "x.n")


def aligned(edges: DataFrame, pairs: DataFrame, pair: list[str]) -> tuple[DataFrame, DataFrame]:
    """Edges with the aggregates of their pair (left join), and the pairs that are no edge."""
    return edges.join(pairs, pair, "left"), pairs.join(edges.select(*pair).distinct(), pair, "left_anti")


def signed_strength(edges: DataFrame, signs: dict[int, int], gain: float, normaliser: str, min_probability: float, min_fraction: float) -> DataFrame:
    """edges (raw, matched, best, confidence, normaliser) with reason, sign and strength = gain * raw / normaliser.

    Reasons by precedence: no_match, low_fraction (matched / raw), low_probability (compared as a 32-bit float), unknown_mapping, known.
    A sign is 0 unless known; strength is null where the normaliser is not positive.
    """
    mapping = F.create_map(*(F.lit(x) for kv in signs.items() for x in kv))
    sign = mapping[F.col("best")]
    fraction = F.when(F.col("raw") > 0, F.col("matched") / F.col("raw"))
    reason = (
        F.when(F.coalesce(F.col("matched"), F.lit(0)) == 0, "no_match")
        .when(F.coalesce(fraction < min_fraction, F.lit(True)), "low_fraction")
        .when(F.col("confidence").cast("float") < F.lit(min_probability).cast("float"), "low_probability")
        .when(sign.isNull(), "unknown_mapping")
        .otherwise("known")
    )
    return edges.withColumns({"reason": reason, "sign": F.when(reason == "known", sign).otherwise(0), "strength": F.when(F.col(normaliser) > 0, gain * F.col("raw") / F.col(normaliser))})


def parameters(sign: Column, weight: Column, scale: float, unknown: str = "exclude") -> Column:
    """scale * sign * weight; an unknown sign (0 or null) is excluded (null), excitatory or inhibitory. Never -0."""
    other = {"exclude": F.lit(None).cast("double"), "excitatory": scale * weight, "inhibitory": -scale * weight}[unknown]
    return F.when(F.coalesce(sign, F.lit(0)) == 0, other).otherwise(scale * sign * weight) + F.lit(0.0)


def effective(sign: Column, log_magnitude: Column) -> Column:
    """sign * exp(log magnitude)."""
    return sign * F.exp(log_magnitude)


def sign_histogram(signed: DataFrame, kinds: list[str]) -> DataFrame:
    """kinds, sign, reason, edges and share of all edges: how often each transmitter got each sign, and for what reason others got none."""
    counts = signed.groupBy(*kinds, "sign", "reason").agg(F.count("*").alias("edges"))
    total = counts.agg(F.sum("edges").alias("__all"))
    return counts.crossJoin(F.broadcast(total)).select(*kinds, "sign", "reason", "edges", (F.col("edges") / F.col("__all")).alias("share"))  # one row
