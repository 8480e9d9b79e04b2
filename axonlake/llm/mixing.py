"""Mixing sources to target weights by capped water-filling (operator 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axonlake.llm.common import SPACE, read, small, stash

#: Buckets of the seeded order: hex digits of the hash that name one.
DIGITS = 3
#: Columns that a mix adds.
ADDED = ["size", "source_size", "target", "copies", "taken"]


def word_count(text: str = "text") -> Column:
    """Number of words of the text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, total: float, epochs: float) -> DataFrame:
    """sources (size, weight and any others) with target: shares of total by weight, none above epochs * size.

    Sources above are clamped and the rest is shared anew by weight until none is; each round is one aggregate over all sources. If
    all are clamped, less than total is given out. A source of weight 0 gets nothing.
    """
    cap, weight = F.col("size") * float(epochs), F.col("weight").cast("double")
    rest, free, clamped = total, sources.agg(F.sum(weight)).first()[0] or 0.0, 0
    while True:
        share = weight * rest / free if free else F.lit(0.0)
        above = share > cap if free else weight > 0
        n, taken, left = sources.agg(F.count_if(above), F.sum(F.when(above, cap)), F.sum(F.when(~above, weight))).first()
        if n == clamped:
            return sources.withColumn("target", F.when(above, cap).otherwise(share))
        rest, free, clamped = total - (taken or 0.0), left or 0.0, n


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with `number` from 0 in this order: ranges are sorted on their own and count on from those before (one row for each range)."""
    at, low = F.col("__at"), (1 << 33) - 1
    rows = stash(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn("__part", F.shiftright(at, 33))
    before = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    first = rows.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(before, F.lit(0)).alias("__first"))
    return rows.join(F.broadcast(first), "__part").withColumn("number", F.col("__first") + at.bitwiseAND(low)).drop("__at", "__part", "__first")


def allot(totals: DataFrame, weights: tuple[float, ...], volume: float, epochs: float) -> DataFrame:
    """totals (source, size) with target; weights repeat over the sources by code point, null last."""
    sources = numbered(totals, [F.col("source").asc_nulls_last()])
    sources = stash(sources.withColumn("weight", F.get(F.lit([float(w) for w in weights]), (F.col("number") % len(weights)).cast("int"))), "sources")
    return water_fill(sources, volume * (sources.agg(F.sum("size")).first()[0] or 0), epochs)


def mix(df: DataFrame, size: Column, key: str = "doc_id", source: str = "source", weights: tuple[float, ...] = (3, 1, 2), volume: float = 1.5, epochs: float = 2.0, seed: int = 0, keep: list[str] | None = None, stored: bool = True) -> DataFrame:
    """Columns `keep` (default: the key) of every row, its size, source_size and target, and how often the mix takes it: `copies` and `taken` = copies * size.

    Sources get targets by water_fill. Of a source, every row is repeated as often as whole epochs fit; the rest of the
    target is filled with rows in a seeded order (md5 of seed and key), up to the row whose middle passes it, so
    a source misses its target by at most half a row. The running sum over the order goes through sums of 16^3 hash
    buckets a source; only the bucket where the target falls is sorted, so a source with most of the rows needs no
    task of its own. Rows with a null key share one place in the order, repeated rows as well; rows of size 0 are
    taken with what surrounds them. Null is a source of its own; there may be any number of sources. Texts are taken whole.
    Columns of `keep` called size, source_size, target, copies or taken are left out. An empty df gives no rows.
    The rows are written once; with `stored` False they are read from df each time, which must be a table then: a copy of kept texts takes as much disk as they do.
    """
    keep = [c for c in ([key] if keep is None else keep) if c not in ADDED]
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    rows = df.select(*keep, F.col(source).cast("string").alias("__source"), size.cast("long").alias("__size"), order.alias("__order"))
    if stored:
        rows = stash(rows, "mix")
    bucket = F.substring("__order", 1, DIGITS)
    sums = stash(rows.groupBy("__source", bucket.alias("__bucket")).agg(F.sum("__size").alias("__sum")), "mix-sums")
    plan = allot(sums.groupBy(F.col("__source").alias("source")).agg(F.sum("__sum").alias("size")), weights, volume, epochs)
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0)
    plan = stash(plan.select(F.col("source").alias("__of"), F.col("size").alias("__source_size"), F.col("target").alias("__target"), whole.cast("int").alias("__whole"), (F.col("target") - whole * F.col("size")).alias("__rest")), "mix-plan")
    upto = F.sum("__sum").over(Window.partitionBy("__source").orderBy("__bucket"))
    same = lambda df: df["__source"].eqNullSafe(plan["__of"])
    passed = sums.withColumn("__upto", upto)
    falls = passed.join(small(plan), same(passed)).where("__upto > __rest")
    falls = falls.groupBy("__of").agg(F.min("__bucket").alias("__edge"), F.min_by(F.col("__upto") - F.col("__sum"), "__bucket").alias("__before")).withColumnRenamed("__of", "__edge_of")
    plan = stash(plan.join(falls, plan["__of"].eqNullSafe(F.col("__edge_of")), "left").drop("__edge_of"), "mix-edges")  # one row for each source
    known = rows.join(small(plan), same(rows))
    at_edge = F.col("__edge").isNotNull() & (bucket == F.col("__edge"))
    run = Window.partitionBy("__source").orderBy("__order", "__size").rowsBetween(Window.unboundedPreceding, 0)
    inside = known.where(at_edge).withColumn("__fits", F.col("__before") + F.sum("__size").over(run) - F.col("__size") / 2 <= F.col("__rest"))
    outside = known.where(~at_edge).withColumn("__fits", F.col("__edge").isNull() | (bucket < F.col("__edge")))
    copies = (F.col("__whole") + ((F.col("__rest") > 0) & F.col("__fits")).cast("int")).cast("int")
    return outside.unionByName(inside).select(*keep, F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), copies.alias("copies"), (copies * F.col("__size")).alias("taken"))


def repeat(df: DataFrame, copies: str = "copies") -> DataFrame:
    """df's rows as often as `copies` says, without that column."""
    return df.where(F.col(copies) > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col(copies)))).drop("__copy", copies)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix of 150 % of all words takes, sources weighing 3, 1, 2 and at most 2 epochs."""
    out = mix(read(spark, sf_dir, "documents"), word_count())
    return out.select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS cap, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps, sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM w),
f AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS k, weight * (total - caps) / free > cap AS above FROM o),
e AS (SELECT coalesce(min(k) FILTER (NOT above), 1000000000) AS k FROM f),
t AS (SELECT f.source, source_size, CASE WHEN f.k < e.k THEN cap ELSE weight * (total - (SELECT caps FROM f g, e h WHERE g.k = h.k)) / (SELECT free FROM f g, e h WHERE g.k = h.k) END AS target FROM f, e),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
r AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, CAST((whole + CASE WHEN rest > 0 AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM r
"""
