"""Dense positions without a single-partition sort, first-row rules and seeded ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axonlake.sources.shared import stash


def dense_index(df: DataFrame, keys: list[str], name: str = "index") -> DataFrame:
    """df with its position, from 0, in the order of `keys` (null first), whatever their types.

    Rows are range-partitioned by all keys and sorted in their ranges, written once, and ranges count on from those before them, so no
    task sorts the whole table and a frequent leading value is cut apart by the other keys. Rows with equal keys get positions in any order.
    """
    order = [F.col(k).asc_nulls_first() for k in keys]
    rows = stash(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__order_at", F.monotonically_increasing_id()), "positions")
    part, row = F.shiftright("__order_at", 33), F.col("__order_at").bitwiseAND((1 << 33) - 1)  # of the range, and in it
    counts = rows.groupBy(part.alias("__range")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    placed = rows.withColumn("__range", part).join(F.broadcast(offsets), "__range")
    return placed.withColumn(name, (F.col("__from") + row).cast("long")).drop("__range", "__order_at", "__from")


def first_rows(df: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """The row of each key with the smallest ordinal; a grouped minimum, so a hot key is combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), ordinal).alias("__row")).select(*key, "__row.*")


def last_rows(df: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """The row of each key with the largest ordinal: the newest record wins."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), ordinal).alias("__row")).select(*key, "__row.*")


def seeded(seed: int, *columns: str | Column) -> Column:
    """A text that orders rows at random, the same in every engine: md5 of seed and values."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") if isinstance(c, str) else c for c in columns)).cast("binary"))


def few(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """df, broadcast if a count says that it has at most so many rows; beyond that Spark's own choice of join holds."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
