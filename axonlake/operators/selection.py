"""Values at given ranks of large groups, found by counting in ever smaller intervals instead of sorting or holding a group."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axonlake.operators.order import few
from axonlake.sources.shared import stash

#: Counts an interval is divided into, and values up to which an interval is read off.
BUCKETS, FEW = 4096, 500_000
_LARGEST, _LEAST = 1.7976931348623157e308, 4.9e-324


def _near(c: Column) -> Column:
    """Half of a value in double, so that differences are finite."""
    return F.greatest(F.least(c.cast("double"), F.lit(_LARGEST)), F.lit(-_LARGEST)) / 2


def _scale(c: Column) -> Column:
    """Sign and logarithm of a value, which never falls as the value grows."""
    return F.signum(_near(c)) * (F.log2(F.greatest(F.abs(_near(c)), F.lit(_LEAST))) + 1080)


def _bucket(value: Column, low: Column, high: Column, by_scale: bool) -> Column:
    """Number of the bucket of a value in [low, high], which never falls as the value grows: of equal width, or by sign and logarithm where these differ."""
    share = (_near(value) - _near(low)) / (_near(high) - _near(low))
    if by_scale:
        share = F.when(_scale(low) < _scale(high), (_scale(value) - _scale(low)) / (_scale(high) - _scale(low))).otherwise(share)
    return F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def values_at(df: DataFrame, by: list[str], column: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """by, `n` (values that are not null) and, for each name, the value at position ranks[name](n), from 0, of the group's values in ascending order.

    Groups of up to FEW values are read off from the counts of their distinct values. With larger ones, round by round the interval that holds a
    wanted rank is cut into buckets, whose counts, least and greatest values are combined before the shuffle; the bucket with the rank is the next
    interval, until it has few values, or such as a double can't tell apart, and is read off. So no task holds or sorts a large group, a round
    reads the table once, and one round does for a billion values that are spread evenly. Buckets of equal width take turns with buckets by scale, so values
    of all sizes or crowded at one point need few rounds too. NaN comes after all numbers. A rank below 0 or beyond the group gives null; groups
    without values are left out.
    """
    group, kind = F.struct(F.lit(0).alias("__all"), *by), df.schema[column].dataType
    values = df.where(F.col(column).isNotNull())
    most = values.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"]
    if most is None or most <= FEW:
        return _at_once(values, by, column, ranks)
    nan = F.isnan(column) if kind.typeName() in ("double", "float") else F.lit(False)
    values = values.select(group.alias("g"), F.col(column).alias("v"), nan.alias("nan"))
    plain = F.when(~F.col("nan"), F.col("v"))
    counts = values.groupBy("g").agg(F.count("*").alias("n"), F.count(plain).alias("m"), F.min(plain).alias("low"), F.max(plain).alias("high"))
    counts = stash(counts, "groups")
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("long").alias("rank")) for name, rank in ranks.items())))
    wanted = counts.select("g", "n", "m", "low", "high", each.alias("w")).select("g", "n", "m", "low", "high", "w.name", "w.rank").where("rank >= 0 and rank < n")
    values = values.where(~F.col("nan")).select("g", "v")
    # a wanted rank, the interval with it, the number of values below, and of those in it
    state = wanted.where("rank < m").select("g", "name", "rank", "low", "high", F.lit(0).cast("long").alias("below"), F.col("m").alias("inside"))
    found, small, alike = [], [], _near(F.col("high")) <= _near(F.col("low"))
    if kind.typeName() in ("double", "float"):
        found.append(wanted.where("rank >= m").select("g", "name", F.lit(float("nan")).cast(kind).alias("v")))
    large = (F.col("inside") > FEW) & ~alike
    for round_ in itertools.count():  # the least and the greatest value of an interval never share a bucket
        found.append(state.where("low = high").select("g", "name", F.col("low").alias("v")))
        small.append(state.where((F.col("low") != F.col("high")) & ~large))
        state = state.where(large)
        if state.isEmpty():
            break
        intervals = state.select("g", "low", "high").distinct()
        rows = values.join(few(intervals), "g").where(F.col("v").between(F.col("low"), F.col("high")))
        bucket = _bucket(F.col("v"), F.col("low"), F.col("high"), round_ % 2 == 1)
        cut = rows.groupBy("g", "low", bucket.alias("bucket")).agg(F.count("*").alias("k"), F.min("v").alias("from"), F.max("v").alias("to"))
        before = Window.partitionBy("g", "low").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows
        cut = cut.withColumn("before", F.coalesce(F.sum("k").over(before), F.lit(0)))
        at = F.col("rank") - F.col("below")
        met = state.join(cut, ["g", "low"]).where((F.col("before") <= at) & (at < F.col("before") + F.col("k")))
        state = stash(met.select("g", "name", "rank", F.col("from").alias("low"), F.col("to").alias("high"), (F.col("below") + F.col("before")).alias("below"), F.col("k").alias("inside")), "intervals")
    all_found = functools.reduce(DataFrame.unionByName, [*found, _read_off(values, functools.reduce(DataFrame.unionByName, small))])
    wide = all_found.groupBy("g").agg(*(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks))
    out = counts.select("g", "n").join(wide, "g", "left")
    return out.select(*(F.col("g")[c].alias(c) for c in by), "n", *ranks)


def _at_once(values: DataFrame, by: list[str], column: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """The same for groups of few values: distinct values are counted, then added up in their group."""
    counts = values.groupBy(*by, F.col(column).alias("__v")).agg(F.count("*").alias("__k"))
    w = Window.partitionBy(*by)
    upto, n = F.sum("__k").over(w.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)), F.sum("__k").over(w)
    rows = counts.withColumns({"__upto": upto, "__n": n})
    here = lambda rank: (F.col("__upto") - F.col("__k") <= rank) & (rank < F.col("__upto"))
    out = rows.groupBy(*by).agg(F.max("__n").alias("n"), *(F.max(F.when(here(rank(F.col("__n"))), F.col("__v"))).alias(name) for name, rank in ranks.items()))
    return out.where(F.col("n").isNotNull())  # without by, no values are a row of nulls


def _read_off(values: DataFrame, state: DataFrame) -> DataFrame:
    """Values at the ranks of small intervals: distinct values are counted, then added up in their interval."""
    rows = values.join(few(state.select("g", "low", "high").distinct()), "g").where(F.col("v").between(F.col("low"), F.col("high")))
    counts = rows.groupBy("g", "low", "v").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy("g", "low").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))  # at most FEW distinct values
    at = F.col("rank") - F.col("below")
    met = state.join(counts.withColumn("upto", upto), ["g", "low"]).where((F.col("upto") - F.col("k") <= at) & (at < F.col("upto")))
    return met.select("g", "name", "v")


def nearest_ranks(df: DataFrame, by: list[str], column: str, ranks: dict[str, float]) -> DataFrame:
    """by and, for each name, element number ceil(q * n) of the sorted values of a group (0: the least); nulls are left out."""
    place = lambda q: lambda n: F.greatest(F.ceil(n * q) - 1, F.lit(0))
    return values_at(df, by, column, {name: place(q) for name, q in ranks.items()}).select(*by, *ranks)


def linear_quantiles(df: DataFrame, by: list[str], column: str, quantiles: dict[str, float]) -> DataFrame:
    """by and, for each name, the value at position q * (n - 1), interpolated between its neighbours; nulls are left out."""
    low = {f"__{name}_low": lambda n, q=q: F.floor((n - 1) * q) for name, q in quantiles.items()}
    high = {f"__{name}_high": lambda n, q=q: F.ceil((n - 1) * q) for name, q in quantiles.items()}
    rows = values_at(df, by, column, low | high)

    def between(name: str, q: float) -> Column:
        at = (F.col("n") - 1) * F.lit(float(q))
        a, b = F.col(f"__{name}_low").cast("double"), F.col(f"__{name}_high").cast("double")
        return F.when(a == b, a).otherwise(a + (b - a) * (at - F.floor(at)))

    return rows.select(*by, *(between(name, q).alias(name) for name, q in quantiles.items()))
