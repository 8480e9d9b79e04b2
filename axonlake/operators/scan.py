"""Windows over long series: ranges of a series are tasks of their own, and each gets the few rows beyond its borders that its windows look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axonlake.sources.shared import stash

#: The range of a row, and whether the row is only there for the windows of another range's rows.
RANGE, HALO = "__range", "__halo"
_AT = "__series_at"
#: Rows up to which a series is one task's.
SERIES = 1_000_000


def _short(rows: DataFrame, by: list[str]) -> bool:
    """Whether no series has more than SERIES rows: one slim count, combined before its shuffle."""
    most = rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"]
    return most is None or most <= SERIES


def _carried(ranges: list[tuple], k: int) -> list[tuple[int, int]]:
    """(row, range) for the last k rows before each range that belong to its first series. ranges: (range, first series, last series, rows of the last series at its end)."""
    out, series, carry = [], object(), []
    for number, first, last, own in ranges:
        if first == series:
            out += [(at, number) for at in carry]
            carry = (carry + own)[-k:] if last == first else own
        else:
            carry = own
        series = last
    return out


def segmented(df: DataFrame, by: list[str], order: list[str], before: int = 0, after: int = 0, keep: Column | None = None, counted: DataFrame | None = None) -> DataFrame:
    """df with `__range` and `__halo`, for windows partitioned by `__range` and the series.

    As long as every series fits a task, all is one range, and the window's own shuffle is the only one. Else rows are range-partitioned by series and
    order and sorted, written once, and a series with most of the rows is many ranges. To a range's own rows (halo false)
    come the last `before` and the first `after` rows beyond its borders of the series that crosses them, or of those that pass `keep` (halo true). They are
    found from one row of facts a range, so what passes the driver are at most ranges * (before + after) row numbers. Null keys are a series like any other.
    `counted` may name a plainer table with as many rows of each series, to be counted in place of df.
    """
    if _short(df if counted is None else counted, by):
        return df.withColumns({RANGE: F.lit(0), HALO: F.lit(False)})
    keys, keep = [F.col(c).asc_nulls_first() for c in [*by, *order]], F.lit(True) if keep is None else keep
    rows = stash(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(_AT, F.monotonically_increasing_id()), "series")
    rows = rows.withColumn(RANGE, F.shiftright(_AT, 33).cast("int"))
    series, seen = F.struct(*by), F.when(keep, F.col(_AT))
    facts = rows.groupBy(RANGE).agg(F.min_by(series, _AT).alias("first"), F.max_by(series, _AT).alias("last"), F.struct(F.max_by(series, seen), F.max(seen)).alias("tail"), F.struct(F.min_by(series, seen), F.min(seen)).alias("head"))
    ranges = sorted(facts.collect(), key=lambda r: r[RANGE])
    wanted: set[tuple[int, int]] = set()
    for k, ascending, edge, near in ((before, False, "last", "tail"), (after, True, "first", "head")):
        if not k or len(ranges) < 2:
            continue
        if k == 1:
            own = {r[RANGE]: [r[near][1]] if r[near][1] is not None and r[near][0] == r[edge] else [] for r in ranges}
        else:
            at = facts.select(RANGE, F.col(edge).alias("__edge"))
            found = rows.where(keep).join(F.broadcast(at), RANGE).where(series.eqNullSafe(F.col("__edge")))  # one row a range
            place = F.row_number().over(Window.partitionBy(RANGE).orderBy(F.col(_AT).asc() if ascending else F.col(_AT).desc()))
            own = {r[RANGE]: [] for r in ranges}
            for r in found.select(RANGE, _AT, place.alias("k")).where(F.col("k") <= k).orderBy(_AT, ascending=not ascending).collect():
                own[r[RANGE]].append(r[_AT])
        line = [(r[RANGE], r["last"], r["first"], own[r[RANGE]]) if ascending else (r[RANGE], r["first"], r["last"], own[r[RANGE]]) for r in (reversed(ranges) if ascending else ranges)]
        wanted |= set(_carried(line, k))
    out = rows.withColumn(HALO, F.lit(False))
    if wanted:
        few = df.sparkSession.createDataFrame(sorted(wanted), f"{_AT} long, __to int")
        more = rows.drop(RANGE).join(F.broadcast(few), _AT).withColumnRenamed("__to", RANGE).withColumn(HALO, F.lit(True))
        out = out.unionByName(more)
    return out.drop(_AT)


def own(df: DataFrame) -> DataFrame:
    """The rows that `segmented` was given, once windows have been computed."""
    return df.where(~F.col(HALO)).drop(RANGE, HALO)


_COMBINE = {"sum": lambda a, b: a + b, "max": max, "min": min}


def prefix(df: DataFrame, by: list[str], order: list[str], running: dict[str, tuple[str, str]]) -> DataFrame:
    """df with running values of its series, the row itself included: name -> (`sum`, `max` or `min`, column). Nulls are passed over; null as long as there was no value.

    Series that fit a task are one window each. Else ranges compute their own running values; what the ranges before hold of the series that crosses the
    border is one row a range.
    """
    if _short(df, by):
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: getattr(F, how)(column).over(w) for name, (how, column) in running.items()})
    keys = [F.col(c).asc_nulls_first() for c in [*by, *order]]
    rows = stash(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(_AT, F.monotonically_increasing_id()), "series")
    rows = rows.withColumn(RANGE, F.shiftright(_AT, 33).cast("int"))
    series = F.struct(*by)
    edges = rows.groupBy(RANGE).agg(F.min_by(series, _AT).alias("first"), F.max_by(series, _AT).alias("last"))
    at_last = rows.join(F.broadcast(edges), RANGE).where(series.eqNullSafe(F.col("last"))).groupBy(RANGE)  # one row a range
    totals = {r[RANGE]: r for r in at_last.agg(*(getattr(F, how)(column).alias(name) for name, (how, column) in running.items())).collect()}
    carried, last, held = [], object(), {}
    for r in sorted(edges.collect(), key=lambda r: r[RANGE]):
        own, crosses = totals[r[RANGE]].asDict(), r["first"] == last
        if crosses:
            carried.append((r[RANGE], *(held[name] for name in running)))
        if crosses and r["first"] == r["last"]:
            held = {name: own[name] if held[name] is None else held[name] if own[name] is None else _COMBINE[how](held[name], own[name]) for name, (how, _) in running.items()}
        else:
            held = own
        last = r["last"]
    w = Window.partitionBy(RANGE, *by).orderBy(_AT).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumns({name: getattr(F, how)(column).over(w) for name, (how, column) in running.items()})
    kinds = ", ".join(f"__c_{name} {inside.schema[name].dataType.simpleString()}" for name in running)
    carry = df.sparkSession.createDataFrame(carried, f"{RANGE} int, {kinds}").join(edges.select(RANGE, "first"), RANGE)
    out = inside.join(F.broadcast(carry.withColumnRenamed(RANGE, "__r")), (F.col(RANGE) == F.col("__r")) & series.eqNullSafe(F.col("first")), "left")  # one row a range
    both = {"sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b), "max": F.greatest, "min": F.least}
    return out.select(*df.columns, *(both[how](F.col(name), F.col(f"__c_{name}")).alias(name) for name, (how, _) in running.items()))
