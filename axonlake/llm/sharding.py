"""Contiguous shards of near-equal bytes from global prefix sums (operator 5)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axonlake.llm.common import read, stash

PART, BEFORE, ROW, TIE, SIZE, TIMES = "__part", "__before", "__row", "__tie", "__size", "__times"


def _runs(batches):
    """Neighbours in a batch that are equal in every column as one row with their number; columns whose equality is not that of their bytes keep rows apart."""
    plain = (pa.types.is_integer, pa.types.is_boolean, pa.types.is_string, pa.types.is_large_string, pa.types.is_binary, pa.types.is_large_binary, pa.types.is_temporal, pa.types.is_decimal)
    for b in batches:
        same = np.ones(max(b.num_rows - 1, 0), bool)
        for c in b.columns:
            if not any(is_kind(c.type) for is_kind in plain):
                same[:] = False
            if same.any():
                x, y = c.slice(1), c.slice(0, b.num_rows - 1)
                both = pc.and_(x.is_null(), y.is_null())
                same &= pc.or_(pc.fill_null(pc.equal(x, y), False), both).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.append(True, ~same)) if b.num_rows else np.zeros(0, np.int64)
        times = np.diff(np.append(first, b.num_rows))
        yield pa.RecordBatch.from_arrays([*b.take(pa.array(first)).columns, pa.array(times, pa.int64())], names=[*b.schema.names, TIMES])


def _running(batches):
    """Adds to the sorted rows of a partition its number, the bytes before each row and the row's number in it."""
    part, before, row = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.num_rows
        size, times = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in (SIZE, TIMES))
        ends, last = np.cumsum(size * times) + before, np.cumsum(times) + row
        added = [np.full(n, part, np.int64), ends - size * times, last - times]
        yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, added)], names=[*batch.schema.names, PART, BEFORE, ROW])
        before, row = (int(ends[-1]), int(last[-1])) if n else (before, row)


def contiguous_shards(df: DataFrame, size: Column, order: list[str], shards: int = 8, repeated: bool = False) -> DataFrame:
    """df with `size`, `shard` and `slot`: shards are contiguous in `order` and cut where the running size passes equal targets.

    Rows are range-partitioned and sorted once; each partition adds up its own sizes, the totals of the partitions
    (one row each) give every partition's offset, so no task sees more than its range. A row belongs to the target in
    which its middle byte lies, so a shard differs from the equal share by at most one row. Slots count from 0 in
    each shard. Null ids sort first; rows with equal keys are dealt in any order and may be cut apart, so one repeated
    key fills no single task. A null size counts as 0. Columns of df called size, shard or slot are replaced.
    An empty df gives no rows. With `repeated`, equal rows that stand together in df travel and are written as one row with their number, and are
    rows of their own again at the end.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    joined = df.mapInArrow(_runs, T.StructType([*df.schema.fields, T.StructField(TIMES, T.LongType())])) if repeated else df.withColumn(TIMES, F.lit(1).cast("long"))
    keyed = joined.withColumns({SIZE: F.coalesce(size.cast("long"), F.lit(0)), TIE: F.monotonically_increasing_id()})
    keys = [F.col(c).asc_nulls_first() for c in [*order, SIZE, TIE]]
    dealt = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(TIE)
    schema = T.StructType([*dealt.schema.fields, *(T.StructField(c, T.LongType()) for c in (PART, BEFORE, ROW))])
    rows = stash(dealt.mapInArrow(_running, schema), "shards")
    totals = rows.groupBy(PART).agg(F.sum(F.col(SIZE) * F.col(TIMES)).alias("size"), F.sum(TIMES).alias("n"))
    earlier = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = totals.select(F.col(PART), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("__from"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__first"), F.sum("size").over(Window.partitionBy()).alias("__all"))
    if repeated:
        k = F.col("__k")
        rows = rows.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.col(TIMES) - 1)))
        rows = rows.withColumns({BEFORE: F.col(BEFORE) + k * F.col(SIZE), ROW: F.col(ROW) + k}).drop("__k")
    placed = rows.join(F.broadcast(offsets), PART)
    middle = (F.col("__from") + F.col(BEFORE)) * 2 + F.col(SIZE)
    cut = F.floor(middle.cast("decimal(38,0)") * shards / F.greatest(F.col("__all") * 2, F.lit(1)))
    placed = placed.withColumns({"shard": F.least(cut, F.lit(shards - 1)).cast("int"), "slot": F.col("__first") + F.col(ROW)})
    firsts = placed.groupBy("shard").agg(F.min("slot").alias("__start"))  # one row for each shard
    out = placed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("slot") - F.col("__start")).withColumn("size", F.col(SIZE))
    return out.select(*(c for c in df.columns if c not in ("size", "shard", "slot")), "size", "shard", "slot")


def text_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus 1 for the line end."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards by law `bytes`, in the order of doc_id."""
    docs = read(spark, sf_dir, "documents").select("doc_id", text_bytes().alias("bytes"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    out = contiguous_shards(docs, F.col("bytes"), ["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        out.append(i)
    return out


#: DuckDB has no crc32: it folds the bytes of the text over the table of the usual polynomial.
OP5_SQL = f"""
WITH k AS (SELECT {_crc_table()} AS t),
d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, size - 1), lambda i: CAST(('0x' || substr(h, CAST(i * 2 + 1 AS INT), 2)) AS BIGINT))), lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1])), 4294967295) AS crc FROM d, k),
s AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before, sum(size) OVER () AS total FROM c),
p AS (SELECT *, CAST(least(7, (before * 2 + size) * 8 // (total * 2)) AS INT) AS shard FROM s)
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size) - 1 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM p
"""
