"""Nearest rows by cosine."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many queries are held against all rows in one pass, and so many rows at a time.
QUERY_BLOCK, ROWS = 16_384, 256


def _unit(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors by their number of components: (where they stand, as rows of length 1); those without length are left out."""
    length, out = pc.list_value_length(vectors).to_numpy(zero_copy_only=False), {}
    for n in np.unique(length[length > 0]).tolist():
        at = np.flatnonzero(length == n)
        x = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
        norm = np.sqrt((x * x).sum(axis=1))
        own = ~(norm <= 0)
        out[n] = at[own], x[own] / norm[own, None]
    return out


def _best(batches, shared, places: int):
    """For each query the best row of a partition: its similarity, id and label. Passes over the rows hold a block of similarities at a time."""
    ids, labels, blocks = shared.value
    top, best, other = np.full(len(ids), -np.inf), np.zeros(len(ids), np.int64), pa.nulls(len(ids), labels.type)
    scale = 10.0**places
    for b in batches:
        number, found = b.column(0).to_numpy(), np.full(len(ids), -1)
        for n, (at, x) in _unit(b.column(1)).items():
            if n not in blocks:
                continue
            asked, q = blocks[n]
            at, x = (v[np.argsort(number[at], kind="stable")] for v in (at, x))
            for lo in range(0, len(at), ROWS):
                rows, near = at[lo : lo + ROWS], x[lo : lo + ROWS] @ q.T
                near *= scale
                near = np.copysign(np.floor(np.abs(near) + 0.5), near)
                near[np.isnan(near)] = np.inf  # sorts above all, as in SQL
                near[number[rows][:, None] == ids[asked]] = -np.inf
                first = near.argmax(axis=0)  # of equals the lowest id
                value, row = near[first, np.arange(len(asked))], rows[first]
                better = (value > top[asked]) | ((value == top[asked]) & (value > -np.inf) & (number[row] < best[asked]))
                own = asked[better]
                top[own], best[own], found[own] = value[better], number[row[better]], row[better]
        if (new := found >= 0).any():
            seen = pc.take(b.column(2), pa.array(np.where(new, found, 0)))
            other = pc.if_else(pa.array(new), seen, other)
    have = np.flatnonzero(top > -np.inf)
    sim = np.where(np.isinf(top[have]), np.nan, top[have] / scale)
    hit = pc.equal(other.take(pa.array(have)), labels.take(pa.array(have)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[have]), pa.array(best[have]), hit, pa.array(sim)], names=["query_id", "vec_id", "hit", "sim"])


def nearest(queries: DataFrame, rows: DataFrame, places: int = 6) -> DataFrame:
    """(query_id, vec_id, hit, sim): for each query the most similar other row, by similarity as rounded; ties to the lowest id; hit: same label.

    A stated set of queries meets all rows in blocks: blocks of queries are broadcast, and each task multiplies its rows with them a few at a time and keeps one
    best row per query, so memory is that of a block and at most one row per query and task is shuffled. Vectors without length, with a null component or a null id are left out.
    """
    known = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda v: v.isNull())
    slim = lambda df: df.where(known).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    q, spark = slim(queries), rows.sparkSession
    blocks, parts = max(1, -(-q.count() // QUERY_BLOCK)), []
    for b in range(blocks):
        own = q if blocks == 1 else q.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        table = own.toArrow().combine_chunks()  # QUERY_BLOCK of them, about
        ids, vectors, labels = (table[c].combine_chunks() if table.num_rows else pa.array([], table.schema.field(c).type) for c in ("vec_id", "embedding", "label"))
        shared = spark.sparkContext.broadcast((ids.to_numpy(), labels, _unit(vectors)))
        parts.append(slim(rows).mapInArrow(functools.partial(_best, shared=shared, places=places), "query_id long, vec_id long, hit boolean, sim double"))
    met = functools.reduce(DataFrame.unionByName, parts)
    best = F.max_by(F.struct("vec_id", "hit", "sim"), F.struct("sim", (-F.col("vec_id")).alias("v")))
    return met.groupBy("query_id").agg(best.alias("x")).select("query_id", "x.*")
