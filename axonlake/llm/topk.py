"""Exact top-k inner products with a KD-tree on every shard (operator 9)."""

from __future__ import annotations

import functools
import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axonlake.llm.common import read, small, stash

#: Vectors a shard and queries a block hold, about; vectors in a leaf.
SHARD_ROWS, BLOCK_QUERIES, LEAF = 20_000, 2_000, 256
#: Numbers in the sample of vectors whose medians cut the space into cells, and sampled vectors a cell has at least. All vectors are indexed.
SAMPLE_VALUES, SAMPLE_CELL = 4_000_000, 16


class Tree:
    """KD-tree over the rows of `points`: split at the median of the widest dimension, with tight bounding boxes; leaves are slices of `order`."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.low, self.high, self.span, self.children = [], [], [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            own, at = points[self.order[lo:hi]], len(self.span)
            self.low.append(own.min(axis=0)), self.high.append(own.max(axis=0)), self.span.append((lo, hi)), self.children.append([None, None])
            if parent >= 0:
                self.children[parent][side] = at
            width = self.high[at] - self.low[at]
            if hi - lo > leaf and width.max() > 0:
                mid, dim = (hi - lo) // 2, int(np.argmax(width))
                self.order[lo:hi] = self.order[lo:hi][np.argpartition(own[:, dim], mid)]
                todo += [(lo, lo + mid, at, 0), (lo + mid, hi, at, 1)]
        self.low, self.high = np.array(self.low), np.array(self.high)


def search(tree: Tree, points: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int | None, k: int, floor) -> list[tuple]:
    """The k best (score, -id) of the tree for a query, leaving out the point at place `own`, best first; none below `floor`, a kth score that is known.

    Nodes are visited by the largest inner product their box allows; the search ends when that is below the kth score so far.
    """
    bounds = np.where(query > 0, query * tree.high, query * tree.low).sum(axis=1)
    best: list[tuple] = []
    heap = [(-bounds[0], 0)]
    while heap:
        bound, node = heapq.heappop(heap)
        kth = best[0][0] if len(best) == k else floor
        if kth is not None and -bound < kth:
            break
        left, right = tree.children[node]
        if left is not None:
            heapq.heappush(heap, (-bounds[left], left)), heapq.heappush(heap, (-bounds[right], right))
            continue
        lo, hi = tree.span[node]
        rows = tree.order[lo:hi]
        scores = points[rows] @ query
        m = rows != own if own is not None else np.ones(len(rows), bool)
        if kth is not None:
            m &= scores >= kth
        for i in np.flatnonzero(m):
            x = (int(scores[i]), -int(ids[rows[i]]))
            if len(best) < k:
                heapq.heappush(best, x)
            elif x > best[0]:
                heapq.heapreplace(best, x)
    return sorted(best, reverse=True)


def _searched(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best of one shard for one block of queries of the same dimension."""
    out, most = [], 2**63 - 1
    if len(left) and len(right):
        points, queries, ids = np.array(left["vec"].tolist(), float), np.array(right["vec"].tolist(), float), left["vec_id"].to_numpy()
        # float64 while all products and sums are exact in it, else Python's integers
        if np.abs(points).max(initial=0) * np.abs(queries).max(initial=0) * points.shape[1] >= 2.0**53:
            whole = np.vectorize(int, otypes=[object])
            points, queries = whole(points), whole(queries)
        tree, place = Tree(points), {row: i for i, row in enumerate(left["row"].tolist())}
        for q, row, name, floor in zip(queries, right["query_row"], right["query_id"], right["floor"], strict=True):
            floor = None if floor is None or pd.isna(floor) else int(floor)
            out += [(row, name, -i, max(-most, min(most, s))) for s, i in search(tree, points, ids, q, place.get(row), k, floor)]
    return pd.DataFrame({c: pd.Series([x[i] for x in out], dtype="int64") for i, c in enumerate(["query_row", "query_id", "vec_id", "score"])})


def vectors(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """row (a number), vec_id, dim and vec, each component x as floor(scale * x) in double, written once.

    Vectors that are null, empty or hold components that are null or not finite (as they are or multiplied by scale), and null ids, are left out.
    """
    large = F.lit(float(np.finfo(np.float64).max) / scale)
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) > large))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(finite)
    # floor of a double as a double: whole part, one less for negative fractions
    part = lambda x: F.rint(x * scale) - (F.rint(x * scale) > x * scale).cast("double")
    whole = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: part(x.cast("double"))).alias("vec"))
    return stash(whole.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.size("vec").alias("dim"), "vec"), "vectors")


def _vectors(column: pa.Array) -> np.ndarray:
    """Arrays of one length as a matrix."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def planes(sample: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """(dimension, median) of each inner node of the top of a KD-tree, level by level: the widest dimension of the sample is cut."""
    out, parts = [], [sample]
    for _ in range(depth):
        halves = []
        for own in parts:
            dim = int(np.argmax(np.ptp(own, axis=0))) if len(own) else 0
            at = float(np.median(own[:, dim])) if len(own) else 0.0
            out.append((dim, at))
            halves += [own[own[:, dim] < at], own[own[:, dim] >= at]]
        parts = halves
    return out


def _celled(batches, shared):
    """Adds each vector's cell: the path through the planes of its dimension."""
    for b in batches:
        dim, vec, cell = b.column(b.schema.get_field_index("dim")).to_numpy(), b.column(b.schema.get_field_index("vec")), np.zeros(b.num_rows, np.int32)
        for d in np.unique(dim):
            own, cuts = np.flatnonzero(dim == d), shared.value[int(d)]
            x, node = _vectors(vec.take(pa.array(own))), np.zeros(len(own), np.int64)
            if cuts:
                along, at = (np.array(c) for c in zip(*cuts, strict=True))
                while node[0] < len(cuts) if len(node) else False:
                    node = 2 * node + 1 + (x[np.arange(len(own)), along[node]] >= at[node])
            cell[own] = node - len(cuts)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=[*b.schema.names, "cell"])


def _boxes(batches):
    """Bounds of the vectors of each cell in a partition."""
    boxes = {}
    for b in batches:
        dim, cell, vec = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
        for d in np.unique(dim):
            own = np.flatnonzero(dim == d)
            x, c = _vectors(vec.take(pa.array(own))), cell[own]
            order = np.argsort(c, kind="stable")
            edge = np.flatnonzero(np.append(True, np.diff(c[order]) != 0))
            for at, low, high in zip(c[order][edge].tolist(), np.minimum.reduceat(x[order], edge), np.maximum.reduceat(x[order], edge), strict=True):
                was = boxes.get((int(d), at), (low, high))
                boxes[int(d), at] = np.minimum(was[0], low), np.maximum(was[1], high)
    keys = list(boxes)
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())]
    values = [[k[0] for k in keys], [k[1] for k in keys], [boxes[k][0] for k in keys], [boxes[k][1] for k in keys]]
    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=["dim", "cell", "low", "high"])


def _joint_box(group: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"dim": group["dim"].iloc[:1], "cell": group["cell"].iloc[:1], "low": [np.min(np.stack(group["low"]), axis=0)], "high": [np.max(np.stack(group["high"]), axis=0)]})


def _visits(batches, shared):
    """The cells that may hold one of a query's best: those whose box allows its kth score so far. Bounds are widened by what rounding may take."""
    for b in batches:
        dim, vec, floor = (b.column(b.schema.get_field_index(c)) for c in ("dim", "vec", "floor"))
        dim, floor = dim.to_numpy(), floor.cast(pa.float64()).fill_null(-np.inf).to_numpy()
        at, to = [], []
        for d in np.unique(dim):
            own, (cells, low, high) = np.flatnonzero(dim == d), shared.value[int(d)]
            q = _vectors(vec.take(pa.array(own)))
            for lo in range(0, len(own), 256):
                part = q[lo : lo + 256]
                bound = np.maximum(part, 0) @ high.T + np.minimum(part, 0) @ low.T
                slack = 1e-9 * (np.abs(part) @ np.maximum(np.abs(low), np.abs(high)).T)
                i, j = np.nonzero(bound + slack >= floor[own[lo : lo + 256], None])
                at.append(own[lo : lo + 256][i]), to.append(cells[j])
        at, to = np.concatenate(at), np.concatenate(to)
        for lo in range(0, len(at), 4000):  # a query's vector goes along to each cell
            own = b.take(pa.array(at[lo : lo + 4000]))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(to[lo : lo + 4000].astype(np.int32))], names=[*b.schema.names, "to"])


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query with the rows (both as `vectors` gives them), but for the row of its own number; ties to the smaller vec_id.

    Medians of a bounded sample cut the space into cells as the top of a KD-tree does; all rows are dealt to cells, and a cell with
    many rows (one vector repeated, say) to shards of bounded size. Queries are dealt to blocks by their own cell. First each query
    searches one shard of its own cell; the kth score found there is carried to all cells, whose boxes are broadcast: those that
    can't reach it are skipped, in the others it is the floor. A task has one shard and the queries of one block that visit it, and
    builds one KD-tree for them; shards are copied only to blocks that visit them.
    Only vectors of the same dimension meet. A repeated id is several rows: each is a candidate, and a query of its own. Scores
    beyond a long are held at its ends. Fewer than k candidates give as many rows; no candidates none.
    """
    spark = rows.sparkSession
    many = lambda c, size: F.ceil(F.col(c) / size).cast("int")
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    share = min(1.0, SAMPLE_VALUES / max(1, sum(d * n for d, n in sizes.items())))
    sample = rows.where(F.pmod(F.xxhash64(F.lit(5), "row"), F.lit(1_000_000_000)) < int(share * 1e9) + 1).select("dim", "vec").toArrow().combine_chunks()
    known, cuts = sample["dim"].to_numpy(), {}
    for d, n in sizes.items():
        own = sample["vec"].take(pa.array(np.flatnonzero(known == d))).combine_chunks()
        x = _vectors(own) if len(own) else np.zeros((0, d))
        depth = max(0, min(int(np.ceil(np.log2(n / SHARD_ROWS))) if n > SHARD_ROWS else 0, int(np.log2(max(1, len(x) / SAMPLE_CELL)))))
        cuts[d] = planes(x, depth)
    shared = spark.sparkContext.broadcast(cuts)
    celled = lambda df, names: df.mapInArrow(functools.partial(_celled, shared=shared), ", ".join(f"{c} {t}" for c, t in names.items()) + ", cell int")
    rows = stash(celled(rows.select("row", "vec_id", "dim", "vec"), {"row": "long", "vec_id": "long", "dim": "int", "vec": "array<double>"}), "celled")
    asked = queries.where(F.col("dim").isin(list(sizes))).select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), "dim", "vec")
    asked = stash(celled(asked, {"query_row": "long", "query_id": "long", "dim": "int", "vec": "array<double>"}).withColumnRenamed("cell", "home"), "asked")
    # as many rows as there are cells, which the sample bounds
    shards = stash(rows.groupBy("dim", "cell").agg(F.count("*").alias("n")).select("dim", "cell", many("n", SHARD_ROWS).alias("shards")), "shards")
    blocks = asked.groupBy("dim", "home").agg(F.count("*").alias("n")).select("dim", "home", many("n", BLOCK_QUERIES).alias("blocks"))
    rows = rows.join(F.broadcast(shards), ["dim", "cell"]).withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards")).cast("int"))
    asked = asked.join(F.broadcast(blocks), ["dim", "home"]).withColumn("block", F.pmod(F.xxhash64("query_row"), F.col("blocks")).cast("int"))
    key, schema, run = ["dim", "cell", "shard", "home", "block"], "query_row long, query_id long, vec_id long, score long", functools.partial(_searched, k=k)

    def search_in(q: DataFrame) -> DataFrame:
        """Best of the shards for the queries that visit them; each shard is copied to the blocks of its visitors."""
        visited = small(stash(q.select(key).distinct(), "visited"))
        copies = rows.join(visited, ["dim", "cell", "shard"]).select(*key, "row", "vec_id", "vec")
        return copies.groupBy(*key).cogroup(q.select(*key, "query_row", "query_id", "vec", "floor").groupBy(*key)).applyInPandas(run, schema)

    first = asked.withColumn("cell", F.col("home")).join(F.broadcast(shards), ["dim", "cell"])
    first = stash(first.withColumns({"shard": F.pmod(F.xxhash64("query_row"), F.col("shards")).cast("int"), "floor": F.lit(None).cast("long")}), "first-visits")
    best = stash(search_in(first), "first-best")
    floors = best.groupBy("query_row").agg(F.min("score").alias("floor"), F.count("*").alias("n")).select("query_row", F.when(F.col("n") == k, F.col("floor")).alias("floor"))
    boxes = rows.select("dim", "cell", "vec").mapInArrow(_boxes, "dim int, cell int, low array<double>, high array<double>").groupBy("dim", "cell").applyInPandas(_joint_box, "dim int, cell int, low array<double>, high array<double>").collect()
    of = {d: [r for r in boxes if r["dim"] == d] for d in sizes}
    shared_boxes = spark.sparkContext.broadcast({d: (np.array([r["cell"] for r in own]), np.array([r["low"] for r in own]), np.array([r["high"] for r in own])) for d, own in of.items()})
    waiting = asked.join(floors, "query_row", "left").select("query_row", "query_id", "dim", "vec", "home", "block", "floor")
    visits = waiting.mapInArrow(functools.partial(_visits, shared=shared_boxes), "query_row long, query_id long, dim int, vec array<double>, home int, block int, floor long, to int").withColumnRenamed("to", "cell")
    visits = visits.join(F.broadcast(shards), ["dim", "cell"]).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    been = (F.col("cell") == F.col("home")) & (F.col("shard") == F.pmod(F.xxhash64("query_row"), F.col("shards")).cast("int"))
    found = best.unionByName(search_in(stash(visits.where(~been), "visits")))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every hundredth vector among all."""
    rows = vectors(read(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.where(F.col("vec_id") % 100 == 0))


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
