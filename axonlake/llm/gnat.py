"""Product codes of vectors, whose entries are found through GNATs, trees of split points with ranges of distances (operator 11)."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axonlake.llm.common import read, small, stash

#: Parts of a vector, entries of a part's codebook (two hexadecimal digits hold at most 256), rounds, and the factor before components are rounded down.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Split points of a node, and points up to which a node is a leaf.
SPLITS, LEAF = 8, 6
LONGEST = 2**63 - 1
#: Bounds are moved outwards by this share, far more than a square root and a sum of doubles lose by rounding.
SLACK = 2.0**-48


def _up(x):
    return x * (1 + SLACK)


def _down(x):
    return x * (1 - SLACK)


def squared(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distances in whole numbers."""
    return ((rows - point) ** 2).sum(axis=-1)


class Gnat:
    """A tree over points with whole components (int64, or Python's integers where those would not do).

    A node has split points, far from one another; every other point belongs to the nearest of them. For split i and the points of split
    j (j with them), `low[i, j]` and `high[i, j]` bound their distances, rounded outwards. `nearest` measures a query against the splits
    one by one. With distance d to split i and r to the best so far, all points of j are farther than r if d - r > high or d + r < low; then the
    whole subtree goes. Only strictly farther points go, so every point that ties is measured, in whole numbers, and the lowest number wins.
    """

    def __init__(self, points: np.ndarray, numbers: np.ndarray | None = None):
        self.points, self.numbers = points, np.arange(len(points)) if numbers is None else numbers
        self.leaf = len(points) <= LEAF
        if self.leaf:
            return
        splits, away = [0], squared(points, points[0])
        while len(splits) < SPLITS and max(away) > 0:
            splits.append(int(np.argmax(away)))
            away = np.minimum(away, squared(points, points[splits[-1]]))
        if len(splits) == 1:  # the same point again and again
            self.leaf = True
            return
        d2 = np.stack([squared(points, points[s]) for s in splits])
        owner = np.argmin(d2, axis=0)
        owner[splits] = np.arange(len(splits))
        d = np.sqrt(d2.astype(float))
        self.low = _down(np.array([[row[owner == j].min() for j in range(len(splits))] for row in d]))
        self.high = _up(np.array([[row[owner == j].max() for j in range(len(splits))] for row in d]))
        self.splits, self.children = splits, []
        for j, s in enumerate(splits):
            own = np.flatnonzero((owner == j) & (np.arange(len(points)) != s))
            self.children.append(Gnat(points[own], self.numbers[own]) if len(own) else None)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The number and the squared distance of each query's nearest point, ties to the lowest number; and how many distances were measured."""
        best, at = np.full(len(queries), -1, queries.dtype), np.full(len(queries), -1)
        return at, best, self._lower(queries, np.arange(len(queries)), best, at)

    def _measure(self, queries, rows, k, best, at):
        d2 = squared(queries[rows], self.points[k])
        better = (at[rows] < 0) | (d2 < best[rows]) | ((d2 == best[rows]) & (self.numbers[k] < at[rows]))
        best[rows[better]], at[rows[better]] = d2[better], self.numbers[k]
        return d2

    def _out(self, d, best, i):
        """Which splits' points are strictly farther than the best, seen from split i at distance d."""
        d, r = d[:, None], _up(np.sqrt(best.astype(float)))[:, None]
        return (_down(d) > _up(r + self.high[i])) | (_up(_up(d) + r) < self.low[i])

    def _lower(self, queries, rows, best, at) -> int:
        if self.leaf:
            for k in range(len(self.points)):
                self._measure(queries, rows, k, best, at)
            return len(rows) * len(self.points)
        measured, alive = 0, np.ones((len(rows), len(self.splits)), bool)
        seen = np.full(alive.shape, np.nan)
        for i, s in enumerate(self.splits):
            own = np.flatnonzero(alive[:, i])
            if len(own):
                seen[own, i] = np.sqrt(self._measure(queries, rows[own], s, best, at).astype(float))
                alive[own] &= ~self._out(seen[own, i], best[rows[own]], i)
                measured += len(own)
        for j, child in enumerate(self.children):
            own = np.flatnonzero(alive[:, j]) if child else ()
            for i in range(len(self.splits)):  # once more: the best has come nearer since
                if len(own):
                    d = seen[own, i]
                    own = own[np.isnan(d) | ~self._out(d, best[rows[own]], i)[:, j]]
            if len(own):
                measured += child._lower(queries, rows[own], best, at)
        return measured


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles as int64, or as Python's integers where squares of differences could pass a long."""
    x = np.floor(values * float(scale))
    if np.abs(x).max(initial=0.0) < 2.0**28:
        return x.astype(np.int64)
    return np.vectorize(int, otypes=[object])(x)


def fit_for(values: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as int64, or both as Python's integers."""
    if values.dtype == object or queries.dtype == object:
        return values.astype(object), queries.astype(object)
    return values, queries


def by_dim(batch: pa.RecordBatch, scale: int):
    """(dimension, row numbers, matrix of whole components) of a batch whose last column is the vector."""
    vec = batch.column(batch.num_columns - 1)
    dims = vec.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(dims):
        own = np.flatnonzero(dims == d)
        yield int(d), own, whole(vec.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), int(d)), scale)


class Coder:
    """Codebooks of one dimension, [part, entry, component], and a tree for each part."""

    def __init__(self, books: np.ndarray):
        self.books, self.trees, self.exact = books, [Gnat(book) for book in books], None
        self.sha256 = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """[row, part] entries and squared distances, and how many distances were measured."""
        trees, width = self.trees, self.books.shape[2]
        if vectors.dtype == object or self.books.dtype == object:
            self.exact = self.exact or [Gnat(book.astype(object)) for book in self.books]
            trees, vectors = self.exact, vectors.astype(object)
        found = [tree.nearest(vectors[:, p * width : (p + 1) * width]) for p, tree in enumerate(trees)]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1), sum(f[2] for f in found)


SUMS = "dim int, part int, entry int, n long, sums array<string>"


def _rows(found: dict) -> pa.RecordBatch:
    keys = [k for k, v in found.items() if v[0]]
    columns = [pa.array([k[i] for k in keys], pa.int32()) for i in range(3)]
    columns += [pa.array([int(found[k][0]) for k in keys], pa.int64()), pa.array([[str(x) for x in found[k][1]] for k in keys], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, names=["dim", "part", "entry", "n", "sums"])


def _sums(batches, shared, scale: int):
    """For each entry the number of parts assigned to it and the sums of their components, one row a task and entry."""
    coders, found = {d: Coder(books) for d, books in shared.value.items()}, {}
    for b in batches:
        for d, _, vectors in by_dim(b, scale):
            at, _, _ = coders[d].assign(vectors)
            parts, entries, width = coders[d].books.shape
            for p in range(parts):
                own, order = vectors[:, p * width : (p + 1) * width], np.argsort(at[:, p], kind="stable")
                names, starts = np.unique(at[order, p], return_index=True)
                totals = np.add.reduceat(own[order], starts, axis=0)
                for e, n, total in zip(names.tolist(), np.diff([*starts, len(own)]).tolist(), totals.tolist(), strict=True):
                    was = found.get((d, p, e))
                    found[d, p, e] = (n, total) if was is None else (was[0] + n, [x + y for x, y in zip(was[1], total, strict=True)])
    yield _rows(found)


def _added(batches):
    """The tasks' sums added up, in whole numbers of any size."""
    found = {}
    for b in batches:
        for d, p, e, n, sums in zip(*(c.to_pylist() for c in b.columns), strict=True):
            was = found.get((d, p, e), (0, [0] * len(sums)))
            found[d, p, e] = (was[0] + n, [x + int(y) for x, y in zip(was[1], sums, strict=True)])
    yield _rows(found)


def _coded(batches, shared, scale: int):
    """id, label, code, error and the digest of the codebooks."""
    coders = {d: Coder(books) for d, books in shared.value.items()}
    for b in batches:
        code, error, digest = [""] * b.num_rows, [0] * b.num_rows, [""] * b.num_rows
        for d, own, vectors in by_dim(b, scale):
            at, far, _ = coders[d].assign(vectors)
            for i, a, x in zip(own.tolist(), at.astype(np.uint8), far.sum(axis=1).tolist(), strict=True):
                code[i], error[i], digest[i] = a.tobytes().hex(), min(x, LONGEST), coders[d].sha256
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(code), pa.array(error, pa.int64()), pa.array(digest)], names=[*b.schema.names[:-1], "code", "error", "codebooks_sha256"])


def usable(embeddings: DataFrame, id: str, vector: str, label: str, parts: int, scale: int) -> DataFrame:
    """vec_id, label and vec (doubles) of the vectors that can be coded."""
    largest = F.lit(float(np.finfo(np.float64).max) / scale)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > largest)
    rows = embeddings.select(F.col(id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vec"))
    return rows.where(F.col("vec").isNotNull() & (F.size("vec") > 0) & (F.size("vec") % parts == 0)).where(~F.exists("vec", bad))


def product_codes(embeddings: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """Codes of all vectors (vec_id, label, code, error, label_error, codebooks_sha256) and the codebooks [part, entry, component] by dimension.

    Components are floor(scale * x). A part's codebook starts as that part of the vectors with the smallest ids (null ids last, equal ids by their
    vectors); fewer vectors give fewer entries. In each round every part goes to its nearest entry, ties to the lower index, and entries
    become the floors of their parts' means; unused ones stay. Errors and sums are whole numbers of any size; a reported error or
    sum beyond a long is held at its end. Left out are vectors that are null, hold null or non-finite components (or such as become infinite when
    scaled), are empty or can't be cut into equal parts. Vectors of different dimensions have codebooks of their own. Repeated ids are rows of their
    own. Other columns of embeddings are not read. No vectors give no rows.

    A round is one pass over the table: a task sends one row of sums for each entry that it used, so what is shuffled and what the driver gets
    (the codebooks) don't grow with the vectors, and a label or an entry with most of the rows costs nothing more.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256")
    spark = embeddings.sparkSession
    rows = usable(embeddings, id, vector, label, parts, scale)
    first = Window.partitionBy("dim").orderBy(F.col("vec_id").asc_nulls_last(), "vec")
    seeds = rows.select("vec_id", "vec", F.size("vec").alias("dim")).withColumn("at", F.row_number().over(first)).where(F.col("at") <= entries).orderBy("dim", "at").select("dim", "vec").collect()
    books = {}
    for d in {r["dim"] for r in seeds}:
        x = whole(np.array([r["vec"] for r in seeds if r["dim"] == d], float), scale)
        books[d] = x.reshape(len(x), parts, -1).transpose(1, 0, 2).copy()
    run = lambda f, shared: functools.partial(f, shared=shared, scale=scale)
    for _ in range(rounds if books else 0):
        shared = spark.sparkContext.broadcast(books)
        sums = rows.select("vec").mapInArrow(run(_sums, shared), SUMS).repartition("dim", "part", "entry").mapInArrow(_added, SUMS).collect()
        books = {d: b.astype(object) for d, b in books.items()}
        for r in sums:
            books[r["dim"]][r["part"], r["entry"]] = [int(x) // r["n"] for x in r["sums"]]
        books = {d: b.astype(np.int64) if np.abs(b).max() < 2**28 else b for d, b in books.items()}
    schema = T.StructType([rows.schema["vec_id"], rows.schema["label"], *T.StructType.fromDDL("code string, error long, codebooks_sha256 string")])
    coded = stash(rows.mapInArrow(run(_coded, spark.sparkContext.broadcast(books)), schema), "codes")
    most = F.lit(LONGEST).cast("decimal(38,0)")
    sums = coded.groupBy(F.col("label").alias("__label")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error"))
    out = coded.join(small(sums), F.col("label").eqNullSafe(F.col("__label")))
    return out.select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256"), books


def decoded(code: Column, books: np.ndarray, scale: int = SCALE) -> Column:
    """The vector that a code stands for, as doubles: entries put together and divided by the scale."""
    parts, tables = len(books), F.array(*(F.array(*(F.array(*(F.lit(int(x) / scale) for x in entry)) for entry in book)) for book in books))
    digit = lambda p: F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int") + 1
    return F.flatten(F.array(*(F.element_at(F.element_at(tables, p + 1), digit(p)) for p in range(parts))))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors in 16 parts of 64 entries after two rounds."""
    return product_codes(read(spark, sf_dir, "embeddings"))[0].select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _assigned(n: int) -> str:
    """All parts with the nearest entry of codebook c{n}, in SQL; key: distance and entry in one number."""
    return f"a{n} AS MATERIALIZED (SELECT p.r, p.part, min(CAST(list_sum(list_transform(list_zip(p.x, c.x), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS HUGEINT) * {ENTRIES} + c.entry) AS key FROM p JOIN c{n} c ON p.part = c.part GROUP BY p.r, p.part)"


def _replaced(n: int) -> str:
    """Codebook c{n+1} from the assignment to c{n}, in SQL."""
    return f"""s{n} AS (SELECT part, entry, pos, sum(v) AS s, count(*) AS n FROM (SELECT a.part, a.key % {ENTRIES} AS entry, unnest(p.x) AS v, unnest(range(1, len(p.x) + 1)) AS pos FROM a{n} a JOIN p ON a.r = p.r AND a.part = p.part) GROUP BY 1, 2, 3),
m{n} AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS x FROM s{n} GROUP BY 1, 2),
c{n + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN m{n} m ON c.part = m.part AND c.entry = m.entry)"""


#: For vectors of one dimension, whose whole components stay below 2 to the 28.
OP11_SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS x FROM v, range({PARTS}) g(part)),
c0 AS (SELECT part, r - 1 AS entry, x FROM p WHERE r <= {ENTRIES}),
{_assigned(0)},
{_replaced(0)},
{_assigned(1)},
{_replaced(1)},
{_assigned(2)},
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2),
o AS (SELECT r, string_agg(lower(printf('%02x', CAST(key % {ENTRIES} AS INT))), '' ORDER BY part) AS code, CAST(sum(key // {ENTRIES}) AS BIGINT) AS error FROM a2 GROUP BY r)
SELECT v.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN o ON v.r = o.r, h
"""
