"""Sparse logistic regression with follow-the-regularised-leader updates, and bounded samples of labelled rows to fit it on."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct feature numbers and their values; None: all 1.
Row = tuple[np.ndarray, np.ndarray | None]
ONES = np.ones(1 << 16, np.float32)


class Ftrl:
    """Weights of a logistic regression; a row is (distinct feature numbers, values).

    Each row updates its own features only; the L1 part keeps features that say little at exactly 0.
    """

    def __init__(self, size: int, alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0):
        self.z, self.n, self.bias_z, self.bias_n = np.zeros(size), np.zeros(size), 0.0, 0.0
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def bias(self) -> float:
        return -self.bias_z / ((self.beta + np.sqrt(self.bias_n)) / self.alpha)

    def fit(self, rows: Sequence[Row], labels: np.ndarray, epochs: int = 3, seed: int = 0) -> Ftrl:
        """Passes over the rows in seeded orders."""
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                at, x = rows[i]
                w, b = self.weights(at), self.bias()
                g = float(probability(w @ x + b)) - labels[i]
                gx = g * x
                self.z[at] += gx - (np.sqrt(self.n[at] + gx * gx) - np.sqrt(self.n[at])) / self.alpha * w
                self.n[at] += gx * gx
                self.bias_z += g - (np.sqrt(self.bias_n + g * g) - np.sqrt(self.bias_n)) / self.alpha * b
                self.bias_n += g * g
        return self


def probability(margin):
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -35, 35)))


def sample(labels: DataFrame, label: str, rows: int, where: Column | None = None, key: str = "doc_id") -> DataFrame:
    """At most `rows` labelled rows (label not null), the first in a seeded order of the key: a bounded table that may be broadcast."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    known = known if where is None else known.where(where)
    return known.select(key, label).orderBy(F.xxhash64(F.lit(7), F.col(key)), key, label).limit(rows)


def featured(docs: DataFrame, chosen: DataFrame, extract: Callable[[], Callable[[bytes], Row]], label: str, key: str = "doc_id"):
    """(rows, labels) of the chosen documents, one text (the least) of a repeated id. chosen is bounded (see sample), so it is broadcast and its features come to the driver."""

    def run(batches):
        of = extract()
        for b in batches:
            found = [of(t) for t in b.column(0).fill_null("").cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([a.astype("<u4").tobytes() for a, _ in found], pa.binary()), pa.array([b"" if x is None else x.astype("<f4").tobytes() for _, x in found], pa.binary()), b.column(1), b.column(2)], names=["at", "x", "label", "key"])

    joined = docs.select(F.col(key), F.col("text")).join(F.broadcast(chosen), key).groupBy(key, label).agg(F.min("text").alias("text"))
    joined = joined.select("text", F.col(label).cast("double").alias("label"), F.col(key).cast("string").alias("key"))
    got = joined.mapInArrow(run, "at binary, x binary, label double, key string").toArrow().sort_by([("key", "ascending"), ("label", "ascending")]).combine_chunks()
    # views of the collected buffers, no copies; a row without values has ones
    view = lambda c, kind: [np.frombuffer(v.as_buffer(), kind) if v.is_valid and len(v.as_buffer()) else np.zeros(0, kind) for v in got[c]]
    rows = [(at, x if len(x) == len(at) else ONES[: len(at)] if len(at) <= len(ONES) else np.ones(len(at), np.float32)) for at, x in zip(view("at", "<u4"), view("x", "<f4"), strict=True)]
    return rows, got["label"].to_numpy()
