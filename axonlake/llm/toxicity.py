"""Toxicity by a chain of linear classifiers (operator 3)."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axonlake.llm.common import read
from axonlake.llm.linear import Ftrl, featured, probability, sample
from axonlake.llm.words import texts

#: Hashed features, labelled documents to learn from at most, folds of the out-of-fold predictions.
SIZE, TRAIN_DOCS, FOLDS = 1 << 20, 8000, 3
#: The categories in the order of the chain: two kinds of toxic documents, found in the training documents, and toxic documents of any kind.
CATEGORIES = ["kind_1", "kind_2", "toxic"]
#: Words and beginnings that tell toxic training documents from others best, by which the kinds are told apart.
TELLING = 256
_WORD = re.compile(r"[^\W\d_]+")
#: A word counts itself and its beginnings of these lengths; each has a feature for being there so many times.
STARTS, TIMES = (4, 5, 6, 7, 8), (1, 2, 4, 8)


def numbers(word: str) -> list[int]:
    """The feature groups of a word."""
    return [xxhash.xxh3_64_intdigest(x) % (SIZE // len(TIMES)) for x in (word, *(word[:n] + "*" for n in STARTS))]


class _Words(dict):
    """The row of each word in `table`, which has its feature groups; forgets all beyond a bound."""

    def __init__(self):
        super().__init__()
        self.table = np.zeros((1024, len(STARTS) + 1), np.int64)

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at] = numbers(word)
        return at


def counted(active: np.ndarray | None = None):
    """A function from a text to its features: which words and beginnings it has at least 1, 2, 4 and 8 times. With `active`, groups that are false there are left out."""
    known = _Words()

    def of(text: bytes):
        words = Counter(_WORD.findall(text.decode("utf-8", "replace").lower()))
        if len(known) > 200_000:
            known.clear()
        at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        groups, times = known.table[at].reshape(-1), np.repeat(np.fromiter(words.values(), np.int64, len(words)), len(STARTS) + 1)
        if active is not None:
            m = active[groups]
            groups, times = groups[m], times[m]
        groups, which = np.unique(groups, return_inverse=True)
        times = np.bincount(which, times, len(groups))
        out = np.concatenate([groups[times >= n] * len(TIMES) + k for k, n in enumerate(TIMES)])
        return out, None

    return of


def _with(row, chain: list[float]):
    """A row of features and the probabilities of the categories before, as features of their own."""
    at = row[0].astype(np.int64)
    return np.append(at, SIZE + np.arange(len(chain))), np.append(np.ones(len(at)), chain)


class _Seen:
    """Some rows with what the chain has said of them so far, put together when asked for."""

    def __init__(self, rows: list, chain: list, own: list[int]):
        self.rows, self.chain, self.own = rows, chain, own

    def __len__(self):
        return len(self.own)

    def __getitem__(self, k):
        return _with(self.rows[self.own[k]], self.chain[self.own[k]])


def folds_of(rows: list, folds: int = FOLDS) -> np.ndarray:
    """The fold of each row, by its features: equal texts are in one fold."""
    return np.array([xxhash.xxh3_64_intdigest(np.asarray(at, "<u4").tobytes()) % folds for at, _ in rows], np.int64)


def _fitted(rows: list, chain: list, y: np.ndarray, own) -> Ftrl:
    return Ftrl(SIZE + len(CATEGORIES), alpha=0.3, l1=1.5).fit(_Seen(rows, chain, own), y[own])


def fit_chain(rows: list, labels: list[np.ndarray], folds: int = FOLDS) -> list[Ftrl]:
    """One model a category. What a model sees of the categories before it are predictions by models that had not seen the row.
    The rows are bounded (TRAIN_DOCS), so the fits run on the driver: sending the rows to tasks takes more disk than the fits take time.
    """
    chain, models, fold = [[] for _ in rows], [], folds_of(rows, folds)
    for y in labels:
        before = [list(c) for c in chain]
        models.append(_fitted(rows, before, y, np.arange(len(rows))))
        for k in range(folds):
            model = _fitted(rows, before, y, np.flatnonzero(fold != k))
            for i in np.flatnonzero(fold == k):
                at, x = _with(rows[i], before[i])
                chain[i] = [*chain[i], float(probability(model.weights(at) @ x + model.bias()))]
    return models


def kinds(rows: list, toxic: np.ndarray) -> list[np.ndarray]:
    """The labels of each category. Toxic documents fall into two kinds along the main direction in which those words and beginnings
    vary over them that are much more frequent in toxic documents than in others."""
    groups = [np.unique(np.asarray(at, np.int64) // len(TIMES)) for at, _ in rows]
    seen = [np.bincount(np.concatenate([np.zeros(0, np.int64), *(g for g, t in zip(groups, toxic, strict=True) if t == k)]), minlength=SIZE // len(TIMES)) for k in (0, 1)]
    odds = np.log((seen[1] + 0.5) / (toxic.sum() + 1)) - np.log((seen[0] + 0.5) / (len(toxic) - toxic.sum() + 1))
    telling = np.sort(np.argsort(-odds * np.sqrt(seen[1]), kind="stable")[:TELLING])
    own = np.flatnonzero(toxic)
    x = np.array([np.isin(telling, groups[i]) for i in own], float).reshape(len(own), len(telling))
    first = np.zeros(len(toxic), bool)
    if len(own) > 1:
        x -= x.mean(axis=0)
        along = np.linalg.svd(x, full_matrices=False)[2][0]
        first[own] = x @ along * np.sign(along[np.argmax(np.abs(along))]) > 0
    return [(toxic.astype(bool) & first).astype(float), (toxic.astype(bool) & ~first).astype(float), toxic]


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_DOCS) -> list[Ftrl]:
    """The chain, learned from at most `rows` labelled documents; a doc_id that is repeated counts once."""
    found, y = featured(docs, sample(labels, "toxic", rows), counted, "toxic")
    return fit_chain(found, kinds(found, y))


def scored(docs: DataFrame, models: list[Ftrl], threshold: float = 0.5, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Columns `keep` (default: doc_id), a probability p_<category> for each category, and `rejected` (the last one reaches the threshold) of every row; one pass, no shuffle.

    Null and empty texts have no features and score as the bias says. Repeated rows score alike; long texts are taken whole;
    other columns than text and those kept are left alone, whatever their names; names of the added ones begin with `prefix`. Without
    labels all probabilities are 0.5 and nothing is rejected. An empty table gives no rows.
    """
    keep = ["doc_id"] if keep is None else keep
    added = [f"{prefix}p_{c}" for c in CATEGORIES]
    trained = any(m.n.any() or m.bias_n for m in models)
    sparse = [(np.flatnonzero(w := m.weights()), w[w != 0], m.bias()) for m in models]
    shared = docs.sparkSession.sparkContext.broadcast((len(models[0].z), sparse))

    def run(batches):
        size, sparse = shared.value
        models = []
        for at, w, bias in sparse:
            weights = np.zeros(size)
            weights[at] = w
            models.append((weights, bias))
        of = counted(np.any([w[:SIZE].reshape(-1, len(TIMES)).any(axis=1) for w, _ in models], axis=0))
        for b in batches:
            out = []
            for text in texts(b):
                row, chain = of(text), []
                for weights, bias in models:
                    at, x = _with(row, chain)
                    chain.append(float(probability(bias + weights[at] @ x)))
                out.append(chain)
            table = np.array(out, float).reshape(-1, len(models))
            kept = [b.column(b.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(table[:, k]) for k in range(table.shape[1]))], names=[*keep, *added])

    rows = docs if keep == docs.columns else docs.select(*keep, *([] if "text" in keep else ["text"]))
    out = rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in keep), *(T.StructField(c, T.DoubleType()) for c in added)]))
    return out.withColumn(f"{prefix}rejected", (F.col(added[-1]) >= threshold) & F.lit(trained))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category probabilities of every document."""
    docs = read(spark, sf_dir, "documents")
    return scored(docs, learn(docs, read(spark, sf_dir, "labels")))
