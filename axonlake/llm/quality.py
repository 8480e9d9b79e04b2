"""Quality classifier on hashed word n-grams (operator 7)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonlake.llm.common import held_out, read
from axonlake.llm.linear import Ftrl, featured, probability, sample
from axonlake.llm.words import STEP, mixed, texts

#: Hashed features, labelled documents to learn from at most, and folds of which one is held out.
SIZE, TRAIN_DOCS, FOLDS = 1 << 18, 8000, 3


def shape(word: str) -> str:
    """The word with runs of lower-case letters, capitals and digits as a, A and 0, and other runs as their first sign."""
    out = []
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


class WordShapes(dict):
    """Row of each word in `table`: the hashes of the word in lower case and of its shape. Forgets all beyond `limit` words."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit, self.table = limit, np.zeros((1024, 2), np.uint64)

    def __missing__(self, word: bytes) -> int:
        at = len(self)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        text = word.decode("utf-8", "replace")
        self.table[at] = xxhash.xxh3_64_intdigest(text.lower()), xxhash.xxh3_64_intdigest(shape(text))
        self[word] = at
        return at

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.table[rows]


def ngrams():
    """A function from a text to its features: word 1- and 2-grams, 1- to 3-grams of word shapes, and repeats of a word, each as a share of the words."""
    known = WordShapes()

    def of(text: bytes):
        words = text.split()
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        both = known.of(words)
        word, form = both[:, 0], both[:, 1]
        grams = [word, mixed(word[:-1] * STEP + word[1:]), form + np.uint64(1), mixed(form[:-1] * STEP + form[1:]), mixed((form[:-2] * STEP + form[1:-1]) * STEP + form[2:]), np.full(int((word[1:] == word[:-1]).sum()), 5, np.uint64)]
        at, times = np.unique((np.concatenate(grams) % np.uint64(SIZE)).astype(np.int64), return_counts=True)
        return at, np.sqrt(times / len(words)) * 3

    return of


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, rows: int = TRAIN_DOCS) -> Ftrl:
    """The classifier of `label`, learned from at most `rows` labelled documents that are not held out."""
    chosen = sample(labels, label, rows, ~held_out("doc_id", folds))
    found, y = featured(docs, chosen, ngrams, label)
    return Ftrl(SIZE, alpha=0.3, l1=0.5).fit(found, y)


def scored(docs: DataFrame, model: Ftrl, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every row of docs, from the text alone; one pass, no shuffle.

    Null and empty texts score as the bias says; without any labels every score is 0.5. Repeated rows score alike, long texts are taken
    whole, columns besides doc_id and text are left alone, whatever their names. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights().astype(np.float32), model.bias()))

    def run(batches):
        of, (weights, bias) = ngrams(), shared.value
        for b in batches:
            margin = [bias + float(weights[at] @ x) for at, x in map(of, texts(b))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(probability(np.array(margin, float)))], names=["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", held_out("doc_id", folds).alias("held_out"), "text")
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a model learned from the labels of two thirds."""
    docs = read(spark, sf_dir, "documents")
    return scored(docs, learn(docs, read(spark, sf_dir, "labels")))
