"""Which texts contain one another: an index of marks of character windows in place of comparing all with all."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonlake.sources.shared import stash

#: Texts of at least 2**TOP characters share one length class.
TOP = 6
#: Marks of needles up to which every task has them all.
FEW = 1_000_000
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)  # odd 64-bit constants
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def marks(text: str, length_class: int) -> np.ndarray:
    """Marks of a text for needles of 2**length_class characters or more: the least hash of each run of neighbouring windows.

    Every stretch of 2**length_class characters gives one mark from itself alone, so the marks of a needle of that length are among those of any
    text that contains it. Neighbouring runs mostly share their least window, so there are few marks a character.
    """
    span = 1 << length_class
    width = max(1, span // 2)
    run = span - width + 1
    signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(signs) < span:
        return np.zeros(0, np.uint64)
    # hash of each window from sums over the text, brought to the same power of the base
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((signs + np.uint64(1)) * _powers(_BASE, len(signs)))])
    n = len(signs) - width + 1
    window = (sums[width:] - sums[:n]) * _powers(_INVERSE, n)
    window = (window ^ (window >> np.uint64(29))) * _MIX
    window ^= window >> np.uint64(32)
    least, have = window, 1
    while have < run:  # least of `have` neighbours, then of twice as many
        step = min(have, run - have)
        least, have = np.minimum(least[: len(least) - step], least[step:]), have + step
    return np.unique(least)


def _marked(batches, wanted=None):
    """(id, class, mark) of texts: for the class of the text's own length, or for the given classes and, where they have some, of these sorted marks only."""
    classes = None if wanted is None else wanted.value
    for b in batches:
        ids, kinds, found = [], [], []
        for ident, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for c in [min(len(text).bit_length() - 1, TOP)] if classes is None else classes:
                own = marks(text, c)
                if classes is not None and classes[c] is not None:
                    at = np.searchsorted(classes[c], own)
                    own = own[classes[c][np.minimum(at, len(classes[c]) - 1)] == own]
                ids += [ident] * len(own)
                kinds.append(np.full(len(own), c, np.int32)), found.append(own.astype(np.int64))
        cat = lambda x, kind: pa.array(np.concatenate(x) if x else np.zeros(0, kind))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), cat(kinds, np.int32), cat(found, np.int64)], names=["id", "class", "mark"])


def contained(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle, id): each text of `texts` with each of `needles` that it contains; both are (id, text), ids unique, texts not empty.

    A needle is entered under one mark, that which the fewest texts have; a text meets the needles under its marks by an equi-join, and
    `contains` confirms. Needles of 1, 2 to 3, 4 to 7, ... and 64 or more characters are classes of their own, whose marks suit their length.
    """
    schema = "id string, class int, mark long"
    own = stash(needles.mapInArrow(_marked, schema), "needle-marks")
    wanted, classes = own.select("class", "mark").distinct(), {r["class"]: None for r in own.select("class").distinct().collect()}  # at most TOP + 1
    found = wanted.limit(FEW + 1).toArrow()
    if found.num_rows <= FEW:  # the others' marks need not leave the task that makes them
        kind, mark = found["class"].to_numpy(), found["mark"].to_numpy().view(np.uint64)
        classes = {c: np.sort(mark[kind == c]) for c in classes}
    shared = needles.sparkSession.sparkContext.broadcast(classes)
    there = texts.mapInArrow(functools.partial(_marked, wanted=shared), schema)
    there = stash(there if found.num_rows <= FEW else there.join(wanted, ["class", "mark"]), "text-marks")
    often = there.groupBy("class", "mark").agg(F.count("*").alias("n"))
    # a needle with a mark that no text has is in none
    rarest = own.join(often, ["class", "mark"], "left").groupBy("id", "class").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "mark")).alias("least"))
    entered = rarest.where("least.n > 0").select(F.col("id").alias("needle"), "class", F.col("least.mark").alias("mark"))
    pairs = entered.join(there, ["class", "mark"]).select("needle", "id")
    met = pairs.join(needles.select(F.col("id").alias("needle"), F.col("text").alias("__needle")), "needle").join(texts, "id")
    return met.where(F.col("text").contains(F.col("__needle"))).select("needle", "id")


def without_overlap(texts: DataFrame, held: DataFrame, column: str = "text") -> DataFrame:
    """texts whose trimmed text neither contains nor lies in a held-out text; empty and null texts stay, empty held-out texts say nothing. Equal texts are compared once."""

    def distinct(df: DataFrame, text: Column) -> DataFrame:
        own = df.select(text.alias("text")).where("text <> ''")
        return own.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("id")).agg(F.first("text").alias("text"))

    own = F.trim(F.col(column))
    mine, others = stash(distinct(texts, own), "texts"), stash(distinct(held, own), "held")
    longest = others.agg(F.coalesce(F.max(F.length("text")), F.lit(0))).first()[0]  # nothing longer lies in a held-out text
    out = contained(others, mine).select("id").union(contained(mine.where(F.length("text") <= longest), others).select(F.col("needle").alias("id"))).distinct()
    return texts.join(out.withColumnRenamed("id", "__id"), F.sha2(own.cast("binary"), 256) == F.col("__id"), "left_anti")
