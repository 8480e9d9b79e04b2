"""Edit counts by substitution, deletion and insertion."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edits(reference: list, hypothesis: list) -> tuple[int, int, int]:
    """(substitutions, deletions, insertions) of a cheapest alignment; of equal costs substitution comes before deletion before insertion.

    Row by row each place carries its cost and the substitutions and insertions on its way, so memory is a few rows. Within a row, places reached
    by insertions take over from the nearest place to the left that is not.
    """
    n, m = len(reference), len(hypothesis)
    codes = {x: i for i, x in enumerate({*reference, *hypothesis})}
    hyp, at = np.array([codes[x] for x in hypothesis], np.int64), np.arange(m + 1)
    cost, subs, ins = at.copy(), np.zeros(m + 1, np.int64), at.copy()
    for i, x in enumerate(reference, 1):
        differs = hyp != codes[x]
        over, down = cost[:-1] + differs, cost[1:] + 1
        row = np.concatenate([[i], np.minimum(over, down)]) - at  # an insertion costs one more than its left neighbour
        row = np.minimum.accumulate(row) + at
        straight, below = row[1:] == over, row[1:] == down
        source = np.maximum.accumulate(np.append(0, np.where(straight | below, at[1:], 0)))
        own_subs = np.append(0, np.where(straight, subs[:-1] + differs, subs[1:]))
        own_ins = np.append(0, np.where(straight, ins[:-1], ins[1:]))
        cost, subs, ins = row, own_subs[source], own_ins[source] + at - source
    return int(subs[m]), int(n - m + ins[m]), int(ins[m])


def edit_counts(pairs: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis", words: bool = False) -> DataFrame:
    """pairs with substitutions, deletions, insertions, ref_length, rate and defined, over code points or white-space words; an empty reference leaves the rate undefined. Null texts are empty."""

    @F.pandas_udf("s long, d long, i long, n long")
    def count(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        cut = (lambda x: (x or "").split()) if words else (lambda x: list(x or ""))
        rows = [(*edits(cut(x), cut(y)), len(cut(x))) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame(rows, columns=["s", "d", "i", "n"])

    out = pairs.withColumn("__e", count(reference, hypothesis))
    total = F.col("__e.s") + F.col("__e.d") + F.col("__e.i")
    return out.withColumns({"substitutions": F.col("__e.s"), "deletions": F.col("__e.d"), "insertions": F.col("__e.i"), "ref_length": F.col("__e.n"), "rate": F.when(F.col("__e.n") > 0, total / F.col("__e.n")), "defined": F.col("__e.n") > 0}).drop("__e")


def corpus_rate(counted: DataFrame, by: list[str]) -> DataFrame:
    """Micro-averaged rate: all edits over all reference lengths, and the share of exact matches."""
    total = F.sum(F.col("substitutions") + F.col("deletions") + F.col("insertions"))
    n = F.sum("ref_length")
    return counted.groupBy(*by).agg(total.alias("edits"), n.alias("ref_length"), F.when(n > 0, total / n).alias("rate"), F.avg((F.col("substitutions") + F.col("deletions") + F.col("insertions") == 0).cast("int")).alias("exact"))
