"""Decoding of class scores that come in chunks of any size: the best class of each frame, repetitions collapsed, blanks dropped.

Chunks are rows (series, ordinal, scores), scores a flat array of which every `classes` values are a frame; a chunk may end within a frame. The last frame of a
series is filled up with zeros when it is flushed. A class is given out at its first frame of a run; of equal scores the lower class is
taken; null and NaN scores are below all others; without any other score class 0 is taken. However scores are cut into chunks, the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from axonlake.operators.scan import RANGE, own, prefix, segmented

SYMBOL = "series string, frame long, class int"


class Decoder:
    """State of one series: the begun frame, the class of the last one, the number of frames so far."""

    def __init__(self, classes: int, blank: int = 0):
        self.classes, self.blank, self.rest, self.last, self.frames = classes, blank, np.zeros(0), -1, 0

    def snapshot(self) -> tuple[list[float], int, int]:
        return self.rest.tolist(), self.last, self.frames

    def restore(self, state: tuple[list[float], int, int]) -> Decoder:
        self.rest, self.last, self.frames = np.array(state[0], float), int(state[1]), int(state[2])
        return self

    def push(self, scores) -> list[tuple[int, int]]:
        """(frame, class) of what begins in the frames that are complete now."""
        have = np.concatenate([self.rest, np.array([np.nan if x is None else x for x in scores], float)])
        n = len(have) // self.classes
        self.rest = have[n * self.classes :]
        frames = have[: n * self.classes].reshape(n, self.classes)
        best = np.argmax(np.where(np.isnan(frames), -np.inf, frames), axis=1) if n else np.zeros(0, int)
        begins = np.flatnonzero((best != np.append(self.last, best[:-1])[:n]) & (best != self.blank))
        out = [(self.frames + int(i), int(best[i])) for i in begins]
        self.last, self.frames = (int(best[-1]) if n else self.last), self.frames + n
        return out

    def flush(self) -> list[tuple[int, int]]:
        """The begun frame, filled up with zeros."""
        return self.push([0.0] * (self.classes - len(self.rest))) if len(self.rest) else []


def decoded(chunks: DataFrame, classes: int, blank: int = 0) -> DataFrame:
    """(series, frame, class) of a table of chunks, flushed.

    A chunk's place is a running sum of sizes; scores meet by frame, and a frame looks at the one before: sums and looks go over ranges of a series, so
    one series with most of the chunks is many tasks.
    """
    sized = chunks.select("series", "ordinal", "scores", F.coalesce(F.size("scores"), F.lit(0)).cast("long").alias("n")).where("n > 0")
    placed = prefix(sized, ["series"], ["ordinal"], {"upto": ("sum", "n")})
    each = placed.select("series", (F.col("upto") - F.col("n")).alias("first"), F.posexplode("scores").alias("k", "score")).select("series", (F.col("first") + F.col("k")).alias("at"), F.coalesce(F.nanvl("score", F.lit(None)), F.lit(float("-inf"))).alias("score"))
    frame, place = F.expr(f"at div {classes}"), (F.col("at") % classes).cast("int")
    frames = each.groupBy("series", frame.alias("frame")).agg(F.max(F.struct("score", (-place).alias("class"))).alias("best"), F.count("*").alias("n"))
    # a missing score is a zero, at the first missing place
    filled = F.struct(F.lit(0.0).alias("score"), (-F.col("n")).cast("int").alias("class"))
    best = frames.select("series", "frame", F.when(F.col("n") < classes, F.greatest("best", filled)).otherwise(F.col("best")).alias("best")).select("series", "frame", F.when(F.col("best.score") == float("-inf"), 0).otherwise(-F.col("best.class")).alias("class"))
    before = F.lag("class").over(Window.partitionBy(RANGE, "series").orderBy("frame"))
    begun = own(segmented(best, ["series"], ["frame"], before=1).withColumn("__before", before))
    return begun.where((F.col("class") != blank) & (F.col("__before").isNull() | (F.col("__before") != F.col("class")))).select("series", "frame", "class")


class _Decoding(StatefulProcessor):
    def __init__(self, classes: int, blank: int):
        self.classes, self.blank = classes, blank

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("decoder", "rest array<double>, last int, frames long, ordinal long, done boolean")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        decoder, out, last, done = Decoder(self.classes, self.blank), [], None, False
        if self.state.exists():
            *state, last, done = self.state.get()
            decoder.restore(state)
        batch = pd.concat(list(rows)).sort_values("ordinal")
        for ordinal, scores, flush in zip(batch["ordinal"], batch["scores"], batch["flush"], strict=True):
            if done or last is not None and ordinal <= last:
                raise ValueError(f"chunk {ordinal} of {key[0]} comes after {'the flush' if done else last}")
            last = int(ordinal)
            out += decoder.push([] if scores is None else scores)
            if flush is not None and bool(flush):
                out, done = out + decoder.flush(), True
        self.state.update((*decoder.snapshot(), last, done))
        yield pd.DataFrame({"series": key[0], "frame": pd.Series([x[0] for x in out], dtype="int64"), "class": pd.Series([x[1] for x in out], dtype="int32")})


def decode_stream(chunks: DataFrame, classes: int, blank: int = 0) -> DataFrame:
    """The same of a stream of chunks (series, ordinal, scores, flush), in order of ordinal; a chunk that comes too late or after its series' flush is an error. State is kept by series in Spark's RocksDB store."""
    return chunks.groupBy("series").transformWithStateInPandas(_Decoding(classes, blank), outputStructType=SYMBOL, outputMode="append", timeMode="none")
