"""Streaming alignment with an explicit, exclusive watermark that travels in the data.

A stream has rows (series, kind, tick, sequence, duration, value). kind is `sample`, `mark` (all samples before its tick have come) or
`finish`. Unlike Spark's watermark, which drops what is late, a sample before the mark is an error, as is a mark
that goes back, any row after a finish, and more steps at once than `output`; with `strict`, for sources whose micro-batches are single pushes, so is a sample
beyond the mark that comes with it (else it waits, since where a micro-batch ends is Spark's choice); the micro-batch then fails as a whole and state stays as it was. The sum of all batches equals
the batch operators of operators.temporal on the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MODES = ("hold", "interval", "pulse")


class Aligner:
    """State of one series. Step k lies at tick k * ticks; `ticks` source ticks make one step."""

    def __init__(self, mode: str, ticks: int, first: int = 0, last: int | None = None, capacity: int = 100_000, output: int = 1_000_000, strict: bool = False):
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if last is not None and last - first >= output:
            raise ValueError(f"steps {first} to {last} are more than {output}")
        self.output, self.strict = output, strict
        self.mode, self.ticks, self.last, self.capacity = mode, ticks, last, capacity
        self.next, self.mark, self.pending, self.held, self.done = first, None, [], None, False

    def load(self, text: str) -> Aligner:
        self.next, self.mark, self.pending, self.held, self.done = json.loads(text)
        self.pending = [tuple(x) for x in self.pending]
        return self

    def dump(self) -> str:
        return json.dumps([self.next, self.mark, self.pending, self.held, self.done])

    def push(self, rows: list[tuple]) -> list[tuple[int, int, float]]:
        """rows (kind, tick, sequence, duration, value) of one micro-batch, samples before marks of the same batch; returns (step, tick of the sample, value)."""
        if self.done and rows:
            raise ValueError("rows after the finish")
        for kind, tick, sequence, duration, value in sorted(rows, key=lambda r: (r[0] != "sample", r[1])):
            if kind == "sample":
                if self.mark is not None and tick < self.mark:
                    raise ValueError(f"sample at {tick} is late: the mark is {self.mark}")
                self.pending.append((tick, sequence, duration, value))
            elif kind == "mark" and self.mark is not None and tick < self.mark:
                raise ValueError(f"the mark goes back from {self.mark} to {tick}")
        if len(self.pending) > self.capacity:
            raise ValueError(f"more than {self.capacity} samples wait for the mark")
        marks = [r[1] for r in rows if r[0] == "mark"]
        if self.strict and marks and not any(r[0] == "finish" for r in rows) and any(r[0] == "sample" and r[1] > max(marks) for r in rows):
            raise ValueError(f"a sample lies beyond the mark {max(marks)} that comes with it")
        out: list[tuple[int, int, float]] = []
        if marks:
            self.mark = max(marks)
            out += self._until(self.mark)
        if any(r[0] == "finish" for r in rows):
            out += self._until(None)
            self.done = True
        return out

    def _until(self, mark: int | None) -> list[tuple[int, int, float]]:
        """Everything at positions before the mark; None: to the end."""
        self.pending.sort(key=lambda s: (s[0], s[1]))
        if self.mode == "pulse":
            due = [mark is None or -(-s[0] // self.ticks) * self.ticks < mark for s in self.pending]
            ready = [s for s, d in zip(self.pending, due, strict=True) if d]
            self.pending = [s for s, d in zip(self.pending, due, strict=True) if not d]
            return [(-(-s[0] // self.ticks), s[0], s[3]) for s in ready]
        out, live = [], list(self.held or []) if self.mode == "interval" else self.held
        end = self.last if mark is None else -(-mark // self.ticks) - 1  # the last step before the mark
        if mark is None and end is None:
            ends = [s[0] + (s[2] or 0) for s in [*self.pending, *((live or []) if self.mode == "interval" else [])]]
            end = max((e // self.ticks for e in ends), default=self.next - 1)
        if self.last is not None:
            end = min(end, self.last)
        if end - self.next >= self.output:
            raise ValueError(f"steps {self.next} to {end} are more than {self.output}")
        at = 0
        while self.next <= end:
            position = self.next * self.ticks
            while at < len(self.pending) and self.pending[at][0] <= position:
                live = [*live, self.pending[at]] if self.mode == "interval" else self.pending[at]
                at += 1
            if self.mode == "interval":
                live = [s for s in live if s[0] + s[2] > position]
                if live:
                    best = max(live, key=lambda s: (s[0], s[1]))
                    out.append((self.next, best[0], best[3]))
            elif live:
                out.append((self.next, live[0], live[3]))
            self.next += 1
        self.pending, self.held = self.pending[at:], live
        return out


def align_stream(rows: DataFrame, mode: str, ticks: int, first: int = 0, last: int | None = None, capacity: int = 100_000, output: int = 1_000_000, strict: bool = False) -> DataFrame:
    """(series, step, tick, value) of a stream of rows as described above, for any number of series; state is kept by series."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = Aligner(mode, ticks, first, last, capacity, output, strict)
        if state.exists:
            own.load(state.get[0])
        found: list[tuple] = []
        for p in parts:
            found += list(zip(p["kind"], p["tick"].astype("int64").tolist(), p["sequence"].fillna(0).astype("int64").tolist(), p["duration"].fillna(0).astype("int64").tolist(), p["value"].tolist(), strict=True))
        out = own.push(found)
        state.update((own.dump(),))
        yield pd.DataFrame({"series": key[0], "step": pd.Series([o[0] for o in out], dtype="int64"), "tick": pd.Series([o[1] for o in out], dtype="int64"), "value": pd.Series([o[2] for o in out], dtype="float64")})

    return rows.groupBy("series").applyInPandasWithState(run, "series string, step long, tick long, value double", "state string", "append", GroupStateTimeout.NoTimeout)


class Utf8Stream:
    """Incremental decoding: gives out complete characters only; flush() reports what is left over."""

    def __init__(self, rest: bytes = b""):
        self.rest = rest

    def push(self, data: bytes) -> str:
        data, self.rest = self.rest + data, b""
        for cut in range(min(4, len(data) + 1)):
            try:
                text = data[: len(data) - cut].decode()
                self.rest = data[len(data) - cut :]
                return text
            except UnicodeDecodeError as e:
                if e.end != len(data) - cut or e.reason != "unexpected end of data":
                    raise
        self.rest = data
        return ""

    def flush(self) -> bytes:
        rest, self.rest = self.rest, b""
        return rest


def feedback_queue(feedback: DataFrame, clock: DataFrame) -> DataFrame:
    """Feedback that has arrived by each series' clock, with `applied` (else deferred): a stream-static join on the clock (series, now)."""
    from pyspark.sql import functions as F

    return feedback.join(clock, "series").withColumn("applied", F.col("available_at") <= F.col("now"))
