"""Delayed feedback on actions: an append-only log of actions, a queue of feedback in the order it came, and updates that apply what has arrived.

Messages have (learner, ordinal, kind, action_id, experience, source, unit, step, available_at, target): learners see theirs in the order of ordinal, which is
unique. kind is

* `act`: action_id is logged with its experience and step, for good; a second action of that name is refused (`repeated_action`);
* `feedback`: about action_id, produced at step, to be used from available_at on. It is refused if the action has not been taken (`no_action`), belongs to
  another experience (`other_experience`), has another unit of time (`other_unit`), was produced before its action (`before_action`) or is said to be available before it
  was produced (`forged`), and if its source has already been counted for the action (`repeated`): reasons in this order. Else it waits (`queued`);
* `update` at time step: the feedback that is available is applied in the order in which it came and leaves the queue. A clock that goes back is refused (`clock_back`).

What comes out has (learner, ordinal, kind, feedback, verdict, consumed, gradient_steps, deferred): a row for each message, and for each feedback that an update applied a row `applied`
with its ordinal. Every update_every-th applied feedback whose action has a target makes a gradient step. With evaluate nothing is applied: an update
to which feedback has arrived is refused (`evaluate_mode`) and changes nothing.

`settled` takes a table, `settled_stream` a stream with one keyed state a learner; both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from axonlake.operators.scan import RANGE, own, prefix, segmented

RESULT = "learner long, ordinal long, kind string, feedback long, verdict string, consumed long, gradient_steps long, deferred long"
UNIT = "model_step"


def _next_update(rows: DataFrame, order: Column, last: Column, name: str) -> DataFrame:
    """rows (learner, ordinal, of, ...) with `name`, the ordinal of the first update at or after each feedback's place."""
    keyed = segmented(rows.withColumns({"__o": order, "__l": last}), ["learner"], ["__o", "__l", "ordinal"], after=1, keep=F.col("kind") == "update")
    # looks back from the end: a frame that grows is carried on row by row, one that shrinks would be read anew for each row
    ahead = Window.partitionBy(RANGE, "learner").orderBy(F.desc("__o"), F.desc("__l"), F.desc("ordinal")).rowsBetween(Window.unboundedPreceding, -1)
    return own(keyed.withColumn(name, F.last(F.when(F.col("kind") == "update", F.col("ordinal")), ignorenulls=True).over(ahead))).drop("__o", "__l")


def judged(messages: DataFrame, unit: str = UNIT) -> DataFrame:
    """messages with the verdict on each: actions and feedback as above, updates `updated` or `clock_back`."""
    messages = messages.withColumn("action_id", F.coalesce("action_id", F.lit("")))
    acts = messages.where("kind = 'act'")
    key = ["learner", "action_id"]
    first = acts.groupBy(*key).agg(F.min_by(F.struct("ordinal", "experience", "step"), "ordinal").alias("action"))
    rows = messages.join(first, key, "left")
    known = F.coalesce(F.col("action.ordinal") < F.col("ordinal"), F.lit(False))
    about = (
        F.when(~known, "no_action")
        .when(~F.col("action.experience").eqNullSafe(F.col("experience")), "other_experience")
        .when(~F.coalesce(F.col("unit") == unit, F.lit(False)), "other_unit")
        .when(~F.coalesce(F.col("step") >= F.col("action.step"), F.lit(False)), "before_action")
        .when(~F.coalesce(F.col("available_at") >= F.col("step"), F.lit(False)), "forged")
        .otherwise("queued")
    )
    rows = rows.withColumn("verdict", F.when(F.col("kind") == "act", F.when(F.col("action.ordinal") == F.col("ordinal"), "logged").otherwise("repeated_action")).when(F.col("kind") == "feedback", about)).drop("action")
    # the first that passes counts for its source
    passed = rows.where("verdict = 'queued'")
    counted = passed.groupBy(*key, F.coalesce("source", F.lit("")).alias("__source")).agg(F.min("ordinal").alias("__counted"))
    rows = rows.withColumn("__source", F.coalesce("source", F.lit(""))).join(counted, [*key, "__source"], "left").drop("__source")
    rows = rows.withColumn("verdict", F.when((F.col("verdict") == "queued") & (F.col("ordinal") > F.col("__counted")), "repeated").otherwise(F.col("verdict"))).drop("__counted")
    clock = prefix(rows.withColumn("__now", F.when(F.col("kind") == "update", F.col("step"))), ["learner"], ["ordinal"], {"__latest": ("max", "__now")})
    update = F.when(F.col("step") >= F.col("__latest"), "updated").otherwise("clock_back")
    return clock.withColumn("verdict", F.when(F.col("kind") == "update", update).otherwise(F.col("verdict"))).drop("__now", "__latest")


def settled(messages: DataFrame, update_every: int = 1, evaluate: bool = False, unit: str = UNIT) -> DataFrame:
    """What becomes of a table of messages, as described above.

    Feedback meets its update through two looks ahead, to the first update after it came and to the first whose time has come, of which the later
    applies it; queues and steps are running sums. All run over ranges of a learner's messages, so one learner with all messages is many tasks.
    """
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    columns = ["learner", "ordinal", "kind", "feedback", "verdict", "consumed", "gradient_steps", "deferred"]
    rows = judged(messages, unit)
    said = rows.where("kind <> 'update' or verdict = 'clock_back'").select("learner", "ordinal", "kind", none.alias("feedback"), "verdict", *(none.alias(c) for c in columns[5:]))
    live = rows.where("verdict in ('queued', 'updated')").select("learner", "ordinal", "kind", "step", "available_at", F.coalesce("target", F.lit(False)).alias("target"))
    queued = F.col("kind") == "feedback"
    if evaluate:
        marked = live.withColumns({"__due": F.when(queued, F.col("available_at")), "__one": F.when(queued, 1).otherwise(0).cast("long")})
        run = prefix(marked, ["learner"], ["ordinal"], {"__earliest": ("min", "__due"), "__waiting": ("sum", "__one")}).where("kind = 'update'")
        due = F.coalesce(F.col("__earliest") <= F.col("step"), F.lit(False))
        updates = run.select("learner", "ordinal", "kind", none.alias("feedback"), F.when(due, "evaluate_mode").otherwise("updated").alias("verdict"), *(F.when(~due, zero).alias(c) for c in ("consumed", "gradient_steps")), F.when(~due, F.col("__waiting")).alias("deferred"))
        return said.select(columns).unionByName(updates.select(columns))
    received = _next_update(live, F.col("ordinal"), zero, "__received")
    timed = _next_update(received, F.when(queued, F.col("available_at")).otherwise(F.col("step")), F.when(queued, 0).otherwise(1), "__due")
    at = F.when(F.col("__received").isNotNull() & F.col("__due").isNotNull(), F.greatest("__received", "__due"))
    met = timed.where(queued).select("learner", "ordinal", "target", at.alias("update"))
    applied = met.where("update is not null")
    each = applied.groupBy("learner", F.col("update").alias("ordinal")).agg(F.count("*").alias("consumed"), F.count_if("target").alias("eligible"))
    flow = live.join(each, ["learner", "ordinal"], "left").withColumns({"consumed": F.coalesce("consumed", zero), "eligible": F.coalesce("eligible", zero)})
    flow = flow.withColumn("__change", F.when(queued, F.lit(1).cast("long")).otherwise(-F.col("consumed")))
    run = prefix(flow, ["learner"], ["ordinal"], {"deferred": ("sum", "__change"), "__eligible": ("sum", "eligible")}).where("kind = 'update'")
    steps = F.floor(F.col("__eligible") / update_every) - F.floor((F.col("__eligible") - F.col("eligible")) / update_every)
    updates = run.select("learner", "ordinal", "kind", none.alias("feedback"), F.lit("updated").alias("verdict"), "consumed", steps.cast("long").alias("gradient_steps"), "deferred")
    used = applied.select("learner", F.col("update").alias("ordinal"), F.lit("applied").alias("kind"), F.col("ordinal").alias("feedback"), F.lit("applied").alias("verdict"), *(none.alias(c) for c in columns[5:]))
    return said.select(columns).unionByName(updates.select(columns)).unionByName(used.select(columns))


class FeedbackLoop(StatefulProcessor):
    """State of one learner: its log (action -> ordinal, experience, step), the sources counted, the queue in the order of coming, and its clock."""

    def __init__(self, update_every: int = 1, evaluate: bool = False, unit: str = UNIT):
        self.update_every, self.evaluate, self.unit = update_every, evaluate, unit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getMapState("log", "action_id string", "experience string, step long")
        self.counted = handle.getMapState("counted", "action_id string, source string", "once boolean")
        self.queue = handle.getListState("queue", "ordinal long, available_at long, target boolean")
        self.clock = handle.getValueState("clock", "now long, eligible long, last long")

    def close(self) -> None:
        pass

    def _act(self, m) -> str:
        key = (m.action_id or "",)
        if self.log.containsKey(key):
            return "repeated_action"
        self.log.updateValue(key, (m.experience, int(m.step)))
        return "logged"

    def _receive(self, m) -> str:
        action = self.log.getValue((m.action_id or "",))
        if action is None:
            return "no_action"
        if action[0] != m.experience:
            return "other_experience"
        if m.unit != self.unit:
            return "other_unit"
        if m.step is None or m.step < action[1]:
            return "before_action"
        if m.available_at is None or m.available_at < m.step:
            return "forged"
        key = (m.action_id or "", m.source or "")
        if self.counted.containsKey(key):
            return "repeated"
        self.counted.updateValue(key, (True,))
        self.queue.appendValue((int(m.ordinal), int(m.available_at), bool(m.target)))
        return "queued"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        learner, out = key[0], []
        batch = pd.concat(list(rows)).sort_values("ordinal").astype(object)
        now, eligible, last = self.clock.get() if self.clock.exists() else (None, 0, None)
        for m in batch.where(batch.notna(), None).itertuples():
            if last is not None and m.ordinal <= last:
                raise ValueError(f"message {m.ordinal} of learner {learner} comes after {last}")
            last = int(m.ordinal)
            if m.kind != "update":
                out.append((m.ordinal, m.kind, None, self._act(m) if m.kind == "act" else self._receive(m), None, None, None))
                continue
            if now is not None and m.step < now:
                out.append((m.ordinal, m.kind, None, "clock_back", None, None, None))
                continue
            now, waiting = int(m.step), list(self.queue.get())
            ready = [x for x in waiting if x[1] <= now]
            if self.evaluate and ready:
                out.append((m.ordinal, m.kind, None, "evaluate_mode", None, None, None))
                continue
            if len(ready) == len(waiting):
                self.queue.clear()
            elif ready:
                self.queue.put([tuple(x) for x in waiting if x[1] > now])
            before, eligible = eligible, eligible + sum(bool(x[2]) for x in ready)
            out += [(m.ordinal, "applied", x[0], "applied", None, None, None) for x in ready]
            out.append((m.ordinal, m.kind, None, "updated", len(ready), eligible // self.update_every - before // self.update_every, len(waiting) - len(ready)))
        self.clock.update((now, eligible, last))
        frame = pd.DataFrame(out, columns=["ordinal", "kind", "feedback", "verdict", "consumed", "gradient_steps", "deferred"])
        numbers = ["ordinal", "feedback", "consumed", "gradient_steps", "deferred"]
        frame[numbers] = frame[numbers].astype("Int64")
        frame.insert(0, "learner", learner)
        yield frame


def settled_stream(messages: DataFrame, update_every: int = 1, evaluate: bool = False, unit: str = UNIT) -> DataFrame:
    """The same of a stream. A learner's messages come in order: one that is not after those of earlier micro-batches is an error.

    State lives in Spark's RocksDB store (spark.sql.streaming.stateStore.providerClass), where a log grows without being read whole.
    """
    return messages.groupBy("learner").transformWithStateInPandas(FeedbackLoop(update_every, evaluate, unit), outputStructType=RESULT, outputMode="append", timeMode="none")
