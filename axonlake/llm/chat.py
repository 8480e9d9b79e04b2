"""Chat formatting with minimum-cost role repair (operator 10)."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axonlake.llm.common import read, small, stash

ROLES = ["system", "user", "assistant"]
#: The automaton: state 0 is the start, the others the last role. A conversation may open with system, then user and assistant alternate; it ends with assistant.
NEXT, END = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}, 3
STATES, FAR = 4, 1 << 40
#: Costs of taking two turns as one, of giving a role to a turn that has none of the three, of putting in an empty turn, and of
#: giving a turn another role. The last is dearer than a merge and an empty answer: no one's words become another's if there is another way.
MERGE, NAME, INSERT, RELABEL = 1, 2, 3, 5
#: A conversation of more turns comes as chunks; a chunk ends after so many turns or characters.
CHUNK_TURNS, CHUNK_CHARS = 256, 1_000_000
#: Chunks of a conversation that a task sums up at a time.
FAN = 256


def _between(p: int, q: int) -> list[int] | None:
    """The shortest run of turns that must stand between state p and a turn of role q; None: no such run."""
    todo, seen = [(p, [])], {p}
    while todo:
        state, path = todo.pop(0)
        if q in NEXT[state]:
            return path
        for r in NEXT[state]:
            if r not in seen:
                seen.add(r)
                todo.append((r, [*path, r]))
    return None


FILL = {(p, q): _between(p, q) for p in range(STATES) for q in range(1, STATES)}
#: Turns that are put in after the last one.
CLOSE = {p: [] if p in (0, END) else [*FILL[p, END], END] for p in range(STATES)}


def moves(role: str | None) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, what is done) for one turn, in the order in which they are tried."""
    own, out = ROLES.index(role) + 1 if role in ROLES else 0, []
    other = RELABEL if own else NAME
    for p in range(STATES):
        for q in range(1, STATES):
            if FILL[p, q] is not None:
                out.append((p, q, INSERT * len(FILL[p, q]) + other * (own != q), "keep" if own == q else "relabel"))
        if p:
            out.append((p, p, MERGE + other * (own != p), "merge"))
    return sorted(out, key=lambda m: (m[2], m[3], m[:2]))


MOVES = {r: moves(r) for r in [*ROLES, None]}


def matrix(roles: list[str | None]) -> np.ndarray:
    """Least costs from each state to each over the turns."""
    best = np.where(np.eye(STATES, dtype=bool), 0, FAR)
    for role in roles:
        new = np.full((STATES, STATES), FAR)
        for p, q, cost, _ in MOVES[role if role in ROLES else None]:
            new[:, q] = np.minimum(new[:, q], best[:, p] + cost)
        best = np.minimum(new, FAR)
    return best


#: Least cost from each state to a legal end after the last turn.
AT_END = [INSERT * len(CLOSE[p]) for p in range(STATES)]


def repair(roles: list[str | None], entry: int = 0, end: list[int] = AT_END) -> tuple[int, list[tuple[int, int, str]]]:
    """(cost of these turns, (state before, state after, what is done) for each turn) of the cheapest way from `entry` on.

    `end` has the least cost of all that follows, from each state. The costs to go are found backwards, then each turn takes
    the first move in their order that leads to the least total. So the choice depends on the conversation alone, not
    on where it is cut.
    """
    togo = [list(end)]
    for role in reversed(roles):
        new = [FAR] * STATES
        for p, q, c, _ in MOVES[role if role in ROLES else None]:
            new[p] = min(new[p], c + togo[-1][q])
        togo.append(new)
    at, total, steps = entry, 0, []
    for role, here, rest in zip(roles, togo[:0:-1], togo[-2::-1], strict=True):
        p, q, c, done = next(m for m in MOVES[role if role in ROLES else None] if m[0] == at and m[2] + rest[m[1]] == here[at])
        steps.append((p, q, done))
        at, total = q, total + c
    return total, steps


def rendered(steps: list, texts: list[str | None], last: bool) -> tuple[str, dict]:
    """The text of the repaired turns and what was done. A turn opens by closing the one before, so chunks can be joined."""
    out, n = [], {"turns": 0, "merged": 0, "relabelled": 0, "inserted": 0}

    def open_turn(before: int, role: int):
        out.append(("<|end|>\n" if before else "") + f"<|{ROLES[role - 1]}|>\n")
        n["turns"] += 1

    for (p, q, done), text in zip(steps, texts, strict=True):
        text = (text or "").replace("<|", "< |")  # a text can't hold markers
        if done == "merge":
            n["merged"] += 1
            out.append("\n" + text)
            continue
        for r in FILL[p, q]:
            open_turn(p, r)
            n["inserted"] += 1
            p = r
        open_turn(p, q)
        n["relabelled"] += done == "relabel"
        out.append(text)
    if last:
        p = steps[-1][1]
        for r in CLOSE[p]:
            open_turn(p, r)
            n["inserted"] += 1
            p = r
        out.append("<|end|>\n")
    return "".join(out), n


def _chunks(batches, most: int):
    """Sorted turns as chunks of one block of a conversation each, with the least costs over them."""
    part, seq, key, roles, texts, size, rows = TaskContext.get().partitionId(), 0, None, [], [], 0, []

    def flush():
        nonlocal seq, roles, texts, size
        if roles:
            rows.append((key[0], part, seq, roles, texts, matrix(roles).reshape(-1).tolist()))
            seq, roles, texts, size = seq + 1, [], [], 0

    for b in batches:
        kind = b.schema.field(0).type
        for c, block, r, t in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if (c, block) != key or len(roles) >= most or size >= CHUNK_CHARS:
                flush()
                key = c, block
            roles.append(r)
            texts.append(t)
            size += len(t or "")
        yield _table(rows, kind)
        rows = []
    flush()
    if rows:
        yield _table(rows, kind)


def _table(rows: list, kind) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["conv_id", "part", "seq", "roles", "texts", "costs"])


def _after(costs, end):
    """Least cost from each state over a chunk and all that follows."""
    return np.minimum((np.reshape(costs, (STATES, STATES)) + np.reshape(end, (1, STATES))).min(axis=1), FAR)


def _both(first, second):
    """Least costs over two chunks."""
    a, b = (np.reshape(x, (STATES, STATES)) for x in (first, second))
    return np.minimum((a[:, :, None] + b[None]).min(axis=1), FAR).reshape(-1)


def scanned(items: DataFrame, start: list[int], step, product, backwards: bool) -> DataFrame:
    """(home, k, state) for each item (home, k, item): what `step` makes of `start` over all items of the home before it (backwards: behind it).

    k counts from 0 in each home. Items are summed up by `product` in runs of FAN, the sums likewise, until one is left; then
    each run gets its state from the run above. So a task has FAN rows of a home at a time, however many it has.
    """
    rank = lambda df: df.withColumn("up", F.floor(F.col("k") / FAN))

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        own = group.sort_values("k")["item"].tolist()
        return pd.DataFrame({"home": group["home"].iloc[:1], "k": group["up"].iloc[:1], "item": [np.asarray(functools.reduce(product, own))]})

    def spread(group: pd.DataFrame) -> pd.DataFrame:
        group, state, out = group.sort_values("k", ascending=not backwards), group["above"].iloc[0], []
        for item in group["item"]:
            out.append(np.asarray(state))
            state = step(item, state)
        return pd.DataFrame({"home": group["home"], "k": group["k"], "state": out})

    levels, last = [items], items.agg(F.max("k")).first()[0] or 0
    while last > 0:
        levels.append(stash(rank(levels[-1]).groupBy("home", "up").applyInPandas(fold, "home long, k long, item array<bigint>"), "chat-level"))
        last //= FAN
    states = levels[-1].select("home", "k", F.lit(start).cast("array<bigint>").alias("state"))
    for level in levels[-2::-1]:
        above = states.select("home", F.col("k").alias("up"), F.col("state").alias("above"))
        states = stash(rank(level).join(above, ["home", "up"]).groupBy("home", "up").applyInPandas(spread, "home long, k long, state array<bigint>"), "chat-states")
    return states


def _exits(batches):
    """Where a chunk is left, for each state in which it may be entered."""
    for b in batches:
        out = []
        for roles, end in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            legal = [repair(roles, p, end)[1][-1][1] if min(c + r for c, r in zip(row, end, strict=True)) < FAR else 0 for p, row in enumerate(matrix(roles).tolist())]
            out.append(legal)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int64()))], names=["home", "k", "item"])


def _rendered(batches):
    for b in batches:
        out = []
        for roles, texts, entry, end in zip(*(b.column(k).to_pylist() for k in range(2, 6)), strict=True):
            cost, steps = repair(roles, entry, end or AT_END)
            last = end is None
            text, n = rendered(steps, texts, last)
            cost += AT_END[steps[-1][1]] if last else 0
            out.append((len(roles), n["turns"], cost, n["merged"], n["relabelled"], n["inserted"], text))
        kinds = [pa.int64()] * 6 + [pa.string()]
        names = ["n_turns", "n_out", "cost", "merged", "relabelled", "inserted", "rendered"]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(6), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], names=["conv_id", "chunk", "chunks", *names])


def format_chats(turns: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """One row per conversation: conv_id, chunk, chunks, n_turns, n_out, cost, merged, relabelled, inserted, rendered.

    Turns are ordered by turn (null first), role, text. Dynamic programming over the automaton finds the cheapest legal sequence; of
    several, the one whose first different move comes first in a fixed order. A conversation of at most `chunk_turns` turns
    (and CHUNK_CHARS characters) is one row; a longer one comes as `chunks` rows, numbered by `chunk` from 0, which
    joined in their order give its text, the same whatever the size of the chunks. Blocks of turn numbers are range-partitioned and
    sorted; a block with many turns is cut further. Each chunk is summed up as a matrix of least costs, a scan over the
    matrices tells each chunk what follows, a second scan the state in which it is entered. So no task holds a whole
    conversation, however long it is.
    An unknown or null role must get another; a null text is empty; repeated turns are turns; a null conv_id is a
    conversation. Markers within a text are broken. Columns besides conv_id, turn, role and text are left alone. An empty table gives no rows.
    """
    turns = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").withColumn("tie", F.monotonically_increasing_id())
    # only a long conversation is cut: its span of turn numbers into as many equal parts as its turns make chunks, wherever the numbers begin and however sparse they are
    number = F.col("turn").cast("decimal(38,0)")
    spans = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.min(number).alias("low"), F.max(number).alias("high")).where(F.col("n") > chunk_turns)
    width = F.ceil((F.col("high") - F.col("low") + 1) / F.ceil(F.col("n") / chunk_turns))
    long = small(stash(spans.select(F.col("conv_id").alias("long_conv"), "low", width.alias("width")), "long"))
    turns = turns.join(long, F.col("conv_id").eqNullSafe(F.col("long_conv")) & F.col("width").isNotNull(), "left")
    turns = turns.withColumn("block", F.coalesce(F.expr("(CAST(turn AS DECIMAL(38,0)) - low) div width"), F.lit(0)))
    crowded = turns.groupBy("conv_id", "block").agg(F.count("*").alias("n")).where(F.col("n") > 4 * chunk_turns)
    crowded = small(stash(crowded.select(F.col("conv_id").alias("c"), F.col("block").alias("b")), "crowded"))
    turns = turns.join(crowded, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")), "left")
    # only where a block is crowded may its turns be dealt to several partitions
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "block")]
    inner = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text", "tie")]
    open_to = [F.when(F.col("b").isNotNull(), F.col(c)).asc_nulls_first() for c in ("turn", "role", "text", "tie")]
    dealt = turns.repartitionByRange(*keys, *open_to).sortWithinPartitions(*keys, *inner).select("conv_id", "block", "role", "text")
    kind = dict(dealt.dtypes)["conv_id"]
    chunks = stash(dealt.mapInArrow(functools.partial(_chunks, most=chunk_turns), f"conv_id {kind}, part long, seq long, roles array<string>, texts array<string>, costs array<bigint>"), "chunks")
    # chunks are numbered over all partitions: one row for each partition
    totals = chunks.groupBy("part").agg(F.count("*").alias("n"))
    offsets = totals.select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    placed = chunks.join(F.broadcast(offsets), F.col("part") == F.col("of")).withColumn("g", F.col("first") + F.col("seq"))
    several = placed.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("g").alias("home")).where("n > 1").select(F.col("conv_id").alias("many"), "home")
    several = small(stash(several, "several"))
    slim = placed.join(several, F.col("conv_id").eqNullSafe(F.col("many"))).select("home", (F.col("g") - F.col("home")).alias("k"), "roles", F.col("costs").alias("item"))
    slim = stash(slim, "chat-slim")
    ends = scanned(slim.select("home", "k", "item"), AT_END, _after, _both, backwards=True)
    exits = stash(slim.join(ends, ["home", "k"]).select("home", "k", "roles", "state").mapInArrow(_exits, "home long, k long, item array<bigint>"), "chat-exits")
    entries = scanned(exits, [0], lambda item, state: [item[state[0]]], lambda a, b: [b[p] for p in a], backwards=False)
    lengths = slim.groupBy("home").agg(F.max("k").alias("last"))
    ways = ends.join(entries.select("home", "k", F.get("state", F.lit(0)).alias("entry")), ["home", "k"]).join(lengths, "home")
    ways = ways.select((F.col("home") + F.col("k")).alias("way"), F.col("k").cast("int").alias("chunk"), F.col("entry").cast("int").alias("entry"), F.when(F.col("k") < F.col("last"), F.col("state")).alias("end"), (F.col("last") + 1).cast("int").alias("chunks"))
    whole = placed.join(small(stash(ways, "ways")), F.col("g") == F.col("way"), "left")
    ready = whole.select("conv_id", F.coalesce("chunk", F.lit(0)).alias("chunk"), "roles", "texts", F.coalesce("entry", F.lit(0)).alias("entry"), "end", F.coalesce("chunks", F.lit(1)).alias("chunks"))
    return ready.mapInArrow(_rendered, f"conv_id {kind}, chunk int, chunks int, n_turns long, n_out long, cost long, merged long, relabelled long, inserted long, rendered string")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, repaired and rendered."""
    return format_chats(read(spark, sf_dir, "conversations"))
