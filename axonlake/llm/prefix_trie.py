"""The trie of all conversations' prefixes, cut at half depth again and again (operator 12)."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axonlake.llm.common import read, small, stash

#: Shared first turns come from the conversation whose id is the next lower multiple of BLOCK; at most HEAD - 1 of them.
BLOCK, HEAD = 100, 6
#: Ids that are put together before they go to the task which hashes a node's list.
RUN = 4096
NODE = ["depth", "name"]


def turns(conversations: DataFrame) -> DataFrame:
    """conv, turn, token (a digest of role and text), chars (code points of the text) and tie, which orders equal turns: role and text where there are such."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    token = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    twice = rows.groupBy("conv", "turn").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv").alias("__conv"), F.col("turn").alias("__turn"))
    met = rows.join(small(twice), F.col("conv").eqNullSafe(F.col("__conv")) & F.col("turn").eqNullSafe(F.col("__turn")), "left")
    return met.select("conv", "turn", token.alias("token"), F.char_length("text").alias("chars"), F.when(F.col("__conv").isNotNull(), F.struct("role", "text")).alias("tie"))


def _numbered(batches):
    """Adds to sorted rows the number of each in its conversation, as far as the partition knows."""
    last, seen = None, 0
    for b in batches:
        conv = b.column(0).to_numpy()
        at = np.arange(len(conv))
        starts = np.append(True, conv[1:] != conv[:-1])[: len(conv)]
        local = at - np.maximum.accumulate(np.where(starts, at, 0))
        if len(conv) and conv[0] == last:
            local[: np.flatnonzero(conv != last)[0] if (conv != last).any() else len(conv)] += seen
        if len(conv):
            last, seen = conv[-1], int(local[-1]) + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local)], names=[*b.schema.names, "local"])


def numbered(rows: DataFrame) -> DataFrame:
    """conv, pos (from 0), token and chars of `turns`, in the order of turn (null first), then role and text.

    Rows are sorted in ranges of (conv, turn, tie), so a long conversation is many tasks; a range counts on from those before it, of
    which it needs one number.
    """
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "tie", "token")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "token", "chars")
    schema = T.StructType([*dealt.schema.fields, T.StructField("local", T.LongType())])
    kept = stash(dealt.mapInArrow(_numbered, schema).withColumn("part", F.spark_partition_id()), "turns")
    edges = kept.groupBy("part").agg(F.min("conv").alias("first"), F.max("conv").alias("last"), F.max_by("local", F.struct("conv", "local")).alias("local")).orderBy("part").collect()  # one row a range
    carried, before = [], {}
    for r in edges:
        from_before = before.get(r["first"], 0)
        carried.append((r["part"], r["first"], from_before))
        before = {r["last"]: r["local"] + 1 + (from_before if r["first"] == r["last"] else 0)}
    carry = rows.sparkSession.createDataFrame([c for c in carried if c[2]], "part int, conv long, carry long")
    return kept.join(F.broadcast(carry), ["part", "conv"], "left").select("conv", (F.col("local") + F.coalesce("carry", F.lit(0))).alias("pos"), "token", "chars")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, pos, token, chars) of all rebuilt conversations, and (conv) of all of them.

    A conversation begins with the first h turns of conversation conv - conv % 100, h = crc32(conv in decimal) % 6, as far as there are such; its
    own turns after its first h follow.
    """
    rows = numbered(turns(conversations))
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % HEAD
    lengths = rows.groupBy("conv").agg(F.count("*").alias("n"))
    wanted = lengths.select("conv", head.alias("h"), (F.col("conv") - F.col("conv") % BLOCK).alias("donor"))
    convs = stash(wanted.join(lengths.select(F.col("conv").alias("donor"), "n"), "donor", "left").select("conv", "donor", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("given")), "convs")
    own = rows.join(small(convs), "conv").where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "token", "chars")
    firsts = rows.where((F.col("conv") % BLOCK == 0) & (F.col("pos") < HEAD - 1)).withColumnRenamed("conv", "donor")
    lent = convs.join(firsts, "donor").where("pos < h").select("conv", "pos", "token", "chars")
    return own.unionByName(lent), convs.select("conv")


def named(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, int]:
    """(conv, depth, name, chars, ends) for each prefix of each conversation, and the number of halvings.

    name stands for the first `depth` turns, chars is the length of the last of them, ends says that there are no more. Depths 0 to
    2**levels - 1 are cut at half, the halves at half and so on. Upwards, each block of turns gets a digest of its two halves. Downwards, the name
    of a cut prefix is the root under which the lower half's trees hang: the upper half keeps its root, the lower half's is the digest of the root and
    the upper half. A level has half the rows of the one below, and keys are single blocks, so a long conversation is many keys.
    """
    none = F.lit(None)
    at = rows.select("conv", F.col("pos").alias("k"), "token", none.cast("int").alias("chars"))
    after = rows.select("conv", (F.col("pos") + 1).alias("k"), none.cast("string").alias("token"), "chars")
    root = convs.select("conv", F.lit(0).cast("long").alias("k"), none.cast("string").alias("token"), none.cast("int").alias("chars"))
    leaves = stash(at.unionByName(after).unionByName(root).groupBy("conv", "k").agg(F.max("token").alias("token"), F.max("chars").alias("chars")), "prefixes")
    deepest = leaves.agg(F.max("k").alias("k")).first()["k"]
    levels = int(deepest or 0).bit_length()
    blocks, halves = leaves.select("conv", "k", F.col("token").alias("block")), []
    for _ in range(levels):
        odd = F.col("k") % 2 == 1
        pair = blocks.groupBy("conv", F.shiftright("k", 1).alias("k")).agg(F.max(F.when(~odd, F.col("block"))).alias("upper"), F.max(F.when(odd, F.col("block"))).alias("lower"), F.max(F.when(odd, 1)).isNotNull().alias("both"))
        halves.append(stash(pair.withColumn("block", F.when(F.col("lower").isNotNull(), F.md5(F.concat("upper", "lower").cast("binary")))).drop("lower"), "halves"))
        blocks = halves[-1].select("conv", "k", "block")
    roots = blocks.where("k = 0").select("conv", "k", F.lit("").alias("name"))
    for half in reversed(halves):
        k, lower = F.col("k") * 2, F.md5(F.concat("name", "upper").cast("binary"))
        both = F.filter(F.array(F.struct(k.alias("k"), F.col("name")), F.when(F.col("both"), F.struct((k + 1).alias("k"), lower.alias("name")))), lambda x: x.isNotNull())
        roots = roots.join(half.select("conv", "k", "upper", "both"), ["conv", "k"]).select("conv", F.explode(both).alias("x")).select("conv", "x.k", "x.name")
    found = roots.join(leaves, ["conv", "k"]).select("conv", F.col("k").alias("depth"), "name", F.coalesce("chars", F.lit(0)).alias("chars"), F.col("token").isNull().alias("ends"))
    return stash(found, "paths"), levels


def grafted(nodes: DataFrame, paths: DataFrame, levels: int) -> DataFrame:
    """nodes with n_leaves and saved_tokens summed over their subtrees.

    Trees of twice the height are put together from an upper tree and the lower trees that hang below its cut nodes, all over the trie at once:
    lower roots are added up by their parent, the cut node, and each cut node's sum is added to its ancestors in the upper tree, which it
    finds on the path of one of its members. So there are as many rounds as halvings, and a round makes at most one row a turn; sums for a frequent
    prefix are combined before the shuffle.
    """
    sums = nodes.select(*NODE, "parent", "conv_id", F.col("leaf").cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    for level in range(levels):
        height = 1 << level
        block = F.shiftright("depth", level)
        hanging = sums.where((F.col("depth") % (2 * height)) == height)
        cut = hanging.groupBy((F.col("depth") - 1).alias("cut_depth"), "parent").agg(F.min("conv_id").alias("conv"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        cut = cut.select("conv", F.shiftright("cut_depth", level).alias("block"), "n_leaves", "saved_tokens")
        more = paths.select("conv", *NODE, block.alias("block")).join(cut, ["conv", "block"]).select(*NODE, "n_leaves", "saved_tokens")
        both = sums.unionByName(more, allowMissingColumns=True).groupBy(*NODE)
        sums = stash(both.agg(F.max("parent").alias("parent"), F.max("conv_id").alias("conv_id"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")), "grafts")
    return sums.select(*NODE, "n_leaves", "saved_tokens")


def _runs(batches):
    """Runs of ids of one node in a sorted partition, as texts of at most RUN ids: depth, name, first id, ids."""
    key, ids, out = None, [], []
    names = [*NODE, "first", "ids"]

    def cut():
        if ids:
            out.append((*key, ids[0], ",".join(map(str, ids))))
            ids.clear()

    for b in batches:
        for depth, name, conv in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (depth, name) != key or len(ids) >= RUN:
                cut()
                key = depth, name
            ids.append(conv)
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], pa.schema([("depth", pa.int64()), ("name", pa.string()), ("first", pa.int64()), ("ids", pa.string())]))
            out.clear()
    cut()
    yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], pa.schema([("depth", pa.int64()), ("name", pa.string()), ("first", pa.int64()), ("ids", pa.string())]))


def _hashed(batches):
    """The SHA-256 of each node's runs, which come in order; only the state of the hash is held."""
    schema = pa.schema([("depth", pa.int64()), ("name", pa.string()), ("ends_sha256", pa.string())])
    key, state, out = None, None, []
    for b in batches:
        for depth, name, _, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (depth, name) == key:
                state.update(b",")
            else:
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = (depth, name), hashlib.sha256()
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)], schema=schema)
        out = []
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*key, state.hexdigest()), schema, strict=True)], schema=schema)


def ends(paths: DataFrame) -> DataFrame:
    """(depth, name, ends_sha256) of the nodes at which conversations end.

    Ids are sorted in ranges and put together there; what goes to a node's task are texts of many ids, read as a stream.
    """
    order = [*NODE, "conv"]
    runs = paths.where("ends").select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_runs, "depth long, name string, first long, ids string")
    return runs.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_hashed, "depth long, name string, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first turns of the rebuilt conversations: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null role or text is empty; turns in the order of turn, null first, equal ones by role and text (repeated rows are turns of their own). Rows without conv_id
    belong to no conversation and are left out; other columns are not read. Names are 128-bit digests. No conversations give no rows.
    """
    paths, levels = named(*rebuilt(conversations))
    found = paths.groupBy(*NODE).agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"), F.max("chars").alias("chars"), F.min("ends").alias("leaf"))
    above = paths.select(F.col("conv").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    nodes = stash(found.join(above, ["conv_id", "depth"], "left"), "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    facts = [nodes.select(*NODE, "parent", "conv_id", "n_convs"), children, grafted(nodes, paths, levels), ends(paths)]
    rows = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), facts).groupBy(*NODE)
    rows = rows.agg(*(F.max(c).alias(c) for c in ("parent", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = rows.join(parents, ["depth", "parent"], "left")
    none = F.lit(hashlib.sha256().hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations' prefixes."""
    return prefix_trie(read(spark, sf_dir, "conversations"))


def _sql() -> str:
    from axonlake.llm.sharding import _crc_table

    crc = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), CAST(i AS INT), 1)) AS BIGINT))), lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1])), 4294967295)"
    return f"""
WITH k AS (SELECT {_crc_table()} AS t),
o AS (SELECT conv_id, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS token, length(coalesce(text, '')) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % {BLOCK} AS donor, {crc} % {HEAD} AS h, n FROM (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id), k),
g AS (SELECT c.conv_id, c.donor, c.h, least(c.h, coalesce(d.n, 0)) AS given FROM c LEFT JOIN c d ON d.conv_id = c.donor),
r AS (SELECT g.conv_id, pos, token, chars FROM g JOIN o ON o.conv_id = g.donor WHERE pos < h UNION ALL SELECT g.conv_id, pos - h + given, token, chars FROM g JOIN o ON o.conv_id = g.conv_id WHERE pos >= h),
q AS (SELECT g.conv_id, coalesce(list(token ORDER BY pos) FILTER (token IS NOT NULL), []) AS path, list(chars ORDER BY pos) AS chars FROM g LEFT JOIN r ON r.conv_id = g.conv_id GROUP BY g.conv_id),
p AS (SELECT conv_id, d AS depth, path[1:d] AS name, coalesce(chars[d], 0) AS chars, d = len(path) AS ends FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM q)),
n AS (SELECT depth, name, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, bool_and(ends) AS leaf, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY depth, name),
s AS (SELECT d AS depth, name[1:d] AS name, sum(CAST(leaf AS INT)) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM n) GROUP BY ALL),
b AS (SELECT depth - 1 AS depth, name[1:depth - 1] AS name, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(b.n_children, 0) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN s USING (depth, name) LEFT JOIN b USING (depth, name) LEFT JOIN n u ON u.depth = n.depth - 1 AND u.name = n.name[1:n.depth - 1]
"""


OP12_SQL = _sql()
