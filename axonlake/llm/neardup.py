"""Near-duplicate documents by MinHash and a multi-index Hamming join (operator 8)."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonlake.llm.common import read, small, stash
from axonlake.llm.words import STEP, WordHashes, mixed, shingles, split, texts

#: A signature has so many minimum hashes of 16 bits. It is cut into chunks; by the pigeonhole principle two signatures that differ
#: in at most 2 * chunks - 1 places (the radius) agree in some chunk up to one place; a chunk has a key for each place left out.
PLACES = 40
#: Chance at most that a pair just as similar as asked differs in more places than the radius. Chunks are as wide as that allows.
MISS = 2e-4
#: Buckets of more nodes are dealt to blocks of about this many.
BLOCK = 2048
#: At most so many links are joined to components by one task.
FEW_LINKS = 100_000
#: Closest candidates of a component in the second round; nodes and shingles in a block of a cluster in the last, about.
CLOSEST, CELL_NODES, CELL_MARKS = 8, 400, 1_000_000
_RNG = np.random.default_rng(8)
_MULTIPLY = _RNG.integers(0, 2**63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, PLACES, dtype=np.uint64)
#: Sets the keys of different chunks and left-out places apart.
_OFFSET = np.arange(1, PLACES + 1, dtype=np.uint64) * STEP


def layout(percent: int) -> tuple[int, int]:
    """(places in a chunk, radius) for a similarity: at 85 % chunks of 5 and a radius of 15, at 80 % chunks of 4 and a radius of 19."""
    differ = 1 - percent / 100
    beyond = lambda r: sum(math.comb(PLACES, k) * differ**k * (1 - differ) ** (PLACES - k) for k in range(r + 1, PLACES + 1))
    widths = [(w, 2 * (PLACES // w) - 1) for w in range(PLACES, 1, -1) if PLACES % w == 0]
    return next(((w, r) for w, r in widths if beyond(r) <= MISS), widths[-1])


def signature(hashes: np.ndarray) -> bytes:
    """PLACES minimum hashes, 16 bits of each."""
    least = np.full(PLACES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        np.minimum(least, (_MULTIPLY[:, None] * part + _ADD[:, None]).min(axis=1), out=least)
    return (mixed(least) >> np.uint64(48)).astype("<u2").tobytes()


def _sketch(batches):
    known = WordHashes()
    for b in batches:
        ids, count, node, sig = b.column(b.schema.get_field_index("doc_id")), [], [], []
        for text in texts(b):
            words = split(text)
            marks = shingles(known.of(words))
            count.append(len(marks))
            node.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
            sig.append(signature(marks) if words else None)
        yield pa.RecordBatch.from_arrays([ids, pa.array(count, pa.int64()), pa.array(node, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "words", "sig"])


def _keys(batches, wide: int):
    for b in batches:
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u2").reshape(-1, PLACES // wide, wide).astype(np.uint64)
        node, keys = b.column(0).to_numpy(), []
        for chunk in range(PLACES // wide):
            for out in range(wide):
                key = np.zeros(len(sig), np.uint64)
                for place in range(wide):
                    if place != out:
                        key = mixed(key * STEP + sig[:, chunk, place])
                keys.append(mixed(key + _OFFSET[chunk * wide + out]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(node, len(keys)))], names=["key", "node"])


def _runs(batches, by: list[str]):
    """The sorted rows of a partition as dicts of arrays; none splits the rows of one key."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows, bool)
        for c in by:
            x = b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
            if rest:
                last = rest[-1].column(b.schema.get_field_index(c))
                new[0] |= last[len(last) - 1].as_py() != x[0]
        starts = np.flatnonzero(new)
        if len(starts) and rest and starts[-1] >= 0:
            yield pa.Table.from_batches([*rest, b.slice(0, starts[-1])]).combine_chunks()
            rest = [b.slice(starts[-1])]
        elif len(starts):
            if starts[-1]:
                yield pa.Table.from_batches([b.slice(0, starts[-1])])
            rest = [b.slice(starts[-1])]
        else:
            rest.append(b)
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def _bounds(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the end."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), len(new))


def _chosen(near: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> list[int]:
    """Of pairs (a, b) of components by rising distance: those that connect them (limit 0), or each component's closest `limit`."""
    out, parent, have = [], {}, {}

    def top(x):
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    for i in np.argsort(near, kind="stable").tolist():
        x, y = int(a[i]), int(b[i])
        if limit:
            if min(have.get(x, 0), have.get(y, 0)) < limit:
                have[x], have[y] = have.get(x, 0) + 1, have.get(y, 0) + 1
                out.append(i)
        elif (x := top(x)) != (y := top(y)):
            parent[x] = y
            out.append(i)
    return out


def _within(batches, limit: int, marked: bool, radius: int):
    """Pairs of nodes of one cell of a bucket that lie in the radius and in different components: see _chosen. `marked`: also (x, x) for each node x that is in any such pair."""
    for t in _runs(batches, ["key", "cell"]):
        key, cell, node, comp, block = (t[c].to_numpy() for c in ("key", "cell", "node", "comp", "block"))
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), "<u2").reshape(-1, PLACES)
        edge, found = _bounds(key, cell), []
        n = np.diff(edge)
        two = edge[:-1][n == 2]
        two = two[(comp[two] != comp[two + 1]) & ((sig[two] != sig[two + 1]).sum(axis=1) <= radius)]
        found.append((node[two], node[two + 1]))
        if marked:
            found += [(node[two], node[two]), (node[two + 1], node[two + 1])]
        for at, size in zip(edge[:-1][n > 2], n[n > 2], strict=True):
            own, c, s, k = slice(at, at + size), comp[at : at + size], sig[at : at + size], block[at : at + size]
            if (c == c[0]).all():
                continue
            crossing, near, left, right = k[0] != k[-1] or (k != k[0]).any(), [], [], []
            for i in range(size - 1):
                m = c[i + 1 :] != c[i]
                if crossing:
                    m &= k[i + 1 :] != k[i]
                if m.any():
                    j = np.flatnonzero(m) + i + 1
                    d = (s[j] != s[i]).sum(axis=1)
                    j, d = j[d <= radius], d[d <= radius]
                    near.append(d), left.append(np.full(len(j), i)), right.append(j)
            if near:
                near, left, right = map(np.concatenate, (near, left, right))
                if marked and len(near):
                    own_node = node[own][np.unique(np.append(left, right))]
                    found.append((own_node, own_node))
                pick = _chosen(near, c[left], c[right], limit)
                found.append((node[own][left[pick]], node[own][right[pick]]))
        x, y = (np.concatenate(z) for z in zip(*found, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def _sets(batches):
    known = WordHashes()
    for b in batches:
        node, marks = [], []
        for text in texts(b):
            words = split(text)
            node.append(xxhash.xxh3_128_digest(b" ".join(words)))
            marks.append(shingles(known.of(words)).view(np.int64))
            if len(node) >= 200:
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(marks, pa.list_(pa.int64()))], names=["words", "marks"])
                node, marks = [], []
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(marks, pa.list_(pa.int64()))], names=["words", "marks"])


def _joined(batches):
    """Smallest node of each node's component, by union-find over a bounded number of links."""
    parent: dict[int, int] = {}

    def top(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = top(x), top(y)
            parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(list(map(top, nodes)), pa.int64())], names=["node", "comp"])


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of all ends of the links (a, b): comp is the component's smallest node.

    Alternating large-star and small-star steps, each a grouped minimum and a join, until nothing changes;
    the number of rounds grows with the logarithm of a component's diameter. At most FEW_LINKS links (counted) are
    joined by one task instead. No links: no rows.
    """
    edges, before = stash(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"), None
    if edges.limit(FEW_LINKS + 1).count() <= FEW_LINKS:  # a few rounds of jobs cost more than these few rows
        return edges.repartition(1).mapInArrow(_joined, "node long, comp long")
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stash(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large-least")
        large = stash(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = stash(large.groupBy("u").agg(F.min("v").alias("m")), "small-least")
        small_star = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stash(small_star.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs whose full sets are as similar as asked."""
    of = lambda x: sets.select(F.col("node").alias(x), F.col("marks").alias(f"{x}_marks"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    common = both.withColumn("common", F.size(F.array_intersect("a_marks", "b_marks")).cast("long"))
    return common.where(F.col("common") * 100 >= (F.size("a_marks") + F.size("b_marks") - F.col("common")) * percent).select("a", "b")


def _confirmed(batches, percent: int):
    """Links between components in each cell of a cluster, by the counts of common shingles of all its pairs: as many as connect what is linked."""
    for t in _runs(batches, ["cluster", "cell"]):
        cluster, cell, node, comp, block = (t[c].to_numpy() for c in ("cluster", "cell", "node", "comp", "block"))
        marks, edge, found = t["marks"], _bounds(cluster, cell), [(node[:0], node[:0])]
        for at, end in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            c, n = comp[at:end], end - at
            if (c == c[0]).all():
                continue
            own = [marks[i].values.to_numpy() for i in range(at, end)]
            sizes = np.array([len(x) for x in own], np.int64)
            row, (_, col, seen) = np.repeat(np.arange(n), sizes), np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
            more = seen[col] > 1  # a shingle of one text adds to no pair
            rank = np.cumsum(seen > 1) - 1
            row, col = row[more], rank[col[more]]
            order = np.argsort(col, kind="stable")
            row, col, common = row[order], col[order], np.zeros((n, n), np.float32)
            for low in range(0, int(col[-1]) + 1 if len(col) else 0, 2048):
                lo, hi = np.searchsorted(col, [low, low + 2048])
                has = np.zeros((n, 2048), np.float32)
                has[row[lo:hi], col[lo:hi] - low] = 1
                common += has @ has.T
            both = sizes[:, None] + sizes[None, :] - common
            k = block[at:end]
            m = (common * 100 >= both * percent) & (c[:, None] != c[None, :])
            if (k != k[0]).any():
                m &= k[:, None] != k[None, :]
            left, right = np.nonzero(np.triu(m, 1))
            pick = _chosen(-common[left, right] / both[left, right], c[left], c[right], 0)
            found.append((node[at:end][left[pick]], node[at:end][right[pick]]))
        x, y = (np.concatenate(z) for z in zip(*found, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])


def _cells(block, last):
    """Numbers of the cells (pairs of blocks 0 to last) that a block is part of."""
    return F.transform(F.sequence(F.lit(0).cast("long"), last), lambda k: F.least(k, block) * (last + 1) + F.greatest(k, block))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id of any type that can be ordered, text; other columns are left alone, whatever their names).

    Texts with the same words (told by 128 bits of a hash) form one node. Nodes whose signatures agree in a chunk up to one place meet
    in a bucket; pairs within the radius become candidates, and a candidate becomes a link only if the full shingle sets agree.
    To keep large groups linear, a bucket is dealt to blocks of about BLOCK nodes. A block first gives a spanning forest of its closest
    pairs, then the closest pairs of each component that is still apart. Only buckets that hold several components then are compared
    across their blocks. Components that are still apart but have candidates form a cluster: those of its nodes that have a candidate in
    another component are compared by their full sets, in cells of bounded blocks. So no candidate is lost, while pairs inside a
    component found before are not looked at again.
    A null or empty text has no shingles and is its own component. A null doc_id counts as the largest; a
    component of nulls only has component_id null and is kept. Rows with one doc_id and equal texts are both
    kept if that id is the component's. Very long texts are taken whole. An empty table gives no rows.
    """
    docs, (wide, radius) = docs.select("doc_id", "text"), layout(percent)
    kind = dict(docs.dtypes)["doc_id"]
    rows = stash(docs.mapInArrow(_sketch, f"doc_id {kind}, n_shingles long, words binary, sig binary"), "sketches")
    nodes = rows.where("words is not null").groupBy("words").agg(F.min("doc_id").alias("first_id"), F.first("sig").alias("sig"))
    nodes = stash(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    keyed = stash(nodes.select("node", "sig").mapInArrow(functools.partial(_keys, wide=wide), "key long, node long"), "keys")
    several = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    several = several.select("key", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    buckets = stash(keyed.join(several, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))), "buckets")

    def candidates(labels: DataFrame | None, limit: int, every: bool, marked: bool = False) -> DataFrame:
        if labels is None:
            meet = buckets.withColumn("comp", F.col("node"))
        else:
            meet = buckets.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            apart = meet.groupBy("key").agg(F.min("comp").alias("c"), F.max("comp").alias("d")).where("c <> d").select("key")
            meet = meet.join(apart, "key")
        cells = _cells(F.col("block"), F.col("blocks") - 1) if every else F.array("block")
        meet = meet.join(nodes.select("node", "sig"), "node").withColumn("cell", F.explode(cells)).select("key", "cell", "node", "comp", "block", "sig")
        meet = meet.repartition("key", "cell").sortWithinPartitions("key", "cell")
        return stash(meet.mapInArrow(functools.partial(_within, limit=limit, marked=marked, radius=radius), "a long, b long").distinct(), "pairs")

    met = buckets.select("node").distinct()
    ids = stash(nodes.join(met, "node").select(F.col("first_id").alias("wanted")).distinct(), "wanted")
    text_of = docs.join(small(ids), docs["doc_id"].eqNullSafe(F.col("wanted")), "left_semi")
    sets = text_of.mapInArrow(_sets, "words binary, marks array<bigint>").dropDuplicates(["words"])
    sets = stash(sets.join(nodes.join(met, "node").select("words", "node"), "words").select("node", "marks"), "sets")
    stars = lambda labels: labels.where("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b"))
    labels = stash(components(_verified(candidates(None, 0, False), sets, percent)), "labels")
    labels = stash(components(_verified(candidates(labels, CLOSEST, False), sets, percent).unionByName(stars(labels))), "labels")

    # what is still apart: clusters of components with a candidate between them, and their nodes that have one
    of = lambda x: labels.select(F.col("node").alias(x), F.col("comp").alias(f"{x}_comp"))
    apart = candidates(labels, 0, True, marked=True)
    between = apart.where("a <> b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    cluster = stash(components(between.select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))).select(F.col("node").alias("comp"), F.col("comp").alias("cluster")), "clusters")
    member = sets.join(apart.where("a = b").select(F.col("a").alias("node")), "node").select("node", F.size("marks").alias("n"))
    member = member.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(cluster, "comp")
    member = stash(member, "cluster-members")
    blocks = member.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / CELL_NODES, F.sum(F.col("n").cast("long")) / CELL_MARKS)).alias("blocks"))
    placed = member.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    cells = placed.withColumn("cell", F.explode(_cells(F.col("block"), F.col("blocks") - 1))).join(sets, "node").select("cluster", "cell", "node", "comp", "block", "marks")
    last_links = cells.repartition("cluster", "cell").sortWithinPartitions("cluster", "cell").mapInArrow(functools.partial(_confirmed, percent=percent), "a long, b long")
    labels = stash(components(last_links.unionByName(stars(labels))), "labels")

    known = nodes.select("node", "words", "first_id").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    firsts = stash(known.groupBy("comp").agg(F.min("first_id").alias("component_id")), "firsts")
    member = stash(known.join(firsts, "comp").select("words", "component_id"), "members")
    out = rows.select("doc_id", "n_shingles", "words").join(member, "words", "left")
    component = F.when(F.col("words").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 % of their five-word shingles."""
    return near_duplicates(read(spark, sf_dir, "documents"))


#: Links by exact counts of shared shingles; components by a recursive closure.
OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m ON s.doc_id = m.a
"""
