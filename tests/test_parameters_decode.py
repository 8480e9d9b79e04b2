"""Digests as trees, parameter sets bound to their graph, decoding in chunks, edit counts in rows."""

import glob
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from axonlake.operators import digest, scan, text
from axonlake.sources import parameters
from axonlake.sources.parameters import EDGE, NODE, CorruptSet
from axonlake.streaming.decode import Decoder, decode_stream, decoded


def tree(rows, block):
    """Plain Python over JSON rows in order."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    level = [sha(r) for r in rows]
    if not level:
        return sha("")
    while True:
        level = [sha("".join(level[i : i + block])) for i in range(0, len(level), block)]
        if len(level) == 1:
            return level[0]


@pytest.mark.parametrize("n", [0, 1, 5, 6, 36, 37, 240])
def test_digest_is_a_tree_over_the_order(spark, monkeypatch, n):
    monkeypatch.setattr(digest, "BLOCK", 6)
    rows = [(i // 3, None if i % 5 == 0 else i, f"é{i}") for i in range(n)]
    df = spark.createDataFrame(rows, "k long, v long, t string")
    form = lambda r: json.dumps({"k": r[0], "v": r[1], "t": r[2]}, ensure_ascii=False, separators=(",", ":"))
    want = f"{n}:" + tree([form(r) for r in sorted(rows, key=lambda r: (r[0], form(r)))], 6)
    assert {digest.digest_of(df.repartition(k), ["k"]) for k in (1, 7)} == {want}


def test_digest_tells_a_change_of_a_value_and_of_the_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "k long, t string")
    other = [df.withColumn("t", F.when(F.col("k") == 3, "c").otherwise(F.col("t"))), df.where("k < 3"), df.withColumn("k", -F.col("k"))]
    assert len({digest.digest_of(x, ["k"], ["t"]) for x in [df, *other]}) == 4


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([(i, 100 + i) for i in range(6)], "index long, id long")
    edges = spark.createDataFrame([(i % 6, (i * 5) % 6, i) for i in range(9)], "source_index long, target_index long, abs_row long")
    return nodes, edges


@pytest.fixture(scope="module")
def tables(spark):
    e = [(i, i / 8 - 0.5, i % 3 - 1, 0.5, 255 if i == 4 else i % 7, i) for i in range(9)]
    return spark.createDataFrame(e, EDGE), spark.createDataFrame([(i, i, 2 * i, "AL" if i % 2 else "") for i in range(6)], NODE)


def test_parameters_round_trip(spark, tmp_path, graph, tables):
    path = str(tmp_path / "set")
    manifest = parameters.save_parameters(*tables, parameters.graph_digests(*graph), path, {"gain": 2})
    again = parameters.save_parameters(tables[0].repartition(5), tables[1].repartition(3), parameters.graph_digests(graph[0].repartition(4), graph[1].repartition(2)), str(tmp_path / "again"), {"gain": 2})
    assert manifest == again
    found = parameters.load_parameters(spark, path)
    found.check_graph(*graph)
    assert sorted(map(tuple, found.edges.collect())) == sorted(map(tuple, tables[0].collect())) and found.manifest == manifest
    assert sorted(map(tuple, found.nodes.collect())) == sorted(map(tuple, tables[1].collect()))
    with pytest.raises(Exception, match="exist"):
        parameters.save_parameters(*tables, parameters.graph_digests(*graph), path)


def test_another_graph_is_refused(spark, tmp_path, graph, tables):
    parameters.save_parameters(*tables, parameters.graph_digests(*graph), str(tmp_path / "set"))
    found = parameters.load_parameters(spark, str(tmp_path / "set"))
    nodes, edges = graph
    for other in ((nodes.withColumn("id", F.col("id") + 1), edges), (nodes, edges.withColumn("target_index", (F.col("target_index") + F.col("abs_row")) % 6)), (nodes, edges.where("abs_row > 0"))):
        with pytest.raises(CorruptSet, match="another graph"):
            found.check_graph(*other)


@pytest.mark.parametrize("section,column,value", [("edges", "weight", 0.25), ("nodes", "primary_roi", "MB")])
def test_a_changed_value_is_refused(spark, tmp_path, graph, tables, section, column, value):
    path = str(tmp_path / "set")
    parameters.save_parameters(*tables, parameters.graph_digests(*graph), path)
    rows = spark.read.parquet(f"{path}/{section}").collect()
    index = "edge_index" if section == "edges" else "node_index"
    new = [r.asDict() | ({column: value} if r[index] == 3 else {}) for r in rows]
    spark.createDataFrame([tuple(r.values()) for r in new], EDGE if section == "edges" else NODE).write.mode("overwrite").parquet(f"{path}/{section}")
    with pytest.raises(CorruptSet, match=column):
        parameters.load_parameters(spark, path)


def test_a_changed_byte_is_refused(spark, tmp_path, graph, tables):
    path = str(tmp_path / "set")
    parameters.save_parameters(*tables, parameters.graph_digests(*graph), path)
    (manifest,) = glob.glob(f"{path}/manifest/part-*.txt")
    data = open(manifest, "rb").read()
    for at in (data.index(b"edge_weight") + 20, 0):
        with open(manifest, "wb") as f:
            f.write(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
        for crc in glob.glob(f"{path}/manifest/.*.crc"):
            open(crc, "wb").close()
        with pytest.raises(Exception):  # noqa: B017  (a digest, or the file system's own check of the file)
            parameters.load_parameters(spark, path)


@pytest.mark.parametrize("column,value,problem", [("weight", float("nan"), "weight"), ("weight", float("inf"), "weight"), ("sign", 2, "sign"), ("transmitter", 9, "transmitter"), ("confidence", None, "confidence"), ("edge_index", 1, "index"), ("edge_index", 40, "index"), ("edge_index", None, "index")])
def test_bad_sets_are_not_saved(spark, tmp_path, graph, tables, column, value, problem):
    rows = [r.asDict() | ({column: value} if r["edge_index"] == 3 else {}) for r in tables[0].collect()]
    bad = spark.createDataFrame([tuple(r.values()) for r in rows], EDGE)
    assert {r["problem"] for r in parameters.problems(bad, tables[1]).collect()} == {problem}
    with pytest.raises(ValueError, match="problems"):
        parameters.save_parameters(bad, tables[1], {}, str(tmp_path / "set"))
    assert not (tmp_path / "set").exists()


# decoding


def whole(scores, classes):
    scores = [*scores, *[0.0] * (-len(scores) % classes)]
    out, last = [], None
    for f in range(len(scores) // classes):
        own = [float("-inf") if x is None or x != x else x for x in scores[f * classes : (f + 1) * classes]]
        best = own.index(max(own))
        if best != last and best != 0:
            out.append((f, best))
        last = best
    return out


def chunked(seed, n=300):
    r = random.Random(seed)
    scores = [r.choice([0.0, 1.0, 1.0, 2.0, -1.0, None, float("nan")]) for _ in range(n)]
    at, chunks = 0, []
    while at < n:
        k = r.choice([0, 1, 2, 5, 17])
        chunks.append(scores[at : at + k])
        at += k
    return scores, chunks


@pytest.mark.parametrize("seed", range(8))
def test_any_chunks_give_the_whole(seed):
    scores, chunks = chunked(seed, 300 + seed)
    own, out = Decoder(4), []
    for c in chunks:
        out += own.push(c)
        own = Decoder(4).restore(json.loads(json.dumps(own.snapshot())))
    assert out + own.flush() == whole(scores, 4)
    assert own.flush() == []


@pytest.mark.parametrize("most", [1_000_000, 10])
def test_a_table_of_chunks_gives_the_whole(spark, monkeypatch, most):
    monkeypatch.setattr(scan, "SERIES", most)
    series = {str(s): chunked(s, n) for s, n in ((0, 203), (1, 60), (2, 3))}
    rows = [(s, i, c) for s, (_, chunks) in series.items() for i, c in enumerate(chunks)] + [("none", 0, None), ("none", 1, [])]
    got = decoded(spark.createDataFrame(rows, "series string, ordinal long, scores array<double>").repartition(3), 4).collect()
    assert sorted(map(tuple, got)) == sorted((s, *x) for s, (scores, _) in series.items() for x in whole(scores, 4))


def test_a_stream_of_chunks_gives_the_whole(spark, tmp_path):
    schema = "series string, ordinal long, scores array<double>, flush boolean"
    series = {str(s): chunked(s, n) for s, n in ((3, 120), (4, 45))}
    rows = [(s, i, c, i == len(chunks) - 1) for s, (_, chunks) in series.items() for i, c in enumerate(chunks)]
    (tmp_path / "in").mkdir()
    store = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        for lo, hi in ((0, 7), (7, 20), (20, 10**6)):
            spark.createDataFrame([r for r in rows if lo <= r[1] < hi], schema).write.mode("append").parquet(str(tmp_path / "in"))
            q = decode_stream(stream, 4).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            q.awaitTermination()
        got = spark.read.parquet(str(tmp_path / "out")).collect()
        assert sorted(map(tuple, got)) == sorted((s, *x) for s, (scores, _) in series.items() for x in whole(scores, 4))
    finally:
        spark.conf.unset(store)


# edits


def table(a, b):
    n, m = len(a), len(b)
    far = [[max(i, j) if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            far[i][j] = min(far[i - 1][j] + 1, far[i][j - 1] + 1, far[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    s, d, k, i, j = 0, 0, 0, n, m
    while i or j:
        if i and j and far[i][j] == far[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            s, i, j = s + (a[i - 1] != b[j - 1]), i - 1, j - 1
        elif i and far[i][j] == far[i - 1][j] + 1:
            d, i = d + 1, i - 1
        else:
            k, j = k + 1, j - 1
    return s, d, k


def test_edit_counts_equal_those_of_the_whole_table():
    r = random.Random(0)
    for _ in range(1500):
        a, b = ([r.choice("abé") for _ in range(r.randint(0, 13))] for _ in range(2))
        assert text.edits(a, b) == table(a, b), (a, b)


def test_edit_counts_of_long_texts_take_little_memory():
    import tracemalloc

    r = random.Random(1)
    a, b = ([r.choice("abcdef") for _ in range(n)] for n in (300, 20_000))
    tracemalloc.start()
    s, d, k = text.edits(a, b)
    assert tracemalloc.get_traced_memory()[1] < 8e6 and k - d == 19_700
    tracemalloc.stop()
