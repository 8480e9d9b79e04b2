"""Alignment against the worked samples and against loops; streams equal batches for any cut into chunks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from axonlake.functions import arrays, basic
from axonlake.operators import kernels, sampling, temporal, text
from axonlake.sources.shared import stash
from axonlake.streaming.align import Aligner, Utf8Stream, align_stream


def test_hold_and_line(spark):
    samples = spark.createDataFrame([("a", 0, 0, 2.0), ("a", 4, 1, 6.0)], "s string, tick long, sequence long, value double")
    grid = spark.range(7).select(F.lit("a").alias("s"), F.col("id").alias("step"), F.col("id").alias("tick"))
    assert [r["value"] for r in temporal.asof_hold(samples, grid, ["s"]).orderBy("step").collect()] == [2, 2, 2, 2, 6, 6, 6]
    assert [r["value"] for r in temporal.asof_linear(samples, grid, ["s"]).orderBy("step").collect()] == [2, 3, 4, 5, 6, 6, 6]


def test_simultaneous_samples_take_the_greatest_sequence(spark):
    samples = spark.createDataFrame([("a", 1, 5, 1.0), ("a", 1, 9, 2.0), ("a", 1, 7, 3.0)], "s string, tick long, sequence long, value double")
    grid = spark.createDataFrame([("a", 0, 0), ("a", 1, 1)], "s string, step long, tick long")
    assert [r["value"] for r in temporal.asof_hold(samples, grid, ["s"]).orderBy("step").collect()] == [None, 2.0]


def loop(mode, rows, ticks, last):
    out = []
    for k in range(last + 1):
        p = k * ticks
        own = [r for r in rows if r[0] <= p and (mode == "hold" or p < r[0] + r[2])]
        if own:
            best = max(own, key=lambda r: (r[0], r[1]))
            out.append((k, best[0], best[3]))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_chunks_equal_the_whole(seed):
    rng = random.Random(seed)
    rows = sorted((rng.randrange(200), i, rng.randrange(1, 60), float(rng.randrange(9))) for i in range(40))
    for mode in ("hold", "interval"):
        own, out, at = Aligner(mode, 7, 0, 40), [], 0
        while at < len(rows):
            n = rng.randrange(1, 8)
            part, at = rows[at : at + n], at + n
            mark = rows[at][0] if at < len(rows) else rows[-1][0] + 1
            out += own.push([("sample", *r) for r in part] + [("mark", mark, 0, 0, 0.0)])
            own = Aligner(mode, 7, 0, 40).load(own.dump())
        out += own.push([("finish", 0, 0, 0, 0.0)])
        assert out == loop(mode, rows, 7, 40)
    own = Aligner("pulse", 7)
    got = own.push([("sample", *r) for r in rows] + [("mark", 100, 0, 0, 0.0)])
    got += own.push([("finish", 0, 0, 0, 0.0)])
    assert sorted(got) == sorted((math.ceil(r[0] / 7), r[0], r[3]) for r in rows)


def test_late_samples_and_marks_are_errors():
    own = Aligner("hold", 1)
    own.push([("sample", 5, 0, 0, 1.0), ("mark", 6, 0, 0, 0.0)])
    before = own.dump()
    with pytest.raises(ValueError, match="late"):
        Aligner("hold", 1).load(before).push([("sample", 5, 1, 0, 1.0)])
    with pytest.raises(ValueError, match="goes back"):
        Aligner("hold", 1).load(before).push([("mark", 4, 0, 0, 0.0)])
    own.push([("finish", 0, 0, 0, 0.0)])
    for row in (("sample", 9, 0, 0, 1.0), ("mark", 9, 0, 0, 0.0), ("finish", 0, 0, 0, 0.0)):
        with pytest.raises(ValueError, match="after the finish"):
            Aligner("hold", 1).load(own.dump()).push([row])
    with pytest.raises(ValueError, match="wait"):
        Aligner("hold", 1, capacity=1).push([("sample", 1, 0, 0, 1.0), ("sample", 2, 0, 0, 1.0)])


def test_stream_equals_batch(spark, tmp_path):
    schema = "series string, kind string, tick long, sequence long, duration long, value double"
    rows = [("a", "sample", t, t, 4, float(t)) for t in range(0, 40, 3)] + [("b", "sample", t, t, 4, -float(t)) for t in range(1, 40, 5)]
    for k, (lo, hi) in enumerate([(0, 10), (10, 25), (25, 60)]):
        part = [r for r in rows if lo <= r[2] < hi] + [(s, "mark", hi, None, None, None) for s in "ab"]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert k < 3
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    q = align_stream(stream, "hold", 2, 0, 19).writeStream.format("memory").queryName("aligned").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["series"], r["step"], r["value"]) for r in spark.table("aligned").collect()}
    samples = spark.createDataFrame([(r[0], r[2], r[3], r[5]) for r in rows], "series string, tick long, sequence long, value double")
    grid = spark.range(20).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("series"), F.col("id").alias("step"), (F.col("id") * 2).alias("tick"))
    want = temporal.asof_hold(samples, grid, ["series"]).where("value is not null")
    assert got == {(r["series"], r["step"], r["value"]) for r in want.collect()}


def test_utf8_stream():
    s, data, out = Utf8Stream(), "aé😀z".encode(), ""
    for b in data:
        out += s.push(bytes([b]))
    assert out == "aé😀z" and s.flush() == b""
    assert s.push("é".encode()[:1]) == "" and s.flush() == "é".encode()[:1]


def test_arrays(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0], [[0.1, 0.9], [0.2, 0.8], [0.9, 0.1], [0.3, 0.7]], [1.0, 0.0, 2.0], [0.5, 0.5, 0.5], [False, True, False])], "x array<double>, f array<array<double>>, r array<double>, v array<double>, d array<boolean>")
    got = df.select(arrays.argmax(F.col("x")).alias("a"), arrays.softmax(F.col("x")).alias("s"), arrays.ctc_collapse(F.col("f")).alias("c"), arrays.gae(F.col("r"), F.col("v"), F.col("d"), F.lit(1.0), 0.9, 0.8).alias("g"), arrays.cosine(F.col("r"), F.col("v")).alias("cos")).first()
    assert got["a"] == 1 and math.isclose(sum(got["s"]), 1) and got["c"] == [1, 1]
    want, nxt = [], 0.0
    for r, v, n, d in [(2.0, 0.5, 1.0, 0), (0.0, 0.5, 0.5, 1), (1.0, 0.5, 0.5, 0)]:
        nxt = r + 0.9 * n * (1 - d) - v + 0.72 * (1 - d) * nxt
        want.insert(0, nxt)
    assert all(map(math.isclose, got["g"], want)) and math.isclose(got["cos"], 1.5 / (math.sqrt(5) * math.sqrt(0.75)))


def test_edit_counts():
    assert text.edits(list("kitten"), list("sitting")) == (2, 0, 1)
    assert text.edits([], ["a"]) == (0, 0, 1) and text.edits(["a", "b"], []) == (0, 2, 0)
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(8))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        assert sum(text.edits(a, b)) == row[-1]


def test_cores_agree(spark):
    edges = [(0, 1, 0.5), (1, 2, -0.3), (2, 0, 0.8)]
    run = kernels.leaky_run(spark.createDataFrame([(0, *e) for e in edges], "variant long, src long, dst long, weight double"), [0, 1, 2], {0: 1.0}, 4, 2.0).where("step = 3")
    state = spark.createDataFrame([(i, 0.0, 0.0) for i in range(3)], "id long, v double, y double")
    e, drive = spark.createDataFrame(edges, "src long, dst long, weight double"), spark.createDataFrame([(0, 1.0)], "id long, input double")
    for _ in range(4):
        state = spark.createDataFrame(kernels.leaky_step(state, e, drive, 2.0).collect(), "id long, v double, y double")
    want = {r["id"]: r["v"] for r in run.collect()}
    assert all(math.isclose(want[r["id"]], r["v"], abs_tol=1e-12) for r in state.collect())
    spikes = kernels.lif_run(spark.createDataFrame([(0, 0, 1, 5.0)], "variant long, src long, dst long, weight double"), [0, 1], {0: 30.0}, 6, clamp={1: (0, 6, "silence")}).groupBy("id").agg(F.sum("spike").alias("n"))
    assert {r["id"]: r["n"] > 0 for r in spikes.collect()} == {0: True, 1: False}


def test_splits_leak_nothing(spark):
    rows = spark.createDataFrame([(i, i % 9, i // 12) for i in range(60) if i % 9 < 3 and i // 12 < 2 or i % 9 >= 3 and i // 12 >= 2], "i long, speaker long, session long")
    got = sampling.group_safe_split(rows, ("speaker", "session"), 0.4, lambda df: stash(df, "t"))
    for c in ("speaker", "session"):
        assert got.groupBy(c).agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    split = sampling.split_by(rows, "speaker", 0.3, 1)
    assert split.groupBy("speaker").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert split.where("split = 'validation'").select("speaker").distinct().count() == max(1, math.floor(0.3 * rows.select("speaker").distinct().count() + 0.5))


def test_strings(spark):
    df = spark.createDataFrame([("x START hé END y",), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(basic.body_between(F.col("t"), "START", "END")).collect()] == ["hé", None, None]
    cut = spark.createDataFrame([("aé😀",)], "t string").select(*(basic.utf8_cut(F.col("t"), n).alias(f"n{n}") for n in (1, 2, 3, 6, 7)), basic.byte_tokens(F.col("t")).alias("b")).first()
    assert list(cut)[:5] == ["a", "a", "aé", "aé", "aé😀"] and cut["b"] == list("aé😀".encode())
    r = spark.createDataFrame([('key sk-abcdefgh1234 Bearer abc.def token=xyz {"secret": "q"}',)], "t string").select(basic.redact(F.col("t"))).first()[0]
    assert "abcdefgh1234" not in r and "abc.def" not in r and "xyz" not in r and '"q"' not in r
