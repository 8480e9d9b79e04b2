"""Forms that no single task has to hold: windows over ranges of a series, ranks by counting, containment by marks, subsets by counts of sizes, feedback."""

import itertools
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from axonlake.operators import containment, graph, sampling, scan, selection, temporal
from axonlake.streaming import feedback


@pytest.fixture
def many_ranges(spark, monkeypatch):
    """Long series are cut, and ranges stay as many as there are partitions, as on large tables."""
    monkeypatch.setattr(scan, "SERIES", 20)
    keep = {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keep}
    for k, v in keep.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def series(seed, hot=400, n=12):
    r = random.Random(seed)
    rows = [(None if s == 0 else s, t, r.randint(0, 3), r.choice([None, 1.0, 2.5, -3.0])) for s, size in [(5, hot), *((i, r.randint(1, 6)) for i in range(n))] for t in range(size)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("before,after", [(1, 1), (7, 0), (70, 3)])
def test_windows_over_ranges_equal_windows_over_series(spark, many_ranges, before, after):
    df = spark.createDataFrame(series(before), "s long, t long, k long, v double")
    cut = scan.segmented(df, ["s"], ["t"], before=before, after=after)
    sizes = {(r[scan.RANGE], r["s"]): r["n"] for r in scan.segmented(df, ["s"], ["t"]).groupBy(scan.RANGE, "s").agg(F.count("*").alias("n")).collect()}
    assert len([k for k in sizes if k[1] == 5]) > 5 and max(sizes.values()) < 150  # the long series is many ranges
    measure = lambda w: F.sum("t").over(w.orderBy("t").rowsBetween(-before, after))
    got = scan.own(cut.withColumn("x", measure(Window.partitionBy(scan.RANGE, "s"))))
    want = df.withColumn("x", measure(Window.partitionBy("s")))
    assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)


def test_kept_rows_are_looked_for_beyond_whole_ranges(spark, many_ranges):
    rows = [(5, t, t if t in (3, 250) else None) for t in range(400)] + [(9, t, 1 if t == 0 else None) for t in range(60)] + [(4, 0, 8)]
    df = spark.createDataFrame(rows, "s long, t long, v long")
    w = Window.partitionBy(scan.RANGE, "s").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    got = scan.own(scan.segmented(df, ["s"], ["t"], before=1, keep=F.col("v").isNotNull()).withColumn("x", F.last("v", ignorenulls=True).over(w)))
    want = {(5, t): (None if t < 3 else 3 if t < 250 else 250) for t in range(400)} | {(9, t): 1 for t in range(60)} | {(4, 0): 8}
    assert {(r["s"], r["t"]): r["x"] for r in got.collect()} == want


@pytest.mark.parametrize("seed", range(2))
def test_running_values_over_ranges(spark, many_ranges, seed):
    df = spark.createDataFrame(series(seed), "s long, t long, k long, v double")
    how = {"total": ("sum", "k"), "most": ("max", "v"), "least": ("min", "v")}
    w = Window.partitionBy("s").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({name: getattr(F, f)(c).over(w) for name, (f, c) in how.items()})
    assert sorted(scan.prefix(df, ["s"], ["t"], how).collect(), key=repr) == sorted(want.collect(), key=repr)
    assert scan.prefix(df.limit(0), ["s"], ["t"], how).count() == 0


def test_short_series_are_windows_without_a_write(spark, capsys):
    df = spark.createDataFrame(series(1), "s long, t long, k long, v double")
    scan.own(scan.segmented(df, ["s"], ["t"], before=1).withColumn("x", F.lag("t").over(Window.partitionBy(scan.RANGE, "s").orderBy("t")))).explain()
    said = capsys.readouterr().out
    assert said.count("Exchange") == 1 and "rangepartitioning" not in said
    w = Window.partitionBy("s").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    assert sorted(scan.prefix(df, ["s"], ["t"], {"x": ("sum", "k")}).collect(), key=repr) == sorted(df.withColumn("x", F.sum("k").over(w)).collect(), key=repr)


def test_holds_and_lines_of_one_long_series(spark, many_ranges):
    r = random.Random(2)
    ticks = sorted(r.sample(range(5000), 300))
    samples = spark.createDataFrame([(1, t, 0, float(t % 17)) for t in ticks] + [(2, 10, 0, 4.0)], "s long, tick long, sequence long, value double")
    grid = spark.createDataFrame([(s, k, k * 10) for s in (1, 2, 3) for k in range(600)], "s long, step long, tick long")
    hold = {(x["s"], x["tick"]): x["value"] for x in temporal.asof_hold(samples, grid, ["s"]).collect()}
    line = {(x["s"], x["tick"]): x["value"] for x in temporal.asof_linear(samples, grid, ["s"]).collect()}
    for t in range(0, 6000, 10):
        at = [x for x in ticks if x <= t]
        up = [x for x in ticks if x > t]
        assert hold[1, t] == (float(at[-1] % 17) if at else None)
        want = None if not at else float(at[-1] % 17) if not up or at[-1] == t else at[-1] % 17 + (up[0] % 17 - at[-1] % 17) * (t - at[-1]) / (up[0] - at[-1])
        assert line[1, t] == want or math.isclose(line[1, t], want)
        assert hold[2, t] == (4.0 if t >= 10 else None) and hold[3, t] is None
    assert len(hold) == len(line) == 1800


def test_runs_cross_ranges(spark, many_ranges):
    inside = [x for x in range(900) if x % 250 not in (0, 1) and x != 400]
    df = spark.createDataFrame([(1, x, 1) for x in inside] + [(1, 0, 0), (2, 7, 1), (2, 7, 1), (None, 3, 1)], "s long, at long, ok int")
    got = sorted(map(tuple, temporal.runs(df, ["s"], "at", F.col("ok") == 1).collect()), key=repr)
    want, at = [], inside[0]
    for a, b in itertools.pairwise([*inside, 10**9]):
        if b != a + 1:
            want.append((1, at, a, a - at + 1))
            at = b
    assert got == sorted([*want, (2, 7, 7, 1), (None, 3, 3, 1)], key=repr)


# ranks

QUANTILES = {f"q{i}": q for i, q in enumerate((0, 0.01, 0.25, 0.5, 0.99, 1))}


def nearest(values, q):
    values = sorted(values, key=lambda v: (math.isnan(v), v))
    return values[max(math.ceil(q * len(values)) - 1, 0)]


def test_ranks_by_counting(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW", 60), monkeypatch.setattr(selection, "BUCKETS", 256)
    r = random.Random(3)
    groups = {"even": [r.uniform(-5, 5) for _ in range(900)], "scale": [math.ldexp(1, -k) * s for k in range(0, 1000, 5) for s in (1, -1, 3)], "same": [2.5] * 500, None: [float(r.randint(0, 3)) for _ in range(300)], "odd": [math.inf, -math.inf, 1.7e308, -1.7e308, 5e-324, 0.0, math.nan, math.nan] * 9, "one": [7.0], "none": []}
    rows = [(g, v) for g, values in groups.items() for v in values] + [("even", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {x["g"]: x for x in selection.nearest_ranks(df, ["g"], "v", QUANTILES).collect()}
    assert set(got) == {g for g in groups if groups[g]}
    for g, x in got.items():
        for name, q in QUANTILES.items():
            want = nearest(groups[g], q)
            assert x[name] == want or math.isnan(x[name]) and math.isnan(want), (g, q)
    line = {x["g"]: x for x in selection.linear_quantiles(df.where("g in ('even', 'same', 'one')"), ["g"], "v", QUANTILES).collect()}
    for g, x in line.items():
        v = sorted(groups[g])
        for name, q in QUANTILES.items():
            at = q * (len(v) - 1)
            assert math.isclose(x[name], v[math.floor(at)] + (v[math.ceil(at)] - v[math.floor(at)]) * (at - math.floor(at)), rel_tol=1e-12, abs_tol=1e-12)


def test_ranks_of_longs_that_doubles_do_not_tell_apart(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW", 10)
    values = [2**60 + i for i in range(300)] + [-(2**61), 2**62]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    row = selection.nearest_ranks(df, [], "v", QUANTILES).first()
    assert [row[name] for name in QUANTILES] == [sorted(values)[max(math.ceil(q * len(values)) - 1, 0)] for q in QUANTILES.values()]
    assert selection.nearest_ranks(df.limit(0), [], "v", QUANTILES).count() == 0


# containment


@pytest.mark.parametrize("seed", range(3))
def test_containment_equals_all_pairs(spark, seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abé😀 ") for _ in range(n))
    base = [word(r.choice([1, 2, 3, 5, 9, 30, 64, 65, 200, 500])) for _ in range(40)]
    texts = base + [x[r.randint(0, len(x) // 2) :] for x in base[:20]] + [word(50) + x + word(7) for x in base[20:]] + ["", None, "  ", "ab" * 300, "é"]
    held = [base[i][: r.randint(1, 150)] for i in range(0, 40, 3)] + [base[5] + "!" + base[6], "", None, "ab" * 40, "qq", "zebra"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    out = {x["i"] for x in containment.without_overlap(df, spark.createDataFrame([(h, 1) for h in held], "text string, i long")).collect()}
    kept = [h.strip(" ") for h in held if h and h.strip(" ")]
    want = {i for i, t in enumerate(texts) if not (t or "").strip(" ") or not any(h in t.strip(" ") or t.strip(" ") in h for h in kept)}
    assert out == want


def test_marks_of_a_stretch_are_among_the_text_s():
    r = random.Random(1)
    text = "".join(r.choice("abc") for _ in range(400))
    for c in range(7):
        for _ in range(50):
            n = r.randint(1 << c, min(400, 2 << c))
            at = r.randint(0, 400 - n)
            own = containment.marks(text[at : at + n], c)
            assert len(own) and set(own.tolist()) <= set(containment.marks(text, c).tolist())
    long = "".join(chr(r.randint(97, 122)) for _ in range(20_000))
    assert len(containment.marks(long, containment.TOP)) < 20_000 / 12


def test_containment_plan_has_no_nested_loop(spark, capsys):
    df = spark.createDataFrame([(1, "some text"), (2, "other")], "i long, text string")
    containment.without_overlap(df, df.where("i = 2")).explain()
    said = capsys.readouterr().out
    assert "NestedLoop" not in said and "Cartesian" not in said


# subsets


@pytest.mark.parametrize("seed", range(40))
def test_nearest_subset_equals_all_subsets(seed):
    r = random.Random(seed)
    sizes = [r.choice([1, 2, 3, 7, 11, 40]) if seed % 2 else r.randint(1, 25) for _ in range(r.randint(1, 12))]
    target = r.choice([0.1, 0.3, 0.5, 0.77]) * sum(sizes)
    sums = {sum(c) for k in range(1, len(sizes)) for c in itertools.combinations(sizes, k)}
    counts = {s: sizes.count(s) for s in set(sizes)}
    got = sampling.nearest_subset(counts, target)
    assert all(n <= counts[s] for s, n in got.items())
    if sums:
        assert sum(s * n for s, n in got.items()) == min(sums, key=lambda x: (abs(x - target), x))
    else:
        assert got == {}


def test_nearest_subset_of_very_many_items():
    counts = {1: 40_000_000, 2: 9_000_000, 17: 300_000, 1003: 40, 2500: 7}
    total = sum(s * n for s, n in counts.items())
    got = sampling.nearest_subset(counts, 0.3 * total)
    assert abs(sum(s * n for s, n in got.items()) - 0.3 * total) <= 0.5
    only = {6: 1_000_000, 10: 1_000_000, 15: 3}
    assert sum(s * n for s, n in sampling.nearest_subset(only, 2_000_001).items()) == 2_000_001
    assert sum(s * n for s, n in sampling.nearest_subset({6: 100_000, 10: 100_000}, 200_001).items()) == 200_000


def test_split_takes_seeded_components(spark):
    rows = spark.createDataFrame([(i, i // 3, i // 3) for i in range(90)] + [(900 + i, 700, i % 2) for i in range(4)] + [(1000, None, None)], "i long, speaker long, session long")
    first = {r["i"]: r["split"] for r in sampling.group_safe_split(rows, ("speaker", "session"), 0.4, seed=1).collect()}
    again = {r["i"]: r["split"] for r in sampling.group_safe_split(rows.repartition(7), ("speaker", "session"), 0.4, seed=1).collect()}
    other = {r["i"]: r["split"] for r in sampling.group_safe_split(rows, ("speaker", "session"), 0.4, seed=2).collect()}
    assert first == again and first != other and len(first) == 95
    assert list(first.values()).count("validation") == list(other.values()).count("validation") == 38


# paths


def test_shortest_actions_on_a_grid(spark):
    r = random.Random(6)
    open_ = {(x, y) for x in range(8) for y in range(8) if r.random() < 0.75} | {(7, 7)}
    moves = {"east": (1, 0), "north": (0, -1), "south": (0, 1), "west": (-1, 0)}
    edges = [(x * 10 + y, (x + dx) * 10 + y + dy, name) for x, y in open_ for name, (dx, dy) in moves.items() if (x + dx, y + dy) in open_]
    far = {77: 0}
    for d in range(1, 70):
        far |= {s: d for s, t, _ in edges if far.get(t) == d - 1 and s not in far}
    got = {x["id"]: x for x in graph.shortest_actions(spark.createDataFrame(edges, "src long, dst long, action string"), spark.createDataFrame([(77,), (77,)], "id long")).collect()}
    assert {i: x["distance"] for i, x in got.items()} == far
    for i, x in got.items():
        best = min(((a, t) for s, t, a in edges if s == i and far.get(t) == far[i] - 1), default=(None, None))
        assert (x["action"], x["next"]) == best


def test_reachable_goes_on_until_nothing_is_new(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)], "src long, dst long")
    got = graph.reachable(chain, spark.createDataFrame([(0,)], "id long"))
    assert {r["id"]: r["distance"] for r in got.collect()} == {i: i for i in range(21)}


# feedback

MESSAGE = "learner long, ordinal long, kind string, action_id string, experience string, source string, unit string, step long, available_at long, target boolean"


def plain(messages, update_every=1, evaluate=False):
    """One learner after the other, message by message."""
    out = []
    for learner in sorted({m[0] for m in messages}):
        log, counted, queue, now, eligible = {}, set(), [], None, 0
        for _, o, kind, a, e, s, u, step, due, target in sorted(m for m in messages if m[0] == learner):
            if kind == "act":
                out.append((learner, o, kind, None, "repeated_action" if a in log else "logged", None, None, None))
                log.setdefault(a, (e, step))
            elif kind == "feedback":
                said = "no_action" if a not in log else "other_experience" if e != log[a][0] else "other_unit" if u != "model_step" else "before_action" if step < log[a][1] else "forged" if due < step else "repeated" if (a, s) in counted else "queued"
                if said == "queued":
                    counted.add((a, s)), queue.append((o, due, target))
                out.append((learner, o, kind, None, said, None, None, None))
            elif now is not None and step < now:
                out.append((learner, o, kind, None, "clock_back", None, None, None))
            else:
                now, ready = step, [q for q in queue if q[1] <= step]
                if evaluate and ready:
                    out.append((learner, o, kind, None, "evaluate_mode", None, None, None))
                    continue
                queue = [q for q in queue if q[1] > step]
                steps = (eligible + sum(q[2] for q in ready)) // update_every - eligible // update_every
                eligible += sum(q[2] for q in ready)
                out += [(learner, o, "applied", q[0], "applied", None, None, None) for q in ready]
                out.append((learner, o, kind, None, "updated", len(ready), steps, len(queue)))
    return sorted(out, key=repr)


def messages(seed, n=150, learners=2):
    r, out = random.Random(seed), []
    for learner in range(learners):
        now, acts = 0, []
        for o in range(n if learner == 0 else 25):
            now += r.randint(0, 3)
            kind = r.choice(["act", "feedback", "feedback", "update"])
            if kind == "act":
                acts.append((r.choice([f"act-{o}", f"act-{o}", "act-0"]), r.choice("xy"), now))
                out.append((learner, o, kind, acts[-1][0], acts[-1][1], None, "model_step", now, None, None))
            elif kind == "feedback":
                a, e, s = r.choice([*acts, ("act-none", "x", 0)])
                produced = s + r.randint(-1, 6)
                out.append((learner, o, kind, a, r.choice([e, e, e, "z"]), r.choice(["env", "env", "rater", None]), r.choice(["model_step"] * 6 + ["ms"]), produced, produced + r.randint(-1, 25), r.random() < 0.6))
            else:
                out.append((learner, o, kind, None, None, None, None, now - r.choice([0, 0, 0, 4]), None, None))
    return out


@pytest.mark.parametrize("seed,every,evaluate", [(0, 1, False), (1, 3, False), (2, 2, False), (3, 1, True)])
def test_feedback_table_equals_a_loop(spark, many_ranges, seed, every, evaluate):
    rows = messages(seed)
    got = feedback.settled(spark.createDataFrame(rows, MESSAGE).repartition(3), every, evaluate)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, every, evaluate)


def test_forged_times_duplicates_and_strangers_are_refused(spark):
    rows = [(0, 0, "act", "a", "x", None, "model_step", 5, None, None)] + [(0, i + 1, "feedback", *m) for i, m in enumerate([("b", "x", "env", "model_step", 6, 7, True), ("a", "y", "env", "model_step", 6, 7, True), ("a", "x", "env", "ms", 6, 7, True), ("a", "x", "env", "model_step", 4, 7, True), ("a", "x", "env", "model_step", 6, 5, True), ("a", "x", "env", "model_step", 6, 7, True), ("a", "x", "env", "model_step", 6, 6, True), ("a", "x", "rater", "model_step", 5, 5, True)])]
    got = {r["ordinal"]: r["verdict"] for r in feedback.settled(spark.createDataFrame(rows, MESSAGE)).collect()}
    assert got == dict(enumerate(["logged", "no_action", "other_experience", "other_unit", "before_action", "forged", "queued", "repeated", "queued"]))


@pytest.mark.parametrize("evaluate", [False, True])
def test_feedback_stream_equals_the_table(spark, tmp_path, evaluate):
    rows = messages(7, 120)
    store = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    (tmp_path / "in").mkdir()
    try:
        stream = spark.readStream.schema(MESSAGE).parquet(str(tmp_path / "in"))
        for k in range(3):
            spark.createDataFrame([m for m in rows if m[1] // 40 == k], MESSAGE).write.mode("append").parquet(str(tmp_path / "in"))
            q = feedback.settled_stream(stream, 2, evaluate).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            q.awaitTermination()
        assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=repr) == plain(rows, 2, evaluate)
    finally:
        spark.conf.unset(store)


def test_rates_and_their_bounds(spark):
    from axonlake.operators import metrics

    trace = spark.createDataFrame([(1, 0, 1), (1, 1, 1), (2, 0, 0), (2, 1, 1), (9, 0, 1)], "id long, step long, spike int")
    nodes = spark.createDataFrame([(1,), (2,), (3,), (3,)], "id long")
    rates = metrics.population_rates(trace, nodes)
    assert sorted(map(tuple, rates.collect())) == [(0, 1, 1 / 3), (1, 2, 2 / 3)]
    assert tuple(metrics.rate_quantiles(trace, nodes, 4).first()) == (0.0, 0.125, 0.25, 0.375, 0.5)
    assert metrics.stability_flags(rates, 1 / 3, 0.5, 0.7) == ["max_population_rate_exceeded", "min_active_fraction_below"]
    assert metrics.stability_flags(rates, 1 / 3, 0.7, 0.6) == metrics.stability_flags(rates, 1.0) == []


def test_trials_and_signals_out_of_order(spark, many_ranges):
    points = [("a", 0.0), ("a", 1.0), ("b", 0.0), ("b", 0.0), ("a", 2.0), ("", 3.0), ("c", -1.0), ("c", float("nan")), ("c", 5.0), ("c", 4.0), (None, 1.0)] + [("z", float(i)) for i in range(200)]
    df = spark.createDataFrame([(i, trial, t, 0.0, 0.0) for i, (trial, t) in enumerate(points)], "ordinal long, trial string, t double, x double, y double").repartition(3)
    got = {r["ordinal"]: r["problem"] for r in temporal.trial_problems(df).collect()}
    want = {3: "time_repeats", 4: "not_contiguous", 5: "no_trial", 6: "negative_time", 7: "not_finite", 8: None, 9: "time_regresses", 10: "no_trial"}
    assert got == {i: want.get(i) for i in range(len(points))}
    rows = [(i, 0, s, "c", q, t) for i, (s, q, t) in enumerate([("u", 2, 5), ("u", 1, 5), ("v", 1, 5), ("v", 1, 6), ("u", 7, 4)])]
    found = {r["ordinal"]: (r["position"], r["problem"]) for r in temporal.ordered_signals(spark.createDataFrame(rows, "ordinal long, experience long, stream string, channel string, sequence long, tick long")).collect()}
    assert found == {0: (3, None), 1: (1, None), 2: (2, None), 3: (4, "repeated"), 4: (0, "time_back")}


@pytest.mark.parametrize("most", [1_000_000, 20])
def test_rows_find_their_batch(spark, many_ranges, monkeypatch, most):
    from axonlake.operators import reports

    monkeypatch.setattr(scan, "SERIES", most)
    starts = [(b, 40 * b + 3) for b in range(9)] + [(20, 5000)]
    rows = [(i, f"r{i}") for i in [*range(400), 4999, 5000, 9999]] + [(7, "twice"), (None, "none")]
    got = reports.located(spark.createDataFrame(rows, "abs_row long, name string"), spark.createDataFrame(starts, "batch int, start long"))
    assert got.columns == ["abs_row", "name", "batch", "row"]
    want = []
    for i, name in rows:
        own = [(b, s) for b, s in starts if i is not None and s <= i]
        want.append((i, name, *((own[-1][0], i - own[-1][1]) if own else (None, None))))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
