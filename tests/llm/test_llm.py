"""The training-data operators against brute force, round trips and held-out labels, with nulls, empties, ties and repeats."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonlake.llm import chat, decontam, lmscore, mixing, neardup, pii, quality, sharding, topk, toxicity
from axonlake.llm.attention import CONTEXT, STEP, Attention, Scorer
from axonlake.llm.linear import Ftrl, featured

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, size string"
ODD = [(1, None, "b", "x"), (2, "", None, "x"), (3, "one two three", "a", None), (3, "one two three", "a", None), (None, "one  two\tthree", "é", "y"), (4, "word " * 5000, "b", "y"), (5, "\x0b \n", "b", "z")]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return (text or "").encode().lower().split()


# 1


def test_decontamination_finds_reparameterised_items(spark):
    items = [(1, "A train leaves Paris at 40 km per hour and meets Anna Bell after 3 hours on the way to the old town of Lyon today"), (2, "short one"), (3, None), (4, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [
        (1, "so: a train leaves Rome at 75 km per hour and meets Tom after 9 hours on the way to the old town of Pisa today, ok", "x"),
        (2, "nothing of the kind is said in this text about any train or any hour of any day in the week", "x"),
        (3, None, "x"),
        (4, "", None),
        (None, items[0][1], "x"),
        (5, "1 2 3 4 5 6 7 8 9 10 11 12 " * 50, "x"),
    ]
    got = {r["doc_id"]: r for r in decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string, item_id string"), bench).collect()}
    assert set(got) == {1, None}
    assert got[None]["exact"] and not got[1]["exact"]
    assert got[1]["slots"] > 0 and got[1]["consistent"] == got[1]["slots"]
    assert decontam.leaks(spark.createDataFrame([], "doc_id long, text string"), bench).count() == 0
    assert decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string, z string"), bench.limit(0)).count() == 0


def test_decontamination_rejects_inconsistent_slots(spark):
    bench = spark.createDataFrame([(1, "take 5 apples and then put 5 apples back on the table so that 5 apples are there and count 5 apples again")], "item_id long, text string")
    ok = "take 7 apples and then put 7 apples back on the table so that 7 apples are there and count 7 apples again"
    bad = "take 1 apples and then put 2 apples back on the table so that 3 apples are there and count 4 apples again"
    got = decontam.leaks(spark.createDataFrame([(1, ok), (2, bad)], "doc_id long, text string"), bench)
    assert [r["doc_id"] for r in got.collect()] == [1]


def test_decontamination_on_given_tables(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    clean = lambda t: re.sub(r"[^\w\s]", "", t.lower()).split()
    runs = {r["item_id"]: {tuple(clean(r["text"])[i : i + 8]) for i in range(max(1, len(clean(r["text"])) - 7))} for r in bench.collect()}
    want = set()
    for d in docs.collect():
        own = {tuple(clean(d["text"])[i : i + 8]) for i in range(len(clean(d["text"])))}
        want |= {(d["doc_id"], k) for k, v in runs.items() if len(v & own) >= 0.5 * len(v)}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()}
    assert want and want == got


APPLES = "take 5 apples and then put 5 apples back on the table so that 5 apples are there and count 5 apples again"


def leaking(spark, items, rows):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in decontam.leaks(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), bench).collect()}


def test_template_words_and_fills_are_aligned(spark):
    text = "on 2020-01-05 at 10:30 we met in Paris, London or New York City the 1st time, 5km or 3.5 kg off; a#b covid19 Anna's"
    row = spark.createDataFrame([(text,)], "text string").select(decontam.template(F.col("text")).alias("w"), decontam.slots(F.col("text")).alias("f")).first()
    got = [(w, f) for w, f in zip(row["w"], row["f"], strict=True) if f]
    assert got == [("###", ["2020", "01", "05"]), ("##", ["10", "30"]), ("^", ["paris"]), ("^", ["london"]), ("^", ["new\u0003york\u0003city"]), ("#st", ["1"]), ("#", ["5"]), ("~", ["km"]), ("#", ["3.5"]), ("~", ["kg"]), ("covid#", ["19"])]
    assert all(sum(map(w.count, "#~^")) == len(f) for w, f in zip(row["w"], row["f"], strict=True))


def test_decontamination_finds_copies_after_any_slots(spark):
    before = ["posted on 2020-01-05 by me: ", "the 1st of them at 10:30 says: ", "we went to Paris, London and then: ", "covid19 in h2o, she said: "]
    got = leaking(spark, [APPLES], [b + APPLES for b in before])
    assert set(got) == {(k, 0) for k in range(len(before))} and all(r["exact"] for r in got.values())


def test_decontamination_judges_every_place_of_an_item(spark):
    bad = "take 1 apples and then put 2 apples back on the table so that 3 apples are there and count 4 apples again"
    got = leaking(spark, [APPLES], [f"{bad}. {APPLES}", f"{APPLES}. {bad}", f"{bad}. {bad}"])
    assert set(got) == {(0, 0), (1, 0)} and all(r["exact"] for r in got.values())


def test_decontamination_finds_exact_copies_with_few_literals(spark):
    items = ["What is 3 + 4 * 5 - 6 / 2?", "Compute 12 + 7, 15 - 9, 8 * 6, 40 / 5 and 31 - 4", "1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89"]
    other = [re.sub("[0-9]+", lambda m: str(int(m[0]) + 1), t) for t in items]
    got = leaking(spark, items, [f"on 2020-01-05 they asked: {t} Nobody knew" for t in items + other])
    assert set(got) == {(k, k) for k in range(len(items))} and all(r["exact"] for r in got.values())


def test_decontamination_keeps_templates_of_items_with_low_windows(spark):
    item = "if a farmer has seven old cows then how many are 3 + 4 * 5 - 6 / 2 * 8 + 9 - 1 + 7 * 5 - 2"
    copy = re.sub("[0-9]+", lambda m: str(int(m[0]) + 10), item)
    got = leaking(spark, [item], [item, copy])
    assert set(got) == {(0, 0), (1, 0)} and got[0, 0]["exact"] and not got[1, 0]["exact"]


# 2


def plain_water_fill(sizes, weights, total, epochs):
    """Source by source, clamped ones taken out until none is above."""
    free, out = set(range(len(sizes))), [epochs * n for n in sizes]
    while True:
        rest, weight = total - sum(out[i] for i in range(len(sizes)) if i not in free), sum(weights[i] for i in free)
        share = {i: weights[i] * rest / weight if weight else 0.0 for i in free}
        above = {i for i in free if share[i] > epochs * sizes[i]}
        if not above:
            return [share.get(i, out[i]) for i in range(len(sizes))]
        free -= above


def test_water_filling_gives_excess_to_the_rest(spark):
    rng = np.random.default_rng(8)
    cases = [([10, 100, 100], [1.0, 1.0, 1.0], 150.0), ([5, 7], [1.0, 0.0], 100.0), (rng.integers(0, 50, 40).tolist(), rng.integers(1, 9, 40).astype(float).tolist(), 1500.0)]
    for sizes, weights, total in cases:
        got = mixing.water_fill(spark.createDataFrame([(i, n, w) for i, (n, w) in enumerate(zip(sizes, weights, strict=True))], "i long, size long, weight double"), total, 2)
        assert np.allclose([r["target"] for r in got.orderBy("i").collect()], plain_water_fill(sizes, weights, total, 2))
    assert plain_water_fill([10, 100, 100], [1, 1, 1], 150, 2) == [20, 65, 65]
    assert mixing.water_fill(spark.createDataFrame([], "size long, weight double"), 0.0, 2).count() == 0


def test_sources_are_numbered_by_code_point(spark):
    names = ["b", "é", None, "a", "Z", "\U0001f600", "\uffee"]
    got = mixing.numbered(spark.createDataFrame([(n,) for n in names], "source string"), [F.col("source").asc_nulls_last()]).collect()
    assert {r["source"]: r["number"] for r in got} == {n: k for k, n in enumerate([*sorted(filter(None, names)), None])}


def test_mix_handles_odd_rows(odd, none):
    got = mixing.mix(odd, mixing.word_count(), keep=["doc_id", "text", "source", "size"]).collect()
    assert len(got) == len(ODD) and {r["source_size"] for r in got if r["source"] == "b"} == {5000}
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(none, mixing.word_count()).count() == 0


def test_mix_comes_near_its_targets_and_reruns_agree(docs):
    run = lambda: sorted(map(tuple, mixing.mix(docs, mixing.word_count(), keep=["doc_id", "source"]).collect()))
    rows = run()
    assert rows == run()
    by = {}
    for _, source, size, total, target, _, taken in rows:
        by.setdefault(source, [target, total, 0, 0])[2] += taken
        by[source][3] = max(by[source][3], size)
    assert all(abs(taken - target) <= most for target, _, taken, most in by.values())
    assert math.isclose(sum(v[0] for v in by.values()), 1.5 * sum(v[1] for v in by.values()))


# 3


def test_chain_learns_and_feeds_forward(docs, spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    some = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    models = toxicity.learn(some, labels.where("doc_id % 4 <> 1"))
    test = toxicity.scored(some, models).join(labels.where("doc_id % 4 = 1"), "doc_id").toPandas()
    assert len(models) == 3 and all(len(m.z) == toxicity.SIZE + 3 for m in models)
    assert (test["rejected"] == (test["toxic"] == 1)).mean() > 0.93
    assert test.loc[test["toxic"] == 0, "rejected"].mean() < 0.02


def plain_ftrl(rows, labels, order, alpha, l1, beta=1.0, l2=1.0):
    """Follow the regularised leader, feature by feature; gives the margin of a row."""
    z, n = Counter(), Counter()

    def weight(i):
        if i == "bias":
            return -z[i] / ((beta + math.sqrt(n[i])) / alpha)
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    def margin(row):
        return sum(weight(i) * x for i, x in row) + weight("bias")

    for k in order:
        row = [(int(i), float(x)) for i, x in zip(*rows[k], strict=True)]
        weights, g = {i: weight(i) for i, _ in [*row, ("bias", 1.0)]}, 1 / (1 + math.exp(-margin(row))) - labels[k]
        for i, x in [*row, ("bias", 1.0)]:
            z[i] += g * x - (math.sqrt(n[i] + (g * x) ** 2) - math.sqrt(n[i])) / alpha * weights[i]
            n[i] += (g * x) ** 2
    return margin


def some_rows(n=60):
    rng = np.random.default_rng(6)
    rows = [(np.sort(rng.choice(40, 6, replace=False)), rng.uniform(0.5, 1, 6)) for _ in range(n)]
    return rows, np.array([float(3 in at or 5 in at) for at, _ in rows])


def test_ftrl_equals_a_plain_loop():
    rows, y = some_rows()
    model, rng = Ftrl(40, alpha=0.3, l1=0.5).fit(rows, y, epochs=2, seed=3), np.random.default_rng(3)
    margin = plain_ftrl(rows, y, np.concatenate([rng.permutation(60) for _ in range(2)]), 0.3, 0.5)
    for at, x in rows:
        assert math.isclose(model.weights(at) @ x + model.bias(), margin(list(zip(at.tolist(), x.tolist(), strict=True))), rel_tol=1e-9, abs_tol=1e-12)


def test_chain_equals_a_plain_loop():
    rows, y = some_rows()
    rows = [(at, np.ones(6)) for at, _ in rows] + [(rows[0][0], np.ones(6))]
    y = np.append(y, y[0])
    labels, fold = toxicity.kinds(rows, y), toxicity.folds_of(rows)
    assert ((labels[0] + labels[1]) == y).all() and labels[0].any() and labels[1].any() and fold[0] == fold[-1]
    models, chain = toxicity.fit_chain(rows, labels), [[] for _ in rows]
    for c, own in enumerate(labels):
        with_chain = [[*zip(at.tolist(), x.tolist(), strict=True), *((toxicity.SIZE + k, p) for k, p in enumerate(ps))] for (at, x), ps in zip(rows, chain, strict=True)]
        as_arrays = [tuple(map(np.array, zip(*r, strict=True))) for r in with_chain]

        def fitted(part, own=own, as_arrays=as_arrays):
            rng = np.random.default_rng(0)
            return plain_ftrl([as_arrays[i] for i in part], own[part], np.concatenate([rng.permutation(len(part)) for _ in range(3)]), 0.3, 1.5)

        whole = fitted(np.arange(len(rows)))
        for r, a in zip(with_chain, as_arrays, strict=True):
            assert math.isclose(models[c].weights(a[0].astype(int)) @ a[1] + models[c].bias(), whole(r), rel_tol=1e-6, abs_tol=1e-9)
        for k in range(toxicity.FOLDS):
            blind = fitted(np.flatnonzero(fold != k))
            for i in np.flatnonzero(fold == k):
                chain[i] = [*chain[i], 1 / (1 + math.exp(-blind(with_chain[i])))]


def test_a_repeated_id_trains_once(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (2, "x " * 9000)], "doc_id long, text string")
    rows, y = featured(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"), toxicity.counted, "toxic")
    assert y.tolist() == [1.0, 0.0] and len(rows[1][0]) == 4 * 2


def test_trained_chain_on_odd_rows(spark, odd):
    docs = spark.createDataFrame([(i, f"word{i % 7} other{i % 5} " + "vile " * (i % 3 == 0)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    models = toxicity.learn(docs, labels)
    rows = odd.select("doc_id", "text", F.lit("x").alias("p_toxic")).union(spark.createDataFrame([(9, "vile", "x"), (9, "vile", "x"), (8, "vile " * 90_000, "x")], "doc_id long, text string, p_toxic string"))
    got = toxicity.scored(rows, models).collect()
    assert len(got) == len(ODD) + 3 and got[0].__fields__ == ["doc_id", "p_kind_1", "p_kind_2", "p_toxic", "rejected"]
    assert [r["rejected"] for r in got if r["doc_id"] == 9] == [True, True] and len({tuple(r) for r in got if r["doc_id"] in (3, 9)}) == 2


def test_chain_of_nothing_rejects_nothing(odd, none, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.scored(odd, toxicity.learn(odd, labels)).collect()
    assert len(got) == len(ODD) and not any(r["rejected"] for r in got)
    labels = spark.createDataFrame([(3, 1, None), (None, 1, 1), (4, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.scored(none, toxicity.learn(odd, labels)).count() == 0


# 4

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for k, (name, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0
            if name == "email" or name == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or name == "card" and 12 <= len(d) <= 19 and luhn or name == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), k, m.end(), name))
    return [f"{n}:{s}:{e}" for s, _, e, n in sorted(out)]


def test_base_spans_equal_brute_force(spark, docs):
    more = [(-1, None), (-2, ""), (-3, "a@b.c_d@e.f x@y 1.2.3.4.5.6.7.8 256.1.1.1 é😀 +1 (555) 123-4567 4111 1111 1111 1111-"), (-4, "mail bob (at) mail.com, tel 555-123-4567"), (-5, "9" * 20000 + " " + "a." * 10000 + "@"), (None, "x@y.z"), (-6, "1-" * 20000)]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    for r in pii.personal_data(rows).collect():
        want = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(filter(None, r["spans"].split(",")))
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(x.startswith(k) for x in want) for k in PATTERNS]


def test_labelers_add_likely_spans(spark):
    text = "please mail bob.ross (at) mail.com or phone 555-123-4567 about it; version 1.22.333.4444"
    rows = spark.createDataFrame([(i, f"contact a{i}@mail.com, phone +1 (555) 123-{1000 + i}, 10.0.0.{i}") for i in range(40)] + [(99, text)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.personal_data(rows).collect()}
    assert got[99]["added"] >= 1 and f"email:{text.index('bob')}:{text.index('.com') + 4}" in got[99]["spans"]
    assert pii.personal_data(rows.limit(0)).count() == 0


# 5


def test_shards_are_contiguous_and_balanced(docs, odd, none):
    rows = sorted(sharding.contiguous_shards(docs, sharding.text_bytes(), ["doc_id"]).select("doc_id", "size", "shard", "slot").collect())
    assert [r["shard"] for r in rows] == sorted(r["shard"] for r in rows)
    total, most = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for k, own in itertools.groupby(rows, key=lambda r: r["shard"]):
        own = list(own)
        assert [r["slot"] for r in own] == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 8) <= most, k
    got = sharding.contiguous_shards(odd, sharding.text_bytes(), ["doc_id"], 3).collect()
    assert len(got) == len(ODD) and got[0].asDict().keys() >= {"text", "source", "size", "shard", "slot"}
    assert sharding.contiguous_shards(none, sharding.text_bytes(), ["doc_id"]).count() == 0


def test_one_repeated_key_is_cut_apart(spark):
    rows = spark.range(1000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    got = sharding.contiguous_shards(rows, sharding.text_bytes(), ["doc_id"]).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [125] * 8


# 6


def test_word_scores_equal_brute_force(docs, odd, spark, monkeypatch):
    monkeypatch.setattr(lmscore, "COMMON_WORDS", 500)
    rows = docs.select("doc_id", "text").union(odd.select(F.col("doc_id") + 10_000, "text"))
    own, counts = {}, Counter()
    for r in rows.collect():
        own.setdefault(r["doc_id"], []).append([*words(r["text"]), b""])
        if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1:
            counts.update([*words(r["text"]), b""])
    n, v = sum(counts.values()), len(counts)
    for r in lmscore.score_documents(rows).collect():
        w = own[r["doc_id"]][0]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
        assert r["score"] < 0


def some_model(tokens=96, dtype=np.float64):
    """A small model with weights far from their first values."""
    rng = np.random.default_rng(5)
    pairs = rng.normal(size=(tokens, tokens))
    model = Attention(pairs - np.log(np.exp(pairs).sum(axis=1, keepdims=True)), width=8)
    model.w = {k: (v + rng.normal(0, 0.3, v.shape)).astype(dtype) for k, v in model.w.items()}
    return model


def test_attention_is_causal_and_its_gradients_are_right():
    rng, model = np.random.default_rng(1), some_model()
    ids, y = rng.integers(0, 96, (3, 9)), rng.integers(0, 96, (3, 9))
    y[2, 5:] = -1
    base = model.log_prob_all(ids)
    other = ids.copy()
    other[:, 6:] = (other[:, 6:] + 1) % 96
    assert np.allclose(base[:, :6], model.log_prob_all(other)[:, :6]) and np.allclose(np.exp(base).sum(axis=2), 1)
    loss, grads = model.gradients(ids, y)
    own = np.take_along_axis(base, np.maximum(y, 0)[:, :, None], 2)[:, :, 0]
    assert math.isclose(loss, -own[y >= 0].mean(), rel_tol=1e-5)
    for k, w in model.w.items():
        at = np.unravel_index(int(np.argmax(np.abs(grads[k]))), w.shape)
        keep = w[at]
        w[at] = keep + 1e-4
        up = model.gradients(ids, y)[0]
        w[at] = keep - 1e-4
        down = model.gradients(ids, y)[0]
        w[at] = keep
        assert math.isclose((up - down) / 2e-4, grads[k][at], rel_tol=1e-2, abs_tol=1e-6), k


def test_scored_log_probabilities_equal_the_plain_form():
    rng, model = np.random.default_rng(2), some_model(dtype=np.float32)
    ids, y = rng.integers(0, 96, (7, CONTEXT)), rng.integers(0, 96, (7, CONTEXT))
    want = np.take_along_axis(model.log_prob_all(ids), y[:, :, None], 2)[:, :, 0]
    assert np.allclose(Scorer(model).log_prob(ids, y), want, atol=1e-4)
    model.w["qkv"] *= 20  # exponents out of range
    model.w["within"] *= 100
    want = np.take_along_axis(model.log_prob_all(ids), y[:, :, None], 2)[:, :, 0]
    assert np.allclose(np.maximum(Scorer(model).log_prob(ids, y), -80), np.maximum(want, -80), atol=1e-2)


def test_windows_score_each_place_once():
    n = np.array([1, 5, CONTEXT, CONTEXT + 1, 100, 1000])
    row, start, first = lmscore.windows(n)
    for k in range(len(n)):
        seen = [p for r, s, f in zip(row, start, first, strict=True) if r == k for p in range(s + f, min(s + CONTEXT, n[k]))]
        assert seen == list(range(n[k]))


def test_scores_of_rows_equal_a_loop_over_places():
    rng, model = np.random.default_rng(3), some_model(dtype=np.float32)
    rows = [rng.integers(1, 96, n) for n in (0, 3, 31, 32, 90)]
    seq, start = np.concatenate([[0], *(np.append(r, 0) for r in rows)]), np.append(0, np.cumsum([len(r) + 1 for r in rows]))
    for k, r in enumerate(rows):
        own, total = np.concatenate([[0], r, [0]]), 0.0
        for p in range(len(r) + 1):
            window = 0 if p < CONTEXT else -(-(p + 1 - CONTEXT) // STEP)
            total += model.log_prob_all(own[None, STEP * window : p + 1])[0, -1, own[p + 1]]
        assert math.isclose(lmscore._log_probs(Scorer(model), seq, start)[k], total, rel_tol=1e-4)


def test_windows_are_drawn_over_all_rows_and_places():
    places = np.array([1, 5, CONTEXT, CONTEXT + 8, 1] * 2000)
    row, at = lmscore.drawn(np.arange(10_000), places, 1.5)
    assert abs(len(row) - 15_000) < 300 and (np.bincount(row, minlength=10_000) >= 1).all()
    assert set(at[places[row] <= CONTEXT]) == {0} and set(at[places[row] == CONTEXT + 8]) == set(range(9))
    again = lmscore.drawn(np.arange(10_000), places, 1.5)
    assert (row == again[0]).all() and (at == again[1]).all()
    x, y = lmscore._padded([np.array([3, 1, 2, 3]), np.arange(CONTEXT + 1)], np.arange(50))
    assert x[0, :4].tolist() == [3, 1, 2, 0] and y[0, :4].tolist() == [1, 2, 3, -1] and (y[1] == np.arange(1, CONTEXT + 1)).all()


def test_model_ids_are_of_all_rows(spark, monkeypatch):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 4998, "zebra zebra zebra").otherwise("a b c").alias("text"))
    seen = {}
    monkeypatch.setattr(lmscore, "_attention", lambda counts, size, f=lmscore._attention: seen.setdefault("model", f(counts, size)))
    assert lmscore.score_documents(docs).count() == 5000
    sub = lmscore.Subwords(lmscore.Path(lmscore.TOKENIZER).read_bytes())
    ids = [seen["model"][1][sub.of([w])[0]].tolist() for w in (b"zebra", b"a", b"b", b"c")]
    assert len({x for own in ids for x in own}) == sum(map(len, ids))  # none shares the id of all others


def test_attention_scores_held_out_text_above_word_counts(spark):
    got = lmscore.op6_lmscore(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_score_of_nothing(spark, none):
    assert lmscore.score_documents(none).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    got = lmscore.score_documents(spark.createDataFrame([(held, "one  two", 1)], "doc_id long, text string, n long")).first()
    assert (got["held_out"], got["n_tokens"], got["n_known"], got["train_tokens"]) == (True, 3, 0, 0) and math.isclose(got["base_score"], 0.0)


# 7


def test_quality_is_learned(spark, odd, none):
    d = "/root/testdata/sf0.01"
    rows, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.learn(rows, labels)
    got = quality.scored(rows, model).join(labels, "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.95
    got = quality.scored(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert quality.scored(none, model).count() == 0
    nothing = quality.learn(rows, labels.limit(0))
    assert {r["score"] for r in quality.scored(odd, nothing).collect()} == {0.5}


# 8


def marks(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows, percent=85):
    sets = [(i, marks(t)) for i, t in rows]
    top = {i: i for i, _ in rows}

    def f(x):
        while top[x] != x:
            x = top[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b) and f(i) != f(j):
            top[max(f(i), f(j))] = min(f(i), f(j))
    return {i: f(i) for i, _ in rows}


def near_copies(rng, n, length=150, edits=2):
    base = [f"w{rng.integers(1e6)}" for _ in range(length)]
    out = []
    for _ in range(n):
        own = list(base)
        for p in rng.integers(0, length, edits):
            own[p] = f"x{rng.integers(1e6)}"
        out.append(" ".join(own))
    return out


def test_near_duplicates_equal_brute_force(spark, docs, monkeypatch):
    rng = np.random.default_rng(3)
    texts = near_copies(rng, 60) + near_copies(rng, 60, edits=4) + near_copies(rng, 30, length=40, edits=1) + ["a b c", "A b  c", "a b", "", None, "a b c d e"]
    rows = [(i, t) for i, t in enumerate(texts)]
    want = brute_components(rows)
    for block, few in ((2048, 100_000), (16, 0)):  # large buckets in blocks; components by rounds of jobs
        monkeypatch.setattr(neardup, "BLOCK", block)
        monkeypatch.setattr(neardup, "FEW_LINKS", few)
        monkeypatch.setattr(neardup, "CELL_NODES", 400 if few else 10)
        got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) and r["n_shingles"] == len(marks(texts[r["doc_id"]])) for r in got)


def test_near_duplicates_of_odd_rows(odd, none):
    got = sorted(neardup.near_duplicates(odd).collect(), key=str)
    assert len(got) == len(ODD) and {r["component_id"] for r in got if r["n_shingles"] == 1 and r["doc_id"] != 4} == {3}
    assert all(r["kept"] for r in got if r["n_shingles"] == 0)
    assert neardup.near_duplicates(none).count() == 0


def test_chunks_follow_the_similarity():
    assert neardup.layout(85) == (5, 15) and neardup.layout(80) == (4, 19) and neardup.layout(50)[1] > 30


def test_near_duplicates_of_string_ids(spark):
    rows = [("b", "one two three four five six", 1), ("a", "One two  three four five six", 2), ("c", "nothing of the kind", 3), (None, "one two three four five six", 4)]
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string, node int")).collect()}
    assert got == {"a": ("a", True), "b": ("a", False), "c": ("c", True), None: ("a", False)}


def test_components_by_rounds(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FEW_LINKS", 0)
    links = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 150), (-5, 150), (7, 7)]
    got = {r["node"]: r["comp"] for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys((100, 200, 150, -5), -5)}


# 9


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 2)
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(300, 8)) + 9 * (rng.integers(4, size=(300, 1)) == np.arange(8)), rng.normal(size=(300, 8))]).astype(np.float32)
    x[50:160] = x[0]  # more of one vector than a shard holds
    rows = [(i if i != 599 else 200, v.tolist()) for i, v in enumerate(x)]  # id 200 twice
    odd = [(700, None), (800, [None] + [1.0] * 7), (900, [float("nan")] * 8), (1000, []), (None, [1.0] * 8), (1100, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows + odd], "vec_id long, embedding array<float>, shard string, row int")
    v = topk.vectors(df)
    got = topk.top_k(v, v.where("vec_id % 100 = 0")).collect()
    whole, ids, want = np.floor(1024 * x.astype(float)).astype(np.int64), [i for i, _ in rows], []
    for q in range(600):
        if ids[q] % 100 == 0:
            s = whole @ whole[q]
            want += [(ids[q], k + 1, i, -n) for k, (n, i) in enumerate(sorted((-s[i], ids[i]) for i in range(600) if i != q)[:10])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_cells_that_can_not_reach_the_floor_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 50)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 4)) * 0.01 + np.where(rng.integers(2, size=(400, 1)) > 0, 1, -1)
    seen = []
    monkeypatch.setattr(topk, "stash", lambda df, name, f=topk.stash: seen.append((name, out := f(df, name))) or out)
    v = topk.vectors(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>"))
    assert topk.top_k(v, v.where("vec_id % 100 = 0")).count() == 40
    made = dict(seen)
    cells, shards, visits = made["shards"].count(), made["shards"].agg(F.sum("shards")).first()[0], made["visits"].count()
    assert cells >= 8 and visits < 0.6 * 4 * shards


def test_top_k_of_few_and_of_large_values(spark):
    rows = spark.createDataFrame([(100, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1.0, 1.0]), (2, [-1.0, 1.0]), (3, [1e306, 1.0])], "vec_id long, embedding array<double>")
    got = topk.top_k(v := topk.vectors(rows), v.where("vec_id % 100 = 0")).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 2]
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0
    assert topk.top_k(v, v.limit(0)).count() == 0


# 10


def cheapest(roles):
    """Brute force over all ways: each turn is merged or placed with some role after some insertions."""
    best = {0: 0}
    for role in roles:
        own, new = chat.ROLES.index(role) + 1 if role in chat.ROLES else 0, {}
        other = chat.RELABEL if own else chat.NAME
        for p, c in best.items():
            options = [(p, chat.MERGE + other * (own != p))] if p else []
            frontier = {(p, 0)}
            for _ in range(4):
                for s, k in list(frontier):
                    options += [(q, chat.INSERT * k + other * (own != q)) for q in chat.NEXT[s]]
                frontier = {(q, k + 1) for s, k in frontier for q in chat.NEXT[s]}
            for q, d in options:
                new[q] = min(new.get(q, 1 << 30), c + d)
        best = new
    return min(c + chat.AT_END[p] for p, c in best.items())


def test_repair_is_cheapest_and_legal():
    for n in range(1, 6):
        for roles in itertools.product([*chat.ROLES, None], repeat=n):
            cost, steps = chat.repair(list(roles))
            text, _ = chat.rendered(steps, ["t"] * n, True)
            assert cost + chat.AT_END[steps[-1][1]] == cheapest(roles)
            out = re.findall(r"<\|(system|user|assistant)\|>", text)
            assert re.fullmatch("(system )?(user assistant )+", "".join(x + " " for x in out)) and text.endswith("<|end|>\n")


def test_two_turns_of_a_user_stay_the_users():
    assert [s[2] for s in chat.repair(["user", "user"])[1]] == ["keep", "merge"]
    assert [s[1:] for s in chat.repair(["user", None])[1]] == [(2, "keep"), (3, "relabel")]


def test_text_of_a_conversation_does_not_depend_on_chunks_or_partitions(spark, monkeypatch):
    rng = np.random.default_rng(2)
    some = lambda: ["user", "assistant", "system", None, "tool"][rng.integers(5)]
    rows = [(1, i, some(), f"t{i} <|end|>") for i in range(300)] + [(2, 0, "user", None), (2, 0, "user", None), (None, None, None, "x")]
    rows += [(4, 7, some(), f"u{i:03d}") for i in range(90)]  # all of one turn number
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, part string")
    order = sorted(rows[303:], key=lambda r: (r[2] is not None, r[2] or "", r[3]))
    want = {}
    for c, own in ((1, rows[:300]), (2, rows[300:302]), (None, rows[302:303]), (4, order)):
        cost, steps = chat.repair([r[2] for r in own])
        text, _ = chat.rendered(steps, [r[3] for r in own], True)
        want[c] = (text, cost + chat.AT_END[steps[-1][1]], len(own))
    assert want[2][0] == "<|user|>\n\n<|end|>\n<|assistant|>\n<|end|>\n" and want[None][0].startswith("<|user|>\nx")
    opened = re.findall(r"<\|(system|user|assistant)\|>", want[1][0])
    assert re.fullmatch("(system )?(user assistant )+", "".join(x + " " for x in opened)) and want[1][0].count("<|end|>") == len(opened)
    assert [f"t{i} " in want[1][0] for i in range(300)] == [True] * 300
    for turns, parts, fan in ((1, 4, 3), (7, 8, 4), (7, 1, 256), (1000, 4, 256)):
        monkeypatch.setattr(chat, "FAN", fan)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = sorted((r for r in chat.format_chats(df, turns).collect()), key=lambda r: r["chunk"])
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        for c in want:
            own = [r for r in got if r["conv_id"] == c]
            assert [r["chunk"] for r in own] == list(range(len(own)))
            assert ("".join(r["rendered"] for r in own), sum(r["cost"] for r in own), sum(r["n_turns"] for r in own)) == want[c]
        assert (len([r for r in got if r["conv_id"] == 1]) >= 43) == (turns < 1000)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_rows_of_a_conversation_follow_the_count_of_its_turns(spark):
    far = 1_700_000_000_000
    rows = [(1, 252 + i) for i in range(10)] + [(2, far + 977 * i * i) for i in range(6)] + [(3, far * (i % 7) + i) for i in range(600)] + [(4, -(2**63)), (4, 2**63 - 1), (4, None)] + [(5, None)] * 300 + [(6, i - 40) for i in range(256)]
    df = spark.createDataFrame([(c, t, "user" if k % 2 else "assistant", f"x{k}") for k, (c, t) in enumerate(rows)], "conv_id long, turn long, role string, text string")
    got = chat.format_chats(df).collect()
    found = {c: sorted((r["chunk"], r["chunks"], r["n_turns"]) for r in got if r["conv_id"] == c) for c in range(1, 7)}
    assert all(found[c] == [(0, 1, n)] for c, n in ((1, 10), (2, 6), (4, 3), (6, 256)))
    for c, n in ((3, 600), (5, 300)):
        assert 2 <= len(found[c]) <= 8 and [x[:2] for x in found[c]] == [(k, len(found[c])) for k in range(len(found[c]))] and sum(x[2] for x in found[c]) == n
