"""Cases of the findings of round 3."""

import math
import os
import re
import types
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from axonlake.functions import basic
import corpus_pipeline
from axonlake.llm import attention, lmscore, mixing, sharding, toxicity
from axonlake.operators import containment, derive, digest, retrieval, temporal
from axonlake.plans import catalog, graph_queries

SQL = catalog.oracle_sql()


def from_sql(name, rewrite=lambda s: s, **tables):
    """Rows of a query's SQL over Arrow tables."""
    con = duckdb.connect()
    for k, v in tables.items():
        con.register(k, v)
    return sorted(con.execute(rewrite(SQL[name])).fetchall(), key=repr)


def given(path, **tables):
    for k, v in tables.items():
        pq.write_table(v, os.path.join(path, f"{k}.parquet"))
    return str(path)


# F2


def test_nearest_by_rounded_cosine_equals_the_sql(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5)).astype(np.float32)
    x[200:] = x[:200]  # copies, and neighbours that differ beyond the sixth place
    x[100:150] = x[150:200] * np.float32(1 + 1e-4) + np.float32(1e-6)
    table = pa.table({"vec_id": pa.array(rng.permutation(400), pa.int64()), "embedding": pa.array(list(x), pa.list_(pa.float32())), "label": pa.array([int(v) if v else None for v in rng.integers(0, 3, 400)], pa.int32())})
    want = from_sql("retrieval_top1", embeddings=table)
    path = given(tmp_path, embeddings=table)
    query = lambda: sorted(map(tuple, catalog.queries()["retrieval_top1"](spark, path).collect()), key=repr)
    assert query() == want
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    monkeypatch.setattr(retrieval, "ROWS", 7)
    assert query() == want


def test_nearest_shuffles_no_pairs(spark, capsys):
    e = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.0, 0.0], 1), (3, [1.0, 1.0], None), (4, None, 1), (5, [1.0], 1)], "vec_id long, embedding array<double>, label int")
    df = retrieval.nearest(e, e)
    assert sorted(map(tuple, df.collect())) == [(1, 3, None, 0.707107), (3, 1, None, 0.707107)]
    df.explain()
    assert "Join" not in capsys.readouterr().out
    assert retrieval.nearest(e.limit(0), e).count() == 0


# F3


def test_looks_ahead_do_not_read_a_shrinking_frame_anew(spark, capsys):
    for name in ("feedback_settled", "asof_linear"):
        catalog.queries()[name](spark, "/root/testdata/sf0.001").explain()
    assert "unboundedfollowing" not in capsys.readouterr().out


# F4


@pytest.mark.parametrize("steps", [1, 3])
def test_steps_are_exact_a_tick_beside_a_border(spark, steps):
    by = 3_600_000_000
    ticks = [s * k * by + d for s in (-1, 1) for k in (0, 1, 7, 10**6) for d in (-1, 0, 1)]
    df = spark.createDataFrame([(t,) for t in ticks], "tick long")
    got = temporal.pulse_align(df, by, steps).collect()
    assert {r["tick"]: r["step"] for r in got} == {t: -(-t * steps // by) for t in ticks}
    floors = df.select("tick", basic.floor_steps(F.col("tick"), by, steps).alias("step")).collect()
    assert {r["tick"]: r["step"] for r in floors} == {t: t * steps // by for t in ticks}


def test_pulses_equal_the_sql_a_tick_after_an_hour(spark, tmp_path):
    start = 1_704_067_200_000_000
    events = pa.table({"event_id": range(6), "ts": pa.array([start + d for d in (0, 1, 1700, 3_600_000_000, 3_600_000_001, 3_599_999_999)], pa.timestamp("us")), "user_id": [1] * 6, "event_type": ["a"] * 6, "value": [1.0] * 6})
    got = catalog.queries()["pulse_align"](spark, given(tmp_path, events=events)).collect()
    assert sorted(map(tuple, got), key=repr) == from_sql("pulse_align", events=events)


# F5


@pytest.mark.parametrize("n", [0, 1, 4, 5, 16, 17, 21, 40, 64])
def test_digest_of_two_levels_equals_its_sql_beyond_two_blocks(spark, tmp_path, monkeypatch, n):
    monkeypatch.setattr(digest, "BLOCK", 4)
    lines = pa.table({"l_orderkey": pa.array([i // 3 for i in range(n)], pa.int64()), "l_linenumber": pa.array([i % 3 for i in range(n)], pa.int32()), "l_partkey": pa.array([i * 7 % 11 for i in range(n)], pa.int64())})
    got = catalog.queries()["ordered_tree_digest"](spark, given(tmp_path, lineitem=lines)).collect()
    if n:
        assert list(map(tuple, got)) == from_sql("ordered_tree_digest", lambda s: s.replace("4096", "4"), lineitem=lines)
    else:
        assert got[0]["rows"] == 0


# F6


def test_largest_mean_is_that_of_the_rounded_means(spark, tmp_path):
    lines = pa.table({"l_suppkey": [1, 1, 1, 2], "l_returnflag": ["A"] * 4, "l_discount": [0.05, 0.05, 0.05, 0.01], "l_tax": [0.02] * 4, "l_quantity": [25.0, 25.0, 25.0001, 4.0]})
    got = catalog.queries()["pair_mean_argmax"](spark, given(tmp_path, lineitem=lines)).collect()
    assert sorted(map(tuple, got), key=repr) == from_sql("pair_mean_argmax", lineitem=lines)
    li = spark.createDataFrame([(1, 0.5, 0.5000001)], "k long, a double, b double")
    assert [derive.pair_means(li, ["k"], ["a", "b"], p).first()["best"] for p in (None, 6)] == [1, 0]


# F1


def test_words_of_a_batch_of_several_chunks_are_those_of_the_texts(monkeypatch):
    monkeypatch.setattr(lmscore, "CHUNK_BYTES", 2_000)
    texts = [None if i % 17 == 0 else f"Wörd{i} É " * (i % 40) + "END" for i in range(300)]
    seen = []
    for c in lmscore._chunks(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})):
        words = c.words.to_pylist()
        rows = [[] for _ in range(c.rows)]
        for code, row in zip(c.code.tolist(), c.row.tolist(), strict=True):
            rows[row].append(words[code])
        seen += rows
    assert seen == [(t or "").encode().lower().split() for t in texts]


def test_exact_columns_over_several_chunks_equal_plain_counts(spark):
    rows = [(i, f"W{i % 900} É{i % 7} " * 1_000) for i in range(1_200)]  # 12 MB in one batch
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for i, t in rows if not held(i) for w in [*t.encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in lmscore.score_documents(df).collect()}
    for i, t in rows[::37]:
        w, r = [*t.encode().lower().split(), b""], got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(w), sum(counts[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)


# pipeline, sharding


def test_shards_of_rows_that_travel_as_runs_are_those_of_rows(spark):
    rows = [(i if i % 9 else None, None if i % 11 == 0 else "é" * (i % 13), None if i % 2 else float("nan")) for i in range(60)]
    for columns, kind in ((2, "doc_id long, text string"), (3, "doc_id long, text string, x double")):
        df = spark.createDataFrame([r[:columns] for r in rows for _ in range(len(r[1] or "") % 4 + 1)], kind).repartition(3)
        form = lambda **how: sorted((tuple(map(repr, r)) for r in sharding.contiguous_shards(df.coalesce(1), sharding.text_bytes(), ["doc_id", "text"], 4, **how).select("doc_id", "text", "size", "shard", "slot").collect()))  # noqa: E731, B023
        assert form(repeated=True) == form()
    a, b = pa.array([1, 1, 1, None, None, 2]), pa.array(["x", "x", "y", None, None, "x"])
    (got,) = sharding._runs([pa.RecordBatch.from_arrays([a, b], names=["a", "b"])])
    assert got.to_pydict() == {"a": [1, 1, None, 2], "b": ["x", "y", None, "x"], sharding.TIMES: [2, 1, 2, 1]}


# F8


def test_ends_of_many_line_items_are_found_in_bounded_tasks(spark, monkeypatch, capsys):
    monkeypatch.setattr(graph_queries, "JOIN_ROWS", 500)
    own = {name: catalog.queries()[name](spark, "/root/testdata/sf0.001") for name in ("graph_unique_endpoints", "graph_self_loops")}
    own["graph_unique_endpoints"].explain()
    said = capsys.readouterr().out
    parts = -(-spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count() // 500)
    assert f", {parts})" in said or f", {parts}), REPARTITION_BY_NUM" in said
    assert said.count("lineitem") == 1 and "Union" not in said
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    for name, df in own.items():
        assert sorted(map(tuple, df.collect())) == sorted(con.execute(SQL[name]).fetchall())


# F9


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_marks_that_no_needle_has_stay_in_their_task(spark, monkeypatch, bound):
    monkeypatch.setattr(containment, "FEW", bound)
    long = "".join(chr(97 + i * i % 23) for i in range(3_000))
    rows = [(1, "plain words " * 40 + "needle in here"), (2, "edle"), (3, long), (4, None), (5, long[:64]), (6, long + "!" + long)]
    df, held = spark.createDataFrame(rows, "i long, text string"), spark.createDataFrame([("needle in",), ("x" * 70 + long[:64] + "y",), ("edle",)], "text string")
    seen, plain = {}, containment.stash
    monkeypatch.setattr(containment, "stash", lambda d, name: seen.setdefault(name, []).append(plain(d, name)) or seen[name][-1])
    assert {r["i"] for r in containment.without_overlap(df, held).collect()} == {3, 4, 6}
    marked = [x.count() for x in seen["text-marks"] + seen["needle-marks"]]
    assert max(marked) < 100  # the long texts are no needles, and few of their marks are wanted
    assert containment.without_overlap(df, held.limit(0)).count() == 6


@pytest.mark.parametrize("name", ["toxicity", "mixing"])
def test_stages_that_judge_rows_write_no_copy_of_the_texts(spark, monkeypatch, name):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumnsRenamed({"n_chars": "p_toxic"})
    written = []
    for module in (corpus_pipeline, toxicity, mixing):
        if hasattr(module, "stash"):
            monkeypatch.setattr(module, "stash", lambda df, label, f=module.stash: written.append(df.columns) or f(df, label))
    got = dict(corpus_pipeline.STAGES)[name](spark, docs, "/root/testdata/sf0.001")
    assert got.columns == docs.columns and 0 < got.count()
    assert not [c for c in written if "text" in c]


def test_a_mix_of_a_table_is_the_same_without_a_copy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    key = lambda stored: sorted(map(str, mixing.mix(docs, mixing.word_count(), keep=["doc_id", "text"], stored=stored).collect()))
    assert key(True) == key(False)


def test_attention_is_fitted_on_every_place_of_all_training_rows(spark, monkeypatch):
    """However few windows the start is drawn from: all places move the weights, for the better."""
    monkeypatch.setattr(lmscore, "WINDOWS", 20)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(3).cache()
    seen, real = {}, lmscore._over_all

    def spied(train, ranks, model, model_id):
        seen["start"], seen["id"] = {k: v.copy() for k, v in model.w.items()}, model_id
        seen["model"], seen["places"] = real(train, ranks, model, model_id)
        return seen["model"], seen["places"]

    monkeypatch.setattr(lmscore, "_over_all", spied)
    lmscore.score_documents(docs)
    sub = lmscore.Subwords(lmscore.Path(lmscore.TOKENIZER).read_bytes())
    train, held = [], []
    for r in docs.collect():
        (held if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1 else train).append(sub.of((r["text"] or "").encode().lower().split())[0])
    assert seen["places"] == sum(len(t) + 1 for t in train)
    assert all((seen["start"][k] != w).any() for k, w in seen["model"].w.items())
    raw = np.concatenate([[sub.size], *(np.append(t, sub.size) for t in held[:50])])
    start = np.append(0, np.cumsum([len(t) + 1 for t in held[:50]]))
    after = lmscore._log_probs(lmscore.Scorer(seen["model"]), seen["id"][raw], start).sum()
    seen["model"].w = seen["start"]
    assert after > lmscore._log_probs(lmscore.Scorer(seen["model"]), seen["id"][raw], start).sum()
    docs.unpersist()


# F1 of the last check


def test_texts_are_cut_into_subwords_once(monkeypatch):
    """Counts, fit and scores take the ids that the coding has written; these are the ids of each word alone."""
    monkeypatch.setattr(lmscore, "CHUNK_BYTES", 500)
    texts = [None, "", " \t ", "Aé  b c d\n\x1ce", "<|endoftext|> x", *(f"Word{i} 学{i} É " * (i % 30) for i in range(60))]
    rows = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "held_out": [False] * len(texts), "text": pa.array(texts, pa.string())})
    ranks = lmscore.Path(lmscore.TOKENIZER).read_bytes()
    sub, plain = lmscore.Subwords(ranks), lambda w: sub.encoding._encode_single_piece(b" " + w)
    coded = pa.Table.from_batches(lmscore._coded([rows], types.SimpleNamespace(value=ranks))).combine_chunks().to_batches()[0]
    want = [[i for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for i in plain(w)] + [sub.size] for t in texts]
    assert coded.column_names == ["doc_id", "held_out", "text", "ids"] and coded["text"].to_pylist() == texts
    for lo, n in ((0, len(texts)), (3, 7), (2, 0)):
        raw, start = lmscore._sequence(coded["ids"].slice(lo, n), sub.size)
        assert raw[0] == sub.size and [raw[i + 1 : j + 1].tolist() for i, j in zip(start[:-1], start[1:], strict=True)] == want[lo : lo + n]
    broken = [b"\xff\xfea", b"ok", b"\xc3"]  # no UTF-8
    ids, n = sub.of(broken)
    assert ids.tolist() == [i for w in broken for i in plain(w)] and n.tolist() == [len(plain(w)) for w in broken]
    monkeypatch.setattr(lmscore, "Subwords", None)  # from here on, no text can be cut
    model, model_id = attention.Attention(np.full((64, 64), -np.log(64))), np.arange(sub.size + 1) % 64
    (moved,) = lmscore._fitted([coded.select(["ids"])], types.SimpleNamespace(value=(sub.size, model, model_id)))
    assert moved["places"][0].as_py() == sum(map(len, want))
    counted = lmscore._counts([coded.select(["text", "ids"]).append_column("key", coded["doc_id"])], sub.size, 1.0)
    assert sum(sum(b["n"].to_pylist()) for b in counted if b["kind"][0].as_py() == lmscore.PAIR) == sum(map(len, want))


def test_scorer_skips_places_that_were_scored_before():
    rng, tokens = np.random.default_rng(4), 96
    pairs = rng.normal(size=(tokens, tokens))
    model = attention.Attention(pairs - np.log(np.exp(pairs).sum(axis=1, keepdims=True)), width=8)
    model.w = {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float32) for k, v in model.w.items()}
    ids, y = rng.integers(0, tokens, (70, attention.CONTEXT)), rng.integers(0, tokens, (70, attention.CONTEXT))
    y[5, 20:] = -1
    want = np.where(y < 0, 0, np.take_along_axis(model.log_prob_all(ids), np.maximum(y, 0)[:, :, None], 2)[:, :, 0])
    for skip in (0, 4):
        assert np.allclose(attention.Scorer(model).log_prob(ids, y, skip), want[:, skip:], atol=1e-4)
