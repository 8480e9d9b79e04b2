"""Golden tables worked out by hand, and agreement in any partitioning."""

import pytest
from pyspark.sql import functions as F

from axonlake.functions.basic import is_unknown, ratio
from axonlake.operators import derive, graph
from axonlake.operators.order import dense_index, first_rows
from axonlake.sources.shared import stash

BIG = 9007199254740993
ANNOTATIONS = [(10, "Traced"), (20, "Traced"), (30, "Traced"), (40, "Orphan"), (50, None), (BIG, "Traced"), (-5, "Traced"), (None, "Traced"), (10, "Traced"), (60, "Traced")]
WEIGHTS = [(10, 20, 3), (10, 20, 4), (20, 30, 1), (30, 30, 2), (10, 40, 5), (20, 99, 1), (None, 20, 1), (10, -7, 1), (BIG, 10, None), (30, 10, 0), (20, 10, 7)]
PREDICTIONS = [(10, "acetylcholine"), (20, "unclear"), (30, None), (99, "gaba"), (10, "gaba")]


def numbered(rows):
    return [(*r, i) for i, r in enumerate(rows)]


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_build_of_the_eleven_rows(spark, parts):
    a = spark.createDataFrame(numbered(ANNOTATIONS), "id long, status string, abs_row long").repartition(parts)
    w = spark.createDataFrame(numbered(WEIGHTS), "src long, dst long, weight long, abs_row long").repartition(parts)
    nodes = graph.classify_nodes(a, F.col("status") == "Traced")
    assert {r["reason"]: r["count"] for r in nodes.groupBy("reason").count().collect()} == {"null_id": 1, "invalid_id": 1, "duplicate": 1, "predicate_false": 2, "kept": 5}
    catalog = graph.node_catalog(nodes)
    assert [r["id"] for r in catalog.orderBy("node_index").collect()] == [10, 20, 30, 60, BIG]
    edges = graph.classify_edges(w, nodes)
    assert {r["reason"]: r["count"] for r in edges.groupBy("reason").count().collect()} == {"null_endpoint": 1, "invalid_id": 1, "missing_annotation": 1, "predicate_false": 1, "kept": 7}
    view = graph.edge_view(edges, catalog).orderBy("source_index", "target_index", "abs_row")
    assert [tuple(r) for r in view.collect()] == [(0, 1, 0, 3), (0, 1, 1, 4), (1, 0, 10, 7), (1, 2, 2, 1), (2, 0, 9, 0), (2, 2, 3, 2), (4, 0, 8, None)]
    kept = edges.where("reason = 'kept'")
    assert graph.duplicate_pairs(kept).first() == (6, 1, 1)
    assert graph.isolated(catalog.select("id"), kept).collect() == [(60,)]
    predicted = graph.with_predictions(catalog, spark.createDataFrame(numbered(PREDICTIONS), "id long, label string, abs_row long"))
    assert {r["id"]: r["status"] for r in predicted.collect()} == {10: "predicted", 20: "unknown", 30: "unknown", 60: "unknown", BIG: "unknown"}


def test_pairs_refuse_unknown_weights(spark):
    rows = spark.createDataFrame([(1, 2, 3, 0), (1, 2, None, 1)], "src long, dst long, weight long, abs_row long")
    with pytest.raises(Exception, match="weights must be known"):
        graph.aggregate_pairs(rows).collect()
    assert graph.aggregate_pairs(rows.where("abs_row = 0")).collect() == [(1, 2, 3, 1, 0)]
    with pytest.raises(ValueError, match="no evidence"):
        graph.merge_datasets()
    with pytest.raises(ValueError, match="namespaces"):
        graph.compare(rows, rows, rows, rows, namespaces=("a", "b"))


EDGES = [(0, 1, 4), (0, 2, 2), (0, 3, 4), (1, 2, 3), (2, 3, 1), (3, 0, 8)]


def test_signs_and_strengths(spark):
    means = {(0, 1): (2, 0, 0.625), (0, 2): (1, 2, 0.6875), (0, 3): (1, 1, 0.625), (1, 2): (1, 3, 0.5625)}
    rows = [(*e, *means.get(e[:2], (None, None, None)), 4.0) for e in EDGES]
    df = spark.createDataFrame(rows, "src int, dst int, raw int, matched int, best int, confidence double, norm double")
    got = {(r["src"], r["dst"]): (r["reason"], r["sign"]) for r in derive.signed_strength(df, {0: 1, 2: -1, 3: -1}, 2.0, "norm", 0.5, 0.25).collect()}
    assert got == {(0, 1): ("known", 1), (0, 2): ("known", -1), (0, 3): ("unknown_mapping", 0), (1, 2): ("known", -1), (2, 3): ("no_match", 0), (3, 0): ("no_match", 0)}


def test_evidence_has_one_outcome_each(spark):
    keys = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.1), (3, 0.2), (4, 0.9)], "k int, p double")
    events = spark.createDataFrame([(1,), (1,), (2,), (3,), (9,)], "k int")
    keyed = derive.key_status(keys, ["k"], ["p"])
    got = derive.join_evidence(events, keyed, ["k"])
    assert sorted(r["outcome"] for r in got.collect()) == ["ambiguous", "matched", "matched", "null_probability", "unmatched"]
    assert [r["k"] for r in derive.unused_keys(keyed, events, ["k"]).collect()] == [4]
    modes = derive.most_frequent(spark.createDataFrame([(1, "b"), (1, "a"), (2, "z"), (2, None)], "node int, roi string"), ["node"], "roi")
    assert sorted(map(tuple, modes.collect())) == [(1, "a", 1), (2, "z", 1)]


def test_first_rows_and_dense_index(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("g")).repartition(7)
    assert [r["k"] for r in dense_index(df, ["k"]).orderBy("index").collect()] == list(range(1000))
    assert {(r["g"], r["k"]) for r in first_rows(df, ["g"], "k").collect()} == {(r["g"], r["k"]) for r in df.groupBy("g").agg(F.min("k").alias("k")).collect()}
    assert dense_index(df.limit(0), ["k"]).count() == 0


def test_iterations_and_variants(spark):
    cut = lambda df: stash(df, "t")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (5, 6)], "src long, dst long")
    assert {r["id"]: r["distance"] for r in graph.reachable(edges, spark.createDataFrame([(0,)], "id long"), cut).collect()} == {0: 0, 1: 1, 2: 2}
    assert {r["id"]: r["component"] for r in graph.connected(edges, cut).collect()} == {0: 0, 1: 0, 2: 0, 5: 5, 6: 5}
    full = spark.createDataFrame([(a, (a + b) % 12, a * 3 + b) for a in range(12) for b in (1, 2, 3)], "src long, dst long, ord long")
    got = graph.rewire(full, 0.5, [0, 1], cut)
    for seed in (0, 1):
        own = got.where(F.col("seed") == seed)
        assert own.where("src = dst").count() == 0 and own.select("src", "dst").distinct().count() == 36
        for side in ("src", "dst"):
            assert own.groupBy(side).count().exceptAll(full.groupBy(side).count()).count() == 0
        first = own.first()
        assert first["swapped"] > 0 and first["swapped"] + first["refused_loop"] + first["refused_duplicate"] == 18
        assert own.join(full.withColumnRenamed("dst", "was"), ["src", "ord"]).where("dst <> was").count() <= 2 * first["swapped"]
    with pytest.raises(ValueError):
        graph.rewire(full.union(full.limit(1)), 0.5, [0], cut)
    mixed = graph.shuffled_column(full, "dst", ["ord"], 1)
    assert sorted(r["dst"] for r in mixed.collect()) == sorted(r["dst"] for r in full.collect())


def test_undefined_is_not_zero(spark):
    df = spark.createDataFrame([(1, 0), (3, 4), (None, 2)], "a int, b int").select(ratio(F.col("a"), F.col("b"), "rows").alias("r"))
    assert [(r["r"]["value"], r["r"]["defined"]) for r in df.collect()] == [(None, False), (0.75, True), (None, False)]
    labels = spark.createDataFrame([("gaba",), (" Unclear ",), ("",), (None,)], "x string")
    assert [r[0] for r in labels.select(is_unknown(F.col("x"))).collect()] == [False, True, True, True]
