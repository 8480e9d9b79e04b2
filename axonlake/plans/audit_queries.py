"""Audits of raw rows: every reason, null, negative id, duplicate and unknown label occurs in them.

Predictions come from events: every 17th has no id, every 13th an invalid one, users repeat, and of seven labels three are unknown.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from axonlake.functions import basic
from axonlake.operators import derive, graph, reports, sampling
from axonlake.operators.order import first_rows
from axonlake.plans.graph_queries import NR, nations
from axonlake.plans.registry import query, six, table
from axonlake.sources.shared import stash

E = """preds AS (SELECT CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 13 = 0 THEN -user_id - 1 ELSE user_id END AS id, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN ' Unclear ' WHEN 2 THEN '' ELSE event_type END AS label, event_id AS abs_row FROM events)"""
U = "(label IS NULL OR lower(trim(label)) IN ('', 'unclear'))"
#: Annotated are suppliers of even keys, twice those of keys that divide by 6; selected are those that don't divide by 10.
A = "ann AS (SELECT CASE WHEN s_suppkey % 14 = 0 THEN NULL WHEN s_suppkey % 22 = 0 THEN -s_suppkey ELSE s_suppkey END AS id, s_suppkey % 10 <> 0 AS ok, s_suppkey * 2 + k AS abs_row FROM supplier, (SELECT unnest([0, 1]) AS k) WHERE s_suppkey % 2 = 0 AND (k = 0 OR s_suppkey % 6 = 0))"
L = "raw AS (SELECT CASE WHEN l_orderkey % 19 = 0 THEN NULL WHEN l_orderkey % 23 = 0 THEN -1 ELSE l_suppkey END AS src, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_partkey % 40 END AS dst, CAST(l_quantity AS BIGINT) AS weight FROM lineitem)"
S = "state AS (SELECT id, max(CAST(ok AND first AS INT)) AS sel FROM (SELECT *, abs_row = min(abs_row) OVER (PARTITION BY id) AS first FROM ann WHERE id >= 0) GROUP BY 1)"


def predictions(spark, d):
    e = table(spark, d, "events")
    i = F.col("event_id")
    named = F.when(i % 17 == 0, None).when(i % 13 == 0, -F.col("user_id") - 1).otherwise(F.col("user_id"))
    label = F.when(i % 7 == 0, None).when(i % 7 == 1, " Unclear ").when(i % 7 == 2, "").otherwise(F.col("event_type"))
    return e.select(named.alias("id"), label.alias("label"), i.alias("abs_row"))


def raw_annotations(spark, d):
    k = F.col("s_suppkey")
    twice = F.when(k % 6 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    s = table(spark, d, "supplier").where(k % 2 == 0).select("s_suppkey", F.explode(twice).alias("k"))
    return s.select(F.when(k % 14 == 0, None).when(k % 22 == 0, -k).otherwise(k).alias("id"), (k % 10 != 0).alias("ok"), (k * 2 + F.col("k")).alias("abs_row"))


def raw_rows(spark, d):
    o = F.col("l_orderkey")
    src = F.when(o % 19 == 0, None).when(o % 23 == 0, -1).otherwise(F.col("l_suppkey"))
    dst = F.when(F.col("l_linenumber") == 7, None).otherwise(F.col("l_partkey") % 40)
    return table(spark, d, "lineitem").select(src.alias("src"), dst.alias("dst"), F.col("l_quantity").cast("long").alias("weight"), F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("abs_row"))


@query(f"WITH {A}, m AS (SELECT *, abs_row <> min(abs_row) OVER (PARTITION BY id) AS later FROM ann) SELECT CASE WHEN id IS NULL THEN 'null_id' WHEN id < 0 THEN 'invalid_id' WHEN later THEN 'duplicate' WHEN NOT ok THEN 'predicate_false' ELSE 'kept' END AS reason, count(*) AS n FROM m GROUP BY 1")
def raw_node_reasons(spark, d):
    return graph.classify_nodes(raw_annotations(spark, d), F.col("ok")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"WITH {A}, {S}, {L} SELECT CASE WHEN src IS NULL OR dst IS NULL THEN 'null_endpoint' WHEN src < 0 OR dst < 0 THEN 'invalid_id' WHEN a.id IS NULL OR b.id IS NULL THEN 'missing_annotation' WHEN a.sel = 0 OR b.sel = 0 THEN 'predicate_false' ELSE 'kept' END AS reason, count(*) AS n, CAST(sum(weight) AS BIGINT) AS weight FROM raw LEFT JOIN state a ON src = a.id LEFT JOIN state b ON dst = b.id GROUP BY 1")
def raw_edge_reasons(spark, d):
    nodes = graph.classify_nodes(raw_annotations(spark, d), F.col("ok"))
    return graph.classify_edges(raw_rows(spark, d), nodes).groupBy("reason").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@query(f"WITH {E} SELECT count(*) AS n_rows, count(*) FILTER (id IS NULL) AS null_ids, count(*) FILTER (id < 0) AS invalid_ids, count(DISTINCT id) FILTER (id >= 0) AS unique_ids, count(*) FILTER (id >= 0) - count(DISTINCT id) FILTER (id >= 0) AS duplicate_rows, count(*) FILTER {U} AS unknown_rows, round(count(*) FILTER {U} / count(*), 6) AS unknown_ratio FROM preds".replace(f"FILTER {U}", f"FILTER (WHERE {U})"))
def raw_prediction_profile(spark, d):
    return graph.prediction_profile(predictions(spark, d)).withColumn("unknown_ratio", six("unknown_ratio"))


@query(f"WITH {E}, f AS (SELECT id, arg_min(struct_pack(l := label), abs_row).l AS label FROM preds WHERE id >= 0 GROUP BY 1) SELECT c_custkey AS id, label, CASE WHEN {U} THEN 'unknown' ELSE 'predicted' END AS status FROM customer LEFT JOIN f ON c_custkey = id")
def node_predictions(spark, d):
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return graph.with_predictions(nodes, predictions(spark, d)).select("id", "label", "status")


@query(f"WITH {E} SELECT coalesce(label, '-') AS label, {U} AS unknown, count(*) AS n FROM preds GROUP BY 1, 2")
def unknown_labels(spark, d):
    unknown = basic.is_unknown(F.col("label"))
    return predictions(spark, d).select(F.coalesce("label", F.lit("-")).alias("label"), unknown.alias("unknown")).groupBy("label", "unknown").agg(F.count("*").alias("n"))


@query(f"WITH {E}, p AS (SELECT id, count(*) AS n FROM preds WHERE id IS NOT NULL GROUP BY 1) SELECT count(id) AS matched, count(*) FILTER (id IS NULL) AS missing, (SELECT count(*) FROM p WHERE n > 1) AS duplicate_ids, (SELECT CAST(sum(n - 1) AS BIGINT) FROM p) AS duplicate_rows FROM customer LEFT JOIN p ON c_custkey = id")
def lookup_counts(spark, d):
    return graph.lookup_counts(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), predictions(spark, d))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 10 = 0)")
def untouched_nodes(spark, d):
    edges = table(spark, d, "orders").where("o_orderkey % 10 = 0").select(F.col("o_custkey").alias("src"), F.col("o_custkey").alias("dst"))
    return graph.isolated(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), edges)


@query("WITH e AS (SELECT DISTINCT l_suppkey AS a, l_linenumber AS b FROM lineitem WHERE l_quantity > 25), p AS (SELECT l_suppkey AS a, l_linenumber AS b, count(*) AS n FROM lineitem WHERE l_quantity <= 10 GROUP BY 1, 2) SELECT a, b, n FROM e LEFT JOIN p USING (a, b)")
def aligned_pairs(spark, d):
    return derive.aligned(*_sides(spark, d), ["a", "b"])[0]


@query("WITH e AS (SELECT DISTINCT l_partkey AS a, l_linenumber AS b FROM lineitem WHERE l_quantity > 25), p AS (SELECT l_partkey AS a, l_linenumber AS b, count(*) AS n FROM lineitem WHERE l_quantity <= 10 GROUP BY 1, 2) SELECT p.* FROM p ANTI JOIN e USING (a, b)")
def pairs_without_edge(spark, d):
    return derive.aligned(*_sides(spark, d, "l_partkey"), ["a", "b"])[1]


def _sides(spark, d, key="l_suppkey"):
    li = table(spark, d, "lineitem").withColumns({"a": F.col(key), "b": F.col("l_linenumber")})
    return li.where("l_quantity > 25").select("a", "b").distinct(), li.where("l_quantity <= 10").groupBy("a", "b").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, CASE l_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN round(0.5 * l_quantity, 6) ELSE round(-0.5 * l_quantity, 6) END AS excluded, round(CASE l_suppkey % 3 WHEN 1 THEN 0.5 WHEN 0 THEN -0.5 ELSE -0.5 END * l_quantity, 6) AS inhibitory, round(CASE l_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -1 END * exp(l_quantity / 10.0), 6) + 0.0 AS effective FROM lineitem")
def derived_parameters(spark, d):
    li = table(spark, d, "lineitem")
    sign = F.when(F.col("l_suppkey") % 3 == 0, 0).when(F.col("l_suppkey") % 3 == 1, 1).otherwise(-1)
    w = F.col("l_quantity").cast("double")
    return li.select("l_orderkey", "l_linenumber", six(derive.parameters(sign, w, 0.5)).alias("excluded"), six(derive.parameters(sign, w, 0.5, "inhibitory")).alias("inhibitory"), (six(derive.effective(sign, w / 10.0)) + F.lit(0.0)).alias("effective"))


@query("WITH w AS (SELECT CAST(o_custkey % 12 AS BIGINT) AS low, CAST(o_custkey % 12 + o_orderkey % 3 + 1 AS BIGINT) AS high, min(o_orderkey) AS first FROM orders GROUP BY 1, 2) SELECT low, high, row_number() OVER (ORDER BY first) - 1 AS position FROM w")
def distinct_windows(spark, d):
    w = table(spark, d, "orders").select((F.col("o_custkey") % 12).cast("long").alias("low"), (F.col("o_custkey") % 12 + F.col("o_orderkey") % 3 + 1).cast("long").alias("high"), "o_orderkey")
    return graph.distinct_windows(w, "low", "high", "o_orderkey")


@query("WITH e AS (SELECT user_id, event_id % 5 - 2.0 AS lx, event_id % 3 - 1.0 AS ly, value AS tx, value / 2 AS ty, event_id FROM events), s AS (SELECT avg(sqrt(tx * tx + ty * ty)) AS s FROM e WHERE user_id % 4 <> 0) SELECT event_id, round(CASE WHEN lx = 0 AND ly = 0 THEN 0 ELSE lx / sqrt(lx * lx + ly * ly) * s END, 6) + 0.0 AS persist_x, round(CASE WHEN lx = 0 AND ly = 0 THEN 0 ELSE ly / sqrt(lx * lx + ly * ly) * s END, 6) + 0.0 AS persist_y FROM e, s")
def naive_forecasts(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", (F.col("event_id") % 5 - 2.0).alias("lx"), (F.col("event_id") % 3 - 1.0).alias("ly"), F.col("value").alias("tx"), (F.col("value") / 2).alias("ty"))
    out = reports.naive_baselines(e, F.col("user_id") % 4 != 0)
    return out.select("event_id", *((six(c) + F.lit(0.0)).alias(c) for c in ("persist_x", "persist_y")))


@query("SELECT l_returnflag, count(*) AS n, round(avg(CASE WHEN l_suppkey % 3 = l_partkey % 3 THEN 1 ELSE 0 END), 6) AS agreement FROM lineitem GROUP BY 1")
def teacher_agreement(spark, d):
    li = table(spark, d, "lineitem").withColumns({"a": F.col("l_suppkey") % 3, "b": F.col("l_partkey") % 3})
    return reports.agreement(li, ["l_returnflag"], "a", "b").withColumn("agreement", six("agreement"))


@query(f"WITH {NR}, e AS (SELECT src, dst, count(*) AS w FROM nr GROUP BY 1, 2) SELECT src AS id, round(sum(w * (dst % 4 - 1.5)), 6) AS grad FROM e GROUP BY 1")
def source_gradients(spark, d):
    e = nations(spark, d).groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")).withColumn("param", F.col("src") % 2)
    ends = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    values, up = ends.withColumn("value", F.lit(1.0)), ends.withColumn("value", F.col("id") % 4 - 1.5)
    return graph.sparse_gradients(e, values, up)[1].withColumn("grad", six("grad"))


@query("SELECT event_id FROM events ORDER BY md5('9:' || event_id), event_id LIMIT 64")
def reservoir_sample(spark, d):
    return sampling.reservoir(table(spark, d, "events").select("event_id"), 64, ["event_id"], 9)


@query("SELECT l_partkey, arg_min(l_extendedprice, l_orderkey * 10 + l_linenumber) AS l_extendedprice, min(l_orderkey * 10 + l_linenumber) AS ordinal FROM lineitem GROUP BY 1")
def first_row_of_key(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_extendedprice", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    return first_rows(li, ["l_partkey"], "ordinal")


@query("WITH t AS (SELECT page_id, html, strpos(html, '<p>') AS a FROM pages), u AS (SELECT page_id, html, a, strpos(substr(html, a + 3), '</p>') AS b FROM t) SELECT page_id, CASE WHEN a > 0 AND b > 0 THEN trim(substr(html, a + 3, b - 1), ' ') END AS body FROM u")
def body_extraction(spark, d):
    return table(spark, d, "pages").select("page_id", basic.body_between(F.col("html"), "<p>", "</p>").alias("body"))


@query("SELECT doc_id, CAST(octet_length(encode(text)) AS INT) AS n, CASE WHEN octet_length(encode(text)) <= 100 THEN text ELSE left(text, CAST(list_max(list_filter(range(0, 101), lambda k: octet_length(encode(left(text, CAST(k AS INT)))) <= 100)) AS INT)) END AS prefix FROM documents")
def utf8_prefix(spark, d):
    return table(spark, d, "documents").select("doc_id", F.octet_length("text").alias("n"), basic.utf8_cut(F.col("text"), 100).alias("prefix"))


@query("WITH p AS (SELECT l_suppkey AS src, l_linenumber AS dst, count(*) AS n FROM lineitem GROUP BY 1, 2), e AS (SELECT DISTINCT id FROM (SELECT src AS id FROM p UNION ALL SELECT dst FROM p)) SELECT count(*) AS ends, (SELECT count(*) FROM e WHERE id NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)) AS unannotated FROM e")
def unannotated_ends(spark, d):
    """Ends of all pairs, and those that no annotation names."""
    pairs = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("long").alias("src"), F.col("l_linenumber").cast("long").alias("dst")).distinct()
    known = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("long").alias("id"), F.lit(1).alias("known"))
    return stash(graph.endpoints(pairs), "ends").join(known, "id", "left").agg(F.count("*").alias("ends"), F.count_if(F.col("known").isNull()).alias("unannotated"))
