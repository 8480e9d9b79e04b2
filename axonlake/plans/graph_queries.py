"""Graph queries: customers and suppliers are nodes, line items are weighted rows between them.

Customer ids are even and supplier ids odd. A customer whose key divides by 10 is not annotated; selected are customers of the
BUILDING segment and suppliers of an even nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonlake.functions.basic import divided, hex_patch
from axonlake.operators import derive, graph
from axonlake.operators.order import dense_index, first_rows
from axonlake.plans.registry import query, six, table
from axonlake.sources.shared import stash

N = """nodes AS (SELECT c_custkey * 2 AS id, c_mktsegment = 'BUILDING' AS ok, c_nationkey AS nation FROM customer WHERE c_custkey % 10 <> 0
 UNION ALL SELECT s_suppkey * 2 + 1, s_nationkey % 2 = 0, s_nationkey FROM supplier)"""
R = """rows AS (SELECT o_custkey * 2 AS src, l_suppkey * 2 + 1 AS dst, CAST(l_quantity AS BIGINT) AS weight, l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
C = """edges AS (SELECT r.*, CASE WHEN a.id IS NULL OR b.id IS NULL THEN 'missing_annotation' WHEN NOT (a.ok AND b.ok) THEN 'predicate_false' ELSE 'kept' END AS reason FROM rows r LEFT JOIN nodes a ON r.src = a.id LEFT JOIN nodes b ON r.dst = b.id)"""
P = "pairs AS (SELECT src, dst, sum(weight) AS weight, count(*) AS n_rows FROM edges WHERE reason = 'kept' GROUP BY 1, 2)"


def annotations(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_custkey % 10 <> 0").select((F.col("c_custkey") * 2).alias("id"), (F.col("c_mktsegment") == "BUILDING").alias("ok"), F.col("c_nationkey").alias("nation"))
    s = table(spark, d, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("id"), (F.col("s_nationkey") % 2 == 0).alias("ok"), F.col("s_nationkey").alias("nation"))
    return c.union(s).withColumn("abs_row", F.col("id"))


#: Line items of a task of their join with orders, about, once there are more of them than tasks at a time.
JOIN_ROWS = 1_000_000


def _of_orders(spark: SparkSession, d: str) -> DataFrame:
    """Line items with their orders; a large table is dealt by its count, so what a task sorts and holds doesn't grow with it."""
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    parts = -(-lines.count() // JOIN_ROWS)
    if parts > spark.sparkContext.defaultParallelism:
        lines, orders = lines.repartition(parts, "l_orderkey"), orders.repartition(parts, "o_orderkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def rows(spark: SparkSession, d: str) -> DataFrame:
    joined = _of_orders(spark, d)
    key = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return joined.select((F.col("o_custkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"), F.col("l_quantity").cast("long").alias("weight"), key.alias("abs_row"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """The annotations, classified once."""
    return stash(graph.classify_nodes(annotations(spark, d), F.col("ok")), "nodes")


def classified(spark: SparkSession, d: str) -> DataFrame:
    return graph.classify_edges(rows(spark, d), nodes(spark, d))


def kept(spark: SparkSession, d: str) -> DataFrame:
    return classified(spark, d).where("reason = 'kept'")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return graph.aggregate_pairs(kept(spark, d))


def nations(spark: SparkSession, d: str) -> DataFrame:
    """Edges between nations: these have self loops, duplicates and ties."""
    joined = _of_orders(spark, d).join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"), F.col("l_quantity").cast("long").alias("weight"), F.xxhash64("l_orderkey", "l_linenumber", "l_partkey").alias("abs_row"))


NR = "nr AS (SELECT c_nationkey AS src, s_nationkey AS dst, CAST(l_quantity AS BIGINT) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"


@query(f"WITH {N}, {R}, {C}, {P} SELECT src, dst, CAST(weight AS BIGINT) AS weight, n_rows FROM pairs")
def graph_pair_aggregate(spark, d):
    return pairs(spark, d).select("src", "dst", "weight", "n_rows")


@query(f"WITH {N}, {R}, {C} SELECT reason, count(*) AS n FROM edges GROUP BY 1")
def graph_edge_reasons(spark, d):
    return classified(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"WITH {N} SELECT id, row_number() OVER (ORDER BY id) - 1 AS node_index, nation FROM nodes WHERE ok")
def graph_node_catalog(spark, d):
    return graph.node_catalog(graph.classify_nodes(annotations(spark, d), F.col("ok"))).select("id", "node_index", "nation")


@query(f"WITH {N} SELECT CASE WHEN ok THEN 'kept' ELSE 'predicate_false' END AS reason, count(*) AS n FROM nodes GROUP BY 1")
def graph_node_reasons(spark, d):
    return graph.classify_nodes(annotations(spark, d), F.col("ok")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""WITH {N}, {R}, {C}, i AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM nodes WHERE ok)
SELECT a.k AS source_index, b.k AS target_index, weight FROM edges JOIN i a ON src = a.id JOIN i b ON dst = b.id WHERE reason = 'kept'""")
def graph_edges_canonical(spark, d):
    known = nodes(spark, d)
    return graph.edge_view(graph.classify_edges(rows(spark, d), known), graph.node_catalog(known)).select("source_index", "target_index", "weight")


@query(f"WITH {R}, p AS (SELECT src, dst, count(*) AS n FROM rows GROUP BY 1, 2) SELECT count(*) AS unique_pairs, count(*) FILTER (n > 1) AS duplicate_pairs, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM p")
def graph_duplicates(spark, d):
    return graph.duplicate_pairs(rows(spark, d))


@query(f"WITH {R} SELECT src AS id FROM rows UNION SELECT dst FROM rows")
def graph_unique_endpoints(spark, d):
    return graph.endpoints(rows(spark, d))


@query(f"WITH {N}, {R}, {C} SELECT id FROM nodes WHERE ok AND id NOT IN (SELECT src FROM edges WHERE reason = 'kept' UNION SELECT dst FROM edges WHERE reason = 'kept')")
def graph_isolated_nodes(spark, d):
    return graph.isolated(annotations(spark, d).where("ok").select("id"), kept(spark, d))


@query(f"WITH {R}, u AS (SELECT src AS id, 1 AS o, 0 AS i FROM rows UNION ALL SELECT dst, 0, 1 FROM rows) SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM u GROUP BY 1")
def graph_degrees(spark, d):
    return graph.degrees(rows(spark, d))


@query(f"WITH {NR} SELECT count(*) AS n_rows, count(*) FILTER (src = dst) AS self_loops, CAST(sum(weight) AS BIGINT) AS total FROM nr")
def graph_self_loops(spark, d):
    return graph.self_loops(nations(spark, d)).drop("loop_nodes")


@query("""WITH a AS (SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'), b AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey < 12),
ea AS (SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT id FROM a)), eb AS (SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT id FROM b))
SELECT (SELECT count(*) FROM a) AS nodes_a, (SELECT count(*) FROM b) AS nodes_b, (SELECT n FROM ea) AS edges_a, (SELECT n FROM eb) AS edges_b, (SELECT count(*) FROM a WHERE id IN (SELECT id FROM b)) AS shared_ids""")
def graph_compare_shared(spark, d):
    c, o = table(spark, d, "customer").withColumnRenamed("c_custkey", "id"), table(spark, d, "orders").select(F.col("o_custkey").alias("id"))
    a, b = c.where("c_mktsegment = 'BUILDING'").select("id"), c.where("c_nationkey < 12").select("id")
    return graph.compare(a, b, o.join(a, "id", "left_semi"), o.join(b, "id", "left_semi"), namespaces=("tpch", "tpch"))


@query("SELECT 'l_quantity' AS column, count(*) AS n_rows, count(*) FILTER (q IS NULL) AS nulls, count(*) FILTER (q < 0) AS negatives, count(*) FILTER (q = 0) AS zeros, round(sum(q), 6) AS total, count(*) FILTER (q < 0) = 0 AS valid FROM (SELECT nullif(l_quantity, 7) AS q FROM lineitem) UNION ALL SELECT 'l_discount', count(*), count(*) FILTER (l_discount IS NULL), count(*) FILTER (l_discount < 0), count(*) FILTER (l_discount = 0), round(sum(l_discount), 6), count(*) FILTER (l_discount < 0) = 0 FROM lineitem")
def profile_nulls(spark, d):
    li = table(spark, d, "lineitem").select(F.nullif(F.col("l_quantity"), F.lit(7.0)).alias("l_quantity"), "l_discount")
    return graph.column_profile(li, ["l_quantity", "l_discount"]).withColumn("total", six("total"))


@query(f"WITH {R} SELECT count(*) AS n_rows, count(*) FILTER (src IS NULL OR dst IS NULL) AS null_endpoints, CAST(min(weight) AS BIGINT) AS least, CAST(max(weight) AS BIGINT) AS greatest, CAST(sum(weight) AS BIGINT) AS total FROM rows")
def graph_raw_profile(spark, d):
    return rows(spark, d).agg(F.count("*").alias("n_rows"), F.count_if(F.col("src").isNull() | F.col("dst").isNull()).alias("null_endpoints"), F.min("weight").alias("least"), F.max("weight").alias("greatest"), F.sum("weight").alias("total"))


@query("SELECT p_partkey FROM part WHERE greatest(abs(p_size - 25), abs(p_partkey % 50 - 25), abs((p_size - 25) - (p_partkey % 50 - 25))) <= 6")
def hex_patch_filter(spark, d):
    return table(spark, d, "part").where(hex_patch(F.col("p_size") - 25, F.col("p_partkey") % 50 - 25, 6)).select("p_partkey")


@query("SELECT c_custkey AS id FROM customer WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE') INTERSECT SELECT c_custkey FROM customer WHERE c_nationkey < 10")
def named_set_intersection(spark, d):
    from axonlake.functions.basic import any_of
    from axonlake.operators.metrics import named_set

    return named_set(table(spark, d, "customer").withColumnRenamed("c_custkey", "id"), [any_of("c_mktsegment", ["BUILDING", "AUTOMOBILE"]), F.col("c_nationkey") < 10])


K = "keyed AS (SELECT l_partkey, l_suppkey, count(*) AS n, CASE WHEN count(*) > 1 THEN 'ambiguous' WHEN count(*) FILTER (t IS NULL) > 0 THEN 'null_probability' ELSE 'usable' END AS status FROM (SELECT *, nullif(l_tax, 0.0) AS t FROM lineitem WHERE l_linenumber <= 3) GROUP BY 1, 2)"


def _keyed(spark, d):
    li = table(spark, d, "lineitem").where("l_linenumber <= 3").withColumn("t", F.nullif(F.col("l_tax"), F.lit(0.0)))
    return derive.key_status(li, ["l_partkey", "l_suppkey"], ["t"])


@query(f"WITH {K} SELECT l_partkey, l_suppkey, status FROM keyed")
def evidence_key_status(spark, d):
    return _keyed(spark, d).select("l_partkey", "l_suppkey", "status")


@query(f"WITH {K} SELECT coalesce(CASE status WHEN 'usable' THEN 'matched' ELSE status END, 'unmatched') AS outcome, count(*) AS n FROM lineitem l LEFT JOIN keyed USING (l_partkey, l_suppkey) WHERE l_linenumber >= 2 GROUP BY 1")
def evidence_outcomes(spark, d):
    return derive.join_evidence(table(spark, d, "lineitem").where("l_linenumber >= 2"), _keyed(spark, d), ["l_partkey", "l_suppkey"]).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"WITH {K} SELECT l_partkey, l_suppkey, status FROM keyed WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_linenumber >= 2 AND l.l_partkey = keyed.l_partkey AND l.l_suppkey = keyed.l_suppkey)")
def evidence_unused_keys(spark, d):
    return derive.unused_keys(_keyed(spark, d), table(spark, d, "lineitem").where("l_linenumber >= 2"), ["l_partkey", "l_suppkey"]).select("l_partkey", "l_suppkey", "status")


M = "means AS (SELECT l_suppkey, l_returnflag, count(*) AS matched, avg(l_discount) AS a, avg(l_tax) AS b, avg(l_quantity / 500) AS c FROM lineitem GROUP BY 1, 2)"


@query(f"WITH {M} SELECT l_suppkey, l_returnflag, matched, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, CAST(list_position([round(a, 6), round(b, 6), round(c, 6)], greatest(round(a, 6), round(b, 6), round(c, 6))) - 1 AS INT) AS best FROM means")
def pair_mean_argmax(spark, d):
    li = table(spark, d, "lineitem").withColumns({"a": F.col("l_discount"), "b": F.col("l_tax"), "c": F.col("l_quantity") / 500})
    return derive.pair_means(li, ["l_suppkey", "l_returnflag"], ["a", "b", "c"], 6).select("l_suppkey", "l_returnflag", "matched", "a", "b", "c", "best")


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c) SELECT user_id, event_type AS label, n FROM r WHERE k = 1")
def node_mode_label(spark, d):
    return derive.most_frequent(table(spark, d, "events"), ["user_id"], "event_type")


@query("""WITH p AS (SELECT l_suppkey, count(*) AS raw, count(*) FILTER (l_returnflag <> 'N') AS matched, CAST(avg(l_discount) FILTER (l_returnflag <> 'N') AS REAL) AS confidence, l_suppkey % 4 AS best, sum(l_quantity) AS q FROM lineitem GROUP BY 1),
r AS (SELECT *, CASE WHEN matched = 0 THEN 'no_match' WHEN matched / raw < 0.45 THEN 'low_fraction' WHEN confidence < CAST(0.05 AS REAL) THEN 'low_probability' WHEN best = 3 THEN 'unknown_mapping' ELSE 'known' END AS reason FROM p)
SELECT l_suppkey, reason, CASE WHEN reason <> 'known' THEN 0 WHEN best = 0 THEN 1 WHEN best = 1 THEN -1 ELSE 1 END AS sign, round(2.0 * raw / q, 6) AS strength FROM r""")
def sign_strength_rules(spark, d):
    li = table(spark, d, "lineitem")
    seen = F.col("l_returnflag") != "N"
    p = li.groupBy("l_suppkey").agg(F.count("*").alias("raw"), F.count_if(seen).alias("matched"), F.avg(F.when(seen, F.col("l_discount"))).cast("float").alias("confidence"), F.sum("l_quantity").alias("q")).withColumn("best", F.col("l_suppkey") % 4)
    out = derive.signed_strength(p, {0: 1, 1: -1, 2: 1}, 2.0, "q", 0.05, 0.45)
    return out.select("l_suppkey", "reason", "sign", six("strength").alias("strength"))


@query("""WITH p AS (SELECT l_suppkey, count(*) AS raw, count(*) FILTER (l_returnflag <> 'N') AS matched, CAST(avg(l_discount) FILTER (l_returnflag <> 'N') AS REAL) AS confidence, l_suppkey % 4 AS best FROM lineitem GROUP BY 1),
r AS (SELECT *, CASE WHEN matched = 0 THEN 'no_match' WHEN matched / raw < 0.45 THEN 'low_fraction' WHEN confidence < CAST(0.05 AS REAL) THEN 'low_probability' WHEN best = 3 THEN 'unknown_mapping' ELSE 'known' END AS reason FROM p),
g AS (SELECT best, reason, CASE WHEN reason <> 'known' THEN 0 WHEN best = 1 THEN -1 ELSE 1 END AS sign FROM r) SELECT best, sign, reason, count(*) AS edges, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM g GROUP BY 1, 2, 3""")
def sign_histogram(spark, d):
    """How often each transmitter got each sign, and for what reason others got none."""
    out = derive.sign_histogram(sign_strength_rules(spark, d).withColumn("best", F.col("l_suppkey") % 4), ["best"])
    return out.withColumn("share", six("share"))


@query("""WITH p AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1) SELECT l_suppkey % 3 AS kind, count(*) AS n, count(*) FILTER (r = 0) AS without FROM p GROUP BY 1""")
def reason_histogram(spark, d):
    p = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("r"))
    return p.groupBy((F.col("l_suppkey") % 3).alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("r") == 0).alias("without"))


@query(f"WITH {N}, {R}, {C}, {P} SELECT dst AS id, CAST(sum(weight * (src % 7)) AS BIGINT) AS value FROM pairs GROUP BY 1")
def sparse_step(spark, d):
    p = stash(pairs(spark, d).select("src", "dst", "weight"), "pairs")
    return graph.sparse_step(p, p.select(F.col("src").alias("id")).distinct().withColumn("value", F.col("id") % 7))


@query(f"WITH {N}, {R}, {C}, {P} SELECT src % 16 AS param, CAST(sum((src % 7) * (dst % 5)) AS BIGINT) AS grad FROM pairs GROUP BY 1")
def sparse_grad(spark, d):
    p = stash(pairs(spark, d).select("src", "dst", "weight", (F.col("src") % 16).alias("param")), "pairs")
    ids = lambda c, k: p.select(F.col(c).alias("id")).distinct().withColumn("value", F.col("id") % k)
    return graph.sparse_gradients(p, ids("src", 7), ids("dst", 5))[0]


LINKS = "links AS MATERIALIZED (SELECT src, dst, weight % 4 AS action FROM pairs WHERE n_rows > 1 UNION ALL SELECT dst, src, weight % 4 FROM pairs WHERE n_rows > 1)"


def links(spark: SparkSession, d: str) -> DataFrame:
    """Both ways along the pairs of more than one row: sparse, with several components."""
    p = stash(pairs(spark, d).where("n_rows > 1").select("src", "dst", (F.col("weight") % 4).alias("action")), "links")
    return p.unionByName(p.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "action"))


@query(f"""WITH RECURSIVE {N}, {R}, {C}, {P}, {LINKS}, r(id, distance) USING KEY (id) AS (SELECT min(src), 0 FROM links UNION SELECT l.dst, min(r.distance) + 1 FROM r JOIN links l ON r.id = l.src WHERE NOT EXISTS (SELECT 1 FROM recurring.r s WHERE s.id = l.dst) GROUP BY l.dst) SELECT id, distance FROM r WHERE id IS NOT NULL""")
def graph_reachable(spark, d):
    e = links(spark, d)
    return graph.reachable(e, e.agg(F.min("src").alias("id")).where("id is not null"), _cut)


@query(f"""WITH RECURSIVE {N}, {R}, {C}, {P}, {LINKS}, r(id, component) USING KEY (id) AS (SELECT DISTINCT src, src FROM links UNION SELECT l.dst, min(r.component) FROM r JOIN links l ON r.id = l.src JOIN recurring.r s ON s.id = l.dst WHERE r.component < s.component GROUP BY l.dst) SELECT id, component FROM r""")
def graph_components(spark, d):
    return graph.connected(links(spark, d), _cut)


@query(f"""WITH RECURSIVE {N}, {R}, {C}, {P}, {LINKS}, r(id, distance) USING KEY (id) AS (SELECT id, 0 FROM nodes WHERE nation = 2 AND id % 2 = 1 UNION SELECT l.src, min(r.distance) + 1 FROM r JOIN links l ON r.id = l.dst WHERE NOT EXISTS (SELECT 1 FROM recurring.r s WHERE s.id = l.src) GROUP BY l.src),
 t AS (SELECT r.id, r.distance, l.action, l.dst, row_number() OVER (PARTITION BY r.id ORDER BY l.action, l.dst) AS k FROM r LEFT JOIN (links l JOIN r n ON n.id = l.dst) ON l.src = r.id AND n.distance = r.distance - 1) SELECT id, distance, CAST(action AS BIGINT) AS action, dst AS next FROM t WHERE k = 1""")
def graph_shortest_actions(spark, d):
    """From every node the way to the nearest supplier of one nation."""
    goals = annotations(spark, d).where("nation = 2 and id % 2 = 1").select("id")
    return graph.shortest_actions(links(spark, d), goals, _cut)


def _cut(df: DataFrame) -> DataFrame:
    """Iterations are cut at a table in the shared folder."""
    from axonlake.sources.shared import stash

    return stash(df, "frontier")


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS numerator, count(*) FILTER (l_linestatus = 'O') AS denominator, count(*) FILTER (l_linestatus = 'F') / nullif(count(*) FILTER (l_linestatus = 'O'), 0) AS value FROM lineitem GROUP BY 1")
def ratio_defined(spark, d):
    out = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_linestatus") == "F").alias("numerator"), F.count_if(F.col("l_linestatus") == "O").alias("denominator"))
    return out.withColumn("value", divided(F.col("numerator"), F.col("denominator")))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal FROM orders")
def dense_ordinals(spark, d):
    return dense_index(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], "ordinal")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS k FROM lineitem) SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM r WHERE k = 1")
def first_row_wins(spark, d):
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return first_rows(table(spark, d, "lineitem").withColumn("at", key), ["l_suppkey"], "at").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")


@query(f"WITH {NR}, p AS (SELECT src, dst, CAST(sum(weight) AS BIGINT) AS weight FROM nr GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (ORDER BY abs(weight), src, dst) - 1 AS k, count(*) OVER () AS n FROM p) SELECT src, dst, weight FROM r WHERE k >= floor(n * 0.3)")
def magnitude_pruning(spark, d):
    from axonlake.operators.sampling import prune

    p = nations(spark, d).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    return prune(p, 0.3).select("src", "dst", "weight")


@query(f"WITH {NR}, p AS (SELECT src, dst, count(*) AS n FROM nr GROUP BY 1, 2) SELECT dst, sha256(string_agg(src || '|' || n, chr(10) ORDER BY src)) AS digest FROM p GROUP BY 1")
def ordered_hash(spark, d):
    from axonlake.functions.basic import ordered_digest

    p = nations(spark, d).groupBy("src", "dst").agg(F.count("*").alias("n"))
    return p.groupBy("dst").agg(ordered_digest(["src", "n"], ["src"]).alias("digest"))


@query(None)
def rewired_variants(spark, d):
    """Two degree-preserving variants of the pairs of customers and suppliers; tests check the degrees."""
    p = pairs(spark, d).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    return graph.rewire(dense_index(p, ["src", "dst"], "ord"), 0.5, [0, 1], lambda df: stash(df, "rewired"))
