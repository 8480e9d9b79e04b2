"""Audited nodes and edges: selection with one reason for each row left out, aggregates, comparisons, iterations over links."""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonlake.functions.basic import divided, is_unknown
from axonlake.operators.order import dense_index, first_rows, seeded
from axonlake.sources.shared import stash

EDGE_REASONS = ["null_endpoint", "invalid_id", "missing_annotation", "predicate_false", "kept"]


def classify_nodes(annotations: DataFrame, predicate: Column, key: str = "id", ordinal: str = "abs_row") -> DataFrame:
    """annotations with `reason`: null_id, invalid_id (negative), duplicate (not the first row of its id), predicate_false or kept, in that order."""
    firsts = annotations.where(F.col(key) >= 0).groupBy(key).agg(F.min(ordinal).alias("__first"))
    marked = annotations.join(firsts, key, "left")
    reason = F.when(F.col(key).isNull(), "null_id").when(F.col(key) < 0, "invalid_id").when(F.col(ordinal) != F.col("__first"), "duplicate").when(~F.coalesce(predicate, F.lit(False)), "predicate_false").otherwise("kept")
    return marked.withColumn("reason", reason).drop("__first")


def node_catalog(classified: DataFrame, key: str = "id") -> DataFrame:
    """The kept nodes with dense indices by ascending id."""
    return dense_index(classified.where("reason = 'kept'").drop("reason"), [key], "node_index")


def with_predictions(nodes: DataFrame, predictions: DataFrame, key: str = "id", label: str = "label", ordinal: str = "abs_row") -> DataFrame:
    """nodes with the first prediction row of each id; status `predicted`, or `unknown` for none, null, blank or unclear."""
    first = first_rows(predictions.where(F.col(key) >= 0).select(key, label, ordinal), [key], ordinal).select(key, label)
    out = nodes.join(first, key, "left")
    return out.withColumn("status", F.when(is_unknown(F.col(label)), "unknown").otherwise("predicted"))


def classify_edges(rows: DataFrame, classified_nodes: DataFrame, key: str = "id") -> DataFrame:
    """rows (src, dst, weight, abs_row) with `reason`: null_endpoint, invalid_id, missing_annotation, predicate_false or kept.

    The ids that are annotated at all are told from those selected by one slim table (id, selected), joined twice;
    Spark broadcasts it if it is small.
    """
    state = classified_nodes.where(F.col(key) >= 0).groupBy(key).agg(F.max(F.col("reason") == "kept").alias("selected"))
    of = lambda end: state.select(F.col(key).alias(end), F.col("selected").alias(f"{end}_selected"))
    both = rows.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    reason = (
        F.when(F.col("src").isNull() | F.col("dst").isNull(), "null_endpoint")
        .when((F.col("src") < 0) | (F.col("dst") < 0), "invalid_id")
        .when(F.col("src_selected").isNull() | F.col("dst_selected").isNull(), "missing_annotation")
        .when(~(F.col("src_selected") & F.col("dst_selected")), "predicate_false")
        .otherwise("kept")
    )
    return both.withColumn("reason", reason).drop("src_selected", "dst_selected")


def edge_view(classified: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """The kept rows with dense end points: (source_index, target_index, abs_row, weight)."""
    at = lambda end, name: nodes.select(F.col(key).alias(end), F.col("node_index").alias(name))
    kept = classified.where("reason = 'kept'")
    return kept.join(at("src", "source_index"), "src").join(at("dst", "target_index"), "dst").select("source_index", "target_index", "abs_row", "weight")


def aggregate_pairs(rows: DataFrame, src: str = "src", dst: str = "dst", weight: str = "weight") -> DataFrame:
    """One row for each pair: summed weight, number of rows, first row. A null or negative weight is an error; sums are checked by ANSI arithmetic."""
    ok = F.when(F.col(weight).isNull() | (F.col(weight) < 0), F.raise_error(F.lit("weights must be known and not negative")).cast("long")).otherwise(F.col(weight))
    return rows.groupBy(src, dst).agg(F.sum(ok).alias("weight"), F.count("*").alias("n_rows"), F.min("abs_row").alias("first_row"))


def duplicate_pairs(rows: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Unique pairs, pairs with several rows, and rows beyond the first of their pair."""
    pairs = rows.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).groupBy(src, dst).agg(F.count("*").alias("n"))
    return pairs.agg(F.count("*").alias("unique_pairs"), F.count_if(F.col("n") > 1).alias("duplicate_pairs"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def self_loops(rows: DataFrame, src: str = "src", dst: str = "dst", weight: str = "weight") -> DataFrame:
    """One row: rows, rows from an end to itself, unique such ends, and the summed weight of all rows."""
    loop = F.col(src) == F.col(dst)
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(loop).alias("self_loops"), F.count_distinct(F.when(loop, F.col(src))).alias("loop_nodes"), F.sum(weight).alias("total"))


def endpoints(rows: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Distinct ends of all rows, which are read once."""
    return rows.select(F.explode(F.array(src, dst)).alias("id")).where("id is not null").distinct()


def prediction_profile(predictions: DataFrame, key: str = "id", label: str = "label") -> DataFrame:
    """One row: rows, null and invalid (negative) ids, unique ids, rows beyond the first of their id, rows with an unknown label and their share."""
    valid, unknown = F.when(F.col(key) >= 0, F.col(key)), is_unknown(F.col(label))
    out = predictions.agg(F.count("*").alias("n_rows"), F.count_if(F.col(key).isNull()).alias("null_ids"), F.count_if(F.col(key) < 0).alias("invalid_ids"), F.count_distinct(valid).alias("unique_ids"), F.count(valid).alias("valid_rows"), F.count_if(unknown).alias("unknown_rows"))
    return out.select("n_rows", "null_ids", "invalid_ids", "unique_ids", (F.col("valid_rows") - F.col("unique_ids")).alias("duplicate_rows"), "unknown_rows", divided(F.col("unknown_rows"), F.col("n_rows")).alias("unknown_ratio"))


def lookup_counts(nodes: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """One row: nodes that the table has, nodes that it lacks, its ids with several rows and the rows beyond their first."""
    per = table.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    found = nodes.select(key).join(per, key, "left").agg(F.count("n").alias("matched"), F.count_if(F.col("n").isNull()).alias("missing"))
    return found.crossJoin(per.agg(F.count_if(F.col("n") > 1).alias("duplicate_ids"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows")))  # one row each


def distinct_windows(windows: DataFrame, low: str, high: str, ordinal: str) -> DataFrame:
    """(low, high, position): each window once, positions by the least ordinal at which it is seen."""
    first = windows.groupBy(low, high).agg(F.min(ordinal).alias("__first"))
    return dense_index(first, ["__first"], "position").drop("__first")


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: rows, nulls, negatives, zeros, sum of what is known and whether that sum is valid (no negatives); one pass."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns)))
    v = F.col("v")
    return df.select(each.alias("x")).select("x.*").groupBy("column").agg(F.count("*").alias("n_rows"), F.count_if(v.isNull()).alias("nulls"), F.count_if(v < 0).alias("negatives"), F.count_if(v == 0).alias("zeros"), F.sum(v).alias("total"), (F.count_if(v < 0) == 0).alias("valid"))


def isolated(nodes: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """Nodes that no edge touches."""
    return nodes.join(endpoints(edges).withColumnRenamed("id", key), key, "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """In- and out-degree of every end, counted in one shuffle."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.groupBy("x.id").agg(F.sum("x.o").alias("out_degree"), F.sum("x.i").alias("in_degree"))


def compare(a: DataFrame, b: DataFrame, a_edges: DataFrame, b_edges: DataFrame, key: str = "id", namespaces: tuple[str, str] | None = None) -> DataFrame:
    """Counts of two graphs of one namespace and of the ids that they share; different namespaces are refused, as no mapping joins them."""
    if namespaces and namespaces[0] != namespaces[1]:
        raise ValueError("graphs of different namespaces can't be compared: there is no mapping between them")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    shared = a.select(key).intersect(b.select(key)).agg(F.count("*").alias("shared_ids"))
    return one(a, "nodes_a").crossJoin(one(b, "nodes_b")).crossJoin(one(a_edges, "edges_a")).crossJoin(one(b_edges, "edges_b")).crossJoin(shared)  # one row each


def merge_datasets(*_args, **_kwargs):
    """Always refused: ids of different datasets have no mapping."""
    raise ValueError("datasets can't be merged: there is no evidence that maps their ids")


def sparse_step(edges: DataFrame, values: DataFrame) -> DataFrame:
    """For each target the sum of weight * value of its sources: edges (src, dst, weight), values (id, value)."""
    return edges.join(values.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def sparse_gradients(edges: DataFrame, values: DataFrame, upstream: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gradients of sparse_step: of each shared parameter (edges.param) and of each source value."""
    joined = edges.join(values.withColumnRenamed("id", "src"), "src").join(upstream.select(F.col("id").alias("dst"), F.col("value").alias("up")), "dst")
    return joined.groupBy("param").agg(F.sum(F.col("value") * F.col("up")).alias("grad")), joined.groupBy(F.col("src").alias("id")).agg(F.sum(F.col("weight") * F.col("up")).alias("grad"))


def _keep(tables: list[tuple[int, DataFrame]], frontier: DataFrame, cut) -> None:
    """Adds a frontier to what has been seen. Two tables of as many rounds become one, so a row is written a logarithm of the rounds times, and there are as few tables."""
    tables.append((1, frontier))
    while len(tables) > 1 and tables[-1][0] == tables[-2][0]:
        (n, late), (_, early) = tables.pop(), tables.pop()
        tables.append((2 * n, cut(early.unionByName(late))))


def _seen(tables: list[tuple[int, DataFrame]]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, (df for _, df in tables))


def reachable(edges: DataFrame, start: DataFrame, checkpoint=None) -> DataFrame:
    """(id, distance) of all nodes that can be reached from start (id), by frontiers until one is empty; `checkpoint` writes a frontier and reads it back."""
    cut = checkpoint or (lambda df: stash(df, "frontier"))
    tables: list[tuple[int, DataFrame]] = []
    frontier, d = cut(start.select("id").distinct().withColumn("distance", F.lit(0))), 0
    while d == 0 or not frontier.isEmpty():
        _keep(tables, frontier, cut)
        d += 1
        step = frontier.select(F.col("id").alias("src")).join(edges.select("src", F.col("dst").alias("id")), "src").select("id").distinct()
        frontier = cut(step.join(_seen(tables), "id", "left_anti").withColumn("distance", F.lit(d)))
    return _seen(tables)


def shortest_actions(edges: DataFrame, goals: DataFrame, checkpoint=None) -> DataFrame:
    """(id, distance, action, next): for each node that can reach a goal (id) how far the nearest is, and what to do there: edges are (src, dst, action).

    Frontiers go backwards from the goals and carry the choice: of the edges that lead to a node one step nearer the least action, then the
    least next node. At a goal action and next are null. It ends when a frontier is empty.
    """
    cut = checkpoint or (lambda df: stash(df, "frontier"))
    tables: list[tuple[int, DataFrame]] = []
    kinds = {c: edges.schema[c].dataType for c in ("action", "dst")}
    none = [F.lit(None).cast(kinds["action"]).alias("action"), F.lit(None).cast(kinds["dst"]).alias("next")]
    frontier, d = cut(goals.select("id").distinct().select("id", F.lit(0).alias("distance"), *none)), 0
    while d == 0 or not frontier.isEmpty():
        _keep(tables, frontier, cut)
        d += 1
        back = edges.join(frontier.select(F.col("id").alias("dst")), "dst").groupBy(F.col("src").alias("id")).agg(F.min(F.struct("action", F.col("dst").alias("next"))).alias("x"))
        frontier = cut(back.join(_seen(tables), "id", "left_anti").select("id", F.lit(d).alias("distance"), "x.action", "x.next"))
    return _seen(tables)


def connected(links: DataFrame, checkpoint=None) -> DataFrame:
    """(id, component) of the ends of links (src, dst): the smallest id that can be reached, either way along the links."""
    cut = checkpoint or (lambda df: stash(df, "labels"))
    both = cut(links.select("src", "dst").union(links.select("dst", "src")).distinct())
    labels = cut(both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.col("src")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("dst"), F.col("component").alias("c")), "dst").groupBy(F.col("src").alias("id")).agg(F.min("c").alias("c"))
        step = labels.join(near, "id").select("id", F.least("component", "c").alias("component"))
        # then to the label of the label, which halves the distance left
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = cut(step.join(jump, "component", "left").select("id", F.least("component", F.coalesce("further", "component")).alias("component")))
        if not new.join(labels.withColumnRenamed("component", "old"), "id").where("component <> old").limit(1).count():
            return new
        labels = new


def shuffled_column(df: DataFrame, column: str, order: list[str], seed: int) -> DataFrame:
    """df with the values of a column dealt anew: position by `order` meets position by a seeded hash. The values as a whole stay the same."""
    own = dense_index(df, order, "__position")
    other = dense_index(own.select(column, F.conv(F.substring(seeded(seed, "__position"), 1, 15), 16, 10).cast("long").alias("__draw"), "__position"), ["__draw", "__position"], "__to").select(F.col("__to").alias("__position"), F.col(column).alias("__new"))
    return own.join(other, "__position").withColumn(column, F.col("__new")).drop("__position", "__new")


def topology_digest(edges: DataFrame) -> str:
    """Digest of sources and targets in canonical order (source_index, target_index, abs_row), as a tree over all rows."""
    from axonlake.operators.digest import digest_of

    return digest_of(edges, ["source_index", "target_index", "abs_row"], ["source_index", "target_index"])


def rewire(edges: DataFrame, fraction: float, seeds: list[int], cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Degree-preserving variants: for each seed ceil(fraction * edges) attempts to swap the targets of two edges, with what became of them.

    An attempt that gives a self loop or a pair that is there already is refused and counted. Attempts are made in rounds: edges are
    ordered by a seeded hash, neighbours in that order form pairs that share no edge, joins tell which new pairs exist, and of
    attempts that propose one pair the first counts. So no task holds a variant. `cut` writes a table and reads it back.
    Edges with a repeated (src, dst) are an error. Returns (seed, src, dst, ord, swapped, refused_loop, refused_duplicate).
    """
    edges = cut(edges.select("src", "dst", "ord"))
    n, distinct = edges.agg(F.count("*"), F.count_distinct("src", "dst")).first()
    if distinct < n:
        raise ValueError("a graph with repeated pairs can't be rewired")
    variants = []
    for seed in seeds:
        own, left, counts, turn = edges, math.ceil(fraction * n), Counter(), 0
        while left and n > 1:
            draw = F.conv(F.substring(seeded(seed, F.lit(str(turn)), "ord"), 1, 15), 16, 10).cast("long")
            placed = dense_index(own.withColumn("draw", draw), ["draw", "ord"], "at").withColumn("pair", F.floor(F.col("at") / 2))
            tries, edge = min(left, n // 2), F.struct("src", "dst", "ord")
            both = placed.where(F.col("pair") < tries).groupBy("pair").agg(F.min_by(edge, "at").alias("e"), F.max_by(edge, "at").alias("f"))
            swapped = F.array(F.struct("e.src", F.col("f.dst").alias("dst"), "e.ord"), F.struct("f.src", F.col("e.dst").alias("dst"), "f.ord"))
            asked = both.select("pair", F.explode(swapped).alias("x")).select("pair", "x.*")
            first = asked.groupBy("src", "dst").agg(F.min("pair").alias("first"))
            seen = asked.join(first, ["src", "dst"]).join(own.select("src", "dst", F.lit(True).alias("there")), ["src", "dst"], "left")
            loop, taken = F.max(F.col("src") == F.col("dst")).alias("loop"), F.max((F.col("first") < F.col("pair")) | F.col("there").isNotNull()).alias("taken")
            verdict = cut(seen.groupBy("pair").agg(loop, taken, F.collect_list(F.struct("ord", "dst")).alias("new")))
            for r in verdict.groupBy("loop", "taken").agg(F.count("*").alias("n")).collect():
                counts["loop" if r["loop"] else "taken" if r["taken"] else "swapped"] += r["n"]
            new = verdict.where("not loop and not taken").select(F.explode("new").alias("x")).select("x.ord", F.col("x.dst").alias("new"))
            own = cut(own.join(new, "ord", "left").select("src", F.coalesce("new", "dst").alias("dst"), "ord"))
            left, turn = left - tries, turn + 1
        said = {"swapped": counts["swapped"], "refused_loop": counts["loop"], "refused_duplicate": counts["taken"]}
        variants.append(own.select(F.lit(seed).cast("long").alias("seed"), "src", "dst", "ord", *(F.lit(v).cast("long").alias(k) for k, v in said.items())))
    return functools.reduce(DataFrame.unionByName, variants)
