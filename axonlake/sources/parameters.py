"""Parameter sets of a graph: tables of numbers for its edges and nodes, bound by digests to themselves and to the graph they were made for."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonlake.operators.digest import digest_of, ordered_digests

VERSION = "parameters/1"
#: Code of a missing transmitter, and the greatest of the others.
NONE, LAST = 255, 6
EDGE = "edge_index long, weight double, sign int, confidence double, transmitter int, matched long"
NODE = "node_index long, pre_total long, post_total long, primary_roi string"


class CorruptSet(ValueError):
    """The tables are not those the manifest speaks of, or another graph's."""


@dataclass(frozen=True)
class ParameterSet:
    edges: DataFrame
    nodes: DataFrame
    manifest: dict

    def check_graph(self, nodes: DataFrame, edges: DataFrame) -> None:
        """Refuses another graph than the one the set was made for."""
        if (found := graph_digests(nodes, edges)) != self.manifest["graph"]:
            raise CorruptSet(f"the set belongs to another graph: {self.manifest['graph']}, not {found}")


def graph_digests(nodes: DataFrame, edges: DataFrame) -> dict[str, str]:
    """Digests of a graph's nodes (index, id) and of its edges (source_index, target_index, abs_row), each in order."""
    return {"node_index": digest_of(nodes, ["index"], ["index", "id"]), "edge_order": digest_of(edges, ["source_index", "target_index", "abs_row"], ["source_index", "target_index"])}


def problems(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(section, index, problem) of all rows that no set may have: numbers that aren't finite, signs and codes out of range, indexes that are not 0, 1, 2, ..."""
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.lit(False))
    code = F.coalesce(F.col("transmitter").between(0, LAST) | (F.col("transmitter") == NONE), F.lit(False))
    edge = F.when(~finite("weight"), "weight").when(~F.coalesce(F.col("sign").between(-1, 1), F.lit(False)), "sign").when(~finite("confidence"), "confidence").when(~code, "transmitter")

    def gaps(df: DataFrame, section: str, index: str) -> DataFrame:
        """Indexes beyond the number of rows, repeated or null ones: without these n indexes are 0 to n - 1."""
        n = df.agg(F.count("*").alias("__n"))
        counts = df.groupBy(F.col(index).alias("index")).agg(F.count("*").alias("k")).join(F.broadcast(n))  # one row
        bad = F.col("index").isNull() | (F.col("index") < 0) | (F.col("index") >= F.col("__n")) | (F.col("k") > 1)
        return counts.where(bad).select(F.lit(section).alias("section"), "index", F.lit("index").alias("problem"))

    rows = edges.select(F.lit("edges").alias("section"), F.col("edge_index").alias("index"), edge.alias("problem")).where("problem is not null")
    return rows.unionByName(gaps(edges, "edges", "edge_index")).unionByName(gaps(nodes, "nodes", "node_index"))


def _sections(edges: DataFrame, nodes: DataFrame) -> dict[str, str]:
    """A digest of each column in the order of its index, so a report can say which one changed."""
    out = {}
    for kind, df in (("edge", edges), ("node", nodes)):
        row = ordered_digests(df, [f"{kind}_index"], {f"{kind}_{c}".replace(f"{kind}_{kind}", kind): [c] for c in df.columns}).first().asDict()
        out |= {name: f"{row['rows']}:{digest}" for name, digest in row.items() if name != "rows"}
    return out


def save_parameters(edges: DataFrame, nodes: DataFrame, graph: dict[str, str], path: str, report: dict | None = None) -> dict:
    """Writes a set (edges and nodes as in EDGE and NODE) and gives its manifest; never over what is there, and no set with a problem.

    The same set has the same manifest, whatever its partitions; graph: `graph_digests` of its graph.
    """
    spark = edges.sparkSession
    edges, nodes = edges.select(*(F.col(f.name).cast(f.dataType) for f in _schema(EDGE))), nodes.select(*(F.col(f.name).cast(f.dataType) for f in _schema(NODE)))
    if found := problems(edges, nodes).orderBy("section", "index").limit(3).collect():
        raise ValueError(f"the set has problems: {[tuple(r) for r in found]}")
    edges.write.mode("errorifexists").parquet(f"{path}/edges")
    nodes.write.mode("errorifexists").parquet(f"{path}/nodes")
    manifest = {"version": VERSION, "graph": graph, "sections": _sections(edges, nodes), "report": report or {}}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "m string").coalesce(1).write.mode("errorifexists").text(f"{path}/manifest")
    return manifest


def load_parameters(spark: SparkSession, path: str) -> ParameterSet:
    """The set, if its tables have the manifest's digests."""
    try:
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
        if manifest["version"] != VERSION:
            raise CorruptSet(f"version {manifest['version']}")
        edges, nodes = spark.read.schema(EDGE).parquet(f"{path}/edges"), spark.read.schema(NODE).parquet(f"{path}/nodes")
        found = _sections(edges, nodes)
    except (json.JSONDecodeError, KeyError, TypeError) as e:
        raise CorruptSet(f"the manifest can't be read: {e}") from e
    if changed := sorted(k for k in {*found, *manifest["sections"]} if found.get(k) != manifest["sections"].get(k)):
        raise CorruptSet(f"sections differ from the manifest: {changed}")
    return ParameterSet(edges, nodes, manifest)


def _schema(ddl: str):
    from pyspark.sql import types as T

    return T.StructType.fromDDL(ddl)
