"""Tables with declared schemas: CSV releases, field mappings, record logs, manifests, audio; stores and reports."""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class FieldMapping:
    """Logical fields to source columns; optional fields may be left out and then are not made up."""

    columns: dict[str, str]
    types: dict[str, str] = field(default_factory=dict)
    optional: frozenset[str] = frozenset()

    def apply(self, df: DataFrame) -> DataFrame:
        """The logical columns; a missing column or another type is an error before anything runs."""
        kinds, out = dict(df.dtypes), []
        for name, source in self.columns.items():
            if source not in kinds:
                if name in self.optional:
                    continue
                raise ValueError(f"field {name}: no column {source}")
            if name in self.types and kinds[source] != self.types[name]:
                raise ValueError(f"field {name}: column {source} is {kinds[source]}, not {self.types[name]}")
            out.append(F.col(source).alias(name))
        return df.select(*out)

    def status(self, name: str) -> str:
        return "mapped" if name in self.columns else "not_mapped"


def csv_table(spark: SparkSession, path: str, types: dict[str, str]) -> DataFrame:
    """A CSV or CSV.gz table with a header: names trimmed of spaces and a byte-order mark, required columns checked, cells trimmed, blanks null; what can't be cast is an error (ANSI)."""
    raw = spark.read.csv(path, header=True, inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    # the header as it is in the file: Spark numbers repeated names, which would hide them
    head = spark.read.csv(path, header=False, inferSchema=False).first() or ()
    names = [(c or "").lstrip("﻿").strip() or f"_c{i}" for i, c in enumerate(head)]
    if len(set(names)) != len(names):
        raise ValueError("a column name is repeated")
    if missing := [c for c in types if c not in names]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    trimmed = raw.toDF(*names)
    return trimmed.select(*(F.nullif(F.trim(c), F.lit("")).cast(t).alias(c) for c, t in types.items()))


#: Columns of the three tables of a release.
RELEASE = {
    "connections": {"pre_root_id": "long", "post_root_id": "long", "syn_count": "long", "neuropil": "string"},
    "classification": {"root_id": "long", "flow": "string", "super_class": "string", "class": "string", "sub_class": "string", "cell_type": "string", "side": "string"},
    "neurons": {"root_id": "long", "nt_type": "string", "nt_type_score": "double"},
}


def convert_release(spark: SparkSession, paths: dict[str, str], out: str, rows_per_file: int = 250_000) -> dict:
    """Writes the three tables as Parquet, classification with included = released, and gives back a manifest."""
    manifest = {}
    for name, types in RELEASE.items():
        df = csv_table(spark, paths[name], types)
        if name == "classification":
            df = df.withColumn("included", F.lit("released"))
        df.write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file).parquet(f"{out}/{name}")
        manifest[name] = {"path": f"{out}/{name}", "columns": df.columns}
    return manifest


def strict_json(text: str, fields: set[str] | None = None, most: int = 1 << 20):
    """A JSON document: bounded, without repeated keys (letters' case apart), unknown fields or anything after it."""
    if len(text.encode()) > most:
        raise ValueError("the document is too long")

    def pairs(items):
        seen = set()
        for k, _ in items:
            if k.casefold() in seen:
                raise ValueError(f"repeated key {k}")
            seen.add(k.casefold())
        return dict(items)

    out = json.loads(text, object_pairs_hook=pairs)
    if fields is not None and (extra := set(out) - fields):
        raise ValueError(f"unknown fields: {', '.join(sorted(extra))}")
    return out


def canonical_digest(document) -> str:
    """SHA-256 of the document with sorted keys."""
    return hashlib.sha256(json.dumps(document, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files, computed where they are read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


RECORD = T.StructType([T.StructField("request_id", T.StringType()), T.StructField("input_hash", T.StringType()), T.StructField("input", T.StringType()), T.StructField("output", T.StringType()), T.StructField("created", T.StringType()), T.StructField("_bad", T.StringType())])


def record_log(spark: SparkSession, path: str, held: DataFrame | None = None) -> DataFrame:
    """JSON lines as records; blank lines are skipped, a malformed line or one whose input is held out (sha256) is an error."""
    df = spark.read.schema(RECORD).option("columnNameOfCorruptRecord", "_bad").json(path)
    bad = F.when(F.col("_bad").isNotNull() | F.col("request_id").isNull() | F.col("input_hash").isNull(), F.raise_error(F.lit("malformed record")).cast("boolean")).otherwise(True)
    df = df.where(bad).drop("_bad")
    if held is not None:
        marked = df.join(held.select(F.col("sha256").alias("__h")).distinct(), F.col("input_hash") == F.col("__h"), "left")
        df = marked.where(F.when(F.col("__h").isNotNull(), F.raise_error(F.lit("a held-out input is in the log")).cast("boolean")).otherwise(True)).drop("__h")
    return df


def append_records(records: DataFrame, path: str) -> None:
    """Appends records; a null id or hash is an error."""
    ok = F.when(F.col("request_id").isNull() | F.col("input_hash").isNull(), F.raise_error(F.lit("a record needs an id and a hash")).cast("boolean")).otherwise(True)
    records.where(ok).write.mode("append").json(path)


def corpus(spark: SparkSession, manifest: str, base: str | None = None) -> DataFrame:
    """Documents of a JSON-lines manifest (id, source, text or path, license): inline text or that of a file under base; a repeated id, a missing license or text is an error."""
    schema = "id string, source string, text string, path string, license struct<holder: string, terms: string, source: string>"
    df = spark.read.schema(schema).json(manifest)
    if base is not None:
        files = spark.read.text(f"{base}/*", wholetext=True).select(F.col("value").alias("__text"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("path"))
        df = df.join(files, "path", "left").withColumn("text", F.coalesce("text", "__text")).drop("__text")
    n = df.groupBy("id").agg(F.count("*").alias("__n"))
    problem = F.when(F.col("__n") > 1, "repeated id").when(F.col("license").isNull() | F.col("license.terms").isNull(), "no license").when(F.col("text").isNull(), "no text")
    return df.join(n, "id").where(F.when(problem.isNotNull(), F.raise_error(F.concat(F.col("id"), F.lit(": "), problem)).cast("boolean")).otherwise(True)).drop("__n", "path")


def hierarchy(df: DataFrame, column: str, depth: int = 64) -> DataFrame:
    """(level, nodes) of a JSON hierarchy {name, children: [...]}, level by level; deeper than `depth` is an error."""
    level, out = df.select(F.col(column).alias("node")), None
    for k in range(depth + 1):
        n = level.agg(F.count("*").alias("nodes")).select(F.lit(k).alias("level"), "nodes")
        if not n.first()["nodes"]:
            return out if out is not None else n.limit(0)
        out = n if out is None else out.unionByName(n)
        level = level.select(F.explode(F.from_json(F.get_json_object("node", "$.children"), "array<string>")).alias("node"))
    raise ValueError(f"the hierarchy is deeper than {depth}")


#: Columns of a trajectory table.
TRAJECTORY = {"fname": "string", "fly": "string", "condition": "string", "segment": "string", "t": "double", "x_cm": "double", "y_cm": "double"}


def trajectory(spark: SparkSession, path: str, extra: dict[str, str] | None = None) -> DataFrame:
    """Points of a trajectory table; values must be finite."""
    df = csv_table(spark, path, TRAJECTORY | (extra or {}))
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))
    return df.where(F.when(finite("t") & finite("x_cm") & finite("y_cm"), True).otherwise(F.raise_error(F.lit("t, x and y must be finite")).cast("boolean")))


def _pcm(content: bytes) -> tuple:
    """(rate, array of samples by channels) of a RIFF WAVE file with 8-, 16- or 32-bit integer samples."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("no RIFF WAVE file")
    at, head, data = 12, None, b""
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack("<I", content[at + 4 : at + 8])[0]
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt ":
            head = struct.unpack("<HHIIHH", body[:16])
        elif name == b"data":
            data = body
        at += 8 + size + size % 2
    if head is None or head[0] != 1 or head[5] not in (8, 16, 32):
        raise ValueError("only integer PCM is read")
    import numpy as np

    x = np.frombuffer(data[: len(data) // (head[5] // 8) * (head[5] // 8)], {8: np.uint8, 16: "<i2", 32: "<i4"}[head[5]]).astype(float)
    x = (x - 128) / 128 if head[5] == 8 else x / 2.0 ** (head[5] - 1)
    return head[2], x[: len(x) // head[1] * head[1]].reshape(-1, head[1])


def audio(spark: SparkSession, path: str) -> DataFrame:
    """(path, rate, samples) of WAVE files, mixed down to one channel and scaled to a peak of 1."""

    @F.pandas_udf("rate int, samples array<double>")
    def decode(content: pd.Series) -> pd.DataFrame:
        rows = []
        for c in content:
            rate, x = _pcm(bytes(c))
            mono = x.mean(axis=1)
            peak = abs(mono).max(initial=0.0)
            rows.append((rate, (mono / peak if peak else mono).tolist()))
        return pd.DataFrame(rows, columns=["rate", "samples"])

    return spark.read.format("binaryFile").load(path).withColumn("x", decode("content")).select("path", "x.rate", "x.samples")


def save_graph(nodes: DataFrame, edges: DataFrame, report: dict, path: str) -> None:
    """Writes nodes, edges and the report; never over what is there."""
    nodes.write.mode("errorifexists").parquet(f"{path}/nodes")
    edges.write.mode("errorifexists").parquet(f"{path}/edges")
    digest = {"nodes": table_digest(nodes), "edges": table_digest(edges)}
    spark = nodes.sparkSession
    spark.createDataFrame([(json.dumps(report | {"digest": digest}, sort_keys=True),)], "report string").coalesce(1).write.mode("errorifexists").text(f"{path}/report")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """Nodes, edges and report; tables that don't have the report's digests are refused."""
    report = json.loads(spark.read.text(f"{path}/report").first()[0])
    nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    if report["digest"] != {"nodes": table_digest(nodes), "edges": table_digest(edges)}:
        raise ValueError("the tables don't have the digests of the report")
    return nodes, edges, report


def table_digest(df: DataFrame) -> str:
    """Row count and a sum of row hashes, free of order and partitioning: one pass, one row to the driver."""
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).alias("h")).first()
    return f"{r['n']}:{r['h']}"


def markdown(df: DataFrame, rows: int = 1000) -> str:
    """A report of at most so many rows as a Markdown table; null is an empty cell. More rows are an error, not a cut."""
    found = df.limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"a report has at most {rows} rows")
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line(["" if v is None else str(v).replace("|", "\\|") for v in r]) for r in found)]) + "\n"


def completion(requirements: DataFrame, evidence: DataFrame) -> DataFrame:
    """Requirements (id, status, evidence) counted by status, and how many of them name evidence that is not there."""
    known = evidence.select(F.col("path").alias("evidence"), F.lit(1).alias("__e")).distinct()
    return requirements.join(known, "evidence", "left").groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("evidence").isNotNull() & F.col("__e").isNull()).alias("missing_evidence"))


def catalogue(spark: SparkSession, rows: Iterable[tuple[str, str, str, int]]) -> DataFrame:
    """(url, role, sha256, bytes) of audited sources."""
    return spark.createDataFrame(list(rows), "url string, role string, sha256 string, bytes long")
