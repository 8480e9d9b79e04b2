"""A pipeline over the documents: toxicity, near duplicates, benchmark passages, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept and is written and read again.
In every stage a row is judged by its own text, whatever its doc_id: null and repeated ids are rows like others. A null or empty text
has nothing to reject, is no copy of anything and stays. Columns besides those of documents ride along, whatever their
names, but for those that a stage adds (the last: size, shard, slot) or that begin with two underscores. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonlake.llm import decontam, mixing, neardup, sharding, toxicity
from axonlake.llm.common import read, small, stash


#: Name of the row number that a stage gives its rows.
ROW = "__row"


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a number for each row, written, so that every reading sees the same numbers."""
    return stash(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def _by_row(rows: DataFrame) -> DataFrame:
    """(doc_id, text) of numbered rows with the row number as doc_id."""
    return rows.select(F.col(ROW).alias("doc_id"), "text")


def _without(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """Numbered rows but for those with these row numbers as doc_id; the numbers are broadcast if a count says that they are few."""
    gone = numbers.select(F.col("doc_id").alias("__gone")).distinct()
    return rows.join(small(stash(gone, "gone")), F.col(ROW) == F.col("__gone"), "left_anti").drop(ROW)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier chain rejects go, whatever their doc_id. A row and its verdict pass together, so none is numbered, written or joined."""
    verdict = toxicity.scored(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")), keep=docs.columns, prefix="__")
    return verdict.where("not __rejected").drop(*(c for c in verdict.columns if c not in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows as similar as 0.8 in five-word shingles, exact copies included, one stays: the smallest doc_id (null last), then the first row. Rows without words stay."""
    rows = _numbered(docs)
    groups = neardup.near_duplicates(_by_row(rows), percent=80).where("n_shingles > 0").select(F.col("doc_id").alias("__at"), F.col("component_id").alias("__group"))
    groups = stash(groups.join(rows.select(ROW, F.col("doc_id").alias("__id")), F.col("__at") == F.col(ROW)).select("__at", "__group", "__id"), "groups")
    many = groups.groupBy("__group").agg(F.count("*").alias("__n"), F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__at")).alias("__first")).where("__n > 1")
    gone = groups.join(small(many.select("__group", F.col("__first.__at").alias("__kept"))), "__group").where("__at <> __kept")
    return _without(rows, gone.select(F.col("__at").alias("doc_id")))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a benchmark item, as it stands or re-parameterised, go, whatever their doc_id."""
    rows = _numbered(docs)
    return _without(rows, decontam.leaks(_by_row(rows), read(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as the mix of 150 % of the words asks, sources weighing 3, 1, 2 and at most 2 epochs. A source without words gives no rows."""
    # columns with names that the mix uses ride along under others
    names = {c: f"__kept_{i}" if c in mixing.ADDED else c for i, c in enumerate(docs.columns)}
    mixed = mixing.mix(docs.withColumnsRenamed(names), mixing.word_count(), keep=list(names.values()), stored=False)
    return mixing.repeat(mixed.select(*(F.col(own).alias(c) for c, own in names.items()), F.col("copies").alias("__copies")), "__copies")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """8 contiguous shards of near-equal bytes in the order of doc_id (null first): the documents with size, shard and slot, which replace columns of these names. The copies that the mix made travel as one row."""
    return sharding.contiguous_shards(docs, sharding.text_bytes(), ["doc_id"], repeated=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The classifier chain has no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
