"""Helpers shared by the training-data operators: tables in the shared checkpoint folder, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most this many slim rows (an id and a few numbers) may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 1_000_000
#: White space that separates words, everywhere in this subpackage.
SPACE = r"\x20\x09-\x0D"


#: Folders made for applications that name none, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (local mode) a new temporary one, else a folder of the warehouse."""
    context = spark.sparkContext
    if found := context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if context.applicationId not in _OWN:
        local = context.master.startswith("local[") or context.master == "local"
        _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-checkpoints-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
    return _OWN[context.applicationId].rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """df written once as a table in the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows (counted); else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(key: str, folds: int) -> F.Column:
    """crc32 of the id as text leaves 1 when divided by folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds == 1
