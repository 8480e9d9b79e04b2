"""Tables in the folder that driver and executors share, to cut a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders made for applications that name none, by application.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; unset: a temporary folder in local mode, else a folder of the warehouse."""
    context = spark.sparkContext
    if found := context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if context.applicationId not in _OWN:
        local = context.master.startswith("local[") or context.master == "local"
        _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-shared-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    return _OWN[context.applicationId].rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """df written once as a table and read back; the table goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    forget(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Has the path's file system delete it at the end of the application, whatever the store; a folder that isn't there yet is made."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(at)
    store.deleteOnExit(at)
