"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_stored: dict[str, None] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local session, as in tests, gets a folder of its own where that is unset."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="equipoise-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def store(df: DataFrame) -> DataFrame:
    """Write df and read it again: cuts the lineage, and a lost executor costs no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/equipoise-{uuid.uuid4().hex}"
    _stored[path] = None
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    _stored.pop(path, None)


def drop(df: DataFrame | None) -> None:
    """Delete what store() wrote, once nothing that is still to be computed reads it."""
    path = getattr(df, "_stored_at", None)
    if path:
        _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all that this process has stored; results that still read it must have been written before."""
    for path in list(_stored):
        _delete(spark, path)
