"""Shared-folder helpers: cutting lineage, and raw files beside Spark's own."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, which driver and executors share.

    Where that setting is empty a temporary folder serves, on a local master only.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quantloom-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by reliable ``checkpoint()`` in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", "")
        if base:
            spark.sparkContext.setCheckpointDir(base)
        else:
            shared_folder(spark, "checkpoint")
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, written with ``options``, read back."""
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.options(**{"compression": "zstd"} | (options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_store(uri: str):
    """``(filesystem, path)`` of a folder URI, for raw range reads and writes inside tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)
