"""Shared working folders, and frames that are evaluated once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, label: str = "work") -> str:
    """A new folder name below spark.checkpoint.dir, which all executors reach; a local one where that isn't set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}/strata"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def once(df: DataFrame, label: str = "once") -> DataFrame:
    """The rows of df as written now. What is read from it later agrees, whatever executors are lost."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
