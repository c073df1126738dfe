"""Landing files and database tables."""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FORMATS = {".xlsx": "xlsx", ".csv": "csv", ".parquet": "parquet", ".json": "json"}


def read_file(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A landing file by its ending."""
    kind = FORMATS[os.path.splitext(path)[1]]
    if kind == "xlsx":
        from strata.sources.xlsx import register

        register(spark)
    reader = spark.read.format(kind)
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "csv":
        reader = reader.option("header", "true")
    return reader.load(path)


def pending(spark: SparkSession, landing: str, done: Iterable[str], schema: StructType | str | None = None) -> list[tuple[str, Callable[[], DataFrame]]]:
    """Landing files that aren't done, oldest first, each with a function that reads it."""
    folder = Path(landing)
    if not folder.is_dir():
        raise FileNotFoundError(f"no landing folder {landing}")
    known = set(done)
    files = sorted((p for p in folder.iterdir() if p.suffix in FORMATS and p.name not in known), key=lambda p: (p.stat().st_mtime, p.name))
    return [(p.name, lambda p=p: read_file(spark, str(p), schema)) for p in files]


def archive(path: str, folder: str) -> Path:
    """Move a processed file away; what is archived already stays so."""
    source, target = Path(path), Path(folder) / Path(path).name
    target.parent.mkdir(parents=True, exist_ok=True)
    if not source.exists():
        if target.exists():
            return target
        raise FileNotFoundError(path)
    shutil.move(source, target)
    return target


def jdbc(spark: SparkSession, url: str, table: str, driver: str | None = None, partition: tuple[str, str, str, int] | None = None, properties: dict[str, str] | None = None) -> DataFrame:
    """A table over JDBC; partition (column, lower, upper, parts) reads it in parallel. Passwords come from the caller."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", "10000")
    if driver:
        reader = reader.option("driver", driver)
    if partition:
        column, lower, upper, parts = partition
        reader = reader.option("partitionColumn", column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", parts)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    return reader.load()
