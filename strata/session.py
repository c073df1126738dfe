"""Sessions and loggers."""

from __future__ import annotations

import logging
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def get_session(name: str = "strata", master: str | None = None, settings: dict[str, str] | None = None) -> SparkSession:
    """A session with adaptive execution and UTC; the cluster's own settings win where it has them."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    for key, value in (base | (settings or {})).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_strata_shipped", False):
        return
    package = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="strata-")) / "strata.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    context.addPyFile(str(path))
    context._strata_shipped = True


def get_logger(name: str, level: int = logging.INFO) -> logging.Logger:
    """A logger with one handler, however often it is asked for."""
    logger = logging.getLogger(name)
    if not logger.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        logger.addHandler(handler)
        logger.setLevel(level)
        logger.propagate = False
    return logger
