"""Surrogate keys: consecutive numbers in the order of some columns, after the largest key that exists.

Ranking all rows in one window would bring them into one task. Rows are range-partitioned by the order instead; each
part is numbered by itself and shifted by how many rows the parts before it hold, a table with a row for each part.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.merge import only_new
from strata.plans.scratch import once


def numbered(df: DataFrame, order: Iterable[str], name: str, parts: int | None = None) -> DataFrame:
    """Add a row number (from 1, NULLs first) over the whole of df. The order should tell all rows apart."""
    order = list(order)
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    here = F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("long")
    # Bounds of ranges are sampled, so parts and their sizes must come from one evaluation.
    ranged = once(ranged.withColumn("_here", here), "numbered")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))  # as many rows as parts
    return ranged.join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_before") + F.col("_here")).alias(name))


def largest(existing: DataFrame, key: str, name: str = "_largest") -> DataFrame:
    """One row: the largest key, 0 without rows."""
    return existing.agg(F.coalesce(F.max(key), F.lit(0)).cast("long").alias(name))


def assign(new: DataFrame, existing: DataFrame | None, natural: Iterable[str], key: str, order: Iterable[str] | None = None) -> DataFrame:
    """Rows of `new` that `existing` lacks by natural key, numbered after its largest key, key first. One row per natural key is expected."""
    natural = list(natural)
    if existing is not None:
        new = only_new(new, existing, natural)
    out = numbered(new, order or natural, "_number")
    if existing is not None:
        out = out.crossJoin(F.broadcast(largest(existing, key)))  # one row
        number = F.col("_number") + F.col("_largest")
    else:
        number = F.col("_number")
    return out.select(number.cast("long").alias(key), *new.columns)
