"""Merges as plans over sets of rows: an anti join and a union. NULL keys never match."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class DuplicateMatchError(ValueError):
    """Several source rows match one target row."""


def only_new(source: DataFrame, target: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Source rows whose key the target doesn't have."""
    keys = list(keys)
    return source.join(target.select(*keys).distinct(), keys, "left_anti").select(*source.columns)


def only_known(source: DataFrame, target: DataFrame, keys: Iterable[str]) -> DataFrame:
    keys = list(keys)
    return source.join(target.select(*keys).distinct(), keys, "left_semi").select(*source.columns)


def newer_than(df: DataFrame, column: str, mark: object | None) -> DataFrame:
    """Rows beyond the high-water mark, all rows where there is none yet. NULL is never beyond a mark."""
    return df if mark is None else df.where(F.col(column) > F.lit(mark).cast(df.schema[column].dataType))


def insert_only(target: DataFrame, source: DataFrame, keys: Iterable[str]) -> DataFrame:
    return target.unionByName(only_new(source, target, keys), allowMissingColumns=True)


def repeated_matches(target: DataFrame, source: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Keys of the target that several source rows have."""
    keys = list(keys)
    many = source.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return many.join(target.select(*keys), keys, "left_semi")


def upsert(target: DataFrame, source: DataFrame, keys: Iterable[str], preserve: Iterable[str] = (), check: bool = True) -> DataFrame:
    """Matched rows take the source's columns, others are inserted; rows of the target without a match stay.

    Columns that the source lacks, and those in `preserve`, keep the target's values. New columns of the source are NULL
    in rows that stay.
    """
    keys, preserve = list(keys), set(preserve)
    if check and not repeated_matches(target, source, keys).isEmpty():
        raise DuplicateMatchError(f"several source rows match one target row on {keys}")
    keep = [c for c in target.columns if c not in keys and (c in preserve or c not in source.columns)]
    incoming = source
    if keep:
        old = target.select(*keys, *(F.col(c).alias(f"_old_{c}") for c in keep), F.lit(True).alias("_matched")).dropDuplicates(keys)
        incoming = source.join(old, keys, "left")
        for c in keep:
            new = F.col(c) if c in source.columns else F.lit(None).cast(target.schema[c].dataType)
            incoming = incoming.withColumn(c, F.when(F.col("_matched"), F.col(f"_old_{c}")).otherwise(new))
        incoming = incoming.drop("_matched", *(f"_old_{c}" for c in keep))
    stay = only_new(target, source, keys)
    return stay.unionByName(incoming, allowMissingColumns=True)
