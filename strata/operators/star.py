"""Dimensions and facts from specs."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions import canonical_name
from strata.operators import keys
from strata.specs import Dimension, Fact, Lookup


def attach(rows: DataFrame, dimension: DataFrame, lookup: Lookup, how: str = "left") -> DataFrame:
    """Add the dimension's key. The dimension is unique on the looked-up columns; Catalyst picks the join by size."""
    theirs = dimension.select(F.col(lookup.key).alias("_key"), *(F.col(b).alias(f"_on_{i}") for i, (_, b) in enumerate(lookup.on)))
    condition: Column = F.lit(True)
    for i, (a, _) in enumerate(lookup.on):
        condition = condition & (F.col(a) == F.col(f"_on_{i}"))
    return rows.join(theirs, condition, how).withColumn(lookup.key, F.col("_key")).drop("_key", *(f"_on_{i}" for i in range(len(lookup.on))))


def members(rows: DataFrame, spec: Dimension, tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row for each natural key without NULLs: its attributes come from the first row by `survivor`."""
    rows = rows.withColumns({c: canonical_name(c) for c in spec.canonical}) if spec.canonical else rows
    for parent in spec.parents:
        rows = attach(rows, tables[parent.dimension], parent, "inner")
    rows = rows.where(" and ".join(f"{c} is not null" for c in spec.natural))
    if not spec.attributes:
        return rows.select(*spec.natural).distinct()
    if not spec.survivor:
        raise ValueError(f"{spec.name} has attributes, so it needs an order of survivors")
    first = F.min(F.struct(*spec.survivor, *spec.attributes)).alias("_first")
    return rows.groupBy(*spec.natural).agg(first).select(*spec.natural, *(F.col(f"_first.{c}").alias(c) for c in spec.attributes))


def new_members(rows: DataFrame, spec: Dimension, existing: DataFrame | None, tables: Mapping[str, DataFrame], now: Column | None = None) -> DataFrame:
    """Members that the dimension lacks, with keys."""
    out = keys.assign(members(rows, spec, tables), existing, spec.natural, spec.key)
    if spec.audit:
        now = F.current_timestamp() if now is None else now
        out = out.withColumns({"created_at": now, "updated_at": now})
    return out


def resolve(rows: DataFrame, lookups: Iterable[Lookup], tables: Mapping[str, DataFrame]) -> DataFrame:
    """Attach every key; those without a member are NULL."""
    for lookup in lookups:
        rows = attach(rows, tables[lookup.dimension], lookup)
    return rows


def new_facts(rows: DataFrame, spec: Fact, existing: DataFrame | None, tables: Mapping[str, DataFrame], now: Column | None = None) -> DataFrame:
    """Rows with all keys that the fact table lacks, numbered. Catalyst turns left joins and NOT NULL into inner joins."""
    found = resolve(rows, spec.lookups, tables).na.drop(subset=[x.key for x in spec.lookups])
    columns = [*spec.natural, *(x.key for x in spec.lookups), *spec.columns]
    out = keys.assign(found.select(*dict.fromkeys([*columns, *spec.order])), existing, spec.natural, spec.key, spec.order)
    return out.select(spec.key, *columns)


def unresolved(rows: DataFrame, spec: Fact, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows that some lookup doesn't resolve."""
    return resolve(rows, spec.lookups, tables).where(" or ".join(f"{x.key} is null" for x in spec.lookups))
