"""Quality checks: one pass for each table, one anti join for each foreign key, and a gate over the report."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPORT = "table_name string, check_name string, failures bigint, status string"


class QualityError(ValueError):
    """A gate that isn't passed."""


def duplicated(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Groups of more than one row; NULL is a value like others."""
    return df.groupBy(*columns).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def dimension_quality(df: DataFrame, name: str, key: str) -> DataFrame:
    """One row: rows, NULL keys, repeated keys and a status."""
    per_key = df.groupBy(key).agg(F.count("*").alias("n"))  # at most one row per key goes on
    summed = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("row_count"),
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).cast("long").alias("null_keys"),
        F.count(F.when(F.col("n") > 1, 1)).alias("duplicate_keys"),
    )
    passes = (F.col("row_count") > 0) & (F.col("null_keys") == 0) & (F.col("duplicate_keys") == 0)
    return summed.select(F.lit(name).alias("table_name"), "row_count", "null_keys", "duplicate_keys", F.when(passes, "PASS").otherwise("FAIL").alias("status"))


def null_counts(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.agg(*(F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns))


def orphans(fact: DataFrame, dimension: DataFrame, fact_key: str, dimension_key: str | None = None) -> DataFrame:
    """Fact rows whose key the dimension lacks; a NULL key is an orphan."""
    theirs = dimension.select(F.col(dimension_key or fact_key).alias("_theirs")).distinct()
    return fact.join(theirs, F.col(fact_key) == F.col("_theirs"), "left_anti")


def fact_quality(silver: DataFrame, fact: DataFrame, natural: Iterable[str], foreign: dict[str, tuple[DataFrame, str]], name: str = "fact") -> DataFrame:
    """check_name and failures: NULL keys, repeated natural keys, rows missing against silver, orphans of each key."""
    key_columns = list(foreign)
    any_null = " or ".join(f"{c} is null" for c in key_columns) or "false"
    checks = [("null_keys", fact.where(any_null).agg(F.count("*").alias("failures")))]
    checks.append(("duplicate_rows", duplicated(fact, natural).agg(F.count("*").alias("failures"))))
    sizes = silver.agg(F.count("*").alias("a")).crossJoin(fact.agg(F.count("*").alias("b")))  # one row each
    checks.append(("row_count", sizes.select(F.abs(F.col("a") - F.col("b")).alias("failures"))))
    for key, (dimension, theirs) in foreign.items():
        checks.append((f"orphans_{key}", orphans(fact, dimension, key, theirs).agg(F.count("*").alias("failures"))))
    out = None
    for check, df in checks:
        row = df.select(F.lit(name).alias("table_name"), F.lit(check).alias("check_name"), "failures", F.when(F.col("failures") == 0, "PASS").otherwise("FAIL").alias("status"))
        out = row if out is None else out.unionAll(row)
    return out


def gate(report: DataFrame) -> list[dict]:
    """The report's rows (as many as there are checks); raises if one has failed."""
    rows = [r.asDict() for r in report.collect()]
    failed = [r for r in rows if r["status"] != "PASS"]
    if failed:
        raise QualityError(f"quality checks failed: {[(r['table_name'], r.get('check_name', 'dimension')) for r in failed]}")
    return rows


def profile(df: DataFrame, name: str) -> DataFrame:
    """One row for each column: non-NULL values, with the table's size."""
    stats = df.agg(F.count("*").alias("n"), *(F.count(c).alias(f"v{i}") for i, c in enumerate(df.columns)))
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"v{i}").alias("filled")) for i, c in enumerate(df.columns)))
    return stats.select(F.lit(name).alias("table_name"), F.col("n").alias("row_count"), F.lit(len(df.columns)).alias("column_count"), F.explode(pairs).alias("c")).select("table_name", "row_count", "column_count", "c.*")
