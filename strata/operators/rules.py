"""Ordered rule chains in one pass.

Each row gets the name of the first rule that it fails. A uniqueness rule counts only rows that passed the rules before
it; all rows of a repeated value fail. A condition that is NULL is an
unknown outcome: such rows are neither valid nor rejected, or rejected under null_policy="strict".
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.specs import Rule

FAILED = "failed_rule"
UNKNOWN = "__unknown__:"


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"required columns are missing: {missing}")
    return df


def tag(df: DataFrame, rules: Iterable[Rule], null_policy: str = "parity") -> DataFrame:
    """Add FAILED: NULL for valid rows. Consecutive conditions are one projection; a uniqueness rule adds a count of its keys and a join."""
    if null_policy not in ("parity", "strict"):
        raise ValueError(f"null_policy is parity or strict, not {null_policy}")
    df = df.withColumn(FAILED, F.lit(None).cast("string"))
    for rule in rules:
        if rule.unique:
            # Only keys move, counted before they do; rows then meet the repeated keys in a join that can be broadcast
            # or split, so a key with very many rows isn't in one task.
            names = [f"_key_{i}" for i in range(len(rule.unique))]
            alive = df.where(F.col(FAILED).isNull()).select(*(F.col(c).alias(n) for c, n in zip(rule.unique, names, strict=True)))
            many = alive.na.drop().groupBy(*names).agg(F.count("*").alias("_copies")).where("_copies > 1")
            same = F.lit(True)
            for c, n in zip(rule.unique, names, strict=True):
                same = same & (F.col(c) == F.col(n))
            df = df.join(many, same, "left")
            df = df.withColumn(FAILED, F.when(F.col(FAILED).isNull() & F.col("_copies").isNotNull(), rule.name).otherwise(F.col(FAILED))).drop("_copies", *names)
        else:
            passes = rule.passes()
            unknown = rule.name if null_policy == "strict" else UNKNOWN + rule.name
            said = F.when(passes, None).when(passes.isNull(), unknown).otherwise(rule.name)
            df = df.withColumn(FAILED, F.coalesce(F.col(FAILED), said))
    return df


def valid(tagged: DataFrame) -> DataFrame:
    return tagged.where(F.col(FAILED).isNull()).drop(FAILED)


def rejected(tagged: DataFrame) -> DataFrame:
    """Rows with the rule that they fail; unknown outcomes are left out."""
    return tagged.where(F.col(FAILED).isNotNull() & ~F.col(FAILED).startswith(UNKNOWN))


def split(df: DataFrame, rule: Rule, null_policy: str = "parity") -> tuple[DataFrame, DataFrame]:
    """Valid and rejected rows of one rule."""
    tagged = tag(df, [rule], null_policy)
    return valid(tagged), rejected(tagged).drop(FAILED)


def write_quarantine(rejects: DataFrame, path: str, batch: str) -> None:
    """Rejects by batch and rule. Writing a batch again replaces its own folders only."""
    out = rejects.withColumn("batch", F.lit(batch)).repartition(FAILED)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", FAILED).parquet(path)
