"""Column expressions that several operators share. All stay inside code generation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Texts that spreadsheets and exporters leave for an empty cell.
EMPTY = ("", "nan", "nat", "none", "null")


def blank_to_null(column: Column | str, empty: Iterable[str] = EMPTY) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.when(F.lower(F.trim(c)).isin(*empty), None).otherwise(c)


def canonical_name(column: Column | str) -> Column:
    """Trimmed, with capitals at the beginning of words."""
    return F.initcap(F.trim(column))


def day_flag(date: Column | str) -> Column:
    return F.when(F.dayofweek(date).isin(1, 7), "Yes").otherwise("No")


def standardize(df: DataFrame, dates: Iterable[str] = (), date_format: str = "yyyy-MM-dd", empty: Iterable[str] = EMPTY) -> DataFrame:
    """Empty texts of every string column become NULL; date columns are parsed, unreadable ones become NULL."""
    dates, changed = set(dates), {}
    for f in df.schema.fields:
        if f.name in dates:
            text = F.col(f.name).cast("string")
            changed[f.name] = F.to_date(F.col(f.name)) if f.dataType.typeName() in ("date", "timestamp", "timestamp_ntz") else F.try_to_timestamp(text, F.lit(date_format)).cast("date")
        elif isinstance(f.dataType, StringType):
            changed[f.name] = blank_to_null(f.name, empty)
    return df.withColumns(changed) if changed else df


def audit(df: DataFrame, pipeline: str, batch: str, now: Column | None = None) -> DataFrame:
    """created_at, updated_at, pipeline_name, batch_id."""
    now = F.current_timestamp() if now is None else now
    return df.withColumns({"created_at": now, "updated_at": now, "pipeline_name": F.lit(pipeline), "batch_id": F.lit(batch)})
