"""File ingestion as a stream: the checkpoint remembers which files are done, each micro-batch is merged once."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from strata.plans.store import TableStore


def ingest(
    spark: SparkSession, landing: str, schema: str, store: TableStore, table: str, checkpoint: str, keys: Iterable[str] = (), file_format: str = "parquet", files_per_batch: int = 100, buckets: int = 16
) -> StreamingQuery:
    """Read what is in `landing` and end. With keys rows are upserted (running a batch again changes nothing); without them a batch is appended once, by its number."""
    keys = list(keys)
    stream = spark.readStream.format(file_format).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(landing)

    def write(batch: DataFrame, number: int) -> None:
        from pyspark.sql import functions as F

        if keys:
            store.upsert(table, batch, keys, buckets)  # which writes the batch out before it reads it again
            return
        have = store.read_or_none(table)
        if have is None or have.where(F.col("batch_number") == number).isEmpty():
            store.append(table, batch.withColumn("batch_number", F.lit(number).cast("long")))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
