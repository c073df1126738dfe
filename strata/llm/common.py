"""Shared helpers: inputs, shared storage, Arrow maps, connected components."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strata.session import ship

#: The characters that separate words, [\x20\x09-\x0D]: what bytes.split() splits at.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name below spark.checkpoint.dir, which every executor and the driver can reach.

    Where the setting is absent (tests, a laptop) a folder below the warehouse is set as checkpoint folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    context._strata_staged = [*getattr(context, "_strata_staged", ()), path]
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder; lost executors recompute nothing before this point."""
    shared_dir(df.sparkSession, "cut")  # sets the folder
    return df.checkpoint()


def staged(df: DataFrame, label: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back. Its shuffle files go as soon as it is written."""
    path = shared_dir(df.sparkSession, label)
    with settings(df.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def discard(spark: SparkSession) -> None:
    """Delete what this application's operators have staged in the shared folder. Results that still read it must be written before."""
    context = spark.sparkContext
    for path in getattr(context, "_strata_staged", ()):
        delete(spark, path)
    context._strata_staged = []


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots as __) for what runs inside."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def map_arrow(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType
) -> DataFrame:
    """mapInArrow with batches small enough for very long texts."""
    ship(df.sparkSession)
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return df.mapInArrow(function, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def whole_id(name: str = "doc_id") -> Column:
    """An id as long; what isn't an integer counts as null."""
    return F.col(name).try_cast("long")


def row_key() -> Column:
    """16 bytes that tell rows apart by id and text, so that rows with one id, or without, have each their verdict."""
    both = F.concat(F.coalesce(whole_id().cast("string"), F.lit("-")), F.lit("\x1f"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return F.substring(F.unhex(F.sha2(both, 256)), 1, 16)


def row_key_of(doc_id: int | None, text: bytes) -> bytes:
    return hashlib.sha256(b"%b\x1f%b" % (b"-" if doc_id is None else b"%d" % doc_id, text)).digest()[:16]


def leave(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of docs whose verdict (key binary, kept boolean; a row for each row of docs) is to stay, with their columns only.

    Of rows with equal id and text one stays. Those are few or copies: they are combined by task before they move.
    """
    taken = {c.lower() for c in docs.columns}
    key = next(k for k in ("_key" + "_" * n for n in range(len(taken) + 1)) if k not in taken)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    verdicts = staged(verdicts, "verdicts")
    rows = docs.withColumn(key, row_key())
    dropped = verdicts.where(~F.col("kept")).select(F.col("key").alias(key)).distinct()
    rows = rows.join(dropped, key, "left_anti")
    again = verdicts.where("kept").groupBy(F.col("key").alias(key)).agg(F.count("*").alias("n")).where("n > 1").select(key)
    if again.isEmpty():
        return rows.select(*columns)
    again = staged(again, "repeated")
    order = F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))))
    one = rows.join(again, key, "left_semi").groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("row"))
    return rows.join(again, key, "left_anti").select(*columns).unionAll(one.select(*(F.col("row").getField(c).alias(c) for c in docs.columns)))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """Connected components of an undirected graph given by its edges: node, component (the smallest node).

    Alternating large-star and small-star steps (Kiveris et al. 2014). Every step is a map-side combined min and a
    join that adaptive execution may split, so a hub of any degree is spread over tasks. Each round is cut by a
    checkpoint. Null ends and loops are ignored; no edges give no rows.
    """
    edges = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and u <> v").distinct()
    )
    before = None
    for _ in range(rounds):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        sign = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == before:
            break
        before = sign
    else:
        raise RuntimeError(f"components: no fixed point after {rounds} rounds")
    roots = edges.select(F.col("v").alias("u"), "v").distinct()
    return edges.unionAll(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))
