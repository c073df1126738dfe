"""Versioned tables over Parquet with atomic commits.

A table is a folder of data segments and a log of manifests, one for each version. A commit creates the next manifest
only if nobody has; that single file makes the new version visible, so readers see whole versions and a lost job leaves
unreferenced segments only. Rows are laid out by a hash bucket of the table's keys: an insert adds a segment, and an
upsert rewrites the buckets that incoming rows fall into and no others. All access is through Spark and Hadoop's file
system, so a store can be in any place that they reach.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from strata.operators import merge
from strata.plans.files import ConflictError, SharedFiles
from strata.plans.scratch import once

BUCKET = "_bucket"
#: A table of so many segments is rewritten as one, so that reading doesn't become a union of more and more scans.
MOST_SEGMENTS = 64
__all__ = ["ConflictError", "Manifest", "MissingTableError", "TableStore"]


class MissingTableError(LookupError):
    """A table that is required but isn't there."""


@dataclass
class Manifest:
    version: int
    schema: StructType
    keys: list[str]
    buckets: int
    segments: list[dict]  # dir, buckets


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), SharedFiles(spark)

    # Versions

    def versions(self, name: str) -> list[int]:
        fs, p = self.files.fs(f"{self.root}/{name}/_log")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def exists(self, name: str) -> bool:
        return bool(self.versions(name))

    def manifest(self, name: str, version: int | None = None) -> Manifest | None:
        known = self.versions(name)
        if not known:
            return None
        version = known[-1] if version is None else version
        if version not in known:
            raise MissingTableError(f"{name} has no version {version}")
        raw = json.loads(self.files.read_text(f"{self.root}/{name}/_log/{version:010d}.json"))
        return Manifest(version, StructType.fromJson(raw["schema"]), raw["keys"], raw["buckets"], raw["segments"])

    def _commit(self, name: str, m: Manifest) -> int:
        raw = {"schema": m.schema.jsonValue(), "keys": m.keys, "buckets": m.buckets, "segments": m.segments}
        self.files.create(f"{self.root}/{name}/_log/{m.version:010d}.json", json.dumps(raw))
        return m.version

    # Reading

    def read(self, name: str, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        m = self.manifest(name, version)
        if m is None:
            raise MissingTableError(f"table {name} isn't in {self.root}")
        wanted = None if buckets is None else set(buckets)
        out = None
        for s in m.segments:
            some = set(s["buckets"]) if wanted is None else set(s["buckets"]) & wanted
            if not some:
                continue
            part = self.spark.read.schema(StructType([*m.schema.fields, StructField(BUCKET, IntegerType())])).parquet(f"{self.root}/{name}/{s['dir']}")
            if len(some) < s["written"]:
                part = part.where(F.col(BUCKET).isin(*sorted(some)))  # prunes folders
            out = part if out is None else out.unionByName(part)
        if out is None:
            return self.spark.createDataFrame([], m.schema)
        return out.select(*m.schema.names)

    def read_or_none(self, name: str) -> DataFrame | None:
        return self.read(name) if self.exists(name) else None

    def schema(self, name: str) -> StructType | None:
        m = self.manifest(name)
        return None if m is None else m.schema

    # Writing

    def _bucketed(self, df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
        number = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int") if keys and buckets > 1 else F.lit(0)
        return df.withColumn(BUCKET, number)

    def _segment(self, name: str, df: DataFrame, keys: list[str], buckets: int) -> dict | None:
        folder = f"seg-{uuid.uuid4().hex}"
        path = f"{self.root}/{name}/{folder}"
        out = self._bucketed(df, keys, buckets)
        if buckets > 1:
            # Rows of a bucket meet in some tasks, not one: adaptive execution splits large ones.
            out = out.hint("rebalance", F.col(BUCKET))
        out.write.partitionBy(BUCKET).parquet(path)
        fs, p = self.files.fs(path)
        found = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(p) if s.getPath().getName().startswith(f"{BUCKET}="))
        return {"dir": folder, "buckets": found, "written": len(found)} if found else None

    @staticmethod
    def _widened(old: StructType, new: StructType) -> StructType:
        names = set(old.names)
        return StructType([*old.fields, *(f for f in new.fields if f.name not in names)])

    def overwrite(self, name: str, df: DataFrame, keys: Iterable[str] = (), buckets: int = 1) -> int:
        keys = list(keys)
        known = self.versions(name)
        segment = self._segment(name, df, keys, buckets)
        return self._commit(name, Manifest((known or [0])[-1] + 1, df.schema, keys, buckets, [segment] if segment else []))

    def append(self, name: str, df: DataFrame, keys: Iterable[str] = (), buckets: int = 1) -> int:
        """Add rows. New columns widen the schema; older rows have NULL there."""
        m = self.manifest(name)
        if m is None:
            return self.overwrite(name, df, keys, buckets)
        segment = self._segment(name, df, m.keys, m.buckets)
        version = self._commit(name, Manifest(m.version + 1, self._widened(m.schema, df.schema), m.keys, m.buckets, [*m.segments, *([segment] if segment else [])]))
        return self.compact(name) if len(m.segments) >= MOST_SEGMENTS else version

    def compact(self, name: str, buckets: int | None = None) -> int:
        """The same rows in one segment, as a new version; with `buckets`, laid out in as many. A commit meanwhile raises."""
        m = self.manifest(name)
        if m is None:
            raise MissingTableError(f"table {name} isn't in {self.root}")
        buckets = buckets or m.buckets
        segment = self._segment(name, self.read(name, m.version), m.keys, buckets)
        return self._commit(name, Manifest(m.version + 1, m.schema, m.keys, buckets, [segment] if segment else []))

    def insert_only(self, name: str, df: DataFrame, keys: Iterable[str], buckets: int = 1) -> int:
        """Add rows whose keys the table lacks; nothing is rewritten."""
        keys = list(keys)
        if not self.exists(name):
            return self.overwrite(name, df, keys, buckets)
        return self.append(name, merge.only_new(df, self.read(name), keys))

    def upsert(self, name: str, df: DataFrame, keys: Iterable[str], buckets: int = 1, preserve: Iterable[str] = ()) -> int:
        """Merge rows in; only the buckets that they fall into are read and rewritten."""
        keys = list(keys)
        m = self.manifest(name)
        if m is None:
            return self.overwrite(name, df, keys, buckets)
        if m.keys != keys:
            raise ValueError(f"{name} is laid out by {m.keys}, not {keys}")
        df = once(df, "upsert")  # read three times below
        touched = sorted(r[0] for r in self._bucketed(df, keys, m.buckets).select(BUCKET).distinct().collect())  # at most m.buckets
        merged = merge.upsert(self.read(name, buckets=touched), df, keys, preserve)
        segment = self._segment(name, merged, keys, m.buckets)
        kept = [s | {"buckets": left} for s in m.segments if (left := [b for b in s["buckets"] if b not in set(touched)])]
        return self._commit(name, Manifest(m.version + 1, self._widened(m.schema, merged.schema), keys, m.buckets, [*kept, *([segment] if segment else [])]))

    def restore(self, name: str, version: int | None) -> None:
        """Make an older version the current one again; None empties a table that had no version before."""
        m = self.manifest(name, version) if version else self.manifest(name)
        if m is None:
            return
        latest = self.versions(name)[-1]
        self._commit(name, Manifest(latest + 1, m.schema, m.keys, m.buckets, m.segments if version else []))

    def vacuum(self, name: str, keep: int = 1) -> None:
        """Drop all but the last `keep` versions and segments that none of them has."""
        known = self.versions(name)
        used = {s["dir"] for v in known[-keep:] for s in self.manifest(name, v).segments}
        fs, p = self.files.fs(f"{self.root}/{name}")
        for v in known[:-keep]:
            fs.delete(self.files.fs(f"{self.root}/{name}/_log/{v:010d}.json")[1], False)
        for s in fs.listStatus(p):
            if s.getPath().getName().startswith("seg-") and s.getPath().getName() not in used:
                fs.delete(s.getPath(), True)
