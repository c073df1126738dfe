"""The layered pipeline: raw batches, current state, star schema, gate. Every step can be run again."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strata.functions import audit, standardize
from strata.operators import contract, quality, rules, star
from strata.operators.calendar import calendar
from strata.plans.ledger import FAILED, SUCCESS, Ledger
from strata.plans.store import TableStore
from strata.session import get_logger
from strata.sources import archive, pending
from strata.specs import Pipeline

log = get_logger("strata.pipeline")


class Layers:
    """bronze(), silver() and gold() for one spec over one store."""

    def __init__(self, spark: SparkSession, spec: Pipeline, root: str, ledger: Ledger | None = None):
        self.spark, self.spec, self.root = spark, spec, root.rstrip("/")
        self.store = TableStore(spark, f"{self.root}/tables")
        self.ledger = ledger or Ledger(f"{self.root}/ledger.json", self.store.files)

    # Layers

    def loaded(self, batch: str) -> bool:
        raw = self.store.read_or_none("bronze")
        return raw is not None and not raw.where(F.col("source_file") == batch).isEmpty()

    def bronze(self, df: DataFrame, batch: str) -> bool:
        """Append a batch once. The schema is compared with the raw history's, once for each batch."""
        if self.loaded(batch):
            return False
        own = ("source_file", "ingestion_timestamp", "pipeline_name")
        existing = self.store.schema("bronze")
        if existing is not None:
            existing = contract.business(existing, own)
        diff = contract.enforce(existing, df.schema, self.spec.optional)
        if diff:
            self.ledger.schema_changed(diff.as_dict() | {"batch": batch})
        meta = {"source_file": F.lit(batch), "ingestion_timestamp": F.current_timestamp(), "pipeline_name": F.lit(self.spec.name)}
        self.store.append("bronze", df.withColumns(meta))
        return True

    def silver(self, df: DataFrame, batch: str) -> None:
        """Rule-checked rows are merged into the current state, rejects go to quarantine under their batch."""
        rules.require_columns(df, self.spec.required)
        policy = "strict" if self.spec.strict_nulls else "parity"
        tagged = rules.tag(df, self.spec.rules, policy).persist()
        try:
            rules.write_quarantine(rules.rejected(tagged), f"{self.root}/quarantine", batch)
            good = audit(rules.valid(tagged), self.spec.name, batch)
            self.store.upsert("silver", good, self.spec.keys, self.spec.buckets, self.spec.preserve)
        finally:
            tagged.unpersist()

    def gold(self) -> list[dict]:
        """New members, new facts, then the gate; if it isn't passed, every table is as it was."""
        names = [d.name for d in self.spec.dimensions] + [self.spec.fact.name]  # the calendar is the same in any run
        before = {n: (self.store.versions(n) or [None])[-1] for n in names}
        try:
            silver = self.store.read("silver")
            if not self.store.exists("dim_date"):
                self.store.overwrite("dim_date", calendar(self.spark, *self.spec.calendar))
            tables = {"dim_date": self.store.read("dim_date")}
            for spec in self.spec.dimensions:
                new = star.new_members(silver, spec, self.store.read_or_none(spec.name), tables)
                self.store.insert_only(spec.name, new, spec.natural)
                tables[spec.name] = self.store.read(spec.name)
            fact = self.spec.fact
            new = star.new_facts(silver, fact, self.store.read_or_none(fact.name), tables)
            self.store.insert_only(fact.name, new, fact.natural, self.spec.buckets)
            return self.check()
        except Exception:
            for name, version in before.items():
                if (self.store.versions(name) or [None])[-1] != version:
                    self.store.restore(name, version)
            raise

    def check(self) -> list[dict]:
        dims = None
        for spec in self.spec.dimensions:
            row = quality.dimension_quality(self.store.read(spec.name), spec.name, spec.key)
            dims = row if dims is None else dims.unionAll(row)
        dims = dims.unionAll(quality.dimension_quality(self.store.read("dim_date"), "dim_date", "date_key"))
        fact = self.spec.fact
        foreign = {x.key: (self.store.read(x.dimension), x.key) for x in fact.lookups}
        facts = quality.fact_quality(self.store.read("silver"), self.store.read(fact.name), fact.natural, foreign, fact.name)
        return quality.gate(dims) + quality.gate(facts)

    # Batches

    def run(self, df: DataFrame, batch: str) -> bool:
        """Take a batch through all layers; layers that have succeeded before are skipped."""
        ledger = self.ledger
        if ledger.complete(batch) and batch in ledger.processed():
            log.info("batch %s is complete", batch)
            return False
        ledger.start(batch)
        df = standardize(df, self.spec.dates)
        for layer, step in (("bronze", lambda: self.bronze(df, batch)), ("silver", lambda: self.silver(df, batch)), ("gold", self.gold)):
            if ledger.done(batch, layer):
                continue
            try:
                step()
            except Exception:
                ledger.mark(batch, layer, FAILED)
                raise
            ledger.mark(batch, layer, SUCCESS)
            log.info("batch %s: %s done", batch, layer)
        ledger.finish(batch)
        return True

    def run_pending(self, sources: Iterable) -> list[str]:
        """Batches (name, function that reads it) in order; all that aren't done, not only the newest."""
        return [name for name, read in sources if self.run(read(), name)]

    def run_landing(self, landing: str, done: str, schema: StructType | str | None = None) -> list[str]:
        """Take every landing file that isn't processed through all layers, oldest first, and move it to `done`."""
        taken = []
        for name, read in pending(self.spark, landing, (), schema):
            if not (self.ledger.complete(name) and name in self.ledger.processed()):
                self.run(read(), name)
                taken.append(name)
            archive(f"{landing.rstrip('/')}/{name}", done)  # also a file that a lost run has left behind
        return taken

    def report(self) -> DataFrame:
        """item, row_count: rows of each table and of the quarantine by rule, repeated keys of the current state, what the ledger holds."""
        out = None
        for name in ["bronze", "silver", *(d.name for d in self.spec.dimensions), "dim_date", self.spec.fact.name]:
            if self.store.exists(name):
                row = self.store.read(name).agg(F.count("*").alias("row_count")).select(F.lit(name).alias("item"), "row_count")
                out = row if out is None else out.unionAll(row)
        fs, path = self.store.files.fs(f"{self.root}/quarantine")
        if fs.exists(path) and any(s.isDirectory() and not s.getPath().getName().startswith("_") for s in fs.listStatus(path)):
            by = self.spark.read.parquet(f"{self.root}/quarantine").groupBy(rules.FAILED).agg(F.count("*").alias("row_count"))
            out = out.unionAll(by.select(F.concat(F.lit("quarantine:"), rules.FAILED), "row_count"))
        if self.store.exists("silver"):
            again = quality.duplicated(self.store.read("silver"), self.spec.keys).agg(F.count("*").alias("row_count"))
            out = out.unionAll(again.select(F.lit("silver:repeated_keys"), "row_count"))
        mark = (self.ledger.watermark() or {}).get("last_processed_file", "none")
        held = [("ledger:processed", len(self.ledger.processed())), ("ledger:schema_changes", len(self.ledger.schema_changes())), (f"ledger:watermark:{mark}", 1)]
        held = self.spark.createDataFrame(held, "item string, row_count bigint")
        return held if out is None else out.unionAll(held)
