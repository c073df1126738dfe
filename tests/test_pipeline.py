"""Star schema, quality gates, ledgers, sources, the stream, and runs that fail and resume."""

import datetime as dt
import json
import os
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest
from pyspark.sql import functions as F

from strata import workloads as w
from strata.operators import quality, star
from strata.operators.calendar import calendar
from strata.plans import pipeline as pl
from strata.plans.ledger import Ledger
from strata.plans.store import TableStore
from strata.session import get_logger
from strata.sources import archive, pending, read_file, write_xlsx
from strata.specs import Dimension, Fact, Lookup, Pipeline, from_dict, in_domain, load, not_null, unique
from strata.streaming import ingest

COLUMNS = "episode_id string, patient_id string, patient_name string, date_of_birth date, gender string, hospital string, department string, ward string, admission_date date, admission_type string"
E1 = ("E001", "P001", "John Smith", dt.date(1981, 5, 15), "Male", "St Mary's Hospital", "Cardiology", "Ward A", dt.date(2026, 1, 10), "Emergency")
E2 = ("E002", "P002", "Mary Jones", dt.date(1988, 9, 20), "Female", "General Hospital", "Orthopaedics", "Ward B", dt.date(2026, 2, 5), "Elective")
E3 = ("E003", "P003", "David Brown", dt.date(1974, 3, 15), "Male", "City Hospital", "Neurology", "Ward C", dt.date(2026, 3, 15), "Emergency")
SITE = Dimension("dim_hospital", "hospital_key", ("hospital",), audit=False)
UNIT = Dimension("dim_department", "department_key", ("hospital_key", "department"), parents=(Lookup("dim_hospital", "hospital_key", (("hospital", "hospital"),)),))
PERSON = Dimension("dim_patient", "patient_key", ("patient_id",), ("patient_name", "date_of_birth", "gender"), survivor=("admission_date", "episode_id"))
FACT = Fact(
    "fact",
    "fact_key",
    ("episode_id",),
    (
        Lookup("dim_patient", "patient_key", (("patient_id", "patient_id"),)),
        Lookup("dim_hospital", "hospital_key", (("hospital", "hospital"),)),
        Lookup("dim_department", "department_key", (("hospital_key", "hospital_key"), ("department", "department"))),
        Lookup("dim_date", "date_key", (("admission_date", "full_date"),)),
    ),
    ("patient_key", "date_key", "episode_id"),
    ("ward",),
)
SPEC = Pipeline(
    "healthcare", ("episode_id", "patient_id"), ("episode_id",), (not_null("patient", "patient_id"), unique("episode", "episode_id"), in_domain("type", "admission_type", "Emergency", "Elective")),
    (SITE, UNIT, PERSON), FACT, dates=("admission_date",), buckets=2,
)


def test_dimensions(spark):
    df = spark.createDataFrame([("Royal Hospital", "Cardiology"), ("Royal Hospital", "Emergency"), ("City Hospital", "Neurology"), ("City Hospital", "Neurology"), ("City Hospital", None)], "hospital string, department string")
    site = spark.createDataFrame([(1, "Royal Hospital"), (2, "City Hospital")], "hospital_key bigint, hospital string")
    first = star.new_members(df, UNIT, None, {"dim_hospital": site})
    assert first.columns == ["department_key", "hospital_key", "department", "created_at", "updated_at"]
    assert sorted(r.department_key for r in first.collect()) == [1, 2, 3]
    more = df.unionAll(spark.createDataFrame([("City Hospital", "ICU")], df.schema))
    new = star.new_members(more, UNIT, first, {"dim_hospital": site}).collect()
    assert [tuple(r)[:3] for r in new] == [(4, 2, "ICU")]
    names = star.new_members(spark.createDataFrame([(" ROYAL nhs-trust ",)], "hospital string"), w.SITE, None, {}).first()
    assert names.hospital == "Royal Nhs-trust"


def test_calendar(spark):
    df = calendar(spark)
    assert df.count() == 5844
    day = df.where("full_date = DATE '2026-01-10'").first()
    assert (day.date_key, day.is_weekend, day.day_of_week, day.month_name) == (20260110, "Yes", 7, "January")
    assert df.where("full_date = DATE '2027-01-01'").first().week_of_year == 53


def test_gates(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert tuple(quality.dimension_quality(df, "d", "k").first()) == ("d", 3, 1, 1, "FAIL")
    assert quality.dimension_quality(df.limit(0), "d", "k").first().status == "FAIL"
    with pytest.raises(quality.QualityError):
        quality.gate(quality.dimension_quality(df, "d", "k"))
    assert quality.gate(quality.dimension_quality(spark.range(3), "d", "id"))
    assert quality.orphans(df, spark.createDataFrame([(1,)], "k int"), "k").count() == 1


def layers(spark, tmp_path):
    return pl.Layers(spark, SPEC, f"file://{tmp_path}/lake", Ledger(tmp_path / "ledger.json"))


def test_whole_run_and_second_batch(spark, tmp_path):
    own = layers(spark, tmp_path)
    bad = ("E009", None, *E1[2:])
    assert own.run(spark.createDataFrame([E1, E2, bad], COLUMNS), "b1") and not own.run(spark.createDataFrame([E1], COLUMNS), "b1")
    read = own.store.read
    assert (read("bronze").count(), read("silver").count(), read("fact").count(), read("dim_patient").count()) == (3, 2, 2, 2)
    keys = {r.patient_id: r.patient_key for r in read("dim_patient").collect()}
    made = {r.episode_id: r.created_at for r in read("silver").collect()}
    changed = (*E1[:2], "John Smith Updated", *E1[3:])
    assert own.run(spark.createDataFrame([changed, E3], COLUMNS), "b2")
    silver = {r.episode_id: r for r in read("silver").collect()}
    assert set(silver) == {"E001", "E002", "E003"} and silver["E001"].patient_name == "John Smith Updated"
    assert silver["E001"].created_at == made["E001"] and silver["E001"].batch_id == "b2" and silver["E002"].batch_id == "b1"
    after = {r.patient_id: r.patient_key for r in read("dim_patient").collect()}
    assert {k: after[k] for k in keys} == keys and after["P003"] == 3
    facts = read("fact").collect()
    assert len(facts) == 3 and len({r.fact_key for r in facts}) == 3
    third = next(r for r in facts if r.episode_id == "E003")
    assert (third.patient_key, third.date_key) == (3, 20260315)
    counts = {r.item: r.row_count for r in own.report().collect()}
    assert counts["quarantine:patient"] == 1 and counts["bronze"] == 5
    assert own.ledger.processed() == ["b1", "b2"] and own.ledger.watermark()["last_processed_file"] == "b2"


def test_failed_gate_changes_no_table_and_run_resumes(spark, tmp_path, monkeypatch):
    own = layers(spark, tmp_path)
    own.run(spark.createDataFrame([E1], COLUMNS), "b1")
    late = (*E2[:8], dt.date(2050, 1, 1), E2[9])  # no such day in the calendar
    with pytest.raises(quality.QualityError):
        own.run(spark.createDataFrame([late], COLUMNS), "b2")
    assert own.store.read("fact").count() == 1 and own.store.read("dim_patient").count() == 1
    assert [own.ledger.status("b2", x) for x in ("bronze", "silver", "gold")] == ["SUCCESS", "SUCCESS", "FAILED"]
    own.store.upsert("silver", own.store.read("silver").where("episode_id = 'E002'").withColumn("admission_date", F.lit("2026-02-05").cast("date")), ["episode_id"], 2)
    monkeypatch.setattr(own, "silver", lambda *_: pytest.fail("a layer that has succeeded ran again"))
    assert own.run(spark.createDataFrame([late], COLUMNS), "b2")
    assert own.store.read("fact").count() == 2 and own.ledger.complete("b2")


def test_first_batch_that_fails_the_gate_can_be_mended(spark, tmp_path):
    own = layers(spark, tmp_path)
    late = (*E2[:8], dt.date(2050, 1, 1), E2[9])
    with pytest.raises(quality.QualityError):
        own.run(spark.createDataFrame([late], COLUMNS), "b1")
    assert own.store.read("fact").count() == 0 and own.store.read("dim_patient").count() == 0
    own.run(spark.createDataFrame([E2], COLUMNS), "b2")
    assert own.store.read("fact").count() == 1 and own.store.read("dim_patient").first().patient_key == 1


def test_rejected_schema_stops_before_anything_is_written(spark, tmp_path):
    own = layers(spark, tmp_path)
    own.run(spark.createDataFrame([E1], COLUMNS), "b1")
    with pytest.raises(ValueError, match="removed"):
        own.run(spark.createDataFrame([E2], COLUMNS).drop("ward"), "b2")
    assert own.store.read("bronze").count() == 1 and own.ledger.status("b2", "bronze") == "FAILED"
    own.run(spark.createDataFrame([E2], COLUMNS).withColumn("admission_source", F.lit("GP")), "b3")
    assert [c["new_columns"] for c in own.ledger.schema_changes()] == [["admission_source"]]
    assert {r.episode_id: r.admission_source for r in own.store.read("silver").collect()} == {"E001": None, "E002": "GP"}


def test_ledger(tmp_path):
    ledger = Ledger(tmp_path / "l.json")
    assert ledger.watermark() is None and ledger.processed() == [] and ledger.status("x", "gold") == "PENDING"
    ledger.start("x")
    for layer in ("bronze", "silver", "gold"):
        assert not ledger.complete("x")
        ledger.mark("x", layer, "SUCCESS")
    ledger.start("x")
    assert ledger.complete("x")
    ledger.finish("x")
    ledger.finish("x")
    assert Ledger(tmp_path / "l.json").processed() == ["x"]
    (tmp_path / "l.json").write_text("{broken")
    with pytest.raises(ValueError):
        ledger.processed()
    assert len(get_logger("a.b").handlers) == len(get_logger("a.b").handlers) == 1


def test_landing_files(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    with pytest.raises(FileNotFoundError):
        pending(spark, str(tmp_path / "none"), [])
    schema = "id long, name string, born date, ok boolean, score double"
    write_xlsx(str(landing / "a.xlsx"), ["id", "name", "born", "ok", "score", "more"], [(1, "Ann & <Bo>", dt.date(1990, 2, 28), True, 1.5, "x"), (2, None, "not a date", False, None, "y"), (None,) * 6])
    write_xlsx(str(landing / "b.xlsx"), ["name", "id"], [(" é ", "7")])
    os.utime(landing / "a.xlsx", (1, 1))
    found = pending(spark, str(landing), ["c.xlsx"], schema)
    assert [n for n, _ in found] == ["a.xlsx", "b.xlsx"]
    assert [tuple(r) for r in found[0][1]().collect()] == [(1, "Ann & <Bo>", dt.date(1990, 2, 28), True, 1.5), (2, None, None, False, None)]
    assert [tuple(r) for r in found[1][1]().collect()] == [(7, " é ", None, None, None)]
    assert read_file(spark, str(landing / "b.xlsx")).columns == ["name", "id"]
    assert archive(str(landing / "a.xlsx"), str(tmp_path / "done")).exists() and archive(str(landing / "a.xlsx"), str(tmp_path / "done")).exists()
    with pytest.raises(FileNotFoundError):
        archive(str(landing / "zzz.xlsx"), str(tmp_path / "done"))


def test_jdbc(spark, tmp_path):
    from strata.sources import jdbc

    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = "org.apache.derby.jdbc.EmbeddedDriver"
    df = spark.range(20).selectExpr("cast(id as int) as id", "concat('n', id) as name")
    df.write.format("jdbc").option("url", url).option("dbtable", "people").option("driver", driver).save()
    got = jdbc(spark, url, "people", driver, ("id", "0", "20", 4))
    assert got.rdd.getNumPartitions() == 4 and got.where("id < 5").count() == 5


ROUNDTRIP = """
import sys
from pyspark.sql import SparkSession
from strata import workloads
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.driver.host", "127.0.0.1").config("spark.ui.enabled", "false").getOrCreate()
try:
    print("GOT", sorted(map(tuple, workloads.q_jdbc_roundtrip(spark, sys.argv[1]).collect())))
finally:
    spark.stop()
"""


def test_jdbc_roundtrip_with_executors_of_their_own(spark, tmp_path):
    """Executors in JVMs of their own reach no database that the driver holds open."""
    want = [(n, f"N{n}") for n in range(25)]
    spark.createDataFrame(want, "n_nationkey long, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    home, repo = tmp_path / "home", Path(w.__file__).parents[1]
    home.mkdir()
    for part in Path(pyspark.__file__).parent.iterdir():  # executors log to Spark's home
        if part.name != "work":
            (home / part.name).symlink_to(part)
    env = os.environ | {"PYTHONPATH": f"{repo}:{os.environ.get('PYTHONPATH', '')}", "SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": f"{tmp_path}/local"}
    run = subprocess.run([sys.executable, "-c", ROUNDTRIP, str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert f"GOT {want[5:]}" in run.stdout, run.stderr[-3000:]


def test_derby_table_keeps_rows_and_types(spark):
    from strata.sources import DERBY, derby_table, jdbc

    df = spark.range(1200).selectExpr(
        "id",
        "if(id = 7, null, cast(id as int)) as n",
        "if(id = 7, null, concat('é ', repeat('x', if(id % 100 = 0, 40000, 9)))) as name",
        "if(id = 7, null, date_add(date'2020-02-28', cast(id as int))) as day",
        "if(id = 7, null, cast(id / 4 as decimal(12, 2))) as amount",
        "if(id = 7, null, id / 8.0d) as share",
        "if(id = 7, null, id % 2 = 0) as even",
    )
    url = derby_table(df, "rows_of_all")
    for part in (None, ("id", "0", "1200", 4)):
        got = jdbc(spark, url, "rows_of_all", DERBY, part)
        assert got.dtypes == df.dtypes and got.exceptAll(df).isEmpty() and df.exceptAll(got).isEmpty()
    empty = jdbc(spark, derby_table(df.where("id < 0"), "nothing"), "nothing", DERBY)
    assert empty.dtypes == df.dtypes and empty.isEmpty()


def test_stream_appends_once(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/tables")
    for n in (1, 2):
        spark.range(10 * n, 10 * n + 10).write.mode("append").parquet(f"{tmp_path}/landing")
        for _ in range(2):
            ingest(spark, f"{tmp_path}/landing", "id long", store, "raw", f"{tmp_path}/progress").awaitTermination()
    assert store.read("raw").count() == 20


def test_entry_imports_without_corpus_operators(monkeypatch):
    import importlib
    import sys

    class Gone:
        def find_spec(self, name, *_):
            if name == "corpus_pipeline" or name.startswith("strata.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for name in [n for n in sys.modules if n.startswith("strata.llm") or n in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    import strata

    monkeypatch.delattr(strata, "llm", raising=False)
    bare = importlib.import_module("__spark_entry__")
    assert "q_medallion" in bare.queries() and not any(q.startswith("op") for q in bare.queries()) and "q_medallion" in bare.oracle_sql()
    monkeypatch.delitem(sys.modules, "__spark_entry__")


CONFIG = {
    "name": "healthcare",
    "required": ["episode_id", "patient_id"],
    "keys": ["episode_id"],
    "rules": [["not_null", "patient", "patient_id"], ["unique", "episode", "episode_id"], ["in_domain", "type", "admission_type", "Emergency", "Elective"]],
    "dimensions": [
        {"name": "dim_hospital", "key": "hospital_key", "natural": ["hospital"], "audit": False},
        {"name": "dim_patient", "key": "patient_key", "natural": ["patient_id"], "attributes": ["patient_name"], "survivor": ["episode_id"]},
    ],
    "fact": {
        "name": "fact",
        "key": "fact_key",
        "natural": ["episode_id"],
        "lookups": [{"dimension": "dim_patient", "key": "patient_key", "on": [["patient_id", "patient_id"]]}, {"dimension": "dim_hospital", "key": "hospital_key", "on": [["hospital", "hospital"]]}],
        "order": ["patient_key", "episode_id"],
        "columns": ["ward"],
    },
    "buckets": 2,
}


def test_landing_folder_with_a_pipeline_from_a_file(spark, tmp_path):
    """Oldest file first; a file that another driver has taken is only moved; the ledger lies beside the tables."""
    (tmp_path / "pipeline.json").write_text(json.dumps(CONFIG))
    spec = load(tmp_path / "pipeline.json")
    assert spec.dimensions[0] == SITE and spec.fact.lookups[0].on == (("patient_id", "patient_id"),)
    with pytest.raises(ValueError, match="kinds of rules"):
        from_dict(CONFIG | {"rules": [["no_such", "x", "y"]]})
    landing = tmp_path / "landing"
    for when, (name, rows) in enumerate((("b.json", [E1, E2]), ("a.json", [E3])), 1):
        landing.mkdir(exist_ok=True)
        (landing / name).write_text("\n".join(json.dumps(dict(zip((c.split()[0] for c in COLUMNS.split(", ")), map(str, r), strict=True))) for r in rows))
        os.utime(landing / name, (when, when))
    first = pl.Layers(spark, spec, f"file://{tmp_path}/lake")
    assert first.run_landing(str(landing), str(tmp_path / "done"), COLUMNS) == ["b.json", "a.json"]
    assert (tmp_path / "lake" / "ledger.json").exists() and not list(landing.iterdir())
    (tmp_path / "done" / "a.json").rename(landing / "a.json")
    other = pl.Layers(spark, spec, f"file://{tmp_path}/lake")
    assert other.run_landing(str(landing), str(tmp_path / "done"), COLUMNS) == [] and (tmp_path / "done" / "a.json").exists()
    counts = {r.item: r.row_count for r in other.report().collect()}
    assert counts["silver"] == 3 and counts["silver:repeated_keys"] == 0 and counts["ledger:processed"] == 2 and counts["ledger:watermark:a.json"] == 1
    keys = other.store.read("fact").schema["fact_key"].dataType.simpleString()
    assert keys == "bigint"
