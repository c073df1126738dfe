"""Each relational operator as a query over the test tables, with the SQL that says the same.

The base is one view of admissions over orders, customers and nations. NULLs, repeats and orphans, which the tables
lack, are made inside the queries, the same way on both sides.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import audit, standardize
from strata.operators import contract, keys, merge, quality, rules, star
from strata.operators.calendar import calendar
from strata.plans.pipeline import Layers
from strata.plans.scratch import folder
from strata.plans.store import TableStore
from strata.sources import DERBY, derby_table, jdbc, read_file, write_xlsx
from strata.specs import Dimension, Fact, Lookup, Pipeline, in_domain, not_after, not_null, unique
from strata.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
AS_OF, CUT, LATER = "2001-01-01", "1999-01-01", "1998-06-01"
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ADM = """adm AS (
    SELECT o_orderkey AS episode_id, c_custkey AS patient_id, c_name AS patient_name, n_name AS hospital, c_mktsegment AS department,
           o_orderstatus AS ward, CAST(o_orderdate AS DATE) AS admission_date, o_orderpriority AS admission_type
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
#: Admissions with gaps, repeats and unknown values.
ROUGH = """rough AS (
    SELECT CASE WHEN episode_id % 101 = 0 THEN episode_id - episode_id % 100 ELSE episode_id END AS episode_id,
           CASE WHEN episode_id % 97 = 0 THEN NULL ELSE patient_id END AS patient_id,
           CASE WHEN episode_id % 89 = 0 THEN NULL ELSE hospital END AS hospital,
           CASE WHEN episode_id % 83 = 0 THEN NULL ELSE admission_date END AS admission_date,
           CASE WHEN episode_id % 79 = 0 THEN NULL ELSE admission_type END AS admission_type
    FROM adm)"""
INITCAP = "array_to_string(list_transform(string_split(lower(trim({0})), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    joined = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.col("o_orderkey").alias("episode_id"),
        F.col("c_custkey").alias("patient_id"),
        F.col("c_name").alias("patient_name"),
        F.col("n_name").alias("hospital"),
        F.col("c_mktsegment").alias("department"),
        F.col("o_orderstatus").alias("ward"),
        F.col("o_orderdate").cast("date").alias("admission_date"),
        F.col("o_orderpriority").alias("admission_type"),
    )


def rough(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("episode_id")
    gap = lambda c, n: F.when(e % n == 0, None).otherwise(F.col(c)).alias(c)
    return admissions(spark, sf_dir).select(
        F.when(e % 101 == 0, e - e % 100).otherwise(e).alias("episode_id"), gap("patient_id", 97), gap("hospital", 89), gap("admission_date", 83), gap("admission_type", 79)
    )


RULES = (
    not_null("missing_patient", "patient_id"),
    not_null("missing_hospital", "hospital"),
    unique("duplicate_episode", "episode_id"),
    not_after("future_admission", "admission_date", AS_OF),
    in_domain("admission_type", "admission_type", *PRIORITIES),
)
SITE = Dimension("dim_site", "site_key", ("hospital",), canonical=("hospital",), audit=False)
RAW_SITE = Dimension("dim_site", "site_key", ("hospital",), audit=False)
UNIT = Dimension("dim_unit", "unit_key", ("site_key", "department"), parents=(Lookup("dim_site", "site_key", (("hospital", "hospital"),)),), audit=False)
PERSON = Dimension("dim_person", "person_key", ("patient_id",), ("patient_name",), survivor=("episode_id",), audit=False)
FACT = Fact(
    "fact_admission",
    "fact_key",
    ("episode_id",),
    (
        Lookup("dim_person", "person_key", (("patient_id", "patient_id"),)),
        Lookup("dim_site", "site_key", (("hospital", "hospital"),)),
        Lookup("dim_unit", "unit_key", (("site_key", "site_key"), ("department", "department"))),
        Lookup("dim_date", "date_key", (("admission_date", "full_date"),)),
    ),
    ("person_key", "date_key", "site_key", "unit_key", "episode_id"),
    ("ward", "admission_type"),
)
MEDALLION = Pipeline(
    "admissions",
    ("episode_id", "patient_id", "patient_name", "hospital", "ward", "admission_date", "admission_type"),
    ("episode_id",),
    RULES[:3] + (not_after("future_admission", "admission_date", "2030-01-01"), in_domain("admission_type", "admission_type", *PRIORITIES, "4-NOT SPECIFIED")),
    (RAW_SITE, UNIT, PERSON),
    FACT,
    calendar=("1992-01-01", "2005-12-31"),
    buckets=4,
)


def before(df: DataFrame, day: str) -> DataFrame:
    return df.where(F.col("admission_date") < F.lit(day).cast("date"))


def since(df: DataFrame, day: str) -> DataFrame:
    return df.where(F.col("admission_date") >= F.lit(day).cast("date"))


# Projections and scalar functions


@query(f"WITH {ADM} SELECT episode_id AS id, upper(hospital) AS site, ward || '-' || admission_type AS kind FROM adm")
def q_project_rename(spark, sf_dir):
    return admissions(spark, sf_dir).select(F.col("episode_id").alias("id"), F.upper("hospital").alias("site"), F.concat_ws("-", "ward", "admission_type").alias("kind"))


@query(f"WITH {ADM} SELECT episode_id, patient_id, 'batch_1.parquet' AS source_file, 'admissions' AS pipeline_name FROM adm")
def q_ingest_metadata(spark, sf_dir):
    return admissions(spark, sf_dir).select("episode_id", "patient_id", F.lit("batch_1.parquet").alias("source_file"), F.lit("admissions").alias("pipeline_name"))


@query(
    f"""WITH {ADM} SELECT episode_id, CASE WHEN episode_id % 10 < 3 THEN NULL ELSE hospital END AS hospital,
        CASE WHEN episode_id % 7 = 0 THEN NULL ELSE admission_date END AS admission_date FROM adm"""
)
def q_standardize_nan(spark, sf_dir):
    e = F.col("episode_id")
    empty = F.when(e % 10 == 0, " NaN ").when(e % 10 == 1, "").when(e % 10 == 2, "nan").otherwise(F.col("hospital"))
    dates = F.when(e % 7 == 0, "31/12/1999x").otherwise(F.col("admission_date").cast("string"))
    df = admissions(spark, sf_dir).select("episode_id", empty.alias("hospital"), dates.alias("admission_date"))
    return standardize(df, ["admission_date"])


@query(f"WITH {ADM} SELECT count(*) AS n_rows, 'department_code' AS missing FROM adm")
def q_required_columns(spark, sf_dir):
    df = admissions(spark, sf_dir)
    rules.require_columns(df, MEDALLION.required)
    try:
        rules.require_columns(df, ["episode_id", "department_code"])
        missing = ""
    except ValueError as e:
        missing = str(e).split("'")[1]
    return df.agg(F.count("*").alias("n_rows")).withColumn("missing", F.lit(missing))


# Rules


def _both(parts: tuple[DataFrame, DataFrame]) -> DataFrame:
    good, bad = parts
    return good.withColumn("outcome", F.lit("valid")).unionByName(bad.withColumn("outcome", F.lit("invalid"))).groupBy("outcome").agg(F.count("*").alias("n_rows"))


def _rule_sql(good: str, bad: str) -> str:
    return f"""WITH {ADM}, {ROUGH} SELECT outcome, count(*) AS n_rows FROM (
        SELECT CASE WHEN {good} THEN 'valid' WHEN {bad} THEN 'invalid' END AS outcome FROM rough) WHERE outcome IS NOT NULL GROUP BY outcome"""


@query(_rule_sql("patient_id IS NOT NULL", "patient_id IS NULL"))
def q_rule_missing_id(spark, sf_dir):
    return _both(rules.split(rough(spark, sf_dir), RULES[0]))


@query(_rule_sql("hospital IS NOT NULL", "hospital IS NULL"))
def q_rule_missing_site(spark, sf_dir):
    return _both(rules.split(rough(spark, sf_dir), RULES[1]))


@query(_rule_sql(f"admission_date <= DATE '{AS_OF}'", f"admission_date > DATE '{AS_OF}'"))
def q_rule_future(spark, sf_dir):
    return _both(rules.split(rough(spark, sf_dir), RULES[3]))


@query(_rule_sql(f"admission_type IN {PRIORITIES}", f"admission_type NOT IN {PRIORITIES}"))
def q_rule_domain(spark, sf_dir):
    return _both(rules.split(rough(spark, sf_dir), RULES[4]))


@query(
    """WITH d AS (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
    SELECT 'invalid' AS outcome, count(*) AS n_rows FROM lineitem SEMI JOIN d USING (l_orderkey, l_linenumber)
    UNION ALL SELECT 'valid', count(*) FROM lineitem ANTI JOIN d USING (l_orderkey, l_linenumber)"""
)
def q_rule_duplicate(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    return _both(rules.split(lines, unique("duplicate_line", "l_orderkey", "l_linenumber")))


CHAIN = f"""{ADM}, {ROUGH},
    a1 AS (SELECT * FROM rough WHERE patient_id IS NOT NULL), b1 AS (SELECT *, 'missing_patient' AS failed_rule FROM rough WHERE patient_id IS NULL),
    a2 AS (SELECT * FROM a1 WHERE hospital IS NOT NULL), b2 AS (SELECT *, 'missing_hospital' AS failed_rule FROM a1 WHERE hospital IS NULL),
    d AS (SELECT episode_id FROM a2 GROUP BY 1 HAVING count(*) > 1),
    a3 AS (SELECT * FROM a2 ANTI JOIN d USING (episode_id)), b3 AS (SELECT *, 'duplicate_episode' AS failed_rule FROM a2 SEMI JOIN d USING (episode_id)),
    a4 AS (SELECT * FROM a3 WHERE admission_date <= DATE '{AS_OF}'), b4 AS (SELECT *, 'future_admission' AS failed_rule FROM a3 WHERE admission_date > DATE '{AS_OF}'),
    a5 AS (SELECT * FROM a4 WHERE admission_type IN {PRIORITIES}), b5 AS (SELECT *, 'admission_type' AS failed_rule FROM a4 WHERE admission_type NOT IN {PRIORITIES}),
    bad AS (SELECT * FROM b1 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b3 UNION ALL SELECT * FROM b4 UNION ALL SELECT * FROM b5)"""


@query(f"WITH {CHAIN} SELECT failed_rule, count(*) AS n_rows FROM bad GROUP BY 1 UNION ALL SELECT 'valid', count(*) FROM a5")
def q_rule_chain_counts(spark, sf_dir):
    tagged = rules.tag(rough(spark, sf_dir), RULES).select(rules.FAILED)
    known = tagged.where(F.col(rules.FAILED).isNull() | ~F.coalesce(F.col(rules.FAILED), F.lit("")).startswith(rules.UNKNOWN))
    return known.groupBy(F.coalesce(rules.FAILED, F.lit("valid")).alias("failed_rule")).agg(F.count("*").alias("n_rows"))


@query(f"WITH {CHAIN} SELECT episode_id, patient_id, hospital, admission_date, admission_type FROM a5")
def q_rule_chain_rows(spark, sf_dir):
    return rules.valid(rules.tag(rough(spark, sf_dir), RULES))


@query(f"WITH {CHAIN} SELECT episode_id, patient_id, hospital, admission_date, admission_type, failed_rule, 'batch_1' AS batch FROM bad")
def q_quarantine_roundtrip(spark, sf_dir):
    path = f"{folder(spark)}/quarantine"
    rules.write_quarantine(rules.rejected(rules.tag(rough(spark, sf_dir), RULES)), path, "batch_1")
    return spark.read.parquet(path)


# Increments and merges


@query(f"WITH {ADM} SELECT episode_id, admission_date FROM adm WHERE admission_date > DATE '{CUT}'")
def q_high_water(spark, sf_dir):
    return merge.newer_than(admissions(spark, sf_dir), "admission_date", CUT).select("episode_id", "admission_date")


@query(f"WITH {ADM}, s AS (SELECT * FROM adm WHERE admission_date < DATE '{CUT}') SELECT episode_id, patient_id FROM adm ANTI JOIN s USING (episode_id)")
def q_split_new(spark, sf_dir):
    df = admissions(spark, sf_dir)
    return merge.only_new(df, before(df, CUT), ["episode_id"]).select("episode_id", "patient_id")


@query(f"WITH {ADM}, s AS (SELECT * FROM adm WHERE admission_date < DATE '{CUT}') SELECT episode_id, patient_id FROM adm SEMI JOIN s USING (episode_id)")
def q_split_existing(spark, sf_dir):
    df = admissions(spark, sf_dir)
    return merge.only_known(df, before(df, CUT), ["episode_id"]).select("episode_id", "patient_id")


BATCHES = f"""{ADM}, b1 AS (SELECT * FROM adm WHERE admission_date < DATE '{CUT}'),
    b2 AS (SELECT * REPLACE (ward || '+' AS ward) FROM adm WHERE admission_date >= DATE '{LATER}')"""


def _batches(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    df = admissions(spark, sf_dir)
    return before(df, CUT), since(df, LATER).withColumn("ward", F.concat("ward", F.lit("+")))


@query(f"WITH {BATCHES} SELECT * FROM b1 ANTI JOIN b2 USING (episode_id) UNION ALL SELECT * FROM b2")
def q_merge_upsert(spark, sf_dir):
    target, source = _batches(spark, sf_dir)
    return merge.upsert(target, source, ["episode_id"])


@query(
    f"""WITH {BATCHES} SELECT episode_id, patient_id, ward, CAST(NULL AS VARCHAR) AS admission_source FROM b1 ANTI JOIN b2 USING (episode_id)
    UNION ALL SELECT b2.episode_id, b1.patient_id, b2.ward, 'referral' FROM b2 LEFT JOIN b1 USING (episode_id)"""
)
def q_merge_evolved(spark, sf_dir):
    target, source = _batches(spark, sf_dir)
    source = source.select("episode_id", "ward", F.lit("referral").alias("admission_source"))
    return merge.upsert(target.select("episode_id", "patient_id", "ward"), source, ["episode_id"])


@query(f"WITH {BATCHES} SELECT * FROM b1 UNION ALL SELECT * FROM b2 ANTI JOIN b1 USING (episode_id)")
def q_merge_insert_only(spark, sf_dir):
    return merge.insert_only(*_batches(spark, sf_dir), ["episode_id"])


@query(f"WITH {BATCHES} SELECT * FROM b1 ANTI JOIN b2 USING (episode_id) UNION ALL SELECT * FROM b2")
def q_store_upsert(spark, sf_dir):
    store = TableStore(spark, folder(spark))
    target, source = _batches(spark, sf_dir)
    store.upsert("silver", target, ["episode_id"], 8)
    store.upsert("silver", source, ["episode_id"], 8)
    return store.read("silver")


@query(f"WITH {BATCHES} SELECT episode_id, 'a.parquet' AS source_file FROM b1 UNION ALL SELECT episode_id, 'b.parquet' FROM b2")
def q_append_once(spark, sf_dir):
    root = folder(spark)
    layers = Layers(spark, MEDALLION, root)
    first, second = _batches(spark, sf_dir)
    for df, batch in ((first, "a.parquet"), (first, "a.parquet"), (second, "b.parquet"), (second, "b.parquet")):
        layers.bronze(df, batch)
    return layers.store.read("bronze").select("episode_id", "source_file")


# Dimensions

CAL = """cal AS (SELECT CAST(d AS DATE) AS full_date FROM generate_series(TIMESTAMP '{0}', TIMESTAMP '{1}', INTERVAL 1 DAY) t(d))"""


@query(
    f"""WITH {CAL.format('2020-01-01', '2035-12-31')} SELECT CAST(strftime(full_date, '%Y%m%d') AS INT) AS date_key, full_date, CAST(day(full_date) AS INT) AS day,
        CAST(month(full_date) AS INT) AS month, monthname(full_date) AS month_name, CAST(quarter(full_date) AS INT) AS quarter, CAST(year(full_date) AS INT) AS year,
        CAST(week(full_date) AS INT) AS week_of_year, CAST(dayofweek(full_date) + 1 AS INT) AS day_of_week, dayname(full_date) AS day_name,
        CASE WHEN dayofweek(full_date) IN (0, 6) THEN 'Yes' ELSE 'No' END AS is_weekend FROM cal"""
)
def q_calendar(spark, sf_dir):
    return calendar(spark)


SITES = f"SELECT CAST(row_number() OVER (ORDER BY hospital) AS BIGINT) AS site_key, hospital FROM (SELECT DISTINCT {INITCAP.format('hospital')} AS hospital FROM {{0}})"
RAW_SITES = "SELECT CAST(row_number() OVER (ORDER BY hospital) AS BIGINT) AS site_key, hospital FROM (SELECT DISTINCT hospital FROM {0} WHERE hospital IS NOT NULL)"
FIRST = f"{ADM}, f AS (SELECT * FROM adm WHERE admission_date < DATE '1995-01-03')"


@query(f"WITH {ADM} {SITES.format('adm')}")
def q_dim_site_initial(spark, sf_dir):
    return star.new_members(admissions(spark, sf_dir), SITE, None, {})


def _first(spark, sf_dir) -> DataFrame:
    return before(admissions(spark, sf_dir), "1995-01-03")


@query(
    f"""WITH {FIRST}, e AS ({SITES.format('f')}), n AS (SELECT DISTINCT {INITCAP.format('hospital')} AS hospital FROM adm)
    SELECT CAST(row_number() OVER (ORDER BY hospital) + (SELECT coalesce(max(site_key), 0) FROM e) AS BIGINT) AS site_key, hospital FROM n ANTI JOIN e USING (hospital)"""
)
def q_dim_site_incremental(spark, sf_dir):
    existing = star.new_members(_first(spark, sf_dir), SITE, None, {})
    return star.new_members(admissions(spark, sf_dir), SITE, existing, {})


UNITS = """SELECT CAST(dense_rank() OVER (ORDER BY site_key, department) AS BIGINT) AS unit_key, site_key, department
    FROM (SELECT DISTINCT site_key, department FROM {0} JOIN site USING (hospital) WHERE department IS NOT NULL)"""


@query(f"WITH {ADM}, site AS ({RAW_SITES.format('adm')}) {UNITS.format('adm')}")
def q_dim_unit_initial(spark, sf_dir):
    df = admissions(spark, sf_dir)
    return star.new_members(df, UNIT, None, {"dim_site": star.new_members(df, RAW_SITE, None, {})})


@query(
    f"""WITH {FIRST}, site AS ({RAW_SITES.format('adm')}), e AS ({UNITS.format('f')}),
    n AS (SELECT DISTINCT site_key, department FROM adm JOIN site USING (hospital))
    SELECT CAST(dense_rank() OVER (ORDER BY site_key, department) + (SELECT max(unit_key) FROM e) AS BIGINT) AS unit_key, site_key, department FROM n ANTI JOIN e USING (site_key, department)"""
)
def q_dim_unit_incremental(spark, sf_dir):
    df = admissions(spark, sf_dir)
    tables = {"dim_site": star.new_members(df, RAW_SITE, None, {})}
    return star.new_members(df, UNIT, star.new_members(_first(spark, sf_dir), UNIT, None, tables), tables)


PERSONS = """SELECT CAST(dense_rank() OVER (ORDER BY patient_id) AS BIGINT) AS person_key, patient_id, patient_name
    FROM (SELECT patient_id, arg_min(patient_name, episode_id) AS patient_name FROM {0} WHERE patient_id IS NOT NULL GROUP BY 1)"""


@query(f"WITH {ADM} {PERSONS.format('adm')}")
def q_dim_person_initial(spark, sf_dir):
    return star.new_members(admissions(spark, sf_dir), PERSON, None, {})


@query(
    f"""WITH {BATCHES}, e AS ({PERSONS.format("(SELECT * FROM b1 WHERE admission_date < DATE '1995-03-01')")}), n AS ({PERSONS.format('adm')})
    SELECT CAST(dense_rank() OVER (ORDER BY patient_id) + (SELECT max(person_key) FROM e) AS BIGINT) AS person_key, patient_id, patient_name FROM n ANTI JOIN e USING (patient_id)"""
)
def q_dim_person_incremental(spark, sf_dir):
    df = admissions(spark, sf_dir)
    return star.new_members(df, PERSON, star.new_members(before(df, "1995-03-01"), PERSON, None, {}), {})


# Facts

STAR = f"""{BATCHES}, {CAL.format('1992-01-01', '2005-12-31')}, dates AS (SELECT CAST(strftime(full_date, '%Y%m%d') AS INT) AS date_key, full_date FROM cal),
    site AS ({RAW_SITES.format('adm')}), unit AS ({UNITS.format('adm')}), person AS ({PERSONS.format('adm')}),
    looked AS (SELECT episode_id, person_key, site.site_key, unit_key, date_key, ward, admission_type, admission_date FROM adm
        LEFT JOIN person USING (patient_id) LEFT JOIN site USING (hospital)
        LEFT JOIN unit ON unit.site_key = site.site_key AND unit.department = adm.department LEFT JOIN dates ON full_date = admission_date),
    f1 AS (SELECT CAST(row_number() OVER (ORDER BY person_key, date_key, site_key, unit_key, episode_id) AS BIGINT) AS fact_key, * EXCLUDE (admission_date)
        FROM looked WHERE admission_date < DATE '{CUT}')"""


def _tables(spark, df) -> dict[str, DataFrame]:
    tables = {"dim_date": calendar(spark, "1992-01-01", "2005-12-31"), "dim_site": star.new_members(df, RAW_SITE, None, {})}
    tables["dim_unit"] = star.new_members(df, UNIT, None, tables)
    tables["dim_person"] = star.new_members(df, PERSON, None, tables)
    return tables


@query(f"WITH {STAR} SELECT * FROM f1")
def q_fact_initial(spark, sf_dir):
    df = admissions(spark, sf_dir)
    return star.new_facts(before(df, CUT), FACT, None, _tables(spark, df))


@query(
    f"""WITH {STAR} SELECT CAST(row_number() OVER (ORDER BY person_key, date_key, site_key, unit_key, episode_id) + (SELECT max(fact_key) FROM f1) AS BIGINT) AS fact_key, * EXCLUDE (admission_date)
    FROM looked ANTI JOIN f1 USING (episode_id)"""
)
def q_fact_incremental(spark, sf_dir):
    df = admissions(spark, sf_dir)
    tables = _tables(spark, df)
    return star.new_facts(df, FACT, star.new_facts(before(df, CUT), FACT, None, tables), tables)


@query(f"WITH {STAR} SELECT episode_id, person_key, date_key FROM looked WHERE site_key = 7 OR admission_date > DATE '2000-12-31'")
def q_fact_unresolved(spark, sf_dir):
    df = admissions(spark, sf_dir)
    tables = _tables(spark, df)
    tables["dim_site"] = tables["dim_site"].where("site_key <> 7")
    late = F.col("admission_date") > F.lit("2000-12-31").cast("date")
    found = star.resolve(df, FACT.lookups, tables | {"dim_date": tables["dim_date"]})
    return found.where(F.col("site_key").isNull() | F.col("unit_key").isNull() | late).select("episode_id", "person_key", "date_key")


# Quality


@query(
    f"""WITH {STAR}, d AS (SELECT 'dim_person' AS table_name, person_key AS k FROM person UNION ALL SELECT 'dim_broken', CASE WHEN person_key % 50 = 0 THEN NULL ELSE person_key // 2 END FROM person),
    g AS (SELECT table_name, k, count(*) AS n FROM d GROUP BY 1, 2),
    s AS (SELECT table_name, CAST(sum(n) AS BIGINT) AS row_count, CAST(coalesce(sum(n) FILTER (k IS NULL), 0) AS BIGINT) AS null_keys, count(*) FILTER (n > 1) AS duplicate_keys FROM g GROUP BY 1)
    SELECT *, CASE WHEN row_count > 0 AND null_keys = 0 AND duplicate_keys = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM s"""
)
def q_quality_dimension(spark, sf_dir):
    person = star.new_members(admissions(spark, sf_dir), PERSON, None, {})
    k = F.col("person_key")
    broken = person.select(F.when(k % 50 == 0, None).otherwise(F.floor(k / 2)).alias("person_key"))
    return quality.dimension_quality(person, "dim_person", "person_key").unionAll(quality.dimension_quality(broken, "dim_broken", "person_key"))


@query(f"WITH {ADM}, {ROUGH} SELECT count(*) FILTER (patient_id IS NULL) AS patient_id, count(*) FILTER (hospital IS NULL) AS hospital FROM rough")
def q_quality_fact_nulls(spark, sf_dir):
    return quality.null_counts(rough(spark, sf_dir), ["patient_id", "hospital"])


@query(f"WITH {ADM}, {ROUGH} SELECT episode_id, count(*) AS n_rows FROM rough GROUP BY 1 HAVING count(*) > 1")
def q_quality_fact_dups(spark, sf_dir):
    return quality.duplicated(rough(spark, sf_dir), ["episode_id"])


@query(
    f"""WITH {STAR}, o AS (SELECT * FROM f1 WHERE site_key = 7)
    SELECT 'fact_admission' AS table_name, check_name, failures, CASE WHEN failures = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (
        SELECT 'null_keys' AS check_name, 0::BIGINT AS failures UNION ALL SELECT 'duplicate_rows', 0 UNION ALL
        SELECT 'row_count', (SELECT count(*) FROM adm) - (SELECT count(*) FROM f1) UNION ALL
        SELECT 'orphans_person_key', 0 UNION ALL SELECT 'orphans_site_key', (SELECT count(*) FROM o))"""
)
def q_quality_fk(spark, sf_dir):
    df = admissions(spark, sf_dir)
    tables = _tables(spark, df)
    fact = star.new_facts(before(df, CUT), FACT, None, tables)
    foreign = {"person_key": (tables["dim_person"], "person_key"), "site_key": (tables["dim_site"].where("site_key <> 7"), "site_key")}
    return quality.fact_quality(df, fact, FACT.natural, foreign, FACT.name)


@query(f"WITH {STAR} SELECT (SELECT count(*) FROM adm) AS silver_rows, (SELECT count(*) FROM f1) AS fact_rows, (SELECT count(DISTINCT person_key) FROM f1) AS persons")
def q_quality_rowcount(spark, sf_dir):
    df = admissions(spark, sf_dir)
    fact = star.new_facts(before(df, CUT), FACT, None, _tables(spark, df))
    return df.agg(F.count("*").alias("silver_rows")).crossJoin(fact.agg(F.count("*").alias("fact_rows"), F.count_distinct("person_key").alias("persons")))  # one row each


@query(
    f"""WITH {ADM}, {ROUGH} SELECT 'rough' AS table_name, (SELECT count(*) FROM rough) AS row_count, CAST(5 AS INT) AS column_count, column_name, filled FROM (
        SELECT 'episode_id' AS column_name, count(episode_id) AS filled FROM rough UNION ALL SELECT 'patient_id', count(patient_id) FROM rough UNION ALL
        SELECT 'hospital', count(hospital) FROM rough UNION ALL SELECT 'admission_date', count(admission_date) FROM rough UNION ALL SELECT 'admission_type', count(admission_type) FROM rough)"""
)
def q_profile(spark, sf_dir):
    return quality.profile(rough(spark, sf_dir), "rough")


@query(f"WITH {ADM} SELECT CAST(row_number() OVER (ORDER BY admission_date, episode_id) AS BIGINT) AS position, episode_id, admission_date FROM adm")
def q_sorted_listing(spark, sf_dir):
    return keys.numbered(admissions(spark, sf_dir).select("admission_date", "episode_id"), ["admission_date", "episode_id"], "position")


@query(f"WITH {ADM} SELECT hospital, max(admission_date) AS latest, arg_max(episode_id, (admission_date, episode_id)) AS episode_id FROM adm GROUP BY 1")
def q_latest_by_group(spark, sf_dir):
    newest = F.max(F.struct("admission_date", "episode_id")).alias("m")
    return admissions(spark, sf_dir).groupBy("hospital").agg(newest).select("hospital", F.col("m.admission_date").alias("latest"), F.col("m.episode_id").alias("episode_id"))


@query(
    """SELECT * FROM (VALUES ('same', true, 'Schema approved.', '', '', ''), ('wider', true, 'Schema approved.', 'admission_source', '', ''),
        ('narrower', false, 'Columns have been removed.', '', 'ward', ''), ('retyped', false, 'Data type changes detected.', '', '', 'ward:string>int'))
        t(case_name, approved, reason, new_columns, removed_columns, type_changes)"""
)
def q_schema_diff(spark, sf_dir):
    df = admissions(spark, sf_dir)
    cases = {"same": df, "wider": df.withColumn("admission_source", F.lit("x")), "narrower": df.drop("ward"), "retyped": df.withColumn("ward", F.lit(1))}
    rows = []
    for name, changed in cases.items():
        diff = contract.difference(df.schema, changed.schema)
        said = contract.decide(diff)
        rows.append((name, said.approved, said.reason, ",".join(diff.new_columns), ",".join(diff.removed_columns), ",".join(f"{c}:{a}>{b}" for c, a, b in diff.type_changes)))
    return spark.createDataFrame(rows, "case_name string, approved boolean, reason string, new_columns string, removed_columns string, type_changes string")


# Sources, streams, the whole pipeline


@query("SELECT n_nationkey AS id, n_name AS name, DATE '2026-01-10' + CAST(n_nationkey AS INT) AS opened FROM nation")
def q_xlsx_roundtrip(spark, sf_dir):
    import datetime as dt

    rows = [(r.n_nationkey, r.n_name, dt.date(2026, 1, 10) + dt.timedelta(days=int(r.n_nationkey))) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect()]  # 25 nations
    path = Path(tempfile.mkdtemp(prefix="strata-")) / "nations.xlsx"
    write_xlsx(str(path), ["id", "name", "opened"], rows)
    df = read_file(spark, str(path), "id long, name string, opened date")
    return spark.createDataFrame(df.collect(), df.schema)


@query("SELECT CAST(n_nationkey AS INT) AS id, n_name AS name FROM nation WHERE n_nationkey >= 5")
def q_jdbc_roundtrip(spark, sf_dir):
    """Through Derby, written by the driver and read by executors. The filter is pushed to the database."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("name"))
    return jdbc(spark, derby_table(nations, "nations"), "nations", DERBY).where("id >= 5")


@query(f"WITH {ADM} SELECT count(*) AS fact_rows, 'FAILED,SUCCESS' AS gold_states FROM adm")
def q_resume(spark, sf_dir):
    """A run that fails in the last layer and, run again, does that layer only."""
    root, states = folder(spark), []
    layers = Layers(spark, MEDALLION, root)
    df, gold = admissions(spark, sf_dir), layers.gold
    layers.gold = lambda: (_ for _ in ()).throw(OSError("lost"))
    for _ in range(2):
        try:
            layers.run(df, "batch_1")
        except OSError:
            layers.gold = gold
        states.append(layers.ledger.status("batch_1", "gold"))
    return layers.store.read("fact_admission").agg(F.count("*").alias("fact_rows")).withColumn("gold_states", F.lit(",".join(states)))


@query(f"WITH {ADM} SELECT episode_id, ward FROM adm")
def q_stream_ingest(spark, sf_dir):
    root = folder(spark)
    df = admissions(spark, sf_dir).select("episode_id", "ward")
    df.repartition(4).write.parquet(f"{root}/landing")
    store = TableStore(spark, f"{root}/tables")
    for _ in range(2):
        ingest(spark, f"{root}/landing", "episode_id long, ward string", store, "events", f"{root}/progress", ["episode_id"], files_per_batch=2, buckets=4).awaitTermination()
    return store.read("events")


MEDALLION_SQL = f"""WITH {STAR} SELECT f.episode_id, p.patient_name, s.hospital, u.department, d.full_date AS admission_date, f.ward, f.admission_type
    FROM (SELECT * FROM looked) f JOIN person p USING (person_key) JOIN site s ON s.site_key = f.site_key JOIN unit u USING (unit_key) JOIN dates d USING (date_key)"""


@query(MEDALLION_SQL)
def q_medallion(spark, sf_dir):
    """Two batches through all layers; the second overlaps the first and is given twice."""
    root = folder(spark)
    layers = Layers(spark, MEDALLION, root)
    df = admissions(spark, sf_dir)
    for rows, batch in ((before(df, CUT), "batch_1"), (since(df, LATER), "batch_2"), (since(df, LATER), "batch_2")):
        layers.run(rows, batch)
    read = layers.store.read
    fact = read("fact_admission")
    joined = fact.join(read("dim_person"), "person_key").join(read("dim_site"), "site_key").join(read("dim_unit").drop("site_key"), "unit_key").join(read("dim_date"), "date_key")
    return joined.select("episode_id", "patient_name", "hospital", "department", F.col("full_date").alias("admission_date"), "ward", "admission_type")


REPORT_SQL = f"""WITH {STAR} SELECT 'bronze' AS item, count(*) + 2 AS row_count FROM adm UNION ALL SELECT 'silver', count(*) FROM adm
    UNION ALL SELECT 'dim_site', count(*) FROM site UNION ALL SELECT 'dim_unit', count(*) FROM unit UNION ALL SELECT 'dim_person', count(*) FROM person
    UNION ALL SELECT 'dim_date', count(*) FROM dates UNION ALL SELECT 'fact_admission', count(*) FROM adm
    UNION ALL SELECT 'quarantine:missing_patient', 2 UNION ALL SELECT 'silver:repeated_keys', 0 UNION ALL SELECT 'ledger:processed', 2
    UNION ALL SELECT 'ledger:schema_changes', 0 UNION ALL SELECT 'ledger:watermark:batch_2', 1"""


@query(REPORT_SQL)
def q_layer_report(spark, sf_dir):
    """Every admission in one batch, then two rows without a patient."""
    layers = Layers(spark, MEDALLION, folder(spark))
    df = admissions(spark, sf_dir)
    layers.run(df, "batch_1")
    layers.run(df.orderBy("episode_id").limit(2).withColumn("patient_id", F.lit(None).cast("long")).withColumn("episode_id", -F.col("episode_id")), "batch_2")
    return layers.report()


@query(f"WITH {ADM} SELECT * FROM (VALUES ('one.parquet', 1, true), ('two.parquet', 2, true)) t(file, position, archived), (SELECT count(*) AS silver_rows FROM adm)")
def q_landing_run(spark, sf_dir):
    """Landing files, oldest first whatever their names, taken through all layers and moved away; a second call finds nothing."""
    import os

    root = Path(tempfile.mkdtemp(prefix="strata-"))
    first, second = before(admissions(spark, sf_dir), CUT), since(admissions(spark, sf_dir), LATER)
    for when, (name, rows) in enumerate((("one.parquet", first), ("two.parquet", second)), 1):
        rows.write.parquet(f"file://{root}/landing/{name}")
        os.utime(root / "landing" / name, (when, when))
    layers = Layers(spark, MEDALLION, folder(spark))
    taken = layers.run_landing(str(root / "landing"), str(root / "done")) + layers.run_landing(str(root / "landing"), str(root / "done"))
    rows = [(name, k, (root / "done" / name).exists() and not (root / "landing" / name).exists()) for k, name in enumerate(taken, 1)]
    counted = layers.store.read("silver").agg(F.count("*").alias("silver_rows"))
    return spark.createDataFrame(rows, "file string, position int, archived boolean").crossJoin(counted)  # one row


@query(
    f"""WITH {ADM} SELECT episode_id, TIMESTAMP '2026-01-10 10:00:00' AS created_at, TIMESTAMP '2026-01-10 10:00:00' AS updated_at, 'admissions' AS pipeline_name, 'batch_1' AS batch_id FROM adm"""
)
def q_audit_columns(spark, sf_dir):
    """The clock is an argument."""
    return audit(admissions(spark, sf_dir).select("episode_id"), "admissions", "batch_1", F.lit("2026-01-10 10:00:00").cast("timestamp_ntz"))


@query(f"WITH {ADM} SELECT episode_id, CASE WHEN episode_id % 5 = 0 THEN NULL ELSE admission_date END AS admission_date FROM adm")
def q_date_coercion(spark, sf_dir):
    """Texts in another format are parsed, unreadable ones become NULL."""
    text = F.when(F.col("episode_id") % 5 == 0, "31.02.1999").otherwise(F.date_format("admission_date", "dd.MM.yyyy"))
    return standardize(admissions(spark, sf_dir).select("episode_id", text.alias("admission_date")), ["admission_date"], "dd.MM.yyyy")


@query(f"""WITH {BATCHES} SELECT * FROM (VALUES (0, false)) t(version, exists_), (SELECT 0::BIGINT AS row_count) UNION ALL SELECT 1, true, count(*) FROM b1
    UNION ALL SELECT 2, true, (SELECT count(*) FROM b1) + (SELECT count(*) FROM b2) FROM (SELECT 1) UNION ALL SELECT 3, true, (SELECT count(*) FROM b1) + (SELECT count(*) FROM b2) FROM (SELECT 1)""")
def q_store_versions(spark, sf_dir):
    """A table that isn't there, its first version, an append, and the same rows compacted; each version is read by number."""
    store = TableStore(spark, folder(spark))
    first, second = _batches(spark, sf_dir)
    missing = (0, store.read_or_none("raw") is not None, 0)
    store.append("raw", first, ["episode_id"], 4)
    store.append("raw", second)
    store.compact("raw", 8)
    out = spark.createDataFrame([missing], "version int, exists_ boolean, row_count bigint")
    for version in store.versions("raw"):
        out = out.unionAll(store.read("raw", version).agg(F.lit(version).alias("version"), F.lit(True).alias("exists_"), F.count("*").alias("row_count")))
    return out


@query("SELECT * FROM (VALUES ('batch_2', 'admission_source', '', 'batch_2', 2)) t(batch, new_columns, removed_columns, last_processed_file, processed)")
def q_registry(spark, sf_dir):
    """The registered change of a batch with a new column, the watermark and the processed list, read by another ledger object."""
    root = folder(spark)
    layers = Layers(spark, MEDALLION, root)
    df = admissions(spark, sf_dir)
    layers.bronze(df, "batch_1")
    layers.ledger.finish("batch_1")
    layers.bronze(df.withColumn("admission_source", F.lit("GP")), "batch_2")
    layers.ledger.finish("batch_2")
    again = Layers(spark, MEDALLION, root).ledger
    rows = [(c["batch"], ",".join(c["new_columns"]), ",".join(c["removed_columns"]), again.watermark()["last_processed_file"], len(again.processed())) for c in again.schema_changes()]
    return spark.createDataFrame(rows, "batch string, new_columns string, removed_columns string, last_processed_file string, processed int")
