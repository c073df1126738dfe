"""Rule chains, contracts, quarantine and column functions."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strata.functions import audit, standardize
from strata.operators import contract, rules
from strata.specs import in_domain, not_after, not_null, unique

SCHEMA = "episode_id string, patient_id string, hospital string, admission_date date, admission_type string"
TODAY = dt.date.today()
BASE = [("E001", "P001", "St Mary's Hospital", dt.date(2026, 1, 10), "Emergency"), ("E002", "P002", "General Hospital", dt.date(2026, 2, 5), "Elective")]
CHECKS = [not_null("patient", "patient_id"), not_null("hospital", "hospital"), unique("episode", "episode_id"), not_after("future", "admission_date", "2026-06-01"), in_domain("type", "admission_type", "Emergency", "Elective")]


def with_change(at, value):
    row = list(BASE[0])
    row[at] = value
    return [tuple(row), BASE[1]]


@pytest.mark.parametrize(
    ("rows", "rule", "n_valid", "n_invalid"),
    [
        (BASE, CHECKS[0], 2, 0),
        (with_change(1, None), CHECKS[0], 1, 1),
        (with_change(2, None), CHECKS[1], 1, 1),
        (with_change(4, "Invalid Type"), CHECKS[4], 1, 1),
        (with_change(3, TODAY + dt.timedelta(days=10)), not_after("future", "admission_date"), 1, 1),
        ([*BASE, BASE[0]], CHECKS[2], 1, 2),
        (with_change(4, None), CHECKS[4], 1, 0),
    ],
)
def test_single_rules(spark, rows, rule, n_valid, n_invalid):
    rows = [r if r[3] != dt.date(2026, 2, 5) or rule.name != "future" else (*r[:3], dt.date(2020, 1, 1), r[4]) for r in rows]
    good, bad = rules.split(spark.createDataFrame(rows, SCHEMA), rule)
    assert (good.count(), bad.count()) == (n_valid, n_invalid)


def sequential(rows):
    """One rule after the other."""
    out, alive = [], list(rows)
    for name, passes in (
        ("patient", lambda r, _: r[1] is not None),
        ("hospital", lambda r, _: r[2] is not None),
        ("episode", lambda r, all_: r[0] is None or sum(x[0] == r[0] for x in all_) == 1),
        ("future", lambda r, _: None if r[3] is None else r[3] <= dt.date(2026, 6, 1)),
        ("type", lambda r, _: None if r[4] is None else r[4] in ("Emergency", "Elective")),
    ):
        said = [(r, passes(r, alive)) for r in alive]
        out += [(name, r) for r, p in said if p is False]
        alive = [r for r, p in said if p]
    return sorted(map(str, [(None, r) for r in alive] + out))


row = st.tuples(
    st.sampled_from(["a", "b", "c", None]), st.sampled_from(["p", "q", None]), st.sampled_from(["h", "h", None]), st.sampled_from([dt.date(2026, 1, 1), dt.date(2027, 1, 1), None]), st.sampled_from(["Emergency", "Other", None])
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(row, max_size=14))
def test_chain_equals_one_rule_after_the_other(spark, rows):
    tagged = rules.tag(spark.createDataFrame(rows, SCHEMA), CHECKS)
    got = [(None, tuple(r)) for r in rules.valid(tagged).collect()] + [(r[5], tuple(r)[:5]) for r in rules.rejected(tagged).collect()]
    assert sorted(map(str, got)) == sequential(rows)
    strict = rules.tag(spark.createDataFrame(rows, SCHEMA), CHECKS, "strict")
    assert rules.valid(strict).count() + rules.rejected(strict).count() == len(rows)


def test_quarantine_keeps_other_batches(spark, tmp_path):
    df = rules.tag(spark.createDataFrame(with_change(1, None), SCHEMA), CHECKS)
    for batch in ("b1", "b2", "b2"):
        rules.write_quarantine(rules.rejected(df), f"{tmp_path}/q", batch)
    assert sorted((r.batch, r.failed_rule) for r in spark.read.parquet(f"{tmp_path}/q").collect()) == [("b1", "patient"), ("b2", "patient")]


def test_required_columns(spark):
    df = spark.createDataFrame(BASE, SCHEMA)
    assert rules.require_columns(df, ["episode_id"]) is df
    with pytest.raises(ValueError, match="ward"):
        rules.require_columns(df, ["episode_id", "ward"])


def test_contracts(spark):
    df = spark.createDataFrame(BASE, SCHEMA)
    assert not contract.enforce(None, df.schema) and not contract.enforce(df.schema, df.schema)
    assert contract.enforce(df.schema, df.withColumn("source", F.lit("x")).schema).new_columns == ("source",)
    with pytest.raises(contract.ContractError, match="removed"):
        contract.enforce(df.schema, df.drop("hospital").schema)
    assert contract.enforce(df.schema, df.drop("hospital").schema, optional=["hospital"]).removed_columns == ("hospital",)
    with pytest.raises(contract.ContractError, match="type"):
        contract.enforce(df.schema, df.withColumn("hospital", F.lit(1)).schema)
    assert not contract.enforce(audit(df, "p", "b").schema, df.schema)


def test_audit_and_standardize(spark):
    df = audit(spark.createDataFrame(BASE, SCHEMA), "healthcare", "20260808_054300")
    assert df.columns[-4:] == ["created_at", "updated_at", "pipeline_name", "batch_id"]
    assert all(r.created_at and r.updated_at and r.pipeline_name == "healthcare" and r.batch_id == "20260808_054300" for r in df.collect())
    raw = spark.createDataFrame([("nan", "2026-01-02"), ("  NaN ", "bad"), ("Royal", None)], "hospital string, day string")
    assert [tuple(r) for r in standardize(raw, ["day"]).collect()] == [(None, dt.date(2026, 1, 2)), (None, None), ("Royal", None)]
