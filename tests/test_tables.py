"""Merges, the snapshot store and surrogate keys."""

import threading

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from strata.operators import keys, merge
from strata.plans import store as store_module
from strata.plans.files import SharedFiles
from strata.plans.store import ConflictError, MissingTableError, TableStore

PAIRS = st.lists(st.tuples(st.sampled_from([1, 2, 3, 4, None]), st.integers(0, 9)), max_size=8)


def simulate(target, source, update):
    """MERGE row by row."""
    out = []
    for k, v in target:
        match = [s for s in source if k is not None and s[0] == k]
        out.append((k, match[0][1] if match and update else v))
    known = {k for k, _ in target if k is not None}
    return sorted(map(str, out + [s for s in source if s[0] is None or s[0] not in known]))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(PAIRS, PAIRS)
def test_merges_equal_row_by_row(spark, target, source):
    # A target without repeated keys, as a merged table is.
    target = [t for i, t in enumerate(target) if t[0] is None or t[0] not in {x[0] for x in target[:i]}]
    t, s = (spark.createDataFrame(x, "k int, v int") for x in (target, source))
    assert sorted(str(tuple(r)) for r in merge.insert_only(t, s, ["k"]).collect()) == simulate(target, source, False)
    repeated = {k for k, _ in source if k is not None and sum(x[0] == k for x in source) > 1} & {k for k, _ in target}
    if repeated:
        with pytest.raises(merge.DuplicateMatchError):
            merge.upsert(t, s, ["k"])
    else:
        assert sorted(str(tuple(r)) for r in merge.upsert(t, s, ["k"]).collect()) == simulate(target, source, True)


def test_upsert_with_other_columns(spark):
    t = spark.createDataFrame([(1, "a", "old"), (2, "b", "old")], "k int, kept string, made string")
    s = spark.createDataFrame([(1, "new", "x"), (3, "new", "y")], "k int, made string, added string")
    got = sorted(tuple(r) for r in merge.upsert(t, s, ["k"]).select("k", "kept", "made", "added").collect())
    assert got == [(1, "a", "new", "x"), (2, "b", "old", None), (3, None, "new", "y")]
    got = sorted(tuple(r) for r in merge.upsert(t, s, ["k"], preserve=["made"]).select("k", "made").collect())
    assert got == [(1, "old"), (2, "old"), (3, "new")]


def test_store(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/tables")
    assert not store.exists("t") and store.read_or_none("t") is None
    with pytest.raises(MissingTableError):
        store.read("t")
    store.upsert("t", spark.createDataFrame([(i, f"v{i}") for i in range(40)], "k int, v string"), ["k"], 8)
    before = {s["dir"] for s in store.manifest("t").segments}
    store.upsert("t", spark.createDataFrame([(3, "new", 1), (100, "new", 1)], "k int, v string, extra int"), ["k"], 8)
    rows = {r.k: (r.v, r.extra) for r in store.read("t").collect()}
    assert len(rows) == 41 and rows[3] == ("new", 1) and rows[4] == ("v4", None) and rows[100] == ("new", 1)
    first = next(s for s in store.manifest("t").segments if s["dir"] in before)
    assert 6 <= len(first["buckets"]) < 8  # untouched buckets stay where they are
    assert store.read("t", version=1).count() == 40
    store.insert_only("t", spark.createDataFrame([(3, "again"), (200, "one")], "k int, v string"), ["k"])
    assert store.read("t").count() == 42 and store.read("t").where("k = 3").first().v == "new"
    store.restore("t", 1)
    assert store.read("t").count() == 40 and store.versions("t") == [1, 2, 3, 4]
    m = store.manifest("t")
    with pytest.raises(ConflictError):
        store._commit("t", m)
    store.vacuum("t")
    assert store.versions("t") == [4] and store.read("t").count() == 40
    store.overwrite("e", spark.createDataFrame([], "k int"))
    assert store.read("e").count() == 0
    with pytest.raises(ValueError, match="laid out"):
        store.upsert("t", spark.createDataFrame([(1, "a")], "k int, v string"), ["v"], 8)


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as x", "cast(if(id % 10 = 0, null, id % 3) as int) as y")
    got = keys.numbered(df, ["y", "x"], "n", parts=7).orderBy("n").collect()
    want = sorted(((r.x, r.y) for r in df.collect()), key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert [(r.x, r.y) for r in got] == want and [r.n for r in got] == list(range(1, 1001))


def test_keys_continue(spark):
    existing = spark.createDataFrame([(1, "Royal"), (2, "City")], "site_key bigint, site string")
    new = spark.createDataFrame([("Royal",), ("New",), ("Alder",)], "site string")
    assert sorted(tuple(r) for r in keys.assign(new, existing, ["site"], "site_key").collect()) == [(3, "Alder"), (4, "New")]
    assert keys.assign(new.limit(0), existing, ["site"], "site_key").count() == 0


def test_one_of_many_writers_creates_a_file(spark, tmp_path):
    files, won = SharedFiles(spark), []

    def write(k):
        try:
            files.create(f"file://{tmp_path}/log/1.json", str(k) * 1000)
            won.append(k)
        except ConflictError:
            pass

    writers = [threading.Thread(target=write, args=(k,)) for k in range(8)]
    for t in writers:
        t.start()
    for t in writers:
        t.join()
    assert len(won) == 1 and files.read_text(f"file://{tmp_path}/log/1.json") == str(won[0]) * 1000
    assert [p.name for p in (tmp_path / "log").iterdir()] == ["1.json"]
    files.replace(f"file://{tmp_path}/log/1.json", "new")
    assert files.read_text(f"file://{tmp_path}/log/1.json") == "new"
    # The steps that other file systems take.
    files._write(f"file://{tmp_path}/a", "x", False)
    files._rename(f"file://{tmp_path}/a", f"file://{tmp_path}/b", False)
    files._write(f"file://{tmp_path}/a", "y", False)
    with pytest.raises(Exception, match="AlreadyExists|already exists"):
        files._rename(f"file://{tmp_path}/a", f"file://{tmp_path}/b", False)
    files._rename(f"file://{tmp_path}/a", f"file://{tmp_path}/b", True)
    assert files.read_text(f"file://{tmp_path}/b") == "y"


def test_segments_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "MOST_SEGMENTS", 3)
    store = TableStore(spark, f"file://{tmp_path}/tables")
    for k in range(5):
        store.append("t", spark.range(10 * k, 10 * k + 10).withColumnRenamed("id", "k"), ["k"], 2)
    assert len(store.manifest("t").segments) <= 3 and store.read("t").count() == 50
    store.compact("t", 5)
    assert len(store.manifest("t").segments) == 1 and store.manifest("t").buckets == 5
    store.upsert("t", spark.createDataFrame([(3,), (99,)], "k long"), ["k"])
    assert sorted(r.k for r in store.read("t").collect()) == [*range(50), 99]
    with pytest.raises(MissingTableError):
        store.compact("none")
