import datetime as dt
import json
import random

from pyspark.sql import functions as F

from rookery.functions.text import root_path
from rookery.operators import snapshots as S

SCHEMA = "id bigint, root_path string, snapshot_id string, indexed_at timestamp_ntz, payload string, seq int, unit_id string"


def unit(uid, **kw):
    return {"unit_id": uid, "kind": "function", "symbol": uid, "path": "p", **kw}


def frame(spark, rows):
    return spark.createDataFrame([(i, r, s, dt.datetime(2026, 1, 1) + dt.timedelta(hours=h), p, 0, "clash") for i, r, s, h, p in rows], SCHEMA)


def found(spark, rows):
    return sorted(tuple(r) for r in S.delivered_changes(frame(spark, rows)).select("snapshot_id", "unit_id", "change_type").collect())


def body(units, **kw):
    return json.dumps({"units": units, **kw})


def test_cases(spark):
    a, b, c = unit("a"), unit("b", calls=["x", "y"]), unit("c", calls=None)
    rows = [
        (1, "/r", "s1", 1, body({"a": a, "b": b, "c": c})),
        (2, "/r", "s0", 0, None),
        (3, "/r", "s2", 2, body([b | {"calls": ["y", "x", "x"]}, b | {"calls": ["y", "x", "x"]}, c | {"calls": []}, unit("d")])),
        (4, "/r/", "s3", 3, body({"a": a, "b": b | {"start_line": 9}, "c": {k: v for k, v in c.items() if k != "calls"}, "d": unit("d", module=None)})[:-4]),  # cut off
        (5, "//r/./", "s3", 3, body({"a": a, "b": b | {"imports": ["i"]}, "c": c, "d": unit("d", module=None, other=1)})),
        (6, "/r", "s4", 4, '{"files": {}}'),
        (7, "/r", "s5", 5, '[{"units": {}}]'),
        (8, "/r", "s6", 6, ""),
        (9, "/r", "s7", 7, body({"z": unit("z")})),
        (10, "/other", "s1", 1, body({"q": unit("q")})),
        (None, "/other", "s2", 2, body({})),
    ]
    assert found(spark, rows) == sorted(
        [("s2", "a", "removed"), ("s2", "d", "added"), ("s3", "a", "added"), ("s3", "b", "changed")] + [("s4", u, "removed") for u in "abcd"] + [("s7", "z", "added")]
    )


def test_highest_id_holds_and_order_is_by_time(spark):
    rows = [(9, "/r", "late", 1, body({"a": unit("a")})), (3, "/r", "late", 1, body({"b": unit("b")})), (1, "/r", "end", 2, body({"a": unit("a", signature="s")})), (12, "/r", "start", 0, body({}))]
    assert found(spark, rows) == [("end", "a", "changed"), ("late", "a", "added")]


def test_null_and_empty_scalars_differ_but_absent_and_null_do_not(spark):
    rows = [(1, "/r", "1", 1, body({"a": unit("a"), "b": unit("b")})), (2, "/r", "2", 2, body({"a": unit("a", module=None), "b": unit("b", module="")}))]
    assert found(spark, rows) == [("2", "b", "changed")]


def test_empty_table(spark):
    assert found(spark, []) == []


def test_fields(spark):
    rows = [(1, "/r", "1", 1, body({"a": unit("a", calls=["x"])})), (2, "/r", "2", 2, body({"a": unit("a", calls=["y", "x"], kind="test")}))]
    got = {tuple(r) for r in S.changed_fields(frame(spark, rows)).select("field", "old_value", "new_value").collect()}
    assert got == {("kind", "function", "test"), ("calls", '["x"]', '["x","y"]')}


def test_histories_against_brute_force(spark):
    rnd = random.Random(3)
    rows, want, last = [], [], {}
    for s in range(12):
        now = {k: unit(k, signature=str(rnd.randrange(2))) for k in "abcdefgh" if rnd.random() < 0.6}
        rows.append((s, "/r", f"s{s:02}", s, body(now if s % 3 else list(now.values()))))
        if s:
            want += [(f"s{s:02}", k, "added") for k in now.keys() - last.keys()] + [(f"s{s:02}", k, "removed") for k in last.keys() - now.keys()]
            want += [(f"s{s:02}", k, "changed") for k in now.keys() & last.keys() if now[k] != last[k]]
        last = now
    assert found(spark, rows) == sorted(want)


def test_store_swaps_indexes(spark, tmp_path):
    store = S.SnapshotStore(spark, str(tmp_path / "store"), "k", ["v"], ["s"], buckets=3)
    df = lambda rows: spark.createDataFrame(rows, "k string, v string, s array<string>, h string, bucket string")
    one = df([("a", "1", None, "", ""), ("b", None, ["y", "x"], "", ""), (None, "0", None, "", "")])
    assert store.apply(one).count() == 0 and store.version() == 1
    two = df([("a", "2", [], "", ""), ("b", None, ["x", "y", "y"], "", ""), ("c", "", None, "", "")])
    changes = store.apply(two)
    assert sorted(tuple(r) for r in changes.collect()) == [("a", "changed"), ("c", "added")]
    assert sorted(tuple(r) for r in store.changes().select("k", "change_type").collect()) == [("a", "changed"), ("c", "added")]  # they stay with the version
    spark.sql(f"drop table {store._name(2)}")  # a new session knows the files only
    assert store.index().count() == 3
    assert [r["v"] for r in store.values(one, changes.where("change_type = 'changed'")).collect()] == ["1"]
    assert sorted(tuple(r) for r in store.apply(df([])).collect()) == [("a", "removed"), ("b", "removed"), ("c", "removed")]


def test_a_job_lost_before_the_swap_is_run_again(spark, tmp_path, monkeypatch):
    store = S.SnapshotStore(spark, str(tmp_path / "lost"), "k", ["v"], buckets=2)
    df = lambda rows: spark.createDataFrame(rows, "k string, v string")
    store.apply(df([("a", "1"), ("b", "1")]))

    def lost(version):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_swap", lost)
        try:
            store.apply(df([("a", "2")]))
        except RuntimeError:
            pass
    assert store.version() == 1 and store.index().count() == 2
    again = S.SnapshotStore(spark, str(tmp_path / "lost"), "k", ["v"], buckets=2)
    want = [("a", "changed"), ("b", "removed")]
    assert sorted(tuple(r) for r in again.apply(df([("a", "2")])).collect()) == want
    after = S.SnapshotStore(spark, str(tmp_path / "lost"), "k", ["v"], buckets=2)  # lost behind the swap, before the changes were read
    assert after.version() == 2 and sorted(tuple(r) for r in after.changes().select("k", "change_type").collect()) == want
    for n in range(3, 6):
        assert [tuple(r) for r in after.apply(df([("a", str(n))])).collect()] == [("a", "changed")]
    assert sorted(x.name for x in (tmp_path / "lost").iterdir() if x.name.startswith("v")) == ["v4", "v5"]


def test_the_index_stays_in_its_buckets(spark, tmp_path):
    store = S.SnapshotStore(spark, str(tmp_path / "put"), "k", ["v"], buckets=3)
    rows = store.hashed(spark.createDataFrame([(str(i), "1") for i in range(50)], "k string, v string"))
    store.probe(rows, F.lit(True), first=True)
    both = store.index().select("scope", "k", "h").join(rows.hint("merge"), ["scope", "k"], "full_outer")
    assert both._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # of the new rows only


def test_root_paths(spark):
    x = spark.createDataFrame([("/a//b/",), ("/a/./b",), ("\\a\\b",), ("/a/././/b/.",), ("/",), (None,)], "p string")
    assert [r[0] for r in x.select(root_path(F.col("p"))).collect()] == ["/a/b"] * 4 + ["/", None]
