import datetime as dt
import random

from rookery.llm import bitmaps as B

SCHEMA = "occurred_at timestamp_ntz, surface string, tenant_id string, actor_id string, session_id string, day string, bits bigint, kind string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def brute(rows):
    out = {}
    for t, s, n, a, e in rows:
        s = s and s.strip().lower()
        d = t and t.strftime("%Y-%m-%d")
        for use in range(8):
            parts = [v for v, bit in ((d, 4), (s, 2), (n, 1)) if use & bit]
            if None in parts:
                continue
            key = (d if use & 4 else None, s if use & 2 else None, n if use & 1 else None, use)
            x = out.setdefault(key, (set(), set()))
            x[0].update({a} if a else ())
            x[1].update({e} if e else ())
    return {k: (len(a), len(e)) for k, (a, e) in out.items() if a or e}


NAMES = {"day+surface+tenant": 7, "day+surface": 6, "day+tenant": 5, "surface+tenant": 3, "day": 4, "surface": 2, "tenant": 1, "all": 0}


def test_against_sets(spark):
    rnd = random.Random(4)
    pick = lambda *xs: rnd.choice(xs)
    rows = [(pick(None, dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 2, 3)), pick(None, "mcp", " MCP", "http"), pick(None, "t1", "t2"), pick(None, "", "hot", f"a{rnd.randrange(300)}", f"A{rnd.randrange(300)}"), pick(None, "", f"s{rnd.randrange(50)}")) for _ in range(1500)]
    got = {(r["day"], r["surface"], r["tenant_id"], NAMES[r["grouping"]]): (r["n_actors"], r["n_sessions"]) for r in B.cube_counts(B.day_words(frame(spark, rows))).collect()}
    assert got == brute(rows)
    # two runs over parts of the rows, in either order, combine to the same
    first, numbers = B.encode_run(frame(spark, rows[:700]))
    second, both = B.encode_run(frame(spark, rows[600:]), numbers)
    got = {(r["day"], r["surface"], r["tenant_id"], NAMES[r["grouping"]]): (r["n_actors"], r["n_sessions"]) for r in B.cube_counts(B.merged(first.unionByName(second), B.DIMS)).collect()}
    assert got == brute(rows)
    assert both.count() == both.select("id").distinct().count() == both.select("kind", "ident").distinct().count()


def test_days_combine_under_an_extended_dictionary(spark):
    t = dt.datetime(2026, 1, 1)
    one = [(t, "mcp", "t", f"a{i}", None) for i in range(200)]
    two = [(t + dt.timedelta(days=1), "mcp", "t", f"a{i}", None) for i in range(100, 350)]
    old, d1 = B.encode_run(frame(spark, one))
    new, d2 = B.encode_run(frame(spark, two), d1)
    assert B.counted(B.merged(old.unionByName(new), ["surface"]), ["surface"]).first()["n"] == 350
    assert B.counted(B.intersected(B.merged(old, ["surface"]), B.merged(new, ["surface"]), ["surface"]), []).first()["n"] == 100
    assert d2.count() == 350 and d2.select("id").distinct().count() == 350
    again, d3 = B.encode_run(frame(spark, two), d2)
    assert d3.count() == 350 and sorted(again.collect()) == sorted(new.collect())


def test_dense_groups_share_words(spark):
    rows = [(dt.datetime(2026, 1, 1 + i // 640), "mcp", f"t{i // 64 % 10}", None, f"{i * 7919 % 10007}") for i in range(6400)]
    w = B.day_words(frame(spark, rows))
    assert w.count() <= 6400 / 16  # 64 sessions a group, few words each, though names are in no order


def test_empty(spark):
    assert B.cube_counts(B.day_words(frame(spark, []))).count() == 0
    assert B.cube_counts(B.day_words(frame(spark, [(None, None, None, None, "")]))).count() == 0
