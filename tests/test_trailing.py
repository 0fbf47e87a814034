import datetime as dt
import random

from pyspark.sql import functions as F

from rookery.operators import trailing as T

DAY0 = dt.date(1970, 1, 1)
SCHEMA = "id bigint, event_id string, occurred_at timestamp_ntz, surface string, operation string, latency_ms bigint, extra string, day string"


def brute(rows, last, windows):
    """rows: (entity, day, value)."""
    out = {}
    for e in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == e]
        for d in range(min(r[1] for r in own), last + 1):
            for w in windows:
                hit = [r[2] for r in own if d - w < r[1] <= d]
                m = [v for v in hit if v is not None]
                out[e, d, w] = (len(hit), len(m), sum(m))
    return out


def as_dict(df, windows):
    return {(r["e"], r["day"], w): (r[f"events_{w}"], r[f"measured_{w}"], int(r[f"total_{w}"])) for r in df.collect() for w in windows}


def leaves(spark, rows):
    df = spark.createDataFrame(rows, "e string, day int, value bigint")
    return T.daily_leaves(df, ["e"])


def test_against_brute_force(spark):
    rnd = random.Random(7)
    for windows, bits in (((1, 7, 30), 6), ((5, 64, 100), 4), ((128,), 7)):
        rows = [(rnd.choice("abc"), rnd.randrange(-70, 200), rnd.choice([None, 0, 5, 10**12])) for _ in range(300)]
        tree = T.build_tree(leaves(spark, rows), ["e"], bits)
        got = as_dict(T.trailing(tree, ["e"], F.lit(210), windows, bits), windows)
        assert got == brute(rows, 210, windows)


def test_windows_longer_than_a_shard(spark):
    rows = [("a", d, 1) for d in range(0, 300, 7)]
    tree = T.build_tree(leaves(spark, rows), ["e"], 4)
    assert as_dict(T.trailing(tree, ["e"], F.lit(310), (100,), 4), (100,)) == brute(rows, 310, (100,))


def test_late_rows_touch_ancestors_only(spark, tmp_path):
    old = [("a", 3, 5), ("a", 200, 1), ("b", 9, None)]
    late = [("a", 4, 7), ("c", 5, 2)]
    tree = T.build_tree(leaves(spark, old), ["e"])
    fixed = T.corrected(tree, leaves(spark, late), ["e"])
    key = lambda df: sorted(tuple(r) for r in df.select("e", "shard", "level", "node", *T.SUMS).collect())
    assert key(fixed) == key(T.build_tree(leaves(spark, old + late), ["e"]))
    changed = set(key(fixed)) - set(key(tree))
    assert len(changed) == 2 * (T.SHARD_BITS + 1)
    path = str(tmp_path / "tree")
    tree.write.partitionBy("shard").parquet(path)
    T.append_corrections(leaves(spark, late), path, ["e"])
    assert key(T.stored_tree(spark.read.parquet(path), ["e"])) == key(fixed)


def test_events_nulls_repeats_and_clashing_columns(spark):
    t = dt.datetime(2026, 1, 5, 23, 59, 59)
    rows = [
        (1, "x", t, " MCP", "Op", 5, "z", "z"),
        (2, "x", t, "mcp", "op ", 5, "z", "z"),  # delivered again
        (3, None, t, "mcp", "op", -1, None, None),
        (4, None, t, "mcp", "op", None, None, None),
        (5, "y", None, "mcp", "op", 1, None, None),  # no day
        (6, "w", t, None, "op", 2, None, None),
    ]
    ev = T.distinct_events(spark.createDataFrame(rows, SCHEMA))
    got = {(r["surface"], r["operation"]): (r["events"], r["measured"], int(r["total"])) for r in T.daily_leaves(ev, ["surface", "operation"]).collect()}
    assert got == {("mcp", "op"): (3, 1, 5), (None, "op"): (1, 1, 2)}


def test_empty(spark):
    ev = T.distinct_events(spark.createDataFrame([], SCHEMA))
    tree = T.build_tree(T.daily_leaves(ev, ["surface", "operation"]), ["surface", "operation"])
    assert T.trailing(tree, ["surface", "operation"], F.lit(None).cast("int")).count() == 0
