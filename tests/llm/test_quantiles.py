import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rookery.llm import quantiles as K

PROBS = [0.001, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 0.999]


def error(values, sketch, probs=PROBS):
    """Greatest distance of an answer's rank interval from the asked rank, as a share of n."""
    s = np.sort(values)
    worst = 0.0
    for p, v in zip(probs, sketch.quantiles(probs)):
        lo, hi = np.searchsorted(s, v, "left"), np.searchsorted(s, v, "right")
        worst = max(worst, max(lo - p * len(s), p * len(s) - hi, 0) / len(s))
    return worst


def stream(values, k, seed, step=997):
    x = K.CompactorSketch(k, seed)
    for i in range(0, len(values), step):
        x.update(values[i : i + step])
    return x


@pytest.mark.parametrize("k", [128, 512, 1024])
def test_error_stays_below_the_bound(k):
    rng, over = np.random.default_rng(k), 0
    for seed in range(12):
        v = (rng.lognormal(5, 2, 150_000)).astype(np.int64)
        sketch = stream(v, k, seed)
        over += sum(error(v, sketch, [p]) > K.rank_error(k) for p in PROBS)
    assert over <= 2  # of 108


def test_merged_partials_keep_the_bound():
    rng = np.random.default_rng(1)
    v = np.r_[rng.integers(0, 10**6, 200_000), np.full(100_000, 42), [2**62]].astype(np.int64)
    rng.shuffle(v)
    parts = [K.CompactorSketch.from_bytes(stream(p, 1024, i).to_bytes()) for i, p in enumerate(np.array_split(v, 97))]
    while len(parts) > 1:
        a, b = parts.pop(0), parts.pop(0)
        a.merge(b)
        parts.append(a)
    (x,) = parts
    assert x.n == len(v) and x.low == v.min() and x.high == v.max()
    assert sum(len(p) << i for i, ps in enumerate(x.levels) for p in ps) == x.n
    assert error(v, x) <= K.rank_error(1024)
    assert x.held() < 8 * 1024


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=300))
def test_small_groups_are_exact(values):
    v = np.array(values, dtype=np.int64)
    s, ordered = stream(v, 1024, 0, 7), sorted(values)
    for p in (0, 0.1, 0.5, 0.99, 1):
        assert s.quantiles([p])[0] == ordered[max(0, int(np.ceil(p * len(v) - 1e-9)) - 1)]


def test_bytes_are_checked():
    with pytest.raises(ValueError):
        K.CompactorSketch.from_bytes(b"xxxx")


SCHEMA = "id bigint, event_id string, occurred_at timestamp_ntz, surface string, operation string, latency_ms bigint, n int, p string, sketch string, part string"


def test_rows(spark):
    t = dt.datetime(2026, 1, 1, 5)
    rows = [(i, f"e{i}", t, "MCP ", "op", i, 0, "", "", "") for i in range(50)] + [(99, "e7", t, "mcp", "op", 7, 0, "", "", "")]
    rows += [(100, "x", t, "mcp", "op", None, 0, "", "", ""), (101, "y", t, "mcp", "op", -5, 0, "", "", ""), (102, None, None, None, "op", 3, 0, "", "", ""), (103, "z", t, "mcp", "silent", None, 0, "", "", "")]
    random.Random(2).shuffle(rows)
    ev = spark.createDataFrame(rows, SCHEMA)
    got = {(r["surface"], r["operation"], r["day"], r["p"]): (r["n"], r["value"]) for r in K.percentiles(K.with_all_days(K.day_sketches(ev)), K.KEYS).collect()}
    assert got["mcp", "op", "2026-01-01", 0.5] == (50, 24) and got["mcp", "op", "all", 0.99] == (50, 49)
    assert got[None, "op", None, 0.5] == (1, 3) and not any(k[1] == "silent" for k in got)
    assert K.percentiles(K.with_all_days(K.day_sketches(ev.limit(0))), K.KEYS).count() == 0


def test_tree_merge_and_early_hand_over(spark, monkeypatch):
    df = spark.range(40_000).selectExpr("id % 3 as g", "id % 1000 as v").repartition(7)
    part = K.partial_sketches(df, ["g"], "v")
    one, tree = (K.merge_sketches(part, ["g"], fan=f) for f in (1, 3))
    for x in (one, tree):
        got = {(r["g"], r["p"]): r["value"] for r in K.percentiles(x, ["g"], (0.5,)).collect()}
        assert all(abs(v - 500) < 1000 * 2 * K.rank_error() + 3 for v in got.values()) and len(got) == 3


def test_bounds_where_days_compact_too(spark):
    """With k = 32 days of sf0.01 are compacted too; the stated bound for that k holds, and the error is not zero."""
    import os

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    got = K.percentile_check(spark, d, 32).collect()
    assert sum(r["n"] > 32 for r in got) > 300 and all(r["within"] for r in got)
    exact = {tuple(r)[:3] + (r["p"],): r["value"] for r in K.latency_percentiles(spark, d).collect()}
    rough = {tuple(r)[:3] + (r["p"],): r["value"] for r in K.latency_percentiles(spark, d, 32).collect()}
    assert exact.keys() == rough.keys() and exact != rough


def test_coins_differ_between_hand_overs():
    assert len({K._seed(("a",), 1, turn) for turn in range(50)}) == 50
    assert K.rank_error(1024) < 0.0052 and 0.008 < K.rank_error(1024, 100_000) < 0.0095
