import datetime as dt

from pyspark.sql import functions as F

from rookery.operators import usage as U

T0 = dt.datetime(2026, 1, 1)
EV = "id bigint, event_id string, occurred_at timestamp_ntz, surface string, operation string, status string, trace_id string, request_id string, session_id string, task_id string, confidence_level string, result_status string, latency_ms bigint, cache_hit boolean, payload string"
FB = "id bigint, feedback_id string, occurred_at timestamp_ntz, surface string, operation string, trace_id string, request_id string, session_id string, task_id string, feedback_outcome string, confidence_level string, retrieval_issue_codes array<string>, ground_truth_unit_ids array<string>, ground_truth_paths array<string>"


def events(spark, rows):
    return U.normalized_events(spark.createDataFrame(rows, EV))


def test_percentile_is_nearest_rank_of_n_minus_1(spark):
    for n in (1, 2, 3, 19, 20, 21, 100):
        rows = [(i, str(i), T0, "mcp", "x", None, None, None, None, None, None, None, i, None, None) for i in range(n)] + [(n, "z", T0, "mcp", "x", None, None, None, None, None, None, None, None, None, "{bad")]
        r = U.latency_summary(events(spark, rows), ["surface"]).first()
        want = sorted(range(n))[-(-95 * (n - 1) // 100)]
        assert (r["n"], r["p95_ms"], r["max_ms"]) == (n, want, n - 1)


def test_empty_groups_are_zero(spark):
    r = U.slo(events(spark, [(1, "a", T0, None, None, None, None, None, None, None, None, None, None, None, None)]), ["surface", "operation"]).first()
    assert (r["surface"], r["operation"], r["cache_hit_ratio"], r["degraded_rate"]) == ("library", "unknown", 0.0, 0.0)
    assert U.slo(events(spark, []), ["surface"]).count() == 0


def test_keys_of_two_kinds_never_meet(spark):
    e = events(spark, [(1, "a", T0, "mcp", "resolve_context", None, "t", "r", "s", "k", "high", None, 1, None, '{"query": "q"}'), (2, "b", T0, "mcp", "resolve_context", None, "t", "", "s", "k", "low", None, 1, None, None), (3, "c", T0, "mcp", "resolve_context", None, None, None, None, None, None, None, 1, None, None)])
    f = U.normalized_feedback(spark.createDataFrame([(1, "x", T0, None, None, None, None, "s", "k", "helpful", None, ["a", "a", " ", None], None, []), (2, "y", T0, None, None, "t", "r", None, None, "abandoned", "high", None, ["u"], None)], FB))
    got = {r["id"]: r["observed"] for r in U.correlated(e, f).select("id", "observed").collect()}
    assert got == {1: 0.0, 2: 1.0, 3: None}
    assert f.where("id = 1").first()["retrieval_issue_codes"] == ["a"]
    cal = {r["level"]: (r["n"], round(r["mae"], 6)) for r in U.calibration(e, f).collect()}
    assert cal == {"high": (1, 0.9), "low": (1, 0.65), "all": (2, 0.775)}


def test_scores_never_fall_below_minus_one(spark):
    f = U.normalized_feedback(spark.createDataFrame([(1, "x", T0, None, None, None, None, None, None, "abandoned", "low", ["missing_authority", "wrong_scope", "too_broad", "unheard"], None, None)], FB))
    assert {r["group"]: r["mean_score"] for r in U.evaluated_feedback(f).collect()} == {"outcome=abandoned": -1.0, "level=low": -1.0, "all": -1.0}


def test_once_keeps_the_first_delivery_and_rows_without_key(spark):
    x = spark.createDataFrame([(2, "a"), (1, "a"), (3, None), (4, None)], "id bigint, k string")
    assert sorted(r["id"] for r in U.once(x, "k").collect()) == [1, 3, 4]


def test_since_is_inclusive(spark):
    x = spark.createDataFrame([(1, T0), (2, T0 - dt.timedelta(microseconds=1)), (3, None)], "id bigint, occurred_at timestamp_ntz")
    assert [r["id"] for r in U.filtered(x, since="2026-01-01 00:00:00").collect()] == [1]
    assert U.filtered(x.withColumn("surface", F.lit("mcp")), surface="http").count() == 0


def test_policy_versions_and_ingress_modes(spark):
    from rookery.operators import usage as U

    rows = [("mcp", '{"policy_id": "p", "policy_version": "2", "query_ingress_mode": "partial"}'), ("mcp", '{"policy_id": "p", "policy_version": "2"}'), ("mcp", '{"policy_id": "p"}'), ("http", '{"policy_id": "q", "policy_version": "", "query_ingress_mode": "partial"}'), (" MCP", '{"query_ingress_mode": "shorthand"}'), ("mcp", None)]
    e = U.normalized_events(spark.createDataFrame([(s, "resolve_context", "success", p) for s, p in rows], "surface string, operation string, status string, payload string"))
    assert [tuple(r) for r in U.policy_versions(e).collect()] == [("p@2", 2)]
    assert sorted(tuple(r) for r in U.policy_versions(e, "none").collect()) == [("p@2", 2), ("p@none", 1), ("q@none", 1)]
    assert sorted(tuple(r) for r in U.ingress_modes(e).collect()) == [("partial", 1), ("shorthand", 1)]
