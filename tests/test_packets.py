import random

from rookery.operators import packets as P
from rookery.operators import quality as Q

LISTS = "must_paths no_paths must_reasons must_warnings must_degradations must_risks must_units postures statuses review_postures paths reasons warnings degradations risks top_units steps".split()
TEXTS = "level least_level posture raw_ceiling confidence_level autonomy_posture result_status raw_level".split()
BANDS = "array<struct<unit_id:string,rank_band:string>>"


def failed(spark, **kw):
    ddl = "fixture_id int, review boolean, " + ", ".join([f"{c} array<string>" for c in LISTS] + [f"{c} string" for c in TEXTS] + [f"{c} {BANDS}" for c in ("bands", "ranked")])
    row = tuple(kw.get(p.split()[0]) if p.split()[0] != "fixture_id" else 1 for p in ddl.replace("struct<unit_id:string,rank_band:string>", "s").split(", "))
    return P.fixture_failures(spark.createDataFrame([row], ddl)).first()["failed"]


def test_fixture_checks_in_order(spark):
    assert failed(spark) is None
    assert failed(spark, must_paths=["a"], paths=["b"], no_paths=["b"]) == "missing required paths"
    assert failed(spark, must_paths=["a"], paths=["a", "b"], no_paths=["b"]) == "found excluded paths"
    assert failed(spark, must_units=["app.x/f"], top_units=["src/x.clj::app.x/f"]) is None
    assert failed(spark, must_units=["lib/y.clj::x/f"], top_units=["src/x.clj::app.x/f"]) is None
    assert failed(spark, must_units=["g"], top_units=["src/x.clj::app.x/f"]) == "missing top authority units"
    assert failed(spark, bands=[("f", "top")], ranked=[("a/f", "top")]) is None and failed(spark, bands=[("f", "top")], ranked=[("a/g", "top")]) == "rank band expectation mismatch"
    assert failed(spark, least_level="medium", confidence_level="low") == "confidence too low" and failed(spark, least_level="medium", confidence_level="high") is None
    assert failed(spark, level="high", confidence_level=None) == "confidence mismatch"
    assert failed(spark, raw_ceiling="target_span", raw_level="whole_file") == "raw fetch level exceeded" and failed(spark, raw_ceiling="target_span") is None
    assert failed(spark, review=True, autonomy_posture="plan_safe") == "review-required fixture must be blocked"
    assert failed(spark, review_postures=["plan_safe"], autonomy_posture="plan_safe", steps=["x"]) == "expected human_review_required"
    assert failed(spark, statuses=["completed"], result_status="truncated") == "result status not allowed"


def test_matching_equals_the_plain_greedy_search():
    rnd = random.Random(2)
    change = lambda: {"change_type": rnd.choice("am"), **{f: rnd.choice(["x", "y", None]) for f in Q.FIELDS}}
    for _ in range(200):
        expected, actual = [change() for _ in range(rnd.randrange(7))], [change() for _ in range(rnd.randrange(7))]
        left, want = list(range(len(actual))), []
        for e in expected:
            same = [i for i in left if all(actual[i][f] == e[f] for f in Q.FIELDS if e[f] is not None)]
            exact = [i for i in same if actual[i]["change_type"] == e["change_type"]]
            supplied = any(e[f] is not None for f in Q.FIELDS)
            hit = exact[:1] or (same[:1] if supplied else [])
            want.append("exact" if exact else "mismatch" if hit else "missing")
            left = [i for i in left if i not in hit]
        assert [o for o, _, _ in Q.match_lists(expected, actual)] == want + ["unexpected"] * len(left)


def test_gate(spark):
    m = spark.createDataFrame([(0.96, None, 0.5, 0.05)], "match_rate double, move_rate double, kind_rate double, unmatched_rate double")
    got = {r["metric"]: (r["applicable"], r["passed"]) for r in Q.gate(m).collect()}
    assert got == {"match_rate": (True, True), "move_rate": (False, True), "kind_rate": (True, False), "unmatched_rate": (True, True)}
    assert not Q.eligible(Q.gate(m)) and Q.eligible(Q.gate(m, {"kind_rate": 0.5}))
