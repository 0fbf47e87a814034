import random

from pyspark.sql import functions as F

from rookery.operators import diff as D
from rookery.operators import graph as G
from rookery.operators import identity as I
from rookery.operators.context import capped, lines, prefix_fit
from rookery.operators.quality import match_lists
from rookery.operators.retrieval import path_class

SCHEMA = "root string, unit_id string, kind string, symbol string, path string, module string, language string, imports array<string>, calls array<string>, signature string, start_line int, end_line int, method_arity int, parser_mode string"


def u(uid, symbol, module="m", path="p", calls=(), imports=(), arity=None, kind="function", root="r", **kw):
    return (root, uid, kind, symbol, path, module, "python", list(imports), list(calls), kw.get("signature"), kw.get("line", 1), 9, arity, "full")


def edges(spark, rows, **extra):
    df = spark.createDataFrame(rows, SCHEMA)
    for c, v in extra.items():
        df = df.withColumn(c, v)
    return sorted((r["caller"], r["callee"]) for r in G.call_edges(df).collect())


def test_narrowing_order(spark):
    same = lambda path, module, **kw: u(f"{path}:{module}", f"{module}/f", module, path, **kw)
    caller = u("c", "a.b/g", "a.b", "here", ["f"], ["x.y"])
    assert edges(spark, [caller, same("here", "q"), same("there", "a.b"), same("far", "x.y")]) == [("c", "here:q")]
    assert edges(spark, [caller, same("there", "a.b"), same("far", "x.y")]) == [("c", "there:a.b")]
    assert edges(spark, [caller, same("there", "zz"), same("far", "x.y")]) == [("c", "far:x.y")]
    assert edges(spark, [caller, same("there", "zz"), same("far", "ww")]) == [("c", "far:ww"), ("c", "there:zz")]


def test_a_caller_that_wins_the_narrowing_hides_the_edge(spark):
    assert edges(spark, [u("a", "m/f", calls=["f"]), u("b", "n/f", "n", "q")]) == []


def test_owner_comes_first_and_directories_are_apart(spark):
    rows = [u("c", "m/g", calls=["n.f"]), u("x", "n/f", "n", "q"), u("y", "m/f"), u("z", "n/f", "n", "q", root="other")]
    assert edges(spark, rows) == [("c", "x")]


def test_arity_passes_units_without_one(spark):
    rows = [u("c", "m/g", calls=["f"]), u("x", "n/f", "n", "q", arity=1), u("y", "o/f", "o", "q", arity=2), u("z", "w/f", "w", "q")]
    one = F.when(F.col("unit_id") == "c", F.create_map(F.lit("f"), F.array(F.lit(2))))
    assert edges(spark, rows, call_arity_by_token=one) == [("c", "y"), ("c", "z")]


def test_super_calls_climb_the_chain(spark):
    rows = [u("c", "p.C#g", "p.C", "a", ["super.f"]), u("x", "p.A#f", "p.A", "b"), u("y", "p.Z#f", "p.Z", "b")]
    up = F.when(F.col("module") == "p.C", "p.B").when(F.col("module") == "p.A", "p.C")
    rows.append(u("b", "p.B#h", "p.B", "d"))
    parents = F.when(F.col("module") == "p.C", "p.B").when(F.col("module") == "p.B", "p.A").when(F.col("module") == "p.A", "p.C")
    assert edges(spark, rows, superclass_module=parents) == [("c", "x")]
    assert up is not None


def test_macros_pass_on_what_they_generate(spark):
    rows = [u("c", "m/g", calls=["mac"]), u("mac", "m/mac"), u("mac2", "m/mac2"), u("t", "m/target")]
    gen = F.when(F.col("unit_id") == "mac", F.array(F.lit("mac2"))).when(F.col("unit_id") == "mac2", F.array(F.lit("target"), F.lit("mac"))).otherwise(F.array().cast("array<string>"))
    op = F.when(F.col("unit_id").like("mac%"), "defmacro").otherwise("defn")
    assert ("c", "t") in edges(spark, rows, form_operator=op, generated_calls=gen)


def test_nulls_and_empty(spark):
    assert edges(spark, [("r", "a", None, None, None, None, None, None, None, None, None, None, None, None), u("b", "m/b", None, calls=["", " ", "m/b"])]) == []
    assert edges(spark, []) == []


def versions(spark, base, cur):
    f = lambda rows, seq, sid, nxt: spark.createDataFrame(rows, SCHEMA).withColumns({"seq": F.lit(seq), "snapshot_id": F.lit(sid), "next_snapshot": F.lit(nxt).cast("string")})
    return f(base, 1, "one", "two").unionByName(f(cur, 2, "two", None))


def kinds(spark, base, cur, **kw):
    return sorted((r["change_type"], r["baseline_unit_id"], r["unit_id"]) for r in D.changes(versions(spark, base, cur), **kw).collect())


def test_diff_kinds(spark):
    base = [u("a", "m/a"), u("b", "m/b", signature="x"), u("c", "m/c"), u("d", "m/d", calls=["k"]), u("e", "m/e")]
    cur = [u("a", "m/a"), u("b", "m/b", signature="y"), u("c", "m/c", calls=["z"]), u("d2", "n/d", "n", "q", calls=["k"]), u("f", "m/f", calls=["w"])]
    assert kinds(spark, base, cur) == [("added", None, "f"), ("implementation_changed", "c", "c"), ("meaning_changed", "b", "b"), ("moved_or_renamed", "d", "d2"), ("removed", "e", None)]
    s = D.summary(D.changes(versions(spark, base, cur), include_unchanged=True)).first()
    assert (s["unchanged"], s["total_changes"]) == (1, 6)
    assert kinds(spark, base, cur, paths=["q"]) == [("moved_or_renamed", "d", "d2")]


def test_real_renames_and_slot_leftovers_are_no_moves(spark):
    assert kinds(spark, [u("a", "m/a", calls=["k"])], [u("b", "m/b", calls=["k"])]) == [("added", None, "b"), ("removed", "a", None)]
    assert kinds(spark, [u("a", "m/a"), u("a2", "m/a")], [u("a", "m/a")]) == [("removed", "a2", None)]


def test_rank_pairing_equals_the_greedy_loop(spark):
    rnd = random.Random(5)
    make = lambda n: [u(f"{i}", f"{rnd.choice('mn')}/{rnd.choice('ab')}", rnd.choice("mn"), rnd.choice("pq"), calls=[rnd.choice("xyz")], line=i) for i in range(n)]
    for _ in range(3):
        base, cur = make(12), make(11)
        got = D.summary(D.changes(versions(spark, base, cur), include_unchanged=True)).first()
        assert got["added"] + got["total_changes"] - got["added"] - got["removed"] == len(cur)
        assert got["total_changes"] - got["added"] == len(base)


def test_identity_ignores_order_and_repetition_of_calls(spark):
    rows = I.with_identity(spark.createDataFrame([u("a", "m/a", calls=["x", "y", "y"]), u("b", "m/a", calls=["y", "x", " "]), u("c", "m/a", None)], SCHEMA)).collect()
    assert rows[0]["fingerprint"] == rows[1]["fingerprint"] and rows[0]["semantic_id"] == rows[1]["semantic_id"] == rows[2]["semantic_id"]


def test_source_wins_over_test_folders_below_it(spark):
    x = spark.createDataFrame([("src/x/test/a.py",), ("test/a.py",), ("a/test/b",), ("a/vendor/src/b",), ("src/gen_pb2.py",), ("docs/a",)], "p string")
    assert [r[0] for r in x.select(path_class(F.col("p"))).collect()] == ["source", "test", "test", "vendored", "generated", "other"]


def test_lines_and_caps(spark):
    x = spark.createDataFrame([("a\r\nb\n\n",), ("",), (None,), ("\n\nx",), ("é" * 4 + "\nb",)], "t string")
    assert [r[0] for r in x.select(lines(F.col("t"))).collect()] == [["a", "b"], [], [], ["", "", "x"], ["éééé", "b"]]
    fit = lambda n: [r[0]["n"] for r in x.select(capped(lines(F.col("t")), n)).collect()]
    assert fit(8) == [2, 0, 0, 3, 1] and fit(10) == [2, 0, 0, 3, 2] and fit(7)[4] == 0


def test_prefix_stops_at_the_first_overflow(spark):
    rnd = random.Random(1)
    rows = [(q, i, rnd.randrange(0, 60)) for q in range(20) for i in range(9)]
    df = spark.createDataFrame(rows, "q int, i int, t int")
    got = {q: 0 for q in range(20)} | {r["q"]: r["n"] for r in prefix_fit(df, F.col("t"), F.lit(100), ["q"], ["i"]).groupBy("q").agg(F.count(F.lit(1)).alias("n")).collect()}
    for q in range(20):
        used = n = 0
        for _, _, t in sorted(r for r in rows if r[0] == q):
            if used + t > 100:
                break
            used, n = used + t, n + 1
        assert got[q] == n


def test_expectations_match_in_order():
    a = [{"change_type": "added", "path": "p"}, {"change_type": "removed", "path": "p"}]
    e = [{"change_type": "removed", "path": "p"}, {"change_type": "meaning_changed", "path": "p"}, {"change_type": "added", "path": "q"}]
    assert [o for o, _, _ in match_lists(e, a)] == ["exact", "mismatch", "missing"]
    assert [o for o, _, _ in match_lists([], a)] == ["unexpected", "unexpected"]


def test_graph_reasons_equal_the_step_by_step_rule(spark):
    """The set form against a walk that scores each (unit, code) once, nearest hop first."""
    from rookery.operators import retrieval as R

    rnd = random.Random(9)
    ids = [f"u{i}" for i in range(14)]
    path, module = {i: rnd.choice("pqrs") for i in ids}, {i: rnd.choice(["m", "n", None]) for i in ids}
    links = {(rnd.choice(ids), rnd.choice(ids)) for _ in range(22)}
    links = {(a, b) for a, b in links if a != b}
    seen_by = {"q1": (2, False, set(ids)), "q2": (3, True, set(ids[:10]))}
    first = {"q1": {"u0", "u3"}, "q2": {"u1"}}
    units = spark.createDataFrame([("r", u, "function", path[u], module[u], "a" if u in ids[:10] else "b") for u in ids], "root string, unit_id string, kind string, path string, module string, language string")
    none = spark.createDataFrame([], "root string, module string, test_path string")
    e = spark.createDataFrame([("r", a, b) for a, b in links], "root string, caller string, callee string")
    for q, (depth, definitions, vis) in seen_by.items():
        asked = spark.createDataFrame([(q, "r", definitions, False, [], ["A"] if len(vis) == 10 else [], [])], "query_id string, root string, definitions boolean, include_tests boolean, prefixes array<string>, languages array<string>, tests array<string>")
        f = spark.createDataFrame([(q, "r", u) for u in first[q]], "query_id string, root string, unit_id string")
        got = {(r["unit_id"], r["code"]): r["points"] for r in R.graph_reasons(units, asked, e, none, f, depth).groupBy("unit_id", "code").agg(F.max("points").alias("points")).collect()}
        want, frontier, visited = {}, set(first[q]), set(first[q])
        for d in range(depth):
            grown = set()
            for u in frontier & vis:
                near = {
                    "graph_callee_neighbor": {b for a, b in links if a == u},
                    "graph_caller_neighbor": {a for a, b in links if b == u},
                    "graph_module_neighbor": {x for x in ids if module[u] and module[x] == module[u]},
                    "graph_path_neighbor": {x for x in ids if path[x] == path[u]},
                }
                for code, xs in near.items():
                    points = max(0, R.POINTS[code][1] - 10 * d - (8 if definitions and "caller" in code else 0))
                    for x in (xs & vis) - {u}:
                        if points:
                            want.setdefault((x, code), points)
                        if code in ("graph_callee_neighbor", "graph_caller_neighbor") and x not in visited:
                            grown.add(x)
            visited |= grown
            frontier = grown
        assert got == want
