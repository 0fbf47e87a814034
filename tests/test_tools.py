"""Recording, outlines and the tool edge over one small tree."""

import json

import pytest

from rookery import errors, mcp
from rookery.api import Workspace
from rookery.operators.outline import tree_lines
from rookery.sources.sink import MemorySink


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("code")
    for path, text in {
        "src/app/main.clj": "(ns app.main\n  (:require [app.util :as u]))\n\n(defrecord Cart [items])\n(s/def ::total int?)\n(def app (ring-handler routes))\n\n(defn -main [& args]\n  (u/go args))\n",
        "src/app/util.clj": "(ns app.util)\n\n(defn go [x] x)\n",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root


@pytest.fixture(scope="module")
def workspace(spark, tree, tmp_path_factory):
    w = Workspace(spark, str(tmp_path_factory.mktemp("kept")), usage=MemorySink(), context={"surface": "mcp", "tenant_id": "t"})
    w.create_index(str(tree), "one")
    return w


def test_operations_are_recorded(workspace, tree):
    kept = workspace.usage.events
    before = len(kept)
    s = workspace.resolve_context(str(tree), {"targets": {"symbols": ["app.util/go"]}, "trace": {"trace_id": "x", "actor_id": "a"}})
    workspace.expand_context(s["selection_id"])
    with pytest.raises(errors.SelectionNotFound):
        workspace.expand_context("nope")
    workspace.repo_map(str(tree), suppress_usage=True)
    got = kept[before:]
    assert [(e["operation"], e["status"]) for e in got] == [("resolve_context", "success"), ("expand_context", "success"), ("expand_context", "error")]
    assert (got[0]["surface"], got[0]["tenant_id"], got[0]["trace_id"], got[0]["result_status"]) == ("mcp", "t", "x", "completed") and got[0]["selected_units_count"] >= 1
    assert got[0]["root_path_hash"] == got[1]["root_path_hash"] == kept[0]["root_path_hash"] and len(kept[0]["root_path_hash"]) == 64
    assert kept[0]["unit_count"] == workspace.summary(str(tree))["n_units"] and json.loads(got[2]["payload"])["code"] == "selection_not_found"
    assert workspace.record_feedback({"feedback_outcome": "helpful"}, str(tree)) and workspace.usage.feedback[0]["surface"] == "mcp"
    workspace.usage.record_event = lambda e: 1 / 0
    assert workspace.repo_map(str(tree)).count() == 1
    del workspace.usage.record_event


def test_outline_and_drift(workspace, tree, tmp_path):
    out = workspace.outline(str(tree))
    assert out["entry_points"] == ["app.main/-main", "app.main/app"] and {(d["name"], d["kind"]) for d in out["domain_model"]} == {("Cart", "record"), ("::total", "spec")}
    assert '"app.main" -> "app.util";' in out["dependency_graph_dot"] and "- app.main -> app.util" in out["summary_markdown"]
    assert workspace.outline_drift(str(tree), str(tmp_path))["stale"]
    assert workspace.outline(str(tree), str(tmp_path))["changed"] and not workspace.outline_drift(str(tree), str(tmp_path))["stale"]
    assert workspace.outline(str(tree), str(tmp_path), changed_only=True)["status"] == "unchanged"
    (tmp_path / "code-context.md").write_text("other")
    assert workspace.outline_drift(str(tree), str(tmp_path))["stale"]
    assert tree_lines("/x/proj", ["a/b/c/d.py", "a/e.py", "f.py"]) == ["proj", "├ a", "│ ├ b", "│ │ └ c", "│ └ e.py", "└ f.py"]


def test_only_changed_paths_are_read(workspace, tree):
    (tree / "src/app/util.clj").write_text("(ns app.util)\n\n(defn go [x] x)\n\n(defn stop [] 1)\n")
    (tree / "src/app/main.clj").write_text("(ns app.main)\n")  # changed on disk, but not named
    workspace.update_index(str(tree), ["src/app/util.clj", "src/app/gone.clj"], "two")
    symbols = {r["symbol"] for r in workspace.query_units(str(tree)).collect()}
    assert {"app.util/stop", "app.main/-main"} <= symbols
    assert "ring-handler" in workspace.literal_file_slice(str(tree), "src/app/main.clj", 6, 6)["content"]


def test_tool_edge(workspace, tree):
    now = [0.0]
    s, got = mcp.Server(workspace, lambda: now[0]), []
    call = lambda name, **a: {"id": 7, "method": "tools/call", "params": {"name": name, "arguments": a}}
    messages = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, call("resolve_context", root_path=str(tree), intent="where is go used"), call("repo_map"), call("nope"), {"id": 3, "method": "what"}]
    s.serve([*map(json.dumps, messages), "no json", ""], lambda t: got.append(json.loads(t)))
    assert len(got) == 7 and got[0]["result"]["serverInfo"]["name"] == "rookery" and len(got[1]["result"]["tools"]) == 10
    answer = json.loads(got[2]["result"]["content"][0]["text"])
    assert answer["query_ingress_mode"] == "mcp_shorthand" and any("go" in f for f in answer["focus"]) and str(tree) in s.open
    assert got[3]["result"]["isError"] and "root_path is missing" in got[3]["result"]["content"][0]["text"] and got[4]["result"]["isError"]
    assert got[5]["error"]["code"] == -32601 and got[6]["error"]["code"] == -32700
    bad = s.answer(call("resolve_context", root_path=str(tree), query={"unheard": 1, "intent": "x"}))
    assert json.loads(bad["result"]["content"][0]["text"])["guidance"]["unknown_sections"] == ["unheard"]
    for i in range(mcp.KEPT + 2):
        s._touch(f"/r{i}", "x")
    assert len(s.open) == mcp.KEPT and "/r0" not in s.open
    now[0] = mcp.TTL + 1.0
    assert s.answer({"id": 9, "method": "ping"})["error"]["message"] == "session expired"


def test_query_shorthand(spark):
    q, mode = mcp.normalized_query(spark, {"intent": "see app.orders/total", "hints": {"preferred_paths": ["src/x.py"], "prefer_breadth_over_depth": False}})
    assert mode == "mcp_shorthand" and q["hints"]["preferred_paths"][0] == "src/x.py" and "app.orders/total" in q["hints"]["suspected_symbols"] and not q["hints"]["prefer_breadth_over_depth"]
    assert q["constraints"]["token_budget"] == 3200 and q["targets"] == {"diff_summary": "see app.orders/total"} and q["trace"]["request_id"].startswith("mcp-shorthand-")
    q, _ = mcp.normalized_query(spark, {"intent": {"purpose": "edit_preparation"}, "targets": {"paths": ["a"]}})
    assert q["constraints"]["token_budget"] == 1600 and q["targets"] == {"paths": ["a"]} and mcp.normalized_query(spark, {"intent": {"purpose": "x"}, "constraints": {"token_budget": 5}})[0]["constraints"]["token_budget"] == 5
    whole = {"schema_version": "1.0", **{k: {} for k in mcp.SECTIONS}}
    assert mcp.normalized_query(spark, whole) == (whole, "canonical")
    with pytest.raises(errors.InvalidQuery):
        mcp.normalized_query(spark, {"targets": {}})
    assert mcp.wrong_arguments("literal_file_slice", {"root_path": "/r", "path": "p", "start_line": "1", "end_line": True, "x": 1}) == ["x is unknown", "start_line has to be of type integer", "end_line has to be of type integer"]


def test_command_line(spark, tree, tables, tmp_path, capsys):
    from rookery.edge import main

    store, out = str(tmp_path / "store"), str(tmp_path / "out")
    run = lambda *args: (main(list(args), spark), capsys.readouterr().out)
    code, text = run("resolve", store, str(tree), "where is go used")
    assert code == 0 and json.loads(text)["focus"]
    assert run("outline", store, str(tree), out, "check")[0] == 1 and run("outline", store, str(tree), out)[0] == 0 and run("outline", store, str(tree), out, "check")[0] == 0
    code, text = run("contracts", tables)
    assert code == int(bool(json.loads(text)))
    (tmp_path / "f.json").write_text(json.dumps([{"fixture_id": "a", "must_paths": ["x"], "paths": ["x"]}, {"fixture_id": "b", "least_level": "high", "confidence_level": "low"}]))
    code, text = run("fixtures", str(tmp_path / "f.json"))
    assert code == 1 and {r["fixture_id"]: r["failed"] for r in json.loads(text)} == {"a": None, "b": "confidence too low"}
    assert run("what")[0] == 2


def test_changed_files_as_a_stream(spark, tmp_path):
    from rookery.streaming.rollup import index_stream

    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.py").write_text("def one():\n    return 1\n")
    (root / "b.py").write_text("def two():\n    return 2\n")
    w = Workspace(spark, str(tmp_path / "kept"))
    w.create_index(str(root), "first")
    (root / "a.py").write_text("def uno():\n    return 1\n")
    (root / "b.py").write_text("def due():\n    return 2\n")
    src = str(tmp_path / "changes")
    spark.createDataFrame([(str(root), "a.py"), (None, "x"), (str(root), None)], "root string, path string").write.parquet(src)
    stream = spark.readStream.schema("root string, path string").parquet(src)
    index_stream(w, stream, str(tmp_path / "cp")).awaitTermination()
    assert {r["symbol"] for r in w.query_units(str(root)).collect()} == {"a/uno", "b/two"} and w.store.latest(str(root)) == "batch-000000000"
