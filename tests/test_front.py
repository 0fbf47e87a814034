import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from rookery import errors
from rookery.api import KEPT, Workspace, checked_query
from rookery.edge import answer
from rookery.plans import catalog
from rookery.sources.store import read_json, retained, write_json
from rookery.streaming import rollup


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for path, text in {
        "src/shop/cart.py": "from shop.price import quote\n\ndef add_item(cart, item):\n    return quote(item)\n\ndef clear(cart):\n    return []\n",
        "src/shop/price.py": "def quote(item):\n    return item\n",
        "node_modules/x/a.py": "def hidden():\n    pass\n",
        "README.md": "no source",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root


@pytest.fixture(scope="module")
def workspace(spark, repo, tmp_path_factory):
    w = Workspace(spark, str(tmp_path_factory.mktemp("store")))
    w.create_index(str(repo), "first")
    return w


def test_index_and_staged_query(workspace, repo):
    root = str(repo)
    assert workspace.summary(root)["n_files"] == 2 and workspace.summary(root)["n_units"] == 3
    s = workspace.resolve_context(root, {"targets": {"symbols": ["src.shop.price/quote"]}})
    assert s["result_status"] == "completed" and s["focus"][0].endswith("price.py::src.shop.price/quote")
    x = workspace.expand_context(s["selection_id"])
    assert any("add_item" in v for v in x["impact_hints"]["callers"])
    d = workspace.fetch_context_detail(s["selection_id"], level="whole_file")
    assert d["raw_context"][0]["content"].startswith("def quote")
    assert workspace.query_callers(root, s["focus"][0]).count() == 1
    assert workspace.skeletons(root).count() == 3


def test_free_text_query(workspace, repo):
    s = workspace.resolve_context(str(repo), "where is add_item used")
    assert any("add_item" in f for f in s["focus"])


def test_update_and_diff(workspace, repo, spark):
    root = str(repo)
    (repo / "src/shop/price.py").write_text("def quote(item, tax):\n    return item\n\ndef fresh():\n    return 2\n")
    workspace.update_index(root, ["src/shop/price.py"], "second")
    got = sorted((r["change_type"], (r["unit_id"] or r["baseline_unit_id"]).split("/")[-1]) for r in workspace.snapshot_diff(root).collect())
    assert got == [("added", "fresh"), ("meaning_changed", "quote")]
    assert workspace.literal_file_slice(root, "src/shop/price.py", 1, 1)["content"] == "def quote(item, tax):"
    assert workspace.literal_file_slice(root, "src/shop/price.py", 1, 1, "first")["content"] == "def quote(item):"
    workspace.update_index(root, [], "third")
    assert workspace.snapshot_diff(root).count() == 0


def test_errors(workspace, repo, spark, tmp_path):
    root = str(repo)
    for bad in ({"api_version": "2.0"}, {"unheard": 1}, {"intent": {"purpose": "x"}}, {"constraints": {"token_budget": 0}}, {"constraints": {"max_raw_code_level": "x"}}):
        with pytest.raises(errors.InvalidRequest):
            checked_query(bad)
    for bad in ({"targets": {"symbols": ["x"] * 21}}, {"targets": {"paths": "a"}}, {"targets": {"paths": [""]}}, {"hints": {"preferred_paths": ["x" * 241]}}, {"intent": {"details": "x" * 2001}}, {"constraints": {"freshness": "old"}}, {"options": {"include_tests": "yes"}}):
        with pytest.raises(errors.InvalidQuery):
            checked_query(bad)
    closed = Workspace(spark, str(tmp_path / "closed"), language_policy={"disable": ["python"]})
    with pytest.raises(errors.NotActive):
        closed.resolve_context(root, {"targets": {"paths": ["src/shop/cart.py"]}})
    with pytest.raises(errors.SnapshotMismatch):
        workspace.resolve_context(root, {"constraints": {"snapshot_id": "nope"}})
    with pytest.raises(errors.IndexNotFound):
        workspace.resolve_context("/nowhere", {})
    with pytest.raises(errors.SelectionNotFound):
        workspace.expand_context("nope")
    with pytest.raises(errors.InvalidRequest):
        workspace.literal_file_slice(root, "../x", 1, 2)
    with pytest.raises(errors.Forbidden):
        Workspace(spark, str(tmp_path), allowed_roots=["/only"]).create_index("/onlyx")
    w = Workspace(spark, str(tmp_path))
    for i in range(KEPT + 1):
        w._keep(str(i), {"snapshot_id": "s"})
    with pytest.raises(errors.SelectionEvicted):
        w.selection("0")
    assert w.selection("1")["snapshot_id"] == "s"


def test_edge(workspace, repo):
    assert answer(workspace, "/health", {})[0] == 200
    assert answer(workspace, "/nope", {})[0] == 404
    assert answer(workspace, "/v1/context/expand", {"selection_id": "nope"}) == (404, {"code": "selection_not_found", "category": "not_found", "message": "nope"})
    assert answer(workspace, "/v1/context/resolve", {})[0] == 400
    status, out = answer(workspace, "/v1/context/resolve", {"root": str(repo), "query": {"targets": {"paths": ["src/shop/cart.py"]}}})
    assert status == 200 and out["focus"]


def test_artifacts(spark, tmp_path):
    p = str(tmp_path / "a" / "x.json")
    write_json(p, {"b": [1, 2], "a": None})
    assert read_json(spark, p).first()["b"] == [1, 2]
    runs = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z"), ("c", 0, None)], "run_id string, at int, v string")
    assert [(r["run_id"], r["v"]) for r in retained(runs, "run_id", "at", 2).collect()] == [("a", "y"), ("b", "z")]


def test_streams_equal_the_batch(spark, tables, tmp_path):
    """Several batches; ids delivered again in later ones count once where that is asked for."""
    from rookery.operators import trailing, usage
    from rookery.sources.tables import table

    ev, fb = table(spark, tables, "semantic_usage_events"), table(spark, tables, "semantic_usage_feedback")
    src = {n: str(tmp_path / n) for n in ("ev", "fb")}
    ev.repartition(3).write.parquet(src["ev"])
    ev.limit(40).withColumn("id", F.col("id") + 10_000_000).write.mode("append").parquet(src["ev"])
    fb.repartition(2).write.parquet(src["fb"])
    read = lambda n, df: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src[n])
    key = lambda df: sorted(tuple(r) for r in df.select("metric_date", "surface", "operation", *rollup.COUNTERS).collect())
    for dedupe in (False, True):
        out = str(tmp_path / f"out-{dedupe}")
        for q in rollup.rollup_stream(read("ev", ev), read("fb", fb), out, str(tmp_path / f"cp-{dedupe}"), dedupe=dedupe):
            q.awaitTermination()
        e, f = (spark.read.parquet(src[n]) for n in ("ev", "fb"))
        if dedupe:
            e, f = usage.once(e, "event_id"), usage.once(f, "feedback_id")
        assert key(rollup.rolled_up(spark, out)) == key(usage.daily_rollup(usage.normalized_events(e), usage.normalized_feedback(f)))
    assert len(os.listdir(tmp_path / "out-True" / "events")) >= 3
    rollup.tree_stream(read("ev", ev), str(tmp_path / "tree"), str(tmp_path / "cp2")).awaitTermination()
    tree = trailing.stored_tree(spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "tree")), ["surface", "operation"])
    rows = lambda df: sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    assert rows(tree) == rows(trailing.event_tree(spark, tables).select(*tree.columns))


def test_correlated_stream(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    cols = "id bigint, occurred_at timestamp_ntz, trace_id string, request_id string, session_id string, task_id string, feedback_outcome string"
    e, f = str(tmp_path / "e"), str(tmp_path / "f")
    spark.createDataFrame([(1, t, "a", "b", None, None, None), (2, t, None, None, "s", "k", None)], cols).write.parquet(e)
    spark.createDataFrame([(9, t + dt.timedelta(hours=1), "a", "b", None, None, "helpful")], cols).write.parquet(f)
    sch = spark.read.parquet(e).schema
    q = rollup.correlated_stream(rollup.stream(spark, e, sch), rollup.stream(spark, f, sch)).writeStream.format("memory").queryName("corr").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["id"], r["feedback_outcome"]) for r in spark.sql("select * from corr").collect()] == [(1, "helpful")]


def test_rest_imports_without_the_llm_part():
    assert all(not f.__module__.startswith("rookery.llm") for f in catalog.queries().values())
