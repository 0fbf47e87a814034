import datetime as dt

from rookery.sources import edn, sink


def test_defaults_and_lists():
    e = sink.event({"operation": "resolve_context", "payload": "text", "occurred_at": "2026-01-01T01:00:00+01:00"})
    assert (e["surface"], e["status"], e["payload"], e["occurred_at"]) == ("library", "success", '{"value": "text"}', dt.datetime(2026, 1, 1)) and len(e["event_id"]) == 36
    f = sink.feedback({"retrieval_issue_codes": ["a", " ", "a", "b"], "payload": None})
    assert f["retrieval_issue_codes"] == ["a", "b"] and f["ground_truth_paths"] is None and f["payload"] == "{}" and f["operation"] == "resolve_context"


def test_tables_take_an_id_once(spark, tmp_path):
    s = sink.TableSink(spark, str(tmp_path / "usage"), size=3)
    for i in range(3):
        assert s.record_event({"event_id": f"e{i % 2}", "operation": " Resolve_Context", "occurred_at": dt.datetime(2026, 1, 1 + i), "latency_ms": 5, "cache_hit": True})
    assert s.batches() == 1 and s.stored_events().count() == 2 and not s.events
    s.record_event({"event_id": "e1", "operation": "resolve_context"})
    s.record_event({"event_id": "e9", "operation": "resolve_context", "occurred_at": "2026-01-01", "status": "error"})
    s.record_feedback({"feedback_outcome": "helpful", "occurred_at": "2026-01-01"})
    assert s.flush() and s.flush() and s.batches() == 2
    got = {r["metric_date"]: r for r in s.rollup().collect()}
    assert (got["2026-01-01"]["events"], got["2026-01-01"]["errors"], got["2026-01-01"]["helpful"], got["2026-01-01"]["cache_hits"]) == (2, 1, 1, 1)
    assert sum(r["events"] for r in got.values()) == 3
    again = sink.TableSink(spark, str(tmp_path / "usage"))
    assert again.batches() == 2 and again.stored_feedback().count() == 1


def test_a_lost_batch_is_not_seen(spark, tmp_path):
    s = sink.TableSink(spark, str(tmp_path / "lost"))
    s.append(spark.createDataFrame([("a",)], "event_id string"), spark.createDataFrame([], "feedback_id string"))
    spark.createDataFrame([("b",)], "event_id string").write.parquet(str(tmp_path / "lost/events/batch=1"))  # no mark
    assert [r["event_id"] for r in s.stored_events().collect()] == ["a"]
    assert s.append(spark.createDataFrame([("c",)], "event_id string"), spark.createDataFrame([], "feedback_id string")) == 1
    assert sorted(r["event_id"] for r in s.stored_events().collect()) == ["a", "c"]


def test_failing_sinks_are_silent():
    class Bad(sink.UsageSink):
        def record_event(self, given):
            raise OSError("full")

    assert sink.safely(Bad().record_event, {}) is False and sink.safely(sink.UsageSink().record_event, {}) is True
    m = sink.MemorySink()
    assert sink.safely(m.record_feedback, {}) and len(m.feedback) == 1


def test_edn_round_trip():
    doc = '{:policies [{:id "p\\"1" :version 2 :active true :weights {:a 1.5 "b c" -3}} nil] ; note\n :tags #{:x y} #_ {:left out}}'
    v = edn.loads(doc)
    assert v == {"policies": [{"id": 'p"1', "version": 2, "active": True, "weights": {"a": 1.5, "b c": -3}}, None], "tags": ["x", "y"]}
    assert edn.loads(edn.dumps(v)) == v and edn.loads("") is None and edn.loads(" ; only a note") is None
