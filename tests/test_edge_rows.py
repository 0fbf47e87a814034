import json
import threading
import urllib.request

from rookery.edge import answer, server
from rookery.api import Workspace
from rookery.operators.projections import ordered_changes

SCHEMA = "root string, unit_id string, kind string, symbol string, path string, module string, language string, imports array<string>, calls array<string>, signature string, start_line int, end_line int, method_arity int, parser_mode string"
N = 2500


class Stored(Workspace):
    """Two snapshots, the second with ``N`` more units."""

    def __init__(self, spark):
        make = lambda n: spark.createDataFrame([("r", f"u{i}", "function", f"m/f{i}", f"p{i % 7}", "m", "python", [], [f"c{i}"], None, i, i, None, "full") for i in range(n)], SCHEMA)
        self.allowed = None
        self.store = self
        self.units = lambda root, sid: make(N + 3 if sid == "b" else 3)
        self.snapshots = lambda root: ["a", "b"]


def test_every_change_comes_out_in_order(spark):
    w = Stored(spark)
    want = [r["unit_id"] for r in ordered_changes(w.snapshot_diff("r")).orderBy("place").collect()]
    status, out = answer(w, "/v1/snapshot/diff", {"root": "r"})
    assert status == 200 and len(out["rows"]) == N and [r["unit_id"] for r in out["rows"]] == want
    s = server(w, 0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    try:
        ask = lambda b: json.load(urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{s.server_port}/v1/snapshot/diff", json.dumps(b).encode())))
        assert ask({"root": "r"}) == out
        assert ask({"root": "r", "current": "a", "baseline": "a"}) == {"rows": []}
    finally:
        s.shutdown()
        s.server_close()
