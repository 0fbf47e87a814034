"""A JSON edge over HTTP and a command line, both thin: they call a ``Workspace`` and turn errors into statuses and exit codes.

    python -m rookery.edge serve FOLDER [PORT]
    python -m rookery.edge query NAME TABLES [OUT]
    python -m rookery.edge resolve STORE ROOT TEXT      (indexes the tree where the store has none; exit code 1 without evidence)
    python -m rookery.edge outline STORE ROOT FOLDER [check]      (exit code 1 where the outline on disk is stale)
    python -m rookery.edge contracts TABLES      (exit code 1 where a rule is broken)
    python -m rookery.edge fixtures FILE      (expectations and results as JSON rows; exit code 1 where one fails)
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import DataFrame, SparkSession

from rookery.api import Workspace
from rookery.errors import RookeryError

#: Route to method and the names of its arguments in the JSON body.
ROUTES = {
    "/v1/index/create": ("create_index", ("root", "snapshot_id")),
    "/v1/index/update": ("update_index", ("root", "changed")),
    "/v1/context/resolve": ("resolve_context", ("root", "query")),
    "/v1/context/expand": ("expand_context", ("selection_id", "unit_ids")),
    "/v1/context/detail": ("fetch_context_detail", ("selection_id", "unit_ids", "level")),
    "/v1/context/impact": ("impact_analysis", ("root", "query")),
    "/v1/file/slice": ("literal_file_slice", ("root", "path", "start_line", "end_line", "snapshot_id")),
    "/v1/snapshot/diff": ("snapshot_diff", ("root", "current", "baseline")),
}


def outcome(workspace: Workspace, route: str, body: dict) -> tuple[int, dict | DataFrame]:
    """Status and result of one request."""
    if route == "/health":
        return 200, {"status": "ok"}
    if route not in ROUTES:
        return 404, {"code": "not_found", "message": route}
    method, names = ROUTES[route]
    try:
        got = getattr(workspace, method)(**{k: body[k] for k in names if k in body})
    except RookeryError as e:
        return e.status, e.payload()
    except (TypeError, KeyError) as e:
        return 400, {"code": "invalid_request", "category": "client", "message": str(e)}
    return 200, got


def rows(got: DataFrame) -> Iterator[dict]:
    """All rows in their order; one partition at a time comes to the driver."""
    return (r.asDict(True) for r in got.toLocalIterator())


def answer(workspace: Workspace, route: str, body: dict) -> tuple[int, dict]:
    """Status and JSON of one request, every row of a frame included."""
    status, got = outcome(workspace, route, body)
    return status, {"rows": list(rows(got))} if isinstance(got, DataFrame) else got


def written_out(got: dict | DataFrame) -> Iterator[bytes]:
    """The JSON of a result in parts, a row each; a frame's text is no whole JSON before its last part."""
    if not isinstance(got, DataFrame):
        yield json.dumps(got, default=str).encode()
        return
    before = '{"rows": ['
    for r in rows(got):
        yield (before + json.dumps(r, default=str)).encode()
        before = ", "
    yield b"]}" if before == ", " else (before + "]}").encode()


def server(workspace: Workspace, port: int = 8080) -> HTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, body: dict) -> None:
            status, got = outcome(workspace, self.path, body)
            parts = written_out(got)
            first = next(parts)  # a job that fails does so before the status is sent
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            if not isinstance(got, DataFrame):  # the end of a frame's rows is the connection's
                self.send_header("Content-Length", str(len(first)))
            self.end_headers()
            self.wfile.write(first)
            for part in parts:
                self.wfile.write(part)

        def do_GET(self) -> None:
            self._send({})

        def do_POST(self) -> None:
            self._send(json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}"))

        def log_message(self, *args) -> None:
            pass

    return HTTPServer(("127.0.0.1", port), Handler)


def _resolve(w: Workspace, root: str, text: str) -> int:
    if w.store.latest(root) is None:
        w.create_index(root)
    got = w.resolve_context(root, text)
    print(json.dumps(got | w.expand_context(got["selection_id"]), default=str))
    return int(got["result_status"] == "insufficient_evidence")


def _outline(w: Workspace, root: str, folder: str, check: bool) -> int:
    got = w.outline_drift(root, folder) if check else w.outline(root, folder)
    print(json.dumps({k: v for k, v in got.items() if not k.endswith("markdown")}, default=str))
    return int(check and got["stale"])


def _contracts(spark: SparkSession, tables: str) -> int:
    from rookery.operators import projections as p
    from rookery.sources.tables import table

    broken = [(t, r["rule"], r["n"]) for t, rules in (("semantic_usage_events", p.event_rules()), ("semantic_usage_feedback", p.feedback_rules())) for r in p.violations(table(spark, tables, t), rules).collect() if r["n"]]
    print(json.dumps([{"table": t, "rule": rule, "rows": n} for t, rule, n in broken]))
    return int(bool(broken))


def _fixtures(spark: SparkSession, path: str) -> int:
    from rookery.operators.packets import FIXTURE, fixture_failures

    got = fixture_failures(spark.read.schema(FIXTURE).option("multiLine", True).json(path)).collect()
    print(json.dumps([r.asDict() for r in got]))
    return int(any(r["failed"] for r in got))


def main(args: list[str], spark: SparkSession | None = None) -> int:
    spark = spark or SparkSession.builder.appName("rookery").getOrCreate()
    name, rest = (args[0], args[1:]) if args else ("", [])
    if name == "serve" and rest:
        server(Workspace(spark, rest[0]), int(rest[1]) if len(rest) > 1 else 8080).serve_forever()
    if name == "query" and len(rest) > 1:
        from rookery.plans import catalog

        df = catalog.queries()[rest[0]](spark, rest[1])
        df.write.mode("overwrite").parquet(rest[2]) if len(rest) > 2 else df.show(50, False)
        return 0
    if name == "resolve" and len(rest) == 3:
        return _resolve(Workspace(spark, rest[0]), rest[1], rest[2])
    if name == "outline" and len(rest) in (3, 4):
        return _outline(Workspace(spark, rest[0]), rest[1], rest[2], rest[3:] == ["check"])
    if name == "contracts" and len(rest) == 1:
        return _contracts(spark, rest[0])
    if name == "fixtures" and len(rest) == 1:
        return _fixtures(spark, rest[0])
    print(__doc__, file=sys.stderr)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
