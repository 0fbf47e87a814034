"""A tool edge over JSON-RPC on standard input and output (one message a line): the same operations as tools for agents.

    python -m rookery.mcp FOLDER

Sessions end after ``TTL`` seconds without a message; at most ``KEPT`` indexes stay open, the one used longest ago is closed first. A query may be a
short text, a mapping with an intent and some sections, or a whole query. What is missing gets defaults, by purpose where there are some; what the text names
is added to the lists, given values come first and win.
"""

from __future__ import annotations

import json
import sys
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.api import PURPOSES, Workspace
from rookery.errors import InvalidQuery, InvalidRequest, RookeryError
from rookery.operators.structure import anchors

PROTOCOL, TTL, KEPT = "2024-11-05", 1800, 8
#: Token budgets by purpose, and what a shorthand query gets where it says nothing.
BUDGETS = {"code_understanding": 3200, "change_impact": 2400, "edit_preparation": 1600, "test_targeting": 2400, "review_support": 3200, "bug_investigation": 2400}
CONSTRAINTS = {"token_budget": 3200, "max_raw_code_level": "enclosing_unit", "freshness": "current_snapshot"}
HINTS = {"prefer_definitions_over_callers": True, "prefer_breadth_over_depth": True}
OPTIONS = {"include_tests": False, "include_impact_hints": True, "allow_raw_code_escalation": False}
SECTIONS = ("intent", "targets", "constraints", "hints", "options", "trace")
_TEXT, _LIST, _INT, _MAP = "string", "array", "integer", "object"
#: Tool: what it does, its arguments with their types, and those it needs.
TOOLS = {
    "create_index": ("Index a directory", {"root_path": _TEXT, "snapshot_id": _TEXT}, ("root_path",)),
    "update_index": ("Read changed paths again", {"root_path": _TEXT, "changed_paths": _LIST}, ("root_path",)),
    "repo_map": ("First paths and modules of an index", {"root_path": _TEXT}, ("root_path",)),
    "resolve_context": ("A ranked selection for a query", {"root_path": _TEXT, "query": _MAP, "intent": _TEXT}, ("root_path",)),
    "expand_context": ("Skeletons and impact hints of a selection", {"selection_id": _TEXT, "unit_ids": _LIST}, ("selection_id",)),
    "fetch_context_detail": ("Raw code of a selection", {"selection_id": _TEXT, "unit_ids": _LIST, "level": _TEXT}, ("selection_id",)),
    "impact_analysis": ("Callers, dependents, tests and neighbours of what a query selects", {"root_path": _TEXT, "query": _MAP, "intent": _TEXT}, ("root_path",)),
    "skeletons": ("Signatures by units or paths", {"root_path": _TEXT, "unit_ids": _LIST, "paths": _LIST}, ("root_path",)),
    "literal_file_slice": ("Lines of a file", {"root_path": _TEXT, "path": _TEXT, "start_line": _INT, "end_line": _INT}, ("root_path", "path", "start_line", "end_line")),
    "snapshot_diff": ("Changes between two snapshots", {"root_path": _TEXT, "current": _TEXT, "baseline": _TEXT}, ("root_path",)),
}
_KINDS: dict[str, type | tuple] = {_TEXT: str, _LIST: list, _INT: int, _MAP: (dict, str)}


def merged(given: Mapping, more: Mapping) -> dict:
    """Sections joined: mappings by key, lists one behind the other without repetition; other given values win."""
    out = dict(given)
    for k, v in more.items():
        old = out.get(k)
        if isinstance(old, Mapping) and isinstance(v, Mapping):
            out[k] = merged(old, v)
        elif isinstance(old, list) and isinstance(v, list):
            out[k] = [*dict.fromkeys([*old, *v])]
        elif old is None:
            out[k] = v
    return out


def normalized_query(spark: SparkSession, query: Mapping | str | None, intent: str | None = None) -> tuple[dict, str]:
    """A whole query, and how it came: canonical, or as mcp_shorthand. A query without an intent is refused."""
    if isinstance(query, str):
        intent, query = query, None
    query = dict(query or {})
    if isinstance(query.get("schema_version"), str) and all(isinstance(query.get(s), Mapping) for s in SECTIONS):
        return query, "canonical"
    own = query.get("intent")
    own = {"details": own} if isinstance(own, str) else dict(own or {})
    own |= {"details": intent} if intent else {}
    if not own:
        raise InvalidQuery("a query needs an intent")
    own.setdefault("purpose", PURPOSES[0])
    out = query | {"api_version": query.get("api_version", "1.0"), "schema_version": query.get("schema_version", "1.0"), "intent": own}
    out["constraints"] = {**CONSTRAINTS, "token_budget": BUDGETS.get(own["purpose"], CONSTRAINTS["token_budget"]), **dict(query.get("constraints") or {})}
    out["hints"], out["options"] = {**HINTS, **dict(query.get("hints") or {})}, {**OPTIONS, **dict(query.get("options") or {})}
    out["trace"] = {"trace_id": str(uuid.uuid4()), "request_id": f"mcp-shorthand-{uuid.uuid4()}", "actor_id": "mcp_client", **dict(query.get("trace") or {})}
    details = own.get("details")
    if details:
        out.setdefault("targets", {"diff_summary": details})
        named = spark.createDataFrame([(details,)], "t string").select(*anchors(F.col("t"))).first()
        out["hints"] = merged(out["hints"], {"suspected_symbols": named["suspected"], "preferred_modules": named["modules"], "preferred_paths": named["paths"]})
    return out, "mcp_shorthand"


def wrong_arguments(tool: str, given: Mapping) -> list[str]:
    """What is wrong with a tool's arguments, by field."""
    _, known, needed = TOOLS[tool]
    out = [f"{n} is missing" for n in needed if given.get(n) is None] + [f"{n} is unknown" for n in given if n not in known]
    return out + [f"{n} has to be of type {known[n]}" for n, v in given.items() if n in known and v is not None and (not isinstance(v, _KINDS[known[n]]) or isinstance(v, bool) and known[n] == _INT)]


def guidance(query: Mapping) -> dict:
    """What helps to mend a refused query: the sections it lacks and a small example."""
    return {"missing_sections": [s for s in ("schema_version", *SECTIONS) if s not in query], "unknown_sections": sorted(set(query) - {*SECTIONS, "api_version", "schema_version"}), "example": {"intent": {"purpose": PURPOSES[0], "details": "where is total computed"}, "targets": {"symbols": ["app.orders/total"]}}}


class Server:
    """One session: answers messages, keeps open indexes in the order of their last use."""

    def __init__(self, workspace: Workspace, clock: Callable[[], float] = time.monotonic):
        self.workspace, self.clock, self.seen = workspace, clock, clock()
        self.open: OrderedDict[str, str] = OrderedDict()

    def expired(self) -> bool:
        return self.clock() - self.seen > TTL

    def _touch(self, root: str, snapshot_id: str) -> None:
        self.open[root] = snapshot_id
        self.open.move_to_end(root)
        while len(self.open) > KEPT:
            self.open.popitem(last=False)

    def call(self, tool: str, given: Mapping) -> dict:
        if tool not in TOOLS:
            raise InvalidRequest(f"no tool {tool}")
        if wrong := wrong_arguments(tool, given):
            raise InvalidRequest("; ".join(wrong))
        args = {{"root_path": "root", "changed_paths": "changed"}.get(k, k): v for k, v in given.items() if v is not None}
        mode = None
        if tool in ("resolve_context", "impact_analysis"):
            args["query"], mode = normalized_query(self.workspace.spark, args.get("query"), args.pop("intent", None))
        if tool == "update_index":
            args.setdefault("changed", [])
        got = getattr(self.workspace, tool)(**args)
        if isinstance(got, DataFrame):
            got = {"rows": [r.asDict(True) for r in got.toLocalIterator()]}
        if "root" in args:
            self._touch(args["root"], got.get("snapshot_id", ""))
        return got | ({"query_ingress_mode": mode} if mode else {})

    def answer(self, message: Mapping) -> dict | None:
        """The response to one message; none to a notification."""
        method, params, at = message.get("method"), message.get("params") or {}, message.get("id")
        if self.expired() and method != "initialize":
            return {"jsonrpc": "2.0", "id": at, "error": {"code": -32001, "message": "session expired"}}
        self.seen = self.clock()
        if at is None:
            return None
        reply = lambda result: {"jsonrpc": "2.0", "id": at, "result": result}
        if method == "initialize":
            return reply({"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "rookery", "version": "1"}})
        if method == "ping":
            return reply({})
        if method == "tools/list":
            return reply({"tools": [{"name": n, "description": text, "inputSchema": {"type": "object", "properties": {a: {"type": t} for a, t in known.items()}, "required": list(needed)}} for n, (text, known, needed) in TOOLS.items()]})
        if method != "tools/call":
            return {"jsonrpc": "2.0", "id": at, "error": {"code": -32601, "message": f"no method {method}"}}
        try:
            got, failed = self.call(params.get("name", ""), params.get("arguments") or {}), False
        except RookeryError as e:
            query = dict(params.get("arguments") or {}).get("query")
            got, failed = e.payload() | ({"guidance": guidance(query if isinstance(query, Mapping) else {})} if isinstance(e, InvalidQuery) else {}), True
        return reply({"content": [{"type": "text", "text": json.dumps(got, default=str)}], "isError": failed})

    def serve(self, lines: Iterable[str], write: Callable[[str], object]) -> None:
        for line in lines:
            if not line.strip():
                continue
            try:
                message = json.loads(line)
            except ValueError:
                write(json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}) + "\n")
                continue
            if (got := self.answer(message)) is not None:
                write(json.dumps(got) + "\n")


if __name__ == "__main__":

    def _out(text: str) -> None:
        sys.stdout.write(text)
        sys.stdout.flush()

    Server(Workspace(SparkSession.builder.appName("rookery").getOrCreate(), sys.argv[1])).serve(sys.stdin, _out)
