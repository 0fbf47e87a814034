"""The library's front: index a tree, ask staged queries, compare snapshots.

A ``Workspace`` keeps what is asked for in tables of a ``UnitStore`` and remembers the last selections on the driver; all work on units
is done by the operators. Selections are bound to their snapshot: slices and details read the snapshot's tables, not the tree.
"""

from __future__ import annotations

import time
import uuid
from collections import OrderedDict
from collections.abc import Mapping, Sequence
from functools import wraps
from types import MappingProxyType

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from rookery import errors, guard
from rookery.operators import context, diff, graph, outline, retrieval
from rookery.operators.identity import LANGUAGE_BY_ENDING
from rookery.operators.projections import change_order
from rookery.operators.structure import anchors, repo_map
from rookery.sources import scan, sink
from rookery.sources.extract import extracted, with_use_imports
from rookery.sources.store import NotFound, UnitStore

QUERY = (
    "root string, query_id string, symbols array<string>, paths array<string>, modules array<string>, tests array<string>, prefixes array<string>, languages array<string>, preferred_paths array<string>, "
    "preferred_modules array<string>, suspected array<string>, spans array<struct<path:string,start_line:int,end_line:int>>, details string, include_tests boolean, definitions boolean"
)
KEPT, FORGOTTEN = 128, 512
LEVELS = ("none", "target_span", "enclosing_unit", "local_neighborhood", "whole_file")
PURPOSES = ("code_understanding", "change_impact", "edit_preparation", "test_targeting", "review_support", "bug_investigation")


#: How many entries the lists of a query may have, how long its texts, and how fresh its snapshot has to be.
LIST_LIMITS = {"targets": dict.fromkeys(("paths", "symbols", "modules", "tests", "changed_spans"), 20), "constraints": {"language_allowlist": 12, "allowed_path_prefixes": 20}, "hints": dict.fromkeys(("preferred_paths", "preferred_modules", "suspected_symbols"), 25)}
TEXT_LIMIT, DETAILS_LIMIT = 240, 2000
FRESHNESS = ("current_snapshot", "allow_stale_if_flagged")


def _check_limits(query: Mapping) -> None:
    """Lists and texts are bounded; what is given may not be empty."""
    for section, lists in LIST_LIMITS.items():
        for name, most in lists.items():
            got = dict(query.get(section) or {}).get(name)
            if got is None:
                continue
            if isinstance(got, str) or not isinstance(got, Sequence) or len(got) > most:
                raise errors.InvalidQuery(f"{section}.{name} has to be a list of at most {most}")
            if any(not x or len(x) > TEXT_LIMIT for x in got if isinstance(x, str)):
                raise errors.InvalidQuery(f"{section}.{name} has an empty or a very long entry")
    details = dict(query.get("intent") or {}).get("details")
    if details is not None and (not isinstance(details, str) or len(details) > DETAILS_LIMIT):
        raise errors.InvalidQuery(f"intent.details has to be a text of at most {DETAILS_LIMIT} characters")
    if dict(query.get("constraints") or {}).get("freshness", FRESHNESS[0]) not in FRESHNESS:
        raise errors.InvalidQuery("freshness")
    for section in ("hints", "options"):
        for name, v in dict(query.get(section) or {}).items():
            if name.startswith(("prefer_", "focus_", "include_", "allow_")) and not isinstance(v, bool):
                raise errors.InvalidQuery(f"{section}.{name} has to be true or false")


def checked_query(query: Mapping) -> dict:
    """A query's fields by their flat names, with defaults; raises where the contract is broken."""
    if query.get("api_version", "1.0") != "1.0":
        raise errors.UnsupportedVersion(f"api version {query['api_version']}")
    known = {"api_version", "schema_version", "intent", "targets", "constraints", "hints", "options", "trace"}
    if extra := set(query) - known:
        raise errors.InvalidQuery(f"unknown sections: {sorted(extra)}")
    _check_limits(query)
    part = lambda k: dict(query.get(k) or {})
    intent, targets, limits, hints, options = map(part, ("intent", "targets", "constraints", "hints", "options"))
    if intent.get("purpose", PURPOSES[0]) not in PURPOSES:
        raise errors.InvalidQuery(f"purpose {intent['purpose']}")
    budget = limits.get("token_budget", context.BUDGET)
    if not isinstance(budget, int) or budget <= 0:
        raise errors.InvalidQuery("token_budget must be a positive integer")
    level = limits.get("max_raw_code_level", "enclosing_unit")
    if level not in LEVELS:
        raise errors.InvalidQuery(f"raw code level {level}")
    return {
        "symbols": targets.get("symbols", []), "paths": targets.get("paths", []), "modules": targets.get("modules", []), "tests": targets.get("tests", []), "spans": [(s["path"], s["start_line"], s["end_line"]) for s in targets.get("changed_spans", [])],
        "prefixes": limits.get("allowed_path_prefixes", []), "languages": limits.get("language_allowlist", []), "preferred_paths": hints.get("preferred_paths", []), "preferred_modules": hints.get("preferred_modules", []), "suspected": hints.get("suspected_symbols", []),
        "details": " ".join(filter(None, [intent.get("details"), targets.get("diff_summary")])), "include_tests": bool(options.get("include_tests") or hints.get("focus_on_tests")), "definitions": bool(hints.get("prefer_definitions_over_callers")),
        "breadth": bool(hints.get("prefer_breadth_over_depth")), "budget": budget, "level": level, "snapshot_id": limits.get("snapshot_id"),
    }


def recorded(operation: str):
    """Records an operation's event, also where it raises; telemetry that fails never fails the operation."""

    def wrap(method):
        @wraps(method)
        def run(self, *args, suppress_usage: bool = False, **kw):
            if self.usage is None or suppress_usage:
                return method(self, *args, **kw)
            begin, status, got, error = time.monotonic(), "success", None, None
            try:
                got = method(self, *args, **kw)
                return got
            except errors.RookeryError as e:
                status, error = "error", e.payload()
                raise
            finally:
                root = kw.get("root") or (args[0] if args else None)
                if operation in ("expand_context", "fetch_context_detail"):
                    root = self.selections.get(root, {}).get("root")
                query = kw.get("query") or (args[1] if len(args) > 1 else None)
                trace = dict(query.get("trace") or {}) if isinstance(query, Mapping) else {}
                answer = got if isinstance(got, dict) else {}
                fields = {"file_count": answer.get("n_files"), "unit_count": answer.get("n_units"), "confidence_level": answer.get("confidence_level"), "result_status": answer.get("result_status")}
                fields |= {"selected_units_count": len(answer["focus"]) if "focus" in answer else None, "payload": error or {"selection_id": answer.get("selection_id"), "snapshot_id": answer.get("snapshot_id")}}
                labels = {k: trace.get(k) for k in ("trace_id", "request_id", "session_id", "task_id", "actor_id")}
                known = {k: v for k, v in labels.items() if v}
                sink.safely(self.usage.record_event, {**self.context, **known, **fields, "operation": operation, "status": status, "latency_ms": int(1000 * (time.monotonic() - begin)), "root_path_hash": sink.root_path_hash(root)})

        return run

    return wrap


class Workspace:
    """Indexes and selections of one session."""

    usage: sink.UsageSink | None = None
    access: Mapping | None = None
    context: Mapping = MappingProxyType({"surface": "library"})

    def __init__(self, spark: SparkSession, folder: str, language_policy: dict | None = None, allowed_roots: Sequence[str] | None = None, usage: sink.UsageSink | None = None, context: Mapping | None = None, access: Mapping | None = None):
        """``usage`` takes an event of every operation, with the fields of ``context`` (surface, actor, tenant, ...). ``access`` is a tenants' policy
        (``rookery.guard``) that the tenant of ``context`` has to meet."""
        self.spark, self.store, self.policy, self.allowed = spark, UnitStore(spark, folder), language_policy, allowed_roots
        self.usage, self.context, self.access = usage, {"surface": "library", **(context or {})}, access
        self.selections: OrderedDict[str, dict] = OrderedDict()
        self.evicted: OrderedDict[str, None] = OrderedDict()

    def _guard(self, root: str, paths: Sequence[str] | None = None) -> str:
        root = root.rstrip("/") or "/"
        guard.authorize(self.access, self.context.get("tenant_id"), root, paths)
        if self.allowed is not None and not any(root == a.rstrip("/") or root.startswith(a.rstrip("/") + "/") for a in self.allowed):
            raise errors.Forbidden(f"{root} is under no allowed root")
        return root

    def _check_languages(self, paths: Sequence[str]) -> None:
        """Raises where a query names files of a language that the policy keeps inactive."""
        p = scan.merged_policy(self.policy, None)
        asked = [x for x in dict.fromkeys(LANGUAGE_BY_ENDING.get(path.rsplit(".", 1)[-1].lower()) for path in paths) if x]
        if closed := [x for x in asked if x in p["disable"] or p["allow"] is not None and x not in p["allow"]]:
            raise errors.NotActive(f"languages {', '.join(closed)} are not active; refresh the project context")

    def _files(self, root: str) -> DataFrame:
        files = scan.tree(self.spark, root)
        detected = [r[0] for r in files.select("language").distinct().collect()]
        active = scan.activation(detected, self.policy)["active"]
        if not active:
            raise errors.NotActive(f"no active language in {root}")
        return files.where(F.col("language").isin(*active)).withColumn("root", F.lit(root))

    @recorded("create_index")
    def create_index(self, root: str, snapshot_id: str | None = None) -> dict:
        """Scans, extracts, links and stores a tree; returns the snapshot's summary."""
        root = self._guard(root)
        files, sid = self._files(root), snapshot_id or uuid.uuid4().hex
        self.store.save(root, sid, with_use_imports(extracted(files, "root"), "root"))
        self._save_text(root, sid, files)
        return self.summary(root, sid)

    @recorded("update_index")
    def update_index(self, root: str, changed: Sequence[str], snapshot_id: str | None = None) -> dict:
        """Reads the changed paths again and links the whole anew; texts of the others are taken from the last snapshot, not from the tree. Without
        paths it is a full rebuild. Changed paths that are gone lose their units."""
        root = self._guard(root, list(changed) or None)
        sid, before = snapshot_id or uuid.uuid4().hex, self.store.latest(root)
        if not changed or before is None:
            files = self._files(root)
            self.store.update(root, sid, with_use_imports(extracted(files, "root"), "root"), []) if before else self.store.save(root, sid, with_use_imports(extracted(files, "root"), "root"))
            self._save_text(root, sid, files)
            return self.summary(root, sid)
        some = scan.tree(self.spark, root, only=changed).withColumn("root", F.lit(root))
        some = some.where(F.col("language").isin(*self._languages(root)))
        self.store.update(root, sid, with_use_imports(extracted(some, "root"), "root"), changed)
        self._save_text(root, sid, self._text(root, before).where(~F.col("path").isin(*changed)).unionByName(some.select("path", "text")))
        return self.summary(root, sid)

    def _languages(self, root: str) -> list[str]:
        """The languages active for a tree: by its paths alone, no file is read."""
        detected = [r[0] for r in scan.tree(self.spark, root, text=False).select("language").distinct().collect()]
        return scan.activation([x for x in detected if x], self.policy)["active"] or [""]

    def _save_text(self, root: str, sid: str, files: DataFrame) -> None:
        files.select("path", "text").write.mode("overwrite").parquet(f"{self.store.folder}/text/{self.store._at(root, sid)}")

    def summary(self, root: str, snapshot_id: str | None = None) -> dict:
        try:
            u = self.store.units(self._guard(root), snapshot_id)
        except NotFound as e:
            raise errors.IndexNotFound(str(e)) from e
        r = repo_map(u).first()
        return {"root_path": root, "snapshot_id": snapshot_id or self.store.latest(root), "n_files": r["n_files"] if r else 0, "n_units": r["n_units"] if r else 0}

    @recorded("repo_map")
    def repo_map(self, root: str) -> DataFrame:
        return repo_map(self.store.units(self._guard(root)))

    @recorded("resolve_context")
    def resolve_context(self, root: str, query: Mapping | str) -> dict:
        """Stage 1: a ranked, compact selection. A string is free text; what it names becomes hints."""
        q = checked_query({"intent": {"details": query}} if isinstance(query, str) else query)
        root = self._guard(root, [*q["paths"], *q["prefixes"]] or None)
        self._check_languages(q["paths"])
        if isinstance(query, str):
            named = self.spark.createDataFrame([(query,)], "t string").select(*anchors(F.col("t"))).first()
            q |= {"suspected": named["suspected"], "preferred_modules": named["modules"], "preferred_paths": named["paths"]}
        sid = q["snapshot_id"] or self.store.latest(root)
        if sid is None or sid not in self.store.snapshots(root):
            raise errors.SnapshotMismatch(f"snapshot {sid} of {root}") if q["snapshot_id"] else errors.IndexNotFound(root)
        selection = uuid.uuid4().hex
        names = [f.split()[0] for f in QUERY.replace("struct<path:string,start_line:int,end_line:int>", "s").split(", ")]
        frame = self.spark.createDataFrame([tuple({"root": root, "query_id": selection, **q}[n] for n in names)], QUERY)
        ranked = retrieval.resolve(self.store.units(root, sid), frame, self.store.edges(root, sid), 3 if q["breadth"] else 2)
        rows = [r.asDict() for r in ranked.orderBy("place").collect()]  # at most 20
        frame_rows = self.spark.createDataFrame([Row(**r) for r in rows], ranked.schema) if rows else ranked.limit(0)
        verdict = context.selections(frame_rows, frame, q["budget"]).first().asDict()
        focus = [r["unit_id"] for r in context.focus(frame_rows, q["budget"]).orderBy("place").collect()]
        self._keep(selection, {"root": root, "snapshot_id": sid, "query": q, "rows": rows, "schema": ranked.schema, "focus": focus, "verdict": verdict})
        return {"selection_id": selection, "snapshot_id": sid, **{k: verdict[k] for k in ("result_status", "confidence_level", "warnings", "next_step")}, "focus": focus}

    def _keep(self, key: str, value: dict) -> None:
        self.selections[key] = value
        while len(self.selections) > KEPT:
            old, _ = self.selections.popitem(last=False)
            self.evicted[old] = None
            while len(self.evicted) > FORGOTTEN:
                self.evicted.popitem(last=False)

    def selection(self, selection_id: str, snapshot_id: str | None = None) -> dict:
        if selection_id not in self.selections:
            raise errors.SelectionEvicted(selection_id) if selection_id in self.evicted else errors.SelectionNotFound(selection_id)
        s = self.selections[selection_id]
        if snapshot_id and snapshot_id != s["snapshot_id"]:
            raise errors.SnapshotMismatch(f"selection is of snapshot {s['snapshot_id']}")
        return s

    def _rows(self, s: dict, unit_ids: Sequence[str] | None) -> DataFrame:
        rows = [r for r in s["rows"] if not unit_ids or r["unit_id"] in unit_ids]
        return self.spark.createDataFrame([Row(**r) for r in rows], s["schema"])

    @recorded("expand_context")
    def expand_context(self, selection_id: str, unit_ids: Sequence[str] | None = None) -> dict:
        """Stage 2: skeletons of the focus (or of the named units) within budget, and impact hints."""
        s = self.selection(selection_id)
        x = self._rows(s, unit_ids or s["focus"])
        units, edges = self.store.units(s["root"], s["snapshot_id"]), self.store.edges(s["root"], s["snapshot_id"])
        hints: dict[str, list[str]] = {}
        for r in graph.impact(x, units, edges).orderBy("hint", "place").collect():  # at most 4 * 12
            hints.setdefault(r["hint"], []).append(r["value"])
        return {"skeletons": [r.asDict() for r in context.skeletons(x, s["query"]["budget"]).select("unit_id", "path", "signature", "rank_band").collect()], "impact_hints": hints}

    @recorded("impact_analysis")
    def impact_analysis(self, root: str, query: Mapping | str) -> dict:
        return self.expand_context(self.resolve_context(root, query)["selection_id"])["impact_hints"]

    @recorded("fetch_context_detail")
    def fetch_context_detail(self, selection_id: str, unit_ids: Sequence[str] | None = None, level: str | None = None) -> dict:
        """Stage 3: raw code of the selected units from the snapshot's text, up to the byte budget."""
        s = self.selection(selection_id)
        level = level or s["query"]["level"]
        if level not in LEVELS:
            raise errors.InvalidRequest(f"raw code level {level}")
        if level == "none" or not s["rows"]:
            return {"raw_context": [], "confidence_level": s["verdict"]["confidence_level"]}
        text = self.spark.read.parquet(f"{self.store.folder}/text/{self.store._at(s['root'], s['snapshot_id'])}")
        x = self._rows(s, unit_ids).join(text, "path", "left")
        got = context.raw_fetch(x, "text", "query_id", "place", s["query"]["budget"], level).orderBy("place").collect()  # at most 6
        return {"raw_context": [{"unit_id": r["unit_id"], "path": r["path"], "start_line": r["from"], "end_line": r["to"], "content": r["content"]} for r in got], "confidence_level": s["verdict"]["confidence_level"]}

    def literal_file_slice(self, root: str, path: str, start_line: int, end_line: int, snapshot_id: str | None = None) -> dict:
        if start_line < 1 or end_line < start_line or path.startswith("/") or ".." in path.split("/"):
            raise errors.InvalidRequest("bad path or line range")
        text = self.spark.read.parquet(f"{self.store.folder}/text/{self.store._at(self._guard(root, [path]), snapshot_id)}").where(F.col("path") == path)
        r = context.slices(text, "path", "text", F.lit(start_line), F.lit(end_line)).first()
        if r is None or r["reason"] == "start_beyond_end":
            raise errors.InvalidRequest(f"{path} has no line {start_line}")
        return r.asDict()

    def snapshot_diff(self, root: str, current: str | None = None, baseline: str | None = None, **options) -> DataFrame:
        """Changes from one snapshot to another in a fixed order; by default from the last but one to the last."""
        ids = self.store.snapshots(self._guard(root))
        current = current or (ids[-1] if ids else None)
        baseline = baseline or (ids[ids.index(current) - 1] if current in ids and ids.index(current) else None)
        if current not in ids or baseline not in ids:
            raise errors.InvalidRequest(f"no such pair of snapshots: {baseline}, {current}")
        of = lambda sid, seq, nxt: self.store.units(root, sid).withColumns({"root": F.lit(root), "seq": F.lit(seq), "snapshot_id": F.lit(sid), "next_snapshot": F.lit(nxt).cast("string")})
        return diff.changes(of(baseline, 1, current).unionByName(of(current, 2, None), allowMissingColumns=True), **options).orderBy(*change_order())

    def query_units(self, root: str, **filters) -> DataFrame:
        return self.store.units(self._guard(root), **filters)

    def query_callers(self, root: str, unit_id: str, limit: int = 100) -> DataFrame:
        return self.store.related(self._guard(root), unit_id, True, limit=limit)

    def query_callees(self, root: str, unit_id: str, limit: int = 100) -> DataFrame:
        return self.store.related(self._guard(root), unit_id, False, limit=limit)

    @recorded("skeletons")
    def skeletons(self, root: str, unit_ids: Sequence[str] | None = None, paths: Sequence[str] | None = None) -> DataFrame:
        """By ids, else by paths, else the first 20 units."""
        u = self.store.units(self._guard(root))
        x = u.where(F.col("unit_id").isin(*unit_ids)) if unit_ids else u.where(F.col("path").isin(*paths)) if paths else u.orderBy("path", "unit_order").limit(20)
        return x.select("unit_id", "path", "symbol", "signature", "start_line", "end_line")

    def record_feedback(self, feedback: Mapping, root: str | None = None) -> bool:
        """Takes a user's answer to an earlier selection; always true, as telemetry never fails the caller."""
        if self.usage is not None:
            sink.safely(self.usage.record_feedback, {**self.context, **({"root_path_hash": sink.root_path_hash(root)} if root else {}), **feedback})
        return True

    def outline(self, root: str, folder: str | None = None, changed_only: bool = False) -> dict:
        """The outline of the last snapshot; with ``folder`` it is written there as Markdown, DOT and JSON."""
        root = self._guard(root)
        units = self.store.units(root).withColumn("root", F.lit(root))
        language = units.groupBy("path").agg(F.min("language").alias("language"))
        files = self._text(root, None).join(language, "path", "left").withColumn("root", F.lit(root))
        return outline.refresh(root, units, files, folder, changed_only) if folder else outline.artifact(root, units, files)

    def outline_drift(self, root: str, folder: str) -> dict:
        return outline.drift(self.outline(root), folder)

    def _text(self, root: str, snapshot_id: str | None) -> DataFrame:
        return self.spark.read.parquet(f"{self.store.folder}/text/{self.store._at(root, snapshot_id)}")
