"""An outline of a code base as one artifact: tree, namespaces, dependencies, domain model, entry points; as Markdown, DOT and JSON.

The parts are frames, computed where the units are; the artifact takes bounded pieces of them to the driver (``Bounds``) and says how many
more there are. An outline is stale where the file on disk differs from what would be written now; a refresh by changes compares
fingerprints of the sources first and writes nothing where they agree.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.operators.context import lines
from rookery.operators.graph import GRAPH_SQL
from rookery.operators.structure import dependency_edges, fingerprint, namespaces, top_symbols
from rookery.plans.views import linked_units
from rookery.sources import scan
from rookery.sources.store import write_json

#: What defining forms make of a name.
DOMAIN = {"(defrecord": "record", "(defprotocol": "protocol", "(deftype": "type", "(defschema": "schema", "(s/def": "spec", "(m/schema": "malli-schema", "(m/=>": "malli-schema"}
CATEGORIES = ("api", "service", "domain", "db", "infra", "util", "app/core", "test", "other")


@dataclass(frozen=True)
class Bounds:
    """How many entries a part shows."""

    per_category: int = 8
    edges: int = 20
    domain: int = 20
    entries: int = 12
    modules: int = 12
    symbols: int = 8
    depth: int = 3
    paths: int = 2000


def _words(line: Column) -> Column:
    return F.split(F.trim(line), r"[\s\[\])]+")


def domain_model(files: DataFrame, kinds: dict[str, str] = DOMAIN) -> DataFrame:
    """root, name, kind, path of the records, protocols, types and schemas that Clojure files define; ``kinds`` by the opening word."""
    x = files.where("language = 'clojure'").select("root", "path", F.explode(lines(F.col("text"))).alias("line")).withColumn("w", _words(F.col("line")))
    kind = F.create_map(*[F.lit(v) for kv in kinds.items() for v in kv])[F.element_at("w", 1)]
    return x.where(F.size("w") > 1).select("root", F.element_at("w", 2).alias("name"), kind.alias("kind"), "path").where("kind is not null and name <> ''").distinct()


def entry_points(units: DataFrame, files: DataFrame) -> DataFrame:
    """root, entry: main functions, and definitions of request handlers."""
    mains = units.where(F.endswith("symbol", F.lit("/-main"))).select("root", F.col("symbol").alias("entry"))
    module = units.where("module is not null").groupBy("root", "path").agg(F.min("module").alias("module"))
    handlers = files.where("language = 'clojure'").select("root", "path", F.explode(lines(F.col("text"))).alias("line")).where(F.ltrim("line").startswith("(def ") & F.col("line").rlike(r"\bring-handler\b"))
    named = handlers.select("root", "path", F.element_at(_words(F.col("line")), 2).alias("name")).join(module, ["root", "path"]).select("root", F.concat_ws("/", "module", "name").alias("entry"))
    return mains.unionByName(named).distinct()


def dot_lines(edges: DataFrame) -> DataFrame:
    """root, place, line of a DOT graph of from/to edges; first and last line included."""
    w = Window.partitionBy("root").orderBy("from", "to")
    body = edges.select("root", F.row_number().over(w).alias("place"), F.format_string('  "%s" -> "%s";', "from", "to").alias("line"))
    frame = edges.groupBy("root").agg(F.count(F.lit(1)).alias("n")).select("root", F.inline(F.array(F.struct(F.lit(0).alias("place"), F.lit("digraph dependency_graph {").alias("line")), F.struct((F.col("n") + 1).cast("int").alias("place"), F.lit("}").alias("line")))))
    return body.unionByName(frame)


def bounded(rows: DataFrame, line: Column, order: list[str], limit: int) -> DataFrame:
    """root, place, line: the first ``limit`` lines of each directory and one that says how many more there are."""
    w = Window.partitionBy("root").orderBy(*order)
    x = rows.withColumn("line", line).withColumn("place", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("root")))
    more = F.format_string("- ... +%d more", F.col("n") - limit)
    return x.where(F.col("place") <= limit + 1).select("root", "place", F.when(F.col("place") <= limit, F.col("line")).otherwise(more).alias("line"))


def tree_lines(root: str, paths: list[str], depth: int = Bounds.depth) -> list[str]:
    """A directory tree of the paths, ``depth`` levels deep."""
    tree: dict = {}
    for p in sorted(paths):
        at = tree
        for part in p.split("/")[:depth]:
            at = at.setdefault(part, {})

    def render(level: dict, before: str) -> list[str]:
        out = []
        for i, (name, below) in enumerate(sorted(level.items())):
            last = i == len(level) - 1
            out += [f"{before}{'└ ' if last else '├ '}{name}", *render(below, before + ("  " if last else "│ "))]
        return out

    return [root.rstrip("/").rsplit("/", 1)[-1] or "/", *render(tree, "")]


def _some(title: str, items: list[str], limit: int) -> list[str]:
    return [title, *(items[:limit] or ["- none"]), *([f"- ... +{len(items) - limit} more"] if len(items) > limit else [])]


def artifact(root: str, units: DataFrame, files: DataFrame, bounds: Bounds = Bounds()) -> dict:
    """The outline of one directory; ``units`` and ``files`` (root, path, language, text) are of that directory."""
    first = lambda df, n, *order: [r.asDict() for r in df.orderBy(*order).limit(n).collect()]
    spaces = first(namespaces(units), bounds.paths, "module", "path")
    symbols: dict[str, list[str]] = {}
    for r in top_symbols(units).where(F.col("place") <= bounds.symbols).join(units.where("module is not null").select("root", "module").distinct().orderBy("module").limit(bounds.modules), ["root", "module"]).orderBy("module", "place").collect():
        symbols.setdefault(r["module"], []).append(f"- {r['symbol'].rsplit('/', 1)[-1]} [{r['kind']}]")
    source = fingerprint(files.select("root", "path", "text"), "root", "path", "text").first()
    out = {
        "project_name": root.rstrip("/").rsplit("/", 1)[-1], "root_path": root, "source_fingerprint": source["fingerprint"] if source else None,
        "tree_lines": tree_lines(root, [r["path"] for r in files.select("path").distinct().orderBy("path").limit(bounds.paths).collect()], bounds.depth),
        "namespaces": spaces, "dependency_edges": first(dependency_edges(units).select("from", "to"), bounds.paths, "from", "to"),
        "domain_model": first(domain_model(files).select("kind", "name", "path"), bounds.paths, "kind", "name", "path"), "entry_points": [r["entry"] for r in first(entry_points(units, files), bounds.paths, "entry")],
        "projection_profile": "summary", "recommended_projection_profile": "selection",
    }
    # the headings are fixed values
    text = [f"# Code Context: {out['project_name']}", "", f"- fingerprint: {out['source_fingerprint']}", "", "## Tree", "```text", *out["tree_lines"], "```", ""]
    text += [*_some("## Entry Points", [f"- {e}" for e in out["entry_points"]], bounds.entries), "", "## Namespace Categories"]
    for c in CATEGORIES:
        text += _some(f"### {c}", [f"- {s['module']}" for s in spaces if s["category"] == c], bounds.per_category)
    text += ["", *_some("## Domain Model", [f"- {d['name']} [{d['kind']}]" for d in out["domain_model"]], bounds.domain)]
    text += ["", *_some("## Dependency Graph", [f"- {e['from']} -> {e['to']}" for e in out["dependency_edges"]], bounds.edges), "", "## Namespaces"]
    for m in sorted(symbols):
        text += [f"### {m}", *symbols[m]]
    out["summary_markdown"] = "\n".join(text) + "\n"
    out["dependency_graph_dot"] = "\n".join(["digraph dependency_graph {", *(f'  "{e["from"]}" -> "{e["to"]}";' for e in out["dependency_edges"]), "}"])
    return out


def _paths(folder: str) -> dict[str, str]:
    return {k: os.path.join(folder, f"code-context.{k}") for k in ("md", "json", "dot")}


def _whole(path: str, text: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(f"{path}.part", path)


def _read(path: str) -> str | None:
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        return f.read()


def drift(outline: dict, folder: str) -> dict:
    """Whether the outline on disk is what would be written now."""
    actual = _read(_paths(folder)["md"])
    return {"stale": actual != outline["summary_markdown"], "expected_markdown": outline["summary_markdown"], "actual_markdown": actual}


def refresh(root: str, units: DataFrame, files: DataFrame, folder: str, changed_only: bool = False) -> dict:
    """Writes the outline; with ``changed_only`` not where the sources' fingerprint is that of the outline on disk."""
    at = _paths(folder)
    if changed_only and _read(at["md"]) is not None and (before := _read(at["json"])):
        now = fingerprint(files.select("root", "path", "text"), "root", "path", "text").first()
        if now and json.loads(before).get("source_fingerprint") == now["fingerprint"]:
            return {"status": "unchanged", "changed": False, "source_fingerprint": now["fingerprint"]}
    outline = artifact(root, units, files)
    _whole(at["md"], outline["summary_markdown"])
    _whole(at["dot"], outline["dependency_graph_dot"])
    write_json(at["json"], outline)
    return {"status": "refreshed", "changed": True, "source_fingerprint": outline["source_fingerprint"]}


#: The test files define no records, so the query names functions and multimethods too.
_WIDER = DOMAIN | {"(defn": "function", "(defmulti": "multimethod", "(defmethod": "method"}


def _domain(spark, d: str) -> DataFrame:
    return domain_model(scan.fallback_files(spark, d), _WIDER)


def _entries(spark, d: str) -> DataFrame:
    u = linked_units(spark, d)
    u = u.withColumn("symbol", F.when(F.col("kind") == "class", F.concat_ws("/", "module", F.lit("-main"))).otherwise(F.col("symbol")))
    return entry_points(u, scan.fallback_files(spark, d))


QUERIES = {
    "agg_29_domain_model": _domain,
    "agg_29_entry_points": _entries,
    "agg_30_dot": lambda s, d: dot_lines(dependency_edges(linked_units(s, d))),
    "agg_30_bounded_edges": lambda s, d: bounded(dependency_edges(linked_units(s, d)), F.concat(F.lit("- "), F.col("from"), F.lit(" -> "), F.col("to")), ["from", "to"], Bounds.edges),
}
_DEP = GRAPH_SQL + ', de as (select distinct root, module as "from", unnest(imports) as "to" from fl where module is not null)'
SQL = {
    "agg_29_domain_model": scan._LINES.format(language="clojure")
    + r", w as (select root, path, string_split_regex(t, '[\s\[\])]+') as w from l) select distinct root, w[2] as name, case w[1] " + " ".join(f"when '{k}' then '{v}'" for k, v in _WIDER.items()) + f" end as kind, path from w where w[2] <> '' and w[1] in ({', '.join(repr(k) for k in _WIDER)})",
    "agg_29_entry_points": GRAPH_SQL + "select distinct root, module || '/-main' as entry from cur where kind = 'class' and module is not null",
    "agg_30_dot": _DEP
    + """ select root, (row_number() over (partition by root order by "from", "to"))::int as place, '  "' || "from" || '" -> "' || "to" || '";' as line from de union all select distinct root, 0, 'digraph dependency_graph {' from de union all select root, (count(*) + 1)::int, '}' from de group by root""",
    "agg_30_bounded_edges": _DEP
    + """, o as (select *, (row_number() over (partition by root order by "from", "to"))::int as place, count(*) over (partition by root) as n from de) select root, place, case when place <= 20 then '- ' || "from" || ' -> ' || "to" else '- ... +' || (n - 20) || ' more' end as line from o where place <= 21""",
}
