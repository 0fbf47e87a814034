"""Views that give the stored tables the shape the retrieval operators read, once as DataFrames and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rookery.operators import snapshots as S
from rookery.sources.tables import table, written

UNIT = S.UNIT + ", start_line int, end_line int"
_STRINGS = ("unit_id", *S.SCALARS)


def all_units(spark, d: str) -> DataFrame:
    """The units of every snapshot that holds, with ``seq``, ``snapshot_id`` and the next snapshot's id."""
    parsed = S.parsed_units(table(spark, d, "semantic_index_snapshots"), UNIT)
    meta = S.snapshot_order(parsed.select("id", "root", "snapshot_id", "indexed_at"))
    rows = parsed.select("id", F.posexplode("units").alias("pos", "u")).join(meta, "id")
    empty = F.array().cast("array<string>")
    x = rows.select(
        "root", "seq", "snapshot_id", "next_snapshot", "pos", *[F.col(f"u.{c}").alias(c) for c in _STRINGS], *[F.coalesce(F.col(f"u.{c}"), empty).alias(c) for c in S.SETS],
        F.col("u.start_line").alias("start_line"), F.col("u.end_line").alias("end_line"),
    ).where("unit_id is not null")
    names = [c for c in x.columns if c not in ("root", "seq", "unit_id", "pos")]
    one = x.groupBy("root", "seq", "unit_id").agg(F.max_by(F.struct(*names), "pos").alias("v")).select("root", "seq", "unit_id", "v.*")
    arity = F.regexp_extract("unit_id", r"\$arity(\d+)", 1)
    return one.withColumn("method_arity", F.when(arity != "", arity.cast("int")))


def current_units(spark, d: str) -> DataFrame:
    """The units of each directory's last snapshot."""
    return all_units(spark, d).where("next_snapshot is null")


def linked_units(spark, d: str) -> DataFrame:
    """``current_units`` with links to follow, for the queries of the catalogue only.

    The stored calls and imports hardly ever name a stored unit, which would leave graph and ranking queries without rows to compare. So here
    each unit also calls its module's last symbol by its local name; each module's first unit calls the directory's first symbol by a
    dotted name and imports the directory's last module; some files lie in a test folder, and methods have a dispatch value. Queries
    over units that are extracted from files (``ext_*``) follow the files' own links."""
    u = current_units(spark, d)
    module = u.groupBy("root", "module").agg(F.min("symbol").alias("lo"), F.max("symbol").alias("hi"))
    whole = u.groupBy("root").agg(F.min(F.struct("unit_id", "symbol")).alias("first"), F.max(F.struct("unit_id", "module")).alias("last"))
    on = (u["root"] == module["root"]) & u["module"].eqNullSafe(module["module"])
    x = u.join(module, on).select(u["*"], "lo", "hi").join(whole, "root")
    head, some = F.col("symbol") == F.col("lo"), lambda *cs: F.filter(F.array(*cs), lambda c: c.isNotNull())
    local = F.regexp_replace("hi", r"^.*[/#]", "")
    dotted = F.when(head, F.regexp_replace("first.symbol", "[/#]", "."))
    place = F.ascii(F.substring(F.md5("path"), 1, 1)) % 5 == 0
    x = x.withColumns({"calls": F.concat("calls", some(local, dotted)), "imports": F.concat("imports", some(F.when(head, F.col("last.module")))), "dispatch_value": F.when(F.col("kind") == "method", F.concat(F.lit(":"), F.regexp_replace("symbol", r"^.*[/#]", "")))})
    x = x.withColumns({"path": F.when(place, F.concat(F.lit("test/"), "path")).otherwise(F.col("path")), "kind": F.when(place & (F.col("kind") == "function"), "test").otherwise(F.col("kind"))})
    return written(x.drop("lo", "hi", "first", "last"), "units")


def files(units: DataFrame) -> DataFrame:
    """root, path, language, module and the imports of a file's units."""
    return units.groupBy("root", "path").agg(F.min("language").alias("language"), F.min("module").alias("module"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("imports")))).alias("imports"))


def ranking_queries(units: DataFrame) -> DataFrame:
    """Four queries per directory: a symbol with test targets; a path with a changed span and hints; free text only; free text that names a dispatch value."""
    first, last = F.min(F.struct("unit_id", "symbol", "module", "path")), F.max(F.struct("unit_id", "symbol", "module", "path", "start_line"))
    g = units.groupBy("root").agg(first.alias("a"), last.alias("z"), F.max("symbol").alias("far"), F.min("dispatch_value").alias("disp") if "dispatch_value" in units.columns else F.first(F.lit("")).alias("disp"))
    none, strings = F.array().cast("array<string>"), "array<string>"
    local = F.regexp_replace("z.symbol", r"^.*[/#]", "")
    span = "array<struct<path:string,start_line:int,end_line:int>>"
    spans = F.array(F.struct(F.col("z.path").alias("path"), (F.col("z.start_line") + 1).alias("start_line"), (F.col("z.start_line") + 9).alias("end_line"))).cast(span)
    q = lambda n, **kw: F.struct(
        F.concat("root", F.lit(f"#{n}")).alias("query_id"),
        *[kw.get(c, none).cast(strings).alias(c) for c in ("symbols", "paths", "modules", "tests", "prefixes", "languages", "preferred_paths", "preferred_modules", "suspected")],
        kw.get("spans", F.array().cast(span)).alias("spans"), kw.get("details", F.lit("")).alias("details"), F.lit(kw.get("include_tests", False)).alias("include_tests"), F.lit(kw.get("definitions", False)).alias("definitions"),
    )
    one = q(1, symbols=F.array("a.symbol"), tests=F.array("z.path"), include_tests=True, details=F.lit("callers and related tests"))
    two = q(2, paths=F.array("z.path"), modules=F.array(F.coalesce("a.module", F.lit("?"))), spans=spans, preferred_paths=F.array("a.path"), preferred_modules=F.array(F.coalesce("z.module", F.lit("?"))), suspected=F.array("far"), definitions=True, prefixes=F.array(F.lit("src/"), F.lit("app/"), F.lit("lib/"), F.lit("core/")))
    three = q(3, details=F.concat(F.lit("where is "), local, F.lit(" used")))
    four = q(4, details=F.concat(F.lit("who handles "), F.coalesce("disp", F.lit("")), F.lit(" now")))
    return g.select("root", F.inline(F.array(one, two, three, four)))


_CAST = ", ".join(f"json_extract_string(u, '$.{c}') as {c}" for c in _STRINGS) + ", " + ", ".join(f"coalesce(try_cast(json_extract(u, '$.{c}') as varchar[]), []) as {c}" for c in S.SETS)
UNITS_SQL = (
    S.P3_SQL[: S.P3_SQL.index("raw as (")]
    + """raw as (select root, snapshot_id, seq, next_snapshot,
        unnest(case json_type(payload, '$.units') when 'OBJECT' then json_extract(payload, '$.units.*') when 'ARRAY' then json_extract(payload, '$.units[*]') else [] end) as u from ord),
allu as (select distinct root, snapshot_id, seq, next_snapshot, """
    + _CAST
    + """, json_extract_string(u, '$.start_line')::int as start_line, json_extract_string(u, '$.end_line')::int as end_line, nullif(regexp_extract(json_extract_string(u, '$.unit_id'), '\\$arity(\\d+)', 1), '')::int as method_arity from raw),
cur0 as (select *, min(symbol) over m as lo, max(symbol) over m as hi, min(row(unit_id, symbol)) over r as fst, max(row(unit_id, module)) over r as lst, ascii(md5(path)[1]) % 5 = 0 as place
    from allu where next_snapshot is null window m as (partition by root, module), r as (partition by root)),
cur as (select * replace (list_concat(calls, list_filter([regexp_replace(hi, '^.*[/#]', ''), case when symbol = lo then regexp_replace(fst[2], '[/#]', '.', 'g') end], lambda x: x is not null)) as calls,
    list_concat(imports, list_filter([case when symbol = lo then lst[2] end], lambda x: x is not null)) as imports,
    case when place then 'test/' || path else path end as path, case when place and kind = 'function' then 'test' else kind end as kind), case when kind = 'method' then ':' || regexp_replace(symbol, '^.*[/#]', '') end as dispatch_value from cur0)
"""
)
QUERIES_SQL = """, qa as (select root, min(row(unit_id, symbol, module, path)) as a, max(row(unit_id, symbol, module, path, start_line)) as z, max(symbol) as far, min(dispatch_value) as disp from cur group by root),
qb as (select root, a[2] as a_symbol, a[3] as a_module, a[4] as a_path, z[2] as z_symbol, z[3] as z_module, z[4] as z_path, z[5] as z_start, far, disp from qa),
q as (select root, root || '#1' as query_id, [a_symbol] as symbols, []::varchar[] as paths, []::varchar[] as modules, [z_path] as tests, []::varchar[] as prefixes, []::varchar[] as preferred_paths, []::varchar[] as preferred_modules, []::varchar[] as suspected,
    null::varchar as span_path, 0 as span_start, 0 as span_end, 'callers and related tests' as details, true as include_tests, false as definitions from qb
  union all select root, root || '#2', [], [z_path], [coalesce(a_module, '?')], [], ['src/', 'app/', 'lib/', 'core/'], [a_path], [coalesce(z_module, '?')], [far], z_path, z_start + 1, z_start + 9, '', false, true from qb
  union all select root, root || '#3', [], [], [], [], [], [], [], [], null, 0, 0, 'where is ' || regexp_replace(z_symbol, '^.*[/#]', '') || ' used', false, false from qb
  union all select root, root || '#4', [], [], [], [], [], [], [], [], null, 0, 0, 'who handles ' || coalesce(disp, '') || ' now', false, false from qb)
"""
