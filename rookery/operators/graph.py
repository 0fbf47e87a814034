"""Call-graph resolution and what is read from it.

Units become addressable tokens, calls become expanded tokens, and both meet in one equi-join per directory. Of several
candidates the narrowing keeps the best kind: owner, then arity, then same file, same module, superclass, imports. Each step keeps
all if it would keep none. The steps are flags and window maxima over (caller, token), so they share one partitioning and
no step joins again. The caller itself may win the narrowing; the edge is then dropped, not passed on.

All frames are keyed by ``root``: many directories are resolved in one job. Null modules equal each other. Units without
symbol have no tokens; blank tokens and calls are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.plans.views import UNITS_SQL, linked_units, files
from rookery.sources.tables import checkpointed

_EMPTY = "array<string>"


def _both_cases(a: Column) -> Column:
    return F.array_distinct(F.filter(F.concat(a, F.transform(a, F.lower)), lambda t: t.isNotNull() & (F.trim(t) != "")))


def _tail(t: Column) -> Column:
    return F.regexp_replace(t, r"^.*[./#]", "")


def symbol_tokens(s: Column) -> Column:
    """The tokens a symbol answers to: itself, its name, prefix and name, class and name, tails, all also in lower case."""
    head = lambda sep: F.substring_index(s, sep, 1)
    rest = lambda sep: F.expr(f"substring(symbol, instr(symbol, '{sep}') + 1)")
    none = F.array().cast(_EMPTY)
    slash = F.when(F.contains(s, F.lit("/")), F.array(rest("/"), F.when((head("/") != "") & (rest("/") != ""), F.concat(head("/"), F.lit("."), rest("/"))))).otherwise(none)
    cls = F.substring_index(head("#"), ".", -1)
    hash_ = F.when(
        F.contains(s, F.lit("#")),
        F.array(rest("#"), F.when((cls != "") & (rest("#") != ""), F.concat(cls, F.lit("#"), rest("#"))), F.when((head("#") != "") & (rest("#") != ""), F.concat(head("#"), F.lit("."), rest("#")))),
    ).otherwise(none)
    base = F.filter(F.concat(F.array(s), slash, hash_), lambda t: t.isNotNull())
    return _both_cases(F.concat(base, F.transform(base, _tail)))


def token_index(units: DataFrame, *more: Column) -> DataFrame:
    """(root, token, target) of all addressable tokens, and ``more`` columns of the units.

    Units with a dispatch value answer to their own ``call_tokens`` only; others to those and to their symbol's tokens."""
    has, tokens = set(units.columns), symbol_tokens(F.col("symbol"))
    if "dispatch_value" in has:
        tokens = F.when(F.col("dispatch_value").isNull(), tokens).otherwise(F.array().cast(_EMPTY))
    if "call_tokens" in has:
        tokens = F.array_union(tokens, _both_cases(F.coalesce("call_tokens", F.array().cast(_EMPTY))))
    return units.where("symbol is not null").select("root", F.explode(tokens).alias("token"), F.col("unit_id").alias("target"), *more)


def call_tokens(units: DataFrame, *more: Column) -> DataFrame:
    """(root, caller, call, token): each call as written and the tokens it may stand for, and ``more`` columns of the callers."""
    names = units.select(*more).columns
    calls = units.select("root", F.col("unit_id").alias("caller"), "module", "symbol", *more, F.explode(F.array_distinct("calls")).alias("call")).where("call is not null and trim(call) <> ''")
    scopes = F.array_distinct(F.filter(F.array("module", F.substring_index("symbol", "/", 1), F.substring_index("symbol", "#", 1)), lambda x: x.isNotNull() & (F.trim(x) != "")))
    plain = ~F.col("call").rlike("[./#]")
    scoped = F.when(plain, F.flatten(F.transform(scopes, lambda s: F.array(*[F.concat(s, F.lit(sep), F.col("call")) for sep in "/.#"])))).otherwise(F.array().cast(_EMPTY))
    return calls.select("root", "caller", "call", *names, F.explode(_both_cases(F.concat(F.array("call", _tail(F.col("call"))), scoped))).alias("token"))


def candidates(units: DataFrame) -> DataFrame:
    """Distinct (root, caller, call, target)."""
    return call_tokens(units).join(token_index(units), ["root", "token"]).select("root", "caller", "call", "target").distinct()


def _scope(symbol: Column) -> Column:
    return F.lower(F.when(F.contains(symbol, F.lit("/")), F.substring_index(symbol, "/", 1)).when(F.contains(symbol, F.lit("#")), F.substring_index(symbol, "#", 1)))


def _owner(call: Column) -> Column:
    c = F.when(F.contains(call, F.lit("#")), F.substring_index(call, "#", 1)).when(F.contains(call, F.lit("/")), F.substring_index(call, "/", 1)).when(F.contains(call, F.lit(".")), F.regexp_replace(call, r"\.[^.]*$", ""))
    return F.lower(c)


def superclass_chain(units: DataFrame) -> DataFrame:
    """(root, module, super) of all superclass modules reached from a module, in lower case; cycles end by the distinct.

    Paths double every round, so a chain of n levels takes about log2(n) of them."""
    step = units.where("module is not null and superclass_module is not null").select("root", F.lower("module").alias("module"), F.lower("superclass_module").alias("super")).distinct()
    reached = checkpointed(step)
    n = reached.count()
    while True:
        more = reached.alias("a").join(reached.alias("b"), (F.col("a.root") == F.col("b.root")) & (F.col("a.super") == F.col("b.module"))).select("a.root", "a.module", "b.super")
        reached = checkpointed(reached.unionByName(more).distinct())
        before, n = n, reached.count()
        if n == before:
            return reached


def priority_select(rows: DataFrame, group: list[str], flags: list[str]) -> DataFrame:
    """Successive filters that never empty a group: rows with the flag, or all where none has it."""
    w = Window.partitionBy(*group)
    for f in flags:
        rows = rows.withColumn("_any", F.max(f).over(w)).where(F.col(f) | ~F.col("_any")).drop("_any")
    return rows


def resolved(units: DataFrame) -> DataFrame:
    """(root, caller, call, target) after narrowing, self-targets included.

    Optional columns of ``units`` are used where present: call_arity_by_token (map) and superclass_module."""
    has = set(units.columns)
    imports = files(units).select("root", "path", F.col("imports").alias("_imports"))
    callers = units.join(imports, ["root", "path"], "left")
    t_cols = [F.col(c).alias(f"t_{n}") for c, n in (("path", "path"), ("module", "module"), ("symbol", "symbol"), ("method_arity", "arity"))]
    c_cols = [F.col("path").alias("c_path"), F.col("module").alias("c_module"), F.col("_imports").alias("c_imports"), *[F.col(c).alias(f"c_{c}") for c in ("call_arity_by_token", "superclass_module") if c in has]]
    calls, tokens = call_tokens(callers, *c_cols), token_index(units, *t_cols)
    settled, calls = _near(calls, tokens, has)
    # both sides carry what the narrowing asks for, so tokens are the only join; all later steps share one partitioning by call
    met = calls.join(tokens, ["root", "token"]).drop("token")
    x = met.repartition("root", "caller", "call").dropDuplicates(["root", "caller", "call", "target"])
    own, scope, module = _owner(F.col("call")), _scope(F.col("t_symbol")), F.lower("t_module")
    dotted = lambda s: F.coalesce(F.endswith(s, F.concat(F.lit("."), own)), F.lit(False))
    yes = lambda b: F.coalesce(b, F.lit(False))
    owner_ok = yes(own == "") | own.isNull() | yes(own == scope) | yes(own == module) | yes(own == F.substring_index(scope, ".", -1)) | dotted(scope) | dotted(module)
    near = F.col("t_path").eqNullSafe(F.col("c_path")) | F.col("t_module").eqNullSafe(F.col("c_module"))
    prefixes = F.array_distinct(F.flatten(F.transform("c_imports", lambda i: _import_prefixes(i))))
    raw_scope, raw_module = F.when(F.contains("t_symbol", F.lit("/")), F.substring_index("t_symbol", "/", 1)).when(F.contains("t_symbol", F.lit("#")), F.substring_index("t_symbol", "#", 1)), F.col("t_module")
    imported = F.exists(F.coalesce(prefixes, F.array().cast(_EMPTY)), lambda p: yes(p == raw_scope) | yes(p == raw_module) | yes(F.startswith(raw_scope, F.concat(p, F.lit(".")))) | yes(F.startswith(raw_module, F.concat(p, F.lit(".")))))
    arity_ok = F.lit(True)
    if "call_arity_by_token" in has:
        known = F.coalesce(F.try_element_at("c_call_arity_by_token", F.col("call")), F.try_element_at("c_call_arity_by_token", _tail(F.col("call"))))
        arity_ok = F.size(F.coalesce(known, F.array().cast("array<int>"))).eqNullSafe(0) | F.col("t_arity").isNull() | yes(F.array_contains(known, F.col("t_arity")))
    inherits = F.lit(False)
    if "superclass_module" in has:
        chain = superclass_chain(units).groupBy("root", "module").agg(F.collect_set("super").alias("supers")).withColumnRenamed("module", "lower_module")
        x = x.withColumn("lower_module", F.lower("c_module")).join(chain, ["root", "lower_module"], "left")
        inherits = F.exists(F.coalesce("supers", F.array().cast(_EMPTY)), lambda s: yes(s == scope) | yes(s == module) | yes(F.endswith(scope, F.concat(F.lit("."), s))) | yes(F.endswith(module, F.concat(F.lit("."), s))))
    group = ["root", "caller", "call"]
    x = x.select(
        *group, "target", (~F.col("call").rlike("[./#]") | owner_ok).alias("f_owner"), F.when(own == "this", near).when(own == "super", inherits).otherwise(F.lit(True)).alias("f_local"), arity_ok.alias("f_arity"),
        F.col("t_path").eqNullSafe(F.col("c_path")).alias("f_path"), F.col("t_module").eqNullSafe(F.col("c_module")).alias("f_module"), inherits.alias("f_super"), imported.alias("f_import"),
    )
    w = Window.partitionBy(*group)
    x = x.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("by_owner", F.max("f_owner").over(w))
    x = x.withColumn("f_first", (F.col("n") == 1) | F.when(F.col("by_owner"), F.col("f_owner")).otherwise(F.col("f_local")))
    x = priority_select(x, group, ["f_first", "f_arity"])
    for f in ("f_path", "f_module", "f_super", "f_import"):
        x = x.withColumn(f"any_{f}", F.max(f).over(w))
    best = F.when(F.col("any_f_path"), F.col("f_path")).when(F.col("any_f_module"), F.col("f_module")).when(F.col("any_f_super"), F.col("f_super")).when(F.col("any_f_import"), F.col("f_import")).otherwise(F.lit(True))
    return x.where(best).select(*group, "target").unionByName(settled)


def _near(calls: DataFrame, tokens: DataFrame, has: set[str]) -> tuple[DataFrame, DataFrame]:
    """(root, caller, call, target) of the calls that their own file or module settles, and the other calls.

    A call by a bare name whose arity is not known is settled by the targets in the caller's file, else by those in its module, whatever else there is. So
    these are joined by (token, file) and (token, module); a frequent name meets its local targets only, not all of the directory's."""
    group, mark = ["root", "caller", "call"], F.lit("\0")
    bare = ~F.col("call").rlike("[./#]")
    if "call_arity_by_token" in has:
        known = F.coalesce(F.try_element_at("c_call_arity_by_token", F.col("call")), F.try_element_at("c_call_arity_by_token", _tail(F.col("call"))))
        bare = bare & (F.size(F.coalesce(known, F.array().cast("array<int>"))) == 0)
    level = lambda side: F.inline(F.array(*[F.struct(F.lit(i).alias("level"), F.coalesce(f"{side}_{c}", mark).alias("key")) for i, c in enumerate(("path", "module"))]))
    met = calls.where(bare).select(*group, "token", level("c")).join(tokens.select("root", "token", "target", level("t")), ["root", "token", "level", "key"])
    met = met.repartition(*group).groupBy(*group, "target").agg(F.min("level").alias("level"))
    near = met.withColumn("_first", F.min("level").over(Window.partitionBy(*group))).where("level = _first").select(*group, "target")
    return near, calls.join(near.select(*group).distinct(), group, "left_anti")


def _import_prefixes(i: Column) -> Column:
    base = F.regexp_replace(i, r"\.\*$", "")
    return F.filter(F.array(base, F.when(base.rlike(r"\.[A-Za-z_][A-Za-z0-9_]*$"), F.regexp_replace(base, r"\.[^.]*$", ""))), lambda p: p.isNotNull() & (F.trim(p) != ""))


def call_edges(units: DataFrame) -> DataFrame:
    """Distinct (root, caller, callee) without self-edges; the callers index is this frame read the other way round.

    Where ``units`` has form_operator and generated_calls, calls of a macro also reach what the macro generates."""
    direct = resolved(units)
    if {"form_operator", "generated_calls"} <= set(units.columns):
        direct = direct.unionByName(_through_macros(units, direct))
    return direct.where("caller <> target").select("root", "caller", F.col("target").alias("callee")).distinct()


def _through_macros(units: DataFrame, direct: DataFrame) -> DataFrame:
    """Targets of generated calls of macros that are called, followed through macros that generate macros.

    Which macros a macro reaches is closed by doubling the paths; calls and ends are joined to that once."""
    macros = units.where("form_operator = 'defmacro'")
    ids = macros.select("root", F.col("unit_id").alias("target"), F.lit(True).alias("is_macro"))
    step = resolved(units.withColumn("calls", F.when(F.col("form_operator") == "defmacro", F.col("generated_calls")).otherwise(F.array().cast(_EMPTY))))
    step = step.select("root", F.col("caller").alias("macro"), "target").distinct()
    reach = direct.join(ids, ["root", "target"]).select("root", "caller", "call", F.col("target").alias("macro")).distinct()
    inner = step.join(ids, ["root", "target"]).select("root", "macro", F.col("target").alias("inner"))
    own = macros.select("root", F.col("unit_id").alias("macro"), F.col("unit_id").alias("inner"))
    reached = checkpointed(inner.unionByName(own).distinct())
    n = reached.count()
    while True:
        more = reached.alias("a").join(reached.alias("b"), (F.col("a.root") == F.col("b.root")) & (F.col("a.inner") == F.col("b.macro"))).select("a.root", "a.macro", "b.inner")
        reached = checkpointed(more.distinct())  # every macro reaches itself, so no path is lost
        before, n = n, reached.count()
        if n == before:
            break
    ends = step.join(ids, ["root", "target"], "left_anti").select("root", F.col("macro").alias("inner"), "target")
    ends = reached.join(ends, ["root", "inner"]).select("root", "macro", "target").distinct()
    return reach.join(ends, ["root", "macro"]).select("root", "caller", "call", "target").distinct()


def neighbours(edges: DataFrame, units: DataFrame, callers: bool = True) -> DataFrame:
    """Callers (or callees) of each unit with their place, in the order of path and start line."""
    a, b = ("callee", "caller") if callers else ("caller", "callee")
    u = units.select("root", F.col("unit_id").alias("neighbour"), "path", "symbol", "start_line")
    x = edges.select("root", F.col(a).alias("unit_id"), F.col(b).alias("neighbour")).join(u, ["root", "neighbour"])
    return x.withColumn("place", F.row_number().over(Window.partitionBy("root", "unit_id").orderBy("path", "start_line", "neighbour")))


def module_dependents(units: DataFrame) -> DataFrame:
    """(root, imported, module) of files that name a module."""
    return files(units).where("module is not null").select("root", F.explode("imports").alias("imported"), "module").distinct()


def is_test() -> Column:
    return F.coalesce(F.col("kind") == "test", F.lit(False)) | F.contains("path", F.lit("/test/"))


def test_targets(units: DataFrame) -> DataFrame:
    """(root, module, test_path): test files and the modules they aim at: their imports and their own module without the test suffix."""
    t = files(units).where("path like 'test/%' or path like '%/test/%' or path like '%/tests/%'")
    bare = F.regexp_replace("module", r"[-_.]?(test|spec)s?$", "")
    return t.select("root", F.explode(F.array_distinct(F.concat("imports", F.filter(F.array(bare), lambda m: m.isNotNull() & (m != ""))))).alias("module"), F.col("path").alias("test_path")).distinct()


def impact(selected: DataFrame, units: DataFrame, edges: DataFrame, limit: int = 12) -> DataFrame:
    """(query_id, hint, value, place): callers, dependents, related tests and risky neighbours of the selected units.

    ``selected`` has query_id, root, unit_id, path, module. Lists are cut at ``limit`` in the order of their values."""
    s = selected.select("query_id", "root", "unit_id", "path", "module")
    u = units.select("root", F.col("unit_id").alias("o_id"), F.col("path").alias("o_path"), F.col("symbol").alias("o_symbol"), F.col("module").alias("o_module"), is_test().alias("o_test"))
    name = F.concat("o_path", F.lit("::"), "o_symbol")
    callers = s.join(edges.select("root", F.col("callee").alias("unit_id"), F.col("caller").alias("o_id")), ["root", "unit_id"]).join(u, ["root", "o_id"])
    modules = s.where("module is not null").select("query_id", "root", "module").distinct()
    dependents = modules.join(module_dependents(units).select("root", F.col("imported").alias("module"), F.col("module").alias("value")), ["root", "module"])
    targets = test_targets(units)
    linked = modules.join(targets, ["root", "module"]).select("query_id", "root", F.col("test_path").alias("o_path"))
    own = s.select("query_id", "root", F.col("unit_id").alias("o_id")).unionByName(callers.select("query_id", "root", "o_id")).join(u.where("o_test"), ["root", "o_id"]).select("query_id", "root", "o_path")
    near = modules.join(u.where("o_test").withColumnRenamed("o_module", "module"), ["root", "module"]).select("query_id", "root", "o_path")
    linked = linked.join(u.where("o_test").select("root", "o_path").distinct(), ["root", "o_path"]).select("query_id", "root", "o_path")
    risky = s.join(u.withColumn("path", F.col("o_path")), ["root", "path"]).where("o_id <> unit_id")
    h = lambda df, hint, v: df.select("query_id", F.lit(hint).alias("hint"), v.alias("value"))
    x = h(callers, "callers", name).unionByName(h(dependents, "dependents", F.col("value"))).unionByName(h(own.unionByName(near).unionByName(linked), "related_tests", F.col("o_path"))).unionByName(h(risky, "risky_neighbors", name)).distinct()
    return x.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "hint").orderBy("value"))).where(F.col("place") <= limit)


def _first_units(spark, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    u = linked_units(spark, d)
    pick = u.groupBy("root").agg(F.max(F.struct("unit_id", "path", "module")).alias("s")).select(F.col("root").alias("query_id"), "root", "s.unit_id", "s.path", "s.module")
    return pick, u, call_edges(u)


QUERIES = {
    "join_01_token_index": lambda s, d: token_index(linked_units(s, d)).groupBy("root", "token").agg(F.count(F.lit(1)).alias("n_targets")),
    "join_03_candidates": lambda s, d: candidates(linked_units(s, d)),
    "join_04_narrowed": lambda s, d: resolved(linked_units(s, d)),
    "join_05_call_edges": lambda s, d: call_edges(linked_units(s, d)),
    "join_06_callees": lambda s, d: neighbours(call_edges(u := linked_units(s, d)), u, callers=False).select("root", "unit_id", "neighbour", "path", "place"),
    "join_09_dependents": lambda s, d: module_dependents(linked_units(s, d)),
    "join_10_test_targets": lambda s, d: test_targets(linked_units(s, d)),
    "join_17_impact": lambda s, d: impact(*_first_units(s, d)),
    "join_18_callers": lambda s, d: neighbours(call_edges(u := linked_units(s, d)), u).select("root", "unit_id", "neighbour", "path", "place"),
}

_LC = lambda a: f"list_distinct(list_filter(list_concat({a}, list_transform({a}, lambda x: lower(x))), lambda x: x is not null and trim(x) <> ''))"
_T = lambda x: f"regexp_replace({x}, '^.*[./#]', '')"
_REST = lambda sep: f"substr(symbol, instr(symbol, '{sep}') + 1)"
_HEAD = lambda sep: f"split_part(symbol, '{sep}', 1)"
GRAPH_SQL = (
    UNITS_SQL
    + f""", tk0 as (select root, unit_id, list_filter(list_concat([symbol],
      case when contains(symbol, '/') then [{_REST('/')}, case when {_HEAD('/')} <> '' and {_REST('/')} <> '' then {_HEAD('/')} || '.' || {_REST('/')} end] else [] end,
      case when contains(symbol, '#') then [{_REST('#')}, case when split_part({_HEAD('#')}, '.', -1) <> '' and {_REST('#')} <> '' then split_part({_HEAD('#')}, '.', -1) || '#' || {_REST('#')} end, case when {_HEAD('#')} <> '' and {_REST('#')} <> '' then {_HEAD('#')} || '.' || {_REST('#')} end] else [] end),
      lambda x: x is not null) as base from cur where symbol is not null and dispatch_value is null),
tk as (select root, unit_id as target, unnest({_LC(f"list_concat(base, list_transform(base, lambda x: {_T('x')}))")}) as token from tk0),
cl0 as (select root, unit_id as caller, module, symbol, unnest(list_distinct(calls)) as call from cur),
cl1 as (select *, list_distinct(list_filter([module, split_part(symbol, '/', 1), split_part(symbol, '#', 1)], lambda x: x is not null and trim(x) <> '')) as scopes from cl0 where trim(call) <> ''),
cl2 as (select *, list_concat([call, {_T('call')}], case when regexp_matches(call, '[./#]') then [] else flatten(list_transform(scopes, lambda s: [s || '/' || call, s || '.' || call, s || '#' || call])) end) as ts from cl1),
cl as (select root, caller, call, unnest({_LC('ts')}) as token from cl2),
cand as (select distinct cl.root, caller, call, target from cl join tk using (root, token)),
fl as (select root, path, min(language) as language, min(module) as module, list_sort(list_distinct(flatten(list(imports)))) as imports from cur group by root, path),
cx as (select cand.*, t.path as t_path, t.module as t_module, t.symbol as t_symbol, c.path as c_path, c.module as c_module,
    list_distinct(list_filter(flatten(list_transform(fl.imports, lambda i: [regexp_replace(i, '\\.\\*$', ''), case when regexp_matches(regexp_replace(i, '\\.\\*$', ''), '\\.[A-Za-z_][A-Za-z0-9_]*$') then regexp_replace(regexp_replace(i, '\\.\\*$', ''), '\\.[^.]*$', '') end])), lambda p: p is not null and trim(p) <> '')) as pre,
    lower(case when contains(call, '#') then split_part(call, '#', 1) when contains(call, '/') then split_part(call, '/', 1) when contains(call, '.') then regexp_replace(call, '\\.[^.]*$', '') end) as own,
    case when contains(t.symbol, '/') then split_part(t.symbol, '/', 1) when contains(t.symbol, '#') then split_part(t.symbol, '#', 1) end as scope
  from cand join cur t on t.root = cand.root and t.unit_id = target join cur c on c.root = cand.root and c.unit_id = caller left join fl on fl.root = cand.root and fl.path = c.path),
fg as (select root, caller, call, target, not regexp_matches(call, '[./#]') or own is null or own = '' or coalesce(own = lower(scope), false) or coalesce(own = lower(t_module), false) or coalesce(own = split_part(lower(scope), '.', -1), false)
      or coalesce(ends_with(lower(scope), '.' || own), false) or coalesce(ends_with(lower(t_module), '.' || own), false) as f_owner,
    case own when 'this' then t_path is not distinct from c_path or t_module is not distinct from c_module when 'super' then false else true end as f_local,
    t_path is not distinct from c_path as f_path, t_module is not distinct from c_module as f_module,
    len(list_filter(coalesce(pre, []), lambda p: coalesce(p = scope, false) or coalesce(p = t_module, false) or coalesce(starts_with(scope, p || '.'), false) or coalesce(starts_with(t_module, p || '.'), false))) > 0 as f_import from cx),
n1 as (select *, count(*) over g = 1 or case when bool_or(f_owner) over g then f_owner else f_local end as f1 from fg window g as (partition by root, caller, call)),
n2 as (select * from n1 qualify f1 or not bool_or(f1) over (partition by root, caller, call)),
res as (select root, caller, call, target from n2 window g as (partition by root, caller, call) qualify case when bool_or(f_path) over g then f_path when bool_or(f_module) over g then f_module when bool_or(f_import) over g then f_import else true end),
edge as (select distinct root, caller, target as callee from res where caller <> target),
dep as (select distinct root, unnest(imports) as imported, module from fl where module is not null),
tt as (select distinct root, unnest(list_distinct(list_concat(imports, list_filter([regexp_replace(module, '[-_.]?(test|spec)s?$', '')], lambda m: m is not null and m <> '')))) as module, path as test_path from fl where path like 'test/%' or path like '%/test/%' or path like '%/tests/%')
"""
)
_NB = "select root, unit_id, neighbour, path, (row_number() over (partition by root, unit_id order by path, start_line, neighbour))::int as place from (select e.root, e.{a} as unit_id, e.{b} as neighbour, path, start_line from edge e join cur u on u.root = e.root and u.unit_id = e.{b})"
IMPACT_SQL = """, us as (select *, coalesce(kind = 'test', false) or contains(path, '/test/') as is_test from cur),
ic as (select s.query_id, s.root, u.unit_id as o_id, u.path || '::' || u.symbol as value from sel s join edge e on e.root = s.root and e.callee = s.unit_id join cur u on u.root = s.root and u.unit_id = e.caller),
im as (select distinct query_id, root, module from sel where module is not null),
hv as (select query_id, 'callers' as hint, value from ic
  union select im.query_id, 'dependents', dep.module from im join dep on dep.root = im.root and dep.imported = im.module
  union select s.query_id, 'related_tests', u.path from sel s join us u on u.root = s.root and u.unit_id = s.unit_id where is_test
  union select ic.query_id, 'related_tests', u.path from ic join us u on u.root = ic.root and u.unit_id = ic.o_id where is_test
  union select im.query_id, 'related_tests', u.path from im join us u on u.root = im.root and u.module = im.module where is_test
  union select im.query_id, 'related_tests', tt.test_path from im join tt using (root, module) where exists (select 1 from us u where u.root = im.root and u.path = tt.test_path and is_test)
  union select s.query_id, 'risky_neighbors', u.path || '::' || u.symbol from sel s join cur u on u.root = s.root and u.path = s.path and u.unit_id <> s.unit_id)
select query_id, hint, value, (row_number() over (partition by query_id, hint order by value))::int as place from hv qualify place <= 12"""
SQL = {
    "join_01_token_index": GRAPH_SQL + "select root, token, count(*) as n_targets from tk group by root, token",
    "join_03_candidates": GRAPH_SQL + "select * from cand",
    "join_04_narrowed": GRAPH_SQL + "select * from res",
    "join_05_call_edges": GRAPH_SQL + "select * from edge",
    "join_06_callees": GRAPH_SQL + _NB.format(a="caller", b="callee"),
    "join_09_dependents": GRAPH_SQL + "select * from dep",
    "join_10_test_targets": GRAPH_SQL + "select * from tt",
    "join_17_impact": GRAPH_SQL + ", sel as (select root as query_id, root, s[1] as unit_id, s[2] as path, s[3] as module from (select root, max(row(unit_id, path, module)) as s from cur group by root))" + IMPACT_SQL,
    "join_18_callers": GRAPH_SQL + _NB.format(a="callee", b="caller"),
}
