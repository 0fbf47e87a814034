"""Ranking of units for batches of structured queries.

One plan answers all queries of a batch. Evidence is a set of reasons (query, unit, code, points): structural seeds, lexical seeds for
queries without any, graph neighbours up to two (three) hops, boosts. As a code's points never grow with depth, the maximum by
(unit, code) equals the step-by-step rule. Reasons are summed by tier, capped, banded and cut to the best 20 by one top-k window.

Queries are turned into keys that meet units by equality: symbols, paths, spans, tests and preferred paths by (root, symbol or path),
modules and suspected symbols by containment among the directory's distinct modules and symbols, then by equality. A frontier is
reduced to its distinct modules and paths, with their numbers of units, before it meets the units there: each hop is linear in the
frontier and in what it reaches. Which units a query may see is asked of the pairs that have evidence, not of all. Only free text
(and dispatch values) is compared with all units of a directory, for the queries that have some.

Null modules match nothing; unknown reasons have no points. Queries without evidence have no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.operators.graph import GRAPH_SQL, call_edges, test_targets
from rookery.plans.views import QUERIES_SQL, linked_units, ranking_queries
from rookery.sources.tables import checkpointed, written

#: Points by reason code, with the tier they count for (fixed values of the default policy).
POINTS = {
    "exact_target_resolved": (1, 140),
    "target_path_match": (1, 95),
    "diff_overlap_direct": (1, 90),
    "target_module_match": (2, 70),
    "target_test_match": (2, 50),
    "dispatch_value_match": (2, 25),
    "hint_suspected_symbol_exact": (2, 42),
    "hint_suspected_symbol_segment": (3, 18),
    "lexical_overlap": (4, 8),
    "graph_callee_neighbor": (2, 44),
    "graph_caller_neighbor": (2, 32),
    "graph_module_neighbor": (3, 18),
    "graph_path_neighbor": (3, 16),
    "graph_related_test_neighbor": (3, 28),
    "hint_preferred_path": (3, 15),
    "hint_preferred_module": (3, 10),
    "source_path_prior": (3, 6),
    "parser_fallback": (3, 0),
}
DECAY, CALLER_PENALTY = 10, 8
NO_TIER1_MAX, FALLBACK_MAX = 89, 59
BANDS = ((120, "top_authority"), (80, "useful_support"), (30, "exploratory"))
LIMIT, LEXICAL, TOKENS = 20, 6, 20


def path_class(path: Column) -> Column:
    """vendored, fixture, generated, source, test or other, in this order."""
    p = F.lower(path)
    has = lambda *xs: _any([F.contains(p, F.lit(x)) for x in xs])
    begins = lambda *xs: _any([F.startswith(p, F.lit(x)) for x in xs])
    return (
        F.when(begins(".tree-sitter-grammars/", "vendor/") | has("/vendor/", "/third_party/", "/node_modules/"), "vendored")
        .when(begins("fixtures/") | has("/fixtures/"), "fixture")
        .when(has("/generated/") | F.endswith(p, F.lit(".pb.go")) | F.endswith(p, F.lit("_pb2.py")), "generated")
        .when(begins("src/", "lib/", "app/"), "source")
        .when(begins("test/") | has("/test/", "/tests/"), "test")
        .otherwise("other")
    )


def _any(xs: list[Column]) -> Column:
    c = F.lit(False)
    for x in xs:
        c = c | F.coalesce(x, F.lit(False))
    return c


def class_rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ("source", "other", "test", "generated", "fixture", "vendored"))), c)


def symbolish(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("_"), F.lit("-"))


def lexical_tokens(details: Column) -> Column:
    """The first 20 distinct words of a free text, in lower case."""
    return F.slice(F.array_distinct(F.transform(F.regexp_extract_all(details, F.lit(r"([A-Za-z][A-Za-z0-9_\-]+)")), F.lower)), 1, TOKENS)


def may_see(test_kind: Column) -> Column:
    """Path prefixes, languages, and tests only where asked for or targeted; over joined columns of units and queries."""
    ok_path = (F.size("prefixes") == 0) | F.exists("prefixes", lambda p: F.startswith(F.col("path"), p))
    ok_lang = (F.size("languages") == 0) | F.exists("languages", lambda p: F.lower(p) == F.lower("language"))
    return ok_path & ok_lang & (F.col("include_tests") | ~test_kind | F.array_contains("tests", F.col("path")))


def is_test() -> Column:
    return F.coalesce(F.col("kind") == "test", F.lit(False)) | F.contains("path", F.lit("/test/"))


UNIT = ("unit_id", "kind", "symbol", "path", "module", "language", "signature", "parser_mode", "start_line", "end_line")
LIMITS = ("prefixes", "languages", "include_tests", "tests")


def visible(units: DataFrame, queries: DataFrame) -> DataFrame:
    """All units each query may see: for free text, and where the whole scope is asked for."""
    extra = [c for c in ("summary", "dispatch_value") if c in units.columns]
    x = units.select("root", *UNIT, *extra).join(queries, "root")
    return x.where(may_see(is_test())).withColumn("class", path_class(F.col("path")))


def seen(pairs: DataFrame, units: DataFrame, queries: DataFrame) -> DataFrame:
    """The (query_id, root, unit_id) pairs whose unit the query may see; other columns stay."""
    u = units.select("root", "unit_id", F.col("path"), F.col("kind"), F.col("language"))
    x = pairs.join(u, ["root", "unit_id"]).join(queries.select("query_id", *LIMITS), "query_id")
    return x.where(may_see(is_test())).select(*pairs.columns)


def unit_keys(units: DataFrame) -> DataFrame:
    """(root, unit_id, field, key): what a unit can be named by: its symbol, path, module and, outside of vendored, fixture and generated paths, its name."""
    k = lambda field, c: F.struct(F.lit(field).alias("field"), c.alias("key"))
    own = ~path_class(F.col("path")).isin("vendored", "fixture", "generated")
    after = F.when(F.contains("symbol", F.lit("/")), symbolish(F.expr("substring(symbol, instr(symbol, '/') + 1)")))
    keys = F.array(k("symbol", F.col("symbol")), k("path", F.col("path")), k("module", F.col("module")), k("name", F.when(own, symbolish(F.coalesce("symbol", F.lit(""))))), k("name", F.when(own, after)))
    return units.select("root", "unit_id", F.inline(F.array_distinct(F.filter(keys, lambda x: x["key"].isNotNull()))))


#: Query field, what of a unit it names, and the reason; the second list names parts of it.
_WHOLE = (("symbols", "symbol", "exact_target_resolved"), ("paths", "path", "target_path_match"), ("tests", "path", "target_test_match"), ("preferred_paths", "path", "hint_preferred_path"), ("suspected", "name", "hint_suspected_symbol_exact"))
_PARTS = (("modules", "module", "target_module_match"), ("preferred_modules", "module", "hint_preferred_module"), ("suspected", "name", "hint_suspected_symbol_segment"))


def _asked(queries: DataFrame, fields: tuple) -> DataFrame:
    """(query_id, root, field, key, code) of what the queries name."""
    named = lambda c, field, code: F.transform(F.filter(c, lambda v: v.isNotNull()), lambda v: F.struct(F.lit(field).alias("field"), (symbolish(v) if field == "name" else v).alias("key"), F.lit(code).alias("code")))
    return queries.select("query_id", "root", F.inline(F.array_distinct(F.concat(*[named(F.col(c), field, code) for c, field, code in fields]))))


def dispatch_pairs(queries: DataFrame, units: DataFrame) -> DataFrame:
    """(query_id, root, unit_id, code): units whose dispatch value contains a word of the query's free text."""
    u = units.where("dispatch_value <> ''").select("root", "unit_id", F.lower("dispatch_value").alias("value"))
    q = queries.select("query_id", "root", F.explode(lexical_tokens(F.col("details"))).alias("word"))
    return u.join(q, "root").where(F.contains("value", F.col("word"))).select("query_id", "root", "unit_id", F.lit("dispatch_value_match").alias("code"))


def named_units(units: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, root, unit_id, code) of all that the queries name and may see, structural evidence and hints.

    Parts (of modules, of suspected symbols of at least 4 characters) are looked for in a directory's distinct modules and names; then whole and partial
    names meet the units in one join. A partial hint does not count where the whole one holds."""
    ids = ["query_id", "root", "unit_id"]
    keys = unit_keys(units)
    distinct = keys.where("field in ('module', 'name')").select("root", "field", "key").distinct()
    parts = _asked(queries, _PARTS).where("field <> 'name' or length(key) >= 4").withColumnRenamed("key", "part")
    partial = distinct.join(parts, ["root", "field"]).where(F.contains("key", F.col("part"))).select("query_id", "root", "field", "key", "code")
    pairs = keys.join(_asked(queries, _WHOLE).unionByName(partial), ["root", "field", "key"]).select(*ids, "code")
    span = queries.select("query_id", "root", F.explode("spans").alias("s")).select("query_id", "root", F.col("s.path").alias("path"), F.col("s.start_line").alias("a"), F.col("s.end_line").alias("b"))
    pairs = pairs.unionByName(units.select("root", "unit_id", "path", "start_line", "end_line").join(span, ["root", "path"]).where("start_line <= b and a <= end_line").select(*ids, F.lit("diff_overlap_direct").alias("code")))
    if "dispatch_value" in units.columns:
        pairs = pairs.unionByName(dispatch_pairs(queries, units))
    codes = seen(pairs.groupBy(*ids).agg(F.collect_set("code").alias("codes")), units, queries)  # a unit has one code of a kind
    whole, part = "hint_suspected_symbol_exact", "hint_suspected_symbol_segment"
    return codes.select(*ids, F.explode(F.when(F.array_contains("codes", whole), F.array_remove("codes", part)).otherwise(F.col("codes"))).alias("code"))


def seeds(units: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, root, unit_id, code) of structural, dispatch and suspected-symbol evidence."""
    return named_units(units, queries).where("code not like 'hint_preferred%'")


def lexical_seeds(units: DataFrame, queries: DataFrame, seeded: DataFrame) -> DataFrame:
    """The best 6 units by shared words for queries without structural seeds; vendored and generated paths only where nothing else matches."""
    v = visible(units, queries.join(seeded.select("query_id").distinct(), "query_id", "left_anti"))
    has = set(v.columns)
    hay = F.lower(F.concat_ws(" ", F.coalesce("signature", F.lit("")), F.coalesce("summary", F.lit("")) if "summary" in has else F.lit(""), F.coalesce("symbol", F.lit(""))))
    x = v.withColumn("hay", hay).withColumn("words", lexical_tokens(F.col("details")))
    bonus = F.when(F.exists("words", lambda t: F.contains(F.lower("dispatch_value"), t)), 2).otherwise(0) if "dispatch_value" in has else F.lit(0)
    x = x.withColumn("hits", F.size(F.filter("words", lambda t: F.contains(F.col("hay"), t))) + bonus).where("hits > 0").withColumn("eligible", ~F.col("class").isin("vendored", "fixture", "generated"))
    x = x.withColumn("some", F.max("eligible").over(Window.partitionBy("query_id"))).where("eligible or not some")
    w = Window.partitionBy("query_id").orderBy(F.col("hits").desc(), class_rank(F.col("class")), "path", "start_line", "unit_id")
    return x.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= LEXICAL).select("query_id", "root", "unit_id", F.lit("lexical_overlap").alias("code"))


def graph_reasons(units: DataFrame, queries: DataFrame, edges: DataFrame, targets: DataFrame, first: DataFrame, depth: int = 2) -> DataFrame:
    """(query_id, root, unit_id, code, points) from up to ``depth`` hops; only call edges carry the frontier on.

    ``first``: (query_id, root, unit_id) of the seeds."""
    ids, on = ["query_id", "root", "unit_id"], ["root", "field", "key"]
    place = units.select("root", "unit_id", "path", "module")
    pair = lambda code, field, c: F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"), c.alias("key"))
    keys = units.select("root", "unit_id", F.inline(F.array(F.struct(F.lit("module").alias("field"), F.col("module").alias("key")), F.struct(F.lit("path").alias("field"), F.col("path").alias("key")))))
    way = lambda a, b, code: edges.select("root", F.col(a).alias("unit_id"), F.col(b).alias("near"), F.lit(code).alias("code"))
    links = way("caller", "callee", "graph_callee_neighbor").unionByName(way("callee", "caller", "graph_caller_neighbor")).where("near <> unit_id")
    flags = queries.select("query_id", F.when(F.col("definitions"), CALLER_PENALTY).otherwise(0).alias("less"), F.col("include_tests").alias("wants"))
    out, frontier = None, first.select(*ids).distinct()
    done = frontier
    for d in range(depth):
        points = F.create_map(*[F.lit(v) for code, (_, p) in POINTS.items() if code.startswith("graph_") for v in (code, max(0, p - DECAY * d))])
        f = frontier.join(place, ["root", "unit_id"]).join(flags, "query_id")
        worth = points[F.col("code")] - F.when(F.col("code") == "graph_caller_neighbor", F.col("less")).otherwise(0)
        linked = f.join(links, ["root", "unit_id"]).select("query_id", "root", F.col("near").alias("unit_id"), "code", worth.alias("points"))
        sources = f.select(*ids, F.inline(F.array(pair("graph_module_neighbor", "module", F.col("module")), pair("graph_path_neighbor", "path", F.col("path")))))
        aims = f.where("wants").join(targets, ["root", "module"]).select(*ids, F.lit("graph_related_test_neighbor").alias("code"), F.lit("path").alias("field"), F.col("test_path").alias("key"))
        groups = sources.unionByName(aims).where("key is not null").groupBy("query_id", "root", "code", "field", "key").agg(F.min("unit_id").alias("one"), F.max("unit_id").alias("other"))
        # a unit is reached by a source other than itself
        around = groups.join(keys, on).where("one <> other or one <> unit_id").select(*ids, "code", points[F.col("code")].alias("points"))
        hop = seen(linked.unionByName(around).groupBy(*ids, "code").agg(F.max("points").alias("points")), units, queries)
        hop = checkpointed(hop) if d + 1 < depth else hop
        out = hop if out is None else out.unionByName(hop)
        if d + 1 < depth:
            grown = hop.where("code in ('graph_callee_neighbor', 'graph_caller_neighbor')").select(*ids).distinct()
            frontier = grown.join(done, ids, "left_anti")
            if d + 2 < depth:
                frontier = checkpointed(frontier)
                done = done.unionByName(frontier)
    return out.where("points > 0")


def reasons(units: DataFrame, queries: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """All evidence (query_id, root, unit_id, code, points)."""
    ids = ["query_id", "root", "unit_id"]
    if "languages" not in queries.columns:
        queries = queries.withColumn("languages", F.array().cast("array<string>"))
    named = checkpointed(named_units(units, queries))
    base = named.where("code not like 'hint_preferred%'")
    base = checkpointed(base.unionByName(lexical_seeds(units, queries, base)))
    points = F.create_map(*[F.lit(x) for k, (_, p) in POINTS.items() for x in (k, p)])
    both = base.withColumn("points", points[F.col("code")]).unionByName(graph_reasons(units, queries, edges, test_targets(units), base, depth)).groupBy(*ids, "code").agg(F.max("points").alias("points")).where("points > 0")
    source = units.where(path_class(F.col("path")) == "source").select("root", "unit_id")
    prior = both.select(*ids).distinct().join(source, ["root", "unit_id"]).select(*ids, F.lit("source_path_prior").alias("code"))
    return both.unionByName(named.where("code like 'hint_preferred%'").unionByName(prior).withColumn("points", points[F.col("code")]))


def ranked(evidence: DataFrame, units: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The best units per query: score, tiers, band and place."""
    tier = F.create_map(*[F.lit(x) for k, (t, _) in POINTS.items() for x in (k, t)])
    t = evidence.withColumn("tier", tier[F.col("code")]).groupBy("query_id", "root", "unit_id").agg(*[F.coalesce(F.sum(F.when(F.col("tier") == i, F.col("points"))), F.lit(0)).alias(f"tier{i}") for i in (1, 2, 3, 4)], F.array_sort(F.collect_set("code")).alias("codes"))
    x = t.join(units.select("root", *UNIT), ["root", "unit_id"])
    raw = F.col("tier1") + F.col("tier2") + F.col("tier3") + F.col("tier4")
    soft = F.when(F.col("tier1") == 0, F.least(raw, F.lit(NO_TIER1_MAX))).otherwise(raw)
    x = x.withColumn("score", F.when(F.coalesce(F.col("parser_mode") == "fallback", F.lit(False)), F.least(soft, F.lit(FALLBACK_MAX))).otherwise(soft).cast("bigint")).where("score > 0")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "path", "start_line", "unit_id")
    return x.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).withColumn("rank_band", band(F.col("score")))


def band(score: Column) -> Column:
    c = F
    for least, name in BANDS:
        c = c.when(score >= least, name)
    return c.otherwise("below_threshold_noise")


def resolve(units: DataFrame, queries: DataFrame, edges: DataFrame | None = None, depth: int = 2) -> DataFrame:
    """Queries to ranked units."""
    return ranked(reasons(units, queries, edges if edges is not None else written(call_edges(units), "edges"), depth), units)


def _case(tier: bool = False) -> str:
    return "case code " + " ".join(f"when '{k}' then {t if tier else p}" for k, (t, p) in POINTS.items()) + " end"


_CLASS = """case when starts_with(lower(path), '.tree-sitter-grammars/') or starts_with(lower(path), 'vendor/') or contains(lower(path), '/vendor/') or contains(lower(path), '/third_party/') or contains(lower(path), '/node_modules/') then 'vendored'
 when starts_with(lower(path), 'fixtures/') or contains(lower(path), '/fixtures/') then 'fixture' when contains(lower(path), '/generated/') or ends_with(lower(path), '.pb.go') or ends_with(lower(path), '_pb2.py') then 'generated'
 when regexp_matches(lower(path), '^(src|lib|app)/') then 'source' when starts_with(lower(path), 'test/') or contains(lower(path), '/test/') or contains(lower(path), '/tests/') then 'test' else 'other' end"""
_SYM = lambda x: f"replace(lower({x}), '_', '-')"
_ANY = lambda a, cond: f"coalesce(len(list_filter({a}, lambda m: coalesce({cond}, false))) > 0, false)"
_EXACT = _ANY("suspected", f"{_SYM('m')} = {_SYM('symbol')} or (contains(symbol, '/') and {_SYM('m')} = {_SYM(chr(115) + 'ubstr(symbol, instr(symbol, chr(47)) + 1)')})")
_PART = _ANY("suspected", f"length(m) >= 4 and contains({_SYM('symbol')}, {_SYM('m')})")
_WORDS = "list_distinct(list_transform(regexp_extract_all(details, '[A-Za-z][A-Za-z0-9_\\-]+'), lambda t: lower(t)))"
_DISPATCH = f"coalesce(dispatch_value, '') <> '' and len(list_filter({_WORDS}, lambda t: contains(lower(dispatch_value), t))) > 0"
_HOP = lambda d, src: f"""select query_id, unit_id, code, max(points) as points from (
  select f.query_id, n.unit_id, 'graph_callee_neighbor' as code, {44 - 10 * d} as points from {src} f join v s using (query_id, unit_id) join edge e on e.root = s.root and e.caller = s.unit_id join v n on n.query_id = f.query_id and n.unit_id = e.callee where n.unit_id <> s.unit_id
  union all select f.query_id, n.unit_id, 'graph_caller_neighbor', greatest(0, {32 - 10 * d} - case when s.definitions then 8 else 0 end) from {src} f join v s using (query_id, unit_id) join edge e on e.root = s.root and e.callee = s.unit_id join v n on n.query_id = f.query_id and n.unit_id = e.caller where n.unit_id <> s.unit_id
  union all select f.query_id, n.unit_id, 'graph_module_neighbor', {18 - 10 * d} from {src} f join v s using (query_id, unit_id) join v n on n.query_id = f.query_id and n.module = s.module where n.unit_id <> s.unit_id
  union all select f.query_id, n.unit_id, 'graph_path_neighbor', {16 - 10 * d} from {src} f join v s using (query_id, unit_id) join v n on n.query_id = f.query_id and n.path = s.path where n.unit_id <> s.unit_id
  union all select f.query_id, n.unit_id, 'graph_related_test_neighbor', {28 - 10 * d} from {src} f join v s using (query_id, unit_id) join tt on tt.root = s.root and tt.module = s.module join v n on n.query_id = f.query_id and n.path = tt.test_path where n.unit_id <> s.unit_id and s.include_tests)
  where points > 0 group by all"""  # noqa: E731
RANK_SQL = (
    GRAPH_SQL
    + QUERIES_SQL
    + f""", v as (select c.root, unit_id, kind, symbol, path, module, language, signature, parser_mode, start_line, end_line, dispatch_value, q.* exclude (root), {_CLASS} as class from cur c join q on q.root = c.root
    where (len(prefixes) = 0 or len(list_filter(prefixes, lambda p: starts_with(path, p))) > 0) and (include_tests or not (coalesce(kind = 'test', false) or contains(path, '/test/')) or list_contains(tests, path))),
s0 as (select query_id, unit_id, unnest(list_filter([case when list_contains(symbols, symbol) then 'exact_target_resolved' end, case when list_contains(paths, path) then 'target_path_match' end,
    case when span_path = path and start_line <= span_end and span_start <= end_line then 'diff_overlap_direct' end, case when {_ANY('modules', 'contains(module, m)')} then 'target_module_match' end, case when list_contains(tests, path) then 'target_test_match' end, case when {_DISPATCH} then 'dispatch_value_match' end,
    case when class not in ('vendored', 'fixture', 'generated') and {_EXACT} then 'hint_suspected_symbol_exact' end,
    case when class not in ('vendored', 'fixture', 'generated') and not {_EXACT} and {_PART} then 'hint_suspected_symbol_segment' end], lambda x: x is not null)) as code from v),
lx as (select *, len(list_filter(list_distinct(list_transform(regexp_extract_all(details, '[A-Za-z][A-Za-z0-9_\\-]+'), lambda t: lower(t))), lambda t: contains(lower(coalesce(signature, '') || '  ' || coalesce(symbol, '')), t))) + case when {_DISPATCH} then 2 else 0 end as hits from v where query_id not in (select query_id from s0)),
ly as (select *, class not in ('vendored', 'fixture', 'generated') as eligible from lx where hits > 0),
lz as (select * from ly qualify eligible or not bool_or(eligible) over (partition by query_id)),
ls as (select query_id, unit_id, 'lexical_overlap' as code from lz qualify row_number() over (partition by query_id order by hits desc, list_position(['source', 'other', 'test', 'generated', 'fixture', 'vendored'], class), path, start_line, unit_id) <= 6),
s1 as (select * from s0 union all select * from ls),
f0 as (select distinct query_id, unit_id from s1),
g0 as ({_HOP(0, 'f0')}),
f1 as (select distinct g.query_id, g.unit_id from g0 g where code in ('graph_callee_neighbor', 'graph_caller_neighbor') and not exists (select 1 from f0 where f0.query_id = g.query_id and f0.unit_id = g.unit_id)),
g1 as ({_HOP(1, 'f1')}),
ev0 as (select query_id, unit_id, code, max(points) as points from (select *, {_case()} as points from s1 union all select * from g0 union all select * from g1) where points > 0 group by query_id, unit_id, code),
ev as (select * from ev0 union all select query_id, unit_id, code, {_case()} from (
    select query_id, unit_id, unnest(list_filter([case when list_contains(preferred_paths, path) then 'hint_preferred_path' end, case when {_ANY('preferred_modules', 'contains(module, m)')} then 'hint_preferred_module' end], lambda x: x is not null)) as code from v
    union all select query_id, unit_id, 'source_path_prior' from v where class = 'source' and exists (select 1 from ev0 where ev0.query_id = v.query_id and ev0.unit_id = v.unit_id))),
tr as (select query_id, unit_id, {', '.join(f'coalesce(sum(points) filter (tier = {i}), 0)::bigint as tier{i}' for i in (1, 2, 3, 4))}, list_sort(list(code)) as codes from (select *, {_case(True)} as tier from ev) group by query_id, unit_id),
sc0 as (select tr.*, v.root, path, module, symbol, kind, language, parser_mode, start_line, end_line, signature, tier1 + tier2 + tier3 + tier4 as raw from tr join v using (query_id, unit_id)),
sc as (select *, case when coalesce(parser_mode = 'fallback', false) then least(case when tier1 = 0 then least(raw, 89) else raw end, 59) else case when tier1 = 0 then least(raw, 89) else raw end end as score from sc0),
rk as (select *, (row_number() over (partition by query_id order by score desc, path, start_line, unit_id))::int as place, case when score >= 120 then 'top_authority' when score >= 80 then 'useful_support' when score >= 30 then 'exploratory' else 'below_threshold_noise' end as rank_band from sc where score > 0 qualify place <= 20)
"""
)


def _ranked(spark, d: str) -> DataFrame:
    u = linked_units(spark, d)
    return resolve(u, ranking_queries(u))


def _evidence(spark, d: str) -> DataFrame:
    u = linked_units(spark, d)
    return reasons(u, ranking_queries(u), written(call_edges(u), "edges"))


QUERIES = {
    "scr_09_ranked": lambda s, d: _ranked(s, d).select("query_id", "place", "unit_id", "path", "score", "tier1", "tier2", "tier3", "tier4", "rank_band", F.concat_ws(",", "codes").alias("codes")),
    "scr_01_seeds": lambda s, d: seeds(u := linked_units(s, d), ranking_queries(u)).select("query_id", "unit_id", "code"),
    "scr_05_lexical": lambda s, d: lexical_seeds(u := linked_units(s, d), q := ranking_queries(u), seeds(u, q)).select("query_id", "unit_id", "code"),
    "flt_06_dispatch": lambda s, d: dispatch_pairs(ranking_queries(u := linked_units(s, d)), u).select("query_id", "unit_id").distinct(),
    "join_16_graph": lambda s, d: _evidence(s, d).where("code like 'graph%'").select("query_id", "unit_id", "code", F.col("points").cast("bigint").alias("points")),
    "scr_06_boosts": lambda s, d: _evidence(s, d).where("code like 'hint_preferred%' or code = 'source_path_prior'").select("query_id", "unit_id", "code"),
    "flt_01_visible": lambda s, d: visible(u := linked_units(s, d), ranking_queries(u)).select("query_id", "unit_id", "class"),
    "flt_05_path_class": lambda s, d: linked_units(s, d).select("path").distinct().withColumn("class", path_class(F.col("path"))),
}
SQL = {
    "scr_09_ranked": RANK_SQL + "select query_id, place, unit_id, path, score, tier1, tier2, tier3, tier4, rank_band, array_to_string(codes, ',') as codes from rk",
    "scr_01_seeds": RANK_SQL + "select * from s0",
    "scr_05_lexical": RANK_SQL + "select * from ls",
    "flt_06_dispatch": RANK_SQL + f"select query_id, unit_id from cur join q using (root) where {_DISPATCH}",
    "join_16_graph": RANK_SQL + "select query_id, unit_id, code, points::bigint as points from ev where code like 'graph%'",
    "scr_06_boosts": RANK_SQL + "select query_id, unit_id, code from ev where code like 'hint_preferred%' or code = 'source_path_prior'",
    "flt_01_visible": RANK_SQL + "select query_id, unit_id, class from v",
    "flt_05_path_class": GRAPH_SQL + f"select distinct path, {_CLASS} as class from cur",
}
