"""From ranked units to a bounded context: budgets, focus, confidence, literal slices and raw fetches.

Budgets are prefixes: running sums over the ranking, cut before the first item that does not fit. All windows are per query or
packet, over at most the ranking's limit of rows. Texts are split once and sliced as arrays; lines are not exploded.

A text's lines end at ``\\n`` or ``\\r\\n``; trailing empty lines do not count. Null text has no lines; a slice that begins behind
the end has none. A line longer than the byte cap alone gives no lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.operators.graph import IMPACT_SQL, call_edges, impact
from rookery.operators.retrieval import RANK_SQL, resolve
from rookery.plans.views import linked_units, ranking_queries
from rookery.sources.tables import table, written

#: Fixed values.
BUDGET, FOCUS, MAX_LINES, MAX_BYTES, RAW_UNITS, NEIGHBOURHOOD = 1800, 5, 400, 32_768, 6, 8
CONFIDENCE = {"high": 0.9, "medium": 0.62, "low": 0.3}
STRENGTH = {"clojure": 2, "elixir": 1, "java": 1, "python": 1, "typescript": 0}
AMBIGUITY = 10
LEVELS = ("low", "medium", "high")


def quarter(*parts: Column) -> Column:
    """ceil(characters / 4)."""
    total = sum((F.length(F.coalesce(p, F.lit(""))) for p in parts), F.lit(0))
    return F.ceil(total / F.lit(4.0)).cast("bigint")


def compact_tokens() -> Column:
    return F.ceil((F.length(F.coalesce("symbol", F.lit(""))) + F.length("path") + F.length("unit_id") + 24) / F.lit(4.0)).cast("bigint")


def stage_budgets(budget: Column) -> list[Column]:
    """Reserved tokens of selection, expansion and detail."""
    sel, exp = F.greatest(F.lit(80), F.floor(budget * 0.10)), F.greatest(F.lit(160), F.floor(budget * 0.20))
    return [sel.cast("bigint").alias("selection_tokens"), exp.cast("bigint").alias("expansion_tokens"), F.greatest(F.lit(0), budget - sel - exp).cast("bigint").alias("detail_tokens")]


def prefix_fit(rows: DataFrame, tokens: Column, budget: Column, keys: list[str], order: list[str], most: int | None = None) -> DataFrame:
    """The rows before the first that overflows the budget, with ``used``; at most ``most``. Token counts are not negative."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = rows.withColumn("used", F.sum(tokens).over(w)).where(F.col("used") <= budget)
    return x if most is None else x.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def focus(ranked: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The first units of each query that fit the selection budget, at most five."""
    return prefix_fit(ranked, compact_tokens(), F.lit(max(80, int(budget * 0.10))), ["query_id"], ["place"], FOCUS)


def skeletons(ranked: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The units whose signatures fit the expansion budget."""
    return prefix_fit(ranked, quarter(F.col("signature")), F.lit(max(160, int(budget * 0.20))), ["query_id"], ["place"])


def capability_units(ranked: DataFrame) -> DataFrame:
    """The units in the two upper bands, or all where a query has none there."""
    sure = F.col("rank_band").isin("top_authority", "useful_support")
    some = F.max(sure).over(Window.partitionBy("query_id"))
    return ranked.withColumn("_some", some).where(sure | ~F.col("_some")).drop("_some")


def capabilities(ranked: DataFrame) -> DataFrame:
    """query_id, languages, parser modes, coverage and the ceiling of confidence (0 to 2) that the selected units' languages allow.

    A language counts as low where all its units came from the fallback parser; the weakest language decides. Mixed coverage allows medium at
    most, fallback alone low. Units without a language are left out of the strengths."""
    weak = F.coalesce(F.col("parser_mode") == "fallback", F.lit(False))
    strength = F.coalesce(F.create_map(*[F.lit(v) for k, n in STRENGTH.items() for v in (k, n)])[F.lower("language")], F.lit(0))
    x = capability_units(ranked).withColumn("_all", F.min(weak).over(Window.partitionBy("query_id", "language")))
    g = x.groupBy("query_id").agg(
        F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"), F.array_join(F.array_sort(F.collect_set("parser_mode")), ",").alias("modes"), F.count(F.lit(1)).alias("n_units"), F.count_if(weak).alias("n_fallback"),
        F.coalesce(F.min(F.when(F.col("language").isNotNull(), F.when(F.col("_all"), 0).otherwise(strength))), F.lit(0)).alias("_strength"),
    )
    level = F.when(F.col("n_fallback") == 0, "full").when(F.col("n_fallback") < F.col("n_units"), "mixed").otherwise("fallback_only")
    ceiling = F.when(level == "fallback_only", 0).when(level == "mixed", F.least("_strength", F.lit(1))).otherwise(F.col("_strength"))
    return g.select("query_id", "languages", "modes", level.alias("coverage"), "n_units", "n_fallback", ceiling.alias("ceiling"))


def selections(ranked: DataFrame, queries: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One row per query: status, confidence, its warnings, capability ceiling and the recommended next step.

    Queries without ranked units are kept: left join from the queries."""
    top = lambda c: F.max_by(c, -F.col("place"))
    second = F.max(F.when(F.col("place") == 2, F.col("score")))
    x = ranked.join(queries.select("query_id", "symbols", "paths", "modules", "tests", "spans"), "query_id")
    first_size = F.max(F.when(F.col("place") == 1, compact_tokens()))
    g = x.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), top("tier1").alias("t1"), top("tier2").alias("t2"), top("score").alias("s1"), second.alias("s2"), F.bool_or(F.array_contains("symbols", F.col("symbol"))).alias("exact"),
        F.bool_or(F.col("parser_mode") == "fallback").alias("fallback"), first_size.alias("first_size"),
    )
    q = queries.select("query_id", F.size("spans").alias("n_spans"), F.size("paths").alias("n_paths"), (F.size("symbols") + F.size("paths") + F.size("modules") + F.size("tests") + F.size("spans")).alias("n_targets"))
    ceilings = capabilities(ranked).select("query_id", "ceiling")
    x = q.join(g, "query_id", "left").join(ceilings, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    no = F.lit(False)
    ambiguous = F.coalesce(F.abs(F.col("s1") - F.col("s2")) <= AMBIGUITY, no)
    exact, fallback = F.coalesce("exact", no), F.coalesce("fallback", no)
    t1, t2 = F.coalesce("t1", F.lit(0)), F.coalesce("t2", F.lit(0))
    level = F.when(fallback, 0).when((t1 > 0) & exact & ~ambiguous, 2).when((t1 > 0) | (t2 >= 50) | exact | (F.col("n_spans") > 0) | (F.col("n_paths") > 0), 1).otherwise(0)
    ceiling = F.coalesce("ceiling", F.lit(0))
    capped = F.least(level, ceiling)
    name = lambda c: F.element_at(F.array(*map(F.lit, LEVELS)), c + 1)
    warnings = F.array_compact(F.array(F.when(fallback, "parser_fallback"), F.when(t1 == 0, "no_tier1_evidence"), F.when(ambiguous, "target_ambiguous"), F.when(capped < level, "capability_ceiling")))
    status = F.when(F.col("n") == 0, "insufficient_evidence").when(F.col("first_size") > max(80, int(budget * 0.10)), "budget_exhausted_at_selection").otherwise("completed")
    lost = (F.col("n_targets") == 0) & (t1 == 0) & ambiguous
    step = F.when(status == "insufficient_evidence", "expand_query_scope").when(status == "budget_exhausted_at_selection", "raise_token_budget").when(lost, "narrow_query").when(capped == 0, "fetch_context_detail").otherwise("expand_context")
    return x.select("query_id", status.alias("result_status"), name(capped).alias("confidence_level"), name(ceiling).alias("confidence_ceiling"), F.array_join(F.array_sort(warnings), ",").alias("warnings"), step.alias("next_step"), F.col("n").cast("bigint").alias("n_selected"))


def lines(text: Column) -> Column:
    """The lines of a text."""
    t = F.regexp_replace(text, r"(\r?\n)+\z", "")
    return F.when(text.isNull() | (t == ""), F.array().cast("array<string>")).otherwise(F.split(t, r"\r?\n"))


def capped(part: Column, most_bytes: int = MAX_BYTES) -> Column:
    """How many of the lines fit the byte cap, separators counted."""
    step = lambda a, x: F.struct(
        F.when(a["open"] & (a["bytes"] + F.octet_length(x) + F.least(a["n"], F.lit(1)) <= most_bytes), a["n"] + 1).otherwise(a["n"]).alias("n"),
        F.when(a["open"] & (a["bytes"] + F.octet_length(x) + F.least(a["n"], F.lit(1)) <= most_bytes), a["bytes"] + F.octet_length(x) + F.least(a["n"], F.lit(1))).otherwise(a["bytes"]).alias("bytes"),
        (a["open"] & (a["bytes"] + F.octet_length(x) + F.least(a["n"], F.lit(1)) <= most_bytes)).alias("open"),
    )
    return F.aggregate(part, F.struct(F.lit(0).alias("n"), F.lit(0).alias("bytes"), F.lit(True).alias("open")), step)


def slices(files: DataFrame, key: str, text: str, start: Column, end: Column, most_lines: int = MAX_LINES, most_bytes: int = MAX_BYTES) -> DataFrame:
    """Lines start..end of each file under both caps; the line cap names the reason where both apply."""
    x = files.select(key, lines(F.col(text)).alias("all"), F.greatest(start, F.lit(1)).alias("from"), end.alias("to"))
    want = F.least(F.col("to"), F.size("all")) - F.col("from") + 1
    x = x.withColumn("part", F.when(want > 0, F.slice("all", F.col("from"), F.least(want, F.lit(most_lines)))).otherwise(F.array().cast("array<string>"))).withColumn("fit", capped(F.col("part"), most_bytes))
    reason = F.when(F.col("from") > F.size("all"), "start_beyond_end").when(want > most_lines, "line_cap_exceeded").when(F.col("fit.n") < F.size("part"), "byte_cap_exceeded")
    return x.select(key, F.size("all").alias("n_lines"), F.col("fit.n").alias("returned_lines"), F.col("fit.bytes").alias("bytes"), reason.alias("reason"), F.array_join(F.when(F.col("fit.n") > 0, F.slice("part", F.lit(1), F.col("fit.n"))).otherwise(F.array().cast("array<string>")), "\n").alias("content"))


def raw_fetch(units: DataFrame, text: str, group: str, order: str, budget: int = BUDGET, level: str = "local_neighborhood") -> DataFrame:
    """Snippets of the first six units of each group up to the byte budget; the first overflow ends the group.

    Units whose file is missing cost a request and no bytes."""
    pad = NEIGHBOURHOOD if level == "local_neighborhood" else 0
    w = Window.partitionBy(group).orderBy(order)
    x = units.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= RAW_UNITS).withColumn("all", lines(F.col(text)))
    n = F.size("all")
    clamp = lambda c: F.least(F.greatest(c, F.lit(1)), n)
    a = F.lit(1) if level == "whole_file" else clamp(F.col("start_line") - pad)
    b = n if level == "whole_file" else clamp(F.col("end_line") + pad)
    x = x.withColumns({"from": a, "to": b}).withColumn("content", F.when(n > 0, F.array_join(F.slice("all", F.col("from"), F.greatest(F.col("to") - F.col("from") + 1, F.lit(0))), "\n")))
    x = x.withColumn("bytes", F.coalesce(F.octet_length("content"), F.lit(0)).cast("bigint")).withColumn("used", F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.where((F.col("used") <= 4 * max(200, budget)) & F.col("content").isNotNull())


def _rank(spark, d: str):
    u = linked_units(spark, d)
    q = ranking_queries(u)
    e = written(call_edges(u), "edges")
    return written(resolve(u, q, e), "ranked"), q, u, e


def _focus(spark, d: str) -> DataFrame:
    return focus(_rank(spark, d)[0]).select("query_id", "place", "unit_id", "used")


def _impact(spark, d: str) -> DataFrame:
    r, _, u, e = _rank(spark, d)
    return impact(focus(r), u, e)


def _selections(spark, d: str) -> DataFrame:
    r, q, _, _ = _rank(spark, d)
    return selections(r, q)


def _slices(spark, d: str) -> DataFrame:
    f = table(spark, d, "degraded_fallback")
    return slices(f, "fallback_id", "raw_context", F.col("start_line") + 4, F.col("end_line") - 2, 60, 1500)


def _whole_slices(spark, d: str) -> DataFrame:
    """The table's own lines under the default caps."""
    return slices(table(spark, d, "degraded_fallback"), "fallback_id", "raw_context", F.col("start_line"), F.col("end_line"))


def _whole_raw(spark, d: str) -> DataFrame:
    """The table's own lines under the default budget."""
    return raw_fetch(table(spark, d, "degraded_fallback"), "raw_context", "packet_id", "fallback_id").select("packet_id", "fallback_id", "from", "to", "bytes", "used", F.sha2("content", 256).alias("content_hash"))


def _raw(spark, d: str) -> DataFrame:
    f = table(spark, d, "degraded_fallback").withColumns({"start_line": F.col("fallback_id").cast("int") % 20 + 1, "end_line": F.col("fallback_id").cast("int") % 20 + 12})
    return raw_fetch(f, "raw_context", "packet_id", "fallback_id", 400).select("packet_id", "fallback_id", "from", "to", "bytes", "used", F.sha2("content", 256).alias("content_hash"))


def _budgets(spark, d: str) -> DataFrame:
    e = table(spark, d, "semantic_usage_events").select("id", F.get_json_object("payload", "$.reserved_tokens").cast("bigint").alias("budget")).where("budget is not null")
    return e.select("id", *stage_budgets(F.col("budget")))


QUERIES = {
    "win_01_skeleton_fit": lambda s, d: skeletons(_rank(s, d)[0]).select("query_id", "place", "unit_id", "used"),
    "win_02_focus_fit": _focus,
    "prj_09_capabilities": lambda s, d: capabilities(_rank(s, d)[0]),
    "scr_10_selection": _selections,
    "scr_15_stage_budgets": _budgets,
    "scr_16_raw_fetch": _raw,
    "scr_16_raw_fetch_whole": _whole_raw,
    "scr_17_literal_slice": _slices,
    "scr_17_literal_slice_whole": _whole_slices,
    "orc_06_expand_impact": _impact,
    "src_03_line_counts": lambda s, d: table(s, d, "degraded_fallback").select("fallback_id", F.size(lines(F.col("raw_context"))).alias("n_lines")),
}
_LINES = lambda t: f"case when {t} is null or regexp_replace({t}, '(\\r?\\n)+\\z', '') = '' then []::varchar[] else string_split_regex(regexp_replace({t}, '(\\r?\\n)+\\z', ''), '\\r?\\n') end"
_COMPACT = "ceil((length(coalesce(symbol, '')) + length(path) + length(unit_id) + 24) / 4.0)::bigint"
_STRONG = "case language " + " ".join(f"when '{k}' then {v}" for k, v in STRENGTH.items()) + " else 0 end"
_CAP_SQL = f""", cu as (select * from (select *, bool_or(rank_band in ('top_authority', 'useful_support')) over (partition by query_id) as sure from rk) where rank_band in ('top_authority', 'useful_support') or not sure),
    cv as (select *, coalesce(parser_mode = 'fallback', false) as weak, bool_and(coalesce(parser_mode = 'fallback', false)) over (partition by query_id, language) as lang_weak from cu),
    cw as (select query_id, coalesce(array_to_string(list_sort(list_distinct(list(language))), ','), '') as languages, coalesce(array_to_string(list_sort(list_distinct(list(parser_mode))), ','), '') as modes, count(*) as n_units, count(*) filter (weak) as n_fallback,
      coalesce(min(case when language is null then null when lang_weak then 0 else {_STRONG} end), 0) as strength from cv group by query_id),
    cap as (select query_id, languages, modes, case when n_fallback = 0 then 'full' when n_fallback < n_units then 'mixed' else 'fallback_only' end as coverage, n_units, n_fallback,
      (case when n_fallback = n_units then 0 when n_fallback > 0 then least(strength, 1) else strength end)::int as ceiling from cw)"""
SQL = {
    "prj_09_capabilities": RANK_SQL + _CAP_SQL + " select query_id, languages, modes, coverage, n_units, n_fallback, ceiling from cap",
    "win_01_skeleton_fit": RANK_SQL + "select * from (select query_id, place, unit_id, sum(ceil(length(coalesce(signature, '')) / 4.0)::bigint) over (partition by query_id order by place)::bigint as used from rk) where used <= 360",
    "win_02_focus_fit": RANK_SQL + f"select * from (select query_id, place, unit_id, sum({_COMPACT}) over (partition by query_id order by place)::bigint as used from rk) where used <= 180 and place <= 5",
    "scr_10_selection": RANK_SQL
    + _CAP_SQL
    + f""", gs as (select query_id, count(*) as n, first(tier1) filter (place = 1) as t1, first(tier2) filter (place = 1) as t2, first(score) filter (place = 1) as s1, first(score) filter (place = 2) as s2, bool_or(list_contains(q.symbols, rk.symbol)) as exact, bool_or(parser_mode = 'fallback') as fallback,
      max({_COMPACT}) filter (place = 1) as size1 from rk join q using (query_id) group by query_id),
    gq as (select q.query_id, coalesce(n, 0) as n, coalesce(t1, 0) as t1, coalesce(t2, 0) as t2, coalesce(abs(s1 - s2) <= 10, false) as amb, coalesce(exact, false) as exact, coalesce(fallback, false) as fallback, coalesce(cap.ceiling, 0) as ceil_, size1, (span_path is not null)::int as n_spans, len(paths) as n_paths, len(symbols) + len(paths) + len(modules) + len(tests) + (span_path is not null)::int as n_targets from q left join gs using (query_id) left join cap using (query_id)),
    gl as (select *, case when fallback then 0 when t1 > 0 and exact and not amb then 2 when t1 > 0 or t2 >= 50 or exact or n_spans > 0 or n_paths > 0 then 1 else 0 end as lvl, 1 as one from gq),
    gz as (select *, least(lvl, ceil_) as cap, case when n = 0 then 'insufficient_evidence' when size1 > 180 then 'budget_exhausted_at_selection' else 'completed' end as result_status from gl)
    select query_id, result_status, ['low', 'medium', 'high'][cap + 1] as confidence_level, ['low', 'medium', 'high'][ceil_ + 1] as confidence_ceiling, array_to_string(list_sort(list_filter([case when fallback then 'parser_fallback' end, case when t1 = 0 then 'no_tier1_evidence' end, case when amb then 'target_ambiguous' end, case when cap < lvl then 'capability_ceiling' end], lambda x: x is not null)), ',') as warnings,
      case when result_status = 'insufficient_evidence' then 'expand_query_scope' when result_status = 'budget_exhausted_at_selection' then 'raise_token_budget' when n_targets = 0 and t1 = 0 and amb then 'narrow_query' when cap = 0 then 'fetch_context_detail' else 'expand_context' end as next_step, n::bigint as n_selected from gz""",
    "scr_15_stage_budgets": "with b as (select id, (payload->>'$.reserved_tokens')::bigint as b from semantic_usage_events), c as (select id, b, greatest(80, floor(b * 0.10))::bigint as selection_tokens, greatest(160, floor(b * 0.20))::bigint as expansion_tokens from b where b is not null) select id, selection_tokens, expansion_tokens, greatest(0, b - selection_tokens - expansion_tokens)::bigint as detail_tokens from c",
    "scr_16_raw_fetch": f"""with f as (select packet_id, fallback_id, fallback_id % 20 + 1 as s, fallback_id % 20 + 12 as e, {_LINES('raw_context')} as ls, row_number() over (partition by packet_id order by fallback_id) as rn from degraded_fallback),
    g as (select *, least(greatest(s - 8, 1), len(ls)) as a, least(greatest(e + 8, 1), len(ls)) as b from f where rn <= 6),
    h as (select *, case when len(ls) > 0 then array_to_string(ls[a:b], chr(10)) end as content from g), k as (select *, coalesce(strlen(content), 0)::bigint as bytes from h),
    m as (select *, sum(bytes) over (partition by packet_id order by fallback_id)::bigint as used from k)
    select packet_id, fallback_id, a::int as "from", b::int as "to", bytes, used, sha256(content) as content_hash from m where used <= 1600 and content is not null""",
    "scr_17_literal_slice": f"""with f as (select fallback_id, {_LINES('raw_context')} as ls, greatest(start_line + 4, 1) as a, end_line - 2 as b from degraded_fallback),
    g as (select *, least(b, len(ls)) - a + 1 as want from f), h as (select *, case when want > 0 then ls[a:a + least(want, 60) - 1] else []::varchar[] end as part from g),
    k as (select *, [list_sum(list_transform(part[1:i], lambda x: strlen(x))) + i - 1 for i in range(1, len(part) + 1)] as sums from h), m as (select *, len(list_filter(sums, lambda x: x <= 1500)) as n from k)
    select fallback_id, len(ls)::int as n_lines, n::int as returned_lines, (case when n > 0 then sums[n] else 0 end)::int as bytes, case when a > len(ls) then 'start_beyond_end' when want > 60 then 'line_cap_exceeded' when n < len(part) then 'byte_cap_exceeded' end as reason, coalesce(array_to_string(part[1:n], chr(10)), '') as content from m""",
    "orc_06_expand_impact": RANK_SQL + f", sel as (select query_id, root, unit_id, path, module from (select *, sum({_COMPACT}) over (partition by query_id order by place) as used from rk) where used <= 180 and place <= 5)" + IMPACT_SQL,
    "src_03_line_counts": f"select fallback_id, len({_LINES('raw_context')})::int as n_lines from degraded_fallback",
}
_swapped = lambda text, *pairs: _swapped(text.replace(*pairs[0]), *pairs[1:]) if pairs else text
SQL |= {
    "scr_16_raw_fetch_whole": _swapped(SQL["scr_16_raw_fetch"], ("fallback_id % 20 + 1 as s, fallback_id % 20 + 12 as e", "start_line as s, end_line as e"), ("used <= 1600", f"used <= {4 * BUDGET}")),
    "scr_17_literal_slice_whole": _swapped(SQL["scr_17_literal_slice"], ("start_line + 4", "start_line"), ("end_line - 2", "end_line"), ("60", str(MAX_LINES)), ("1500", str(MAX_BYTES))),
}
