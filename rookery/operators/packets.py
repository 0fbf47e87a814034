"""What a context packet says about itself: projection tags, the query in words, its stages, its top reasons, fixtures it is held against.

All of it is per query and JVM-side; lists keep the order of the ranking or of the query. Null lists are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.operators.context import BUDGET, capability_units, compact_tokens, focus, quarter
from rookery.operators.context import _rank as _selection_parts
from rookery.operators.retrieval import RANK_SQL
from rookery.plans.views import ranking_queries
from rookery.sources.tables import table

#: Profiles by their names in answers, raw code levels and confidence levels in rising order, durations of stages.
PROFILES = {"structural": "structural", "summary": "summary", "selection": "selection", "api-shape": "api_shape", "detail": "detail", "literal-slice": "literal_slice", "diff": "diff"}
RAW = ("none", "target_span", "enclosing_unit", "local_neighborhood", "whole_file")
LEVELS = ("low", "medium", "high")
STAGES = {"query_validation": 2, "candidate_generation": 7, "ranking": 4, "context_packet_assembly": 5, "raw_code_fetch": 3, "result_finalization": 2}
TOP_REASONS = 10
_STRINGS = "array<string>"


def with_projection(rows: DataFrame, profile: str, recommended: str | None = None) -> DataFrame:
    """The profile an answer was cut to, and the one to ask for next."""
    tagged = rows.withColumn("projection_profile", F.lit(PROFILES.get(profile, profile)))
    return tagged if recommended is None else tagged.withColumn("recommended_projection_profile", F.lit(PROFILES.get(recommended, recommended)))


def query_summary(queries: DataFrame) -> DataFrame:
    """query_id, targets and hints of each query in words, in the query's order."""
    named = lambda field, word: F.transform(F.coalesce(field, F.array().cast(_STRINGS)), lambda x: F.concat(F.lit(f"{word}: "), x))
    targets = F.concat(named("symbols", "symbol"), named("paths", "path"), named("modules", "module"), named("tests", "test"))
    some = lambda c, name: F.when(F.size(c) > 0, name)
    hints = F.array_compact(F.array(some("preferred_paths", "preferred_paths"), some("preferred_modules", "preferred_modules"), some("suspected", "suspected_symbols"), F.when(F.col("definitions"), "prefer_definitions_over_callers")))
    limits = F.concat(F.transform("prefixes", lambda p: F.concat(F.lit("allowed_path_prefix "), p)), F.transform("languages", lambda p: F.concat(F.lit("language "), p)))
    return queries.select("query_id", F.array_join(targets, "; ").alias("targets_summary"), F.array_join(limits, "; ").alias("constraints_summary"), F.array_join(hints, "; ").alias("hints_summary"))


def stage_rows(queries: DataFrame, ranked: DataFrame, selected: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The six stages of each query as rows: status, two counters and the stage's fixed duration.

    Raw code is fetched late, so its stage is skipped here and takes no time. The last stage is degraded where confidence is low or a unit came
    from the fallback parser. Queries without candidates have all stages too."""
    g = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("units"), F.countDistinct("path").alias("files"), F.count_if(F.col("rank_band") == "top_authority").alias("top"))
    kept = focus(ranked, budget).groupBy("query_id").agg(F.count(F.lit(1)).alias("kept"), F.sum(compact_tokens()).alias("tokens"))
    q = queries.select("query_id", (F.size("symbols") + F.size("paths") + F.size("modules") + F.size("tests")).alias("targets"), (F.size("prefixes") + F.size("languages")).alias("limits"))
    x = q.join(g, "query_id", "left").join(kept, "query_id", "left").join(selected.select("query_id", "result_status", "confidence_level", "warnings"), "query_id").na.fill(0)
    weak = (F.col("confidence_level") == "low") | F.contains("warnings", F.lit("parser_fallback"))
    n_warnings = F.size(F.filter(F.split("warnings", ","), lambda w: w != ""))
    packet = F.when((F.col("units") > 0) & (F.col("kept") == 0), "budget_exhausted").when(F.col("kept") < F.least("units", F.lit(5)), "truncated").otherwise("completed")
    row = lambda place, stage, status, a, b: F.struct(F.lit(place).alias("place"), F.lit(stage).alias("stage"), status.alias("status"), a.cast("bigint").alias("counter_a"), b.cast("bigint").alias("counter_b"), F.lit(0 if stage == "raw_code_fetch" else STAGES[stage]).alias("duration_ms"))
    done = F.lit("completed")
    stages = [
        row(1, "query_validation", done, F.col("targets"), F.col("limits")), row(2, "candidate_generation", done, F.col("units"), F.col("files")), row(3, "ranking", done, F.col("units"), F.col("top")),
        row(4, "context_packet_assembly", packet, F.col("kept"), F.col("tokens")), row(5, "raw_code_fetch", F.lit("skipped"), F.lit(0), F.lit(0)), row(6, "result_finalization", F.when(weak, "degraded").otherwise(done), n_warnings, weak.cast("int")),
    ]
    out = x.select("query_id", F.inline(F.array(*stages)))
    return out.withColumn("event_name", F.concat_ws(".", "stage", "status"))


def top_reasons(ranked: DataFrame, limit: int = TOP_REASONS) -> DataFrame:
    """query_id and its distinct reasons in the order of the ranking, the first 10; a query has at most 20 units."""
    order = F.array_sort(F.collect_list(F.struct("place", "codes")))
    distinct = F.array_distinct(F.flatten(F.transform(order, lambda r: r["codes"])))
    return ranked.groupBy("query_id").agg(F.array_join(F.slice(distinct, 1, limit), ",").alias("reasons"))


def selected_modules(ranked: DataFrame) -> DataFrame:
    """query_id, module: distinct modules of the selected paths."""
    return ranked.where("module is not null").select("query_id", "module").distinct()


BROAD = 2  # risky neighbours beyond this make an impact broad (fixed value)


def guardrails(selected: DataFrame, capable: DataFrame, impact: DataFrame, stale: Column | None = None) -> DataFrame:
    """Posture, blocking reasons, next step, allowed scope and risk flags of each selection.

    Confidence gives the posture; a stale index or evidence from the fallback parser alone blocks autonomy. ``impact`` has query_id, hint and value."""
    risky = impact.where("hint = 'risky_neighbors'").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_risky"))
    x = selected.join(capable.select("query_id", "coverage"), "query_id", "left").join(risky, "query_id", "left")
    old = F.lit(False) if stale is None else F.coalesce(stale, F.lit(False))
    level, only_fallback, broad, limited = F.col("confidence_level"), F.coalesce(F.col("coverage") == "fallback_only", F.lit(False)), F.coalesce(F.col("n_risky") > BROAD, F.lit(False)), F.col("confidence_ceiling") != "high"
    posture = F.when(old | only_fallback, "autonomy_blocked").when(level == "high", "draft_patch_safe").when(level == "medium", "plan_safe").otherwise("autonomy_blocked")
    blocked = posture == "autonomy_blocked"
    codes = lambda *cs: F.array_join(F.array_compact(F.array(*[F.when(c, code) for c, code in cs])), ",")
    return x.select(
        "query_id", posture.alias("autonomy_posture"),
        codes((blocked & (level == "low"), "confidence_low"), (old, "stale_index"), (only_fallback, "capability_low"), (blocked & limited, "capability_ceiling"), (broad, "impact_broad")).alias("blocking_reasons"),
        F.when(posture == "draft_patch_safe", "run_targeted_tests").when(posture == "plan_safe", "fetch_more_context").otherwise("human_review_required").alias("required_next_step"),
        F.when(posture == "draft_patch_safe", "draft_patch_on_selected_unit_only").when(posture == "plan_safe", "plan_only").otherwise("analysis_only").alias("scope"),
        codes((old, "stale_index"), (broad, "impact_broad"), (only_fallback, "capability_low"), (limited, "capability_ceiling"), (blocked, "review_gate")).alias("risk_flags"),
    )


def token_estimates(ranked: DataFrame, impact: DataFrame) -> DataFrame:
    """Tokens of each query's parts: all structure with one rounding, skeletons and compact items rounded each, impact hints with 12 characters a list."""
    chars = lambda c: F.length(F.coalesce(c, F.lit("")))
    summary = chars(F.col("summary")) if "summary" in ranked.columns else F.lit(0)
    g = ranked.groupBy("query_id").agg(F.ceil(F.sum(chars(F.col("signature")) + summary + chars(F.col("symbol"))) / F.lit(4.0)).cast("bigint").alias("structure_tokens"), F.sum(quarter(F.col("signature"))).alias("skeleton_tokens"), F.sum(compact_tokens()).alias("compact_tokens"))
    i = impact.groupBy("query_id").agg(F.ceil((F.sum(F.length("value")) + 12 * 4) / F.lit(4.0)).cast("bigint").alias("impact_tokens"))
    return g.join(i, "query_id", "left").na.fill(12, ["impact_tokens"])


# ---------------------------------------------------------------- fixtures


_MANY = "must_paths no_paths must_reasons must_warnings must_degradations must_risks must_units postures statuses review_postures paths reasons warnings degradations risks top_units steps".split()
_ONE = "fixture_id level least_level posture raw_ceiling confidence_level autonomy_posture result_status raw_level".split()
#: Columns of a fixture and its result.
FIXTURE = ", ".join([*(f"{c} string" for c in _ONE), "review boolean", *(f"{c} array<string>" for c in _MANY), *(f"{c} array<struct<unit_id:string,rank_band:string>>" for c in ("bands", "ranked"))])


def holds(have: Column, want: Column) -> Column:
    """Whether all wanted are among what there is; nothing wanted holds."""
    none = F.array().cast(_STRINGS)
    return F.size(F.array_except(F.coalesce(want, none), F.coalesce(have, none))) == 0


def same_unit(actual: Column, wanted: Column) -> Column:
    """A unit id matches one it ends with, or one whose symbol its symbol ends with."""
    symbol = lambda c: F.contains(c, F.lit("::"))
    tail = lambda c: F.regexp_extract(c, "^.*?::(.*)$", 1)
    return F.endswith(actual, wanted) | (symbol(actual) & symbol(wanted) & (F.endswith(tail(actual), tail(wanted)) | F.endswith(actual, tail(wanted))))


def _place(levels: tuple[str, ...], c: Column, other: int) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, levels)), c), F.lit(0)) - 1, F.lit(other))


def fixture_failures(fixtures: DataFrame) -> DataFrame:
    """fixture_id and the first check, in their fixed order, that a result fails; null where it passes.

    ``fixtures`` holds expectations and the result side by side; what is not expected (null or empty) passes. Expectations: must_paths, no_paths,
    must_reasons, must_warnings, must_degradations, must_risks, must_units, bands (array of unit_id and rank_band), level, least_level, posture,
    postures, statuses, raw_ceiling, review, review_postures. Result: paths, reasons, warnings, degradations, risks, top_units, ranked (array of
    unit_id and rank_band), confidence_level, autonomy_posture, result_status, raw_level, steps."""
    c, none = F.col, F.array().cast(_STRINGS)
    list_of = lambda name: F.coalesce(c(name), none)
    asked = lambda name: F.size(list_of(name)) > 0
    among = lambda value, name: ~asked(name) | F.coalesce(F.array_contains(list_of(name), value), F.lit(False))
    has_unit = lambda u: F.exists(list_of("top_units"), lambda a: same_unit(a, u))
    empty = F.array().cast("array<struct<unit_id:string,rank_band:string>>")
    bands, ranked = F.coalesce(c("bands"), empty), F.coalesce(c("ranked"), empty)
    band_of = lambda u: F.element_at(F.concat(F.transform(F.filter(ranked, lambda r: same_unit(r["unit_id"], u)), lambda r: r["rank_band"]), F.array(F.lit("?"))), 1)
    blocked = F.coalesce(c("autonomy_posture") == "autonomy_blocked", F.lit(False))
    checks = {  # their names are fixed values
        "missing required paths": holds(c("paths"), c("must_paths")),
        "found excluded paths": ~F.arrays_overlap(list_of("paths"), list_of("no_paths")),
        "missing selection reason codes": holds(c("reasons"), c("must_reasons")),
        "missing warning codes": holds(c("warnings"), c("must_warnings")),
        "missing degradation codes": holds(c("degradations"), c("must_degradations")),
        "missing risk flags": holds(c("risks"), c("must_risks")),
        "missing top authority units": F.forall(list_of("must_units"), has_unit),
        "rank band expectation mismatch": F.forall(bands, lambda b: band_of(b["unit_id"]) == b["rank_band"]),
        "confidence mismatch": c("level").isNull() | c("confidence_level").eqNullSafe(c("level")),
        "confidence too low": c("least_level").isNull() | (_place(LEVELS, c("confidence_level"), -1) >= _place(LEVELS, c("least_level"), 0)),
        "autonomy posture mismatch": c("posture").isNull() | c("autonomy_posture").eqNullSafe(c("posture")),
        "autonomy posture not allowed": among(c("autonomy_posture"), "postures"),
        "result status not allowed": among(c("result_status"), "statuses"),
        "raw fetch level exceeded": c("raw_ceiling").isNull() | (_place(RAW, c("raw_level"), 0) <= _place(RAW, c("raw_ceiling"), 0)),
        "review-required fixture must be blocked": ~F.coalesce(c("review"), F.lit(False)) | blocked,
        "expected human_review_required": ~F.coalesce(F.array_contains(list_of("review_postures"), c("autonomy_posture")), F.lit(False)) | F.array_contains(list_of("steps"), "human_review_required"),
    }
    return fixtures.select("fixture_id", F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]).alias("failed"))


def _parts(spark, d: str):
    r, q, _, _ = _selection_parts(spark, d)
    return r, q


def _stages(spark, d: str) -> DataFrame:
    from rookery.operators.context import selections

    r, q = _parts(spark, d)
    return stage_rows(q, r, selections(r, q)).select("query_id", "place", "stage", "status", "event_name", "counter_a", "counter_b", "duration_ms")


def _fixtures(spark, d: str) -> DataFrame:
    """Stored answers held against stored feedback: each answered event is a fixture that asks for what its users named.

    What was asked for: the ground-truth paths and units; no path of another language than the first; a completed or truncated answer of medium
    confidence at least, nothing beyond the enclosing unit, and a review where the user gave up."""
    e = table(spark, d, "semantic_usage_events").where("trace_id is not null").groupBy("trace_id").agg(F.max_by(F.struct("confidence_level", "autonomy_posture", "result_status", "raw_fetch_level", "payload"), "id").alias("e"))
    f = table(spark, d, "semantic_usage_feedback")
    none = F.array().cast(_STRINGS)
    units, paths = F.coalesce("ground_truth_unit_ids", none), F.coalesce("ground_truth_paths", none)
    even = lambda a, n: F.filter(a, lambda x: F.length(x) % n != 0)
    band = lambda a: F.transform(a, lambda u: F.struct(u.alias("unit_id"), F.when(F.length(u) % 2 == 0, "top_authority").otherwise("useful_support").alias("rank_band")))
    x = f.join(e, "trace_id").select(
        F.col("id").alias("fixture_id"), paths.alias("must_paths"), F.filter(paths, lambda p: F.length(p) % 17 == 0).alias("no_paths"), F.coalesce("retrieval_issue_codes", none).alias("must_reasons"),
        F.when(F.col("e.confidence_level") == "low", F.array(F.lit("confidence_low"))).alias("must_warnings"), none.alias("must_degradations"), none.alias("must_risks"), F.transform(units, lambda u: F.regexp_replace(u, "^.*/", "")).alias("must_units"),
        band(units).alias("bands"), F.lit(None).cast("string").alias("level"), F.lit("medium").alias("least_level"), F.when(F.col("feedback_outcome") == "helpful", "draft_patch_safe").alias("posture"),
        F.array(F.lit("draft_patch_safe"), F.lit("plan_safe"), F.lit("autonomy_blocked")).alias("postures"), F.array(F.lit("completed"), F.lit("truncated")).alias("statuses"), F.lit("enclosing_unit").alias("raw_ceiling"),
        (F.col("feedback_outcome") == "abandoned").alias("review"), F.array(F.lit("autonomy_blocked")).alias("review_postures"),
        even(paths, 19).alias("paths"), F.filter(F.coalesce("retrieval_issue_codes", none), lambda x: x != "too_broad").alias("reasons"), F.array(F.lit("confidence_low")).alias("warnings"), none.alias("degradations"), none.alias("risks"),
        even(units, 7).alias("top_units"), band(even(units, 5)).alias("ranked"), F.col("e.confidence_level").alias("confidence_level"), F.col("e.autonomy_posture").alias("autonomy_posture"), F.col("e.result_status").alias("result_status"),
        F.col("e.raw_fetch_level").alias("raw_level"), F.when(F.col("feedback_reason").isNull(), F.array(F.lit("human_review_required"))).alias("steps"),
    )
    return fixture_failures(x)


def _judged(spark, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    from rookery.operators.context import capabilities, selections
    from rookery.operators.graph import impact

    r, q, u, e = _selection_parts(spark, d)
    return r, guardrails(selections(r, q), capabilities(r), hints := impact(focus(r), u, e)), hints


QUERIES = {
    "scr_12_full_guardrails": lambda s, d: _judged(s, d)[1],
    "scr_14_estimates": lambda s, d: token_estimates((x := _judged(s, d))[0], x[2]),
    "prj_02_projection": lambda s, d: with_projection(top_reasons(_parts(s, d)[0]), "selection", "api-shape").select("query_id", "projection_profile", "recommended_projection_profile"),
    "prj_03_query_summary": lambda s, d: query_summary(_queries(s, d)),
    "prj_07_stages": _stages,
    "agg_32_top_reasons": lambda s, d: top_reasons(_parts(s, d)[0]),
    "agg_32_modules": lambda s, d: selected_modules(_parts(s, d)[0]),
    "agg_32_capability_units": lambda s, d: capability_units(_parts(s, d)[0]).select("query_id", "unit_id"),
    "val_02_fixtures": _fixtures,
}


def _queries(spark, d: str) -> DataFrame:
    from rookery.plans.views import linked_units

    return ranking_queries(linked_units(spark, d))


def _stage_sql() -> str:
    from rookery.operators.context import _COMPACT
    from rookery.operators.projections import _selection_sql

    return (
        _selection_sql()
        + f""", gg as (select query_id, count(*) as units, count(distinct path) as files, count(*) filter (rank_band = 'top_authority') as top from rk group by query_id),
        fk as (select query_id, place, {_COMPACT} as tokens, sum({_COMPACT}) over (partition by query_id order by place) as used from rk), kk as (select query_id, count(*) as kept, sum(tokens) as tokens from fk where used <= 180 and place <= 5 group by query_id),
        ss as (select q.query_id, len(symbols) + len(paths) + len(modules) + len(tests) as targets, len(prefixes) as limits, coalesce(units, 0) as units, coalesce(files, 0) as files, coalesce(top, 0) as top, coalesce(kept, 0) as kept, coalesce(tokens, 0) as tokens,
          confidence_level = 'low' or contains(warnings, 'parser_fallback') as weak, case when warnings = '' then 0 else len(string_split(warnings, ',')) end as n_warn from q left join gg using (query_id) left join kk using (query_id) join sel using (query_id)),
        st as (select query_id, 1 as place, 'query_validation' as stage, 'completed' as status, targets as counter_a, limits as counter_b, 2 as duration_ms from ss union all select query_id, 2, 'candidate_generation', 'completed', units, files, 7 from ss
          union all select query_id, 3, 'ranking', 'completed', units, top, 4 from ss union all select query_id, 4, 'context_packet_assembly', case when units > 0 and kept = 0 then 'budget_exhausted' when kept < least(units, 5) then 'truncated' else 'completed' end, kept, tokens, 5 from ss
          union all select query_id, 5, 'raw_code_fetch', 'skipped', 0, 0, 0 from ss union all select query_id, 6, 'result_finalization', case when weak then 'degraded' else 'completed' end, n_warn, weak::int, 2 from ss)
        select query_id, place::int as place, stage, status, stage || '.' || status as event_name, counter_a::bigint as counter_a, counter_b::bigint as counter_b, duration_ms::int as duration_ms from st"""
    )


def _impact_sql() -> str:
    """The verdicts as ``verdict`` and the impact hints as ``imp``."""
    from rookery.operators.context import _COMPACT
    from rookery.operators.graph import IMPACT_SQL
    from rookery.operators.projections import _selection_sql

    body, last = IMPACT_SQL.rsplit("\nselect query_id, hint", 1)
    return _selection_sql().replace(", sel as (", ", verdict as (") + f", sel as (select query_id, root, unit_id, path, module from (select *, sum({_COMPACT}) over (partition by query_id order by place) as used from rk) where used <= 180 and place <= 5)" + body + ", imp as (select query_id, hint" + last + ")"


def _guard_sql() -> str:
    codes = lambda *cs: "array_to_string(list_filter([" + ", ".join(f"case when {c} then '{code}' end" for c, code in cs) + "], lambda x: x is not null), ',')"
    return (
        _impact_sql()
        + """, rn as (select query_id, count(*) as n from imp where hint = 'risky_neighbors' group by query_id),
      gr as (select v.*, coalesce(cap.coverage = 'fallback_only', false) as fo, coalesce(rn.n > 2, false) as broad, confidence_ceiling <> 'high' as lim, case when coalesce(cap.coverage = 'fallback_only', false) then 'autonomy_blocked' when confidence_level = 'high' then 'draft_patch_safe' when confidence_level = 'medium' then 'plan_safe' else 'autonomy_blocked' end as autonomy_posture
        from verdict v left join cap using (query_id) left join rn using (query_id)) select query_id, autonomy_posture, """
        + codes(("autonomy_posture = 'autonomy_blocked' and confidence_level = 'low'", "confidence_low"), ("fo", "capability_low"), ("autonomy_posture = 'autonomy_blocked' and lim", "capability_ceiling"), ("broad", "impact_broad"))
        + """ as blocking_reasons, case autonomy_posture when 'draft_patch_safe' then 'run_targeted_tests' when 'plan_safe' then 'fetch_more_context' else 'human_review_required' end as required_next_step,
      case autonomy_posture when 'draft_patch_safe' then 'draft_patch_on_selected_unit_only' when 'plan_safe' then 'plan_only' else 'analysis_only' end as scope, """
        + codes(("broad", "impact_broad"), ("fo", "capability_low"), ("lim", "capability_ceiling"), ("autonomy_posture = 'autonomy_blocked'", "review_gate"))
        + " as risk_flags from gr"
    )


def _estimate_sql() -> str:
    from rookery.operators.context import _COMPACT

    return _impact_sql() + f" select query_id, ceil(sum(length(coalesce(signature, '')) + length(coalesce(symbol, ''))) / 4.0)::bigint as structure_tokens, sum(ceil(length(coalesce(signature, '')) / 4.0)::bigint)::bigint as skeleton_tokens, sum({_COMPACT})::bigint as compact_tokens, coalesce((select ceil((sum(length(value)) + 48) / 4.0)::bigint from imp where imp.query_id = rk.query_id), 12) as impact_tokens from rk group by query_id"


_SAME = lambda a, w: f"(ends_with({a}, {w}) or (contains({a}, '::') and contains({w}, '::') and (ends_with(regexp_extract({a}, '^.*?::(.*)$', 1), regexp_extract({w}, '^.*?::(.*)$', 1)) or ends_with({a}, regexp_extract({w}, '^.*?::(.*)$', 1)))))"
SQL = {
    "scr_12_full_guardrails": _guard_sql(),
    "scr_14_estimates": _estimate_sql(),
    "prj_02_projection": RANK_SQL + "select distinct query_id, 'selection' as projection_profile, 'api_shape' as recommended_projection_profile from rk",
    "prj_03_query_summary": RANK_SQL
    + """select query_id, array_to_string(list_concat([('symbol: ' || x) for x in symbols], [('path: ' || x) for x in paths], [('module: ' || x) for x in modules], [('test: ' || x) for x in tests]), '; ') as targets_summary,
      array_to_string([('allowed_path_prefix ' || x) for x in prefixes], '; ') as constraints_summary,
      array_to_string(list_filter([case when len(preferred_paths) > 0 then 'preferred_paths' end, case when len(preferred_modules) > 0 then 'preferred_modules' end, case when len(suspected) > 0 then 'suspected_symbols' end, case when definitions then 'prefer_definitions_over_callers' end], lambda x: x is not null), '; ') as hints_summary from q""",
    "prj_07_stages": _stage_sql(),
    "agg_32_top_reasons": RANK_SQL + ", fr as (select query_id, code, min(place * 100 + i) as spot from (select query_id, place, unnest(codes) as code, generate_subscripts(codes, 1) as i from rk) group by all), fx as (select *, row_number() over (partition by query_id order by spot) as n from fr) select query_id, string_agg(code, ',' order by spot) as reasons from fx where n <= 10 group by query_id",
    "agg_32_modules": RANK_SQL + "select distinct query_id, module from rk where module is not null",
    "agg_32_capability_units": RANK_SQL + "select query_id, unit_id from (select *, bool_or(rank_band in ('top_authority', 'useful_support')) over (partition by query_id) as sure from rk) where rank_band in ('top_authority', 'useful_support') or not sure",
    "val_02_fixtures": f"""with e as (select trace_id, arg_max(struct_pack(c := confidence_level, a := autonomy_posture, r := result_status, f := raw_fetch_level), id) as e from semantic_usage_events where trace_id is not null group by trace_id),
    x as (select id as fixture_id, coalesce(ground_truth_paths, []) as p, coalesce(ground_truth_unit_ids, []) as u, coalesce(retrieval_issue_codes, []) as i, feedback_outcome as o, feedback_reason as why, e.c as lvl, e.a as pos, e.r as st, e.f as raw from semantic_usage_feedback join e using (trace_id)),
    y as (select *, list_filter(u, lambda a: length(a) % 7 <> 0) as top, list_filter(u, lambda a: length(a) % 5 <> 0) as rk, list_transform(u, lambda a: regexp_replace(a, '^.*/', '')) as mu from x)
    select fixture_id, case when len(list_filter(p, lambda a: length(a) % 19 = 0)) > 0 then 'missing required paths'
      when len(list_filter(p, lambda a: length(a) % 19 <> 0 and length(a) % 17 = 0)) > 0 then 'found excluded paths'
      when list_contains(i, 'too_broad') then 'missing selection reason codes'
      when len(list_filter(mu, lambda w: len(list_filter(top, lambda a: {_SAME('a', 'w')})) = 0)) > 0 then 'missing top authority units'
      when len(list_filter(u, lambda w: coalesce(list_filter(rk, lambda a: {_SAME('a', 'w')})[1], '') = '' or length(list_filter(rk, lambda a: {_SAME('a', 'w')})[1]) % 2 <> length(w) % 2)) > 0 then 'rank band expectation mismatch'
      when coalesce(lvl, '') not in ('medium', 'high') then 'confidence too low'
      when o = 'helpful' and coalesce(pos, '') <> 'draft_patch_safe' then 'autonomy posture mismatch'
      when coalesce(pos, '') not in ('draft_patch_safe', 'plan_safe', 'autonomy_blocked') then 'autonomy posture not allowed'
      when coalesce(st, '') not in ('completed', 'truncated') then 'result status not allowed'
      when coalesce(raw, 'none') in ('local_neighborhood', 'whole_file') then 'raw fetch level exceeded'
      when coalesce(o = 'abandoned', false) and coalesce(pos, '') <> 'autonomy_blocked' then 'review-required fixture must be blocked'
      when coalesce(pos, '') = 'autonomy_blocked' and why is not null then 'expected human_review_required' end as failed from y""",
}
