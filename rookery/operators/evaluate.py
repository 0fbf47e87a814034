"""Replay evaluation: relational division per query, scorecards, comparison of two policies, rankings and histories.

A result passes if its top-authority units hold all required ones, its paths all required paths, and its confidence reaches the
least level; what is not asked for passes. Rates of nothing are 0.0. Deltas are compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.operators.usage import rate
from rookery.sources.tables import table

RANK = ("low", "medium", "high")
SCORE = {"high": 0.9, "medium": 0.62, "low": 0.3}
#: Metrics and whether more of them is better.
METRICS = {"top_authority_hit_rate": True, "required_path_hit_rate": True, "confidence_pass_rate": True, "pass_rate": True, "degraded_rate": False, "mae": False}


def level_rank(c: Column) -> Column:
    return F.when(c == "high", 2).when(c == "medium", 1).when(c == "low", 0)


def judged(results: DataFrame) -> DataFrame:
    """Adds top_ok, paths_ok, confidence_ok and ok to (required_units, top_units, required_paths, paths, confidence_level, min_confidence_level)."""
    holds = lambda need, got: F.size(F.array_except(F.coalesce(need, F.array().cast("array<string>")), F.coalesce(got, F.array().cast("array<string>")))) == 0
    sure = F.col("min_confidence_level").isNull() | (F.coalesce(level_rank(F.col("confidence_level")), F.lit(-1)) >= F.coalesce(level_rank(F.col("min_confidence_level")), F.lit(0)))
    x = results.withColumns({"top_ok": holds(F.col("required_units"), F.col("top_units")), "paths_ok": holds(F.col("required_paths"), F.col("paths")), "confidence_ok": sure})
    return x.withColumn("ok", F.col("top_ok") & F.col("paths_ok") & F.col("confidence_ok"))


def scorecard(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rates and the mean absolute error of confidence against success."""
    n, c = F.count(F.lit(1)), F.count_if
    miss = F.abs(F.coalesce(F.when(F.col("confidence_level") == "high", 0.9).when(F.col("confidence_level") == "medium", 0.62).when(F.col("confidence_level") == "low", 0.3), F.lit(0.3)) - F.col("ok").cast("int"))
    return rows.groupBy(*keys).agg(
        n.alias("queries"), rate(c("top_ok"), n).alias("top_authority_hit_rate"), rate(c("paths_ok"), n).alias("required_path_hit_rate"), rate(c("confidence_ok"), n).alias("confidence_pass_rate"),
        rate(c("ok"), n).alias("pass_rate"), rate(c("degraded"), n).alias("degraded_rate"), F.round(F.avg(miss), 9).alias("mae"),
    )


def compared(rows: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """metric, baseline, candidate, delta, regressed; over protected queries where there are any."""
    own = rows.where(F.col("policy").isin(baseline, candidate))
    has = own.groupBy().agg(F.coalesce(F.max("protected_case"), F.lit(False))).scalar()
    card = scorecard(own.where(F.col("protected_case") | ~has), ["policy"])
    flat = card.select("policy", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v"), F.lit(up).alias("up")) for m, up in METRICS.items()])))
    x = flat.groupBy("metric", "up").agg(F.max(F.when(F.col("policy") == baseline, F.col("v"))).alias("baseline"), F.max(F.when(F.col("policy") == candidate, F.col("v"))).alias("candidate"))
    delta = F.round(F.col("candidate") - F.col("baseline"), 9)
    return x.select("metric", "baseline", "candidate", delta.alias("delta"), F.when(F.col("up"), delta < 0).otherwise(delta > 0).alias("regressed"))


def newly_failed(rows: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """Queries the candidate fails and the baseline does not."""
    bad = lambda p: rows.where((F.col("policy") == p) & ~F.col("ok")).select("query_id")
    return bad(candidate).distinct().join(bad(baseline).distinct(), "query_id", "left_anti")


def ranked_policies(card: DataFrame) -> DataFrame:
    """Policies by pass, top, path and confidence rates down, then degraded rate and error up, then name. There are few policies."""
    order = [F.col("pass_rate").desc(), F.col("top_authority_hit_rate").desc(), F.col("required_path_hit_rate").desc(), F.col("confidence_pass_rate").desc(), "degraded_rate", "mae", "policy"]
    return card.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def streaks(runs: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Length of the latest run of equal values per group: gaps and islands from the end."""
    w = Window.partitionBy(group).orderBy(*[F.col(c).desc() for c in order])
    x = runs.withColumn("_last", F.first(value).over(w)).withColumn("_off", F.sum((~F.col(value).eqNullSafe(F.col("_last"))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.where("_off = 0").groupBy(group).agg(F.max("_last").alias("last_value"), F.count(F.lit(1)).alias("streak"))


def history_counts(runs: DataFrame, dims: list[str]) -> DataFrame:
    """Counts by each of several dimensions, in one pass over grouping sets."""
    flat = runs.select(F.inline(F.array(*[F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("none")).alias("value")) for c in dims])))
    return flat.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


#: Dimensions of a run's history, and what a reason asks for (fixed values).
HISTORY = ("selection_mode", "promotion_reason", "selected_policy_id", "selected_approval_tier", "selected_promotion_mode")
ACTIONS = {
    "multiple_eligible_candidates": "choose_best_candidate_from_ranking", "insufficient_candidate_streak": "wait_for_next_consistent_review_run", "promotion_cooldown_active": "wait_for_cooldown_window_to_expire",
    "all_candidates_blocked_by_governance": "review_governance_tier_and_candidate_policy", "no_protected_queries": "collect_more_feedback", "manual_approval_required": "review_candidate_and_decide_promotion",
}


def last_runs(runs: DataFrame, limit: int | None = None) -> DataFrame:
    """The last ``limit`` runs by generated_at and run_id, or all."""
    return runs if limit is None else runs.orderBy(F.col("generated_at").desc(), F.col("run_id").desc(), *(["item_key"] if "item_key" in runs.columns else [])).limit(max(0, limit))


def run_history(runs: DataFrame, limit: int | None = None) -> DataFrame:
    """dimension, value, n of the last runs: totals, promoted and skipped ones, and each of ``HISTORY``; nulls are no values."""
    x = last_runs(runs, limit)
    e = lambda d, v: F.struct(F.lit(d).alias("dimension"), v.cast("string").alias("value"))
    each = F.array(e("runs", F.lit("total")), e("runs", F.when(F.col("promoted"), "promoted")), e("runs", F.when(F.col("skipped"), "skipped")), *[e(c, F.col(c)) for c in HISTORY])
    return x.select(F.inline(each)).where("value is not null").groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def review_queue(runs: DataFrame, reviews: DataFrame, limit: int | None = None) -> DataFrame:
    """What waits for a decision: one item per key, of each key the latest; the last ``limit`` of them.

    ``runs`` (run_id, generated_at, promotion_reason, review_run_id, selected_policy_id, selected_version) give an item where their reason asks for
    something; ``reviews`` (run_id, generated_at, reason, root_path, surface, tenant_id, candidates: array of policy_id and version) one where they
    lack protected queries and one for each candidate that a person has to approve."""
    part = lambda *cs: F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in cs])
    reason = F.col("promotion_reason")
    by_review = reason.isin("multiple_eligible_candidates", "all_candidates_blocked_by_governance")
    key = F.when(by_review, part(reason, F.col("review_run_id"))).otherwise(part(reason, F.col("selected_policy_id"), F.col("selected_version")))
    policy = F.when(~by_review, F.concat_ws("@", "selected_policy_id", "selected_version"))
    own = runs.where(reason.isin(*[r for r in ACTIONS if r not in ("no_protected_queries", "manual_approval_required")])).select("run_id", "generated_at", reason.alias("reason_code"), key.alias("item_key"), policy.alias("policy"))
    gaps = reviews.where("reason = 'no_protected_queries'").select("run_id", "generated_at", F.col("reason").alias("reason_code"), part(F.col("reason"), F.col("root_path"), F.col("surface"), F.col("tenant_id")).alias("item_key"), F.lit(None).cast("string").alias("policy"))
    manual = reviews.select("run_id", "generated_at", F.explode("candidates").alias("c")).select(
        "run_id", "generated_at", F.lit("manual_approval_required").alias("reason_code"), part(F.lit("manual_approval_required"), F.col("c.policy_id"), F.col("c.version")).alias("item_key"), F.concat_ws("@", "c.policy_id", "c.version").alias("policy")
    )
    items = own.unionByName(gaps).unionByName(manual)
    latest = items.groupBy("item_key").agg(F.max(F.struct("generated_at", "run_id", "reason_code", "policy")).alias("v")).select("item_key", "v.*")
    action = F.create_map(*[F.lit(v) for kv in ACTIONS.items() for v in kv])[F.col("reason_code")]
    return last_runs(latest, limit).select("item_key", "generated_at", "run_id", "reason_code", "policy", action.alias("required_action"))


def stored_runs(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Runs and reviews in the shape of a governance history, made of stored feedback: its outcome stands for a run's reason."""
    f = table(spark, d, "semantic_usage_feedback")
    reasons = F.create_map(*[F.lit(v) for kv in zip(("helpful", "partially_helpful", "not_helpful", "abandoned"), list(ACTIONS)[:4]) for v in kv])
    runs = f.select(
        F.col("id").alias("run_id"), F.col("occurred_at").alias("generated_at"), (F.col("feedback_outcome") == "helpful").alias("promoted"), (F.col("feedback_outcome") == "abandoned").alias("skipped"), F.col("surface").alias("selection_mode"),
        reasons[F.col("feedback_outcome")].alias("promotion_reason"), F.col("session_id").alias("review_run_id"), F.col("tenant_id").alias("selected_policy_id"), F.col("confidence_level").alias("selected_version"),
        F.col("confidence_level").alias("selected_approval_tier"), F.col("followup_action").alias("selected_promotion_mode"),
    )
    gap = F.when(F.size(F.coalesce("ground_truth_paths", F.array().cast("array<string>"))) == 0, "no_protected_queries")
    candidates = F.transform(F.array_distinct(F.coalesce("retrieval_issue_codes", F.array().cast("array<string>"))), lambda i: F.struct(i.alias("policy_id"), F.col("confidence_level").alias("version")))
    reviews = f.select(F.col("id").alias("run_id"), F.col("occurred_at").alias("generated_at"), gap.alias("reason"), F.col("root_path_hash").alias("root_path"), "surface", "tenant_id", candidates.alias("candidates"))
    return runs, reviews


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same keys, others are appended."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def replayed(spark, d: str) -> DataFrame:
    """Replay rows of two policies from stored feedback: the ground truth is required; each policy misses some of it by a fixed rule."""
    f = table(spark, d, "semantic_usage_feedback")
    none = F.array().cast("array<string>")
    units, paths = F.coalesce("ground_truth_unit_ids", none), F.coalesce("ground_truth_paths", none)
    base = f.select(F.col("id").alias("query_id"), units.alias("required_units"), paths.alias("required_paths"), "confidence_level", F.lit("medium").alias("min_confidence_level"), F.col("feedback_outcome").isin("not_helpful", "abandoned").alias("protected_case"), (F.col("id") % 9 == 0).alias("degraded"))
    less = lambda n: [F.filter("required_units", lambda u: F.length(u) % n != 0).alias("top_units"), F.filter("required_paths", lambda u: F.length(u) % (n + 6) != 0).alias("paths")]
    return judged(base.select("*", F.lit("baseline").alias("policy"), *less(3)).unionByName(base.select("*", F.lit("candidate").alias("policy"), *less(5))).withColumn("protected_case", F.coalesce("protected_case", F.lit(False))))


def _registry(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Entries of a registry by (policy, version): those of two outcomes, the second one the newer."""
    f = table(spark, d, "semantic_usage_feedback").where("tenant_id is not null and confidence_level is not null")
    of = lambda o: f.where(F.col("feedback_outcome") == o).groupBy(F.col("tenant_id").alias("policy_id"), F.col("confidence_level").alias("version")).agg(F.max("id").alias("entry"), F.lit(o).alias("state"))
    return of("helpful"), of("not_helpful")


_KEY = lambda *cs: "concat_ws(chr(31), " + ", ".join(f"coalesce({c}::varchar, '')" for c in cs) + ")"
_RUNS = (
    "with r as (select id as run_id, occurred_at as generated_at, feedback_outcome = 'helpful' as promoted, feedback_outcome = 'abandoned' as skipped, surface as selection_mode, case feedback_outcome "
    + " ".join(f"when '{o}' then '{a}'" for o, a in zip(("helpful", "partially_helpful", "not_helpful", "abandoned"), list(ACTIONS)[:4]))
    + """ end as promotion_reason, session_id as review_run_id, tenant_id as selected_policy_id, confidence_level as selected_version, confidence_level as selected_approval_tier, followup_action as selected_promotion_mode,
      root_path_hash, surface, tenant_id, len(coalesce(ground_truth_paths, [])) = 0 as gap, list_distinct(coalesce(retrieval_issue_codes, [])) as codes, feedback_outcome from semantic_usage_feedback)
"""
)
_HISTORY = lambda src: " union all ".join(["select 'runs' as dimension, 'total' as value, count(*) as n from " + src + " having count(*) > 0"] + [f"select 'runs', '{c}', count(*) from {src} where {c} having count(*) > 0" for c in ("promoted", "skipped")] + [f"select '{c}', {c}::varchar, count(*) from {src} where {c} is not null group by {c}" for c in HISTORY])
_QUEUE = (
    _RUNS
    + f""", it as (select run_id, generated_at, promotion_reason as reason_code, case when feedback_outcome in ('helpful', 'abandoned') then {_KEY('promotion_reason', 'review_run_id')} else {_KEY('promotion_reason', 'selected_policy_id', 'selected_version')} end as item_key,
      case when feedback_outcome not in ('helpful', 'abandoned') then concat_ws('@', selected_policy_id, selected_version) end as policy from r where promotion_reason is not null
    union all select run_id, generated_at, 'no_protected_queries', {_KEY("'no_protected_queries'", 'root_path_hash', 'surface', 'tenant_id')}, null from r where gap
    union all select run_id, generated_at, 'manual_approval_required', {_KEY("'manual_approval_required'", 'c', 'selected_version')}, concat_ws('@', c, selected_version) from (select *, unnest(codes) as c from r)),
    lt as (select * from it qualify row_number() over (partition by item_key order by generated_at desc, run_id desc, policy desc nulls last) = 1)
"""
)
_ACTION = "case reason_code " + " ".join(f"when '{k}' then '{v}'" for k, v in ACTIONS.items()) + " end"
_REPLAY = """with b as (select id as query_id, list_filter(coalesce(ground_truth_unit_ids, []), lambda x: true) as ru, coalesce(ground_truth_paths, []) as rp, confidence_level, coalesce(feedback_outcome in ('not_helpful', 'abandoned'), false) as protected_case, id % 9 = 0 as degraded from semantic_usage_feedback),
p as (select *, 'baseline' as policy, 3 as n from b union all select *, 'candidate', 5 from b),
r as (select *, len(list_filter(ru, lambda u: length(u) % n = 0)) = 0 as top_ok, len(list_filter(rp, lambda u: length(u) % (n + 6) = 0)) = 0 as paths_ok, coalesce(confidence_level in ('medium', 'high'), false) as confidence_ok from p),
s as (select *, top_ok and paths_ok and confidence_ok as ok from r)"""
_CARD = """select policy, count(*) as queries, (count(*) filter (top_ok))::double / count(*) as top_authority_hit_rate, (count(*) filter (paths_ok))::double / count(*) as required_path_hit_rate, (count(*) filter (confidence_ok))::double / count(*) as confidence_pass_rate,
 (count(*) filter (ok))::double / count(*) as pass_rate, (count(*) filter (degraded))::double / count(*) as degraded_rate, round(avg(abs((case confidence_level when 'high' then 0.9 when 'medium' then 0.62 else 0.3 end)::double - ok::int)), 9) as mae from {s} group by policy"""
QUERIES = {
    "agg_17_judged": lambda s, d: replayed(s, d).select("policy", "query_id", "top_ok", "paths_ok", "confidence_ok", "ok"),
    "agg_16_scorecard": lambda s, d: scorecard(replayed(s, d), ["policy"]),
    "agg_18_compared": lambda s, d: compared(replayed(s, d), "baseline", "candidate"),
    "set_04_newly_failed": lambda s, d: newly_failed(replayed(s, d), "baseline", "candidate"),
    "srt_05_ranked_policies": lambda s, d: ranked_policies(scorecard(replayed(s, d), ["policy"])).select("policy", "place"),
    "win_07_streaks": lambda s, d: streaks(table(s, d, "semantic_usage_feedback"), "tenant_id", ["occurred_at", "id"], "feedback_outcome"),
    "agg_23_run_history": lambda s, d: run_history(stored_runs(s, d)[0]),
    "agg_23_last_runs": lambda s, d: run_history(stored_runs(s, d)[0], 50),
    "agg_24_review_queue": lambda s, d: review_queue(*stored_runs(s, d)),
    "agg_24_queue_counts": lambda s, d: review_queue(*stored_runs(s, d), 100).groupBy("reason_code", "required_action").agg(F.count(F.lit(1)).alias("n")),
    "set_07_upserted": lambda s, d: upserted(*_registry(s, d), ["policy_id", "version"]),
}
SQL = {
    "agg_17_judged": _REPLAY + " select policy, query_id, top_ok, paths_ok, confidence_ok, ok from s",
    "agg_16_scorecard": _REPLAY + _CARD.format(s="s"),
    "agg_18_compared": _REPLAY
    + ", c as ("
    + _CARD.format(s="s where protected_case")
    + "), m as ("
    + " union all ".join(f"select '{m}' as metric, max({m}) filter (policy = 'baseline') as baseline, max({m}) filter (policy = 'candidate') as candidate, {str(up).lower()} as up from c" for m, up in METRICS.items())
    + ") select metric, baseline, candidate, round(candidate - baseline, 9) as delta, case when up then round(candidate - baseline, 9) < 0 else round(candidate - baseline, 9) > 0 end as regressed from m",
    "set_04_newly_failed": _REPLAY + " select query_id from s where policy = 'candidate' and not ok except select query_id from s where policy = 'baseline' and not ok",
    "srt_05_ranked_policies": _REPLAY + ", c as (" + _CARD.format(s="s") + ") select policy, row_number() over (order by pass_rate desc, top_authority_hit_rate desc, required_path_hit_rate desc, confidence_pass_rate desc, degraded_rate, mae, policy)::int as place from c",
    "win_07_streaks": """with l as (select *, first_value(feedback_outcome) over w as last_value, from semantic_usage_feedback window w as (partition by tenant_id order by occurred_at desc, id desc)),
    o as (select *, sum((feedback_outcome is distinct from last_value)::int) over (partition by tenant_id order by occurred_at desc, id desc rows between unbounded preceding and current row) as off from l)
    select tenant_id, max(last_value) as last_value, count(*) as streak from o where off = 0 group by tenant_id""",
    "agg_23_run_history": _RUNS + _HISTORY("r"),
    "agg_23_last_runs": _RUNS + ", l as (select * from r order by generated_at desc, run_id desc limit 50) " + _HISTORY("l"),
    "agg_24_review_queue": _QUEUE + f"select item_key, generated_at, run_id, reason_code, policy, {_ACTION} as required_action from lt",
    "agg_24_queue_counts": _QUEUE + f", lc as (select * from lt order by generated_at desc, run_id desc, item_key limit 100) select reason_code, {_ACTION} as required_action, count(*) as n from lc group by all",
    "set_07_upserted": """with g as (select tenant_id as policy_id, confidence_level as version, max(id) as entry, feedback_outcome as state from semantic_usage_feedback where tenant_id is not null and confidence_level is not null and feedback_outcome in ('helpful', 'not_helpful') group by all)
    select policy_id, version, entry, state from g qualify state = 'not_helpful' or count(*) over (partition by policy_id, version) = 1""",
}
