"""Usage analytics over event and feedback streams.

Every report is one pass over a filtered scan with conditional aggregates; the payload is parsed once, into the few fields the
reports read. Events and feedback meet on a correlation key: (trace, request) where both are given, else (session, task),
else none; the first kind never meets the second. Feedback is reduced to one row per key before it is joined, so a key that
very many events share costs each of them one row, and rows without a key are not shuffled to one place.

Rates and means of nothing are 0.0. The p95 is the value at place ceil(0.95 * (n - 1)) of the sorted measurements, counted from 0.
Null latencies are left out. Events count as delivered (redeliveries count again) unless ``once`` is applied first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.functions.text import label
from rookery.sources.tables import table

PAYLOAD = (
    "stage_name string, stage_result_status string, reserved_tokens bigint, estimated_tokens bigint, returned_tokens bigint, within_budget boolean, truncation_count bigint, "
    "fallback_units bigint, policy_id string, policy_version string, query string, query_ingress_mode string, recommended_action string, snapshot_id string, selection_id string, "
    "selected_paths array<string>, selected_unit_ids array<string>, outcome_summary struct<confidence_score:double>"
)
STAGES = {"resolve_context": "selection", "expand_context": "expand", "fetch_context_detail": "detail"}
#: Scores of feedback outcomes in calibration and in evaluation, and penalties of issue codes (fixed values).
CALIBRATION_SCORE = {"helpful": 1.0, "partially_helpful": 0.5, "not_helpful": 0.0, "abandoned": 0.0}
EVALUATION_SCORE = {"helpful": 1.0, "partially_helpful": 0.5, "not_helpful": 0.0, "abandoned": -0.25}
LEVEL_SCORE = {"high": 0.9, "medium": 0.65, "low": 0.35}
LEVEL_RANK = {"low": 0, "medium": 1, "high": 2}
ISSUE_PENALTY = {"missing_authority": 0.45, "wrong_scope": 0.35, "too_broad": 0.2, "too_shallow": 0.2, "latency_too_high": 0.1, "confidence_miscalibrated": 0.15}
DIFFICULT_OUTCOMES = ("not_helpful", "abandoned")
DIFFICULT_ISSUES = ("missing_authority", "wrong_scope", "too_broad", "too_shallow", "confidence_miscalibrated")


def lookup(values: dict[str, float], key: Column) -> Column:
    """A small literal table as a CASE; null where the key is not in it."""
    c = F.when(F.lit(False), F.lit(None).cast("double"))
    for k, v in values.items():
        c = c.when(key == k, F.lit(v))
    return c


def rate(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0.0 for an empty whole."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def normalized_events(events: DataFrame) -> DataFrame:
    """Defaults for missing labels and the payload as a struct ``p``; an unreadable payload has no fields."""
    return events.withColumns(
        {
            "surface": F.coalesce(label("surface"), F.lit("library")),
            "operation": F.coalesce(label("operation"), F.lit("unknown")),
            "status": F.coalesce("status", F.lit("success")),
            "p": F.from_json("payload", PAYLOAD),
        }
    )


def normalized_feedback(feedback: DataFrame) -> DataFrame:
    """Defaults for missing labels; lists without nulls, blanks and repetitions."""
    tidy = lambda c: F.array_distinct(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != "")))
    out = {"surface": F.coalesce(label("surface"), F.lit("library")), "operation": F.coalesce(label("operation"), F.lit("resolve_context"))}
    return feedback.withColumns(out | {c: tidy(c) for c in ("retrieval_issue_codes", "ground_truth_unit_ids", "ground_truth_paths")})


def once(rows: DataFrame, key: str, order: str = "id") -> DataFrame:
    """The first delivery of each key; rows without key are kept."""
    w = Window.partitionBy(F.coalesce(F.col(key), F.concat(F.lit("\0"), F.col(order).cast("string")))).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def filtered(rows: DataFrame, surface: str | None = None, operation: str | None = None, tenant_id: str | None = None, root_path_hash: str | None = None, since: str | None = None) -> DataFrame:
    """Optional equalities and an inclusive lower bound of the time."""
    for c, v in (("surface", surface), ("operation", operation), ("tenant_id", tenant_id), ("root_path_hash", root_path_hash)):
        if v is not None:
            rows = rows.where(F.col(c) == v)
    return rows if since is None else rows.where(F.col("occurred_at") >= F.lit(since).cast("timestamp_ntz"))


def correlation_key() -> Column:
    """A tagged key, or null."""
    has = lambda a, b: (F.coalesce(F.col(a), F.lit("")) != "") & (F.coalesce(F.col(b), F.lit("")) != "")
    return F.when(has("trace_id", "request_id"), F.concat_ws("\x1f", F.lit("tr"), "trace_id", "request_id")).when(has("session_id", "task_id"), F.concat_ws("\x1f", F.lit("st"), "session_id", "task_id"))


def stage_name() -> Column:
    """The stage in the payload, else by operation."""
    c = F.col("p.stage_name")
    for op, stage in STAGES.items():
        c = F.coalesce(c, F.when(F.col("operation") == op, F.lit(stage)))
    return c


def _coarse(v: Column) -> Column:
    """A bucket number that rises with v: values below 1024 have their own, above it goes by length and top 10 bits."""
    n = F.length(F.bin(v))
    return F.when(v < 1024, v).otherwise(n * 1024 + F.expr("shiftright(v, cast(length(bin(v)) as int) - 11)") % 1024)


def p95(value: Column, keys: list[str], rows: DataFrame) -> DataFrame:
    """keys, p95_ms by the nearest-rank rule, exactly, for groups of any size.

    Counts by value are made first; then the group's place is found among at most 56 thousand coarse buckets, and only the
    values of that bucket are ordered. Negative values share one bucket."""
    n = rows.where(value.isNotNull()).groupBy(*keys, value.cast("bigint").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    n = n.withColumn("b", F.when(F.col("v") < 0, F.lit(-1)).otherwise(_coarse(F.col("v"))).cast("bigint"))
    w = Window.partitionBy(*keys)
    upto = lambda by: F.sum("c").over(w.orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    coarse = n.groupBy(*keys, "b").agg(F.sum("c").alias("c")).withColumns({"upto": upto("b"), "n": F.sum("c").over(w)})
    rank = F.ceil(F.lit(0.95) * (F.col("n") - 1))
    hit = coarse.where((F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank)).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("b").alias("_b"), (rank - (F.col("upto") - F.col("c"))).alias("place"))
    same = F.col("b") == F.col("_b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return n.join(hit, same).withColumn("upto", upto("v")).where(F.col("upto") > F.col("place")).groupBy(*keys).agg(F.min("v").alias("p95_ms"))


def latency_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Count, mean, p95 and maximum of latency_ms by group."""
    agg = rows.groupBy(*keys).agg(F.count("latency_ms").alias("n"), F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("mean_ms"), F.coalesce(F.max("latency_ms"), F.lit(0)).alias("max_ms"))
    q = p95(F.col("latency_ms"), keys, rows)
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"q.{k}")) for k in keys]
    j = agg.alias("a").join(q.alias("q"), on, "left")
    return j.select(*[F.col(f"a.{k}") for k in keys], "n", "mean_ms", F.coalesce("p95_ms", F.lit(0)).alias("p95_ms"), "max_ms")


def slo(events: DataFrame, keys: list[str]) -> DataFrame:
    """Totals, cache-hit ratio, degraded and fallback rates of one scan, by group."""
    is_index = F.col("operation").isin("create_index", "update_index")
    is_query = F.col("operation") == "resolve_context"
    cached = (F.col("operation") == "create_index") & F.col("cache_hit").isNotNull()
    degraded = is_query & ((F.col("result_status") == "degraded") | (F.col("status") == "error"))
    n = F.count_if
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"),
        n(is_index).alias("index_events"),
        n(is_query).alias("retrieval_events"),
        rate(n(cached & F.col("cache_hit")), n(cached)).alias("cache_hit_ratio"),
        rate(n(degraded), n(is_query)).alias("degraded_rate"),
        rate(n(is_query & (F.col("p.fallback_units") > 0)), n(is_query)).alias("fallback_rate"),
    )


def stage_tokens(events: DataFrame) -> DataFrame:
    """Count, mean and maximum of reserved, estimated and returned tokens by stage."""
    x = events.where(F.col("operation").isin(*STAGES)).withColumn("stage", stage_name())
    cols = [F.count(F.lit(1)).alias("n")]
    for c in ("reserved", "estimated", "returned"):
        t = f"p.{c}_tokens"
        cols += [F.count(t).alias(f"{c}_n"), F.coalesce(F.avg(t), F.lit(0.0)).alias(f"{c}_mean"), F.coalesce(F.max(t), F.lit(0)).alias(f"{c}_max")]
    return x.groupBy("stage").agg(*cols)


def stage_budgets(events: DataFrame) -> DataFrame:
    """Rates of stages within budget, truncated and out of budget."""
    x = events.where(F.col("operation").isin(*STAGES)).withColumn("stage", stage_name())
    n = F.count(F.lit(1))
    return x.groupBy("stage").agg(
        n.alias("n"),
        rate(F.count_if(F.col("p.within_budget")), n).alias("within_budget_rate"),
        rate(F.count_if(F.col("p.truncation_count") > 0), n).alias("truncated_rate"),
        rate(F.count_if(F.col("p.stage_result_status") == "budget_exhausted"), n).alias("budget_exhausted_rate"),
    )


def policy_versions(events: DataFrame, unversioned: str = "") -> DataFrame:
    """Retrieval events by "id@version"; policies without a version are left out, or counted under the name given for it."""
    version = F.coalesce(F.nullif("p.policy_version", F.lit("")), F.lit(unversioned))
    both = (F.coalesce("p.policy_id", F.lit("")) != "") & (version != "")
    return events.where((F.col("operation") == "resolve_context") & both).groupBy(F.concat(F.col("p.policy_id"), F.lit("@"), version).alias("policy")).agg(F.count(F.lit(1)).alias("n"))


def feedback_by_key(feedback: DataFrame) -> DataFrame:
    """One row per correlation key: scores and the sets of what its feedback says. Lists are sets, so a hot key stays small."""
    score = lookup(CALIBRATION_SCORE, F.col("feedback_outcome"))
    x = feedback.where(F.col("operation") == "resolve_context").withColumn("k", correlation_key()).where("k is not null")
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    return x.groupBy("k").agg(
        F.count(F.lit(1)).alias("n_feedback"),
        F.avg(score).alias("observed"),
        F.array_sort(F.collect_set("feedback_outcome")).alias("outcomes"),
        F.array_sort(F.collect_set("confidence_level")).alias("levels"),
        flat("retrieval_issue_codes").alias("issues"),
        flat("ground_truth_unit_ids").alias("truth_units"),
        flat("ground_truth_paths").alias("truth_paths"),
    )


def correlated(events: DataFrame, feedback: DataFrame) -> DataFrame:
    """Successful retrieval events with the summary of their feedback (nulls where there is none)."""
    e = events.where("operation = 'resolve_context' and status = 'success'").withColumn("k", correlation_key())
    e = e.withColumn("_j", F.coalesce("k", F.concat(F.lit("\0"), F.col("id").cast("string"))))  # null keys would meet in one task
    return e.join(feedback_by_key(feedback).withColumnRenamed("k", "_j"), "_j", "left").drop("_j")


def predicted() -> Column:
    """The confidence score in the payload, else the level's."""
    return F.coalesce("p.outcome_summary.confidence_score", lookup(LEVEL_SCORE, F.col("confidence_level")), F.lit(0.0))


def calibration(events: DataFrame, feedback: DataFrame) -> DataFrame:
    """Predicted against observed by confidence level; the level 'all' is the total."""
    x = correlated(events, feedback).where("observed is not null").select("confidence_level", predicted().alias("predicted"), "observed")
    x = x.withColumn("level", F.explode(F.array(F.coalesce("confidence_level", F.lit("none")), F.lit("all"))))
    return x.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.avg("predicted").alias("mean_predicted"), F.avg("observed").alias("mean_observed"), F.avg(F.abs(F.col("predicted") - F.col("observed"))).alias("mae"))


def difficult() -> Column:
    """Negative feedback, a difficult issue, low confidence, a degraded result or fallback units."""
    any_of = lambda c, xs: F.coalesce(F.arrays_overlap(F.col(c), F.array(*map(F.lit, xs))), F.lit(False))
    low = F.coalesce(F.col("confidence_level") == "low", F.lit(False)) | F.coalesce(F.col("result_status") == "degraded", F.lit(False))
    return any_of("outcomes", DIFFICULT_OUTCOMES) | any_of("issues", DIFFICULT_ISSUES) | low | F.coalesce(F.col("p.fallback_units") > 0, F.lit(False))


def harvested(events: DataFrame, feedback: DataFrame) -> DataFrame:
    """Replay rows of the events that carry a query: expectations from ground truth, protected where difficult."""
    x = correlated(events, feedback).where("coalesce(p.query, '') <> ''")
    lists = lambda c: F.concat_ws(",", F.coalesce(F.col(c), F.array().cast("array<string>")))
    return x.select("id", F.coalesce("request_id", "event_id").alias("query_id"), difficult().alias("protected_case"), F.col("p.query").alias("query"), lists("truth_units").alias("top_authority_unit_ids"), lists("truth_paths").alias("required_paths"), lists("outcomes").alias("feedback_outcomes"))


def protected(events: DataFrame, feedback: DataFrame) -> DataFrame:
    """The protected replay rows with the strongest confidence level their feedback names, medium where it names none."""
    rank = F.array_max(F.transform("levels", lambda v: F.when(v == "high", 2).when(v == "medium", 1).when(v == "low", 0)))
    level = F.when(rank == 2, "high").when(rank == 1, "medium").when(rank == 0, "low").otherwise("medium")
    x = correlated(events, feedback).where("coalesce(p.query, '') <> ''").where(difficult())
    return x.select("id", F.coalesce("request_id", "event_id").alias("query_id"), level.alias("min_confidence_level"), F.concat_ws(",", F.coalesce("truth_paths", F.array().cast("array<string>"))).alias("required_paths"))


def review(events: DataFrame, feedback: DataFrame) -> DataFrame:
    """Per week: queries, correlated and protected ones, and how many name each outcome."""
    x = correlated(events, feedback).where("coalesce(p.query, '') <> ''")
    has = lambda o: F.count_if(F.coalesce(F.array_contains("outcomes", o), F.lit(False)))
    week = F.date_format(F.date_trunc("week", "occurred_at"), "yyyy-MM-dd").alias("week")
    return x.groupBy(week).agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.size("outcomes") > 0).alias("correlated"), F.count_if(difficult()).alias("protected"), *[has(o).alias(o) for o in CALIBRATION_SCORE])


def evaluated_feedback(feedback: DataFrame) -> DataFrame:
    """Mean score of feedback by outcome and by confidence level: the outcome's score less penalties of its issues, at least -1."""
    pen = F.aggregate(F.transform("retrieval_issue_codes", lambda c: F.coalesce(lookup(ISSUE_PENALTY, c), F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)
    s = F.greatest(F.lit(-1.0), F.coalesce(lookup(EVALUATION_SCORE, F.col("feedback_outcome")), F.lit(0.0)) - pen)
    x = feedback.select(F.explode(F.array(F.concat(F.lit("outcome="), F.coalesce("feedback_outcome", F.lit("none"))), F.concat(F.lit("level="), F.coalesce("confidence_level", F.lit("none"))), F.lit("all"))).alias("group"), s.alias("s"))
    return x.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 9).alias("mean_score"))


def issue_counts(feedback: DataFrame) -> DataFrame:
    return feedback.select(F.explode("retrieval_issue_codes").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


def daily_rollup(events: DataFrame, feedback: DataFrame) -> DataFrame:
    """Additive counters by day, surface and operation, by the time of the event."""
    e = events.select(
        F.to_date("occurred_at").alias("metric_date"), "surface", "operation", F.lit(1).alias("events"), (F.col("status") == "success").cast("int").alias("successes"), (F.col("status") == "error").cast("int").alias("errors"),
        F.coalesce(F.col("cache_hit").cast("int"), F.lit(0)).alias("cache_hits"), ((F.coalesce("result_status", F.lit("")) == "degraded") | (F.col("status") == "error")).cast("int").alias("degraded"),
        F.coalesce(F.col("latency_ms"), F.lit(0)).alias("latency_total"), F.lit(0).alias("feedback"), *[F.lit(0).alias(o) for o in CALIBRATION_SCORE],
    )
    f = feedback.select(
        F.to_date("occurred_at").alias("metric_date"), "surface", "operation", *[F.lit(0).alias(c) for c in ("events", "successes", "errors", "cache_hits", "degraded", "latency_total")], F.lit(1).alias("feedback"),
        *[F.coalesce((F.col("feedback_outcome") == o).cast("int"), F.lit(0)).alias(o) for o in CALIBRATION_SCORE],
    )
    counters = ["events", "successes", "errors", "cache_hits", "degraded", "latency_total", "feedback", *CALIBRATION_SCORE]
    day = F.date_format("metric_date", "yyyy-MM-dd").alias("metric_date")
    return e.unionByName(f).groupBy(day, "surface", "operation").agg(*[F.sum(c).cast("bigint").alias(c) for c in counters])


def query_memory(events: DataFrame) -> DataFrame:
    """Successful mcp queries by stage, policy and recommended continuation."""
    x = events.where("surface = 'mcp' and operation = 'resolve_context' and status = 'success'")
    return x.groupBy(F.coalesce("p.stage_name", F.lit("none")).alias("stage"), F.coalesce("p.policy_id", F.lit("none")).alias("policy_id"), F.coalesce("p.recommended_action", F.lit("expand_context")).alias("next_step")).agg(F.count(F.lit(1)).alias("n"))


def ingress_modes(events: DataFrame) -> DataFrame:
    """How successful mcp queries came in; queries without a mode are not counted."""
    x = events.where("surface = 'mcp' and operation = 'resolve_context' and status = 'success' and p.query_ingress_mode is not null")
    return x.groupBy(F.col("p.query_ingress_mode").alias("mode")).agg(F.count(F.lit(1)).alias("n"))


def _e(spark, d: str) -> DataFrame:
    return normalized_events(table(spark, d, "semantic_usage_events"))


def _f(spark, d: str) -> DataFrame:
    return normalized_feedback(table(spark, d, "semantic_usage_feedback"))


QUERIES = {
    "agg_01_slo": lambda s, d: slo(_e(s, d), ["surface"]),
    "agg_02_latency": lambda s, d: latency_summary(_e(s, d), ["surface", "operation"]),
    "agg_02_stage_latency": lambda s, d: latency_summary(_e(s, d).where(F.col("operation").isin(*STAGES)).withColumn("stage", stage_name()), ["stage"]),
    "agg_03_rates_by_tenant": lambda s, d: slo(_e(s, d), ["tenant_id"]),
    "agg_05_stage_tokens": lambda s, d: stage_tokens(_e(s, d)),
    "agg_06_stage_budgets": lambda s, d: stage_budgets(_e(s, d)),
    "agg_07_policy_versions": lambda s, d: policy_versions(_e(s, d), "none"),
    "agg_08_calibration": lambda s, d: _rounded(calibration(_e(s, d), _f(s, d))),
    "agg_09_daily_rollup": lambda s, d: daily_rollup(_e(s, d), _f(s, d)),
    "agg_10_harvest": lambda s, d: harvested(_e(s, d), _f(s, d)),
    "agg_11_calibration_once": lambda s, d: _rounded(calibration(once(_e(s, d), "event_id"), once(_f(s, d), "feedback_id"))),
    "agg_12_weekly_review": lambda s, d: review(_e(s, d), _f(s, d)),
    "agg_13_query_memory": lambda s, d: query_memory(_e(s, d)),
    "agg_14_protected": lambda s, d: protected(_e(s, d), _f(s, d)),
    "agg_15_feedback_scores": lambda s, d: evaluated_feedback(_f(s, d)),
    "agg_15_issue_counts": lambda s, d: issue_counts(_f(s, d)),
    "join_21_correlation": lambda s, d: correlated(_e(s, d), _f(s, d)).where("k is not null").select("id", "n_feedback", F.round("observed", 9).alias("observed")),
    "flt_07_filtered": lambda s, d: filtered(_e(s, d), surface="mcp", operation="resolve_context", since="2026-04-01 00:00:00").select("id", "tenant_id", "latency_ms"),
    "flt_11_difficult": lambda s, d: correlated(_e(s, d), _f(s, d)).where(difficult()).select("id"),
    "prj_06_normalized_feedback": lambda s, d: _f(s, d).select("id", "surface", "operation", *[F.concat_ws("|", c).alias(c) for c in ("retrieval_issue_codes", "ground_truth_unit_ids", "ground_truth_paths")]),
}


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_CASE = lambda values, key: "case " + key + " " + " ".join(f"when '{k}' then {v}" for k, v in values.items()) + " end"
_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)
_LIST = lambda c: f"list_sort(list_distinct(list_filter(coalesce({c}, []), lambda x: x is not null and trim(x) <> '')))"
_BASE = f"""
with e as (select * replace (coalesce(lower(trim(surface)), 'library') as surface, coalesce(lower(trim(operation)), 'unknown') as operation, coalesce(status, 'success') as status),
    payload->>'$.stage_name' as p_stage, (payload->>'$.reserved_tokens')::bigint as p_reserved, (payload->>'$.estimated_tokens')::bigint as p_estimated, (payload->>'$.returned_tokens')::bigint as p_returned,
    (payload->>'$.within_budget')::boolean as p_within, (payload->>'$.truncation_count')::bigint as p_truncated, (payload->>'$.fallback_units')::bigint as p_fallback, payload->>'$.policy_id' as p_policy,
    payload->>'$.policy_version' as p_version, payload->>'$.query' as p_query, payload->>'$.stage_result_status' as p_result, payload->>'$.recommended_action' as p_next,
    (payload->>'$.outcome_summary.confidence_score')::double as p_confidence,
    case when coalesce(trace_id, '') <> '' and coalesce(request_id, '') <> '' then 'tr' || chr(31) || trace_id || chr(31) || request_id
         when coalesce(session_id, '') <> '' and coalesce(task_id, '') <> '' then 'st' || chr(31) || session_id || chr(31) || task_id end as k,
    coalesce(payload->>'$.stage_name', {_CASE({k: f"'{v}'" for k, v in STAGES.items()}, "lower(trim(operation))")}) as stage from semantic_usage_events),
f as (select * replace (coalesce(lower(trim(surface)), 'library') as surface, coalesce(lower(trim(operation)), 'resolve_context') as operation),
    case when coalesce(trace_id, '') <> '' and coalesce(request_id, '') <> '' then 'tr' || chr(31) || trace_id || chr(31) || request_id
         when coalesce(session_id, '') <> '' and coalesce(task_id, '') <> '' then 'st' || chr(31) || session_id || chr(31) || task_id end as k from semantic_usage_feedback),
fk as (select k, count(*) as n_feedback, avg({_CASE(CALIBRATION_SCORE, "feedback_outcome")}) as observed, list_sort(list_distinct(list(feedback_outcome))) as outcomes, list_distinct(list(confidence_level)) as levels,
    {_LIST("flatten(list(retrieval_issue_codes))")} as issues, {_LIST("flatten(list(ground_truth_unit_ids))")} as truth_units, {_LIST("flatten(list(ground_truth_paths))")} as truth_paths
    from f where operation = 'resolve_context' and k is not null group by k),
c as (select e.*, n_feedback, observed, outcomes, levels, issues, truth_units, truth_paths,
    coalesce(list_has_any(outcomes, [{_IN(DIFFICULT_OUTCOMES)}]), false) or coalesce(list_has_any(issues, [{_IN(DIFFICULT_ISSUES)}]), false) or coalesce(confidence_level = 'low', false)
        or coalesce(result_status = 'degraded', false) or coalesce(p_fallback > 0, false) as difficult
    from e left join fk using (k) where operation = 'resolve_context' and status = 'success'),
""".rstrip().rstrip(",")
_LAT = "count(latency_ms) as n, coalesce(avg(latency_ms), 0.0) as mean_ms, coalesce(list_sort(list(latency_ms) filter (latency_ms is not null))[ceil(0.95 * (count(latency_ms) - 1))::bigint + 1], 0) as p95_ms, coalesce(max(latency_ms), 0) as max_ms"
_SLO = """count(*) as events, count(*) filter (operation in ('create_index', 'update_index')) as index_events, count(*) filter (operation = 'resolve_context') as retrieval_events,
 coalesce((count(*) filter (operation = 'create_index' and cache_hit))::double / nullif(count(*) filter (operation = 'create_index' and cache_hit is not null), 0), 0.0) as cache_hit_ratio,
 coalesce((count(*) filter (operation = 'resolve_context' and (result_status = 'degraded' or status = 'error')))::double / nullif(count(*) filter (operation = 'resolve_context'), 0), 0.0) as degraded_rate,
 coalesce((count(*) filter (operation = 'resolve_context' and p_fallback > 0))::double / nullif(count(*) filter (operation = 'resolve_context'), 0), 0.0) as fallback_rate"""
_TOK = ", ".join(f"count(p_{c}) as {c}_n, coalesce(avg(p_{c}), 0.0) as {c}_mean, coalesce(max(p_{c}), 0) as {c}_max" for c in ("reserved", "estimated", "returned"))
_CAL = """, r as (select coalesce(confidence_level, 'none') as level, coalesce(p_confidence, {score}, 0.0)::double as predicted, observed from {c} where observed is not null),
r2 as (select * from r union all select 'all', predicted, observed from r)
select level, count(*) as n, round(avg(predicted), 9) as mean_predicted, round(avg(observed), 9) as mean_observed, round(avg(abs(predicted - observed)), 9) as mae from r2 group by level"""
_ONCE = _BASE.replace("from semantic_usage_events)", "from (select * from semantic_usage_events qualify row_number() over (partition by coalesce(event_id, chr(1) || id::varchar) order by id) = 1))").replace(
    "from semantic_usage_feedback)", "from (select * from semantic_usage_feedback qualify row_number() over (partition by coalesce(feedback_id, chr(1) || id::varchar) order by id) = 1))"
)
_JOIN = lambda c: f"coalesce(array_to_string({c}, ','), '')"
_PEN = "greatest(-1.0, coalesce(" + _CASE(EVALUATION_SCORE, "feedback_outcome") + ", 0.0) - coalesce(list_sum([" + f"coalesce({_CASE(ISSUE_PENALTY, 'x')}, 0.0) for x in {_LIST('retrieval_issue_codes')}" + "]), 0.0))"
SQL = {
    "agg_01_slo": _BASE + f" select surface, {_SLO} from e group by surface",
    "agg_02_latency": _BASE + f" select surface, operation, {_LAT} from e group by surface, operation",
    "agg_02_stage_latency": _BASE + f" select stage, {_LAT} from e where operation in ({_IN(STAGES)}) group by stage",
    "agg_03_rates_by_tenant": _BASE + f" select tenant_id, {_SLO} from e group by tenant_id",
    "agg_05_stage_tokens": _BASE + f" select stage, count(*) as n, {_TOK} from e where operation in ({_IN(STAGES)}) group by stage",
    "agg_06_stage_budgets": _BASE
    + f" select stage, count(*) as n, (count(*) filter (p_within))::double / count(*) as within_budget_rate, (count(*) filter (p_truncated > 0))::double / count(*) as truncated_rate, (count(*) filter (p_result = 'budget_exhausted'))::double / count(*) as budget_exhausted_rate from e where operation in ({_IN(STAGES)}) group by stage",
    "agg_07_policy_versions": _BASE + " select p_policy || '@' || coalesce(nullif(p_version, ''), 'none') as policy, count(*) as n from e where operation = 'resolve_context' and coalesce(p_policy, '') <> '' group by 1",
    "agg_08_calibration": _BASE + _CAL.format(score=_CASE(LEVEL_SCORE, "confidence_level"), c="c"),
    "agg_09_daily_rollup": _BASE
    + f""", u as (select occurred_at::date as metric_date, surface, operation, 1 as events, (status = 'success')::int as successes, (status = 'error')::int as errors, coalesce(cache_hit::int, 0) as cache_hits,
        (coalesce(result_status, '') = 'degraded' or status = 'error')::int as degraded, coalesce(latency_ms, 0) as latency_total, 0 as feedback, {', '.join(f'0 as {o}' for o in CALIBRATION_SCORE)} from e
      union all select occurred_at::date, surface, operation, 0, 0, 0, 0, 0, 0, 1, {', '.join(f"coalesce((feedback_outcome = '{o}')::int, 0)" for o in CALIBRATION_SCORE)} from f)
    select strftime(metric_date, '%Y-%m-%d') as metric_date, surface, operation, {', '.join(f'sum({c})::bigint as {c}' for c in ('events', 'successes', 'errors', 'cache_hits', 'degraded', 'latency_total', 'feedback', *CALIBRATION_SCORE))} from u group by u.metric_date, surface, operation""",
    "agg_10_harvest": _BASE + f" select id, coalesce(request_id, event_id) as query_id, difficult as protected_case, p_query as query, {_JOIN('truth_units')} as top_authority_unit_ids, {_JOIN('truth_paths')} as required_paths, {_JOIN('outcomes')} as feedback_outcomes from c where coalesce(p_query, '') <> ''",
    "agg_11_calibration_once": _ONCE + _CAL.format(score=_CASE(LEVEL_SCORE, "confidence_level"), c="c"),
    "agg_12_weekly_review": _BASE
    + f" select strftime(date_trunc('week', occurred_at), '%Y-%m-%d') as week, count(*) as queries, count(*) filter (len(outcomes) > 0) as correlated, count(*) filter (difficult) as protected, {', '.join(f'count(*) filter (list_contains(outcomes, {chr(39)}{o}{chr(39)})) as {o}' for o in CALIBRATION_SCORE)} from c where coalesce(p_query, '') <> '' group by 1",
    "agg_13_query_memory": _BASE + " select coalesce(p_stage, 'none') as stage, coalesce(p_policy, 'none') as policy_id, coalesce(p_next, 'expand_context') as next_step, count(*) as n from e where surface = 'mcp' and operation = 'resolve_context' and status = 'success' group by all",
    "agg_14_protected": _BASE
    + f" select id, coalesce(request_id, event_id) as query_id, case when list_contains(levels, 'high') then 'high' when list_contains(levels, 'medium') then 'medium' when list_contains(levels, 'low') then 'low' else 'medium' end as min_confidence_level, {_JOIN('truth_paths')} as required_paths from c where coalesce(p_query, '') <> '' and difficult",
    "agg_15_feedback_scores": _BASE + f", s as (select feedback_outcome, confidence_level, {_PEN} as s from f), g as (select 'outcome=' || coalesce(feedback_outcome, 'none') as \"group\", s from s union all select 'level=' || coalesce(confidence_level, 'none'), s from s union all select 'all', s from s) select \"group\", count(*) as n, round(avg(s), 9) as mean_score from g group by 1",
    "agg_15_issue_counts": _BASE + f", i as (select unnest({_LIST('retrieval_issue_codes')}) as issue from f) select issue, count(*) as n from i group by issue",
    "join_21_correlation": _BASE + " select id, n_feedback, round(observed, 9) as observed from c where k is not null",
    "flt_07_filtered": _BASE + " select id, tenant_id, latency_ms from e where surface = 'mcp' and operation = 'resolve_context' and occurred_at >= timestamp '2026-04-01 00:00:00'",
    "flt_11_difficult": _BASE + " select id from c where difficult",
    "prj_06_normalized_feedback": "select id, coalesce(lower(trim(surface)), 'library') as surface, coalesce(lower(trim(operation)), 'resolve_context') as operation, "
    + ", ".join(f"array_to_string(list_filter([x for x, i in coalesce({c}, []) if list_position({c}, x) = i], lambda x: x is not null and trim(x) <> ''), '|') as {c}" for c in ("retrieval_issue_codes", "ground_truth_unit_ids", "ground_truth_paths"))
    + " from semantic_usage_feedback",
}
