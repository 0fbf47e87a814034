"""Small projections, checks and set operations over units, selections and events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.operators import usage
from rookery.operators.context import lines, quarter
from rookery.operators.diff import DIFF_SQL, changes
from rookery.operators.retrieval import RANK_SQL, resolve, seeds
from rookery.plans.views import UNITS_SQL, all_units, linked_units, ranking_queries
from rookery.sources import scan, store
from rookery.sources.tables import new_folder, table
from rookery.streaming import rollup

#: What the event contract allows.
SURFACES = ("library", "mcp", "http", "grpc")
OPERATIONS = ("create_index", "update_index", "repo_map", "resolve_context", "expand_context", "fetch_context_detail", "impact_analysis", "skeletons", "server_start", "cache_eviction")
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
HASH = "^[0-9a-f]{64}$"


def compact(ranked: DataFrame) -> DataFrame:
    """Unit, span, band and the first two reasons."""
    return ranked.select("query_id", "unit_id", F.concat_ws(":", "path", F.col("start_line").cast("string"), F.col("end_line").cast("string")).alias("span"), "rank_band", F.array_join(F.slice("codes", 1, 2), ",").alias("why"))


def coverage(units: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Languages, and how much of the units came from the fallback parser: full, mixed, fallback_only or unknown."""
    n, weak = F.count("parser_mode"), F.count_if(F.col("parser_mode") == "fallback")
    level = F.when(n == 0, "unknown").when(weak == 0, "full").when(weak == n, "fallback_only").otherwise("mixed")
    return units.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"), level.alias("coverage"), F.count(F.lit(1)).alias("n_units"))


def lifecycle(snapshots: DataFrame, now: Column, max_age: int) -> DataFrame:
    """Age in whole seconds and staleness at ``now``."""
    age = F.timestamp_diff("SECOND", F.col("indexed_at"), now)
    return snapshots.select("id", age.alias("age_seconds"), (age > max_age).alias("stale"))


def guardrails(selected: DataFrame) -> DataFrame:
    """Posture by confidence, and what blocks autonomy."""
    level = F.col("confidence_level")
    posture = F.when(level == "high", "draft_patch_safe").when(level == "medium", "plan_safe").otherwise("autonomy_blocked")
    risks = F.array_compact(F.array(F.when(level == "low", "confidence_low"), F.when(F.col("confidence_ceiling") == "low", "capability_low"), F.when(F.contains("warnings", F.lit("capability_ceiling")), "capability_ceiling")))
    return selected.select("query_id", posture.alias("autonomy_posture"), F.array_join(risks, ",").alias("risk_flags"))


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): rows that break each rule; one pass."""
    flat = F.array(*[F.struct(F.lit(k).alias("rule"), (~F.coalesce(c, F.lit(True))).cast("int").alias("bad")) for k, c in rules.items()])
    return rows.select(F.inline(flat)).groupBy("rule").agg(F.sum("bad").cast("bigint").alias("n"))


def event_rules() -> dict[str, Column]:
    return {
        "surface": F.col("surface").isin(*SURFACES),
        "operation": F.col("operation").isin(*OPERATIONS),
        "event_id": F.col("event_id").rlike(UUID),
        "root_path_hash": F.col("root_path_hash").rlike(HASH),
        "latency_ms": F.col("latency_ms") >= 0,
        "payload": F.from_json("payload", "x string, broken string", {"columnNameOfCorruptRecord": "broken"})["broken"].isNull(),
    }


#: What the feedback contract allows.
OUTCOMES = ("helpful", "partially_helpful", "not_helpful", "abandoned")


def feedback_rules() -> dict[str, Column]:
    return {
        "surface": F.col("surface").isin(*SURFACES),
        "feedback_id": F.col("feedback_id").rlike(UUID),
        "outcome": F.col("feedback_outcome").isin(*OUTCOMES),
        "confidence": F.col("confidence_level").isin("low", "medium", "high"),
        "issue_codes": ~F.exists("retrieval_issue_codes", lambda x: x.isNull() | (F.trim(x) == "")),
        "root_path_hash": F.col("root_path_hash").rlike(HASH),
    }


def broken_references(rows: DataFrame, key: str, catalog: DataFrame, target: str) -> DataFrame:
    """Rows whose reference names nothing in the catalogue; a null reference names nothing and is none."""
    return rows.where(F.col(key).isNotNull()).join(catalog.select(F.col(target).alias(key)).distinct(), key, "left_anti")


def first_failure(selected: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """The first check, in order, that a selection fails; null if it passes."""
    return selected.select("query_id", F.coalesce(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()]).alias("failed"))


def merged_units(old: DataFrame, parsed: DataFrame, changed: DataFrame) -> DataFrame:
    """Old units of unchanged paths and the newly parsed ones."""
    return old.join(changed.select("root", "path"), ["root", "path"], "left_anti").unionByName(parsed, allowMissingColumns=True)


def line_table(files: DataFrame) -> DataFrame:
    """root, path, line_no, line."""
    return files.select("root", "path", F.posexplode(lines(F.col("text"))).alias("pos", "line")).select("root", "path", (F.col("pos") + 1).alias("line_no"), "line")


def last_class(files: DataFrame) -> DataFrame:
    """For each method line of a file the class declared last before it: a look back, not a join."""
    x = line_table(files)
    cls = F.regexp_extract("line", r"^\s*(?:public\s+)?(?:class|interface|enum)\s+([A-Za-z_][A-Za-z0-9_]*)", 1)
    w = Window.partitionBy("root", "path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("class", F.last(F.when(cls != "", cls), ignorenulls=True).over(w))
    return x.where(F.col("line").rlike(r"^\s+(public|private|protected)\s.*\(.*\{")).select("root", "path", "line_no", "class")


def end_lines(defs: DataFrame, n_lines: DataFrame) -> DataFrame:
    """A definition ends before the next one begins, the last with the file."""
    w = Window.partitionBy("root", "path").orderBy("start_line")
    x = defs.join(n_lines, ["root", "path"])
    return x.withColumn("end_line", F.greatest(F.col("start_line"), F.coalesce(F.lead("start_line").over(w) - 1, F.col("n_lines"))))


def change_order() -> list[Column]:
    """The order of one snapshot's changes: type, path, former path, symbol and unit."""
    c = lambda a: F.coalesce(a, f"baseline_{a}", F.lit(""))
    return [F.col("change_type"), c("path"), F.coalesce("baseline_path", F.lit("")), c("symbol"), c("unit_id")]


def ordered_changes(changed: DataFrame) -> DataFrame:
    """The place of each change in the order of ``change_order``, per snapshot."""
    w = Window.partitionBy("root", "snapshot_id").orderBy(*change_order())
    return changed.withColumn("place", F.row_number().over(w))


def _ranked(s, d: str) -> DataFrame:
    u = linked_units(s, d)
    return resolve(u, ranking_queries(u))


def _selected(s, d: str) -> DataFrame:
    from rookery.operators.context import _selections

    return _selections(s, d)


def _streamed(s, d: str) -> DataFrame:
    """The daily rollup by streams over both tables, each delivered in several files, ids that come again counting once."""
    out = new_folder(s, "rollup")
    frames = []
    for name in ("semantic_usage_events", "semantic_usage_feedback"):
        t = table(s, d, name)
        t.repartitionByRange(4, "id").write.parquet(f"{out}/{name}")
        frames.append(s.readStream.schema(t.schema).option("maxFilesPerTrigger", 2).parquet(f"{out}/{name}"))
    for q in rollup.rollup_stream(*frames, f"{out}/parts", f"{out}/checkpoint", dedupe=True):
        q.awaitTermination()
    return rollup.rolled_up(s, f"{out}/parts")


def _stored(s, d: str) -> DataFrame:
    """Units of all current snapshots written by partition and read back with pruning."""
    u = linked_units(s, d)
    path = f"{new_folder(s, 'store')}/rows"
    u.withColumn("root_hash", F.sha2("root", 256)).write.partitionBy("root_hash").parquet(path)
    return s.read.parquet(path).select("root", "snapshot_id", "unit_id")


def _java(s, d: str) -> DataFrame:
    return scan.fallback_files(s, d).where("language = 'java'")


def _ends(s, d: str) -> DataFrame:
    f = scan.fallback_files(s, d).where("language = 'python'")
    x = line_table(f)
    defs = x.where(F.col("line").rlike(r"^(async def|def|class) ")).select("root", "path", F.col("line_no").alias("start_line"))
    return end_lines(defs, x.groupBy("root", "path").agg(F.max("line_no").alias("n_lines")))


def _merge(s, d: str) -> DataFrame:
    u = linked_units(s, d).select("root", "path", "unit_id")
    changed = u.groupBy("root").agg(F.min("path").alias("path"))
    return merged_units(u, changed.withColumn("unit_id", F.concat("path", F.lit("::fresh"))), changed)


def _latest(s, d: str) -> DataFrame:
    return store.retained(table(s, d, "semantic_usage_feedback").where("feedback_id is not null").select("feedback_id", "id", "feedback_outcome"), "feedback_id", "id", 50)


QUERIES = {
    "prj_01_compact": lambda s, d: compact(_ranked(s, d)),
    "prj_09_coverage": lambda s, d: coverage(linked_units(s, d), ["root"]),
    "prj_10_lifecycle": lambda s, d: lifecycle(t := table(s, d, "semantic_index_snapshots"), t.agg(F.max("indexed_at")).scalar(), 30 * 86_400),
    "scr_12_guardrails": lambda s, d: guardrails(_selected(s, d)),
    "scr_14_tokens": lambda s, d: linked_units(s, d).select("root", "unit_id", quarter(F.col("signature"), F.col("symbol")).alias("tokens")),
    "val_01_event_contract": lambda s, d: violations(table(s, d, "semantic_usage_events"), event_rules()),
    "val_01_feedback_contract": lambda s, d: violations(table(s, d, "semantic_usage_feedback"), feedback_rules()),
    "val_01_references": lambda s, d: broken_references(table(s, d, "semantic_usage_feedback").select("id", F.explode("ground_truth_unit_ids").alias("unit_id")), "unit_id", table(s, d, "degraded_fallback"), "unit_id").select("id", "unit_id"),
    "val_02_first_failure": lambda s, d: first_failure(_selected(s, d), {"result_status": F.col("result_status") == "completed", "confidence_level": F.col("confidence_level") != "low", "next_step": F.col("next_step") == "expand_context", "warnings": F.col("warnings") == ""}),
    "set_03_incremental_merge": _merge,
    "src_15_store_round_trip": _stored,
    "src_19_retained": _latest,
    "src_03_line_table": lambda s, d: line_table(scan.fallback_files(s, d)).groupBy("root", "path").agg(F.max("line_no").alias("n_lines"), F.sum(F.length("line")).cast("bigint").alias("n_chars")),
    "win_05_last_class": lambda s, d: last_class(_java(s, d)),
    "win_06_end_lines": _ends,
    "srt_03_diff_order": lambda s, d: ordered_changes(changes(all_units(s, d))).select("root", "snapshot_id", "place", "change_type", F.coalesce("unit_id", "baseline_unit_id").alias("unit_id")),
    "join_11_span_overlap": lambda s, d: seeds(u := linked_units(s, d), ranking_queries(u)).where("code = 'diff_overlap_direct'").select("query_id", "unit_id"),
    "join_13_module_containment": lambda s, d: seeds(u := linked_units(s, d), ranking_queries(u)).where("code = 'target_module_match'").select("query_id", "unit_id"),
    "str_01_streamed_rollup": _streamed,
}
_L = r"case when text is null or regexp_replace(text, '(\r?\n)+\z', '') = '' then []::varchar[] else string_split_regex(regexp_replace(text, '(\r?\n)+\z', ''), '\r?\n') end"
_LINE_TABLE = scan._FILES + f", l as (select root, path, language, unnest({_L}) as line, generate_subscripts({_L}, 1)::int as line_no from g)"


def _selection_sql() -> str:
    from rookery.operators.context import SQL as CONTEXT

    text = CONTEXT["scr_10_selection"]
    cut = text.rindex("select query_id, result_status")
    return text[:cut] + ", sel as (" + text[cut:] + ")\n"


SQL = {
    "prj_01_compact": RANK_SQL + "select query_id, unit_id, concat_ws(':', path, start_line, end_line) as span, rank_band, array_to_string(codes[1:2], ',') as why from rk",
    "prj_09_coverage": UNITS_SQL + "select root, array_to_string(list_sort(list_distinct(list(language))), ',') as languages, case when count(parser_mode) = 0 then 'unknown' when count(*) filter (parser_mode = 'fallback') = 0 then 'full' when count(*) filter (parser_mode = 'fallback') = count(parser_mode) then 'fallback_only' else 'mixed' end as coverage, count(*) as n_units from cur group by root",
    "prj_10_lifecycle": "select id, datesub('second', indexed_at, (select max(indexed_at) from semantic_index_snapshots)) as age_seconds, datesub('second', indexed_at, (select max(indexed_at) from semantic_index_snapshots)) > 2592000 as stale from semantic_index_snapshots",
    "scr_12_guardrails": _selection_sql()
    + "select query_id, case confidence_level when 'high' then 'draft_patch_safe' when 'medium' then 'plan_safe' else 'autonomy_blocked' end as autonomy_posture, array_to_string(list_filter([case when confidence_level = 'low' then 'confidence_low' end, case when confidence_ceiling = 'low' then 'capability_low' end, case when contains(warnings, 'capability_ceiling') then 'capability_ceiling' end], lambda x: x is not null), ',') as risk_flags from sel",
    "scr_14_tokens": UNITS_SQL + "select root, unit_id, ceil((length(coalesce(signature, '')) + length(coalesce(symbol, ''))) / 4.0)::bigint as tokens from cur",
    "val_01_event_contract": "with v as (select surface not in ("
    + ", ".join(f"'{x}'" for x in SURFACES)
    + ") as a, operation not in ("
    + ", ".join(f"'{x}'" for x in OPERATIONS)
    + f") as b, not regexp_matches(event_id, '{UUID}') as c, not regexp_matches(root_path_hash, '{HASH}') as d, latency_ms < 0 as e, not json_valid(payload) as f from semantic_usage_events) "
    + " union all ".join(f"select '{n}' as rule, count(*) filter ({c}) as n from v" for n, c in (("surface", "a"), ("operation", "b"), ("event_id", "c"), ("root_path_hash", "d"), ("latency_ms", "e"), ("payload", "f"))),
    "val_01_feedback_contract": "with v as (select surface not in ("
    + ", ".join(f"'{x}'" for x in SURFACES)
    + f") as a, not regexp_matches(feedback_id, '{UUID}') as b, feedback_outcome not in ({', '.join(repr(o) for o in OUTCOMES)}) as c, confidence_level not in ('low', 'medium', 'high') as d, len(list_filter(retrieval_issue_codes, lambda x: coalesce(trim(x), '') = '')) > 0 as e, not regexp_matches(root_path_hash, '{HASH}') as f from semantic_usage_feedback) "
    + " union all ".join(f"select '{n}' as rule, count(*) filter ({c}) as n from v" for n, c in (("surface", "a"), ("feedback_id", "b"), ("outcome", "c"), ("confidence", "d"), ("issue_codes", "e"), ("root_path_hash", "f"))),
    "val_01_references": "with u as (select id, unnest(ground_truth_unit_ids) as unit_id from semantic_usage_feedback) select id, unit_id from u where unit_id is not null and unit_id not in (select unit_id from degraded_fallback where unit_id is not null)",
    "val_02_first_failure": _selection_sql() + "select query_id, case when result_status <> 'completed' then 'result_status' when confidence_level = 'low' then 'confidence_level' when next_step <> 'expand_context' then 'next_step' when warnings <> '' then 'warnings' end as failed from sel",
    "set_03_incremental_merge": UNITS_SQL + ", c as (select root, min(path) as path from cur group by root) select root, path, unit_id from cur where not exists (select 1 from c where c.root = cur.root and c.path = cur.path) union all select root, path, path || '::fresh' from c",
    "src_15_store_round_trip": UNITS_SQL + "select root, snapshot_id, unit_id from cur",
    "src_19_retained": "select feedback_id, max(id) as id, arg_max(feedback_outcome, id) as feedback_outcome from semantic_usage_feedback where feedback_id is not null group by feedback_id order by id desc, feedback_id limit 50",
    "src_03_line_table": _LINE_TABLE + " select root, path, max(line_no) as n_lines, sum(length(line))::bigint as n_chars from l group by root, path",
    "win_05_last_class": _LINE_TABLE
    + r", w as (select *, last_value(nullif(regexp_extract(line, '^\s*(?:public\s+)?(?:class|interface|enum)\s+([A-Za-z_][A-Za-z0-9_]*)', 1), '') ignore nulls) over (partition by root, path order by line_no rows between unbounded preceding and current row) as class from l where language = 'java') select root, path, line_no, class from w where regexp_matches(line, '^\s+(public|private|protected)\s.*\(.*\{')",
    "win_06_end_lines": _LINE_TABLE
    + ", n as (select root, path, max(line_no) as n_lines from l where language = 'python' group by all), e as (select root, path, line_no as start_line from l where language = 'python' and regexp_matches(line, '^(async def|def|class) ')) select root, path, start_line, n_lines, greatest(start_line, coalesce(lead(start_line) over (partition by root, path order by start_line) - 1, n_lines)) as end_line from e join n using (root, path)",
    "srt_03_diff_order": DIFF_SQL
    + "select root, snapshot_id, row_number() over (partition by root, snapshot_id order by change_type, coalesce(path, baseline_path, ''), coalesce(baseline_path, ''), coalesce(symbol, baseline_symbol, ''), coalesce(unit_id, baseline_unit_id, ''))::int as place, change_type, coalesce(unit_id, baseline_unit_id) as unit_id from ch where change_type <> 'unchanged'",
    "join_11_span_overlap": RANK_SQL + "select query_id, unit_id from s0 where code = 'diff_overlap_direct'",
    "join_13_module_containment": RANK_SQL + "select query_id, unit_id from s0 where code = 'target_module_match'",
    "str_01_streamed_rollup": usage.SQL["agg_09_daily_rollup"].replace(usage._BASE, usage._ONCE),
}
