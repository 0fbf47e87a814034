"""Totals over trailing periods, from segment trees per entity and time shard.

A leaf is one entity's day; the node (level l, index k) holds the sums of the days k*2^l .. (k+1)*2^l-1. Shards are the
aligned blocks of 2^shard_bits days, each with its own tree, so no node spans two shards and a correction touches
``shard_bits + 1`` nodes. A trailing window is the disjoint union of its canonical nodes: those that lie inside it while
their parent does not. Instead of looking the nodes up for every date (a join), each node is sent to the dates it is
canonical for; those dates form one interval, see ``_canonical_days``. So a query is one aggregation over
O(nodes * window) small rows, and days without activity need no rows of their own.

Semantics: a row without time or with a null key component in ``entity`` keeps that null as a key (nulls group together);
a row without time has no day and is left out. Values that are null or negative count as events but not as measurements.
``event_id`` null rows are told apart by ``id``. Sums are decimals, so they cannot wrap. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.functions.text import label, utc_day
from rookery.sources.tables import checkpointed, new_folder, table

SHARD_BITS = 6
WINDOWS = (7, 30)
SUMS = ("events", "measured", "total")


def distinct_events(events: DataFrame) -> DataFrame:
    """Each event once: deliveries of one ``event_id`` have the same content, so distinct rows of what is needed suffice.

    The aggregation has keys only, hence a hash aggregate with a map-side pass and no skew, as ids are unique."""
    key = F.coalesce(F.col("event_id"), F.concat(F.lit("\0"), F.col("id").cast("string")))
    value = F.when(F.col("latency_ms") >= 0, F.col("latency_ms"))
    return (
        events.where(F.col("occurred_at").isNotNull())
        .select(key.alias("event"), label("surface").alias("surface"), label("operation").alias("operation"), utc_day("occurred_at").alias("day"), value.alias("value"))
        .distinct()
    )


def daily_leaves(rows: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Sums by entity and day of rows with ``day`` (int) and ``value`` (null: not measured)."""
    return rows.groupBy(*entity, "day").agg(
        F.count(F.lit(1)).alias("events"), F.count("value").alias("measured"), F.coalesce(F.sum(F.col("value").cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("total")
    )


def build_tree(leaves: DataFrame, entity: Sequence[str], shard_bits: int = SHARD_BITS) -> DataFrame:
    """All nodes: entity, shard, level, node and the sums. Nodes without events are absent."""
    x = leaves.select(*entity, "day", F.explode(F.sequence(F.lit(0), F.lit(shard_bits))).alias("level"), *SUMS)
    x = x.withColumn("node", F.expr("shiftright(day, level)")).withColumn("shard", F.expr(f"shiftright(day, {shard_bits})"))
    return _summed(x, [*entity, "shard", "level", "node"])


def corrected(tree: DataFrame, late: DataFrame, entity: Sequence[str], shard_bits: int = SHARD_BITS) -> DataFrame:
    """The tree after late rows (leaves of additions, or negative leaves of retractions).

    Only ancestors of the late days change; as sums are additive, their deltas are appended and combined by key."""
    return _summed(tree.unionByName(build_tree(late, entity, shard_bits)), [*entity, "shard", "level", "node"])


def append_corrections(late: DataFrame, path: str, entity: Sequence[str], shard_bits: int = SHARD_BITS) -> None:
    """Adds late leaves to a tree stored by shard: delta nodes of the touched shards are appended, nothing is rewritten."""
    build_tree(late, entity, shard_bits).write.mode("append").partitionBy("shard").parquet(path)


def stored_tree(df: DataFrame, entity: Sequence[str]) -> DataFrame:
    """A stored tree with its appended deltas combined."""
    return _summed(df, [*entity, "shard", "level", "node"])


def _summed(x: DataFrame, keys: Sequence[str]) -> DataFrame:
    return x.groupBy(*keys).agg(*[F.sum(c).cast(t).alias(c) for c, t in zip(SUMS, ("bigint", "bigint", "decimal(38,0)"))])


def _canonical_days(window: int, shard_bits: int) -> Column:
    """The days d for which a node is canonical in [d-window+1, d]; null if there are none.

    The node lies in the window for end <= d <= start+window-1. Where its parent fits too, the left child is left with
    the days before the parent's end, the right child with those after the parent has slid out."""
    size = "shiftleft(1, level)"
    start = "shiftleft(node, level)"
    left = "node % 2 = 0"
    parent_fits = f"(level < {shard_bits} and 2 * {size} <= {window})"
    low = f"case when {parent_fits} and not ({left}) then {start} - {size} + {window} else {start} + {size} - 1 end"
    high = f"case when {parent_fits} and {left} then {start} + 2 * {size} - 2 else {start} + {window} - 1 end"
    return F.expr(f"case when {size} <= {window} and {low} <= {high} then sequence({low}, {high}) end")


def trailing(tree: DataFrame, entity: Sequence[str], last_day: Column, windows: Sequence[int] = WINDOWS, shard_bits: int = SHARD_BITS) -> DataFrame:
    """For each entity and day from its first one to ``last_day``: events_w, measured_w and total_w of each window w."""
    parts = []
    for w in windows:
        hit = tree.withColumn("day", F.explode(_canonical_days(w, shard_bits)))
        parts.append(hit.select(*entity, "day", F.lit(w).alias("w"), *SUMS))
    first = tree.where("level = 0").groupBy(*entity).agg(F.min("node").alias("first"))
    zeros = [F.lit(0).cast(t).alias(c) for c, t in zip(SUMS, ("bigint", "bigint", "decimal(38,0)"))]
    grid = first.select(*entity, F.explode(F.sequence("first", last_day)).alias("day"), F.lit(0).alias("w"), *zeros)
    x = grid
    for p in parts:
        x = x.unionByName(p)
    sums = [F.coalesce(F.sum(F.when(F.col("w") == w, F.col(c))), F.lit(0)).alias(f"{c}_{w}") for w in windows for c in SUMS]
    out = x.where(F.col("day") <= last_day).groupBy(*entity, "day").agg(F.max((F.col("w") == 0).cast("int")).alias("inside"), *sums)
    return out.where("inside = 1").drop("inside")


def event_tree(spark, d: str) -> DataFrame:
    """The tree of the usage events; it is small (days, not events), so it is computed once and kept."""
    rows = distinct_events(table(spark, d, "semantic_usage_events"))
    return checkpointed(build_tree(daily_leaves(rows, ["surface", "operation"]), ["surface", "operation"]))


def last_event_day(spark, d: str) -> Column:
    """The last day with any event, as a scalar subquery over one column."""
    return table(spark, d, "semantic_usage_events").agg(F.max(utc_day("occurred_at"))).scalar()


def corrected_event_tree(spark, d: str) -> DataFrame:
    """The same tree from two stored runs: most events first, the others, of any day, as late corrections appended to the touched shards."""
    entity = ["surface", "operation"]
    rows = distinct_events(table(spark, d, "semantic_usage_events"))
    late = F.pmod(F.xxhash64("event"), F.lit(4)) == 0
    path = new_folder(spark, "trailing-tree") + "/shards"
    build_tree(daily_leaves(rows.where(~late), entity), entity).write.partitionBy("shard").parquet(path)
    append_corrections(daily_leaves(rows.where(late), entity), path, entity)
    return stored_tree(spark.read.parquet(path), entity)


def activity_totals(spark, d: str, tree: DataFrame | None = None) -> DataFrame:
    """p2_rolling: events, total and average latency of the trailing 7 and 30 days by pair and day."""
    t = trailing(event_tree(spark, d) if tree is None else tree, ["surface", "operation"], last_event_day(spark, d))
    cols = []
    for w in WINDOWS:
        cols += [
            F.col(f"events_{w}").cast("bigint").alias(f"events_{w}d"),
            F.col(f"total_{w}").cast("bigint").alias(f"latency_total_{w}d"),
            (F.col(f"total_{w}").cast("double") / F.when(F.col(f"measured_{w}") > 0, F.col(f"measured_{w}"))).alias(f"latency_avg_{w}d"),
        ]
    return t.select("surface", "operation", _day_string("day").alias("activity_day"), *cols)


def paused_days(spark, d: str) -> DataFrame:
    """p2_found: days on which a pair had no event in 7 days but some in 30."""
    t = trailing(event_tree(spark, d), ["surface", "operation"], last_event_day(spark, d))
    return t.where("events_7 = 0 and events_30 > 0").select("surface", "operation", _day_string("day").alias("activity_day"))


def _day_string(c: str) -> Column:
    return F.date_format(F.date_from_unix_date(c), "yyyy-MM-dd")


P2_DAILY_SQL = """
with ev as (select distinct coalesce(event_id, chr(1) || id::varchar) as event, lower(trim(surface)) as surface, lower(trim(operation)) as operation,
        occurred_at::date as day, case when latency_ms >= 0 then latency_ms end as v from semantic_usage_events where occurred_at is not null),
leaf as (select surface, operation, day, count(*) as n, count(v) as m, coalesce(sum(v), 0) as s from ev group by all),
grid as (select surface, operation, unnest(generate_series(min(day)::timestamp, (select max(occurred_at::date) from semantic_usage_events)::timestamp, interval 1 day))::date as day
         from leaf group by surface, operation),
roll as (select g.surface, g.operation, g.day,
        coalesce(sum(l.n) filter (l.day > g.day - 7), 0) as n7, coalesce(sum(l.m) filter (l.day > g.day - 7), 0) as m7, coalesce(sum(l.s) filter (l.day > g.day - 7), 0) as s7,
        coalesce(sum(l.n), 0) as n30, coalesce(sum(l.m), 0) as m30, coalesce(sum(l.s), 0) as s30
    from grid g left join leaf l on l.surface is not distinct from g.surface and l.operation is not distinct from g.operation and l.day between g.day - 29 and g.day
    group by g.surface, g.operation, g.day)
"""

QUERIES = {"p2_found": paused_days, "p2_rolling": activity_totals, "p2_corrected": lambda s, d: activity_totals(s, d, corrected_event_tree(s, d))}

SQL = {
    "p2_found": P2_DAILY_SQL + "select surface, operation, strftime(day, '%Y-%m-%d') as activity_day from roll where n7 = 0 and n30 > 0",
    "p2_rolling": P2_DAILY_SQL
    + """select surface, operation, strftime(day, '%Y-%m-%d') as activity_day, n7::bigint as events_7d, s7::bigint as latency_total_7d, s7::double / nullif(m7, 0)::double as latency_avg_7d,
    n30::bigint as events_30d, s30::bigint as latency_total_30d, s30::double / nullif(m30, 0)::double as latency_avg_30d from roll""",
}
SQL["p2_corrected"] = SQL["p2_rolling"]
