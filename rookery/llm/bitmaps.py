"""Exact distinct counts over identifier sets by bucketed, compressed bitmaps.

A dictionary numbers every distinct identifier once, with dense 64-bit integers. It orders identifiers by where they were first seen (day,
tenant, surface), so those that occur together lie together and the bitmaps of groups become dense. The order comes from a
range partitioning, which follows the data's size and splits hot tenants and days, so no task numbers all identifiers. The
upper 48 bits of a number are its container of 65,536 numbers (``bucket``), the lower 16 the place in it. A set's bitmap is kept
as the non-zero 64-bit words of its containers: rows (kind, bucket, word, bits). Sparse containers so take a row per occupied
word, dense ones one row per 64 identifiers; OR is ``bit_or`` in a grouped aggregation with a map-side pass, AND a join of words. All
steps are keyed by the bucket; only counts leave it. The error is zero.

Words of single days (``day_words``) are the partial results: they can be stored, and ORed over days, surfaces and tenants, as long as
they were encoded by one dictionary. ``encode_run`` takes the dictionary of earlier runs and numbers new identifiers behind its
last container, so stored words stay valid.

Skew: rows are first reduced to distinct (identifier, day, surface, tenant), with a map-side pass, so an identifier with a
third of all rows costs a few rows per task. Null identifiers, and empty ones, are none. Null tenants belong to no tenant
but count in the combinations without tenant; null surfaces and days likewise. Identifiers are compared as written,
surfaces without letter case and outer blanks. Repeated rows change nothing. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.functions.text import label
from rookery.sources.tables import table, written

KINDS = {"actor": "actor_id", "session": "session_id"}
DIMS = ("day", "surface", "tenant_id")
DICTIONARY = "kind string, ident string, id bigint"


def memberships(events: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """Distinct (kind, ident, day, surface, tenant_id) of valid identifiers."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("ident")) for k, c in (kinds or KINDS).items()])
    rows = events.select(F.to_date("occurred_at").alias("day"), label("surface").alias("surface"), "tenant_id", F.inline(F.filter(each, lambda e: e["ident"].isNotNull() & (e["ident"] != ""))))
    return rows.distinct()


def dictionary(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(kind, ident, id) of the identifiers of ``rows``; with ``known``, its rows and behind them the identifiers it lacks.

    The result is stored, as the numbers depend on how the ranges were cut."""
    first = rows.groupBy("kind", "ident").agg(F.min(F.struct("day", "tenant_id", "surface")).alias("first"))
    fresh = first if known is None else first.join(known, ["kind", "ident"], "left_anti")
    order = ["kind", F.col("first.day"), F.col("first.tenant_id"), F.col("first.surface"), "ident"]
    numbered = fresh.repartitionByRange(*order).sortWithinPartitions(*order).select("kind", "ident", F.monotonically_increasing_id().alias("id"))
    if known is None:
        return written(numbered, "dictionary")
    behind = known.agg(((F.shiftright(F.coalesce(F.max("id"), F.lit(-1)), 16) + 1) * 65536).alias("behind")).first()[0]
    return written(known.select("kind", "ident", "id").unionByName(numbered.withColumn("id", F.col("id") + behind)), "dictionary")


def words(numbered: DataFrame, dims: Sequence[str] = DIMS) -> DataFrame:
    """The bitmaps of the finest groups, by word: kind, bucket, dims, word, bits."""
    return numbered.groupBy("kind", F.shiftright("id", 16).alias("bucket"), *dims, F.expr("cast(shiftright(id, 6) & 1023 as int)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(id & 63 as int))")).alias("bits"))


def encode_run(events: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The partial results by day, surface and tenant of some events, and the dictionary they and those of earlier runs share."""
    rows = written(memberships(events), "memberships")
    numbers = dictionary(rows, known)
    return words(rows.join(numbers, ["kind", "ident"])), numbers


def day_words(events: DataFrame) -> DataFrame:
    """Partial results by day, surface and tenant, under a dictionary of their own."""
    return encode_run(events)[0]


def merged(partial: DataFrame, dims: Sequence[str]) -> DataFrame:
    """OR over all dimensions but ``dims``."""
    return partial.groupBy("kind", "bucket", *dims, "word").agg(F.bit_or("bits").alias("bits"))


def intersected(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """AND of two word tables, group by group of ``keys``; nothing but common non-zero words remains."""
    on = ["kind", "bucket", *keys, "word"]
    x = a.select(*on, F.col("bits").alias("_a")).join(b.select(*on, F.col("bits").alias("_b")), on)
    return x.select(*on, F.col("_a").bitwiseAND(F.col("_b")).alias("bits")).where("bits <> 0")


def counted(partial: DataFrame, dims: Sequence[str]) -> DataFrame:
    """(kind, dims, n): bits are counted in each bucket's words, then the counts are added."""
    return partial.groupBy("kind", *dims).agg(F.sum(F.bit_count("bits")).cast("bigint").alias("n"))


def cube_counts(partial: DataFrame) -> DataFrame:
    """n_actors and n_sessions for every combination of day, surface and tenant; ``grouping`` names the ones in use.

    Each coarser bitmap is ORed from a finer one, not from the rows: the sets over (day, surface), (day, tenant) and
    (surface, tenant) from the finest, single dimensions and the total from those."""
    got = {DIMS: partial}
    for dims, source in ((("day", "surface"), DIMS), (("day", "tenant_id"), DIMS), (("surface", "tenant_id"), DIMS), (("day",), ("day", "surface")), (("surface",), ("day", "surface")), (("tenant_id",), ("surface", "tenant_id")), ((), ("surface",))):
        got[dims] = merged(got[source], dims)
    parts = []
    for dims, w in got.items():
        for c in dims:
            w = w.where(F.col(c).isNotNull())
        name = "+".join(c.removesuffix("_id") for c in dims) or "all"
        flat = w.select("kind", F.lit(name).alias("grouping"), *[F.col(c) if c in dims else F.lit(None).cast("date" if c == "day" else "string").alias(c) for c in DIMS], "bits")
        parts.append(flat)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    n = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.bit_count("bits"))), F.lit(0)).cast("bigint")
    return out.groupBy("grouping", F.date_format("day", "yyyy-MM-dd").alias("day"), "surface", "tenant_id").agg(n("actor").alias("n_actors"), n("session").alias("n_sessions"))


def distinct_cube(spark, d: str) -> DataFrame:
    """p4_distinct. The partial results are stored once; all combinations are made of them."""
    return cube_counts(written(day_words(table(spark, d, "semantic_usage_events")), "day-words"))


def shared_between_surfaces(spark, d: str) -> DataFrame:
    """p4_shared: identifiers seen on both of two surfaces, by AND of their bitmaps."""
    by = merged(day_words(table(spark, d, "semantic_usage_events")), ["surface"]).where("surface is not null")
    each = by.groupBy("kind", "bucket", "word").agg(F.array_sort(F.collect_list(F.struct("surface", "bits"))).alias("s"))  # a word has as many entries as there are surfaces
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b["surface"] > a["surface"]), lambda b: F.struct(a["surface"].alias("surface_a"), b["surface"].alias("surface_b"), a["bits"].bitwiseAND(b["bits"]).alias("bits")))))
    return counted(each.select("kind", F.inline(pairs)).where("bits <> 0"), ["surface_a", "surface_b"]).withColumnRenamed("n", "n_shared")


_GROUPS = [("day+surface+tenant", 1, 1, 1), ("day+surface", 1, 1, 0), ("day+tenant", 1, 0, 1), ("surface+tenant", 0, 1, 1), ("day", 1, 0, 0), ("surface", 0, 1, 0), ("tenant", 0, 0, 1), ("all", 0, 0, 0)]
_EVENTS = "with e as (select strftime(occurred_at, '%Y-%m-%d') as day, lower(trim(surface)) as surface, tenant_id, nullif(actor_id, '') as a, nullif(session_id, '') as s from semantic_usage_events)\n"
QUERIES = {"p4_distinct": distinct_cube, "p4_shared": shared_between_surfaces}
SQL = {
    "p4_distinct": _EVENTS
    + " union all ".join(
        f"select '{name}' as grouping, {'day' if d else 'null'} as day, {'surface' if s else 'null'} as surface, {'tenant_id' if t else 'null'} as tenant_id, count(distinct a) as n_actors, count(distinct s) as n_sessions "
        f"from e where true{' and day is not null' if d else ''}{' and surface is not null' if s else ''}{' and tenant_id is not null' if t else ''} group by all having count(a) + count(s) > 0"
        for name, d, s, t in _GROUPS
    ),
    "p4_shared": _EVENTS
    + """, m as (select distinct 'actor' as kind, surface, a as i from e where a is not null union select distinct 'session', surface, s from e where s is not null)
    select x.kind, x.surface as surface_a, y.surface as surface_b, count(*) as n_shared from m x join m y on x.kind = y.kind and x.i = y.i and x.surface < y.surface group by all""",
}
