"""Semantic diff of consecutive snapshots: same slot, moved, added, removed.

Both sides of all pairs lie in one frame, told apart by ``side``. One shuffle by (root, pair, semantic_id) serves the
ranking inside a slot and the pairing by rank, a second by the rename class serves the moves; no side is joined. Units of one
slot are paired in the order of (fingerprint, path, start_line, unit_id). What is left over in a slot is removed or added and never a
move; units whose slot is missing on the other side are moves where fingerprint, local name, kind and arity agree, nulls
being equal. Path filters and the dropping of unchanged units come after pairing, counts after both.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rookery.operators.identity import IDENTITY_SQL, local_name, with_identity
from rookery.plans.views import all_units

KINDS = ("added", "removed", "moved_or_renamed", "implementation_changed", "meaning_changed", "unchanged")
_COLS = ("unit_id", "path", "symbol", "semantic_id", "fingerprint", "public_shape", "kind", "method_arity", "start_line")


def both_sides(units: DataFrame) -> DataFrame:
    """root, seq and snapshot_id of the later snapshot, side ('b' or 'c') and the unit."""
    keep = ["root", *_COLS]
    c = units.where("seq > 1").select(*keep, "seq", "snapshot_id", F.lit("c").alias("side"))
    b = units.where("next_snapshot is not null").select(*keep, (F.col("seq") + 1).alias("seq"), F.col("next_snapshot").alias("snapshot_id"), F.lit("b").alias("side"))
    return c.unionByName(b)


def _paired(x: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both sides by rank inside ``keys``: structs b and c, one may be null, and the sides' sizes."""
    w = Window.partitionBy(*keys, "side").orderBy("fingerprint", "semantic_id", "path", "start_line", "unit_id")
    ranked = x.repartition(*keys).withColumn("rn", F.row_number().over(w))
    one = lambda s: F.max(F.when(F.col("side") == s, F.struct(*_COLS))).alias(s)
    out = ranked.groupBy(*keys, "rn").agg(one("b"), one("c"))
    k = Window.partitionBy(*keys)
    return out.withColumns({"has_b": F.max(F.col("b").isNotNull()).over(k), "has_c": F.max(F.col("c").isNotNull()).over(k)})


def changes(units: DataFrame, include_unchanged: bool = False, paths: Sequence[str] | None = None) -> DataFrame:
    """root, snapshot_id, change_type and path, symbol, unit_id of both versions."""
    slots = _paired(both_sides(with_identity(units)), ["root", "seq", "snapshot_id", "semantic_id"]).drop("semantic_id")
    same = F.when(F.col("b.public_shape") != F.col("c.public_shape"), "meaning_changed").when(F.col("b.fingerprint") != F.col("c.fingerprint"), "implementation_changed").otherwise("unchanged")
    alone = F.when(F.col("b").isNull(), "added").otherwise("removed")
    settled = slots.where("has_b and has_c").withColumn("change_type", F.when(F.col("b").isNotNull() & F.col("c").isNotNull(), same).otherwise(alone))
    single = slots.where("not (has_b and has_c)").select("root", "seq", "snapshot_id", F.explode(F.array(F.struct(F.lit("b").alias("side"), F.col("b").alias("u")), F.struct(F.lit("c").alias("side"), F.col("c").alias("u")))).alias("s")).where("s.u is not null")
    single = single.select("root", "seq", "snapshot_id", "s.side", "s.u.*").withColumn("name", F.coalesce(local_name(F.col("symbol")), F.lit("")))
    named = single.withColumn("class", F.when(F.col("name") != "", F.concat_ws("\x1f", "fingerprint", F.coalesce("kind", F.lit("~")), F.coalesce(F.col("method_arity").cast("string"), F.lit("~")), "name")).otherwise(F.concat_ws("\x1f", "side", "unit_id")))
    moves = _paired(named, ["root", "seq", "snapshot_id", "class"]).drop("class")
    moved = moves.withColumn("change_type", F.when(F.col("b").isNotNull() & F.col("c").isNotNull(), "moved_or_renamed").otherwise(alone))
    out = settled.unionByName(moved)
    flat = [F.col(f"c.{c}").alias(c) for c in ("path", "symbol", "unit_id")] + [F.col(f"b.{c}").alias(f"baseline_{c}") for c in ("path", "symbol", "unit_id")]
    out = out.select("root", "snapshot_id", "change_type", *flat)
    if not include_unchanged:
        out = out.where("change_type <> 'unchanged'")
    return out if paths is None else out.where(F.col("path").isin(*paths) | F.col("baseline_path").isin(*paths))


def summary(changed: DataFrame) -> DataFrame:
    """Counts of every change type by snapshot, zero-filled."""
    return changed.groupBy("root", "snapshot_id").agg(*[F.count_if(F.col("change_type") == k).alias(k) for k in KINDS], F.count(F.lit(1)).alias("total_changes"))


DIFF_SQL = (
    IDENTITY_SQL
    + """, sides as (select root, seq, snapshot_id, 'c' as side, unit_id, path, symbol, semantic_id, fingerprint, public_shape, kind, method_arity, start_line from ids where seq > 1
  union all select root, seq + 1, next_snapshot, 'b', unit_id, path, symbol, semantic_id, fingerprint, public_shape, kind, method_arity, start_line from ids where next_snapshot is not null),
rk as (select *, row_number() over (partition by root, seq, semantic_id, side order by fingerprint, path, start_line, unit_id) as rn,
    count(*) filter (side = 'b') over (partition by root, seq, semantic_id) as nb, count(*) filter (side = 'c') over (partition by root, seq, semantic_id) as nc from sides),
slot as (select root, seq, snapshot_id, c.path, c.symbol, c.unit_id, b.path as baseline_path, b.symbol as baseline_symbol, b.unit_id as baseline_unit_id,
    case when b.unit_id is null then 'added' when c.unit_id is null then 'removed' when b.public_shape <> c.public_shape then 'meaning_changed' when b.fingerprint <> c.fingerprint then 'implementation_changed' else 'unchanged' end as change_type
  from (select * from rk where side = 'b' and nc > 0) b full outer join (select * from rk where side = 'c' and nb > 0) c using (root, seq, snapshot_id, semantic_id, rn)),
lone as (select *, coalesce(regexp_replace(symbol, '^.*[/#]', ''), '') as name from rk where nb = 0 or nc = 0),
lk as (select *, case when name <> '' then concat_ws(chr(31), fingerprint, coalesce(kind, '~'), coalesce(method_arity::varchar, '~'), name) else concat_ws(chr(31), side, unit_id) end as class from lone),
lr as (select *, row_number() over (partition by root, seq, class, side order by fingerprint, semantic_id, path, start_line, unit_id) as rm from lk),
mv as (select root, seq, snapshot_id, c.path, c.symbol, c.unit_id, b.path as baseline_path, b.symbol as baseline_symbol, b.unit_id as baseline_unit_id,
    case when b.unit_id is null then 'added' when c.unit_id is null then 'removed' else 'moved_or_renamed' end as change_type
  from (select * from lr where side = 'b') b full outer join (select * from lr where side = 'c') c using (root, seq, snapshot_id, class, rm)),
ch as (select * from slot union all select * from mv)
"""
)
def relocated(units: DataFrame) -> DataFrame:
    """Units whose module is renamed in every second snapshot, by a hash of the unit: the stored histories hold no moves."""
    away = (F.col("seq") % 2 == 0) & (F.ascii(F.substring(F.md5("unit_id"), 1, 1)) % 3 == 0)
    moved = lambda c: F.when(away, F.concat(F.lit("away."), c)).otherwise(F.col(c))
    return units.withColumns({"module": moved("module"), "symbol": moved("symbol")})


_AWAY = "seq % 2 = 0 and ascii(md5(unit_id)[1]) % 3 = 0"
_RELOCATED_SQL = DIFF_SQL.replace("from allu", f"from (select * replace (case when {_AWAY} then 'away.' || module else module end as module, case when {_AWAY} then 'away.' || symbol else symbol end as symbol) from allu)")
_PICK = "root, snapshot_id, change_type, path, symbol, unit_id, baseline_path, baseline_symbol, baseline_unit_id"
QUERIES = {
    "join_19_snapshot_diff": lambda s, d: changes(all_units(s, d)),
    "join_20_moves": lambda s, d: changes(all_units(s, d)).where("change_type = 'moved_or_renamed'"),
    "join_20_moves_relocated": lambda s, d: changes(relocated(all_units(s, d))).where("change_type = 'moved_or_renamed'"),
    "set_02_one_sided": lambda s, d: changes(all_units(s, d)).where("change_type in ('added', 'removed')").select("root", "snapshot_id", "change_type", F.coalesce("unit_id", "baseline_unit_id").alias("unit_id")),
    "agg_22_diff_summary": lambda s, d: summary(changes(all_units(s, d))),
    "flt_09_diff_with_unchanged": lambda s, d: summary(changes(all_units(s, d), include_unchanged=True)),
}
_SUM = "select root, snapshot_id, " + ", ".join(f"count(*) filter (change_type = '{k}') as {k}" for k in KINDS) + ", count(*) as total_changes from ch"
SQL = {
    "join_19_snapshot_diff": DIFF_SQL + f"select {_PICK} from ch where change_type <> 'unchanged'",
    "join_20_moves": DIFF_SQL + f"select {_PICK} from ch where change_type = 'moved_or_renamed'",
    "join_20_moves_relocated": _RELOCATED_SQL + f"select {_PICK} from ch where change_type = 'moved_or_renamed'",
    "set_02_one_sided": DIFF_SQL + "select root, snapshot_id, change_type, coalesce(unit_id, baseline_unit_id) as unit_id from ch where change_type in ('added', 'removed')",
    "agg_22_diff_summary": DIFF_SQL + _SUM + " where change_type <> 'unchanged' group by root, snapshot_id",
    "flt_09_diff_with_unchanged": DIFF_SQL + _SUM + " group by root, snapshot_id",
}
