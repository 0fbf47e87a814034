"""What changed between full snapshots, from a bucketed key-to-hash index.

A snapshot's index holds one row per key: the key and a 64-bit hash of the compared columns, never the values. ``SnapshotStore`` keeps
the index of the last snapshot as a table bucketed by key. A new snapshot is probed against it bucket by bucket: a key without
partner was added or removed, another hash means changed. The same pass writes the next index, with the changes in it, and
then the indexes are swapped. Only for changed keys are values fetched.

``delivered_changes`` replays whole histories: payloads are read and hashed once, and the deliveries go through one store in generations,
the first snapshots of all directories together, then all second ones, and so on. A generation moves its own hashes once, into
the buckets; the index never moves. Buckets take (directory, key), so a directory with a third of all rows is spread by its keys. Their
number follows the size of the hashes.

Hashes are compared only between two versions of one key, so a change is missed with probability 2^-64.

Semantics for deliveries: a payload that is null, blank, cut off or no JSON object is no delivery. Of several deliveries of
one (directory, snapshot_id) the highest id holds. A delivery without ``units`` has none. Units without id are left out;
of a repeated unit_id the last in the array holds. Spellings of one directory are unified. Null scalars equal absent ones
but not empty strings. ``calls`` and ``imports`` are sets; null, absent and empty are equal. Snapshots follow each other by
(indexed_at, id), null first. A delivery without id is left out. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rookery.functions.text import root_path
from rookery.sources.tables import new_folder, spread, table, written

SCALARS = ("kind", "symbol", "path", "module", "language", "signature", "parser_mode", "semantic_fingerprint")
SETS = ("calls", "imports")
UNIT = "unit_id string, " + ", ".join(f"{c} string" for c in SCALARS) + ", " + ", ".join(f"{c} array<string>" for c in SETS)
NULL = "\0null"


def value_hash(scalars: Sequence[Column], sets: Sequence[Column]) -> Column:
    """64-bit hash of a row's compared values. Spark's hash skips nulls and array ends, so both get marks."""
    parts: list[Column] = [F.coalesce(c, F.lit(NULL)) for c in scalars]
    for c in sets:
        parts += [F.array_sort(F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull()))), F.lit("\0end")]
    return F.xxhash64(*parts)


def parsed_units(snapshots: DataFrame, unit: str = UNIT) -> DataFrame:
    """Deliveries with a complete JSON object: id, root, snapshot_id, indexed_at and ``units``, an array of ``unit`` structs.

    ``units`` comes as an object by unit_id or as an array, so it is first taken as text and then read by its kind."""
    outer = F.from_json("payload", "units string, broken string", {"columnNameOfCorruptRecord": "broken"})
    x = spread(snapshots.where("id is not null").select("id", "root_path", "snapshot_id", "indexed_at", "payload")).select("id", root_path("root_path").alias("root"), "snapshot_id", "indexed_at", "payload").where(F.col("payload").rlike(r"^\s*\{") & F.col("payload").rlike(r"\}\s*$"))
    x = x.withColumn("o", outer).where("o is not null and o.broken is null").withColumn("u", F.ltrim("o.units"))
    by_id = F.transform(F.map_entries(F.from_json("u", f"map<string, struct<{_colons(unit)}>>")), lambda e: e["value"].withField("unit_id", F.coalesce(e["value"]["unit_id"], e["key"])))
    in_array = F.from_json("u", f"array<struct<{_colons(unit)}>>")
    units = F.when(F.col("u").startswith("{"), by_id).when(F.col("u").startswith("["), in_array)
    return x.select("id", "root", "snapshot_id", "indexed_at", F.coalesce(units, F.array().cast(f"array<struct<{_colons(unit)}>>")).alias("units"))


def _colons(ddl: str) -> str:
    return ", ".join(":".join(part.strip().split(" ", 1)) for part in ddl.split(","))


def hash_index(parsed: DataFrame) -> DataFrame:
    """One row per delivery with its key-to-hash index as ``entries`` (unit_id, h)."""
    h = lambda u: value_hash([u[c] for c in SCALARS], [u[c] for c in SETS])
    entries = F.transform(F.filter("units", lambda u: u["unit_id"].isNotNull()), lambda u: F.struct(u["unit_id"].alias("unit_id"), h(u).alias("h")))
    return parsed.select("id", "root", "snapshot_id", "indexed_at", entries.alias("entries"))


def snapshot_order(index: DataFrame) -> DataFrame:
    """The deliveries that hold: id, root, snapshot_id, its number ``seq`` in the directory and the next one's id and snapshot."""
    meta = index.select("id", "root", "snapshot_id", "indexed_at")
    last = Window.partitionBy("root", "snapshot_id").orderBy(F.col("id").desc_nulls_last())
    line = Window.partitionBy("root").orderBy(F.col("indexed_at").asc_nulls_first(), "id")
    held = meta.withColumn("rn", F.row_number().over(last)).where("rn = 1")
    return held.select("id", "root", "snapshot_id", F.row_number().over(line).alias("seq"), F.lead("snapshot_id").over(line).alias("next_snapshot"), F.lead("id").over(line).alias("next_id"))


def delivered_changes(snapshots: DataFrame) -> DataFrame:
    """root, snapshot_id (the later one), unit_id, change_type and the delivery ids of both versions (null where there is none)."""
    spark = snapshots.sparkSession
    index = written(hash_index(parsed_units(snapshots)), "unit-index")
    order = snapshot_order(index).withColumnRenamed("id", "ref").withColumnRenamed("root", "scope")
    held = index.select(F.col("id").alias("ref"), "entries").join(order, "ref").select("seq", "scope", "ref", "snapshot_id", "next_snapshot", "entries")
    entries = written(held, "unit-generations", by=["seq"])
    generations = entries.agg(F.max("seq")).first()[0] or 0
    store = SnapshotStore(spark, new_folder(spark, "unit-store"), buckets=bucket_count(entries))
    for seq in range(1, generations + 1):
        one = entries.where(F.col("seq") == seq).select("scope", "ref", "snapshot_id", "next_snapshot", F.posexplode("entries").alias("pos", "e"))
        last = F.max_by(F.struct(F.col("e.h").alias("h"), "ref", "snapshot_id", "next_snapshot"), "pos")
        rows = one.select("scope", F.col("e.unit_id").alias("k"), "*").repartition(store.buckets, "scope", "k").groupBy("scope", "k").agg(last.alias("v")).select("scope", "k", "v.*")
        store.probe(rows, F.col("next_snapshot").isNotNull(), first=seq == 1)
    got = store.all_changes()
    return got.select(F.col("scope").alias("root"), "snapshot_id", F.col("k").alias("unit_id"), "change_type", F.col("old_ref").alias("old_id"), F.when(F.col("change_type") != "removed", F.col("ref")).alias("new_id"))


def bucket_count(entries: DataFrame, size: int = 16 << 20) -> int:
    """Buckets of about ``size`` bytes of stored hashes over all generations."""
    stored = int(str(entries._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(20_000, max(1, -(-stored // size)))


def changed_fields(snapshots: DataFrame) -> DataFrame:
    """root, snapshot_id, unit_id, field, old and new value (sets as sorted JSON) of every changed unit.

    Values are fetched for changed keys only: deliveries without any are never parsed again, other units are dropped at once."""
    changes = delivered_changes(snapshots).where("change_type = 'changed'")
    ends = F.array(F.struct(F.col("old_id").alias("id"), F.lit(False).alias("new")), F.struct(F.col("new_id").alias("id"), F.lit(True).alias("new")))
    wanted = written(changes.select("root", "snapshot_id", "unit_id", F.inline(ends)), "unit-changes")
    touched = snapshots.join(wanted.select("id").distinct(), "id", "left_semi")
    canon = lambda u, c: F.to_json(F.array_sort(F.array_distinct(F.filter(F.coalesce(u[c], F.array().cast("array<string>")), lambda x: x.isNotNull()))))
    u = F.col("u")
    values = parsed_units(touched).select("id", F.posexplode("units").alias("pos", "u")).select("id", "pos", F.col("u.unit_id").alias("unit_id"), *[u[c].alias(c) for c in SCALARS], *[canon(u, c).alias(c) for c in SETS])
    fields = [*SCALARS, *SETS]
    v = values.join(wanted, ["id", "unit_id"])
    both = v.groupBy("root", "snapshot_id", "unit_id").agg(
        *[F.max_by(F.struct(*fields), F.when(F.col("new") == side, F.col("pos"))).alias(name) for side, name in ((False, "old"), (True, "new"))]
    )
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"old.{c}").alias("old_value"), F.col(f"new.{c}").alias("new_value")) for c in fields])
    return both.select("root", "snapshot_id", "unit_id", F.inline(F.filter(each, lambda e: ~e["old_value"].eqNullSafe(e["new_value"]))))


class SnapshotStore:
    """The index of the last snapshot of a keyed table, as versions of a bucketed and sorted table below ``folder``.

    A version has a row per key: scope (a part of the table that has snapshots of its own; '' where there is one only), k, h, ref (what the
    values can be fetched by), snapshot_id, next_snapshot, and change_type and old_ref where the key differs from the version before. Rows
    with a hash are the index; removed keys have none and are gone with the next version. So index and changes are one write: a version
    is complete before the pointer file names it, a job lost before that leaves the old version in force and is run again, and one lost
    after it finds the changes in the version. All versions of a store have the same number of ``buckets``.
    """

    COLUMNS = "scope string, k string, h bigint, ref bigint, snapshot_id string, next_snapshot string, change_type string, old_ref bigint"

    def __init__(self, spark: SparkSession, folder: str, key: str = "k", scalars: Sequence[str] = (), sets: Sequence[str] = (), buckets: int = 64):
        self.spark, self.folder, self.key, self.scalars, self.sets, self.buckets = spark, folder.rstrip("/"), key, list(scalars), list(sets), buckets

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return jvm, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the version in force; 0 before the first snapshot."""
        jvm, fs = self._fs()
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return max([int(n[5:]) for n in names if n.startswith("live-")], default=0)

    def _name(self, version: int) -> str:
        return f"rookery_index_{hashlib.sha1(self.folder.encode()).hexdigest()[:16]}_{version}"

    def _stored(self, version: int) -> DataFrame:
        """A version's table; a new session registers the stored files again."""
        self.spark.sql(f"create table if not exists {self._name(version)} ({self.COLUMNS}) using parquet clustered by (scope, k) sorted by (scope, k) into {self.buckets} buckets location '{self.folder}/v{version}'")
        return self.spark.table(self._name(version))

    def index(self, version: int | None = None) -> DataFrame:
        """The keys and hashes of a version, by default the one in force; empty before the first snapshot."""
        v = self.version() if version is None else version
        return self._stored(v).where("h is not null") if v else self.spark.createDataFrame([], self.COLUMNS)

    def changes(self, version: int | None = None) -> DataFrame:
        """The keys that a version changed, by default the one in force."""
        v = self.version() if version is None else version
        return (self._stored(v) if v else self.index(0)).where("change_type is not null")

    def all_changes(self) -> DataFrame:
        """The changes of all versions that are kept."""
        paths = [f"{self.folder}/v{v}" for v in range(1, self.version() + 1)]
        rows = self.spark.read.schema(self.COLUMNS).parquet(*paths) if paths else self.index(0)
        return rows.where("change_type is not null")

    def hashed(self, snapshot: DataFrame) -> DataFrame:
        """The rows to probe with; null keys are left out, of repeated keys the highest hash holds as rows of a table have no order."""
        # the scope is no literal, which the planner would drop from the join's keys
        h = value_hash([F.col(c).cast("string") for c in self.scalars], [F.col(c) for c in self.sets])
        x = snapshot.select(F.substring(F.col(self.key).cast("string"), 1, 0).alias("scope"), F.col(self.key).cast("string").alias("k"), h.alias("h")).where("k is not null").repartition(self.buckets, "scope", "k")
        none = F.lit(None).cast("string")
        return x.groupBy("scope", "k").agg(F.max("h").alias("h")).select("*", F.lit(None).cast("bigint").alias("ref"), none.alias("snapshot_id"), none.alias("next_snapshot"))

    def apply(self, snapshot: DataFrame) -> DataFrame:
        """(k, change_type) of a full snapshot against the index in force; the first one has no changes. Its index is then in force; the one
        before is kept until the next snapshot, so that old values can be looked up."""
        v = self.probe(self.hashed(snapshot), F.lit(True), first=not self.version())
        jvm, fs = self._fs()
        for old in range(1, v - 1):
            self.spark.sql(f"drop table if exists {self._name(old)}")
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/v{old}"), True)
        return self.changes(v).select("k", "change_type")

    def probe(self, rows: DataFrame, delivered: Column, first: bool = False) -> int:
        """Writes and swaps in the version after the one in force. ``rows`` are partitioned by (scope, k) into the store's buckets; ``delivered``
        says of a row of the old index whether its scope has a new snapshot, the other scopes' rows stay as they are."""
        v = self.version()
        # an empty side of the same buckets keeps the plan of the first version like that of the others
        old = self.index(v).select("scope", "k", F.col("h").alias("h0"), F.col("ref").alias("ref0"), F.col("snapshot_id").alias("s0"), F.col("next_snapshot").alias("n0"), delivered.alias("again"))
        both = old.join(rows.hint("merge"), ["scope", "k"], "full_outer")
        came, had = F.col("h").isNotNull(), F.col("h0").isNotNull()
        gone, stays = ~came & F.col("again"), ~came & ~F.col("again")
        kind = F.when(gone, "removed").when(came & had & (F.col("h") != F.col("h0")), "changed").when(came & ~had & F.lit(not first), "added")
        keep = lambda new, before: F.when(stays, F.col(before)).otherwise(F.col(new)).alias(new)
        out = both.select(
            "scope", "k", keep("h", "h0"), keep("ref", "ref0"), F.when(gone, F.col("n0")).otherwise(F.when(stays, F.col("s0")).otherwise(F.col("snapshot_id"))).alias("snapshot_id"),
            keep("next_snapshot", "n0"), kind.alias("change_type"), F.when(kind.isin("removed", "changed"), F.col("ref0")).alias("old_ref"),
        )
        name = self._name(v + 1)
        self.spark.sql(f"drop table if exists {name}")
        out.write.mode("overwrite").bucketBy(self.buckets, "scope", "k").sortBy("scope", "k").option("path", f"{self.folder}/v{v + 1}").saveAsTable(name)
        self._swap(v + 1)
        return v + 1

    def _swap(self, version: int) -> None:
        jvm, fs = self._fs()
        fs.create(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/live-{version}"), True).close()

    def values(self, snapshot: DataFrame, changes: DataFrame) -> DataFrame:
        """The rows of ``snapshot`` (old or new) whose keys changed; nothing else is kept of it."""
        return snapshot.join(changes.select(F.col("k").alias("__k")), F.col(self.key).cast("string") == F.col("__k"), "left_semi")


def unit_changes(spark, d: str) -> DataFrame:
    """p3_found."""
    return delivered_changes(table(spark, d, "semantic_index_snapshots")).select("snapshot_id", "unit_id", "change_type")


def unit_change_counts(spark, d: str) -> DataFrame:
    """p3_counts: changes by directory and snapshot."""
    c = delivered_changes(table(spark, d, "semantic_index_snapshots"))
    return c.groupBy("root", "snapshot_id").agg(*[F.count_if(F.col("change_type") == k).alias(k) for k in ("added", "removed", "changed")])


def unit_field_changes(spark, d: str) -> DataFrame:
    """p3_fields: old and new value of each changed field, sets as sorted JSON."""
    return changed_fields(table(spark, d, "semantic_index_snapshots"))


_SET = lambda c: f"to_json(list_sort(list_distinct(coalesce(try_cast(json_extract(u, '$.{c}') as varchar[]), []))))"
P3_SQL = r"""
with ok as (select id, regexp_replace(regexp_replace(root_path, '/(\./|/)+', '/', 'g'), '/+$', '') as root, snapshot_id, indexed_at, payload from semantic_index_snapshots
            where payload is not null and trim(payload) <> '' and json_valid(payload) and json_type(payload) = 'OBJECT'),
held as (select * from ok qualify row_number() over (partition by root, snapshot_id order by id desc) = 1),
ord as (select *, row_number() over (partition by root order by indexed_at, id) as seq, lead(snapshot_id) over (partition by root order by indexed_at, id) as next_snapshot from held),
raw as (select root, snapshot_id, seq, next_snapshot,
        unnest(case json_type(payload, '$.units') when 'OBJECT' then json_extract(payload, '$.units.*') when 'ARRAY' then json_extract(payload, '$.units[*]') else [] end) as u from ord),
unit as (select distinct root, snapshot_id, seq, next_snapshot, json_extract_string(u, '$.unit_id') as unit_id, """ + ", ".join(f"json_extract_string(u, '$.{c}') as {c}" for c in SCALARS) + ", " + ", ".join(f"{_SET(c)} as {c}" for c in SETS) + """ from raw),
probe as (select n.root, n.seq, n.snapshot_id, n.unit_id, 'added' as change_type from unit n where n.seq > 1 and not exists (select 1 from unit o where o.root = n.root and o.unit_id = n.unit_id and o.seq = n.seq - 1)
  union all select o.root, o.seq + 1, o.next_snapshot, o.unit_id, 'removed' from unit o where o.next_snapshot is not null and not exists (select 1 from unit n where o.root = n.root and o.unit_id = n.unit_id and o.seq = n.seq - 1)
  union all select n.root, n.seq, n.snapshot_id, n.unit_id, 'changed' from unit n join unit o on o.root = n.root and o.unit_id = n.unit_id and o.seq = n.seq - 1
    where """ + " or ".join(f"o.{c} is distinct from n.{c}" for c in (*SCALARS, *SETS)) + ")\n"

QUERIES = {"p3_found": unit_changes, "p3_counts": unit_change_counts, "p3_fields": unit_field_changes}
SQL = {
    "p3_found": P3_SQL + "select snapshot_id, unit_id, change_type from probe",
    "p3_counts": P3_SQL + "select root, snapshot_id, " + ", ".join(f"count(*) filter (change_type = '{k}') as {k}" for k in ("added", "removed", "changed")) + " from probe group by root, snapshot_id",
    "p3_fields": P3_SQL
    + " union all ".join(
        f"select n.root, n.snapshot_id, n.unit_id, '{c}' as field, o.{c}::varchar as old_value, n.{c}::varchar as new_value from unit n join unit o on o.root = n.root and o.unit_id = n.unit_id and o.seq = n.seq - 1 where o.{c} is distinct from n.{c}"
        for c in (*SCALARS, *SETS)
    ),
}
