"""Snapshots on disk: units, files and edges by directory and snapshot, a small manifest, JSON artifacts.

Tables are parquet, partitioned by (root_hash, snapshot_id); a save overwrites its own partition only, so it can be run again.
The manifest is one small file per saved snapshot, named by a rising number, hence the latest is the highest name and no reader
ever sees half a snapshot: it is written last. ``MemoryStore`` and ``JdbcStore`` have the same interface.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.operators.graph import call_edges, neighbours
from rookery.operators.identity import with_identity


class NotFound(LookupError):
    """A snapshot that was asked for does not exist."""


def root_hash(root: str) -> str:
    return hashlib.sha256(root.encode()).hexdigest()


class UnitStore:
    """Units, edges and the manifest below one folder of a Hadoop file system."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def snapshots(self, root: str) -> list[str]:
        """Snapshot ids of a directory, oldest first."""
        path, fs = self._fs()
        folder = path(f"{self.folder}/manifest/{root_hash(root)}")
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []
        return [n.split("_", 1)[1] for n in names]

    def latest(self, root: str) -> str | None:
        got = self.snapshots(root)
        return got[-1] if got else None

    def save(self, root: str, snapshot_id: str, units: DataFrame, edges: DataFrame | None = None) -> None:
        """Identity is filled in; edges are resolved where none are given."""
        h = root_hash(root)
        u = with_identity(units.withColumn("root", F.lit(root)))
        e = edges if edges is not None else call_edges(u)
        for name, df in (("units", u), ("edges", e.drop("root"))):
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}/root_hash={h}/snapshot_id={snapshot_id}")
        path, fs = self._fs()
        known = self.snapshots(root)
        if snapshot_id not in known:
            fs.create(path(f"{self.folder}/manifest/{h}/{len(known):012d}_{snapshot_id}"), False).close()

    def _at(self, root: str, snapshot_id: str | None) -> str:
        sid = snapshot_id or self.latest(root)
        if sid is None or sid not in self.snapshots(root):
            raise NotFound(f"no snapshot {snapshot_id or ''} of {root}")
        return f"root_hash={root_hash(root)}/snapshot_id={sid}"

    def _frame(self, name: str, root: str, snapshot_id: str | None) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}/{self._at(root, snapshot_id)}")

    def units(self, root: str, snapshot_id: str | None = None, module: str | None = None, symbol: str | None = None, limit: int | None = None) -> DataFrame:
        """Units of a snapshot (default: the latest) by module and symbol, in the order of path and start line if limited."""
        x = self._frame("units", root, snapshot_id)
        for c, v in (("module", module), ("symbol", symbol)):
            x = x if v is None else x.where(F.col(c) == v)
        return x if limit is None else x.orderBy("path", "start_line", "unit_id").limit(limit)

    def edges(self, root: str, snapshot_id: str | None = None) -> DataFrame:
        return self._frame("edges", root, snapshot_id).withColumn("root", F.lit(root))

    def related(self, root: str, unit_id: str, callers: bool = True, snapshot_id: str | None = None, limit: int = 100) -> DataFrame:
        """Callers or callees of one unit."""
        e = self.edges(root, snapshot_id).where(F.col("callee" if callers else "caller") == unit_id)
        return neighbours(e, self.units(root, snapshot_id), callers).where(F.col("place") <= limit)

    def update(self, root: str, snapshot_id: str, parsed: DataFrame, changed: Sequence[str]) -> None:
        """A new snapshot from the latest: units of changed paths are replaced by ``parsed``; no paths replace all."""
        old = self.units(root)
        kept = old.where(~F.col("path").isin(*changed)) if changed else old.limit(0)
        self.save(root, snapshot_id, kept.unionByName(parsed, allowMissingColumns=True))


class MemoryStore(UnitStore):
    """The same interface over cached frames of this session; ``drop`` frees a snapshot."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, ""
        self._kept: dict[str, dict[str, tuple[DataFrame, DataFrame]]] = {}

    def snapshots(self, root: str) -> list[str]:
        return list(self._kept.get(root, {}))

    def save(self, root: str, snapshot_id: str, units: DataFrame, edges: DataFrame | None = None) -> None:
        u = with_identity(units.withColumn("root", F.lit(root))).cache()
        e = (edges if edges is not None else call_edges(u)).drop("root").cache()
        u.count(), e.count()
        self.drop(root, snapshot_id)
        self._kept.setdefault(root, {})[snapshot_id] = u, e

    def drop(self, root: str, snapshot_id: str) -> None:
        for df in self._kept.get(root, {}).pop(snapshot_id, ()):
            df.unpersist()

    def _frame(self, name: str, root: str, snapshot_id: str | None) -> DataFrame:
        self._at(root, snapshot_id)
        return self._kept[root][snapshot_id or self.latest(root)][("units", "edges").index(name)]


class JdbcStore(UnitStore):
    """The same interface over three tables of a database: ``{prefix}snapshots``, ``{prefix}units`` and ``{prefix}edges``.

    Rows carry root_hash and snapshot_id; reads push both down. Lists are JSON text in the database, missing modules and symbols empty. The row of
    ``snapshots`` is written last, so a snapshot is seen when it is whole; saving it again adds rows under a new version and then the row that names it."""

    #: Columns that filters are pushed down for, and their type where Spark creates the tables; not every database compares its longest text type.
    KEYS = {"root_hash": "VARCHAR(64)", "version": "VARCHAR(32)", "snapshot_id": "VARCHAR(200)", **dict.fromkeys(("unit_id", "path", "module", "symbol", "caller", "callee"), "VARCHAR(4000)")}
    LISTS = ("imports", "calls", "call_tokens", "generated_calls", "test_target_modules", "use_modules", "use_expansion_imports")

    def __init__(self, spark: SparkSession, url: str, prefix: str = "code_", user: str | None = None, password: str | None = None, driver: str | None = None):
        self.spark, self.folder, self.prefix = spark, "", prefix
        self._options = lambda table: jdbc_options(url, table, user, password) | ({"driver": driver} if driver else {})

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(**self._options(self.prefix + name)).load()

    def _append(self, name: str, df: DataFrame) -> None:
        types = ", ".join(f"{c} {t}" for c, t in self.KEYS.items() if c in df.columns)
        df.write.format("jdbc").options(**self._options(self.prefix + name)).option("createTableColumnTypes", types).mode("append").save()

    def _versions(self, root: str) -> list[tuple[str, str]]:
        """(snapshot id, version) in the order of their first saving."""
        try:
            rows = self._table("snapshots").where(F.col("root_hash") == root_hash(root)).orderBy("saved_at").collect()  # one row per saving
        except Exception as e:  # noqa: BLE001 - the table comes with the first snapshot
            if "does not exist" in str(e).lower() or "not found" in str(e).lower():
                return []
            raise
        return list({r["snapshot_id"]: r["version"] for r in rows}.items())

    def snapshots(self, root: str) -> list[str]:
        return [s for s, _ in self._versions(root)]

    def save(self, root: str, snapshot_id: str, units: DataFrame, edges: DataFrame | None = None) -> None:
        import time
        import uuid

        u = with_identity(units.withColumn("root", F.lit(root))).cache()
        e = (edges if edges is not None else call_edges(u)).drop("root")
        version = uuid.uuid4().hex
        tag = lambda df: df.withColumns({"root_hash": F.lit(root_hash(root)), "version": F.lit(version)})
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.coalesce(c, F.lit("")).alias(c) if c in self.KEYS else F.col(c) for c, t in u.dtypes if c != "root"]
        self._append("units", tag(u.select(*flat)))
        self._append("edges", tag(e))
        self._append("snapshots", tag(self.spark.createDataFrame([(snapshot_id, time.time_ns())], "snapshot_id string, saved_at bigint")))
        u.unpersist()

    def _frame(self, name: str, root: str, snapshot_id: str | None) -> DataFrame:
        self._at(root, snapshot_id)
        version = dict(self._versions(root))[snapshot_id or self.latest(root)]
        x = self._table(name).where((F.col("root_hash") == root_hash(root)) & (F.col("version") == version)).drop("root_hash", "version")
        lists = {c: F.from_json(c, "array<string>") for c in self.LISTS if c in x.columns}
        if "call_arity_by_token" in x.columns:
            lists["call_arity_by_token"] = F.from_json("call_arity_by_token", "map<string, array<int>>")
        x = x.withColumns(lists | {c: F.nullif(c, F.lit("")) for c in ("module", "symbol") if c in x.columns}) if lists else x
        return x.withColumn("root", F.lit(root)) if name == "units" else x


def write_json(path: str, value: object) -> None:
    """A JSON artifact that is either whole or absent: written aside, read back, then moved."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    aside = f"{path}.part-{os.getpid()}"
    with open(aside, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, sort_keys=True, ensure_ascii=False)
    with open(aside, encoding="utf-8") as f:
        json.load(f)
    os.replace(aside, path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON document or array of documents as rows."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def retained(runs: DataFrame, key: str, order: str, keep: int) -> DataFrame:
    """The latest record of each key, of those the last ``keep`` by ``order``."""
    last = runs.groupBy(key).agg(F.max_by(F.struct(*[c for c in runs.columns if c != key]), order).alias("r")).select(key, "r.*")
    return last.orderBy(F.col(order).desc(), key).limit(keep)


def jdbc_options(url: str, table: str, user: str | None = None, password: str | None = None) -> dict[str, str]:
    """Options for ``spark.read.format('jdbc')`` and ``df.write.format('jdbc')``; filters and limits are pushed down."""
    return {k: v for k, v in {"url": url, "dbtable": table, "user": user, "password": password, "pushDownLimit": "true", "batchsize": "10000"}.items() if v is not None}
