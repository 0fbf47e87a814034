"""Recording of usage events and feedback: where the telemetry tables come from.

A sink takes single records from the front, or whole frames. ``TableSink`` appends them as parquet under a rising batch number, with the
batch's additive daily counters beside them; a batch counts once its mark is written, so a job lost halfway leaves nothing half seen and
is run again under the same number. An event or feedback id is stored once: rows whose id is already there, or repeated in the batch, are
left out of both the rows and the counters; rows without id are all kept. One writer per folder.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rookery.operators.usage import CALIBRATION_SCORE, daily_rollup, normalized_events, normalized_feedback

LABELS = "trace_id string, request_id string, session_id string, task_id string, actor_id string, tenant_id string, root_path_hash string"
EVENT = (
    f"event_id string, occurred_at timestamp_ntz, surface string, operation string, status string, {LABELS}, latency_ms bigint, file_count int, unit_count int, selected_units_count int, "
    "selected_files_count int, cache_hit boolean, confidence_level string, autonomy_posture string, result_status string, raw_fetch_level string, payload string"
)
FEEDBACK = (
    f"feedback_id string, occurred_at timestamp_ntz, surface string, operation string, {LABELS}, feedback_outcome string, feedback_reason string, followup_action string, confidence_level string, "
    "retrieval_issue_codes array<string>, ground_truth_unit_ids array<string>, ground_truth_paths array<string>, payload string"
)
COUNTERS = ("events", "successes", "errors", "cache_hits", "degraded", "latency_total", "feedback", *CALIBRATION_SCORE)


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


def _payload(value: object) -> str:
    """JSON of a mapping; anything else is wrapped, nothing is an empty object."""
    return json.dumps({} if value is None else dict(value) if isinstance(value, Mapping) else {"value": str(value)}, sort_keys=True, default=str)


def _record(given: Mapping, ddl: str, key: str, operation: str) -> dict:
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    base = {key: str(uuid.uuid4()), "occurred_at": now, "surface": "library", "operation": operation}
    out = {n: given.get(n) if given.get(n) is not None else base.get(n) for n in _names(ddl)}
    if isinstance(out["occurred_at"], str):
        at = dt.datetime.fromisoformat(out["occurred_at"])
        out["occurred_at"] = at.astimezone(dt.timezone.utc).replace(tzinfo=None) if at.tzinfo else at
    return out | {"payload": _payload(given.get("payload"))}


def event(given: Mapping) -> dict:
    """An event with its defaults: a new id, the present, surface library, operation unknown, status success."""
    out = _record(given, EVENT, "event_id", "unknown")
    return out | {"status": out["status"] or "success"}


def feedback(given: Mapping) -> dict:
    """Feedback with its defaults; lists lose blanks and repetitions."""
    out = _record(given, FEEDBACK, "feedback_id", "resolve_context")
    lists = ("retrieval_issue_codes", "ground_truth_unit_ids", "ground_truth_paths")
    return out | {c: None if out[c] is None else list(dict.fromkeys(s for s in map(str, out[c]) if s.strip())) for c in lists}


def root_path_hash(root: str | None) -> str | None:
    return hashlib.sha256(root.encode()).hexdigest() if root else None


class UsageSink:
    """Takes everything and keeps nothing."""

    def record_event(self, given: Mapping) -> bool:
        return True

    def record_feedback(self, given: Mapping) -> bool:
        return True

    def flush(self) -> bool:
        return True


class MemorySink(UsageSink):
    """Keeps normalised records in two lists."""

    def __init__(self):
        self.events: list[dict] = []
        self.feedback: list[dict] = []

    def record_event(self, given: Mapping) -> bool:
        self.events.append(event(given))
        return True

    def record_feedback(self, given: Mapping) -> bool:
        self.feedback.append(feedback(given))
        return True


class TableSink(MemorySink):
    """Appends to tables below ``folder``; single records are held until ``size`` of them are there or ``flush``."""

    def __init__(self, spark: SparkSession, folder: str, size: int = 1000):
        super().__init__()
        self.spark, self.folder, self.size = spark, folder.rstrip("/"), size

    def record_event(self, given: Mapping) -> bool:
        return super().record_event(given) and (len(self.events) < self.size or self.flush())

    def record_feedback(self, given: Mapping) -> bool:
        return super().record_feedback(given) and (len(self.feedback) < self.size or self.flush())

    def flush(self) -> bool:
        if self.events or self.feedback:
            frame = lambda rows, ddl: self.spark.createDataFrame([tuple(r[n] for n in _names(ddl)) for r in rows], ddl)
            self.append(frame(self.events, EVENT), frame(self.feedback, FEEDBACK))
            self.events, self.feedback = [], []
        return True

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self) -> int:
        path, fs = self._fs()
        marks = path(f"{self.folder}/marks")
        return len(fs.listStatus(marks)) if fs.exists(marks) else 0

    def _read(self, table: str, ddl: str) -> DataFrame:
        n = self.batches()
        return self.spark.read.schema(ddl).parquet(*[f"{self.folder}/{table}/batch={i}" for i in range(n)]) if n else self.spark.createDataFrame([], ddl)

    def stored_events(self) -> DataFrame:
        return self._read("events", EVENT)

    def stored_feedback(self) -> DataFrame:
        return self._read("feedback", FEEDBACK)

    def rollup(self) -> DataFrame:
        """The daily counters: the batches' counters, added up."""
        ddl = "metric_date string, surface string, operation string, " + ", ".join(f"{c} bigint" for c in COUNTERS)
        return self._read("rollup", ddl).groupBy("metric_date", "surface", "operation").agg(*[F.sum(c).cast("bigint").alias(c) for c in COUNTERS])

    def append(self, events: DataFrame, feedback: DataFrame) -> int:
        """Stores one batch of both tables and its counters; returns its number. Ids that are known already are left out."""
        n = self.batches()
        kept = []
        for name, df, ddl, key, known in (("events", events, EVENT, "event_id", self.stored_events()), ("feedback", feedback, FEEDBACK, "feedback_id", self.stored_feedback())):
            have = set(df.columns)
            new = df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(ddl)])
            with_id = new.where(F.col(key).isNotNull()).dropDuplicates([key])
            fresh = (with_id.join(known.select(key), key, "left_anti") if n else with_id).unionByName(new.where(F.col(key).isNull()))
            at = f"{self.folder}/{name}/batch={n}"
            fresh.write.mode("overwrite").parquet(at)
            kept.append(self.spark.read.schema(ddl).parquet(at))
        daily_rollup(normalized_events(kept[0]), normalized_feedback(kept[1])).write.mode("overwrite").parquet(f"{self.folder}/rollup/batch={n}")
        path, fs = self._fs()
        fs.create(path(f"{self.folder}/marks/{n:09d}"), False).close()
        return n


def safely(record: Callable[[Mapping], bool], given: Mapping) -> bool:
    """Records; telemetry that fails never fails what it is about."""
    try:
        return record(given)
    except Exception:  # noqa: BLE001 - whatever the sink's store raises
        return False


def _recorded(spark, d: str) -> DataFrame:
    from rookery.sources.tables import new_folder, table

    sink = TableSink(spark, new_folder(spark, "usage"))
    sink.append(table(spark, d, "semantic_usage_events"), table(spark, d, "semantic_usage_feedback"))
    return sink.rollup()


def _sql() -> str:
    from rookery.operators.usage import SQL, _BASE, _ONCE

    return SQL["agg_09_daily_rollup"].replace(_BASE, _ONCE)


QUERIES = {"src_16_recorded": _recorded}
SQL = {"src_16_recorded": _sql()}
