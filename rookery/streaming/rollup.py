"""Incremental variants of the batch operators on file streams.

Counters are additive, so each micro-batch is aggregated and its partial counters are appended under the batch's number; reading sums
them. A batch that is run again after a failure overwrites its own partition, which makes the sink exactly-once without a lock.
The key is the event's date; the correlation of streams has a watermark, beyond which late feedback is left to the batch operator.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.operators import trailing
from rookery.operators.usage import CALIBRATION_SCORE, correlation_key, daily_rollup, normalized_events, normalized_feedback

COUNTERS = ("events", "successes", "errors", "cache_hits", "degraded", "latency_total", "feedback", *CALIBRATION_SCORE)


def stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def _once(rows: DataFrame, key: str, late: str | None) -> DataFrame:
    """Deliveries again of one key are dropped while the state remembers it: for ``late`` behind the newest event, or for good without it.

    Rows without key are told apart by their ``id``."""
    k = rows.withColumn("_key", F.coalesce(F.col(key), F.concat(F.lit("\0"), F.col("id").cast("string"))))
    if late is None:
        return k.dropDuplicates(["_key"]).drop("_key")
    timed = k.withColumn("_at", F.col("occurred_at").cast("timestamp")).withWatermark("_at", late)
    return timed.dropDuplicatesWithinWatermark(["_key"]).drop("_key", "_at")


def _sink(out: str, counted):
    def write(batch: DataFrame, number: int) -> None:
        counted(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return write


def rollup_stream(events: DataFrame, feedback: DataFrame | None, out: str, checkpoint: str, once: bool = True, dedupe: bool = False, late: str | None = None) -> list:
    """Starts the daily rollup of streams of usage events and of feedback; partial counters go to ``out`` by stream and batch.

    Two queries, as counters of the two add up; with ``dedupe`` an event or feedback id counts once over all batches."""
    session = events.sparkSession
    no_events = lambda: session.createDataFrame([], "occurred_at timestamp_ntz, surface string, operation string, status string, cache_hit boolean, result_status string, latency_ms bigint")
    no_feedback = lambda: session.createDataFrame([], "occurred_at timestamp_ntz, surface string, operation string, feedback_outcome string")
    parts = [("events", events, "event_id", lambda b: daily_rollup(normalized_events(b), no_feedback()))]
    if feedback is not None:
        parts.append(("feedback", feedback, "feedback_id", lambda b: daily_rollup(no_events(), normalized_feedback(b))))
    started = []
    for name, rows, key, counted in parts:
        x = _once(rows, key, late) if dedupe else rows
        w = x.writeStream.queryName(f"{name}-{uuid.uuid4().hex}").foreachBatch(_sink(f"{out}/{name}", counted)).option("checkpointLocation", f"{checkpoint}/{name}")
        started.append((w.trigger(availableNow=True) if once else w).start())
    return started


def rolled_up(spark: SparkSession, out: str) -> DataFrame:
    rows = spark.read.option("recursiveFileLookup", True).parquet(out)
    return rows.groupBy("metric_date", "surface", "operation").agg(*[F.sum(c).cast("bigint").alias(c) for c in COUNTERS])


def tree_stream(events: DataFrame, out: str, checkpoint: str, entity=("surface", "operation"), once: bool = True, late: str | None = None):
    """Keeps a trailing-totals tree up to date: late rows of any day append the nodes above that day, nothing else.

    An event counts once, in whatever batch it is delivered again: its id stays in the stream's state, for good or for ``late``."""

    def leaves(batch: DataFrame) -> DataFrame:
        return trailing.build_tree(trailing.daily_leaves(trailing.distinct_events(batch), list(entity)), list(entity))

    w = _once(events, "event_id", late).writeStream.foreachBatch(_sink(out, leaves)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def correlated_stream(events: DataFrame, feedback: DataFrame, late: str = "2 days") -> DataFrame:
    """Events with feedback of their key within ``late`` of each other; left outer, so unanswered events come out once the watermark passes."""
    e = events.withColumn("k", correlation_key()).withColumn("et", F.col("occurred_at").cast("timestamp")).where("k is not null").select("id", "k", "et").withWatermark("et", late)
    f = feedback.withColumn("fk", correlation_key()).withColumn("ft", F.col("occurred_at").cast("timestamp")).where("fk is not null").select("fk", "ft", "feedback_outcome").withWatermark("ft", late)
    return e.join(f, F.expr(f"k = fk and ft between et - interval {late} and et + interval {late}"), "leftOuter").select("id", "k", "et", "feedback_outcome")


def index_stream(workspace, changes: DataFrame, checkpoint: str, once: bool = True):
    """Keeps indexes up to date from a stream of changed files (root, path): each batch updates its directories, reading the named paths only.

    A batch names the snapshots it makes, so one that is run again after a failure makes them again and no others."""

    def update(batch: DataFrame, number: int) -> None:
        named = batch.where("root is not null and path is not null").groupBy("root").agg(F.array_sort(F.collect_set("path")).alias("paths"))
        for r in named.toLocalIterator():  # the changes of one batch
            workspace.update_index(r["root"], r["paths"], f"batch-{number:09d}")

    w = changes.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
