"""Percentiles of very large numeric columns from mergeable compactor sketches.

A sketch is a hierarchy of compactors. Level l holds values of weight 2^l. A level that is over capacity is sorted, a fair
coin picks the odd or the even places, and those values move one level up while the others are dropped: ranks stay right
on average and the hierarchy stays small. Capacities shrink by 2/3 from the top level down, k at the top. Sketches merge
level by level and are compacted again, in any order, so partials of partitions, days or clusters combine.

Error: with k = 1024 the rank of an answer differs from the asked one by at most ``rank_error(k)`` = 0.5 % of n with
probability 0.99 for a single percentile, ``rank_error(k, m)`` for m of them at once (0.9 % for 100,000); below k values the answer is exact. Minimum and maximum are exact always.

Coins are drawn from a generator seeded by the group's key, the partition and the number of the hand-over, so a task that runs again after an executor
was lost draws the same ones. Values that are null, negative or not finite are not measured. A group without measured values
has no row. Ties and repeated values are kept as such; redelivered events (same event_id) count once.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from math import isqrt, log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rookery.functions.text import label
from rookery.sources.tables import table

K = 1024
SHRINK = 2 / 3
PROBS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
#: Values held by a task over all groups before it hands its sketches on and starts anew; early hand-over is always right.
HELD = 4_000_000
MAGIC = b"CS1"
KEYS = ("surface", "operation", "day")


def rank_error(k: int = K, asked: int = 1) -> float:
    """Bound on |rank - asked rank| / n that holds with probability 0.99 for all of ``asked`` percentiles together.

    For a single one it is measured in the tests; a rank's error is a sum of many independent coins, so its tails are those of a normal
    distribution and the bound grows with the root of the logarithm of how many are asked."""
    return 3.0 / k**0.92 * sqrt(log(2 * asked / 0.01) / log(2 / 0.01))


class CompactorSketch:
    """A randomized compactor hierarchy over int64 values."""

    __slots__ = ("k", "n", "low", "high", "levels", "rng", "fill")

    def __init__(self, k: int = K, seed: int = 0):
        self.k, self.n, self.low, self.high = k, 0, 2**63 - 1, -(2**63)
        self.levels: list[list[np.ndarray]] = [[]]
        self.fill = [0]
        self.rng = np.random.Generator(np.random.PCG64(seed & (2**63 - 1)))

    def held(self) -> int:
        return sum(self.fill)

    def _capacity(self, level: int) -> int:
        return max(8, int(self.k * SHRINK ** (len(self.levels) - 1 - level)))

    def update(self, values: np.ndarray) -> None:
        """Takes values of weight 1."""
        if not len(values):
            return
        self.n += len(values)
        self.low, self.high = min(self.low, int(values.min())), max(self.high, int(values.max()))
        self.levels[0].append(values)
        self.fill[0] += len(values)
        self._compact()

    def merge(self, other: CompactorSketch) -> None:
        """Levelwise union, then compaction."""
        while len(self.levels) < len(other.levels):
            self.levels.append([])
            self.fill.append(0)
        for i, parts in enumerate(other.levels):
            self.levels[i].extend(parts)
            self.fill[i] += other.fill[i]
        self.n += other.n
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        self._compact()

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if self.fill[level] > self._capacity(level) and (level < len(self.levels) - 1 or self.fill[level] > self.k):
                x = np.sort(np.concatenate(self.levels[level]))
                rest = x[-1:] if len(x) % 2 else x[:0]  # an odd one stays
                x = x[: len(x) - len(rest)]
                kept = x[int(self.rng.integers(2)) :: 2]
                self.levels[level], self.fill[level] = ([rest] if len(rest) else []), len(rest)
                if level + 1 == len(self.levels):
                    self.levels.append([])
                    self.fill.append(0)
                    self.levels[level + 1].append(kept)
                    self.fill[level + 1] += len(kept)
                    level = 0  # capacities below have shrunk
                    continue
                self.levels[level + 1].append(kept)
                self.fill[level + 1] += len(kept)
            level += 1

    def quantiles(self, probs: Sequence[float]) -> list[int]:
        """For each p the smallest held value whose estimated rank reaches ceil(p * n), at least 1."""
        parts = [np.concatenate(x) if x else np.empty(0, np.int64) for x in self.levels]
        v = np.concatenate(parts)
        w = np.concatenate([np.full(len(x), 1 << i, np.int64) for i, x in enumerate(parts)])
        order = np.argsort(v, kind="stable")
        v, ranks = v[order], np.cumsum(w[order])
        asked = np.maximum(1, np.ceil(np.asarray(probs) * self.n - 1e-9))
        asked = asked * (ranks[-1] / self.n)  # odd ones that stay keep the weights' sum at n; this guards against drift
        at = np.minimum(np.searchsorted(ranks, asked - 1e-6), len(v) - 1)
        return [self.low if p <= 0 else self.high if p >= 1 else int(v[i]) for p, i in zip(probs, at)]

    def to_bytes(self) -> bytes:
        sizes = struct.pack(f"<{len(self.fill)}I", *self.fill)
        head = MAGIC + struct.pack("<IQqqB", self.k, self.n, self.low, self.high, len(self.levels))
        return head + sizes + b"".join(np.ascontiguousarray(x, dtype="<i8").tobytes() for parts in self.levels for x in parts)

    @classmethod
    def from_bytes(cls, data: bytes, seed: int = 0) -> CompactorSketch:
        if data[:3] != MAGIC:
            raise ValueError("not a compactor sketch")
        k, n, low, high, count = struct.unpack_from("<IQqqB", data, 3)
        at = 3 + struct.calcsize("<IQqqB")
        sizes = struct.unpack_from(f"<{count}I", data, at)
        at += 4 * count
        s = cls(k, seed)
        s.n, s.low, s.high, s.levels, s.fill = n, low, high, [], list(sizes)
        for size in sizes:
            s.levels.append([np.frombuffer(data, "<i8", size, at)] if size else [])
            at += 8 * size
        return s


def _seed(key: tuple, part: int, turn: int = 0) -> int:
    return zlib.crc32(repr((key, part, turn)).encode())


def partial_sketches(df: DataFrame, keys: Sequence[str], value: str, k: int = K) -> DataFrame:
    """One sketch per group and partition of ``df``: keys, part, sketch. No shuffle; memory is bounded by ``HELD``."""
    keys = list(keys)
    schema = T.StructType([*[df.schema[c] for c in keys], T.StructField("part", T.IntegerType()), T.StructField("sketch", T.BinaryType())])
    x = df.where(F.col(value).isNotNull() & (F.col(value) >= 0)).select(*keys, F.col(value).cast("bigint").alias("_v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        live: dict[tuple, CompactorSketch] = {}
        held = turn = 0

        def out() -> pd.DataFrame:
            rows = [(*key, part, s.to_bytes()) for key, s in live.items()]
            return pd.DataFrame(rows, columns=[*keys, "part", "sketch"]).astype({c: object for c in keys})

        for pdf in batches:
            codes = np.zeros(len(pdf), np.int64)
            uniques = []
            for c in keys:
                code, u = pd.factorize(pdf[c], use_na_sentinel=False)
                uniques.append(u)
                codes = codes * len(u) + code
            values = pdf["_v"].to_numpy(np.int64)
            order = np.argsort(codes, kind="stable")
            codes, values = codes[order], values[order]
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else []
            for a, b in zip(starts, [*starts[1:], len(codes)]):
                c, key = int(codes[a]), []
                for u in reversed(uniques):
                    c, i = divmod(c, len(u))
                    key.append(None if pd.isna(u[i]) else u[i])
                key = tuple(reversed(key))
                s = live.get(key)
                if s is None:
                    s = live[key] = CompactorSketch(k, _seed(key, part, turn))
                before = s.held()
                s.update(values[a:b].copy())
                held += s.held() - before
            if held > HELD:
                yield out()
                live, held, turn = {}, 0, turn + 1  # a group that comes back draws other coins
        if live:
            yield out()

    return x.mapInPandas(run, schema)


def merge_sketches(partials: DataFrame, keys: Sequence[str], k: int = K, fan: int | None = None) -> DataFrame:
    """One sketch per group. Partials of a group meet sorted in one task and are merged one by one, never held together.

    Above 200 shuffle partitions a group's partials first meet in ``fan`` = sqrt(partitions) tasks, so a hot group's
    hundred thousand partials are merged as a tree of two levels."""
    n = int(partials.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fan = fan if fan is not None else (isqrt(n) if n > 200 else 1)
    keys = list(keys)
    x = partials.select(*keys, "part", "sketch")
    if fan > 1:
        x = _merged(x.withColumn("part", F.col("part") % fan), [*keys, "part"], k)
    return _merged(x, keys, k)


def _merged(x: DataFrame, keys: list[str], k: int) -> DataFrame:
    schema = T.StructType([*[x.schema[c] for c in keys], *([] if "part" in keys else [T.StructField("part", T.IntegerType())]), T.StructField("sketch", T.BinaryType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, live, done = None, None, []
        cols = [*keys, *([] if "part" in keys else ["part"]), "sketch"]

        def row():
            return (*key, *([] if "part" in keys else [0]), live.to_bytes())

        for pdf in batches:
            for now, data in zip(zip(*[pdf[c] for c in keys]), pdf["sketch"]):
                now = tuple(None if pd.isna(v) else v for v in now)
                if live is None or now != key:
                    if live is not None:
                        done.append(row())
                    key, live = now, CompactorSketch.from_bytes(bytes(data), _seed(now, -1))
                else:
                    live.merge(CompactorSketch.from_bytes(bytes(data)))
            if len(done) > 2000:
                yield pd.DataFrame(done, columns=cols)
                done = []
        if live is not None:
            done.append(row())
        if done:
            yield pd.DataFrame(done, columns=cols)

    order = [*keys, *([] if "part" in keys else ["part"])]
    return x.repartition(*keys).sortWithinPartitions(*order).mapInPandas(run, schema)


def percentiles(sketches: DataFrame, keys: Sequence[str], probs: Sequence[float] = PROBS) -> DataFrame:
    """keys, n, p, value: one row per asked percentile."""
    keys, probs = list(keys), tuple(probs)
    schema = T.StructType([*[sketches.schema[c] for c in keys], T.StructField("n", T.LongType()), T.StructField("p", T.DoubleType()), T.StructField("value", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [CompactorSketch.from_bytes(bytes(b)) for b in pdf["sketch"]]
            rows = [(*key, s.n, p, v) for key, s in zip(zip(*[pdf[c] for c in keys]), got) for p, v in zip(probs, s.quantiles(probs))]
            yield pd.DataFrame(rows, columns=[*keys, "n", "p", "value"])

    return sketches.select(*keys, "sketch").mapInPandas(run, schema)


def measured(events: DataFrame) -> DataFrame:
    """surface, operation, day, latency_ms of each event once."""
    key = F.coalesce(F.col("event_id"), F.concat(F.lit("\0"), F.col("id").cast("string")))
    return (
        events.where("latency_ms >= 0")
        .select(key.alias("event"), label("surface").alias("surface"), label("operation").alias("operation"), F.date_format("occurred_at", "yyyy-MM-dd").alias("day"), "latency_ms")
        .distinct()
    )


def day_sketches(events: DataFrame, k: int = K) -> DataFrame:
    """The partial results of single days, mergeable by ``merge_sketches``."""
    return merge_sketches(partial_sketches(measured(events), KEYS, "latency_ms", k), KEYS, k)


def with_all_days(days: DataFrame, k: int = K) -> DataFrame:
    """Day sketches and, merged from them, one per surface and operation over all days (day 'all')."""
    whole = merge_sketches(days.withColumn("part", (F.crc32(F.coalesce("day", F.lit(""))) % 1_000_003).cast("int")), ["surface", "operation"], k)
    return days.select(*KEYS, "sketch").unionByName(whole.select("surface", "operation", F.lit("all").alias("day"), "sketch"))


def latency_percentiles(spark, d: str, k: int = K) -> DataFrame:
    """p1_percentiles: surface, operation, day (or 'all'), n, p, value."""
    return percentiles(with_all_days(day_sketches(table(spark, d, "semantic_usage_events"), k), k), KEYS)


#: p1_bounds asks fewer percentiles at once.
ASKED = 100_000


def percentile_check(spark, d: str, k: int = K) -> DataFrame:
    """p1_bounds: the answers of p1_percentiles against exact ranks; ``within`` tells whether the stated error holds.

    Each value is counted against the at most 16 answers of its two groups (its day and all days), after reduction to
    distinct values, so the join multiplies small rows by a constant."""
    events = table(spark, d, "semantic_usage_events")
    answers = latency_percentiles(spark, d, k).groupBy(*KEYS, "n").agg(F.collect_set("value").alias("asked"), F.collect_list(F.struct("p", "value")).alias("answers"))
    one = measured(events).groupBy("surface", "operation", "day", "latency_ms").agg(F.count(F.lit(1)).alias("c"))
    both = one.unionByName(one.withColumn("day", F.lit("all")))
    a, v = answers.alias("a"), both.alias("v")
    on = F.col("a.surface").eqNullSafe(F.col("v.surface")) & F.col("a.operation").eqNullSafe(F.col("v.operation")) & F.col("a.day").eqNullSafe(F.col("v.day"))
    x = v.join(a, on).select("a.surface", "a.operation", "a.day", "a.n", "v.c", "v.latency_ms", F.inline("a.answers"))
    less = F.sum(F.when(F.col("latency_ms") < F.col("value"), F.col("c")).otherwise(0))
    upto = F.sum(F.when(F.col("latency_ms") <= F.col("value"), F.col("c")).otherwise(0))
    r = x.groupBy("surface", "operation", "day", "n", "p", "value").agg(less.alias("less"), upto.alias("upto"))
    slack = F.lit(rank_error(k, ASKED)) * F.col("n") + 1
    return r.select("surface", "operation", "day", "n", "p", ((F.col("less") <= F.col("p") * F.col("n") + slack) & (F.col("upto") >= F.col("p") * F.col("n") - slack)).alias("within"))


QUERIES = {"p1_percentiles": latency_percentiles, "p1_bounds": percentile_check}
SQL = {
    "p1_bounds": f"""with e as (select distinct coalesce(event_id, chr(1) || id::varchar) as event, lower(trim(surface)) as surface, lower(trim(operation)) as operation,
        strftime(occurred_at, '%Y-%m-%d') as day, latency_ms from semantic_usage_events where latency_ms >= 0),
    g as (select surface, operation, day, count(*) as n from e group by all union all select surface, operation, 'all', count(*) from e group by all)
    select surface, operation, day, n, p, true as within from g, (select unnest([{', '.join(map(str, PROBS))}])::double as p) order by all""",
}
