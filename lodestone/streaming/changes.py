"""The change stream: debounced batches of paths, applied to the index; progress."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store

log = logging.getLogger("lodestone")
#: Levels by name; verbose lies between info and debug.
LEVELS = {"silent": logging.CRITICAL + 1, "info": logging.INFO, "verbose": 15, "debug": logging.DEBUG}


def set_level(name: str) -> None:
    """How much the library says: silent, info, verbose or debug."""
    if name not in LEVELS:
        raise ValueError(f"no level {name}")
    log.setLevel(LEVELS[name])


def source(spark: SparkSession, path: str, schema: str, per_trigger: int = 16) -> DataFrame:
    """Change events (path, action, ts) from Parquet files as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


#: Ranges of time in which quiet gaps are sought side by side, at most, and parts into which the rows of one moment are dealt.
SLICES, SALTS = 256, 8


def _moments(events: DataFrame, gap: str) -> DataFrame:
    """ts, period, start of every moment at which something happened: the number and the beginning of its period without a gap.

    Moments are cut into ranges of time with about the same number of them. Gaps are found in each range by itself; then the ranges,
    one row each, tell which periods go on over a border and how many came before. No range holds more than its share of moments, and
    no period needs to be in one task; where the cuts are does not matter for the result."""
    spark = events.sparkSession
    times = events.filter("ts IS NOT NULL").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).distinct()
    n = max(1, min(SLICES, 4 * spark.sparkContext.defaultParallelism))
    found = times.agg(F.percentile_approx("us", [i / n for i in range(1, n)] or [0.5]).alias("c")).first()
    cuts = sorted(set((found and found.c) or []))
    at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("us"))) if cuts else F.lit(0)
    wait = F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {gap}"))
    by = Window.partitionBy("slice").orderBy("us")
    here = times.withColumn("slice", at).withColumn("before", F.lag("us").over(by))
    opens = F.when(F.col("us") - F.col("before") < wait, 0).otherwise(1)
    here = here.withColumn("local", F.sum(opens).over(by)).drop("before")
    slices = here.groupBy("slice").agg(F.max("local").alias("k"), F.min("us").alias("first"), F.max("us").alias("last"))
    order = Window.orderBy("slice")  # over one row for each range, SLICES at most
    slices = slices.withColumn("goes_on", F.when(F.col("first") - F.lag("last").over(order) < wait, 1).otherwise(0))
    earlier = F.coalesce(F.sum(F.col("k") - F.col("goes_on")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = here.join(F.broadcast(slices.select("slice", (earlier - F.col("goes_on")).alias("base"))), "slice").select("us", (F.col("base") + F.col("local")).alias("period"))
    starts = numbered.groupBy("period").agg(F.min("us").alias("start"))
    return numbered.join(starts, "period").select(F.timestamp_micros("us").alias("ts"), "period", F.timestamp_micros("start").alias("start"))


def quiet_paths(events: DataFrame, gap: str = "300 milliseconds") -> DataFrame:
    """start, path, n_events, last: the distinct paths of each period that a quiet time of `gap` ends, with its last moment. events: path, ts.

    Rows are counted by moment and path before they meet their period, and those of one moment are dealt to several tasks."""
    per = events.filter("ts IS NOT NULL").groupBy(F.col("ts").cast("timestamp").alias("ts"), "path").agg(F.count(F.lit(1)).alias("n"))
    per = per.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
    moments = _moments(events, gap).withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return per.join(moments, ["ts", "salt"]).groupBy("start", "path").agg(F.sum("n").alias("n_events"), F.max("ts").alias("last"))


def quiet_periods(events: DataFrame, gap: str = "300 milliseconds") -> DataFrame:
    """start, end, n_events, n_paths of each period."""
    each = quiet_paths(events, gap).groupBy("start").agg(F.max("last").alias("last"), F.sum("n_events").alias("n_events"), F.count(F.lit(1)).alias("n_paths"))
    return each.select("start", (F.col("last") + F.expr(f"INTERVAL {gap}")).alias("end"), "n_events", "n_paths")


class Quiet:
    """The batch function of on_quiet(). What is pending is a table: path, action, ts, and at: the last moment of its period."""

    def __init__(self, store: Store, gap: str, handle: Callable[[DataFrame, int], None]):
        self.store, self.gap, self.handle = store, gap, handle
        self.wait = store.spark.range(1).select((F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {gap}")) / 1e6).alias("s")).first().s
        self.came = time.monotonic()

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch = batch.filter("path IS NOT NULL").select("path", "action", F.col("ts").cast("timestamp").alias("ts")).persist()
        try:
            if batch.isEmpty():
                if self.store.has("pending") and time.monotonic() - self.came >= self.wait:
                    self._close(self.store.read("pending"), number)
                    self.store.forget("pending")
                return
            self.came = time.monotonic()
            new = last_events(batch.withColumn("event_id", F.lit(0))).select("path", "action", "ts")
            seen = batch.select("path", "ts")
            if self.store.has("pending"):
                held = self.store.read("pending")
                seen = seen.unionByName(held.select("path", F.col("at").alias("ts")))
                new = new.unionByName(held.select("path", "action", "ts"))
            periods = quiet_paths(seen, self.gap).persist()
            try:
                *closed, open_ = [r.start for r in periods.select("start").distinct().orderBy("start").collect()]
                for start in closed:
                    self._close(periods.filter(F.col("start") == start).select("path").join(new, "path"), number)
                at = periods.filter(F.col("start") == open_).agg(F.max("last")).first()[0]
                rest = last_events(periods.filter(F.col("start") == open_).select("path").join(new, "path").withColumn("event_id", F.lit(0)))
                self.store.write(pending=rest.withColumn("at", F.lit(at)))
            finally:
                periods.unpersist()
        finally:
            batch.unpersist()

    def _close(self, rows: DataFrame, number: int) -> None:
        self.handle(rows.select("path").distinct(), number)


def on_quiet(events: DataFrame, handle: Callable[[DataFrame, int], None], folder: str, checkpoint: str, gap: str = "300 milliseconds") -> StreamingQuery:
    """Run handle(paths, number) once for each period of a stream of events (path, action, ts) that a quiet time of `gap` ends. The query runs on.

    A second source ticks, so that the end of a period is seen when nothing more comes. Pending paths are a table below folder, which
    outlives a restart; a batch that fails is repeated, so handle must be idempotent."""
    spark = events.sparkSession
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    none = [F.lit(None).cast(events.schema[c].dataType).alias(c) for c in ("path", "action", "ts")]
    both = events.select("path", "action", "ts").unionByName(ticks.select(*none))
    quiet = Quiet(Store(spark, folder), gap, handle)
    every = f"{max(100, int(quiet.wait * 500))} milliseconds"
    return both.writeStream.foreachBatch(quiet).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def last_events(events: DataFrame) -> DataFrame:
    """path, action, ts: the last event of each path."""
    last = F.max_by(F.struct("action", "ts"), F.struct("ts", "event_id")).alias("e")
    return events.groupBy("path").agg(last).select("path", "e.action", "e.ts")


def apply_changes(batches: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run handle(batch, number) for each micro-batch; a batch is repeated after a failure, so handle must be idempotent."""
    return batches.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@dataclass(frozen=True)
class Progress:
    phase: str
    current: int
    total: int
    message: str = ""

    @property
    def percent(self) -> int:
        return round(100 * self.current / self.total) if self.total else 0


class Reporter:
    """Passes progress to listeners; a failing listener is logged and does not stop the others."""

    def __init__(self) -> None:
        self.listeners: list[Callable[[Progress], None]] = []

    def report(self, phase: str, current: int, total: int, message: str = "") -> None:
        for f in self.listeners:
            try:
                f(Progress(phase, current, total, message))
            except Exception:
                log.exception("a progress listener failed")
