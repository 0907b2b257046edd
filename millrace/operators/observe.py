"""Observation without change: silence, latency, quality counters, stage metadata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import metrics
from ..functions import maps
from ..pipeline import BlockResult


HOUR_MS = 3_600_000


@dataclass(frozen=True)
class FlowDisruptionDetector:
    """Per key, an alert when no row follows within the timeout; main rows are unchanged.

    Alerts: key, disrupted_at (last row plus timeout), recovered_at (the next row, or null
    while silent).  ``until`` bounds the wait for a key's last row in a bounded frame:
    without it, a last row raises no alert.

    Where rows are ordered by the clock, a key's rows are sorted hour by hour (or by the
    timeout, if longer) and only the hours' first and last rows meet, so a key with a large
    share of all rows is no single task.
    """

    key: str
    timeout_ms: int
    clock: str = "event_time"
    order: tuple[str, ...] = ("event_time", "event_seq")
    until: Column | None = None

    def alerts(self, df: DataFrame) -> DataFrame:
        rows = df.where(F.col(self.key).isNotNull() & F.col(self.clock).isNotNull())
        hour = F.lit(0)
        if self.order and self.order[0] == self.clock:
            hour = F.floor(F.unix_micros(F.col(self.clock).cast("timestamp")) / (1000 * max(self.timeout_ms, HOUR_MS)))
        rows = rows.select(F.col(self.key).alias("key"), F.col(self.clock).alias("_t"), hour.alias("_hour"), F.struct(*self.order).alias("_o"))
        within = rows.withColumn("recovered_at", F.lead("_t").over(Window.partitionBy("key", "_hour").orderBy("_o"))).where("recovered_at is not null")
        ends = rows.groupBy("key", "_hour").agg(F.min_by("_t", "_o").alias("_first"), F.max_by("_t", "_o").alias("_t"))
        ends = ends.withColumn("recovered_at", F.lead("_first").over(Window.partitionBy("key").orderBy("_hour")))
        rows = within.select("key", "_t", "recovered_at").unionByName(ends.select("key", "_t", "recovered_at"))
        end = F.coalesce("recovered_at", self.until) if self.until is not None else F.col("recovered_at")
        rows = rows.where(F.unix_micros(end.cast("timestamp")) - F.unix_micros(F.col("_t").cast("timestamp")) > 1000 * self.timeout_ms)
        return rows.select("key", (F.col("_t") + F.make_dt_interval(secs=F.lit(self.timeout_ms / 1000))).alias("disrupted_at"), "recovered_at")

    def apply(self, df: DataFrame) -> BlockResult:
        if df.isStreaming:
            from ..streaming.processors import silence_stream

            return BlockResult(df, sides={"silence": silence_stream(df, F.col(self.key), self.timeout_ms)})
        return BlockResult(df, sides={"silence": self.alerts(df)})


@dataclass(frozen=True)
class LatencyDetector:
    """Counts rows later than the threshold (strictly) and the largest latency; rows without a time are ignored."""

    threshold_ms: int
    time: str = "event_time"
    now: Column | None = None
    scope: str = "latency"

    def latency_ms(self) -> Column:
        now = self.now if self.now is not None else F.current_timestamp()
        return ((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(self.time).cast("timestamp"))) / 1000).cast("long")

    def apply(self, df: DataFrame) -> BlockResult:
        out, o = metrics.observed(df, self.scope, "latency", {metrics.key("latency", "alert"): self.latency_ms() > self.threshold_ms}, {"latency.max_ms": F.max(self.latency_ms())})
        return BlockResult(out, observations={f"{self.scope}.latency": o})


@dataclass(frozen=True)
class MetadataDecorator:
    """Adds ``stage.<name>.taskName``, ``.subtaskIndex`` and ``.processedAt``; other keys stay."""

    stage: str
    task_name: str | None = None
    processed_at: Column | None = None
    counted: bool = False

    def apply(self, df: DataFrame) -> BlockResult:
        at = self.processed_at if self.processed_at is not None else F.current_timestamp()
        own = {"taskName": F.lit(self.task_name or self.stage), "subtaskIndex": F.spark_partition_id().cast("string"), "processedAt": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")}
        df, seen = metrics.counted(df, "decorator", {"event": F.lit(True)}, self.counted)
        return BlockResult(df.withColumn("metadata", maps.put("metadata", {f"stage.{self.stage}.{k}": v for k, v in own.items()})), observations=seen)


@dataclass(frozen=True)
class QualityCheck:
    name: str
    condition: Column

    @classmethod
    def is_null(cls, column: str) -> QualityCheck:
        return cls(f"null_{column}", F.col(column).isNull())


@dataclass(frozen=True)
class OnlineObserver:
    """Counts all rows and those for which each check is true; main rows are unchanged."""

    checks: tuple[QualityCheck, ...] = ()
    scope: str = "observer"

    def apply(self, df: DataFrame) -> BlockResult:
        out, o = metrics.observed(df, self.scope, "observer", {metrics.OBSERVER_TOTAL: F.lit(True), **{c.name: c.condition for c in self.checks}})
        return BlockResult(out, observations={f"{self.scope}.observer": o})

    def counts(self, df: DataFrame) -> DataFrame:
        """The same counters as one row."""
        return df.agg(F.count("*").alias("total_events"), *[F.count_if(F.coalesce(c.condition, F.lit(False))).alias(c.name) for c in self.checks])
