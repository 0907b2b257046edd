"""Sinks: broker records, document upserts, search index, dead letters.

Each has a projection that is pure DataFrame work, and a writer for batches or, through
``foreachBatch``, for streams.  Writers run again with the same batch give the same state.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from .. import model
from ..pipeline import BlockResult
from ..sources.streams import MissingConnector

log = logging.getLogger(__name__)
UPSERT_BATCH, UPSERT_FLUSH_MS = 500, 1000
TRANSACTION_TIMEOUT_S = 900


@dataclass(frozen=True)
class BrokerSink:
    """Key: the primary key's bytes or null; value: the envelope as JSON; compacted topics get tombstones.

    The engine's broker writer is at-least-once and has no transactions, so ``write`` refuses
    ``exactly_once``; ``idempotent`` gives the producer idempotence, and readers drop repeats
    by trace id.
    """

    topic: str
    compacted: bool = False
    exactly_once: bool = False
    idempotent: bool = False

    def records(self, df: DataFrame) -> DataFrame:
        value = model.to_json(df).cast("binary")
        if self.compacted:
            value = F.when(F.upper("operation").eqNullSafe(F.lit("DELETE")), None).otherwise(value)
        return df.select(F.col("primary_key").cast("binary").alias("key"), value.alias("value"), F.col("event_time").alias("timestamp"))

    def options(self, cfg: C.ScopedConfig) -> dict[str, str]:
        o = {"kafka.bootstrap.servers": cfg.require(C.BROKERS), "topic": self.topic, "kafka.batch.size": str(32 * 1024), "kafka.linger.ms": "50", "kafka.compression.type": "snappy", "kafka.max.in.flight.requests.per.connection": "1"}
        if self.exactly_once or self.idempotent:
            o |= {"kafka.enable.idempotence": "true", "kafka.acks": "all", "kafka.transaction.timeout.ms": str(TRANSACTION_TIMEOUT_S * 1000)}
        return o

    def write(self, df: DataFrame, cfg: C.ScopedConfig):
        if self.exactly_once:
            raise ValueError("the engine's broker writer is at-least-once; use idempotent and drop repeats by trace id")
        records = self.records(df)
        try:
            if df.isStreaming:
                return records.drop("timestamp").writeStream.format("kafka").options(**self.options(cfg)).start()
            return records.drop("timestamp").write.format("kafka").options(**self.options(cfg)).save()
        except Exception as e:
            if "Failed to find" in str(e) or "DATA_SOURCE_NOT_FOUND" in str(e):
                raise MissingConnector("the session has no 'kafka' connector; add its package to spark.jars.packages") from e
            raise


@dataclass(frozen=True)
class UpsertSink:
    """Documents by ``key_field``: the last operation of each key wins; deletes remove, all others replace.

    Rows without a key, from the envelope or the payload, are dropped; payloads that are
    not objects become dead letters.
    """

    key_field: str = "_id"
    order: tuple[str, ...] = ("event_time", "event_seq")

    def _keyed(self, df: DataFrame) -> DataFrame:
        doc_key = F.try_variant_get(F.try_parse_json("payload_json"), f"$.{self.key_field}", "string")
        return df.withColumn("_key", F.coalesce(doc_key, F.col("primary_key"))).withColumn("_ok", F.json_object_keys("payload_json").isNotNull() | F.lower("operation").eqNullSafe(F.lit("delete")))

    def split(self, df: DataFrame) -> BlockResult:
        rows = self._keyed(df)
        bad = rows.where("not _ok")
        return BlockResult(rows.where("_ok and _key is not null").drop("_ok"), model.dead_letters(bad, model.SINK_ERROR, F.lit("payload is not a document"), "UpsertSink", model.to_json(df)))

    def last_operations(self, df: DataFrame) -> DataFrame:
        """One row per key: key, deleted, document."""
        rows = self.split(df).main
        w = Window.partitionBy("_key").orderBy(*[F.desc(o) for o in self.order])
        rows = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1")
        gone = F.lower("operation").eqNullSafe(F.lit("delete"))
        return rows.select(F.col("_key").alias("key"), gone.alias("deleted"), F.when(~gone, F.col("payload_json")).alias("document"))

    def merged(self, current: DataFrame | None, df: DataFrame) -> DataFrame:
        """The collection (key, document) after a batch of operations."""
        ops = self.last_operations(df)
        new = ops.where("not deleted").select("key", "document")
        return new if current is None else current.join(ops.select("key"), "key", "left_anti").unionByName(new)

    def parquet_writer(self, path: str) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: versions of the collection, one folder per batch; a batch that runs again replaces its own."""

        def write(df: DataFrame, batch_id: int) -> None:
            spark = df.sparkSession
            before = None
            if batch_id > 0 and (old := latest_version(spark, path, batch_id - 1)) is not None:
                before = spark.read.parquet(f"{path}/v={old}")
            self.merged(before, df).write.mode("overwrite").parquet(f"{path}/v={batch_id}")

        return write


def latest_version(spark: SparkSession, path: str, at_most: int | None = None) -> int | None:
    """The newest complete version in a folder of versions, through Spark's file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return None
    done = [int(s.getPath().getName()[2:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    done = [d for d in done if at_most is None or d <= at_most]
    return max(done, default=None)


@dataclass(frozen=True)
class SearchSink:
    """Documents by trace id; rows without one are skipped; a repeated id keeps its last row."""

    def documents(self, df: DataFrame) -> DataFrame:
        rows = df.where(F.length(F.trim("trace_id")) > 0)
        last = F.max(F.struct("event_time", "event_seq", model.to_json(df).alias("body")))
        return rows.groupBy(F.col("trace_id").alias("id")).agg(last.alias("r")).select("id", F.col("r.body").alias("body"))

    def skipped(self, df: DataFrame) -> int:
        return df.where(F.coalesce(F.length(F.trim("trace_id")), F.lit(0)) == 0).count()


@dataclass
class DlqSink:
    """Writes dead letters as JSON text; a failed write is counted and logged, and never raised."""

    path: str
    failed: int = 0

    def _write(self, dlq: DataFrame, path: str, mode: str) -> bool:
        try:
            dlq.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)
        except Exception:
            self.failed += 1
            log.exception("cannot write dead letters to %s", path)
            return False
        return True

    def write(self, dlq: DataFrame | None) -> bool:
        """Appends; whether the rows are written."""
        return dlq is None or self._write(dlq, self.path, "append")

    def batch(self, dlq: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``: a folder per batch, which a batch that runs again replaces."""
        self._write(dlq, f"{self.path}/batch={batch_id}", "overwrite")


def replay(dlq: DataFrame) -> DataFrame:
    """Raw texts of dead letters, ready for the parser."""
    return dlq.where("raw_event is not null").select(F.col("raw_event").alias("value"))
