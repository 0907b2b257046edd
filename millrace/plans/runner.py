"""Jobs as running streams: source, watermark, checkpoint, sinks and dead letters of each.

The main rows, every side output and the dead letters are queries of their own with
checkpoints of their own, so each resumes where it stopped.  Batches are written as
folders by batch number, or as versions of a collection; a batch that runs again replaces
its own.  A failed write of dead letters is counted and logged, and stops nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CheckpointSettings
from ..operators.parse import EnvelopeParser
from ..sinks.sinks import DlqSink, UpsertSink
from ..sources import cdc, streams
from .jobs import REGISTRY

#: Jobs whose input are changes, whose frames meet in time, and whose result is a collection.
CHANGES, TIMED, DOCUMENTS = {"MongoToKafka"}, {"OrderPaymentJoin", "MergedIngest"}, {"KafkaToMongo"}
#: How late a row of a timed job may be.
OUT_OF_ORDER = "5 seconds"


def _folders(path: str) -> Callable[[DataFrame, int], None]:
    def write(df: DataFrame, batch_id: int) -> None:
        df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{path}/batch={batch_id}")

    return write


@dataclass
class RunningJob:
    """The streaming queries of a job, by output."""

    queries: dict = field(default_factory=dict)

    def wait(self, seconds: float | None = None) -> bool:
        """Whether all queries have ended; one that failed raises its error."""
        return all([q.awaitTermination(seconds) if seconds is not None else q.awaitTermination() or True for q in self.queries.values()])

    def stop(self) -> None:
        for q in self.queries.values():
            q.stop()


def start(spark: SparkSession, name: str, inputs: list[str], out: str, settings: CheckpointSettings | None = None, once: bool = False) -> RunningJob:
    """Starts a job on folders that new files arrive in; ``once`` ends it when all present files are read."""
    if name not in REGISTRY:
        raise ValueError(f"unknown job {name}")
    settings = settings or CheckpointSettings(location=f"{out}/_checkpoints")
    frames, dead = [], []
    for path in inputs:
        if name in CHANGES:
            frames.append(cdc.multi_reader(spark, path))
            continue
        parsed = EnvelopeParser().apply(streams.text_stream(spark, path))
        dead.append(parsed.dlq)
        frames.append(parsed.main.withWatermark("event_time", OUT_OF_ORDER) if name in TIMED else parsed.main)
    r = REGISTRY[name].build(*frames)
    dead += [r.dlq] if r.dlq is not None else []
    outputs = {"main": r.main, **r.sides} | ({"dlq": reduce(DataFrame.unionByName, dead)} if dead else {})
    job = RunningJob()
    for part, df in outputs.items():
        if part == "main" and name in DOCUMENTS:
            write = UpsertSink().parquet_writer(f"{out}/main")
        elif part == "dlq":
            write = DlqSink(f"{out}/dlq").batch
        else:
            write = _folders(f"{out}/{part}")
        w = df.writeStream.queryName(f"{name}-{part}").foreachBatch(write).outputMode("append")
        w = CheckpointSettings(settings.interval_seconds, f"{settings.location}/{part}").on(w)
        job.queries[part] = (w.trigger(availableNow=True) if once else w).start()
    return job
