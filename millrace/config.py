"""Layered settings: overrides, Spark conf, environment, .env, the job's section, the common section."""

from __future__ import annotations

import json
import logging
import os
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession

log = logging.getLogger(__name__)
COMMON = "common"
# Setting names of the connectors.
BROKERS, TOPIC, DLQ_TOPIC, DELIVERY_MODE = "KAFKA_BOOTSTRAP_SERVERS", "STREAM_TOPIC", "DLQ_TOPIC", "DELIVERY_MODE"
AT_LEAST_ONCE, EXACTLY_ONCE = "at_least_once", "exactly_once"
DOC_URI, DOC_DB, DOC_COLLECTION = "MONGO_URI", "MONGO_DB", "MONGO_COLLECTION"
SEARCH_HOST, SEARCH_INDEX = "ES_HOST", "ES_INDEX"


def _dotenv(path: Path) -> dict[str, str]:
    out = {}
    if path.exists():
        for line in path.read_text().splitlines():
            k, eq, v = line.strip().partition("=")
            if eq and not k.startswith("#"):
                out[k.removeprefix("export ").strip()] = v.strip().strip("\"'")
    return out


@dataclass
class ScopedConfig:
    """A blank value counts as missing in ``require``, ``exists`` and ``get``."""

    job: str | None = None
    overrides: dict[str, str] = field(default_factory=dict)
    sections: dict[str, dict[str, str]] = field(default_factory=dict)
    dotenv: dict[str, str] = field(default_factory=dict)

    @classmethod
    def load(cls, job: str | None = None, path: str = "millrace.json", dotenv: str = ".env", **overrides: str) -> ScopedConfig:
        sections: dict[str, dict[str, str]] = {}
        if Path(path).exists():
            try:
                sections = json.loads(Path(path).read_text())
            except ValueError as e:
                log.error("cannot read %s: %s", path, e)
        return cls(job, dict(overrides), sections, _dotenv(Path(dotenv)))

    def _resolve(self, key: str, with_job: bool = True) -> str | None:
        spark = SparkSession.getActiveSession()
        conf = spark.conf.get(f"spark.millrace.{key}", None) if spark else None
        layers = [self.overrides.get(key), conf, os.environ.get(key), self.dotenv.get(key)]
        if with_job and self.job:
            layers.append(self.sections.get(self.job, {}).get(key))
        layers.append(self.sections.get(COMMON, {}).get(key))
        return next((v for v in layers if v is not None), None)

    def require(self, key: str) -> str:
        v = self._resolve(key)
        if v is None or not v.strip():
            raise ValueError(f"missing setting {key}" + (f" of job {self.job}" if self.job else ""))
        return v

    def exists(self, key: str) -> bool:
        return bool((self._resolve(key) or "").strip())

    def get(self, key: str, default: str | None = None) -> str | None:
        v = self._resolve(key)
        return v if v is not None and v.strip() else default

    def get_global(self, key: str, default: str | None = None) -> str | None:
        """Like ``get``, but the job's own section is passed over."""
        v = self._resolve(key, with_job=False)
        return v if v is not None and v.strip() else default


@dataclass(frozen=True)
class CheckpointSettings:
    """Trigger and checkpoint settings of a streaming query; pause and timeout follow the interval."""

    interval_seconds: int = 60
    location: str | None = None

    @property
    def pause_seconds(self) -> int:
        return self.interval_seconds // 2

    @property
    def timeout_seconds(self) -> int:
        return self.interval_seconds * 2

    def on(self, writer):
        writer = writer.trigger(processingTime=f"{self.interval_seconds} seconds")
        return writer.option("checkpointLocation", self.location) if self.location else writer


def session(app: str = "millrace", prometheus: bool = False, **conf: str) -> SparkSession:
    """A session with the settings that the blocks rely on."""
    b = SparkSession.builder.appName(app)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.multipleWatermarkPolicy": "min",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    if prometheus:
        base |= {"spark.ui.prometheus.enabled": "true", "spark.executor.processTreeMetrics.enabled": "true"}
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()
