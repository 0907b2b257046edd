"""Sources of raw text: message brokers, document collections, files and memory."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .. import config as C

TEXT = T.StructType([T.StructField("value", T.StringType())])


class MissingConnector(RuntimeError):
    """The session has no jar for an external system."""


def _load(reader: Any, fmt: str) -> DataFrame:
    try:
        return reader.load()
    except Exception as e:
        if "DATA_SOURCE_NOT_FOUND" in str(e) or "Failed to find" in str(e):
            raise MissingConnector(f"the session has no '{fmt}' connector; add its package to spark.jars.packages") from e
        raise


def broker_options(cfg: C.ScopedConfig, topic: str | None = None) -> dict[str, str]:
    """Reads committed records only, if delivery is exactly once; new queries start at the latest record."""
    opts = {"kafka.bootstrap.servers": cfg.require(C.BROKERS), "subscribe": topic or cfg.require(C.TOPIC), "startingOffsets": "latest"}
    if cfg.get(C.DELIVERY_MODE, C.AT_LEAST_ONCE) == C.EXACTLY_ONCE:
        opts["kafka.isolation.level"] = "read_committed"
    return opts


def broker_stream(spark: SparkSession, cfg: C.ScopedConfig, topic: str | None = None) -> DataFrame:
    """Record values as text; offsets live in the query's checkpoint."""
    return _load(spark.readStream.format("kafka").options(**broker_options(cfg, topic)), "kafka").selectExpr("cast(value as string) AS value")


def collection(spark: SparkSession, cfg: C.ScopedConfig) -> DataFrame:
    """A whole document collection, bounded."""
    r = spark.read.format("mongodb").option("connection.uri", cfg.require(C.DOC_URI)).option("database", cfg.require(C.DOC_DB)).option("collection", cfg.require(C.DOC_COLLECTION))
    return _load(r, "mongodb")


def text_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Lines of text files as they appear in a folder; stands in for a broker."""
    r = spark.readStream.schema(TEXT).format("text")
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).load(path)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def memory(spark: SparkSession, rows: list, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
