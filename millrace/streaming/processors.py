"""Exact processing-time state: dedup, change suppression, materialisation, silence.

Each is a row processor of ``transformWithState`` with one small value per key, expired
by the state store's TTL.  The rows travel as JSON text, with times to the microsecond,
and are parsed back into the input's schema, so any schema passes.  A null key and an
empty one are two keys.  The RocksDB state store is required.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import Row


_OUT = T.StructType([T.StructField("kind", T.StringType()), T.StructField("key", T.StringType()), T.StructField("row", T.StringType()), T.StructField("before", T.StringType()), T.StructField("at", T.LongType())])
_VALUE = T.StructType([T.StructField("v", T.StringType())])
_LONG = T.StructType([T.StructField("v", T.LongType())])


class _Dedup(StatefulProcessor):
    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", _LONG, ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        for r in rows:
            if not self.seen.exists():
                self.seen.update((1,))
                yield Row(kind="PASS", key=key[0], row=r["_row"], before=None, at=None)

    def close(self) -> None:
        pass


class _Suppress(StatefulProcessor):
    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _LONG, ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        for r in rows:
            h = r["_hash"]
            if not self.last.exists() or self.last.get()[0] != h:
                self.last.update((h,))
                yield Row(kind="PASS", key=key[0], row=r["_row"], before=None, at=None)

    def close(self) -> None:
        pass


class _Materialize(StatefulProcessor):
    def __init__(self, ttl_ms: int | None, merge: Callable[[dict, dict], dict] | None = None):
        self.ttl_ms, self.merge = ttl_ms, merge

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", _VALUE, ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        for r in rows:
            before = self.value.get()[0] if self.value.exists() else None
            if r["_del"]:
                self.value.clear()
                yield Row(kind="DELETE", key=key[0], row=None, before=before, at=r["_at"])
            else:
                row = r["_row"]
                if before is not None and self.merge is not None:
                    row = json.dumps(self.merge(json.loads(before), json.loads(row)))
                self.value.update((row,))
                yield Row(kind="INSERT" if before is None else "UPDATE", key=key[0], row=row, before=before, at=r["_at"])

    def close(self) -> None:
        pass


class _Silence(StatefulProcessor):
    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", _LONG)
        self.silent = handle.getValueState("silent", _LONG)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        for _ in rows:
            pass
        now = timerValues.getCurrentProcessingTimeInMs()
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        self.timer.update((now + self.timeout_ms,))
        self.handle.registerTimer(now + self.timeout_ms)
        if self.silent.exists():
            self.silent.clear()
            yield Row(kind="RECOVERED", key=key[0], row=None, before=None, at=now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.timer.clear()
        self.silent.update((1,))
        yield Row(kind="DISRUPTED", key=key[0], row=None, before=None, at=expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


#: Times as JSON text and back without loss.
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _run(df: DataFrame, key: Column, processor: StatefulProcessor, **extra: Column) -> DataFrame:
    # a sign before the key tells an empty one from none
    signed = F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("-"))
    rows = df.select(signed.alias("_key"), F.to_json(F.struct("*"), _TIMES).alias("_row"), *[v.alias(k) for k, v in extra.items()])
    out = rows.groupBy("_key").transformWithState(processor, _OUT, "append", "processingTime")
    return out.withColumn("key", F.when(F.col("key") != "-", F.substring("key", 2, 2**31 - 1)))


def _rows(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(F.from_json("row", schema, _TIMES).alias("r")).select("r.*")


def dedup_stream(df: DataFrame, key: Column, ttl_ms: int | None) -> DataFrame:
    return _rows(_run(df, key, _Dedup(ttl_ms)), df.schema)


def dedup_within_watermark(df: DataFrame, keys: list[str], time: str, ttl: str) -> DataFrame:
    """Event-time variant, by the engine's own operator."""
    return df.withWatermark(time, ttl).dropDuplicatesWithinWatermark(keys)


def suppress_stream(df: DataFrame, key: Column, fingerprint: Column, ttl_ms: int | None) -> DataFrame:
    return _rows(_run(df, key, _Suppress(ttl_ms), _hash=fingerprint), df.schema)


def materialize_stream(df: DataFrame, key: Column, delete: Column | None, ttl_ms: int | None, merge: Callable[[dict, dict], dict] | None = None) -> DataFrame:
    gone = F.coalesce(delete, F.lit(False)) if delete is not None else F.lit(False)
    at = F.unix_millis(F.col("event_time")) if "event_time" in df.columns else F.lit(0).cast("long")
    out = _run(df.where(key.isNotNull()), key, _Materialize(ttl_ms, merge), _del=gone, _at=F.coalesce(at, F.lit(0).cast("long")))
    return out.select(F.col("kind").alias("change_type"), "key", F.from_json("before", df.schema, _TIMES).alias("before"), F.from_json("row", df.schema, _TIMES).alias("after"), F.timestamp_millis("at").alias("timestamp"))


def silence_stream(df: DataFrame, key: Column, timeout_ms: int) -> DataFrame:
    """Alerts (key, kind DISRUPTED or RECOVERED, at)."""
    out = _run(df.where(key.isNotNull()), key, _Silence(timeout_ms))
    return out.select("key", "kind", F.timestamp_millis("at").alias("at"))


