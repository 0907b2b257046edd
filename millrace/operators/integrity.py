"""Data integrity: dedup, schema versions, constraints, suppression of empty changes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import metrics, model
from ..functions import jsonx
from ..functions.columns import bound, unused
from ..pipeline import BlockResult

ORDER = ("event_time", "event_seq")


def _ttl_scan(df: DataFrame, key: Column, clock: str, order: tuple[str, ...], ttl_ms: int, state: Column | None) -> DataFrame:
    """Rows that pass: a key's first, those at least a TTL after the last that passed, and those whose state differs from it.

    One sorted pass over the keys' partitions: a task holds a batch and one key's last
    state, never a key's rows.
    """
    schema = df.schema
    h, k, t, st = unused(df, "_h", "_k", "_t", "_s")
    at = F.coalesce(F.unix_micros(F.col(clock).cast("timestamp")), F.lit(0))
    helpers = {h: F.xxhash64(key), k: key.cast("string"), t: at, st: state.cast("long") if state is not None else F.lit(0).cast("long")}
    work = df.select("*", *[v.alias(c) for c, v in helpers.items()])
    work = work.repartition(h).sortWithinPartitions(h, k, t, *order)
    n = len(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, anchor, held = run, 0, 0  # no key equals the function
        for b in batches:
            keys, times, states = b.column(n + 1).to_pylist(), b.column(n + 2).to_pylist(), b.column(n + 3).to_pylist()
            keep = np.zeros(b.num_rows, bool)
            for i, (k, t, s) in enumerate(zip(keys, times, states, strict=True)):
                if k != now or t - anchor >= 1000 * ttl_ms or s != held:
                    keep[i], now, anchor, held = True, k, t, s
            yield pa.RecordBatch.from_arrays(b.columns[:n], schema=pa.schema([b.schema.field(i) for i in range(n)])).filter(pa.array(keep))

    return work.mapInArrow(run, schema)


@dataclass(frozen=True)
class Deduplicator:
    """The first row of each key passes; with a TTL, also the first at or after each expiry.

    The TTL counts from the row that passed and does not slide.  ``clock`` stands in for
    processing time; a row without a time counts as at 1970-01-01.  Rows without a key are
    one group, apart from those with an empty key.
    """

    key: Column
    ttl_ms: int | None = None
    clock: str = "event_time"
    order: tuple[str, ...] = ORDER

    def apply(self, df: DataFrame) -> BlockResult:
        if df.isStreaming:
            from ..streaming.processors import dedup_stream

            return BlockResult(dedup_stream(df, self.key, self.ttl_ms))
        if self.ttl_ms is not None:
            return BlockResult(_ttl_scan(df, self.key, self.clock, self.order, self.ttl_ms, None))
        k, n = unused(df, "_key", "_n")
        w = Window.partitionBy(k).orderBy(*self.order)
        return BlockResult(df.withColumn(k, self.key).withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).drop(k, n))


@dataclass(frozen=True)
class ChangeSuppressor:
    """Drops rows whose payload, less the excluded top-level fields, equals the key's last passed one."""

    key: Column
    payload: str = "payload_json"
    excluded: tuple[str, ...] = ()
    ttl_ms: int | None = None
    with_operation: bool = False
    clock: str = "event_time"
    order: tuple[str, ...] = ORDER

    def _hash(self) -> Column:
        h = jsonx.fingerprint(self.payload, self.excluded)
        return F.xxhash64(h, F.col("operation")) if self.with_operation else h

    def apply(self, df: DataFrame) -> BlockResult:
        if df.isStreaming:
            from ..streaming.processors import suppress_stream

            return BlockResult(suppress_stream(df, self.key, self._hash(), self.ttl_ms))
        if self.ttl_ms is not None:
            return BlockResult(_ttl_scan(df, self.key, self.clock, self.order, self.ttl_ms, self._hash()))
        k, h, prev, n = unused(df, "_key", "_h", "_prev", "_n")
        w = Window.partitionBy(k).orderBy(*self.order)
        rows = df.select("*", self.key.alias(k), self._hash().alias(h))
        rows = rows.withColumn(prev, F.lag(h).over(w)).withColumn(n, F.row_number().over(w))
        return BlockResult(rows.where((F.col(n) == 1) | (F.col(prev) != F.col(h))).drop(k, h, prev, n))


def _counted(rows: DataFrame, op: str, name: str) -> tuple[DataFrame, dict]:
    bad = F.col("_violations").isNotNull()
    rows, o = metrics.observed(rows, op, name, {metrics.key(op, "pass"): ~bad, metrics.key(op, "violation"): bad})
    return rows, {f"{op}.{name}": o}


@dataclass(frozen=True)
class SchemaVersion:
    """Required fields with types, optional names, and whether others are violations."""

    required: dict[str, str] = field(default_factory=dict)
    optional: tuple[str, ...] = ()
    strict: bool = False

    def __post_init__(self):
        if unknown := set(self.required.values()) - jsonx.TYPES.keys():
            raise ValueError(f"unknown field types: {sorted(unknown)}")

    @staticmethod
    def _said(t: Column, name: str, kind: str) -> Column:
        missing = t.isNull() | (t == "VOID")
        wrong = ~t.isin(*jsonx.TYPES[kind]) if jsonx.TYPES[kind] else F.lit(False)
        return F.when(missing, f"missing required field: {name}").when(wrong, F.concat(F.lit(f"{name} expected {kind} but got "), t))

    def violations(self, p: Column, json: str = "payload_json") -> Column:
        """Array of messages, empty if the payload conforms."""
        out = []
        for name, kind in self.required.items():
            out.append(bound(jsonx.type_of(p, name), lambda t, name=name, kind=kind: self._said(t, name, kind)))
        found = F.array_compact(F.array(*out)) if out else F.expr("cast(array() as array<string>)")
        if self.strict:
            declared = F.array(*[F.lit(n) for n in (*self.required, *self.optional)]) if self.required or self.optional else F.expr("cast(array() as array<string>)")
            unknown = F.array_except(F.coalesce(jsonx.keys(json), F.expr("cast(array() as array<string>)")), declared)
            found = F.concat(found, F.transform(unknown, lambda k: F.concat(F.lit("unknown field: "), k)))
        no_object = jsonx.keys(json).isNull()
        return F.when(no_object, F.array(F.lit("payload is null"))).otherwise(found)


@dataclass(frozen=True)
class SchemaEnforcer:
    """Rows pass if any version has no violations, the newest tried first; others are dead letters."""

    versions: tuple[SchemaVersion, ...]
    payload: str = "payload_json"
    name: str = "SchemaEnforcer"
    counted: bool = False

    def __post_init__(self):
        if not self.versions:
            raise ValueError("at least one schema version is required")

    def checked(self, df: DataFrame) -> DataFrame:
        """Adds ``_violations``: null where a version passes, else all messages, newest version first."""
        newest = range(len(self.versions), 0, -1)

        def told(found: Column) -> Column:
            said = [F.concat(F.lit(f"[v{v}] "), F.array_join(found[i], ", ")) for i, v in enumerate(newest)]
            return F.when(~F.exists(found, lambda x: F.size(x) == 0), F.concat_ws("; ", *said))

        every = lambda p: F.array(*[self.versions[v - 1].violations(p, self.payload) for v in newest])
        return df.withColumn("_violations", bound(bound(jsonx.payload(self.payload), every), told))

    def apply(self, df: DataFrame) -> BlockResult:
        rows, seen = _counted(self.checked(df), "schema", self.name) if self.counted else (self.checked(df), {})
        bad = rows.where("_violations is not null")
        return BlockResult(rows.where("_violations is null").drop("_violations"), model.dead_letters(bad, model.SCHEMA_VIOLATION, F.col("_violations"), self.name, model.to_json(df)), observations=seen)


@dataclass(frozen=True)
class NotNullRule:
    field: str

    def violation(self, p: Column, json: str) -> Column:
        t = jsonx.type_of(p, self.field)
        return F.when(t.isNull() | (t == "VOID"), f"{self.field} must not be null")


@dataclass(frozen=True)
class RangeRule:
    field: str
    low: float
    high: float

    def violation(self, p: Column, json: str) -> Column:
        v = jsonx.get(p, self.field, "double")
        number = jsonx.is_number(p, self.field)
        return F.when(~jsonx.has(self.field, json), None).when(~number, f"{self.field} is not a number").when(~v.between(self.low, self.high), f"{self.field} must be between {self.low} and {self.high}")


@dataclass(frozen=True)
class FormatRule:
    """The whole text must match; absent and null fields are skipped."""

    field: str
    pattern: str

    # The two patterns, which messages quote.
    @classmethod
    def email(cls, field: str) -> FormatRule:
        return cls(field, r"^[\w.-]+@[\w.-]+\.[a-zA-Z]{2,}$")

    @classmethod
    def date(cls, field: str) -> FormatRule:
        return cls(field, r"^\d{4}-\d{2}-\d{2}$")

    def violation(self, p: Column, json: str) -> Column:
        t = jsonx.text(p, self.field)
        return F.when(t.isNotNull() & ~t.rlike(rf"\A(?:{self.pattern})\z"), f"{self.field} does not match format: {self.pattern}")


@dataclass(frozen=True)
class ConstraintEnforcer:
    """All rules are evaluated; a row with any violation is dropped to the dead letters."""

    rules: tuple[NotNullRule | RangeRule | FormatRule, ...]
    payload: str = "payload_json"
    name: str = "ConstraintEnforcer"
    counted: bool = False

    def __post_init__(self):
        if not self.rules:
            raise ValueError("at least one rule is required")

    def checked(self, df: DataFrame) -> DataFrame:
        p = F.when(jsonx.keys(self.payload).isNotNull(), jsonx.payload(self.payload))
        found = bound(p, lambda p: F.array_compact(F.array(*[r.violation(p, self.payload) for r in self.rules])))
        return df.withColumn("_violations", bound(found, lambda x: F.when(F.size(x) > 0, F.array_join(x, "; "))))

    def apply(self, df: DataFrame) -> BlockResult:
        rows, seen = _counted(self.checked(df), "constraint", self.name) if self.counted else (self.checked(df), {})
        bad = rows.where("_violations is not null")
        return BlockResult(rows.where("_violations is null").drop("_violations"), model.dead_letters(bad, model.CONSTRAINT_VIOLATION, F.col("_violations"), self.name, model.to_json(df)), observations=seen)
