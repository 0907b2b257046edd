"""Parsers, processors and projections between raw text, envelopes and results."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import metrics, model
from ..functions import jsonx
from ..functions.columns import bound, unused
from ..pipeline import BlockResult

#: Envelope fields as their names in JSON text.
JSON_NAMES = {"operation": "operation", "source": "source", "payload_json": "payloadJson", "trace_id": "traceId", "primary_key": "primaryKey"}


@dataclass(frozen=True)
class EnvelopeParser:
    """JSON text to envelopes.

    Text that is null or not ``{...}`` after trimming is passed over; text that is not
    valid JSON, or holds a non-text where text belongs, becomes a dead letter.  Incoming
    metadata is dropped unless ``keep_metadata``.  A missing event time is now.
    """

    column: str = "value"
    keep_metadata: bool = False
    seq: Column | None = None
    counted: bool = False

    def apply(self, df: DataFrame) -> BlockResult:
        raw = F.col(self.column)
        t = F.trim(raw)
        now, empty = F.current_timestamp(), F.expr("cast(map() as map<string,string>)")

        def fields(p: Column, when: Column) -> Column:
            """One struct of all that a text holds, and whether it is malformed."""
            nested = [jsonx.get(p, n, kind).isNotNull() for n in JSON_NAMES.values() for kind in ("array<variant>", "map<string,variant>")]
            bad = p.isNull() | (when.isNotNull() & when.try_cast("timestamp").isNull()) | reduce(or_, nested)
            got = {k: jsonx.text(p, n) for k, n in JSON_NAMES.items()}
            got["event_time"] = when.try_cast("timestamp")
            got["event_seq"] = F.try_variant_get(p, "$.eventSeq", "bigint")
            if self.keep_metadata:
                got["metadata"] = F.try_variant_get(p, "$.metadata", "map<string,string>")
            return F.struct(F.coalesce(bad, F.lit(True)).alias("bad"), *[v.alias(k) for k, v in got.items()])

        parsed = F.transform(F.array(F.try_parse_json(raw)), lambda p: bound(jsonx.text(p, "eventTime"), lambda w: fields(p, w)))
        # a generated row is not folded into the filters after it, so each text is parsed once
        got, = unused(df, "_got")
        rows = df.where(t.startswith("{") & t.endswith("}")).select("*", F.explode(parsed).alias(got))
        r = F.col(got)
        rows, seen = metrics.counted(rows, "parser", {"success": ~r["bad"], "error": r["bad"]}, self.counted)
        values = {k: r[k] for k in JSON_NAMES}
        values |= {
            "event_time": F.coalesce(r["event_time"], now),
            "event_seq": self.seq if self.seq is not None else r["event_seq"],
            "processed_time": now,
            "metadata": F.coalesce(r["metadata"], empty) if self.keep_metadata else empty,
        }
        good = rows.where(~r["bad"]).select(*[values[f.name].cast(f.dataType).alias(f.name) for f in model.ENVELOPE])
        dlq = model.dead_letters(rows.where(r["bad"]), model.PARSING_ERROR, F.lit("malformed envelope"), "EnvelopeParser", raw)
        return BlockResult(good, dlq, observations=seen)


def _merged(a: Column, b: Column) -> Column:
    """Object text with b's fields over a's."""
    as_map = lambda c: F.try_variant_get(F.try_parse_json(c), "$", "map<string,variant>")
    left = F.map_filter(as_map(a), lambda k, _: ~F.coalesce(F.map_contains_key(as_map(b), k), F.lit(False)))
    return F.to_json(F.map_concat(left, as_map(b)))


@dataclass(frozen=True)
class CdcParser:
    """Change documents (op, full_document, document_key, update_description as JSON text, cluster_time) to envelopes.

    Inserts carry the document; updates the document or else the updated fields, with the
    document key laid over; deletes the document key.  The key is the payload's ``_id``.
    A change without an operation is a dead letter.  The ordinal within a second becomes
    ``event_seq``, as timestamps hold no nanoseconds.
    """

    source_name: str = "CdcParser"

    def apply(self, df: DataFrame) -> BlockResult:
        for c in ("after", "operationType", "collection", "update_description"):
            if c not in df.columns:
                df = df.withColumn(c, F.lit(None).cast("string"))
        said = F.lower(F.coalesce("op", "operationType"))
        op = F.when(said.isin("c", "insert"), "insert").when(said.isin("u", "update", "replace"), "update").when(said.isin("d", "delete"), "delete").otherwise("unknown")
        doc = F.coalesce("after", "full_document")
        updated = F.to_json(F.try_variant_get(F.try_parse_json("update_description"), "$.updatedFields", "variant"))
        changed = F.coalesce(doc, updated)
        payload = F.when(op == "delete", F.col("document_key")).when(op == "update", F.when(changed.isNull(), F.col("document_key")).when(F.col("document_key").isNull(), changed).otherwise(_merged(changed, F.col("document_key")))).otherwise(doc)
        rows = df.withColumn("_op", op).withColumn("_said", said).withColumn("_payload", payload)
        time = F.coalesce(F.timestamp_seconds("cluster_time.sec"), F.current_timestamp()) if "cluster_time" in df.columns else F.current_timestamp()
        seq = F.col("cluster_time.inc") if "cluster_time" in df.columns else F.lit(None)
        fields = {
            "operation": F.col("_op"),
            "source": F.coalesce("collection", F.lit("unknown")),
            "payload_json": F.col("_payload"),
            "event_time": time,
            "event_seq": seq,
            "primary_key": jsonx.text(F.try_parse_json("_payload"), "_id"),
            "metadata": F.expr("cast(map() as map<string,string>)"),
        }
        good = rows.where("_said is not null").select(*[(v if (v := fields.get(f.name)) is not None else F.lit(None)).cast(f.dataType).alias(f.name) for f in model.ENVELOPE])
        raw = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
        return BlockResult(good, model.dead_letters(rows.where("_said is null"), model.PARSING_ERROR, F.lit("change without an operation"), self.source_name, raw))


def with_trace_id(df: DataFrame) -> DataFrame:
    """A random trace id where none is set; non-deterministic by nature."""
    return df.withColumn("trace_id", F.when(F.coalesce(F.length("trace_id"), F.lit(0)) == 0, F.concat(F.lit("trace-"), F.uuid())).otherwise(F.col("trace_id")))


@dataclass(frozen=True)
class Processor:
    """Stamps the processing time and a trace id; ``strict`` sends rows without an operation to the dead letters."""

    name: str = "Processor"
    strict: bool = False
    counted: bool = False

    def apply(self, df: DataFrame) -> BlockResult:
        none = F.col("operation").isNull() & F.col("payload_json").isNull() & F.col("source").isNull()
        df, seen = metrics.counted(df, "processor", {"success": ~none, "error": none}, self.counted)
        main = with_trace_id(df.where(~none).withColumn("processed_time", F.current_timestamp()))
        dlq = model.dead_letters(df.where(none), model.PROCESSING_ERROR, F.lit("null input"), self.name, model.to_json(df)) if self.strict else None
        return BlockResult(main, dlq, observations=seen)


@dataclass(frozen=True)
class FilterInterceptor:
    """Keeps rows for which the condition is true; a null condition drops.

    ``counted`` adds pass and drop counters; without them the filter reaches the scan.
    """

    condition: Column
    counted: bool = False

    def apply(self, df: DataFrame) -> BlockResult:
        keep, seen = F.coalesce(self.condition, F.lit(False)), {}
        if self.counted:
            df, o = metrics.observed(df, "filter", "filter", {metrics.key("filter", "pass"): keep, metrics.key("filter", "drop"): ~keep})
            seen = {"filter": o}
        return BlockResult(df.where(keep), observations=seen)


def differs(col: str, value: str) -> Column:
    """Null-safe inequality: a null differs from any value."""
    return ~F.col(col).eqNullSafe(F.lit(value))


def changelog_to_envelope(df: DataFrame) -> DataFrame:
    """Changelog rows as envelopes; before and after hold the payloads and are left out where null."""
    part = lambda c: F.try_parse_json(F.col(f"{c}.payload_json"))
    payload = F.to_json(F.struct(F.col("key").alias("_id"), F.col("change_type").alias("changeType"), part("after").alias("after"), part("before").alias("before")))
    return model.conform(
        df.select(
            F.concat(F.lit("CHANGELOG_"), "change_type").alias("operation"),
            F.lit("materializer").alias("source"),
            payload.alias("payload_json"),
            F.col("timestamp").alias("event_time"),
            F.coalesce("after.event_seq", "before.event_seq").alias("event_seq") if "event_seq" not in df.columns else F.col("event_seq"),
            F.current_timestamp().alias("processed_time"),
            F.col("key").alias("primary_key"),
            F.create_map(F.lit("changeType"), F.col("change_type"), F.lit("materializedKey"), F.col("key")).alias("metadata"),
        )
    )


def iso_duration(ms: Column) -> Column:
    """ISO-8601 text of a duration in milliseconds: PT8H6M12.345S, PT0S."""
    h, m, s = F.floor(ms / 3600000), F.floor(ms / 60000) % 60, (ms % 60000) / 1000
    sec = F.regexp_replace(F.format_string("%.3f", s), r"\.?0+$", "")
    return F.when(ms == 0, "PT0S").otherwise(F.concat(F.lit("PT"), F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(""), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(""), F.when(s > 0, F.concat(sec, F.lit("S"))).otherwise("")))


def session_to_envelope(df: DataFrame) -> DataFrame:
    """Closed sessions as envelopes: the result's fields plus ``_id`` are the payload."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    entries = F.map_concat(F.try_variant_get(F.try_parse_json("result"), "$", "map<string,variant>"), F.create_map(F.lit("_id"), F.col("key").cast("variant")))
    meta = F.create_map(F.lit("sessionStart"), iso("session_start"), F.lit("sessionEnd"), iso("session_end"), F.lit("eventCount"), F.col("event_count").cast("string"), F.lit("duration"), iso_duration(F.col("duration_ms")))
    return model.conform(
        df.select(
            F.lit("SESSION_CLOSED").alias("operation"),
            F.lit("session-analyzer").alias("source"),
            F.to_json(entries).alias("payload_json"),
            F.col("session_start").alias("event_time"),
            F.current_timestamp().alias("processed_time"),
            F.lit("_id").alias("primary_key"),
            meta.alias("metadata"),
        )
    )
