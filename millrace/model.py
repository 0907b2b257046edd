"""Record schemas and constants shared by all blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, TS, I, L = T.StringType(), T.TimestampType(), T.IntegerType(), T.LongType()

ENVELOPE = T.StructType(
    [
        T.StructField("operation", S),
        T.StructField("source", S),
        T.StructField("payload_json", S),
        T.StructField("event_time", TS),
        T.StructField("event_seq", L),
        T.StructField("processed_time", TS),
        T.StructField("trace_id", S),
        T.StructField("primary_key", S),
        T.StructField("metadata", T.MapType(S, S)),
    ]
)
DLQ = T.StructType([T.StructField(n, TS if n == "timestamp" else S) for n in ("error_type", "error_message", "source", "timestamp", "raw_event", "stacktrace")])
CHANGELOG = T.StructType([T.StructField("change_type", S), T.StructField("key", S), T.StructField("before", ENVELOPE), T.StructField("after", ENVELOPE), T.StructField("timestamp", TS)])
CDC_DOC = T.StructType(
    [
        *[T.StructField(n, S) for n in ("op", "db", "collection", "document_key", "full_document", "update_description")],
        T.StructField("cluster_time", T.StructType([T.StructField("sec", L), T.StructField("inc", I)])),
    ]
)
FIELDS = tuple(f.name for f in ENVELOPE)

# Error codes of dead letters.
PARSING_ERROR = "PARSING_ERROR"
PROCESSING_ERROR = "PROCESSING_ERROR"
SINK_ERROR = "SINK_ERROR"
CONSTRAINT_VIOLATION = "CONSTRAINT_VIOLATION"
SCHEMA_VIOLATION = "SCHEMA_VIOLATION"
SOURCE_PARSING_ERROR = "SOURCE_PARSING_ERROR"


def envelope(operation: Column, source: Column, payload: Column | None = None, key: Column | None = None) -> list[Column]:
    """Columns of a new envelope stamped now; operation and source must not be null."""
    checked = lambda c, n: F.coalesce(c, F.raise_error(F.lit(f"{n} must not be null")).cast("string"))
    now = F.current_timestamp()
    values = {
        "operation": checked(operation, "operation"),
        "source": checked(source, "source"),
        "payload_json": payload,
        "event_time": now,
        "processed_time": now,
        "primary_key": key,
        "metadata": F.expr("cast(map() as map<string,string>)"),
    }
    return [(v if (v := values.get(f.name)) is not None else F.lit(None)).cast(f.dataType).alias(f.name) for f in ENVELOPE]


def conform(df: DataFrame) -> DataFrame:
    """Selects the envelope's columns in order; missing ones are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in ENVELOPE])


def dead_letters(df: DataFrame, error_type: str, message: Column, source: str, raw: Column, at: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(error_type).alias("error_type"),
        message.alias("error_message"),
        F.lit(source).alias("source"),
        (at if at is not None else F.current_timestamp()).alias("timestamp"),
        raw.alias("raw_event"),
        F.lit(None).cast("string").alias("stacktrace"),
    )


def envelope_from_events(events: DataFrame) -> DataFrame:
    """The ``events`` table as envelopes: the type is the operation, the user the key, props the payload."""
    t = F.col("event_type")
    return conform(
        events.select(
            t.alias("operation"),
            F.when(t == "purchase", "payments").when(t == "signup", "orders").otherwise(t).alias("source"),
            F.col("props").alias("payload_json"),
            F.col("ts").cast("timestamp").alias("event_time"),
            F.col("event_id").alias("event_seq"),
            F.concat(F.lit("trace-"), F.col("event_id").cast("string")).alias("trace_id"),
            F.col("user_id").cast("string").alias("primary_key"),
            F.expr("cast(map() as map<string,string>)").alias("metadata"),
        )
    )


def to_json(df: DataFrame) -> Column:
    """An envelope row as JSON text; ISO-8601 times, absent fields left out."""
    return F.to_json(F.struct(*[F.col(f) for f in FIELDS if f in df.columns]), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
