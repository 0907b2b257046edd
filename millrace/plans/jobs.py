"""The seven jobs, each a short composition of blocks; bounded or unbounded frames pass alike."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import enrich, flow, integrity, observe, parse, stateful
from ..pipeline import BlockResult, Pipeline

MINUTE, HOUR = 60_000, 3_600_000


@dataclass(frozen=True)
class Job:
    name: str
    build: Callable[..., BlockResult]


REGISTRY: dict[str, Job] = {}


def job(name: str) -> Callable:
    def register(fn: Callable) -> Callable:
        REGISTRY[name] = Job(name, fn)
        return fn

    return register


def _result(p: Pipeline) -> BlockResult:
    return BlockResult(p.df, p.dlq, p.sides, p.observations)


def dedup_key(time: str = "event_time") -> F.Column:
    """Primary key and event time; a missing part prints as null."""
    return F.concat_ws(":", F.coalesce("primary_key", F.lit("null")), F.coalesce(F.col(time).cast("string"), F.lit("null")), F.coalesce(F.col("event_seq").cast("string"), F.lit("null")))


@job("MongoToKafka")
def cdc_to_broker(changes: DataFrame, silence_ms: int = 5 * MINUTE, dedup_ms: int = 10 * MINUTE, latency_ms: int = 30_000, parsed: bool = False) -> BlockResult:
    """Changes to envelopes: silence watch, known operations, dedup, change suppression, schema, latency, checks, stage tag, trace."""
    p = Pipeline.source(changes)
    p = p if parsed else p.parse(parse.CdcParser())
    p = p.apply(observe.FlowDisruptionDetector("source", silence_ms))
    p = p.apply(parse.FilterInterceptor(parse.differs("operation", "unknown")))
    p = p.apply(integrity.Deduplicator(dedup_key(), dedup_ms))
    p = p.apply(integrity.ChangeSuppressor(F.col("primary_key"), excluded=("updatedAt", "modifiedAt"), ttl_ms=24 * HOUR, with_operation=True))
    p = p.apply(integrity.SchemaEnforcer((integrity.SchemaVersion({"_id": "ANY"}),)))
    p = p.apply(observe.LatencyDetector(latency_ms, scope="MongoToKafka"))
    p = p.apply(observe.OnlineObserver((observe.QualityCheck.is_null("payload_json"), observe.QualityCheck.is_null("primary_key")), scope="MongoToKafka"))
    p = p.apply(observe.MetadataDecorator("pre-sink")).apply(parse.Processor("CdcProcessor"))
    return _result(p)


@job("KafkaToMongo")
def broker_to_documents(envelopes: DataFrame, ref1: DataFrame | None = None, ref2: DataFrame | None = None) -> BlockResult:
    """Up to two reference lookups, a key in every payload, a trace."""
    p = Pipeline.source(envelopes)
    for name, ref in (("enrichedRef1", ref1), ("enrichedRef2", ref2)):
        if ref is not None:
            p = p.enrich(ref, lambda m, r, name=name: enrich.static_join_as_metadata(m, r, name))
    return _result(p.apply(integrity.ConstraintEnforcer((integrity.NotNullRule("_id"),))).apply(parse.Processor("DocumentProcessor", strict=True)))


@job("MergedIngest")
def merged_ingest(first: DataFrame, second: DataFrame, names: tuple[str, str] = ("orders", "payments"), max_drift: str = "5 seconds") -> BlockResult:
    """Two streams as one, each row tagged with its source."""
    f = flow.WatermarkAlignedFanIn(max_drift, tag=flow.tag_metadata("ingestSource"))
    return BlockResult(f.source(names[0], first).source(names[1], second).merge())


@job("OrderPaymentJoin")
def order_payments(orders: DataFrame, payments: DataFrame, ttl_ms: int = 10 * MINUTE) -> BlockResult:
    """Orders with their payments' payload and source in the metadata, one row per pair, unmatched orders too."""
    cols = orders.columns
    joined = enrich.DynamicJoiner("primary_key", "primary_key", "LEFT", ttl_ms, right_prefix="pay_")(orders, payments)
    return BlockResult(enrich.payment_metadata(joined, cols, F.col("pay_payload_json"), F.col("pay_source"), F.col("pay_primary_key").isNotNull()))


@job("UserStateMaterialize")
def user_state(envelopes: DataFrame, ttl_ms: int = 24 * HOUR, delete: F.Column | None = None) -> BlockResult:
    """The changelog of each key's latest state, as envelopes."""
    gone = delete if delete is not None else F.upper("operation").eqNullSafe(F.lit("DELETE"))
    p = Pipeline.source(envelopes).apply(stateful.Materializer(ttl_ms=ttl_ms, delete=gone)).process(parse.changelog_to_envelope)
    return _result(p)


@job("EventRouter")
def event_router(envelopes: DataFrame) -> BlockResult:
    """Orders and payments to routes of their own, the rest on main."""
    s = flow.ParallelSplitter().route("orders", F.col("source") == "orders").route("payments", F.col("source") == "payments")
    return s.apply(envelopes)


@job("UserSessionAnalysis")
def user_sessions(envelopes: DataFrame, gap_ms: int = 1_800_000) -> BlockResult:
    """Closed sessions as envelopes."""
    p = Pipeline.source(envelopes).apply(stateful.SessionAnalyzer(gap_ms=gap_ms, result=stateful.actions_result())).process(parse.session_to_envelope)
    return _result(p)
