"""Metric names and counters collected with ``DataFrame.observe``.

A metric is named ``<operator>.<what>_count``; scopes are the connector names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# The names of all counters.
NAMES = (
    "parser.success_count",
    "parser.error_count",
    "processor.success_count",
    "processor.error_count",
    "sink.success_count",
    "sink.error_count",
    "dlq.published_count",
    "dlq.failed_count",
    "source.read_count",
    "source.error_count",
    "filter.pass_count",
    "filter.drop_count",
    "constraint.pass_count",
    "constraint.violation_count",
    "dedup.pass_count",
    "dedup.duplicate_count",
    "latency.alert_count",
    "flow.disruption_count",
    "flow.recovery_count",
    "observer.total_events",
    "decorator.event_count",
    "merger.pass_count",
    "merger.suppressed_count",
    "schema.pass_count",
    "schema.violation_count",
    "splitter.unmatched_count",
    "fanin.merged_count",
    "joiner.match_count",
    "joiner.miss_count",
    "joiner.ref_update_count",
    "dynamic_joiner.match_count",
    "dynamic_joiner.left_pass_count",
    "dynamic_joiner.right_pass_count",
    "dynamic_joiner.expire_count",
    "session.closed_count",
    "materializer.insert_count",
    "materializer.update_count",
    "materializer.delete_count",
    "cdc.read_count",
    "cdc.reconnect_count",
    "cdc.checkpoint_count",
)
OBSERVER_TOTAL = "observer.total_events"
SCOPES = ("kafka", "mongo", "cdc")


def key(operator: str, outcome: str) -> str:
    name = f"{operator}.{outcome}_count"
    if name not in NAMES:
        raise ValueError(f"unknown metric {name}")
    return name


def route_key(route: str) -> str:
    return f"splitter.route.{route}_count"


def catalogue() -> list[str]:
    return list(NAMES)


def observed(df: DataFrame, scope: str, operator: str, counts: dict[str, Column], gauges: dict[str, Column] | None = None) -> tuple[DataFrame, Observation | str]:
    """The same rows with conditional counters and aggregates; batch results come from the Observation, streaming ones by listener."""
    name = f"{scope}.{operator}"
    cols = [F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in counts.items()]
    cols += [c.alias(k) for k, c in (gauges or {}).items()]
    if df.isStreaming:
        return df.observe(name, *cols), name
    o = Observation(name)
    return df.observe(o, *cols), o


def counted(df: DataFrame, operator: str, outcomes: dict[str, Column], on: bool) -> tuple[DataFrame, dict]:
    """The rows with a block's own counters, and its observations; as they are, unless asked for."""
    if not on:
        return df, {}
    df, o = observed(df, operator, operator, {key(operator, k): c for k, c in outcomes.items()})
    return df, {operator: o}
