"""Joins of two event streams and enrichment by reference data."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import maps

HOW = {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "FULL_OUTER": "full"}


@dataclass(frozen=True)
class DynamicJoiner:
    """Equi-join of two keyed streams whose rows meet within a TTL, many to many.

    A row waits for partners strictly less than ``ttl_ms``, counted between the two
    clocks.  Rows without a key are passed over, on outer sides too.  Columns of the
    right side get ``right_prefix``.  Streaming frames must carry watermarks.
    """

    left_key: str
    right_key: str
    how: str = "INNER"
    ttl_ms: int = 600_000
    left_clock: str = "event_time"
    right_clock: str = "event_time"
    right_prefix: str = "r_"

    def __post_init__(self):
        if not self.left_key or not self.right_key:
            raise ValueError("left_key and right_key are required")
        if self.how not in HOW:
            raise ValueError(f"how must be one of {sorted(HOW)}")
        if self.ttl_ms <= 0:
            raise ValueError("ttl must be positive")

    def __call__(self, left: DataFrame, right: DataFrame) -> DataFrame:
        p = self.right_prefix
        right = right.select(*[F.col(f"`{c}`").alias(p + c) for c in right.columns]).where(F.col(p + self.right_key).isNotNull())
        left = left.where(F.col(self.left_key).isNotNull())
        lt, rt = F.col(self.left_clock), F.col(p + self.right_clock)
        gap = F.expr(f"INTERVAL {int(self.ttl_ms)} MILLISECONDS")  # a literal, as streaming joins ask for
        near = (rt > lt - gap) & (rt < lt + gap)
        return left.join(right, (F.col(self.left_key) == F.col(p + self.right_key)) & near, HOW[self.how])


def latest_per_key(ref: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key; rows without a key go."""
    cols = [c for c in ref.columns if c != key]
    best = F.max(F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], *cols)).alias("_r")
    return ref.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


@dataclass(frozen=True)
class StaticJoiner:
    """Looks main rows up in reference data, latest row per key; misses and null keys pass with nulls.

    The reference's size decides between broadcast and shuffle when the plan runs, so it
    may grow without harm.
    """

    main_key: str
    ref_key: str
    order: tuple[str, ...] = ()
    prefix: str = "ref_"

    def __post_init__(self):
        if not self.main_key or not self.ref_key:
            raise ValueError("main_key and ref_key are required")

    def __call__(self, main: DataFrame, ref: DataFrame) -> DataFrame:
        if self.order:
            ref = latest_per_key(ref, self.ref_key, *self.order)
        ref = ref.where(F.col(self.ref_key).isNotNull()).select(*[F.col(f"`{c}`").alias(self.prefix + c) for c in ref.columns])
        return main.join(ref, F.col(self.main_key) == F.col(self.prefix + self.ref_key), "left")


def static_join_as_metadata(main: DataFrame, ref: DataFrame, name: str, main_key: str = "primary_key", ref_key: str = "primary_key", value: str = "payload_json", order: tuple[str, ...] = ("event_time", "event_seq")) -> DataFrame:
    """Puts the matching reference payload into the metadata under ``name``; chain it for several references."""
    cols = main.columns
    hit = StaticJoiner(main_key, ref_key, order)(main, ref.select(ref_key, value, *[o for o in order if o not in (ref_key, value)]))
    v = F.col(f"ref_{value}")
    meta = F.when(F.col(f"ref_{ref_key}").isNotNull(), maps.put("metadata", {name: v})).otherwise(F.col("metadata"))
    return hit.withColumn("metadata", meta).select(*cols)


def as_of_join(main: DataFrame, ref: DataFrame, main_key: str, ref_key: str, main_time: str, ref_time: str, prefix: str = "ref_") -> DataFrame:
    """Each main row with its key's last reference row at or before its time.

    Union, then one sort per key that carries the last reference row along: no row is
    multiplied, and hot keys spill rather than explode.  Main rows without a key match
    nothing and take no part in the sort.
    """
    ref_cols, kinds = ref.columns, dict(ref.dtypes)
    m = main.where(F.col(main_key).isNotNull()).select(F.col(main_key).alias("_k"), F.col(main_time).alias("_t"), F.lit(1).alias("_side"), F.struct("*").alias("_m"))
    r = ref.where(F.col(ref_key).isNotNull()).select(F.col(ref_key).alias("_k"), F.col(ref_time).alias("_t"), F.lit(0).alias("_side"), F.struct("*").alias("_r"))
    w = Window.partitionBy("_k").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = m.unionByName(r, allowMissingColumns=True)
    out = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    out = out.select("_m.*", *[F.col(f"_r.{c}").alias(prefix + c) for c in ref_cols])
    return out.unionAll(main.where(F.col(main_key).isNull()).select("*", *[F.lit(None).cast(kinds[c]).alias(prefix + c) for c in ref_cols]))


JoinPattern = Callable[[DataFrame, DataFrame], DataFrame]


def payment_metadata(joined: DataFrame, left_cols: list[str], payload: Column, source: Column, matched: Column) -> DataFrame:
    """Order rows with their payment in the metadata, one row per pair; unmatched rows stay as they are."""
    meta = F.when(matched, maps.put("metadata", {"paymentPayload": payload, "paymentSource": source})).otherwise(F.col("metadata"))
    return joined.withColumn("metadata", meta).select(*left_cols)
