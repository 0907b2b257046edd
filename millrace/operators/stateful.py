"""Latest-value materialisation and event-time sessions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import metrics, model
from ..pipeline import BlockResult

ORDER = ("event_time", "event_seq")


@dataclass(frozen=True)
class Materializer:
    """A key's rows as a changelog of its latest value.

    A row for which ``delete`` holds gives DELETE (before may be null); else a key without
    a live value gives INSERT, with one UPDATE, even if nothing changed.  A value expires
    at ``ttl_ms`` after its last write.  ``merge(acc, new)`` combines the envelope structs;
    the default replaces.  Rows without a key are passed over.  A stream's state is folded
    row by row, so there ``row_merge(acc, new)`` does the same on rows as dicts of their JSON
    values; a stream with ``merge`` alone is refused.
    """

    key: str = "primary_key"
    ttl_ms: int | None = None
    delete: Column | None = None
    merge: Callable[[Column, Column], Column] | None = None
    row_merge: Callable[[dict, dict], dict] | None = None
    clock: str = "event_time"
    order: tuple[str, ...] = ORDER
    counted: bool = False

    def apply(self, df: DataFrame) -> BlockResult:
        out, seen = metrics.counted(self._changes(df), "materializer", {k.lower(): F.col("change_type") == k for k in ("INSERT", "UPDATE", "DELETE")}, self.counted)
        return BlockResult(out, observations=seen)

    def _changes(self, df: DataFrame) -> DataFrame:
        if df.isStreaming:
            from ..streaming.processors import materialize_stream

            if self.merge and not self.row_merge:
                raise ValueError("a stream needs row_merge beside merge")
            return materialize_stream(df, F.col(self.key), self.delete, self.ttl_ms, self.row_merge)
        if self.row_merge and not self.merge:
            raise ValueError("a bounded table needs merge beside row_merge")
        return self._merged(df) if self.merge else self._replaced(df)

    def _rows(self, df: DataFrame) -> DataFrame:
        gone = F.coalesce(self.delete, F.lit(False)) if self.delete is not None else F.lit(False)
        return df.where(F.col(self.key).isNotNull()).withColumn("_del", gone).withColumn("_t", F.unix_micros(F.col(self.clock).cast("timestamp")))

    def _replaced(self, df: DataFrame) -> DataFrame:
        w = Window.partitionBy(self.key).orderBy(*self.order)
        env = F.struct(*[F.col(c) for c in df.columns])
        rows = self._rows(df).withColumn("_env", env)
        rows = rows.withColumn("_prev", F.lag(F.struct("_env", "_del", "_t")).over(w))
        expired = F.col("_t") - F.col("_prev._t") >= 1000 * self.ttl_ms if self.ttl_ms is not None else F.lit(False)
        live = F.col("_prev").isNotNull() & ~F.col("_prev._del") & ~expired
        before = F.when(live, F.col("_prev._env"))
        kind = F.when(F.col("_del"), "DELETE").when(live, "UPDATE").otherwise("INSERT")
        return rows.select(kind.alias("change_type"), F.col(self.key).alias("key"), before.alias("before"), F.when(~F.col("_del"), F.col("_env")).alias("after"), self._at().alias("timestamp"))

    def _at(self) -> Column:
        return F.coalesce(F.col(self.clock).cast("timestamp"), F.timestamp_millis(F.lit(0)))

    def _merged(self, df: DataFrame) -> DataFrame:
        """A custom merge folds a key's rows in order.

        A value lives from one delete or expiry to the next, so a key's rows are cut into
        such lives first and each life is folded on its own.
        """
        cols = df.columns
        env = F.struct(*[F.col(c) for c in cols])
        item = F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(self.order)], env.alias("env"), F.col("_del").alias("del"), F.col("_t").alias("t"), self._at().alias("at"))
        w = Window.partitionBy(self.key).orderBy(*self.order)
        fresh = F.coalesce(F.lag("_del").over(w), F.lit(False))
        if self.ttl_ms is not None:
            fresh = fresh | F.coalesce(F.col("_t") - F.lag("_t").over(w) >= 1000 * self.ttl_ms, F.lit(False))
        lives = self._rows(df).withColumn("_life", fresh.cast("int")).withColumn("_life", F.sum("_life").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        names = [f"_o{i}" for i in range(len(self.order))]
        key_of = lambda x: F.struct(*[x[n] for n in names])
        compare = lambda a, b: F.when(key_of(a) < key_of(b), -1).when(key_of(a) > key_of(b), 1).otherwise(0)
        grouped = lives.groupBy(F.col(self.key).alias("key"), "_life").agg(F.array_sort(F.collect_list(item), compare).alias("items"))
        out_type = model.T.StructType([model.T.StructField("change_type", model.S), model.T.StructField("before", df.schema), model.T.StructField("after", df.schema), model.T.StructField("timestamp", model.TS)])
        none = F.lit(None).cast(df.schema)
        init = F.struct(none.alias("value"), F.lit(None).cast("long").alias("t"), F.lit(None).cast(model.T.ArrayType(out_type)).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            live = acc["value"].isNotNull()
            if self.ttl_ms is not None:
                live = live & (x["t"] - acc["t"] < 1000 * self.ttl_ms)
            before = F.when(live, acc["value"])
            after = F.when(~x["del"], F.when(live, self.merge(acc["value"], x["env"])).otherwise(x["env"]))
            kind = F.when(x["del"], "DELETE").when(live, "UPDATE").otherwise("INSERT")
            row = F.struct(kind.alias("change_type"), before.alias("before"), after.alias("after"), x["at"].alias("timestamp")).cast(out_type)
            out = F.concat(F.coalesce(acc["out"], F.array().cast(model.T.ArrayType(out_type))), F.array(row))
            return F.struct(after.cast(df.schema).alias("value"), x["t"].alias("t"), out.alias("out"))

        folded = grouped.select("key", F.explode(F.aggregate("items", init, step)["out"]).alias("c"))
        return folded.select("c.change_type", "key", "c.before", "c.after", "c.timestamp")


def current_state(df: DataFrame, key: str = "primary_key", delete: Column | None = None, order: tuple[str, ...] = ORDER) -> DataFrame:
    """The latest row of each key, without keys whose latest row deletes."""
    cols = df.columns
    gone = F.coalesce(delete, F.lit(False)) if delete is not None else F.lit(False)
    rows = df.where(F.col(key).isNotNull()).withColumn("_del", gone).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])))
    return rows.where("_n = 1 and not _del").select(*cols)


@dataclass(frozen=True)
class SessionAnalyzer:
    """Event-time sessions per key: rows at most ``gap_ms`` apart are one; the end is the last row plus the gap.

    ``result`` aggregates a session's rows.  Streaming: the watermark is the out-of-order
    bound plus the allowed lateness, so a session fires once, after both; later rows are
    dropped and counted by the engine.
    """

    key: str = "primary_key"
    time: str = "event_time"
    gap_ms: int = 1_800_000
    result: Column | None = None
    out_of_order_ms: int = 0
    lateness_ms: int = 0
    counted: bool = False

    def __post_init__(self):
        if not self.key or not self.time:
            raise ValueError("key and time are required")
        if self.gap_ms <= 0:
            raise ValueError("gap must be positive")
        if self.out_of_order_ms < 0 or self.lateness_ms < 0:
            raise ValueError("out-of-order bound and lateness must not be negative")

    def apply(self, df: DataFrame) -> BlockResult:
        if df.isStreaming:
            df = df.withWatermark(self.time, f"{self.out_of_order_ms + self.lateness_ms} milliseconds")
        df = df.where(F.col(self.key).isNotNull() & F.col(self.time).isNotNull())
        s = df.groupBy(F.col(self.key).alias("key"), F.session_window(self.time, f"{self.gap_ms} milliseconds").alias("w"))
        out = s.agg(F.count("*").cast("int").alias("event_count"), (self.result if self.result is not None else F.lit(None).cast("string")).alias("result"))
        ms = ((F.unix_micros(F.col("w.end").cast("timestamp")) - F.unix_micros(F.col("w.start").cast("timestamp"))) / 1000).cast("long")
        out = out.select("key", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "event_count", (F.col("w.end") - F.col("w.start")).alias("duration"), ms.alias("duration_ms"), "result")
        out, seen = metrics.counted(out, "session", {"closed": F.lit(True)}, self.counted)
        return BlockResult(out, observations=seen)


def actions_result(operation: str = "operation", time: str = "event_time", seq: str = "event_seq") -> Column:
    """A session's operations joined by commas, in event order, and their count, as JSON text."""
    ops = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(time), F.col(seq), F.col(operation).alias("op")))), lambda x: x["op"]), ",")
    return F.to_json(F.struct(ops.alias("actions"), F.count("*").alias("count")))
