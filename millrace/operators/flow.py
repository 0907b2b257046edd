"""Routing of one stream to several and merging of several into one."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import metrics
from ..functions import maps
from ..pipeline import BlockResult


@dataclass(frozen=True)
class Route:
    name: str
    condition: Column

    def __post_init__(self):
        if not self.name or not self.name.strip():
            raise ValueError("a route needs a name")
        if self.condition is None:
            raise ValueError(f"route {self.name} needs a condition")


@dataclass
class ParallelSplitter:
    """Named routes. Exclusive: the first that matches takes the row, others stay on main.

    ``counted`` adds a counter per route and one for rows that no route took.
    With ``copy_to_main`` main gets every row and each matching route a copy.  A condition
    that is null does not match.  Adding a name again replaces its route.
    """

    copy_to_main: bool = False
    counted: bool = False
    routes: dict[str, Route] = field(default_factory=dict)
    _last: BlockResult | None = None

    def route(self, name: str, condition: Column) -> ParallelSplitter:
        r = Route(name, condition)
        self.routes[r.name] = r
        return self

    def tagged(self, df: DataFrame) -> DataFrame:
        """Exclusive mode's rows with their route's name, null on main."""
        if not self.routes:
            raise ValueError("at least one route is required")
        tag = F.lit(None).cast("string")
        for r in reversed(self.routes.values()):
            tag = F.when(F.coalesce(r.condition, F.lit(False)), r.name).otherwise(tag)
        return df.withColumn("_route", tag)

    def apply(self, df: DataFrame) -> BlockResult:
        if not self.routes:
            raise ValueError("at least one route is required")
        hit = {n: F.coalesce(r.condition, F.lit(False)) for n, r in self.routes.items()}
        t, seen = df if self.copy_to_main else self.tagged(df), {}
        if self.counted:
            counts = {n: c if self.copy_to_main else F.col("_route").eqNullSafe(F.lit(n)) for n, c in hit.items()}
            none = ~functools.reduce(operator.or_, hit.values()) if self.copy_to_main else F.col("_route").isNull()
            t, o = metrics.observed(t, "splitter", "splitter", {**{metrics.route_key(n): c for n, c in counts.items()}, metrics.key("splitter", "unmatched"): none})
            seen = {"splitter": o}
        if self.copy_to_main:
            self._last = BlockResult(t, sides={n: df.where(c) for n, c in hit.items()}, observations=seen)
        else:
            self._last = BlockResult(t.where("_route is null").drop("_route"), sides={n: t.where(F.col("_route") == n).drop("_route") for n in self.routes}, observations=seen)
        return self._last

    def side(self, name: str) -> DataFrame:
        if name not in self.routes:
            raise ValueError(f"unknown route {name}")
        if self._last is None:
            raise ValueError("apply the splitter before asking for its side outputs")
        return self._last.sides[name]


@dataclass
class WatermarkAlignedFanIn:
    """Union of two or more named sources, each with a watermark of ``max_drift``; no reorder, no dedup.

    The slowest source holds the joint watermark back (the session's policy is ``min``).
    """

    max_drift: str | None = None
    time: str = "event_time"
    tag: Callable[[DataFrame, str], DataFrame] | None = None
    sources: dict[str, DataFrame] = field(default_factory=dict)

    def source(self, name: str, df: DataFrame) -> WatermarkAlignedFanIn:
        if not name or not name.strip():
            raise ValueError("a source needs a name")
        if name in self.sources:
            raise ValueError(f"source {name} is named twice")
        self.sources[name] = df
        return self

    def merge(self) -> DataFrame:
        if len(self.sources) < 2:
            raise ValueError("at least two sources are required")
        if not self.max_drift:
            raise ValueError("max_drift is required")
        parts = []
        for name, df in self.sources.items():
            df = df.withWatermark(self.time, self.max_drift) if df.isStreaming else df
            parts.append(self.tag(df, name) if self.tag else df)
        return union(*parts)


def tag_metadata(key: str = "ingestSource") -> Callable[[DataFrame, str], DataFrame]:
    """Writes the source's name into the metadata."""

    def tag(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn("metadata", maps.put("metadata", {key: F.lit(name)}))

    return tag


def union(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """All rows of all frames, columns matched by name."""
    return functools.reduce(DataFrame.unionByName, rest, first)
