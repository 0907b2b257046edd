"""The fluent pipeline: source, parse, blocks, enrichment, process, sink.

A block turns a DataFrame into a ``BlockResult``: the main rows, dead letters, named
side outputs and observations.  Blocks are lazy and hold for bounded and unbounded
frames alike; a pipeline gathers the dead letters of all its blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any, Protocol

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class BlockResult:
    main: DataFrame
    dlq: DataFrame | None = None
    sides: dict[str, DataFrame] = field(default_factory=dict)
    observations: dict[str, Any] = field(default_factory=dict)


class Block(Protocol):
    def apply(self, df: DataFrame) -> BlockResult: ...


@dataclass(frozen=True)
class Pipeline:
    df: DataFrame
    dead: tuple[DataFrame, ...] = ()
    sides: dict[str, DataFrame] = field(default_factory=dict)
    observations: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def source(cls, df: DataFrame) -> Pipeline:
        return cls(df)

    def _took(self, r: BlockResult | DataFrame) -> Pipeline:
        if isinstance(r, DataFrame):
            return replace(self, df=r)
        if clash := self.sides.keys() & r.sides.keys():
            raise ValueError(f"side outputs named twice: {sorted(clash)}")
        return replace(self, df=r.main, dead=(*self.dead, r.dlq) if r.dlq is not None else self.dead, sides={**self.sides, **r.sides}, observations={**self.observations, **r.observations})

    def parse(self, parser: Block) -> Pipeline:
        return self._took(parser.apply(self.df))

    def apply(self, block: Block) -> Pipeline:
        return self._took(block.apply(self.df))

    def enrich(self, other: DataFrame, join: Callable[[DataFrame, DataFrame], DataFrame | BlockResult]) -> Pipeline:
        return self._took(join(self.df, other))

    def process(self, fn: Callable[[DataFrame], DataFrame | BlockResult]) -> Pipeline:
        return self._took(fn(self.df))

    def to(self, sink: Callable[[DataFrame], Any]) -> Any:
        return sink(self.df)

    @property
    def dlq(self) -> DataFrame | None:
        """All blocks' dead letters together."""
        return reduce(DataFrame.unionByName, self.dead) if self.dead else None
