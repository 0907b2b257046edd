"""Metadata maps: later entries replace earlier ones, whatever the session's map policy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def put(m: str | Column, entries: dict[str, Column]) -> Column:
    """The map with the entries set; a null map counts as empty."""
    old = F.map_filter(F.coalesce(F.col(m) if isinstance(m, str) else m, F.expr("cast(map() as map<string,string>)")), lambda k, _: ~k.isin(*entries))
    return F.map_concat(old, F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)]))
