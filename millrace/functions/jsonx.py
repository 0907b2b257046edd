"""Payload access: a payload is parsed once into a variant, fields are read from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Variant type names that count as a declared field type.
TYPES = {
    "STRING": ("STRING",),
    "NUMBER": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT"),
    "BOOLEAN": ("BOOLEAN",),
    "OBJECT": ("OBJECT",),
    "ARRAY": ("ARRAY",),
    "ANY": (),
}


def payload(col: str | Column = "payload_json") -> Column:
    """The payload as a variant; null if there is none or it is not JSON."""
    return F.try_parse_json(F.col(col) if isinstance(col, str) else col)


def _path(field: str) -> str:
    return "$['" + field.replace("'", "\\'") + "']"


def get(p: Column, field: str, kind: str = "variant") -> Column:
    return F.try_variant_get(p, _path(field), kind)


def text(p: Column, field: str) -> Column:
    """A field as text, null if absent or JSON null."""
    return F.try_variant_get(p, _path(field), "string")


def keys(json: str | Column = "payload_json") -> Column:
    """Top-level field names, in order; null unless the text is an object."""
    return F.json_object_keys(F.col(json) if isinstance(json, str) else json)


def has(field: str, json: str | Column = "payload_json") -> Column:
    return F.coalesce(F.array_contains(keys(json), field), F.lit(False))


def type_of(p: Column, field: str) -> Column:
    """Name of a field's variant type without parameters: BIGINT, DECIMAL, STRING, OBJECT, ...; VOID for JSON null."""
    return F.regexp_extract(F.schema_of_variant(get(p, field)), "^([A-Z]+)", 1)


def is_number(p: Column, field: str) -> Column:
    return F.coalesce(type_of(p, field).isin(*TYPES["NUMBER"]), F.lit(False))


def canonical(json: str | Column, excluded: tuple[str, ...] = ()) -> Column:
    """Text that is equal for payloads with equal fields: keys in order, white space gone, excluded keys dropped."""
    j = F.col(json) if isinstance(json, str) else json
    entries = F.map_entries(F.from_json(j, "map<string,string>"))
    kept = F.filter(entries, lambda e: ~e["key"].isin(*excluded)) if excluded else entries
    return F.coalesce(F.to_json(F.array_sort(kept)), F.when(j.isNotNull(), j))


def fingerprint(json: str | Column, excluded: tuple[str, ...] = ()) -> Column:
    """64-bit hash of the canonical payload; 0 for none."""
    c = canonical(json, excluded)
    return F.when(c.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(c))
