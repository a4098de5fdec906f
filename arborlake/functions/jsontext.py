"""JSON text as VARIANT, strictly."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_END = "\\u0001end"


def strict_json(text: Column) -> Column:
    """The parsed value, or null when the text is not exactly one JSON value.

    The built-in parser stops after the first value and does not mind what follows it. Parsed
    as the first element of an array with an end mark behind it, text after the value shows.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))
    mark = F.try_variant_get(wrapped, "$[1]", "string")
    return F.when(mark == F.lit("\x01end"), F.try_variant_get(wrapped, "$[0]", "variant"))


def is_object(value: Column) -> Column:
    """True for a VARIANT object, null for no value."""
    return F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))
