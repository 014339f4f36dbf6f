"""JSON helpers for tool calls (JVM expressions).

Validity follows a strict parse (``try_parse_json``: one JSON value); the
``arguments`` text keeps its original key order in compact form
(``get_json_object``), except for a string value, which keeps its quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def is_json_object(body: Column) -> Column:
    v = F.try_parse_json(body)
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def json_name(body: Column) -> Column:
    """``name`` when it is a JSON string, else NULL."""
    v = F.try_variant_get(F.try_parse_json(body), "$.name", "variant")
    return F.when(F.schema_of_variant(v) == "STRING",
                  F.get_json_object(body, "$.name"))


def json_arguments(body: Column) -> Column:
    """``arguments`` as compact JSON text, ``{}`` when absent."""
    v = F.try_variant_get(F.try_parse_json(body), "$.arguments", "variant")
    kind = F.schema_of_variant(v)
    raw = F.get_json_object(body, "$.arguments")
    return (F.when(v.isNull(), F.lit("{}"))
             .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), raw)
             .otherwise(F.to_json(v)))
