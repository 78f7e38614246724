"""Reading values out of JSON payloads, with the types that JSON gives them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

PATH = re.compile(r"^\$(\.[A-Za-z_]\w*)+$")


def check_path(path: str) -> str:
    if not PATH.match(path):
        raise ValueError(f"{path!r} is not a path of the form $.name.name")
    return path


def key_path(name: str) -> str:
    if '"' in name:
        raise ValueError(f"{name!r} can't be a key")
    return f'$["{name}"]'


def parsed(payload: Column) -> Column:
    """The payload as a variant; null if it isn't JSON."""
    return F.try_parse_json(payload)


def item(v: Column, name: str) -> Column:
    return F.try_variant_get(v, key_path(name), "variant")


def string_scalar(x: Column) -> Column:
    """The text of a JSON string; null for any other JSON value."""
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))


def json_text(x: Column) -> Column:
    """The value's JSON; null for JSON null and where there is none."""
    return F.when(~F.is_variant_null(x), F.to_json(x))


def unquoted(text: Column) -> Column:
    """Text of JSON text: a string without quotes, anything else as it stands."""
    return F.when(text.startswith('"'), F.try_variant_get(F.try_parse_json(text), "$", "string")).otherwise(text)


def number(x: Column) -> Column:
    """A number, a number in a string, or 1 and 0 for true and false; else null."""
    return F.try_variant_get(x, "$", "double")


#: Declared type -> JSON schemas that give it, Spark type.
TYPED = {
    "STRING": (r"^STRING$", "string"),
    "INT64": (r"^BIGINT$", "bigint"),
    "FLOAT64": (r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "double"),
    "BOOLEAN": (r"^BOOLEAN$", "boolean"),
}
CAST = {"DATE": "date", "TIMESTAMP": "timestamp_ntz", "BYTES": "binary"}


def typed_path(doc: Column, path: str, kind: str) -> Column:
    """The value at a path as its declared type; null on a mismatch."""
    x = F.try_variant_get(F.try_parse_json(doc), check_path(path), "variant")
    if kind in TYPED:
        schema, spark_type = TYPED[kind]
        return F.when(F.schema_of_variant(x).rlike(schema), F.try_variant_get(x, "$", spark_type))
    if kind in CAST:
        return string_scalar(x).try_cast(CAST[kind])
    raise ValueError(f"no JSON value has type {kind}")


def packed(columns: dict[str, Column]) -> Column:
    """A JSON object of the columns, nulls kept; {} for none."""
    if not columns:
        return F.lit("{}")
    return F.to_json(F.struct(*(c.alias(k) for k, c in columns.items())), {"ignoreNullFields": "false"})
