"""JSON, masking and filtering of metadata maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metadata keys that never leave the engine.
SECRET_KEYS = ("password", "token", "api_key", "secret", "connection_string", "dsn")


def to_json(value: Column) -> Column:
    return F.to_json(value)


def property_value(properties: Column, name: str) -> Column:
    """One property of a MAP<STRING,STRING>; null when absent."""
    return F.try_element_at(properties, F.lit(name))


def properties_match(properties: Column, wanted: dict[str, str]) -> Column:
    """All wanted properties are present and equal, ignoring case."""
    result = F.lit(True)
    for name, expected in wanted.items():
        actual = property_value(properties, name)
        result = result & F.coalesce(F.lower(actual) == str(expected).lower(), F.lit(False))
    return result


def drop_secrets(metadata: Column) -> Column:
    return F.map_filter(metadata, lambda key, _value: ~F.lower(key).isin(*SECRET_KEYS))


def mask_url_password(url: Column) -> Column:
    return F.regexp_replace(url, r"(://[^:/@\s]*:)[^@\s]+@", "$1***@")
