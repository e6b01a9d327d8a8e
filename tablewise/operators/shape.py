"""Column selection by type and reshaping between wide and long."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_LABEL = "N/D"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def temporal_columns(df: DataFrame) -> list[str]:
    kinds = (T.TimestampType, T.TimestampNTZType, T.DateType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def datetime_columns(df: DataFrame) -> list[str]:
    """Temporal columns first, then text columns named like a date or time."""
    found = temporal_columns(df)
    named = [
        f.name
        for f in df.schema
        if isinstance(f.dataType, T.StringType) and any(t in f.name.lower() for t in ("date", "time"))
    ]
    return found + named


def is_missing(df: DataFrame, column: str) -> Column:
    value = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def null_label(column: Column) -> Column:
    """Text with nulls shown as the null label; real values equal to the label merge with them."""
    return F.coalesce(column.cast("string"), F.lit(NULL_LABEL))


def long_numbers(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``keep..., column, value DOUBLE``; missing values kept as null."""
    cells = F.array(*[
        F.struct(
            F.lit(c).alias("column"),
            F.when(~is_missing(df, c), F.col(f"`{c}`").cast("double")).alias("value"),
        )
        for c in columns
    ])
    return df.select(*keep, F.explode(cells).alias("_cell")).select(*keep, "_cell.column", "_cell.value")


def long_texts(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``keep..., column, value STRING``; nulls kept."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.when(~is_missing(df, c), F.col(f"`{c}`").cast("string")).alias("value"))
        for c in columns
    ])
    return df.select(*keep, F.explode(cells).alias("_cell")).select(*keep, "_cell.column", "_cell.value")


def row_to_long(row: DataFrame, names: Sequence[str], measures: Sequence[str], name: str = "column") -> DataFrame:
    """A one-row frame with ``<column>__<measure>`` fields as one row per column."""
    cells = F.array(*[
        F.struct(F.lit(n).alias(name), *[F.col(f"`{n}__{m}`").alias(m) for m in measures]) for n in names
    ])
    return row.select(F.explode(cells).alias("_cell")).select(f"_cell.{name}", *[f"_cell.{m}" for m in measures])


def literal_row(df: DataFrame, row: Row, columns: Sequence[Column], more: dict[str, float | None]) -> DataFrame:
    """One row of known values: those of the aggregates ``columns`` of ``df``, in their types, and ``more`` numbers."""
    known = [F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in df.agg(*columns).schema]
    added = [F.lit(v).cast("double").alias(name) for name, v in more.items()]
    return df.sparkSession.range(0, 1, 1, 1).select(*known, *added)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, value, count`` for every distinct value, nulls included."""
    return long_texts(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, distinct_values`` without nulls; 16 bytes of each distinct value are shuffled, whatever its length."""
    digests = long_texts(df, columns).select("column", F.unhex(F.md5("value")).alias("_digest")).distinct()
    return digests.groupBy("column").agg(F.count("_digest").alias("distinct_values"))


def row_hash(df: DataFrame) -> Column:
    """A row identity for tables without a key."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
