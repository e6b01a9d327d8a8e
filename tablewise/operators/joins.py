"""Joins against a side that is unique per key, and the latest row of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lookup_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """Join ``left`` to ``right`` (unique per ``right_key``); ``right_key`` is dropped.

    One plain join, so that plans stay linear in their inputs. A key that owns many rows is
    left to the adaptive skew join, which splits its rows over tasks; ``build_session``
    turns that on. Text keys are led by a hash: ids that begin alike would be compared letter by letter in the sort.
    """
    renamed, same = right.withColumnRenamed(right_key, "_rk"), F.col(left_key) == F.col("_rk")
    if isinstance(left.schema[left_key].dataType, T.StringType):
        left, renamed = left.withColumn("_lh", F.xxhash64(left_key)), renamed.withColumn("_rh", F.xxhash64("_rk"))
        same = (F.col("_lh") == F.col("_rh")) & same
    return left.join(renamed, same, how).drop("_rk", "_lh", "_rh")


def latest_per_key(df: DataFrame, keys: list[str], order: list[str] | list[Column]) -> DataFrame:
    """The row with the greatest ``order`` per key, by a map-side combinable aggregate."""
    columns = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*columns), ordering).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in columns]).select(*df.columns)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows, or those of each key together, over as many tasks as run side by side, before work that is heavy for each row; few rows in little room would share a task."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
