"""Categorical counts, semantic groups, cross-tabs and top-N."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.operators.aggregates import grouped_metric
from tablewise.operators.shape import long_texts, null_label

OTHER_LABEL = "ALTRO"


def count_occurrences(
    df: DataFrame, column: str, limit: int | None = None, groups: Sequence[dict] = ()
) -> DataFrame:
    """``value, count`` by descending count, ties by value; nulls under the null label."""
    value = semantic_group(F.col(column), groups) if groups else null_label(F.col(column))
    counted = df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("count"))
    ordered = counted.orderBy(F.desc("count"), "value")
    return ordered.limit(limit) if limit else ordered


def occurrence_totals(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Shown values, distinct non-null values and records of one column."""
    per_value = df.groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    label = null_label(F.col("_v"))
    return (
        per_value.groupBy(label.alias("_label"))
        .agg(F.sum("_n").alias("_n"), F.count("_v").alias("_known"))
        .agg(
            F.sum("_n").alias("total_records"),
            F.least(F.count(F.lit(1)), F.lit(limit) if limit else F.count(F.lit(1))).cast("bigint").alias("displayed_unique_values"),
            F.sum("_known").alias("non_null_unique_values"),
        )
    )


def related_counts(df: DataFrame, related: Sequence[str], limit: int | None = None) -> DataFrame:
    """Counts of the related columns as ``column, value, count, rank``, the top ``limit`` of each if given."""
    cells = long_texts(df, related).groupBy("column", null_label(F.col("value")).alias("value")).agg(
        F.count(F.lit(1)).alias("count")
    )
    best = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    ranked = cells.withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= limit) if limit else ranked


def semantic_group(column: Column, groups: Sequence[dict]) -> Column:
    """Label of the first matching ``{label, operator, values}`` definition, else the rest label."""
    raw = null_label(column)
    label = None
    for group in groups:
        values = [str(v) for v in group["values"]]
        hit = ~raw.isin(values) if group.get("operator") == "exclude" else raw.isin(values)
        label = F.when(hit, group["label"]) if label is None else label.when(hit, group["label"])
    return F.lit(OTHER_LABEL) if label is None else label.otherwise(OTHER_LABEL)


def semantic_group_values(df: DataFrame, column: str, groups: Sequence[dict]) -> DataFrame:
    """``label, value, count``: which source values each group took in."""
    raw = df.groupBy(null_label(F.col(column)).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return raw.select(semantic_group(F.col("value"), groups).alias("label"), "value", "count")


def semantic_groups(df: DataFrame, column: str, groups: Sequence[dict]) -> DataFrame:
    """``label, count, source_value_count`` per group."""
    return semantic_group_values(df, column, groups).groupBy("label").agg(
        F.sum("count").alias("count"), F.count(F.lit(1)).alias("source_value_count")
    )


def cross_tab(
    df: DataFrame, primary: str, related: str, groups: Sequence[dict] = ()
) -> DataFrame:
    """Zero-filled contingency ``primary_value, related_value, count, total, share_percent``.

    Empty when the related column has more distinct values than min(50, max(10, n/10)).
    """
    left = semantic_group(F.col(primary), groups) if groups else null_label(F.col(primary))
    pairs = df.groupBy(left.alias("primary_value"), F.col(related).alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    per_related = pairs.groupBy("_r").agg(F.sum("_n").alias("_n"))
    gate = per_related.agg(
        (F.count("_r") <= F.least(F.lit(50), F.greatest(F.lit(10), F.floor(F.sum("_n") / 10)))).alias("_allowed")
    )
    # The gate admits at most 50 known values, so 52 rows hold all of them plus the null.
    first_values = per_related.select(null_label(F.col("_r")).alias("_r")).distinct().orderBy("_r").limit(52)
    spine = first_values.agg(F.array_sort(F.collect_list("_r")).alias("_values")).crossJoin(F.broadcast(gate)).where(
        "_allowed"
    )
    cells = (
        pairs.crossJoin(F.broadcast(gate))
        .where("_allowed")
        .groupBy("primary_value", null_label(F.col("_r")).alias("_r"))
        .agg(F.sum("_n").alias("_n"))
        .groupBy("primary_value")
        .agg(
            F.sum("_n").alias("total"),
            F.map_from_entries(F.collect_list(F.struct("_r", "_n"))).alias("_cells"),
        )
    )
    filled = cells.crossJoin(F.broadcast(spine)).select(
        "primary_value", "total", "_cells", F.explode("_values").alias("related_value")
    )
    count = F.coalesce(F.try_element_at("_cells", F.col("related_value")), F.lit(0).cast("bigint"))
    return filled.select(
        "primary_value",
        "related_value",
        count.alias("count"),
        "total",
        F.round(count / F.col("total") * 100, 2).alias("share_percent"),
    )


def share_of_total(df: DataFrame, column: str) -> DataFrame:
    """``value, count, share_percent`` of all records per labelled value."""
    counted = df.groupBy(null_label(F.col(column)).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    total = counted.agg(F.sum("count").alias("_total"))
    return counted.crossJoin(F.broadcast(total)).select(
        "value", "count", F.round(F.col("count") / F.col("_total") * 100, 4).alias("share_percent")
    )


def top_n(
    df: DataFrame, target: str, value: str | None = None, aggregation: str = "count", limit: int | None = None
) -> DataFrame:
    """``value, metric``: top groups by a metric (null group kept) or by count (null label)."""
    if value is None or aggregation == "count":
        return count_occurrences(df, target, limit).select("value", F.col("count").alias("metric"))
    grouped = grouped_metric(df, target, value, aggregation)
    ordered = grouped.select(F.col("group").alias("value"), F.col("value").alias("metric")).orderBy(F.desc_nulls_last("metric"), "value")
    return ordered.limit(limit) if limit else ordered
