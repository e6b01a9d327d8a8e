"""Numeric aggregates and per-column summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.functions.dates import as_timestamp
from tablewise.functions.numeric import finite, safe_ratio
from tablewise.operators.ordering import column_quantiles, exact_quantiles
from tablewise.operators.shape import (
    categorical_columns,
    datetime_columns,
    is_missing,
    literal_row,
    numeric_columns,
    row_to_long,
    value_counts,
)

PERCENTILES = (10, 25, 50, 75, 90, 95, 99)


def metric_aggregate(value: Column, aggregation: str) -> Column:
    """sum (0 when nothing is known), mean, min, max or count."""
    if aggregation == "sum":
        total = F.sum(value)
        return F.coalesce(total, F.lit(0))
    functions = {"mean": F.avg, "min": F.min, "max": F.max, "count": F.count}
    if aggregation not in functions:
        raise ValueError(f"unsupported aggregation: {aggregation}")
    return functions[aggregation](value)


def grouped_metric(df: DataFrame, group: str, value: str, aggregation: str) -> DataFrame:
    return df.groupBy(F.col(group).alias("group")).agg(metric_aggregate(F.col(value), aggregation).alias("value"))


def numeric_aggregation(
    df: DataFrame, value: str, aggregation: str = "sum", group_by: str | None = None, limit: int | None = None
) -> DataFrame:
    """Ungrouped: ``result, count``. Grouped: ``group, value``, descending, nulls last."""
    if group_by is None:
        return df.agg(
            metric_aggregate(F.col(value), aggregation).alias("result"), F.count(value).alias("count")
        )
    ordered = grouped_metric(df, group_by, value, aggregation).orderBy(F.desc_nulls_last("value"), "group")
    return ordered.limit(limit) if limit else ordered


def _known(df: DataFrame, column: str) -> Column:
    return F.when(~is_missing(df, column), F.col(f"`{column}`").cast("double"))


def summary_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column: count, sum, mean, median, min, max, std (sample), missing."""
    names = list(columns or numeric_columns(df))
    measures: list[Column] = []
    for c in names:
        v = _known(df, c)
        measures += [
            F.count(v).alias(f"{c}__count"),
            F.sum(v).alias(f"{c}__sum"),
            F.avg(v).alias(f"{c}__mean"),
            F.min(v).alias(f"{c}__min"),
            F.max(v).alias(f"{c}__max"),
            F.when(F.count(v) > 1, F.stddev_samp(v)).when(F.count(v) == 1, 0.0).alias(f"{c}__std"),
            F.count_if(is_missing(df, c)).alias(f"{c}__missing"),
        ]
    fields = ["count", "sum", "mean", "min", "max", "std", "missing"]
    medians, row = column_quantiles(df, {c: finite(_known(df, c)) for c in names}, [0.5], measures)
    known = literal_row(df, row, measures, {f"{c}__median": medians[c] and medians[c][0] for c in names})
    return row_to_long(known, names, [*fields[:3], "median", *fields[3:]]).where(F.col("count") > 0)


def numeric_profile(
    df: DataFrame, columns: Sequence[str] | None = None
) -> DataFrame:
    """Robust statistics per numeric column: seven percentiles, spread and MAD.

    Two scans give the percentiles of all columns and two more, once the medians are known, their MADs.
    """
    names = list(columns or numeric_columns(df))
    base: list[Column] = []
    for c in names:
        v = _known(df, c)
        base += [
            F.count(v).alias(f"{c}__count"),
            F.count_if(is_missing(df, c)).alias(f"{c}__missing_count"),
            F.avg(v).alias(f"{c}__mean"),
            F.min(v).alias(f"{c}__min"),
            F.max(v).alias(f"{c}__max"),
            F.sum(v).alias(f"{c}__sum"),
            F.when(F.count(v) > 1, F.var_samp(v)).when(F.count(v) == 1, 0.0).alias(f"{c}__variance"),
        ]
    fields = ["count", "missing_count", "mean", "min", "max", "sum", "variance"]
    values = {c: finite(_known(df, c)) for c in names}
    quantiles, row = column_quantiles(df, values, [p / 100 for p in PERCENTILES], base)
    apart = {c: F.abs(values[c] - quantiles[c][PERCENTILES.index(50)]) for c in names if quantiles[c]}
    mads = column_quantiles(df, apart, [0.5])[0] if apart else {}
    percentiles = [f"p{p}" for p in PERCENTILES]
    more = {f"{c}__{name}": quantiles[c] and quantiles[c][i] for c in names for i, name in enumerate(percentiles)}
    more |= {f"{c}__mad": mads[c][0] if mads.get(c) else None for c in names}
    long = row_to_long(literal_row(df, row, base, more), names, [*fields, *percentiles, "mad"])
    std = F.sqrt("variance")
    return long.where(F.col("count") > 0).select(
        "column",
        "count",
        "missing_count",
        "mean",
        F.col("p50").alias("median"),
        "min",
        "max",
        "sum",
        *percentiles,
        (F.col("max") - F.col("min")).alias("range"),
        (F.col("p75") - F.col("p25")).alias("iqr"),
        "variance",
        std.alias("std"),
        safe_ratio(std, F.abs("mean")).alias("cv"),
        "mad",
    )


def summary_categorical(df: DataFrame, top: int | None = None) -> DataFrame:
    """Categorical columns: ``column, distinct_values, missing, rank, value, count``."""
    names = categorical_columns(df)
    counts = value_counts(df, names)
    totals = counts.groupBy("column").agg(
        F.count("value").alias("distinct_values"),
        F.sum(F.when(F.col("value").isNull(), F.col("count")).otherwise(0)).alias("missing"),
    )
    best = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    leaders = (
        counts.where(F.col("value").isNotNull())
        .withColumn("rank", F.row_number().over(best))
    )
    leaders = leaders.where(F.col("rank") <= top) if top else leaders
    return totals.join(leaders, "column", "left").select(
        "column", "distinct_values", "missing", "rank", "value", "count"
    )


def time_ranges(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Date columns: ``column, min, max, valid_values``."""
    names = list(columns or datetime_columns(df))
    measures = []
    for c in names:
        moment = as_timestamp(df, c)
        measures += [
            F.min(moment).alias(f"{c}__min"), F.max(moment).alias(f"{c}__max"),
            F.count(moment).alias(f"{c}__valid_values"),
        ]
    long = row_to_long(df.agg(*measures), names, ["min", "max", "valid_values"])
    return long.where(F.col("valid_values") > 0)


def frequency_table(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Non-null values, the top ones if ``top`` is given, with their share of the non-null rows."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("count")
    )
    totals = counts.agg(F.sum("count").alias("non_null_count"), F.count(F.lit(1)).alias("unique_count"))
    ordered = counts.orderBy(F.desc("count"), "value")
    return (
        (ordered.limit(top) if top else ordered)
        .crossJoin(F.broadcast(totals))
        .select(
            "value",
            "count",
            F.round(F.col("count") / F.col("non_null_count") * 100, 4).alias("share_percent"),
            "unique_count",
            "non_null_count",
        )
    )


def latency_percentiles(df: DataFrame, value: str, failed: Column) -> DataFrame:
    """p50 and p95 by lower index, with the error rate."""
    ranks = exact_quantiles(df, value, [0.5, 0.95], lower=True)
    errors = df.agg(
        F.count(F.lit(1)).alias("requests"), F.avg(failed.cast("double")).alias("error_rate")
    )
    return errors.crossJoin(F.broadcast(ranks)).select(
        "requests", "error_rate", F.col("quantiles")[0].alias("p50"), F.col("quantiles")[1].alias("p95")
    )


def pass_rates(df: DataFrame, group: str, passed: Column) -> DataFrame:
    """Cases, passed, failed per group."""
    return df.groupBy(F.col(group).alias("domain")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(passed).alias("passed"),
        F.count_if(~passed).alias("failed"),
    )


def finite_or_null(df: DataFrame) -> DataFrame:
    """Doubles with NaN and infinities replaced by null."""
    return df.select(*[
        finite(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f"`{f.name}`")
        for f in df.schema
    ])
