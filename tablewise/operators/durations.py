"""Datetime shifts, durations between two dates and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions.dates import as_timestamp, elapsed
from tablewise.functions.numeric import finite
from tablewise.operators.aggregates import numeric_profile
from tablewise.operators.ordering import exact_quantiles
from tablewise.session import reused


def datetime_shift(df: DataFrame, column: str, hours: int = 1, output: str | None = None) -> DataFrame:
    """Adds ``<column>_ADJUSTED`` = parsed column plus ``hours``."""
    shifted = as_timestamp(df, column) + F.make_dt_interval(hours=F.lit(hours))
    return df.withColumn(output or f"{column}_ADJUSTED", shifted)


def datetime_shift_report(df: DataFrame, column: str, hours: int = 1) -> DataFrame:
    """Parsed, missing and unparsable counts with the range before and after."""
    parsed = as_timestamp(df, column)
    shifted = parsed + F.make_dt_interval(hours=F.lit(hours))
    return df.agg(
        F.count(parsed).alias("parsed_count"),
        F.count_if(F.col(column).isNull()).alias("missing_count"),
        F.count_if(parsed.isNull() & F.col(column).isNotNull()).alias("failed_parse_count"),
        F.min(parsed).alias("min_before"),
        F.max(parsed).alias("max_before"),
        F.min(shifted).alias("min_after"),
        F.max(shifted).alias("max_after"),
    )


def duration_feature(df: DataFrame, start: str, end: str, output: str, unit: str = "days") -> DataFrame:
    """Adds ``end - start`` as a double; negatives are kept."""
    return df.withColumn(output, elapsed(as_timestamp(df, start), as_timestamp(df, end), unit))


def duration_report(df: DataFrame, start: str, end: str, unit: str = "days") -> DataFrame:
    """Valid, missing, negative and unparsable counts of a duration."""
    first, last = as_timestamp(df, start), as_timestamp(df, end)
    span = elapsed(first, last, unit)
    return df.agg(
        F.count(span).alias("valid_count"),
        F.count_if(span.isNull()).alias("missing_count"),
        F.count_if(span < 0).alias("negative_duration_count"),
        F.count_if(first.isNull()).alias("start_parse_errors"),
        F.count_if(last.isNull()).alias("end_parse_errors"),
    )


def _valid_hours(df: DataFrame, start: str, end: str) -> DataFrame:
    hours = elapsed(as_timestamp(df, start), as_timestamp(df, end), "hours")
    return df.select(hours.alias("hours"))


def duration_between_dates(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows with both dates and a non-negative span: count, mean, median, min, max hours."""
    spans = reused(_valid_hours(df, start, end).where(F.col("hours") >= 0))
    medians = exact_quantiles(spans, "hours", [0.5])
    stats = spans.agg(
        F.count("hours").alias("valid_rows"),
        F.avg("hours").alias("average_hours"),
        F.min("hours").alias("min_hours"),
        F.max("hours").alias("max_hours"),
    )
    return stats.crossJoin(F.broadcast(medians)).select(
        "valid_rows",
        F.round("average_hours", 4).alias("average_hours"),
        F.round(F.col("quantiles")[0], 4).alias("median_hours"),
        F.round("min_hours", 4).alias("min_hours"),
        F.round("max_hours", 4).alias("max_hours"),
    )


def elapsed_summary(df: DataFrame, start: str, end: str) -> DataFrame:
    """``duration_between_dates`` with the number of rows left out."""
    df = reused(df.select(start, end))
    counted = df.agg(F.count(F.lit(1)).alias("total_rows"))
    return (
        duration_between_dates(df, start, end)
        .crossJoin(F.broadcast(counted))
        .withColumn("excluded_rows", F.col("total_rows") - F.col("valid_rows"))
    )


def long_tail(p95: Column, median: Column) -> Column:
    return F.coalesce((median > 0) & (p95 / median >= 2), F.lit(False))


def activation_profile(df: DataFrame, start: str, end: str, unit: str = "days") -> DataFrame:
    """Distribution of a duration: counts, percentiles, spread, IQR outliers, long tail."""
    spans = reused(df.select(elapsed(as_timestamp(df, start), as_timestamp(df, end), unit).alias("duration")))
    profile = numeric_profile(spans, ["duration"])
    fence = profile.select(
        (F.col("p25") - 1.5 * F.col("iqr")).alias("_low"), (F.col("p75") + 1.5 * F.col("iqr")).alias("_high")
    )
    counts = spans.crossJoin(F.broadcast(fence)).agg(
        F.count_if(F.col("duration") < 0).alias("negative_duration_count"),
        F.count_if((F.col("duration") < F.col("_low")) | (F.col("duration") > F.col("_high"))).alias("outlier_count"),
    )
    return profile.crossJoin(F.broadcast(counts)).select(
        F.col("count").alias("valid_count"),
        "missing_count",
        "negative_duration_count",
        "mean",
        "median",
        "p75",
        "p90",
        "p95",
        "p99",
        "iqr",
        "mad",
        "outlier_count",
        long_tail(F.col("p95"), F.col("median")).alias("long_tail"),
    )


def activation_by_method(df: DataFrame, metric: str, method: str) -> DataFrame:
    """Mean metric per method, the leading method flagged, and the overall long-tail flag."""
    df = reused(df.select(metric, method))
    means = (
        df.where(F.col(method).isNotNull())
        .groupBy(F.col(method).alias("method"))
        .agg(F.avg(finite(F.col(metric))).alias("mean_metric"))
        .where(F.col("mean_metric").isNotNull())
    )
    leader = means.agg(F.max_by("method", F.struct("mean_metric", "method")).alias("_leader"))
    tail = exact_quantiles(df, metric, [0.5, 0.95]).select(
        F.col("quantiles")[0].alias("median"), F.col("quantiles")[1].alias("p95")
    )
    return means.crossJoin(F.broadcast(leader)).crossJoin(F.broadcast(tail)).select(
        "method",
        "mean_metric",
        (F.col("method") == F.col("_leader")).alias("is_leader"),
        (F.col("p95") >= F.greatest(F.col("median") * 2, F.col("median") + 1)).alias("long_tail"),
    )
