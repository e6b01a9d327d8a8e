"""Calendar buckets, trends and concentration in time.

Everything after the first ``groupBy`` works on one row per calendar bucket, so the windows
here see at most one row per day of the covered span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.functions.dates import as_timestamp, month_end, month_start, week_end, year_end
from tablewise.functions.numeric import finite, round_to
from tablewise.operators.ordering import exact_quantiles

FILL_WITH_ZERO = ("count", "sum")


def bucket(moment: Column, frequency: str) -> Column:
    """Bucket date: D day, W closing Sunday, M month end, MS month start, Y year end."""
    buckets = {
        "D": lambda m: m.cast("date"), "W": week_end, "M": month_end, "MS": month_start, "Y": year_end,
    }
    return buckets[frequency](moment)


def _spine(low: Column, high: Column, frequency: str) -> Column:
    """All bucket dates from ``low`` to ``high`` (both bucket dates)."""
    if frequency in ("D", "W"):
        return F.sequence(low, high, F.expr("interval 1 day" if frequency == "D" else "interval 7 days"))
    if frequency == "MS":
        return F.sequence(low, high, F.expr("interval 1 month"))
    step = "interval 1 month" if frequency == "M" else "interval 12 months"
    unit = "MM" if frequency == "M" else "YYYY"
    firsts = F.sequence(F.trunc(low, unit), F.trunc(high, unit), F.expr(step))
    return F.transform(firsts, F.last_day if frequency == "M" else year_end)


def _pick_by_span(days: Column, choices: list[tuple[int | None, str]]) -> Column:
    """Frequency name: the first choice whose span limit is exceeded; the last is the default."""
    picked = None
    for limit, name in choices[:-1]:
        picked = F.when(days > limit, name) if picked is None else picked.when(days > limit, name)
    return picked.otherwise(choices[-1][1])


# How each aggregation is rebuilt from daily partial results.
_DAILY = {
    "count": (lambda x: {"_a": F.count(F.lit(1))}, lambda: F.sum("_a")),
    "sum": (lambda x: {"_a": F.sum(x)}, lambda: F.sum("_a")),
    "mean": (lambda x: {"_a": F.sum(x), "_b": F.count(x)}, lambda: F.try_divide(F.sum("_a"), F.sum("_b").cast("double"))),
    "min": (lambda x: {"_a": F.min(x)}, lambda: F.min("_a")),
    "max": (lambda x: {"_a": F.max(x)}, lambda: F.max("_a")),
}


def _adaptive_trend(df: DataFrame, time: str, value: str | None, aggregation: str, choices: list[tuple[int | None, str]]) -> DataFrame:
    """``period, value, frequency`` with the frequency the covered span asks for.

    The rows are read once, into one partial result per day; the span and the final buckets
    both come from those.
    """
    partial, final = _DAILY[aggregation]
    columns = [] if value is None else [F.col(value).alias("_x")]
    rows = df.select(as_timestamp(df, time).alias("_at"), *columns).where(F.col("_at").isNotNull())
    daily = rows.groupBy(F.col("_at").cast("date").alias("_day")).agg(
        F.min("_at").alias("_lo"), F.max("_at").alias("_hi"),
        *[measure.alias(name) for name, measure in partial("_x").items()],
    )
    span = daily.agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")).where(F.col("_lo").isNotNull())
    whole_days = F.floor(F.timestamp_diff("SECOND", F.col("_lo"), F.col("_hi")) / 86400)
    span = span.withColumn("frequency", _pick_by_span(whole_days, choices))

    def by_frequency(build) -> Column:
        chosen = None
        for _limit, name in choices:
            branch = build(name)
            chosen = F.when(F.col("frequency") == name, branch) if chosen is None else chosen.when(F.col("frequency") == name, branch)
        return chosen

    bucketed = (
        daily.crossJoin(F.broadcast(span.select("frequency")))
        .groupBy("frequency", by_frequency(lambda name: bucket(F.col("_day"), name)).alias("period"))
        .agg(final().alias("value"))
    )
    if aggregation not in FILL_WITH_ZERO:
        return bucketed.where(F.col("value").isNotNull()).select("period", "value", "frequency")
    spine = span.select(
        "frequency",
        F.explode(by_frequency(lambda name: _spine(bucket(F.col("_lo"), name), bucket(F.col("_hi"), name), name))).alias("period"),
    )
    return spine.join(bucketed.drop("frequency"), "period", "left").select(
        "period", F.coalesce("value", F.lit(0)).alias("value"), "frequency"
    )


def time_trend(df: DataFrame, time: str, value: str | None = None, aggregation: str = "count") -> DataFrame:
    """``period, value, frequency``: yearly above 730 days, monthly above 90, else daily.

    count and sum show empty buckets as 0; mean, min and max leave them out.
    """
    if value is None or aggregation == "count":
        value, aggregation = None, "count"
    return _adaptive_trend(df, time, value, aggregation, [(730, "Y"), (90, "M"), (None, "D")])


def event_volume_trend(df: DataFrame, time: str) -> DataFrame:
    """Row counts per day, per week above 120 days, per month above 730 days; gaps are 0."""
    return _adaptive_trend(df, time, None, "count", [(730, "M"), (120, "W"), (None, "D")])


def trend_stats(
    df: DataFrame,
    time: str,
    value: str | None = None,
    *,
    frequency: str = "MS",
    window: int = 3,
    aggregation: str = "mean",
) -> DataFrame:
    """Bucketed series with rolling mean and std, growth, and first/last/total growth."""
    moment = as_timestamp(df, time)
    if value is None:
        aggregation, number = "count", F.lit(1.0)
    else:
        number = finite(F.col(value))
    functions = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
    buckets = (
        df.select(bucket(moment, frequency).alias("period"), number.alias("_x"))
        .where(F.col("period").isNotNull() & F.col("_x").isNotNull())
        .groupBy("period")
        .agg(functions[aggregation]("_x").cast("double").alias("value"))
    )
    if aggregation in FILL_WITH_ZERO:
        ends = buckets.agg(F.min("period").alias("_lo"), F.max("period").alias("_hi")).where(F.col("_lo").isNotNull())
        spine = ends.select(F.explode(_spine(F.col("_lo"), F.col("_hi"), frequency)).alias("period"))
        buckets = spine.join(buckets, "period", "left").select(
            "period", F.coalesce("value", F.lit(0.0)).alias("value")
        )
    ordered = Window.partitionBy(F.lit(0)).orderBy("period")
    rolling = ordered.rowsBetween(-(window - 1), 0)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    growth = (F.try_divide(F.col("value"), F.lag("value").over(ordered)) - 1) * 100
    first, last = F.first("value").over(whole), F.last("value").over(whole)
    return buckets.select(
        "period",
        "value",
        F.avg("value").over(rolling).alias("rolling_mean"),
        F.stddev_samp("value").over(rolling).alias("rolling_std"),
        growth.alias("growth_percent"),
        first.alias("first_value"),
        last.alias("last_value"),
        (F.try_divide(last - first, F.abs(first)) * 100).alias("total_growth_percent"),
    )


def trend_direction(points: DataFrame) -> DataFrame:
    """First, last, change, direction, peak and minimum of ``period, value`` points."""
    shape = points.where(F.col("value").isNotNull()).agg(
        F.min_by("value", "period").cast("double").alias("first_value"),
        F.max_by("value", "period").cast("double").alias("last_value"),
        F.max(F.struct(F.col("value"), -F.datediff("period", F.lit("1970-01-01").cast("date")), F.col("period"))).alias(
            "_peak"
        ),
        F.min(F.struct("value", "period")).alias("_low"),
    )
    first, last = F.col("first_value"), F.col("last_value")
    change = last - first
    meaningful = (first != 0) & (first * last >= 0) & (F.abs(first) >= 1)
    return shape.select(
        "first_value",
        "last_value",
        F.round(change, 4).alias("absolute_change"),
        F.when(meaningful, F.round(change / F.abs(first) * 100, 2)).alias("percentage_change"),
        F.when(change > 0, "rising").when(change < 0, "falling").otherwise("stable").alias("direction"),
        F.col("_peak.period").alias("peak_period"),
        F.col("_peak.value").cast("double").alias("peak_value"),
        F.col("_low.period").alias("minimum_period"),
        F.col("_low.value").cast("double").alias("minimum_value"),
    )


def weekly_mean_median(df: DataFrame, time: str, metric: str) -> DataFrame:
    """Mean and median of a metric per week ending on Sunday."""
    rows = df.select(week_end(as_timestamp(df, time)).alias("week_end"), finite(F.col(metric)).alias("_x")).where(
        F.col("week_end").isNotNull() & F.col("_x").isNotNull()
    )
    means = rows.groupBy("week_end").agg(F.avg("_x").alias("mean"))
    medians = exact_quantiles(rows, "_x", [0.5], ["week_end"]).select(
        "week_end", F.col("quantiles")[0].alias("median")
    )
    return means.join(medians, "week_end")


def _metric_days(df: DataFrame, time: str, metric: str) -> DataFrame:
    return df.select(
        finite(F.col(metric)).alias("metric"), as_timestamp(df, time).cast("date").alias("day")
    ).where(F.col("metric").isNotNull() & F.col("day").isNotNull())


def concentration_threshold(quantiles: Column) -> Column:
    """min(p95, q3 + 1.5·IQR) when the fence lies above q3, else p95."""
    q1, q3, p95 = quantiles[0], quantiles[1], quantiles[2]
    fence = q3 + 1.5 * (q3 - q1)
    return F.when(fence > q3, F.least(p95, fence)).otherwise(p95)


def daily_ratio(df: DataFrame, time: str, metric: str) -> DataFrame:
    """``day, outlier_count, total_count, outlier_ratio`` of days with outliers, with the
    threshold and the total; nothing below five valid rows."""
    valid = _metric_days(df, time, metric)
    limits = exact_quantiles(valid, "metric", [0.25, 0.75, 0.95]).where(F.col("n") >= 5).select(
        concentration_threshold(F.col("quantiles")).alias("threshold")
    )
    days = (
        valid.crossJoin(F.broadcast(limits))
        .groupBy("day")
        .agg(
            F.count_if(F.col("metric") >= F.col("threshold")).alias("outlier_count"),
            F.count(F.lit(1)).alias("total_count"),
            F.max("threshold").alias("threshold"),
        )
        .where(F.col("outlier_count") > 0)
    )
    return days.withColumn("outlier_ratio", F.round(F.col("outlier_count") / F.col("total_count"), 4))


def top_days(days: DataFrame, limit: int = 10) -> DataFrame:
    return days.orderBy(F.desc("outlier_count"), "day").limit(limit)


def temporal_concentration(df: DataFrame, time: str, metric: str) -> DataFrame:
    """One row: outliers, threshold, top day, and whether one day holds half of them."""
    days = daily_ratio(df, time, metric)
    return days.agg(
        F.coalesce(F.sum("outlier_count"), F.lit(0)).alias("outlier_count"),
        round_to(F.max("threshold")).alias("outlier_threshold"),
        F.count(F.lit(1)).alias("outlier_days"),
        F.max_by("day", F.struct("outlier_count", -F.datediff("day", F.lit("1970-01-01").cast("date")))).alias("top_day"),
        F.max("outlier_count").alias("top_day_outliers"),
    ).withColumn(
        "conclusion",
        F.when(F.col("outlier_count") == 0, "insufficient_evidence")
        .when(F.col("top_day_outliers") / F.col("outlier_count") >= 0.5, "concentrated")
        .otherwise("distributed"),
    )


def daily_outlier_counts(df: DataFrame, time: str, metric: str) -> DataFrame:
    """Days with values above q3 + 1.5·IQR of the non-negative values."""
    valid = df.select(finite(F.col(metric)).alias("metric"), as_timestamp(df, time).cast("date").alias("day")).where(
        F.col("metric") >= 0
    )
    fence = exact_quantiles(valid, "metric", [0.25, 0.75]).select(
        (F.col("quantiles")[1] + 1.5 * (F.col("quantiles")[1] - F.col("quantiles")[0])).alias("_fence")
    )
    return (
        valid.crossJoin(F.broadcast(fence))
        .where((F.col("metric") > F.col("_fence")) & F.col("day").isNotNull())
        .groupBy("day")
        .agg(F.count(F.lit(1)).alias("outlier_count"))
    )
