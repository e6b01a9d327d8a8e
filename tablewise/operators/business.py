"""Revenue, cost, margin and churn summaries, and the ticket overview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions.numeric import safe_ratio, to_number
from tablewise.operators.counts import count_occurrences
from tablewise.operators.durations import elapsed_summary
from tablewise.operators.timeseries import event_volume_trend
from tablewise.session import reused


def _total(column: str | None) -> Column:
    return F.coalesce(F.sum(to_number(F.col(column))), F.lit(0.0)) if column else F.lit(None).cast("double")


def _mean(column: str | None) -> Column:
    return F.avg(to_number(F.col(column))) if column else F.lit(None).cast("double")


def _with_margin(df: DataFrame) -> DataFrame:
    margin = F.col("revenue") - F.col("cost")
    return df.withColumn("margin", margin).withColumn("margin_rate", safe_ratio(margin, F.col("revenue")))


def business_totals(df: DataFrame, revenue: str | None, cost: str | None, churn: str | None = None) -> DataFrame:
    """Total revenue, cost, margin, margin rate and mean churn."""
    return _with_margin(
        df.agg(_total(revenue).alias("revenue"), _total(cost).alias("cost"), _mean(churn).alias("churn_rate"))
    )


def business_by_dim(
    df: DataFrame, dimension: str, revenue: str | None, cost: str | None, churn: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """The totals per value of a dimension (null kept), best margin first."""
    grouped = df.groupBy(F.col(dimension).cast("string").alias("name")).agg(
        _total(revenue).alias("revenue"), _total(cost).alias("cost"), _mean(churn).alias("churn_rate")
    )
    ordered = _with_margin(grouped).orderBy(F.desc_nulls_last("margin"), "name")
    return ordered.limit(limit) if limit else ordered


def business_periods(df: DataFrame, period: str, revenue: str, limit: int | None = None) -> DataFrame:
    """Revenue per period in text order."""
    grouped = df.groupBy(F.col(period).cast("string").alias("period")).agg(_total(revenue).alias("revenue"))
    ordered = grouped.orderBy("period")
    return ordered.limit(limit) if limit else ordered


def business_trend(df: DataFrame, period: str, revenue: str) -> DataFrame:
    """First and last period with their revenue and growth; empty below two periods."""
    periods = business_periods(df, period, revenue)
    ends = periods.agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("period").alias("first_period"),
        F.max("period").alias("last_period"),
        F.min_by("revenue", "period").alias("first_revenue"),
        F.max_by("revenue", "period").alias("last_revenue"),
    )
    growth = (F.col("last_revenue") - F.col("first_revenue")) / F.col("first_revenue")
    return ends.where((F.col("_n") >= 2) & (F.col("first_revenue") != 0)).drop("_n").withColumn(
        "revenue_growth_rate", growth
    )


def business_extremes(by_channel: DataFrame, by_segment: DataFrame | None = None) -> DataFrame:
    """Lowest margin rate, highest cost ratio and highest churn among the dimension rows."""
    cost_ratio = F.coalesce(safe_ratio(F.col("cost"), F.col("revenue")), F.lit(-1.0))
    worst = by_channel.agg(
        F.min_by(F.struct("name", F.col("margin_rate").alias("value")), F.struct(F.coalesce("margin_rate", F.lit(999.0)), "name")).alias("m"),
        F.max_by(F.struct("name", cost_ratio.alias("value")), F.struct(cost_ratio, "name")).alias("c"),
    )
    rows = worst.select(F.explode(F.array(
        F.struct(F.lit("lowest_margin_rate").alias("finding"), F.col("m.name").alias("name"), F.col("m.value").alias("value")),
        F.struct(F.lit("highest_cost_ratio").alias("finding"), F.col("c.name").alias("name"), F.col("c.value").alias("value")),
    )).alias("_r")).select("_r.*")
    if by_segment is not None:
        churn = by_segment.agg(
            F.max_by(F.struct("name", F.col("churn_rate").alias("value")), F.struct(F.coalesce("churn_rate", F.lit(0.0)), "name")).alias("s")
        )
        rows = rows.unionByName(
            churn.select(F.lit("highest_churn").alias("finding"), F.col("s.name").alias("name"), F.col("s.value").alias("value"))
        )
    return rows


def ticket_overview(
    df: DataFrame, status: str, opened: str, closed: str
) -> dict[str, DataFrame]:
    """Counts by status, closures per bucket, their ends and peak, and the elapsed time."""
    df = reused(df.select(status, opened, closed))
    closures = event_volume_trend(df.where(F.col(closed).isNotNull()), closed)
    return {
        "by_status": count_occurrences(df, status),
        "closures": closures,
        "closure_ends": df.agg(
            F.count(closed).alias("valid_closures"), F.min(closed).alias("first_closure"), F.max(closed).alias("last_closure")
        ).crossJoin(
            closures.agg(
                F.max_by("period", F.struct("value", -F.datediff("period", F.lit("1970-01-01").cast("date")))).alias("peak_period"),
                F.max("value").alias("peak_closures"),
            )
        ),
        "elapsed": elapsed_summary(df, opened, closed),
    }
