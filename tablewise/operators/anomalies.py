"""Anomaly records: outliers, spikes, sudden changes, degradation, drift and SLA breaches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions.dates import as_timestamp
from tablewise.functions.numeric import (
    confidence_for_severity, finite, round_to, safe_ratio, severity_from_rate, severity_from_ratio, severity_rank,
)
from tablewise.operators.ordering import top_share_sum
from tablewise.operators.outliers import METHODS, outlier_rows
from tablewise.operators.quality import threshold_check
from tablewise.operators.shape import datetime_columns, numeric_columns
from tablewise.operators.timeseries import trend_stats
from tablewise.session import reliable_checkpoint

ROW_COUNT = "__row_count__"
PREFERRED_METRIC_TERMS = ("duration", "durata", "tempo", "time", "latency", "latenza", "sla", "hours", "minuti")
FIELDS = (
    "anomaly_id", "anomaly_type", "severity", "confidence_score", "affected_column", "affected_period",
    "observed_value", "expected_value", "deviation", "method", "row_id", "evidence",
)


def _records(
    df: DataFrame, anomaly_type: str, severity: Column, column: Column, period: Column, observed: Column,
    expected: Column, deviation: Column, method: Column, row_id: Column | None = None,
    evidence: dict[str, Column] | None = None,
) -> DataFrame:
    """Shape rows as anomaly records with a stable id over their identifying fields."""
    details = [part for name, value in (evidence or {}).items() for part in (F.lit(name), value.cast("string"))]
    shaped = df.select(
        F.lit(anomaly_type).alias("anomaly_type"),
        severity.alias("severity"),
        column.cast("string").alias("affected_column"),
        period.cast("string").alias("affected_period"),
        round_to(observed).alias("observed_value"),
        round_to(expected).alias("expected_value"),
        round_to(deviation).alias("deviation"),
        method.alias("method"),
        (row_id if row_id is not None else F.lit(None)).cast("string").alias("row_id"),
        F.create_map(*details).cast("map<string,string>").alias("evidence"),
    )
    identity = F.concat_ws(
        "|", "anomaly_type", F.coalesce("affected_column", F.lit("")), F.coalesce("affected_period", F.lit("")),
        F.coalesce(F.col("observed_value").cast("string"), F.lit("")), F.coalesce("row_id", F.lit("")), "method",
    )
    return (
        shaped.withColumn("confidence_score", confidence_for_severity(F.col("severity")))
        .withColumn("anomaly_id", F.concat(F.lit("anomaly-"), F.substring(F.sha1(identity), 1, 12)))
        .select(*FIELDS)
    )


def numeric_anomalies(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), methods: Sequence[str] = METHODS
) -> DataFrame:
    """One record per (row, column, method); severity from the distance to the median in IQRs."""
    hits = outlier_rows(df, columns, keys, methods)
    observed, median, iqr = (F.round(c, 4) for c in ("value", "median", "iqr"))
    scale = F.when(iqr != 0, F.abs(iqr)).otherwise(F.abs(median))
    ratio = F.when(scale == 0, F.lit(1.0)).otherwise(F.abs(observed - median) / scale)
    return _records(
        hits, "numeric_outlier", severity_from_ratio(ratio), F.col("column"), F.lit(None), observed, median,
        observed - median, F.col("method"), F.col("row_id"),
        {"lower_bound": F.col("lower_bound"), "upper_bound": F.col("upper_bound"), "mad": F.col("mad")},
    )


def _points(df, time, value, frequency, window, aggregation) -> DataFrame:
    stats = trend_stats(df, time, value, frequency=frequency, window=window, aggregation=aggregation)
    return stats.select(
        "period", *[round_to(F.col(c)).alias(c) for c in ("value", "rolling_mean", "rolling_std", "growth_percent")]
    )


def ts_spikes(
    df: DataFrame, time: str, value: str | None = None, *, frequency: str = "MS", window: int = 3,
    aggregation: str = "mean", multiplier: float = 2.0, exclude_current: bool = False, points: DataFrame | None = None,
) -> DataFrame:
    """Buckets above rolling mean + ``multiplier``·rolling std.

    The rolling window includes the tested bucket, so a window of 3 can never reach a
    multiplier of 2; ``exclude_current`` tests against the buckets before it instead.
    """
    points = points or _points(df, time, value, frequency, window, aggregation)
    if exclude_current:
        from pyspark.sql import Window

        before = Window.partitionBy(F.lit(0)).orderBy("period").rowsBetween(-window, -1)
        points = points.withColumn("rolling_mean", F.avg("value").over(before)).withColumn(
            "rolling_std", F.stddev_samp("value").over(before)
        )
    deviation = F.col("value") - F.col("rolling_mean")
    spiking = points.where(
        (F.col("rolling_std") > 0) & (F.col("value") > F.col("rolling_mean") + multiplier * F.col("rolling_std"))
    )
    return _records(
        spiking, "time_series_spike", severity_from_ratio(deviation / F.col("rolling_std")),
        F.lit(value or ROW_COUNT), F.col("period"), F.col("value"), F.col("rolling_mean"), deviation,
        F.lit("rolling_mean_std"), None,
        {"rolling_std": F.col("rolling_std"), "growth_percent": F.col("growth_percent")},
    )


def ts_sudden_changes(
    df: DataFrame, time: str, value: str | None = None, *, frequency: str = "MS", window: int = 3,
    aggregation: str = "mean", threshold: float = 50.0, points: DataFrame | None = None,
) -> DataFrame:
    """Buckets whose growth over the previous one reaches ``threshold`` percent either way."""
    points = points or _points(df, time, value, frequency, window, aggregation)
    growth = F.col("growth_percent")
    return _records(
        points.where(F.abs(growth) >= threshold), "sudden_change", severity_from_ratio(F.abs(growth) / threshold),
        F.lit(value or ROW_COUNT), F.col("period"), F.col("value"), F.col("rolling_mean"), growth,
        F.lit("period_over_period_growth"), None, {"growth_threshold_percent": F.lit(threshold)},
    )


def recent_vs_baseline(
    df: DataFrame, time: str, value: str, recent_rows: int | None = None
) -> DataFrame:
    """Mean of the last k rows by time (k = max(2, n/3)) against all earlier rows.

    Rows of one moment are ordered by value.
    """
    rows = df.select(as_timestamp(df, time).alias("t"), finite(F.col(value)).alias("x"))
    take = F.lit(max(1, recent_rows)) if recent_rows else F.greatest(F.lit(2), F.floor(F.col("n") / 3))
    sums = top_share_sum(rows, "t", "x", take)
    baseline = safe_ratio(F.col("baseline_sum"), F.col("n") - F.col("take"))
    recent = safe_ratio(F.col("recent_sum"), F.col("take"))
    return sums.where(F.col("n") > F.col("take")).select(
        "n",
        F.col("take").alias("recent_rows"),
        baseline.alias("baseline_mean"),
        recent.alias("recent_mean"),
        (safe_ratio(recent - baseline, F.abs(baseline)) * 100).alias("change_percent"),
        "recent_from",
        "recent_to",
    )


def degradation(
    df: DataFrame, time: str, value: str, *, recent_rows: int | None = None, min_points: int = 6,
    threshold: float = 20.0, higher_is_worse: bool = True,
) -> DataFrame:
    """A record when the recent rows are worse than the earlier ones by ``threshold`` percent."""
    compared = recent_vs_baseline(df, time, value, recent_rows).where(F.col("n") >= min_points)
    change = F.col("change_percent")
    worse = compared.where(change >= threshold if higher_is_worse else change <= -threshold)
    period = F.concat_ws("/", F.col("recent_from").cast("string"), F.col("recent_to").cast("string"))
    return _records(
        worse, "performance_degradation", severity_from_ratio(F.abs(change) / threshold), F.lit(value), period,
        F.col("recent_mean"), F.col("baseline_mean"), change, F.lit("recent_window_vs_baseline_mean"), None,
        {"recent_window": F.col("recent_rows"), "threshold_percent": F.lit(threshold)},
    )


def baseline_drift(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Change of the mean per column of two summaries (``column, mean``)."""
    left = current.select("column", F.col("mean").alias("current_mean"))
    right = baseline.select("column", F.col("mean").alias("baseline_mean"))
    return left.join(right, "column").where((F.col("baseline_mean") != 0) & F.col("current_mean").isNotNull()).select(
        "column", "current_mean", "baseline_mean",
        ((F.col("current_mean") - F.col("baseline_mean")) / F.abs("baseline_mean") * 100).alias("change_percent"),
    )


def drift_anomalies(current: DataFrame, baseline: DataFrame, threshold: float = 20.0) -> DataFrame:
    drifted = baseline_drift(current, baseline).where(F.abs("change_percent") >= threshold)
    return _records(
        drifted, "baseline_drift", severity_from_ratio(F.abs("change_percent") / threshold), F.col("column"),
        F.lit(None), F.col("current_mean"), F.col("baseline_mean"), F.col("change_percent"),
        F.lit("mean_drift_vs_baseline"), None, {"drift_threshold_percent": F.lit(threshold)},
    )


def sla_violations(
    df: DataFrame, column: str, threshold: float, operator: str = "<=", min_breach_rate: float = 0.0
) -> DataFrame:
    """A record when rows breach the threshold at least at the given rate."""
    checked = threshold_check(df, column, threshold, operator)
    rate = F.col("breach_rate")
    return _records(
        checked.where((F.col("breach_count") > 0) & (rate >= min_breach_rate)), "sla_violation",
        severity_from_rate(rate), F.lit(column), F.lit(None), rate, F.lit(0.0), rate, F.lit("threshold_comparison"),
        None, {
            "threshold": F.lit(threshold), "operator": F.lit(operator), "breach_count": F.col("breach_count"),
            "valid_count": F.col("valid_count"),
        },
    )


def anomaly_union(parts: Sequence[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result


def anomaly_dedup(anomalies: DataFrame) -> DataFrame:
    """One record per (type, column, period, observed value, row) with the methods collected."""
    order = F.coalesce(
        *[F.when(F.col("method") == m, F.lit(i)) for i, m in enumerate(METHODS)], F.lit(len(METHODS))
    )
    keys = ["anomaly_type", "affected_column", "affected_period", "observed_value", "row_id"]
    rest = [c for c in FIELDS if c not in keys and c not in ("severity", "confidence_score")]
    ranked = anomalies.withColumn("_order", order)
    return (
        ranked.groupBy(*keys)
        .agg(
            F.min_by(F.struct(*rest), F.struct("_order", "method")).alias("_first"),
            F.max("confidence_score").alias("confidence_score"),
            F.max_by("severity", F.struct("confidence_score", severity_rank(F.col("severity")))).alias("severity"),
            F.sort_array(F.collect_set("method")).alias("detection_methods"),
        )
        .select(*keys, "severity", "confidence_score", "detection_methods",
                F.size("detection_methods").alias("detection_count"), "_first.*")
        .select(*FIELDS, "detection_methods", "detection_count")
    )


def preferred_metric(columns: Sequence[str]) -> str | None:
    """First column named like a duration, else the first."""
    named = [c for c in columns if any(term in c.lower() for term in PREFERRED_METRIC_TERMS)]
    return (named or list(columns) or [None])[0]


def detect_all(
    df: DataFrame,
    *,
    numeric: Sequence[str] | None = None,
    time: str | None = None,
    value: str | None = None,
    keys: Sequence[str] = (),
    sla: dict | None = None,
    frequency: str = "MS",
    window: int = 3,
    multiplier: float = 2.0,
    growth_threshold: float = 50.0,
    degradation_threshold: float = 20.0,
) -> DataFrame:
    """Every detector that applies to the table, united and deduplicated."""
    columns = list(numeric or numeric_columns(df))
    dates = datetime_columns(df)
    time = time or (dates[0] if dates else None)
    value = value or preferred_metric(columns)
    parts = [numeric_anomalies(df, columns, keys)] if columns else []
    if time:
        # One row for each bucket; both detectors of changes over time read it.
        points = reliable_checkpoint(_points(df, time, value, frequency, window, "mean"))
        parts.append(ts_spikes(df, time, value, multiplier=multiplier, points=points))
        parts.append(ts_sudden_changes(df, time, value, threshold=growth_threshold, points=points))
        if value:
            parts.append(degradation(df, time, value, threshold=degradation_threshold))
    if sla:
        parts.append(sla_violations(df, sla.get("column", value), sla["threshold"], sla.get("operator", "<=")))
    return anomaly_dedup(anomaly_union(parts))


def anomaly_summary(anomalies: DataFrame) -> DataFrame:
    """Counts per anomaly type and severity."""
    return anomalies.groupBy("anomaly_type").agg(
        F.count(F.lit(1)).alias("anomaly_count"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("low", "medium", "high", "critical")],
    )


def top_anomalies(anomalies: DataFrame, limit: int = 10) -> DataFrame:
    """The gravest records: by severity, confidence and size of the deviation, then by what names them."""
    return anomalies.orderBy(
        severity_rank(F.col("severity")).desc(), F.desc("confidence_score"), F.abs("deviation").desc_nulls_last(),
        "anomaly_type", "affected_column", "affected_period", "observed_value", "row_id", "method",
    ).limit(limit)
