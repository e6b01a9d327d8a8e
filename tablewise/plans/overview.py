"""The standard battery of analyses on any table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.operators.aggregates import numeric_aggregation
from tablewise.operators.counts import count_occurrences, top_n
from tablewise.operators.durations import duration_between_dates
from tablewise.operators.profiling import pick_pair, pick_time_axis
from tablewise.operators.quality import duplicate_detection, null_detection
from tablewise.operators.shape import categorical_columns, numeric_columns
from tablewise.operators.timeseries import time_trend

STATUS_WORDS = ("stato", "status", "state", "fase", "esito")
START_WORDS = ("creazione", "apertura", "created", "creation", "opened", "start")
END_WORDS = ("risoluzione", "chiusura", "resolved", "closed", "end")


def auto_overview(df: DataFrame) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Result frames per step, and the error text of the steps that do not apply.

    Steps: distribution of the status column, trend, duration, up to two top categories, mean
    of the first metric, nulls, duplicates.
    """
    categories, numbers = categorical_columns(df), numeric_columns(df)
    status = next((c for c in df.columns if any(w in c.lower() for w in STATUS_WORDS)), None)
    status = status or (categories[0] if categories else None)
    time, pair = pick_time_axis(df), pick_pair(df, START_WORDS, END_WORDS)
    metric = numbers[0] if numbers else None
    steps: dict[str, Callable[[], DataFrame]] = {}
    if status:
        steps["category-distribution"] = lambda: count_occurrences(df, status, 20)
    if time:
        steps["time-trend"] = lambda: time_trend(df, time, metric, "sum" if metric else "count")
    if pair:
        steps["duration-summary"] = lambda: duration_between_dates(df, *pair)
    for index, column in enumerate(categories[:2]):
        if column != status:
            steps[f"top-category-{index + 1}"] = lambda c=column: top_n(df, c, metric, "sum" if metric else "count", 10)
    if metric:
        steps["numeric-summary"] = lambda: numeric_aggregation(df, metric, "mean", status, 20)
    steps["null-detection"] = lambda: null_detection(df, 20)
    steps["duplicate-detection"] = lambda: duplicate_detection(df)

    results, errors = {}, {}
    for name, build in steps.items():
        try:
            results[name] = build()
        except Exception as error:  # noqa: BLE001 - one failing step must not stop the others
            errors[name] = str(error)
    return results, errors


def overview_long(df: DataFrame) -> DataFrame:
    """``step, item, value`` of the battery in one frame."""
    results, _errors = auto_overview(df)
    picks = {
        "category-distribution": ("value", "count"),
        "time-trend": ("period", "value"),
        "duration-summary": (None, "average_hours"),
        "numeric-summary": ("group", "value"),
        "null-detection": ("column", "null_count"),
        "duplicate-detection": (None, "duplicate_rows"),
    }
    united = None
    for step, frame in results.items():
        item, value = picks.get(step, ("value", "metric"))
        label = F.coalesce(F.col(item).cast("string"), F.lit("N/D")) if item and item in frame.columns else F.lit(value)
        part = frame.select(F.lit(step).alias("step"), label.alias("item"), F.col(value).cast("double").alias("value"))
        united = part if united is None else united.unionByName(part)
    return united
