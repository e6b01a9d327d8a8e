"""Rate breaches, feedback counters and SLA monitoring on streams.

Each function also runs on a batch frame, where the watermark has no effect.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from tablewise.operators.learning import confidence_and_status
from tablewise.operators.quality import complies


def _event_time(events: DataFrame, time: str, delay: str) -> DataFrame:
    return events.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", delay)


def rate_breaches(
    events: DataFrame, time: str, keys: Sequence[str], limit: int, window: str = "60 seconds", delay: str = "10 minutes"
) -> DataFrame:
    """Subjects with more than ``limit`` events in a fixed window; ``sliding_breaches`` for any window of that length."""
    counted = _event_time(events, time, delay).groupBy(F.window("_at", window).alias("_w"), *keys).agg(
        F.count(F.lit(1)).alias("requests")
    )
    return counted.where(F.col("requests") > limit).select(
        F.col("_w.start").cast("timestamp_ntz").alias("window_start"), *keys, "requests"
    )


def _span_of(moment: Column, span: int) -> Column:
    """The number of the span of ``span`` microseconds that holds a moment; below zero before 1970."""
    return ((moment - F.pmod(moment, F.lit(span))) / span).cast("bigint")


def sliding_breaches(
    events: DataFrame, time: str, keys: Sequence[str], limit: int, seconds: int = 60, delay: str = "10 minutes", windows: int = 64
) -> DataFrame:
    """Moments at which a subject made more than ``limit`` requests in the last ``seconds``: ``keys..., moment, requests``.

    A request counts until ``seconds`` have passed, refused ones too, and those of the same moment count together; events
    without a time are left out, and a null key is a subject. A subject's events are cut into spans of ``windows`` windows, and the events of a span's last window
    are context of the next one too, so that the tasks of a busy subject hold one span each.

    On a stream a moment is given once the watermark has passed it, so late events up to ``delay`` count; the state of a span
    holds a count for each moment of the last window and of those still open. Use the append output mode.
    """
    width = seconds * 1_000_000
    span = width * windows
    timed = events.select(*keys, F.col(time).cast("timestamp").alias("_at")).where(F.col("_at").isNotNull())
    moment = F.unix_micros("_at")
    if events.isStreaming:
        # The watermark belongs to the time column, which stays in the rows.
        counted = timed.withWatermark("_at", delay).withColumn("_moment", moment)
    else:
        counted = timed.groupBy(*keys, moment.alias("_moment")).agg(F.count(F.lit(1)).alias("_n"))
    own = _span_of(F.col("_moment"), span)
    in_last_window = F.pmod(F.col("_moment"), F.lit(span)) > span - width
    placed = counted.withColumn("_span", F.explode(F.when(in_last_window, F.array(own, own + 1)).otherwise(F.array(own))))
    if events.isStreaming:
        fields = [StructField(f.name, f.dataType) for f in timed.select(*keys).schema]
        found = placed.groupBy(*keys, "_span").applyInPandasWithState(
            _sliding_counts([f.name for f in fields], limit, width, span),
            StructType([*fields, StructField("_moment", LongType()), StructField("requests", LongType())]),
            "moments array<bigint>, counts array<bigint>, given bigint", "append", GroupStateTimeout.EventTimeTimeout,
        )
    else:
        trailing = Window.partitionBy(*keys, "_span").orderBy("_moment").rangeBetween(1 - width, 0)
        found = placed.withColumn("requests", F.sum("_n").over(trailing)).where((F.col("requests") > limit) & (F.col("_span") == own))
    return found.select(*keys, F.timestamp_micros("_moment").cast("timestamp_ntz").alias("moment"), "requests")


def _sliding_counts(names: Sequence[str], limit: int, width: int, span: int):
    """The step of one subject's span: merge new moments, give those that the watermark has passed, keep what later ones need."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        moments, counts, given = state.get if state.exists else ([], [], None)
        merged = pd.Series(counts, index=moments, dtype="int64")
        for frame in () if state.hasTimedOut else frames:
            merged = merged.add(frame["_moment"].value_counts(), fill_value=0)
        merged = merged.sort_index()
        at, n = merged.index.to_numpy("int64"), merged.to_numpy("int64")
        passed = state.getCurrentWatermarkMs() * 1000
        start, end = int(key[-1]) * span, (int(key[-1]) + 1) * span
        # Moments before the span are context, and those up to the last watermark have been given.
        first = start if given is None else max(start, given + 1)
        low, high = np.searchsorted(at, [first, passed + 1])
        if low < high:
            sums = np.concatenate(([0], np.cumsum(n)))
            requests = sums[low + 1:high + 1] - sums[np.searchsorted(at, at[low:high] - width, side="right")]
            over = requests > limit
            subject = {name: [None if pd.isna(k) else k] * int(over.sum()) for name, k in zip(names, key)}
            yield pd.DataFrame({**subject, "_moment": at[low:high][over], "requests": requests[over]})
        if passed >= end:
            state.remove()
            return
        needed = at > max(passed, start) - width
        at, n = at[needed], n[needed]
        state.update((at.tolist(), n.tolist(), max(passed, start - 1)))
        waiting = at[at > max(passed, start - 1)]
        wake = int(waiting[0]) if len(waiting) else end
        state.setTimeoutTimestamp(max(-(-wake // 1000), passed // 1000 + 1))

    return step


def sla_monitor(
    events: DataFrame, time: str, column: str, threshold: float, operator: str = "<=", window: str = "1 hour",
    delay: str = "10 minutes",
) -> DataFrame:
    """Valid, compliant and breaching counts per tumbling window."""
    value = F.col(column).try_cast("double")
    counted = _event_time(events, time, delay).groupBy(F.window("_at", window).alias("_w")).agg(
        F.count(value).alias("valid_count"), F.count_if(complies(value, threshold, operator)).alias("compliant_count")
    )
    return counted.select(
        F.col("_w.start").cast("timestamp_ntz").alias("window_start"), "valid_count", "compliant_count",
        (F.col("valid_count") - F.col("compliant_count")).alias("breach_count"),
    )


def feedback_fold(events: DataFrame) -> DataFrame:
    """Running counters, confidence and status per pattern; use the update output mode.

    ``events``: ``pattern_id, event_type ('usage' or 'feedback'), feedback``.
    """
    return confidence_and_status(events.groupBy("pattern_id").agg(
        F.count_if(F.col("event_type") == "usage").alias("usage_count"),
        F.count_if((F.col("event_type") == "feedback") & (F.col("feedback") == "positive")).alias("success_count"),
        F.count_if((F.col("event_type") == "feedback") & (F.col("feedback") == "negative")).alias("failure_count"),
        F.count_if(
            (F.col("event_type") == "feedback") & ~F.coalesce(F.col("feedback").isin("positive", "negative"), F.lit(False))
        ).alias("neutral_count"),
    ))
