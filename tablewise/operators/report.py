"""Numbers behind reports and charts: histograms, box statistics, KPI, segment and quality rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.functions.numeric import safe_ratio
from tablewise.operators.aggregates import summary_numeric
from tablewise.operators.ordering import exact_quantiles
from tablewise.operators.quality import completeness_total, duplicate_detection
from tablewise.operators.shape import long_numbers, null_label, value_counts


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 30) -> DataFrame:
    """``column, bin (1..bins), lower, upper, count`` over equal-width bins; empty bins kept."""
    cells = long_numbers(df, columns).where(F.col("value").isNotNull())
    ends = cells.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    number = F.when(F.col("hi") == F.col("lo"), 1).otherwise(
        F.least(F.lit(bins), (F.floor((F.col("value") - F.col("lo")) / width) + 1).cast("int"))
    )
    counted = (
        cells.join(F.broadcast(ends), "column")
        .groupBy("column", number.alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    spine = ends.select("column", "lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return spine.join(counted, ["column", "bin"], "left").select(
        "column",
        "bin",
        (F.col("lo") + width * (F.col("bin") - 1)).alias("lower"),
        (F.col("lo") + width * F.col("bin")).alias("upper"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def box_stats(df: DataFrame, metric: str, group: str | None = None) -> DataFrame:
    """Five-number summary, mean and sample std of a metric, overall or per group."""
    name = group or "group"
    rows = df.select(
        (F.col(group) if group else F.lit("all")).alias(name), F.col(metric).cast("double").alias("_x")
    ).where(F.col("_x").isNotNull())
    stats = rows.groupBy(name).agg(F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("std"))
    marks = exact_quantiles(rows, "_x", [0.0, 0.25, 0.5, 0.75, 1.0], [name])
    five = [F.col("quantiles")[i].alias(n) for i, n in enumerate(("min", "q1", "median", "q3", "max"))]
    joined = stats.join(marks.withColumnRenamed(name, "_g"), F.col(name).eqNullSafe(F.col("_g")))
    return joined.select(name, "n", *five, "mean", "std")


def kpi_rows(df: DataFrame, metrics: Sequence[str], limit: int | None = None) -> DataFrame:
    """Row and column counts, then mean, sum, min and max of the metrics."""
    summary = summary_numeric(df, list(metrics))
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in ("mean", "sum", "min", "max")])
    per_metric = summary.select("column", F.explode(cells).alias("_c")).select(
        F.concat_ws(" ", "_c.measure", "column").alias("name"), F.col("_c.value").alias("value"),
        F.lit("numeric_metric").alias("kind"),
    )
    shape = df.agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("rows").alias("name"), "value", F.lit("volume").alias("kind")
    )
    width = shape.select(F.lit("columns").alias("name"), F.lit(float(len(df.columns))).alias("value"), F.lit("structure").alias("kind"))
    united = shape.unionByName(width).unionByName(per_metric).dropDuplicates(["name", "value"])
    first = F.when(F.col("kind") == "volume", 0).when(F.col("kind") == "structure", 1).otherwise(2)
    ordered = united.orderBy(first, "name")
    return ordered.limit(limit) if limit else ordered


def segment_leaders(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Leading value and its share of all rows, for columns worth segmenting by."""
    counts = value_counts(df, columns).groupBy("column", null_label(F.col("value")).alias("value")).agg(
        F.sum("count").alias("count")
    )
    per_column = counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("segments"),
        F.min_by("value", F.struct(-F.col("count"), "value")).alias("leading_segment"),
        F.max("count").alias("leading_value"),
        F.sum("count").alias("_all"),
    )
    share = safe_ratio(F.col("leading_value"), F.col("_all"))
    return per_column.where((F.col("segments") > 1) & (share < 0.95)).select(
        "column", "segments", "leading_segment", "leading_value",
        F.round(share * 100, 2).alias("leading_share_percent"),
    )


def quality_rows(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and duplicates as ``note, value``."""
    totals = completeness_total(df).crossJoin(duplicate_detection(df).select("duplicate_rows"))
    cells = F.array(
        F.struct(F.lit("rows").alias("note"), F.col("row_count").alias("value")),
        F.struct(F.lit("columns").alias("note"), F.col("column_count").alias("value")),
        F.struct(F.lit("missing_cells").alias("note"), F.col("total_missing").alias("value")),
        F.struct(F.lit("duplicate_rows").alias("note"), F.col("duplicate_rows").alias("value")),
    )
    return totals.select(F.explode(cells).alias("_c")).select("_c.note", "_c.value")
