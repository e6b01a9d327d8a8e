"""Outliers by IQR fence, z-score and modified z-score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions.numeric import finite, safe_ratio
from tablewise.operators.aggregates import numeric_profile
from tablewise.operators.ordering import exact_quantiles
from tablewise.operators.shape import row_to_long

METHODS = ("iqr", "zscore", "modified_zscore")
Z_LIMIT = 3.0
MODIFIED_Z_LIMIT = 3.5


def outlier_limits(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column the statistics every method needs, one row per column."""
    profile = numeric_profile(df, columns)
    population_std = F.sqrt(F.col("variance") * (F.col("count") - 1) / F.col("count"))
    return profile.select(
        "column",
        "count",
        "median",
        "iqr",
        "mad",
        "mean",
        population_std.alias("std_pop"),
        (F.col("p25") - 1.5 * F.col("iqr")).alias("lower_bound"),
        (F.col("p75") + 1.5 * F.col("iqr")).alias("upper_bound"),
    )


# Numbers of equal rows that are made at a time.
NUMBER_BLOCK = 100_000
LIMIT_FIELDS = ("median", "iqr", "mad", "mean", "std_pop", "lower_bound", "upper_bound")


def _hit(method: str, value: Column, limits: Column) -> Column:
    """Whether ``value`` is an outlier under the limits of its column."""
    if method == "iqr":
        return (value < limits["lower_bound"]) | (value > limits["upper_bound"])
    if method == "zscore":
        return (limits["std_pop"] > 0) & (F.abs(safe_ratio(value - limits["mean"], limits["std_pop"])) > Z_LIMIT)
    if method == "modified_zscore":
        score = safe_ratio(0.6745 * (value - limits["median"]), limits["mad"])
        return (limits["mad"] > 0) & (F.abs(score) > MODIFIED_Z_LIMIT)
    raise ValueError(f"unsupported outlier method: {method}")


def _with_limits(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with the limits of all columns as one struct per column, from a single broadcast row."""
    one_row = outlier_limits(df, columns).agg(*[
        F.max(F.when(F.col("column") == c, F.struct(*LIMIT_FIELDS))).alias(f"_limits_{i}") for i, c in enumerate(columns)
    ])
    return df.crossJoin(F.broadcast(one_row))


def outlier_rows(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), methods: Sequence[str] = METHODS
) -> DataFrame:
    """One row per (row, column, method) hit: ``row_id, column, method, value`` and the limits.

    ``row_id`` is the keys as JSON, nulls kept. Where there is no key it is a hash of the row's fields and a number
    among equal rows, so that equal rows stay apart and the ids don't depend on the partitions. Rows are tested in
    place; only hits are multiplied out.
    """
    identity = (
        F.to_json(F.struct(*[F.col(k).cast("string").alias(k) for k in keys]), {"ignoreNullFields": "false"})
        if keys else F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}))
    )
    hits = []
    for i, c in enumerate(columns):
        value = finite(F.col(f"`{c}`"))
        for order, method in enumerate(methods):
            hits.append(F.when(_hit(method, value, F.col(f"_limits_{i}")), F.struct(
                F.lit(c).alias("column"), F.lit(method).alias("method"), F.lit(order).alias("method_order"),
                value.alias("value"), F.col(f"_limits_{i}").alias("limits"),
            )))
    found = _with_limits(df, columns).select(identity.alias("row_id"), F.explode(F.array_compact(F.array(*hits))).alias("_h"))
    found = found.select("row_id", "_h.column", "_h.method", "_h.method_order", "_h.value", "_h.limits.*")
    return found if keys else _numbered(found)


def _numbered(hits: DataFrame) -> DataFrame:
    """Hits with the number among equal ones in ``row_id``: counted before the shuffle, then told off in blocks."""
    counted = hits.groupBy(*hits.columns).agg(F.count(F.lit(1)).alias("_n"))
    blocks = counted.withColumn("_block", F.explode(F.sequence(F.lit(0), F.expr(f"(_n - 1) div {NUMBER_BLOCK}"))))
    left = F.least(F.lit(NUMBER_BLOCK), F.col("_n") - F.col("_block") * NUMBER_BLOCK)
    numbers = blocks.withColumn("_i", F.explode(F.sequence(F.lit(1), left.cast("int"))))
    number = (F.col("_block") * NUMBER_BLOCK + F.col("_i")).cast("string")
    return numbers.withColumn("row_id", F.concat_ws("-", "row_id", number)).select(*hits.columns)


def outlier_counts(
    df: DataFrame, columns: Sequence[str], methods: Sequence[str] = METHODS
) -> DataFrame:
    """``column, method, outlier_count, outlier_percent`` without listing the rows."""
    measures = []
    for i, c in enumerate(columns):
        value = finite(F.col(f"`{c}`"))
        measures.append(F.count(value).alias(f"{c}__valid_count"))
        measures += [F.count_if(_hit(m, value, F.col(f"_limits_{i}"))).alias(f"{c}__{m}") for m in methods]
    long = row_to_long(_with_limits(df, columns).agg(*measures), columns, ["valid_count", *methods])
    found = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("outlier_count")) for m in methods]))
    return long.where(F.col("valid_count") > 0).select("column", "valid_count", found.alias("_h")).select(
        "column",
        "_h.method",
        "_h.outlier_count",
        F.round(F.col("_h.outlier_count") / F.col("valid_count") * 100, 4).alias("outlier_percent"),
    )


def extreme_from_summary(summary: DataFrame) -> DataFrame:
    """Columns whose max or min lies beyond three std of the mean, or max/|mean| ≥ 5."""
    mean, std = F.col("mean"), F.col("std")
    three_sigma = (std > 0) & ((F.col("max") > mean + 3 * std) | (F.col("min") < mean - 3 * std))
    ratio = F.coalesce(safe_ratio(F.col("max"), F.abs(mean)) >= 5, F.lit(False))
    return summary.where(three_sigma | ratio).select("column", "min", "max", "mean", "std")


def subset_vs_baseline(
    df: DataFrame, subset: Column, metric: str
) -> DataFrame:
    """Median, p95 and outlier ratio of the non-negative metric, subset against all rows."""
    rows = df.select(F.coalesce(subset, F.lit(False)).alias("_in"), F.col(metric).cast("double").alias("_x"))
    sides = F.when(F.col("_in"), F.array(F.lit("baseline"), F.lit("subset"))).otherwise(F.array(F.lit("baseline")))
    both = rows.select(F.explode(sides).alias("side"), "_x")
    counts = rows.agg(F.count(F.lit(1)).alias("baseline_rows"), F.count_if("_in").alias("subset_rows"))
    positive = both.where(F.col("_x") >= 0)
    quantiles = exact_quantiles(positive, "_x", [0.25, 0.5, 0.75, 0.95], ["side"])
    fences = quantiles.select(
        "side",
        F.col("quantiles")[1].alias("median"),
        F.col("quantiles")[3].alias("p95"),
        (F.col("quantiles")[2] + 1.5 * (F.col("quantiles")[2] - F.col("quantiles")[0])).alias("_fence"),
    )
    ratios = (
        positive.join(F.broadcast(fences), "side")
        .groupBy("side")
        .agg(
            F.max("median").alias("median"), F.max("p95").alias("p95"),
            F.avg((F.col("_x") > F.col("_fence")).cast("double")).alias("ratio"),
        )
    )

    def of(side: str, field: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(field)))

    wide = ratios.agg(*[
        of(side, field).alias(f"{side}_{field}") for side in ("baseline", "subset") for field in ("median", "p95", "ratio")
    ])

    def pct(field: str) -> Column:
        base = F.col(f"baseline_{field}")
        return safe_ratio(F.col(f"subset_{field}") - base, F.abs(base)) * 100

    return counts.crossJoin(F.broadcast(wide)).select(
        "baseline_rows",
        "subset_rows",
        "baseline_median",
        "subset_median",
        "baseline_p95",
        "subset_p95",
        pct("median").alias("median_pct"),
        pct("p95").alias("p95_pct"),
        (F.coalesce("subset_ratio", F.lit(0.0)) - F.coalesce("baseline_ratio", F.lit(0.0))).alias("outlier_ratio_delta"),
        F.when(pct("p95") > 10, "subset_worse").when(pct("p95") < -10, "subset_better").otherwise(
            "subset_similar"
        ).alias("conclusion"),
    )
