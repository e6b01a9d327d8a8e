"""Pearson, Spearman and Kendall correlation of column pairs, pairwise complete."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewise.functions.numeric import finite
from tablewise.operators.joins import lookup_join
from tablewise.operators.ordering import average_ranks
from tablewise.operators.shape import numeric_columns
from tablewise.session import reliable_checkpoint

# Kendall compares ranks digit by digit in this base, and chunks the second rank.
DIGIT_BITS = 3
DIGITS = 1 << DIGIT_BITS
RANK_CHUNK = 65_536


def corr_pearson(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``left_column, right_column, correlation`` of every pair, from one aggregate."""
    pairs = list(combinations(columns or numeric_columns(df), 2))
    measures = []
    for i, (a, b) in enumerate(pairs):
        x, y = finite(F.col(a)), finite(F.col(b))
        measures += [
            F.covar_samp(x, y).alias(f"_c{i}"),
            F.stddev_samp(F.when(y.isNotNull(), x)).alias(f"_x{i}"),
            F.stddev_samp(F.when(x.isNotNull(), y)).alias(f"_y{i}"),
        ]
    cells = F.array(*[
        F.struct(
            F.lit(a).alias("left_column"),
            F.lit(b).alias("right_column"),
            F.try_divide(F.col(f"_c{i}"), F.col(f"_x{i}") * F.col(f"_y{i}")).alias("correlation"),
        )
        for i, (a, b) in enumerate(pairs)
    ])
    return df.agg(*measures).select(F.explode(cells).alias("_p")).select("_p.*")


def _complete_pairs(df: DataFrame, left: str, right: str) -> DataFrame:
    pairs = df.select(finite(F.col(left)).alias("x"), finite(F.col(right)).alias("y"))
    return pairs.where(F.col("x").isNotNull() & F.col("y").isNotNull())


def corr_spearman(df: DataFrame, left: str, right: str) -> DataFrame:
    """Pearson on average ranks of one pair; the ranks come from per-value counts."""
    pairs = _complete_pairs(df, left, right)
    cells = reliable_checkpoint(pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("cell")))
    rank_x = average_ranks(cells, "x", count="cell").select(F.col("x").alias("_x"), F.col("average_rank").alias("rx"))
    rank_y = average_ranks(cells, "y", count="cell").select(F.col("y").alias("_y"), F.col("average_rank").alias("ry"))
    ranked = lookup_join(cells, rank_x, "x", "_x")
    ranked = lookup_join(ranked, rank_y, "y", "_y")
    middle = cells.agg(((F.sum("cell") + 1) / 2.0).alias("_mid"))
    dx, dy = F.col("rx") - F.col("_mid"), F.col("ry") - F.col("_mid")
    sums = ranked.crossJoin(F.broadcast(middle)).agg(
        F.sum(F.col("cell") * dx * dy).alias("xy"),
        F.sum(F.col("cell") * dx * dx).alias("xx"),
        F.sum(F.col("cell") * dy * dy).alias("yy"),
    )
    return sums.select(
        F.lit(left).alias("left_column"),
        F.lit(right).alias("right_column"),
        F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy")).alias("correlation"),
    )


def _tied_pairs(counts: DataFrame, by: str, output: str) -> DataFrame:
    tied = counts.groupBy(by).agg(F.sum("cell").cast("double").alias("_t"))
    return tied.agg(F.sum(F.col("_t") * (F.col("_t") - 1) / 2).alias(output))


def corr_kendall(
    df: DataFrame, left: str, right: str, *, rank_chunk: int = RANK_CHUNK
) -> DataFrame:
    """Kendall tau-b without comparing pairs of rows.

    Rows collapse to distinct (x, y) cells with dense ranks. Two cells are concordant at
    exactly one digit position of their x ranks: the first where they differ. So for every
    position, cells that share the earlier digits are scanned in y order with a running count
    per digit, in chunks of the y rank with offsets for earlier chunks. That is one shuffle of
    cells times digits instead of all pairs.
    """
    cells = reliable_checkpoint(_complete_pairs(df, left, right).groupBy("x", "y").agg(F.count(F.lit(1)).alias("cell")))
    ranks = {
        side: average_ranks(cells, side, count="cell").select(
            F.col(side).alias(f"_{side}"), (F.col("dense_rank") - 1).alias(f"{side}r")
        )
        for side in ("x", "y")
    }
    # Two scalars that set how many digits the ranks have; the shorter side goes by digit.
    distinct_x, distinct_y = cells.agg(F.count_distinct("x"), F.count_distinct("y")).first()
    by_digit, by_scan = ("xr", "yr") if distinct_x <= distinct_y else ("yr", "xr")
    positions = max(1, -(-max(1, min(distinct_x, distinct_y) - 1).bit_length() // DIGIT_BITS))

    cells = lookup_join(cells, ranks["x"], "x", "_x")
    # Five branches read the ranked cells from here on.
    cells = reliable_checkpoint(lookup_join(cells, ranks["y"], "y", "_y").select("xr", "yr", "cell"))

    levels = F.array(*[
        F.struct(
            F.lit(position).alias("position"),
            F.shiftright(by_digit, DIGIT_BITS * (positions - position)).alias("prefix"),
            F.shiftright(by_digit, DIGIT_BITS * (positions - 1 - position)).bitwiseAND(DIGITS - 1).alias("digit"),
        )
        for position in range(positions)
    ])
    digit_counts = (
        cells.select(F.explode(levels).alias("_l"), F.col(by_scan).alias("scan"), "cell")
        .groupBy("_l.position", "_l.prefix", "scan")
        .agg(*[
            F.sum(F.when(F.col("_l.digit") == d, F.col("cell")).otherwise(0)).cast("double").alias(f"d{d}")
            for d in range(DIGITS)
        ])
        .withColumn("chunk", F.floor(F.col("scan") / rank_chunk))
    )
    group = ["position", "prefix"]
    chunk_sums = digit_counts.groupBy(*group, "chunk").agg(*[F.sum(f"d{d}").alias(f"s{d}") for d in range(DIGITS - 1)])
    earlier = Window.partitionBy(*group).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunk_sums.select(
        *group, "chunk", *[F.coalesce(F.sum(f"s{d}").over(earlier), F.lit(0.0)).alias(f"o{d}") for d in range(DIGITS - 1)]
    )
    before = Window.partitionBy(*group, "chunk").orderBy("scan").rowsBetween(Window.unboundedPreceding, -1)
    running = digit_counts.select(
        *group, "chunk", *[f"d{d}" for d in range(DIGITS)],
        *[F.coalesce(F.sum(f"d{d}").over(before), F.lit(0.0)).alias(f"r{d}") for d in range(DIGITS - 1)],
    ).join(offsets, [*group, "chunk"])
    smaller = F.lit(0.0)
    concordant = F.lit(0.0)
    for d in range(1, DIGITS):
        smaller = smaller + F.col(f"r{d - 1}") + F.col(f"o{d - 1}")
        concordant = concordant + F.col(f"d{d}") * smaller
    found = running.agg(F.coalesce(F.sum(concordant), F.lit(0.0)).alias("con"))

    n = F.col("n")
    totals = (
        cells.agg(
            F.sum("cell").cast("double").alias("n"), F.sum(F.col("cell") * (F.col("cell") - 1) / 2).alias("both")
        )
        .crossJoin(_tied_pairs(cells, "xr", "tx"))
        .crossJoin(_tied_pairs(cells, "yr", "ty"))
        .crossJoin(found)
        .withColumn("n0", n * (n - 1) / 2)
    )
    discordant = F.col("n0") - F.col("tx") - F.col("ty") + F.col("both") - F.col("con")
    return totals.select(
        F.lit(left).alias("left_column"),
        F.lit(right).alias("right_column"),
        F.try_divide(
            F.col("con") - discordant, F.sqrt(F.col("n0") - F.col("tx")) * F.sqrt(F.col("n0") - F.col("ty"))
        ).alias("correlation"),
    )


def top_correlated_pairs(correlations: DataFrame, limit: int = 10) -> DataFrame:
    """Pairs by descending absolute correlation."""
    return (
        correlations.where(F.col("correlation").isNotNull())
        .withColumn("correlation_abs", F.abs("correlation"))
        .orderBy(F.desc("correlation_abs"), "left_column", "right_column")
        .limit(limit)
    )
