"""Completeness, duplicates, thresholds and quality gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.functions.numeric import to_number
from tablewise.operators.joins import lookup_join
from tablewise.operators.shape import is_missing, row_to_long

OPERATORS = ("<=", "<", ">=", ">", "==", "!=")


def _missing_long(df: DataFrame) -> DataFrame:
    """``column, missing_count, row_count`` from one aggregate."""
    names = df.columns
    row = df.agg(
        *[F.count_if(is_missing(df, c)).alias(f"{c}__missing_count") for c in names],
        *[F.count(F.lit(1)).alias(f"{c}__row_count") for c in names],
    )
    return row_to_long(row, names, ["missing_count", "row_count"])


def completeness(df: DataFrame) -> DataFrame:
    """Missing and complete counts and percentages per column."""
    complete = F.col("row_count") - F.col("missing_count")
    return _missing_long(df).select(
        "column",
        "missing_count",
        F.round(F.coalesce(F.try_divide(F.col("missing_count") * 100.0, F.col("row_count")), F.lit(0.0)), 4).alias(
            "missing_percent"
        ),
        complete.alias("complete_count"),
        F.round(F.coalesce(F.try_divide(complete * 100.0, F.col("row_count")), F.lit(0.0)), 4).alias(
            "completeness_percent"
        ),
    )


def completeness_total(df: DataFrame) -> DataFrame:
    """Row, column, cell and missing totals and the overall completeness."""
    return _missing_long(df).agg(
        F.max("row_count").alias("row_count"),
        F.count(F.lit(1)).alias("column_count"),
        F.sum("row_count").alias("total_cells"),
        F.sum("missing_count").alias("total_missing"),
        F.round(
            F.coalesce(
                F.try_divide((F.sum("row_count") - F.sum("missing_count")) * 100.0, F.sum("row_count")), F.lit(0.0)
            ),
            4,
        ).alias("overall_completeness_percent"),
    )


def null_detection(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Columns with nulls, most first, with the table-wide total on each row."""
    # One row per column of the table, so the window stays tiny.
    cells = _missing_long(df).withColumn("total_nulls", F.sum("missing_count").over(Window.partitionBy(F.lit(0))))
    found = (
        cells.where(F.col("missing_count") > 0)
        .select(
            "column",
            F.col("missing_count").alias("null_count"),
            F.round(F.col("missing_count") / F.col("row_count") * 100, 2).alias("null_percent"),
            "total_nulls",
        )
        .orderBy(F.desc("null_count"), "column")
    )
    return found.limit(limit) if limit else found


def _repeated_rows(df: DataFrame) -> DataFrame:
    """Every repeated row once, with ``_copies``; nulls compare equal.

    The table is first reduced to rows whose 64-bit hash occurs twice, so whole rows of
    mostly unique data are never shuffled; the exact grouping then drops chance collisions.
    """
    names = [F.col(f"`{c}`") for c in df.columns]
    hashed = df.withColumn("_hash", F.xxhash64(*names))
    twice = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(F.col("_hash").alias("_twice"))
    rows = lookup_join(hashed, twice, "_hash", "_twice", "left_semi").drop("_hash")
    return rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_copies")).where(F.col("_copies") > 1)


def duplicate_detection(df: DataFrame) -> DataFrame:
    """Row count, surplus copies and rows that have a copy; nulls compare equal."""
    total = df.agg(F.count(F.lit(1)).alias("row_count"))
    copies = F.col("_copies")
    repeated = _repeated_rows(df).agg(
        F.coalesce(F.sum(copies - 1), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum(copies), F.lit(0)).alias("duplicate_groups_rows"),
    )
    return total.crossJoin(F.broadcast(repeated))


def duplicate_sample(df: DataFrame, limit: int = 5) -> DataFrame:
    """A few of the repeated rows with their number of copies."""
    repeated = _repeated_rows(df).withColumnRenamed("_copies", "copies")
    return repeated.orderBy(F.desc("copies"), *[F.col(f"`{c}`") for c in df.columns]).limit(limit)


def validation_score(df: DataFrame) -> DataFrame:
    """100 less 10 for missing values and 5 for duplicates; 0 for an empty table."""
    totals = completeness_total(df).select("row_count", "total_missing")
    duplicates = duplicate_detection(df).select("duplicate_rows")
    score = 100 - F.when(F.col("total_missing") > 0, 10).otherwise(0) - F.when(
        F.col("duplicate_rows") > 0, 5
    ).otherwise(0)
    return totals.crossJoin(F.broadcast(duplicates)).select(
        "row_count",
        "total_missing",
        "duplicate_rows",
        F.when(F.col("row_count") == 0, 0).otherwise(score).alias("score"),
    )


def complies(value: Column, threshold: float, operator: str) -> Column:
    if operator not in OPERATORS:
        raise ValueError(f"unsupported operator: {operator}")
    limit = F.lit(float(threshold))
    return {
        "<=": value <= limit, "<": value < limit, ">=": value >= limit,
        ">": value > limit, "==": value == limit, "!=": value != limit,
    }[operator]


def threshold_check(df: DataFrame, column: str, threshold: float, operator: str = "<=") -> DataFrame:
    """Valid, compliant and breaching counts and rates of ``value operator threshold``."""
    value = to_number(F.col(column))
    counted = df.agg(
        F.count(value).alias("valid_count"),
        F.count_if(complies(value, threshold, operator)).alias("compliant_count"),
    )
    breach = F.col("valid_count") - F.col("compliant_count")
    return counted.select(
        "valid_count",
        "compliant_count",
        breach.alias("breach_count"),
        F.round(F.try_divide(F.col("compliant_count") * 100.0, F.col("valid_count")), 4).alias("compliance_rate"),
        F.round(F.try_divide(breach * 100.0, F.col("valid_count")), 4).alias("breach_rate"),
    )


def threshold_breaches(
    df: DataFrame, column: str, threshold: float, operator: str, keys: Sequence[str]
) -> DataFrame:
    """The breaching rows' keys and values."""
    value = to_number(F.col(column))
    return df.where(value.isNotNull() & ~complies(value, threshold, operator)).select(*keys, column)


def quality_gate(df: DataFrame, metric: str) -> DataFrame:
    """Negative and missing ratios of a metric; more than 5 % negatives need a decision."""
    value = to_number(F.col(metric))
    counted = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(value.isNull()).alias("missing_count"),
        F.count_if(value < 0).alias("negative_count"),
    )
    negative = F.coalesce(F.try_divide(F.col("negative_count") * 1.0, F.col("total")), F.lit(0.0))
    missing = F.coalesce(F.try_divide(F.col("missing_count") * 1.0, F.col("total")), F.lit(0.0))
    return counted.select(
        F.lit(metric).alias("metric"),
        "negative_count",
        negative.alias("negative_ratio"),
        "missing_count",
        missing.alias("missing_ratio"),
        F.when(negative > 0.05, "high").otherwise("low").alias("severity"),
        F.when(negative > 0.05, "requires_user_decision").otherwise("passed").alias("status"),
    )


def null_negatives(df: DataFrame, metric: str) -> DataFrame:
    """Negative values of the metric become null; the rows stay."""
    value = F.col(metric)
    return df.withColumn(metric, F.when(to_number(value) < 0, F.lit(None)).otherwise(value))


def positive_rows(df: DataFrame, metric: str) -> DataFrame:
    return df.where(to_number(F.col(metric)) >= 0)


def missing_severity(df: DataFrame) -> DataFrame:
    """Severity of each column with missing values: 20 % high, 5 % medium, else low."""
    percent = F.round(F.col("missing_count") / F.col("row_count") * 100, 2)
    return _missing_long(df).where(F.col("missing_count") > 0).select(
        "column",
        "missing_count",
        percent.alias("missing_percent"),
        F.when(percent >= 20, "high").when(percent >= 5, "medium").otherwise("low").alias("severity"),
    )


def segment_usefulness(df: DataFrame, columns: Sequence[str], blocked: Sequence[str] = (
    "pyid", "contrattoid", "serialnumber", "idcontrattotlm",
)) -> DataFrame:
    """Per column: number of values, leader share, and whether it is worth segmenting by."""
    from tablewise.operators.shape import null_label, value_counts

    counts = value_counts(df, columns).groupBy("column", null_label(F.col("value")).alias("value")).agg(
        F.sum("count").alias("count")
    )
    per_column = counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("segments"), (F.max("count") / F.sum("count")).alias("leader_share")
    )
    name = F.regexp_replace(F.lower("column"), "_", "")
    blocked_name = F.lit(False)
    for term in blocked:
        blocked_name = blocked_name | F.contains(name, F.lit(term))
    return per_column.select(
        "column",
        "segments",
        F.round("leader_share", 4).alias("leader_share"),
        ((F.col("segments") > 1) & (F.col("leader_share") < 0.95) & ~blocked_name).alias("useful"),
    )


def chunk_union(chunks: Sequence[DataFrame]) -> DataFrame:
    """Chunks of one query as one table."""
    result = chunks[0]
    for chunk in chunks[1:]:
        result = result.unionByName(chunk)
    return result


#: Ranges of row digests that are compared before rows are: at most as many numbers are ever broadcast.
PARITY_RANGES = 65_536
COMPLEX = ("array", "struct", "map", "variant")


def _signed_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both tables by position as ``c0, c1, ...`` with ``sign`` (1 left, -1 right), a 128-bit digest and its range."""
    if len(left.columns) != len(right.columns):
        raise ValueError("tables of unlike width cannot be compared")
    names = [f"c{i}" for i in range(len(left.columns))]
    # The types of both sides meet before anything is hashed.
    rows = left.toDF(*names).withColumn("sign", F.lit(1)).union(right.toDF(*names).withColumn("sign", F.lit(-1)))
    cells = [
        F.to_json(F.struct(f.name), {"ignoreNullFields": "false"}) if f.dataType.typeName() in COMPLEX else F.col(f.name)
        for f in rows.schema if f.name != "sign"
    ]
    # Hashes pass over nulls, so their places are hashed too.
    parts = [*cells, *[F.isnull(c) for c in names]]
    digest = F.struct(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b"))
    return rows.withColumn("digest", digest).withColumn("range", F.pmod("digest.a", F.lit(PARITY_RANGES)))


def _differing_digests(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ranges whose sums of digests differ, and the digests there with ``copies`` more on the left than on the right."""
    halves = [h for d in ("a", "b") for h in (F.col(f"digest.{d}").bitwiseAND(0xFFFFFFFF), F.shiftright(f"digest.{d}", 32))]
    sums = [F.sum(h.cast("decimal(20,0)") * F.col("sign")) for h in halves]
    compared = signed.groupBy("range").agg(F.sum("sign").alias("rows"), *[s.alias(f"s{i}") for i, s in enumerate(sums)])
    ranges = compared.where(" OR ".join(f"{c} <> 0" for c in ("rows", "s0", "s1", "s2", "s3"))).select("range")
    there = signed.select("range", "digest", "sign").join(F.broadcast(ranges), "range", "left_semi")
    return ranges, there.groupBy("range", "digest").agg(F.sum("sign").alias("copies")).where("copies <> 0")


def table_parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows only in one of two tables, duplicates counted: ``side, rows``; empty for equal tables.

    Columns meet by position, nulls equal nulls. Digests of rows are summed in 65,536 ranges, which a map-side aggregate does without a shuffle of
    rows; only digests of the ranges that differ are shuffled and counted. No row is moved, and equal tables cost one scan each.
    """
    _, digests = _differing_digests(_signed_rows(left, right))
    side = F.when(F.col("copies") > 0, "left_only").otherwise("right_only")
    return digests.groupBy(side.alias("side")).agg(F.sum(F.abs("copies")).alias("rows"))


def differing_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows behind ``table_parity``: ``side, copies`` and the columns of ``left``, one row for each distinct row.

    ``copies`` tells how many more of a row its side has. Only rows of ranges that differ are joined with the digests found there.
    """
    signed = _signed_rows(left, right)
    ranges, digests = _differing_digests(signed)
    names = [f"c{i}" for i in range(len(left.columns))]
    wanted = F.when(F.col("copies") > 0, 1).otherwise(-1)
    found = digests.select("digest", wanted.alias("sign"), F.abs("copies").alias("copies"))
    rows = signed.join(F.broadcast(ranges), "range", "left_semi").join(found, ["digest", "sign"])
    # A digest stands for one row, of which any will do.
    one = rows.groupBy("digest", "sign").agg(F.first("copies").alias("copies"), F.first(F.struct(*names)).alias("row"))
    side = F.when(F.col("sign") > 0, "left_only").otherwise("right_only").alias("side")
    return one.select(side, "copies", *[F.col(f"row.{c}").alias(name) for c, name in zip(names, left.columns)])


def field_parity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Per non-key field: rows that match, differ, or lack a partner."""
    fields = [c for c in left.columns if c != key]
    joined = left.alias("l").join(right.alias("r"), F.col(f"l.{key}") == F.col(f"r.{key}"), "full_outer")
    both = F.col(f"l.{key}").isNotNull() & F.col(f"r.{key}").isNotNull()
    row = joined.agg(*[
        measure
        for c in fields
        for measure in (
            F.count_if(both & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))).alias(f"{c}__matched"),
            F.count_if(both & ~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))).alias(f"{c}__mismatched"),
            F.count_if(~both).alias(f"{c}__unpaired"),
        )
    ])
    return row_to_long(row, fields, ["matched", "mismatched", "unpaired"], name="field")
