"""Numeric functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("low", "medium", "high", "critical")


def finite(value: Column) -> Column:
    """Null for NaN and infinities."""
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)


def to_number(value: Column) -> Column:
    """Double, or null where the text is not a finite number."""
    return finite(value.try_cast("double"))


def round_to(value: Column, digits: int = 4) -> Column:
    return F.round(finite(value), digits)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Double division, null on a zero or null denominator."""
    bottom = denominator.cast("double")
    return F.when(bottom != 0, numerator.cast("double") / bottom)


def accurate_sum(value: Column) -> Column:
    """Aggregate sum that adds whole and fractional parts apart, so long sums keep their digits
    and hardly depend on the order of the rows."""
    whole = F.floor(value).cast("double")
    return F.sum(whole) + F.sum(value - whole)


def severity_from_ratio(ratio: Column) -> Column:
    size = F.abs(finite(ratio))
    return (
        F.when(size >= 4, "critical").when(size >= 2.5, "high").when(size >= 1.25, "medium").otherwise("low")
    )


def severity_from_rate(rate: Column) -> Column:
    return F.when(rate >= 50, "critical").when(rate >= 25, "high").when(rate >= 10, "medium").otherwise("low")


def confidence_for_severity(severity: Column) -> Column:
    return (
        F.when(severity == "low", 0.55)
        .when(severity == "medium", 0.68)
        .when(severity == "high", 0.82)
        .when(severity == "critical", 0.92)
        .otherwise(0.5)
    )


def severity_rank(severity: Column) -> Column:
    """1 (low, also unknown) to 4 (critical)."""
    return F.when(severity == "critical", 4).when(severity == "high", 3).when(severity == "medium", 2).otherwise(1)


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), rank.cast("int"))


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def normalize_vector(vector: Column) -> Column:
    """Unit-length copy; null for a null or zero vector."""
    values = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(norm > 0, F.transform(values, lambda x: x / norm))


def dot(left: Column, right: Column) -> Column:
    """Inner product; 0 when the lengths differ or a side is empty."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.when(
        (F.size(left) == F.size(right)) & (F.size(left) > 0),
        F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x),
    ).otherwise(F.lit(0.0))


def cosine(left: Column, right: Column) -> Column:
    return F.coalesce(dot(normalize_vector(left), normalize_vector(right)), F.lit(0.0))


def dimension_similarity(left: Column, right: Column, logarithmic: bool) -> Column:
    """Closeness of two sizes in [0, 1]; null when one is missing or negative."""
    if logarithmic:
        closeness = 1.0 - F.least(F.abs(F.log1p(left) - F.log1p(right)) / 6.0, F.lit(1.0))
    else:
        closeness = 1.0 - F.abs(left - right) / F.greatest(left, right, F.lit(1))
    known = left.isNotNull() & right.isNotNull() & (left >= 0) & (right >= 0)
    return F.when(known, F.when(left == right, F.lit(1.0)).otherwise(clamp(closeness)))


def shape_similarity(rows_a: Column, cols_a: Column, rows_b: Column, cols_b: Column) -> Column:
    """Mean of the row and column closeness that can be computed; 0 if none."""
    rows = dimension_similarity(rows_a, rows_b, logarithmic=True)
    cols = dimension_similarity(cols_a, cols_b, logarithmic=False)
    known = rows.isNotNull().cast("int") + cols.isNotNull().cast("int")
    total = F.coalesce(rows, F.lit(0.0)) + F.coalesce(cols, F.lit(0.0))
    return F.when(known > 0, total / known).otherwise(F.lit(0.0))
