"""Column semantics, informativeness and column picking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.dates import from_excel_serial, parse_compact, parse_strict, parse_text
from tablewise.functions.text import normalize_name
from tablewise.operators.shape import is_missing, row_to_long, value_counts

# Name terms of the column rules.
DATE_TERMS = (
    "data", "date", "creazione", "agg", "update", "updated", "created", "timestamp", "sottoscrizione",
    "attivazione", "chiusura", "apertura", "fine", "inizio",
)
IDENTIFIER_TERMS = (
    "id", "pyid", "pzinskey", "uuid", "guid", "key", "idcontratto", "idcontrattotlm", "contrattoid",
    "contractid", "serialnumber", "serial", "codicefiscale",
)
STATUS_TERMS = ("status", "stato", "state", "esito")
DURATION_TERMS = ("tempo", "duration", "durata", "giorni", "attivazione", "sla")
AMOUNT_TERMS = ("amount", "importo", "revenue", "costo", "cost", "prezzo")
BOOLEAN_VALUES = ("true", "false", "0", "1", "yes", "no", "si", "sì")
CHART_IDENTIFIER_TERMS = (
    "id", "pyid", "pzinskey", "uuid", "guid", "key", "idcontratto", "idcontrattotlm", "contrattoid",
    "contractid", "smartmoveid", "serialnumber", "codicefiscale",
)
CHART_METRIC_TERMS = (
    "amount", "importo", "tempo", "tempoattivazione", "duration", "durata", "processing", "volume", "count",
    "error", "rate", "sla", "score", "revenue", "cost",
)
CHART_DATE_TERMS = (
    "date", "data", "time", "timestamp", "created", "updated", "giorno", "mese", "creazione", "agg",
    "sottoscrizione", "attivazione", "chiusura", "apertura",
)
CHART_CODE_TERMS = ("code", "codice", "cod", "key")
BUSINESS_TYPES = ("METRIC", "AMOUNT", "PERCENTAGE", "DURATION")
FORBIDDEN_TYPES = ("IDENTIFIER", "CODE", "EMAIL", "PHONE")


def name_matches(column: str, terms: Sequence[str], match: str = "substring") -> bool:
    """Substring of the squeezed name, or a whole word of it with ``match='token'``."""
    if match == "token":
        return bool(set(normalize_name(column, " ").split()) & set(terms))
    name = normalize_name(column)
    return any(term in name for term in terms)


def _kind(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "text"


def _date_candidate(df: DataFrame, column: str) -> Column:
    """The column read as a date for the parse-ratio test."""
    kind, value = _kind(df.schema[column].dataType), F.col(f"`{column}`")
    if kind == "datetime":
        return value.cast("timestamp_ntz")
    if kind == "numeric":
        digits = F.when(value == F.floor(value), value.cast("bigint").cast("string"))
        serial = F.when(value.between(20000, 60000), from_excel_serial(value))
        return F.coalesce(parse_compact(digits), serial)
    return parse_strict(value)


def column_facts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: rows, known values, distinct values, date-parse and clock-time ratios, dominant
    value. One pass for the counts of every (column, value), one for the date tests."""
    names = list(columns or df.columns)
    counts = value_counts(df, names)
    boolean_like = F.lower(F.trim("value")).isin(*BOOLEAN_VALUES)
    known = F.col("value").isNotNull()
    facts = counts.groupBy("column").agg(
        F.sum("count").alias("row_count"),
        F.sum(F.when(known, F.col("count")).otherwise(0)).alias("non_null_count"),
        F.count("value").alias("distinct_count"),
        F.count_if(known & ~boolean_like).alias("_other_values"),
        F.max(F.when(known, F.struct(F.col("count"), F.col("value")))).alias("_most"),
        F.min(F.when(known, F.struct((-F.col("count")).alias("count"), F.col("value")))).alias("_top"),
    )
    dated = [c for c in names if name_matches(c, DATE_TERMS) or name_matches(c, CHART_DATE_TERMS)]
    measures = []
    for c in names:
        parsed = _date_candidate(df, c) if c in dated else F.lit(None).cast("timestamp_ntz")
        clock = F.hour(parsed) + F.minute(parsed) + F.second(parsed)
        measures += [
            F.avg(parsed.isNotNull().cast("double")).alias(f"{c}__date_ratio"),
            F.coalesce(F.avg((clock > 0).cast("double")), F.lit(0.0)).alias(f"{c}__time_ratio"),
            F.lit(_kind(df.schema[c].dataType)).alias(f"{c}__kind"),
            F.lit(names.index(c)).alias(f"{c}__position"),
        ]
    dates = row_to_long(df.agg(*measures), names, ["date_ratio", "time_ratio", "kind", "position"])
    return (
        facts.join(F.broadcast(dates), "column")
        .withColumn("dominant_value", F.col("_top.value"))
        .withColumn("dominant_count", F.coalesce(F.col("_most.count"), F.lit(0)))
        .withColumn("boolean_like", (F.col("_other_values") == 0) & (F.col("distinct_count") > 0))
        .drop("_other_values", "_most", "_top")
    )


def _named(columns: Sequence[str], terms: Sequence[str], match: str = "substring") -> Column:
    hits = [c for c in columns if name_matches(c, terms, match)]
    return F.col("column").isin(*hits) if hits else F.lit(False)


def _category_limit() -> Column:
    return F.least(F.lit(50), F.greatest(F.lit(10), F.floor(F.col("row_count") * 0.5)))


def column_semantics(df: DataFrame, columns: Sequence[str] | None = None, match: str = "substring") -> DataFrame:
    """``column, semantic_type, confidence, cardinality, unique_ratio, dtype`` by ordered rules.

    ``match='substring'`` treats every name that contains "id" or "key" as an identifier;
    ``'token'`` only whole words.
    """
    names = list(columns or df.columns)
    facts = column_facts(df, names)
    distinct, unique = F.col("distinct_count"), F.col("distinct_count") / F.greatest(F.lit(1), F.col("non_null_count"))
    dated = _named(names, DATE_TERMS, match) & (F.col("date_ratio") >= 0.3)
    rules: list[tuple[Column, Column | str, float]] = [
        (_named(names, DURATION_TERMS, match), "DURATION", 0.88),
        (dated, F.when(F.col("time_ratio") >= 0.1, "DATETIME").otherwise("DATE"), 0.92),
        (_named(names, IDENTIFIER_TERMS, match), "IDENTIFIER", 0.95),
        (F.col("kind") == "boolean", "BOOLEAN", 0.98),
        (F.col("boolean_like"), "BOOLEAN", 0.9),
        (_named(names, STATUS_TERMS, match), "STATUS", 0.9),
        (_named(names, AMOUNT_TERMS, match), "AMOUNT", 0.88),
        (F.col("kind") == "datetime", "DATETIME", 0.9),
        ((F.col("kind") == "numeric") & (F.col("row_count") >= 10) & (unique >= 0.95), "IDENTIFIER", 0.78),
        (F.col("kind") == "numeric", "METRIC", 0.75),
        ((distinct >= 2) & (distinct <= _category_limit()), "CATEGORY", 0.75),
        (distinct > _category_limit(), "CODE", 0.65),
    ]
    kind = confidence = None
    for condition, label, score in rules:
        value = F.lit(label) if isinstance(label, str) else label
        kind = F.when(condition, value) if kind is None else kind.when(condition, value)
        confidence = F.when(condition, score) if confidence is None else confidence.when(condition, score)
    return facts.select(
        "column",
        kind.otherwise("UNKNOWN").alias("semantic_type"),
        confidence.otherwise(0.4).alias("confidence"),
        F.col("distinct_count").alias("cardinality"),
        F.round(unique, 4).alias("unique_ratio"),
        F.col("kind").alias("dtype"),
        "position",
    )


def column_informativeness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Whether a column is worth a chart, and why not."""
    names = list(columns or df.columns)
    facts = column_facts(df, names)
    rows, distinct = F.col("row_count"), F.col("distinct_count")
    kind = (
        F.when(_named(names, CHART_IDENTIFIER_TERMS), "IDENTIFIER")
        .when(_named(names, CHART_METRIC_TERMS), "METRIC")
        .when(
            _named(names, CHART_DATE_TERMS)
            & (F.round(F.col("date_ratio") * rows) >= F.greatest(F.lit(2), F.floor(rows * 0.3))), "DATE"
        )
        .when((F.col("kind") == "boolean") | F.col("boolean_like"), "BOOLEAN")
        .when((F.col("kind") == "numeric") & (distinct / rows > 0.9) & (rows >= 10), "IDENTIFIER")
        .when(F.col("kind") == "numeric", "METRIC")
        .when(_named(names, CHART_CODE_TERMS), "CODE")
        .when((distinct >= 2) & (distinct <= _category_limit()), "CATEGORY")
        .when(distinct > _category_limit(), "CODE")
        .otherwise("UNKNOWN")
    )
    share = F.col("dominant_count") / rows
    typed = facts.withColumn("semantic_type", kind)
    reason = (
        F.when(F.col("semantic_type") == "IDENTIFIER", "identifier")
        .when((F.col("semantic_type") == "CODE") & ((distinct > 30) | (distinct / rows > 0.5)), "technical_code_high_cardinality")
        .when(distinct <= 1, "constant")
        .when(share > 0.95, "quasi_constant")
        .when((F.col("semantic_type") == "CATEGORY") & ((distinct < 2) | (distinct > _category_limit())), "category_not_informative")
        .when(F.col("semantic_type").isin("TEXT", "UNKNOWN"), "unsupported_semantic_type")
        .otherwise("")
    )
    return typed.select(
        "column",
        "semantic_type",
        reason.alias("reason"),
        (reason == "").alias("chart_allowed"),
        "distinct_count",
        F.round(share, 4).alias("dominant_ratio"),
        "dominant_value",
        (rows - F.col("non_null_count")).alias("missing_count"),
        (F.col("non_null_count") - distinct).alias("duplicate_count"),
    )


def business_metrics(semantics: DataFrame) -> DataFrame:
    """Columns that may be analysed as metrics."""
    return semantics.where(F.col("semantic_type").isin(*BUSINESS_TYPES)).select("column", "semantic_type")


def forbidden_columns(semantics: DataFrame) -> DataFrame:
    return semantics.where(F.col("semantic_type").isin(*FORBIDDEN_TYPES)).select("column", "semantic_type")


def pick_metric(semantics: DataFrame) -> DataFrame:
    """First numeric business metric in column order."""
    found = semantics.where(F.col("semantic_type").isin(*BUSINESS_TYPES) & (F.col("dtype") == "numeric"))
    return found.orderBy("position").limit(1).select("column", "semantic_type")


def pick_dimension(semantics: DataFrame, rows: int | None, request_tokens: Sequence[str] = ()) -> DataFrame:
    """Categorical columns by request-token prefix matches, then usefulness, then position."""
    tokens = [t.lower() for t in request_tokens if len(t) >= 4]
    parts = F.filter(F.split(F.regexp_replace(F.lower("column"), "[^a-z0-9]+", " "), " "), lambda t: F.length(t) >= 4)
    heads = F.array(*[F.lit(t[:5]) for t in tokens]) if tokens else F.array().cast("array<string>")
    matches = F.size(F.filter(parts, lambda t: F.array_contains(heads, F.substring(t, 1, 5))))
    limit = F.greatest(F.lit(50), F.floor(F.lit(rows or 0) * 0.5))
    useful = F.when(F.col("cardinality").between(1, limit), 1).otherwise(0)
    return (
        semantics.where(F.col("dtype").isin("text", "boolean") & (F.col("semantic_type") != "IDENTIFIER"))
        .select("column", "cardinality", matches.alias("matches"), useful.alias("useful"), "position")
        .where((F.col("matches") > 0) | (F.col("useful") > 0))
        .orderBy(F.desc("matches"), F.desc("useful"), "position")
    )


def pick_time_axis(df: DataFrame, minimum: float = 0.2) -> str | None:
    """First temporal column, else the first date-named text column that mostly parses."""
    temporal = [f.name for f in df.schema if _kind(f.dataType) == "datetime"]
    if temporal:
        return temporal[0]
    named = [f.name for f in df.schema if _kind(f.dataType) == "text" and name_matches(f.name, DATE_TERMS + ("time",))]
    if not named:
        return None
    ratios = df.agg(*[F.avg(parse_text(F.col(f"`{c}`")).isNotNull().cast("double")).alias(c) for c in named]).first()
    return next((c for c in named if (ratios[c] or 0.0) >= minimum), None)


def pick_pair(
    df: DataFrame, start_terms: Sequence[str], end_terms: Sequence[str], minimum: float = 0.2
) -> tuple[str, str] | None:
    """First start and end date columns whose names hold one of the terms."""
    def candidates(terms: Sequence[str]) -> list[str]:
        return [c for c in df.columns if any(t in c.lower().replace("_", " ") for t in terms)]

    names = sorted(set(candidates(start_terms)) | set(candidates(end_terms)))
    if not names:
        return None
    ratios = df.agg(*[
        F.avg(_any_date(df, c).isNotNull().cast("double")).alias(c) for c in names
    ]).first()
    valid = {c for c in names if (ratios[c] or 0.0) >= minimum}
    start = next((c for c in candidates(start_terms) if c in valid), None)
    end = next((c for c in candidates(end_terms) if c in valid and c != start), None)
    return (start, end) if start and end else None


def _any_date(df: DataFrame, column: str) -> Column:
    kind = _kind(df.schema[column].dataType)
    return parse_text(F.col(f"`{column}`")) if kind == "text" else _date_candidate(df, column)


def missing_rows(df: DataFrame, column: str) -> DataFrame:
    return df.where(is_missing(df, column))
