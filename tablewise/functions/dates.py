"""Date and time functions on columns. Results are zone-free (TIMESTAMP_NTZ)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The formats accepted without guessing, day first.
STRICT_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
    "d/M/yyyy HH:mm:ss",
    "d/M/yyyy HH:mm",
    "d/M/yyyy",
    "d-M-yyyy",
)
EXCEL_FIRST, EXCEL_LAST = 20000, 60000


def _parse(text: Column, fmt: str) -> Column:
    return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")


def parse_strict(text: Column) -> Column:
    """First of the fixed formats that fits; null otherwise."""
    clean = F.trim(text.cast("string"))
    return F.coalesce(*[_parse(clean, fmt) for fmt in STRICT_FORMATS])


def parse_compact(digits: Column) -> Column:
    """``yyyymmdd`` or ``yyyymmddHHMMSS``."""
    return (
        F.when(F.length(digits) == 8, _parse(digits, "yyyyMMdd"))
        .when(F.length(digits) == 14, _parse(digits, "yyyyMMddHHmmss"))
    )


def from_excel_serial(days: Column) -> Column:
    """Days since 1899-12-30, fractions kept."""
    seconds = F.round(days.cast("double") * 86400.0, 6).cast("decimal(18,6)")
    return F.lit("1899-12-30").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def parse_text(text: Column) -> Column:
    """Compact digits, then Excel serial, then common written formats; null if none fits."""
    clean = F.trim(text.cast("string"))
    number = clean.try_cast("double")
    compact = parse_compact(F.regexp_replace(clean, r"\D", ""))
    serial = F.when(number.between(EXCEL_FIRST, EXCEL_LAST), from_excel_serial(number))
    written = F.when(
        number.isNull(),
        F.coalesce(
            clean.try_cast("timestamp_ntz"),
            _parse(clean, "M/d/yyyy HH:mm:ss"),
            _parse(clean, "M/d/yyyy HH:mm"),
            _parse(clean, "M/d/yyyy"),
            parse_strict(clean),
        ),
    )
    return F.coalesce(compact, serial, written)


def _whole_digits(number: Column) -> Column:
    value = number.cast("double")
    whole = F.when((value == F.floor(value)) & (F.abs(value) < 1e15), value.cast("bigint").cast("string"))
    return F.when(F.length(whole).isin(8, 14), whole)


def parse_numeric(df: DataFrame, column: str, output: str) -> DataFrame:
    """Read a numeric column as dates; the reading is chosen once for the whole column."""
    number = F.col(column).cast("double")
    shares = df.select(
        F.avg(F.when(number.isNotNull(), _whole_digits(number).isNotNull().cast("double"))).alias("_compact"),
        F.avg(number.between(EXCEL_FIRST, EXCEL_LAST).cast("double")).alias("_serial"),
    )
    parsed = (
        F.when(F.col("_compact") >= 0.5, parse_compact(_whole_digits(number)))
        .when(F.col("_serial") >= 0.5, from_excel_serial(number))
    )
    return df.crossJoin(F.broadcast(shares)).withColumn(output, parsed).drop("_compact", "_serial")


def as_timestamp(df: DataFrame, column: str) -> Column:
    """The column as TIMESTAMP_NTZ, parsed from text where it is text."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        return parse_text(F.col(column))
    return F.col(column).cast("timestamp_ntz")


def has_time(moment: Column) -> Column:
    """Aggregate: at least 10 % of the valid values are not at midnight."""
    clock = F.hour(moment) + F.minute(moment) + F.second(moment)
    return F.coalesce(F.avg((clock > 0).cast("double")) >= 0.1, F.lit(False))


def period_key(value: Column) -> Column:
    """``YYYY-MM`` found in the text, else the whole text."""
    text = F.coalesce(value, F.lit(""))
    month = F.regexp_extract(text, r"\d{4}-\d{2}", 0)
    return F.when(month != "", month).otherwise(text)


def period_range_key(start: Column, end: Column) -> Column:
    """``from-to`` months of a range, empty ends left out."""
    left, right = F.substring(start, 1, 7), F.substring(end, 1, 7)
    return F.concat_ws("-", F.when(left != "", left), F.when(right != "", right))


def duration_text(seconds: Column) -> Column:
    """Days, hours and minutes in words; minutes are shown when nothing else is."""
    total = F.floor(seconds).cast("bigint")
    days, hours, minutes = total / 86400, F.pmod(total, F.lit(86400)) / 3600, F.pmod(total, F.lit(3600)) / 60
    days, hours, minutes = [F.floor(part).cast("bigint") for part in (days, hours, minutes)]
    show_minutes = (minutes > 0) | ((days == 0) & (hours == 0))
    return F.concat_ws(
        ", ",
        F.when(days > 0, F.concat(days.cast("string"), F.lit(" giorni"))),
        F.when(hours > 0, F.concat(hours.cast("string"), F.lit(" ore"))),
        F.when(show_minutes, F.concat(minutes.cast("string"), F.lit(" minuti"))),
    )


def elapsed(start: Column, end: Column, unit: str = "days") -> Column:
    """``end - start`` as a double in days or hours; negatives kept."""
    micros = F.timestamp_diff("MICROSECOND", start, end).cast("double")
    return micros / (3600e6 if unit == "hours" else 86400e6)


def month_end(moment: Column) -> Column:
    return F.last_day(moment.cast("date"))


def month_start(moment: Column) -> Column:
    return F.trunc(moment.cast("date"), "MM")


def year_end(moment: Column) -> Column:
    return F.make_date(F.year(moment), F.lit(12), F.lit(31))


def week_end(moment: Column) -> Column:
    """The Sunday that closes the week."""
    return F.next_day(F.date_sub(moment.cast("date"), 1), "SUN")
