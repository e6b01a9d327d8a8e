"""CSV files and JSON records as DataFrames."""

from __future__ import annotations

import csv
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.operators.aggregates import summary_numeric
from tablewise.operators.quality import completeness
from tablewise.operators.shape import numeric_columns

DELIMITERS = ",;\t|"
#: Combinations of dialect and header that a folder's files may have.
MAX_DIALECTS = 100
MAX_COLUMNS = 500
# Bytes that cp1252 leaves undefined.
CP1252_UNDEFINED = "81|8D|8F|90|9D"


@dataclass(frozen=True)
class CsvFormat:
    encoding: str
    delimiter: str
    warnings: tuple[str, ...]


def file_dialects(spark: SparkSession, path: str) -> DataFrame:
    """Of each file, from all its lines in one pass: ``file, encoding, delimiter, header, lines``.

    A delimiter that stands equally often in every line, outside quotes, is taken first, then the one that most lines
    hold, then the more frequent one. Blank lines don't count; ``header`` has the bytes of the first other one.
    """
    raw = F.col("value").cast("binary")
    pairs = F.regexp_replace(F.hex(raw), "(..)", "$1 ")
    bare = F.regexp_replace("value", '"[^"]*"', "")
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), raw.alias("raw"), place.alias("place"), (~F.is_valid_utf8("value")).alias("not_utf8"),
        pairs.rlike(f"(^| )({CP1252_UNDEFINED}) ").alias("not_cp1252"), (F.trim("value") != "").alias("filled"),
        *[(F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit("")))).alias(f"n{i}") for i, d in enumerate(DELIMITERS)],
    )
    filled = F.col("filled")
    counts = lambda i: F.when(filled, F.col(f"n{i}"))
    found = lines.groupBy("file").agg(
        F.max("not_utf8").alias("not_utf8"), F.max("not_cp1252").alias("not_cp1252"), F.count_if(filled).alias("lines"),
        F.min_by("raw", F.when(filled, F.col("place"))).alias("header"),
        *[F.struct(
            ((F.min(counts(i)) == F.max(counts(i))) & (F.max(counts(i)) > 0)).alias("even"), F.count_if(counts(i) > 0).alias("lines"),
            F.coalesce(F.sum(counts(i)), F.lit(0)).alias("total"), F.lit(-i).alias("order"), F.lit(d).alias("sign")).alias(f"d{i}")
          for i, d in enumerate(DELIMITERS)],
    )
    best = F.greatest(*[F.col(f"d{i}") for i in range(len(DELIMITERS))])
    encoding = F.when(~F.col("not_utf8"), "UTF-8").when(F.col("not_cp1252"), "ISO-8859-1").otherwise("windows-1252")
    return found.select("file", encoding.alias("encoding"), F.when(best["lines"] > 0, best["sign"]).otherwise(",").alias("delimiter"), "header", "lines")


def _format(encoding: str, delimiter: str) -> CsvFormat:
    warnings = []
    if encoding != "UTF-8":
        warnings.append(f"CSV converted from {encoding}.")
    if delimiter != ",":
        warnings.append(f"Delimiter detected: {delimiter!r}.")
    return CsvFormat(encoding, delimiter, tuple(warnings))


def sniff_csv(spark: SparkSession, path: str) -> CsvFormat:
    """The one dialect of all files, from all their lines; a folder with several fails with their names."""
    found = file_dialects(spark, path).where("lines > 0").groupBy("delimiter").agg(F.min("file").alias("file"), F.collect_set("encoding").alias("encodings"))
    kinds = found.collect()  # as many rows as there are delimiters
    if len(kinds) > 1:
        raise ValueError("files with different delimiters: " + ", ".join(f"{r.delimiter!r} in {r.file}" for r in sorted(kinds)))
    if not kinds:
        return _format("UTF-8", ",")
    # What is UTF-8 in one file and isn't in another is read by the wider table.
    encoding = next(e for e in ("ISO-8859-1", "windows-1252", "UTF-8") if e in kinds[0].encodings)
    if len(kinds[0].encodings) > 1 and "UTF-8" in kinds[0].encodings:
        raise ValueError(f"files with different encodings: {', '.join(sorted(kinds[0].encodings))}")
    return _format(encoding, kinds[0].delimiter)


def _cp1252_pairs() -> tuple[str, str]:
    """Characters that latin-1 and cp1252 read differently, and what cp1252 means by them."""
    codes = [c for c in range(0x80, 0xA0) if bytes([c]).decode("cp1252", "ignore")]
    return "".join(map(chr, codes)), "".join(bytes([c]).decode("cp1252") for c in codes)


def _as_cp1252(df: DataFrame) -> DataFrame:
    """Text read as latin-1, corrected to cp1252; Spark reads no cp1252 itself."""
    latin, windows = _cp1252_pairs()
    table = str.maketrans(latin, windows)
    return df.select(*[
        (F.translate(F.col(f"`{f.name}`"), latin, windows) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")).alias(f.name.translate(table))
        for f in df.schema
    ])


def read_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None, fmt: CsvFormat | None = None
) -> DataFrame:
    """CSV with a header; give ``schema`` to save the inference pass."""
    reader = spark.read.option("header", True)
    windows = fmt is not None and fmt.encoding == "windows-1252"
    if fmt:
        reader = reader.option("sep", fmt.delimiter).option("encoding", "ISO-8859-1" if windows else fmt.encoding)
    df = reader.csv(path, schema=schema) if schema else reader.option("inferSchema", True).csv(path)
    return _as_cp1252(df) if windows else df


def _header_names(raw: bytes, encoding: str, delimiter: str) -> tuple[str, ...]:
    """Column names as written, before Spark renames duplicates."""
    codec = {"UTF-8": "utf-8-sig", "windows-1252": "cp1252"}.get(encoding, encoding)
    return tuple(next(csv.reader([bytes(raw).decode(codec)], delimiter=delimiter), ()))


def guarded_csv(
    spark: SparkSession, path: str, *, max_rows: int, max_columns: int = MAX_COLUMNS, schema: T.StructType | str | None = None
) -> tuple[DataFrame, CsvFormat]:
    """CSV files after checking extension, emptiness, headers and row limit, from one pass over their lines.

    Files of a folder may differ in delimiter and encoding, not in their column names; those of one dialect are read
    together. The format returned is that of most files; its warnings are those of all. Records are counted only if there are
    more lines than ``max_rows``; a line is a record here, quoted line ends are not read.
    """
    if not path.lower().rstrip("/").endswith((".csv", ".txt")):
        raise ValueError("only CSV and Excel files are supported")
    # One row for each dialect and header.
    kinds = file_dialects(spark, path).where("lines > 0").groupBy("encoding", "delimiter", "header").agg(
        F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"), F.min("file").alias("first")).limit(MAX_DIALECTS + 1).collect()
    if not kinds:
        raise ValueError("the file is empty")
    if len(kinds) > MAX_DIALECTS:
        raise ValueError(f"more than {MAX_DIALECTS} different headers or dialects")
    kinds.sort(key=lambda r: (-r.files, r.first))
    headers = {_header_names(r.header, r.encoding, r.delimiter): r for r in reversed(kinds)}
    names = _header_names(kinds[0].header, kinds[0].encoding, kinds[0].delimiter)
    if len(names) > max_columns:
        raise ValueError(f"more than {max_columns} columns")
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"duplicate column names: {', '.join(repeated[:5])}")
    if len(headers) > 1:
        raise ValueError("files with different columns: " + ", ".join(sorted(r.first for r in headers.values())))
    lines, files = sum(r.lines for r in kinds), sum(r.files for r in kinds)
    if lines <= files:
        raise ValueError("the file holds no rows")
    formats = list(dict.fromkeys(_format(r.encoding, r.delimiter) for r in kinds))
    if len(formats) == 1:
        df = read_csv(spark, path, schema, formats[0])
    else:
        df = _mixed_csv(spark, path, schema, formats)
    if lines - files > max_rows and df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} records")
    return df, CsvFormat(formats[0].encoding, formats[0].delimiter, tuple(dict.fromkeys(w for f in formats for w in f.warnings)))


def _mixed_csv(spark: SparkSession, path: str, schema: T.StructType | str | None, formats: list[CsvFormat]) -> DataFrame:
    """Files of several dialects, one read for each; columns whose inferred types differ are read as text."""
    dialects = file_dialects(spark, path).where("lines > 0").select("file", "encoding", "delimiter").collect()  # the names that a reader lists as well
    parts = []
    for fmt in formats:
        own = [unquote(r.file) for r in dialects if (r.encoding, r.delimiter) == (fmt.encoding, fmt.delimiter)]
        parts.append(read_csv(spark, own, schema, fmt))
    types = [{f.name: f.dataType for f in part.schema} for part in parts]
    united = None
    for part in parts:
        columns = [F.col(f"`{c}`") if len({t[c] for t in types}) == 1 else F.col(f"`{c}`").cast("string").alias(c) for c in parts[0].columns]
        part = part.select(*columns)
        united = part if united is None else united.unionByName(part)
    return united


def records_table(spark: SparkSession, records: list[dict], schema: T.StructType | str | None = None) -> DataFrame:
    """A list of JSON objects as a table."""
    return spark.createDataFrame(records, schema=schema)


def parse_records(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A column of JSON objects as columns; malformed rows become nulls."""
    return df.withColumn("_r", F.from_json(column, schema, {"mode": "PERMISSIVE"})).select(
        *[c for c in df.columns if c != column], "_r.*"
    )


def file_preview(df: DataFrame, first_rows: int = 5) -> dict[str, DataFrame]:
    """Null counts, numeric description and the first rows."""
    return {
        "nulls": completeness(df).select("column", F.col("missing_count").alias("null_count")),
        "numeric": summary_numeric(df) if numeric_columns(df) else df.limit(0),
        "rows": df.limit(first_rows),
    }
