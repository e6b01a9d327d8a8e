"""Helpers shared by the text operators: Arrow slices, row keys and written intermediates."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.session import shared_folder

SLICE_BYTES = 8 * 1024 * 1024
#: Ids that occur again are looked up in a table that is sent to all executors, up to so many.
KEPT_IDS = 100_000
#: Arguments of ``hash_bucket`` are decimal ids as text, as the held-out folds are defined.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: ASCII characters other than digits and lower-case letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, safe from lost executors, in little room."""
    path = f"{shared_folder(df.sparkSession)}/tablewise/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def word_line(text: Column) -> Column:
    """The words of a text, in lower case, with one space between them; null counts as empty."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, " "))


def word_count(line: Column) -> Column:
    """The number of words of a ``word_line``."""
    spaces = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    return F.when(line == "", 0).otherwise(spaces + 1).cast("long")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once even where lambdas in ``body`` use it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(identity: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(identity.cast("string")) % folds


def row_key(identity: Column, text: Column) -> list[Column]:
    """Two columns without nulls that tell rows of different id or text apart.

    Rows that repeat both are one document for the operators; each of them gets its result.
    """
    return [
        F.coalesce(identity.cast("long"), F.lit(-(2 ** 63))).alias("_k1"),
        F.xxhash64(F.coalesce(text, F.lit("")), identity.isNull(), text.isNull()).alias("_k2"),
    ]


def free_names(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened until no column has them (Spark doesn't tell upper from lower case)."""
    taken = {c.lower() for c in columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


def with_document_keys(docs: DataFrame, first: str = "_k1", second: str = "_k2") -> DataFrame:
    """The rows with two columns that tell documents apart as ``row_key`` does.

    The second is the hash only where a row's id is missing or occurs again; elsewhere it is 0, which takes no
    room in shuffles and tables. If over ``KEPT_IDS`` ids occur again, it is the hash everywhere.
    """
    one, two = row_key(F.col("doc_id"), F.col("text"))
    several = written(docs.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias(first)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(first))
    count = several.count()
    if count > KEPT_IDS:
        return docs.withColumns({first: one, second: two})
    again = F.col("doc_id").isNull()
    if not count:
        return docs.withColumns({first: one, second: F.when(again, two).otherwise(F.lit(0).cast("long"))})
    marked = docs.withColumns({first: one, second: two}).join(F.broadcast(several.withColumnRenamed(first, f"{first}_again")), F.col(first) == F.col(f"{first}_again"), "left")
    again = again | F.col(f"{first}_again").isNotNull()
    return marked.withColumn(second, F.when(again, F.col(second)).otherwise(F.lit(0).cast("long"))).drop(f"{first}_again")


def hash_sample(rows: DataFrame, identity: list[str], wanted: int, total: int) -> DataFrame:
    """The ``wanted`` of ``total`` rows whose hashes are smallest, all if they are fewer.

    A bound that four times as many rows pass spares sorting the rest; it never comes down to nothing.
    """
    place = F.xxhash64(*identity)
    if total > 8 * wanted:
        rows = rows.where(place <= -(2 ** 63) + (2 ** 64 * 4 * wanted) // total)
    return rows.orderBy(place, *identity).limit(wanted)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))[1]
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets of each; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary array over ``data`` cut at ``offsets``."""
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    )


def crc_fold(identity: int, folds: int) -> int:
    return zlib.crc32(str(identity).encode()) % folds
