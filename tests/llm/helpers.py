"""Rows that every operator has to stand: nulls, empty and long texts, repeated rows, clashing columns."""

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
CLASHES = ("n", "score", "uid", "_k1", "start", "data", "label", "fp", "words", "key")


def docs_frame(spark, texts, ids=None, clash=True):
    """Documents with the given texts and with columns whose names operators may use themselves."""
    ids = list(range(len(texts))) if ids is None else ids
    frame = spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in zip(ids, texts)], DOCS)
    if clash:
        from pyspark.sql import functions as F

        frame = frame.withColumns({name: F.lit(7) for name in CLASHES})
    return frame


def odd_texts():
    return [None, "", " ", "\n\t ", "...", "a", "Straße 12 café, ÉTÉ 日本語 😀", "x" * 5000, "word " * 3000, "A b C d E f G", "A b C d E f G"]


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)
