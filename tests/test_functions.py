"""Column functions against plain Python."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tablewise.functions import dates, jsonfn, numeric, text


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("value, expected", [
    ("2026-07-29", dt.datetime(2026, 7, 29)), ("29/07/2026", dt.datetime(2026, 7, 29)), ("29/07/2026 14:35", dt.datetime(2026, 7, 29, 14, 35)),
    ("2026-07-29T14:35:00", dt.datetime(2026, 7, 29, 14, 35)), ("03/07/2026", dt.datetime(2026, 7, 3)), ("not-a-date", None), ("31/02/2026", None),
])
def test_strict_dates(spark, value, expected):
    assert one(spark, dates.parse_strict(F.lit(value)))[0] == expected


def test_loose_dates(spark):
    values = ["20260729", "20260729143500", "46232", "2026-07-29", "nope", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    found = [r[0] for r in df.orderBy("i").select(dates.parse_text(F.col("v"))).collect()]
    day = dt.datetime(2026, 7, 29)
    assert found == [day, day.replace(hour=14, minute=35), day, day, None, None]
    numbers = spark.createDataFrame([(20260729,), (20260730,), (5,)], "n long")
    parsed = dates.parse_numeric(numbers, "n", "d").collect()
    assert {r.n: r.d for r in parsed} == {20260729: day, 20260730: dt.datetime(2026, 7, 30), 5: None}


def test_text_functions(spark):
    row = one(
        spark, text.slug(F.lit("  Città Nuova!! ")).alias("slug"), text.value_normalize(F.lit("consegna mano")).alias("value"),
        text.truncate(F.lit("abcdef"), 5).alias("short"), text.name_normalize(F.lit("O_Order-Key"), "").alias("name"),
        jsonfn.mask_url_password(F.lit("sqlite://me:pw@host/db")).alias("url"), dates.duration_text(F.lit(37200)).alias("duration"),
        dates.period_key(F.lit("from 2026-03-04")).alias("period"), numeric.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("zero"),
    )
    assert (row.slug, row.value, row.short, row.name) == ("città_nuova", "CONSEGNA_A_MANO", "ab...", "oorderkey")
    assert (row.url, row.duration, row.period, row.zero) == ("sqlite://me:***@host/db", "10 ore, 20 minuti", "2026-03", 0.0)
    unit = one(spark, numeric.normalize_vector(F.array(F.lit(3.0), F.lit(4.0))))[0]
    assert unit == [0.6, 0.8]
    assert one(spark, numeric.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))))[0] == 0.0
    column = one(spark, text.search_tokens(F.lit("Quali anomalie su response-time?")))[0]
    assert column == sorted(
        {"anomalie", "anomalia", "anomaly", "anomalies", "response_time", "response time", "responsetime"})


def test_keyword_starts_a_word_of_any_script(spark):
    def hit(value, keyword):
        return one(spark, text.keyword_match(F.lit(value), keyword))[0]

    assert hit("trends per mese", "trend") and not hit("étrend", "trend") and not hit("a_trend", "trend")
    assert hit("per mese di", "per mese") and hit("(trend)", "trend")


def test_text_ratio(spark):
    samples = [("Abc  def", "abc def", 1.0), ("", "", 1.0), ("a b c", "b c d", 0.5), ("one two", "three", 0.0), ("xyz", "", 0.0), ("!", "?", 0.0)]
    df = spark.createDataFrame(samples, "a string, b string, wanted double")
    for row in df.select("*", text.text_ratio(F.col("a"), F.col("b")).alias("r")).collect():
        assert row.r == pytest.approx(row.wanted)


def test_numbers(spark):
    values = [("3.5", 3.5), ("x", None), ("NaN", None), ("Infinity", None), (None, None)]
    df = spark.createDataFrame([(v,) for v, _ in values], "v string")
    assert [r[0] for r in df.select(numeric.to_number(F.col("v"))).collect()] == [e for _, e in values]
    assert one(spark, numeric.shape_similarity(F.lit(100), F.lit(None).cast("int"), F.lit(1000), F.lit(3)))[0] == pytest.approx(
        1 - abs(math.log1p(100) - math.log1p(1000)) / 6)
    assert one(spark, numeric.safe_ratio(F.lit(1), F.lit(0)))[0] is None


def test_secrets_are_dropped(spark):
    row = one(spark, jsonfn.drop_secrets(F.create_map(F.lit("API_KEY"), F.lit("x"), F.lit("team"), F.lit("a"))))
    assert row[0] == {"team": "a"}
