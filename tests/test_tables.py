"""Counts, aggregates, quality and statistics on small tables with known results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablewise.operators import aggregates, counts, durations, outliers, profiling, quality, timeseries
from tablewise.operators.correlation import corr_pearson, top_correlated_pairs
from tablewise.plans.overview import auto_overview


def pairs(df, *columns):
    return {row[columns[0]]: row[columns[1]] if len(columns) == 2 else tuple(row[c] for c in columns[1:]) for row in df.collect()}


def numbers(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "value double")


def test_counts_show_nulls_under_a_label(spark):
    df = spark.createDataFrame([("open", 10), ("closed", 20), ("open", 30), (None, 40)], "stato string, amount long")
    assert [tuple(r) for r in counts.count_occurrences(df, "stato").collect()] == [("open", 2), ("N/D", 1), ("closed", 1)]
    totals = counts.occurrence_totals(df, "stato").first()
    assert (totals.total_records, totals.displayed_unique_values, totals.non_null_unique_values) == (4, 3, 2)


def test_groups_and_cross_tab(spark):
    channels = ["WEB", "WEB", "APP", None, "NEGOZIO", "WEB", None, "APP"]
    priorities = ["CRITICA"] * 5 + ["ALTA", "MEDIA", "BASSA"]
    df = spark.createDataFrame(list(zip(priorities, channels)), "priorita string, canale string")
    groups = [
        {"label": "CRITICA", "operator": "include", "values": ["CRITICA"]},
        {"label": "NON CRITICA", "operator": "exclude", "values": ["CRITICA"]},
    ]
    assert pairs(counts.semantic_groups(df, "priorita", groups), "label", "count") == {"CRITICA": 5, "NON CRITICA": 3}
    values = counts.semantic_group_values(df, "priorita", groups).where("label = 'NON CRITICA'")
    assert sorted(r.value for r in values.collect()) == ["ALTA", "BASSA", "MEDIA"]
    cells = {(r.primary_value, r.related_value): (r["count"], r.share_percent) for r in counts.cross_tab(df, "priorita", "canale", groups).collect()}
    assert cells[("CRITICA", "WEB")] == (2, 40.0) and cells[("CRITICA", "N/D")] == (1, 20.0)
    assert cells[("NON CRITICA", "NEGOZIO")] == (0, 0.0) and cells[("NON CRITICA", "APP")] == (1, 33.33)
    assert len(cells) == 8


def test_cross_tab_is_empty_for_too_many_values(spark):
    df = spark.range(60).select(F.lit("a").alias("p"), F.col("id").cast("string").alias("r"))
    assert counts.cross_tab(df, "p", "r").count() == 0


def test_top_and_grouped_metrics(spark):
    df = spark.createDataFrame([("A", 10), ("A", 15), ("B", 40), ("C", 5)], "cliente string, fatturato long")
    assert [tuple(r) for r in counts.top_n(df, "cliente", "fatturato", "sum", 2).collect()] == [("B", 40), ("A", 25)]
    area = spark.createDataFrame([("Nord", 10), ("Nord", 20), ("Sud", 40)], "area string, score long")
    assert [tuple(r) for r in aggregates.numeric_aggregation(area, "score", "mean", "area").collect()] == [("Sud", 40.0), ("Nord", 15.0)]
    empty = spark.createDataFrame([("A", None), (None, 2.0)], "g string, v double")
    assert pairs(aggregates.numeric_aggregation(empty, "v", "sum", "g"), "group", "value") == {"A": 0.0, None: 2.0}


def test_duplicates_of_a_hot_row(spark):
    rows = [("hot", None)] * 400 + [(f"u{i}", float(i)) for i in range(300)] + [("pair", 1.0)] * 2
    df = spark.createDataFrame(rows, "k string, v double")
    row = quality.duplicate_detection(df).first()
    assert (row.row_count, row.duplicate_rows, row.duplicate_groups_rows) == (702, 400, 402)
    assert [tuple(r) for r in quality.duplicate_sample(df).collect()] == [("hot", None, 400), ("pair", 1.0, 2)]


def test_nulls_and_duplicates(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 1.0), (None, 2.0), ("B", None), ("B", None)], "categoria string, valore double")
    found = {r.column: (r.null_count, r.null_percent, r.total_nulls) for r in quality.null_detection(df).collect()}
    assert found == {"valore": (2, 40.0, 3), "categoria": (1, 20.0, 3)}
    row = quality.duplicate_detection(df).first()
    assert (row.row_count, row.duplicate_rows, row.duplicate_groups_rows) == (5, 2, 4)
    assert quality.validation_score(df).first().score == 85
    assert quality.validation_score(df.limit(0)).first().score == 0


DOMAINS = ["retail", "energy", "training", "support", "university", "weather"]


@pytest.mark.parametrize("domain", DOMAINS[:2])
def test_domain_contract(spark, domain):
    rows = [("first", "web", 10.0), ("first", "web", 10.0), ("second", "app", 25.0), ("third", "web", 5.0), ("second", "store", None)]
    df = spark.createDataFrame(rows, f"{domain} string, canale string, metric double")
    assert pairs(counts.count_occurrences(df, domain), "value", "count") == {"first": 2, "second": 2, "third": 1}
    sums = [tuple(r) for r in aggregates.numeric_aggregation(df, "metric", "sum", domain).collect()]
    assert sums == [("second", 25.0), ("first", 20.0), ("third", 5.0)]
    assert [r.value for r in counts.top_n(df, domain, "metric", "sum", 2).collect()] == ["second", "first"]
    assert quality.null_detection(df).first().null_percent == 20.0
    row = quality.duplicate_detection(df).first()
    assert (row.duplicate_rows, row.duplicate_groups_rows) == (1, 2)


def test_empty_text_is_not_missing(spark):
    df = spark.createDataFrame([("", 1.0), (None, 2.0), (None, float("nan"))], "nota string, v double")
    assert pairs(quality.completeness(df), "column", "missing_count") == {"nota": 2, "v": 1}


def test_numeric_profile(spark):
    row = aggregates.numeric_profile(numbers(spark, range(1, 101)), ["value"]).first()
    assert (row.p50, row.p90) == (50.5, pytest.approx(90.1))
    row = aggregates.numeric_profile(numbers(spark, [1, 2, 3, 4, 5]), ["value"]).first()
    assert (row.iqr, row.range, row.mad) == (2.0, 4.0, 1.0)
    row = aggregates.numeric_profile(numbers(spark, [7, None]), ["value"]).first()
    assert (row["count"], row.missing_count, row.variance, row.std) == (1, 1, 0.0, 0.0)
    summary = aggregates.summary_numeric(numbers(spark, [1, 2, 3, 10]), ["value"]).first()
    assert (summary["median"], summary["sum"]) == (2.5, 16.0)


@pytest.mark.parametrize("values, method", [([10] * 30 + [100], "zscore"), ([10, 11, 12, 13, 14, 15, 100], "modified_zscore"), ([10] * 30 + [100], "iqr")])
def test_outliers(spark, values, method):
    found = outliers.outlier_rows(numbers(spark, values), ["value"], methods=[method]).collect()
    assert [r.value for r in found] == [100.0]
    counted = outliers.outlier_counts(numbers(spark, values), ["value"], [method]).first()
    assert counted.outlier_count == 1


def test_constant_values_have_no_outliers(spark):
    assert outliers.outlier_rows(numbers(spark, [5] * 10), ["value"]).count() == 0


def test_threshold(spark):
    row = quality.threshold_check(numbers(spark, [1, 2, 3, 4, None]), "value", 2, "<=").first()
    assert (row.valid_count, row.compliant_count, row.breach_count, row.breach_rate) == (4, 2, 2, 50.0)
    with pytest.raises(ValueError):
        quality.threshold_check(numbers(spark, [1]), "value", 2, "~")


def test_pearson_ignores_constant_columns(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 3.0) for i in range(1, 5)], "a double, b double, c double")
    found = {(r.left_column, r.right_column): r.correlation for r in corr_pearson(df).collect()}
    assert found[("a", "b")] == pytest.approx(1.0) and found[("a", "c")] is None
    best = top_correlated_pairs(corr_pearson(df)).first()
    assert (best.left_column, best.right_column) == ("a", "b")


def test_completeness_total(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, "y"), (3.0, None)], "a double, b string")
    row = quality.completeness_total(df).first()
    assert (row.total_missing, row.overall_completeness_percent) == (2, 66.6667)


def test_daily_trend(spark):
    df = spark.createDataFrame([("2026-01-01", "a"), ("2026-01-01", "b"), ("2026-01-02", "a"), ("2026-01-05", "a"), ("x", "a")], "data_evento string, stato string")
    rows = {r.period.isoformat(): (r.value, r.frequency) for r in timeseries.time_trend(df, "data_evento").collect()}
    assert rows == {"2026-01-01": (2, "D"), "2026-01-02": (1, "D"), "2026-01-03": (0, "D"), "2026-01-04": (0, "D"), "2026-01-05": (1, "D")}


def test_monthly_and_yearly_buckets(spark):
    def trend(days, **kwargs):
        start = dt.date(2024, 1, 10)
        df = spark.createDataFrame([(start + dt.timedelta(days=d), float(d)) for d in days], "d date, v double")
        return [(r.period.isoformat(), r.value) for r in timeseries.time_trend(df, "d", **kwargs).orderBy("period").collect()]

    assert trend([0, 100], value="v", aggregation="sum") == [("2024-01-31", 0.0), ("2024-02-29", 0.0), ("2024-03-31", 0.0), ("2024-04-30", 100.0)]
    assert trend([0, 100], value="v", aggregation="mean") == [("2024-01-31", 0.0), ("2024-04-30", 100.0)]
    assert trend([0, 800]) == [("2024-12-31", 1), ("2025-12-31", 0), ("2026-12-31", 1)]


def test_rolling_statistics(spark):
    df = spark.createDataFrame([(f"2026-0{m}-01", float(v)) for m, v in ((1, 10), (2, 20), (3, 30), (4, 40))], "mese string, value double")
    rows = timeseries.trend_stats(df, "mese", "value", window=2).orderBy("period").collect()
    assert rows[1].rolling_mean == 15.0 and round(rows[3].growth_percent, 4) == 33.3333
    assert rows[0].rolling_std is None and rows[0].total_growth_percent == 300.0


@pytest.mark.parametrize("long_days, expected", [([1, 1, 1, 1], "concentrated"), ([1, 4, 7, 10], "distributed")])
def test_concentration(spark, long_days, expected):
    rows = [(f"2026-02-{d:02d}", 40) for d in long_days] + [(f"2026-02-{d:02d}", 2 + d % 3) for d in range(1, 17)]
    df = spark.createDataFrame(rows, "giorno string, durata long")
    row = timeseries.temporal_concentration(df, "giorno", "durata").first()
    assert row.conclusion == expected
    if expected == "concentrated":
        assert row.top_day == dt.date(2026, 2, 1)


def activation(spark):
    spans = [2, 3, 4, 40, 42, 41, 2, 3, 4, 5, 7, 8, -1, -2, -3, 2, 3, 4, 5, 6]
    rows = []
    for i, span in enumerate(spans):
        start = dt.datetime(2026, 1, 4, 23, 30) if 3 <= i <= 5 else dt.datetime(2026, 1, 10) + dt.timedelta(days=i)
        rows.append((start.isoformat(" "), (start + dt.timedelta(days=span)).isoformat(" "), "web" if i % 2 else "shop"))
    return spark.createDataFrame(rows + [(None, "2026-01-01", "web"), ("non data", "2026-01-01", "web")], "inizio string, fine string, metodo string")


def test_durations_and_gate(spark):
    df = activation(spark)
    report = durations.duration_report(df, "inizio", "fine").first()
    assert (report.valid_count, report.negative_duration_count, report.start_parse_errors) == (20, 3, 2)
    featured = durations.duration_feature(df, "inizio", "fine", "giorni").where("giorni is not null")
    gate = quality.quality_gate(featured, "giorni").first()
    assert (gate.negative_count, gate.severity, gate.status) == (3, "high", "requires_user_decision")
    assert quality.null_negatives(featured, "giorni").where("giorni is null").count() == 3
    profile = durations.activation_profile(df, "inizio", "fine").first()
    assert profile.long_tail and profile.outlier_count >= 3
    shifted = durations.datetime_shift(df, "inizio", 1).select("inizio", "inizio_ADJUSTED").collect()
    assert sum(r.inizio_ADJUSTED is not None and str(r.inizio_ADJUSTED.date()) == "2026-01-05" and r.inizio.startswith("2026-01-04") for r in shifted) == 3


def test_elapsed_text(spark):
    from tablewise.functions.dates import duration_text

    rows = [("2026-01-01 00:00:00", "2026-01-01 04:00:00"), ("2026-01-01 00:00:00", "2026-01-02 00:00:00"), ("2026-01-01 00:00:00", "2026-01-01 03:00:00")]
    df = spark.createDataFrame(rows, "a string, b string")
    row = durations.elapsed_summary(df, "a", "b").select("*", duration_text(F.col("average_hours") * 3600).alias("text")).first()
    assert row.valid_rows == 3 and row.excluded_rows == 0 and "10 ore" in row.text


def test_column_semantics(spark):
    rows = [(f"2026-01-{d:02d}", f"2026-02-{d:02d} 10:30:00", f"ID{d}", d, d % 2 == 0, "web" if d % 3 else "shop", d * 1.5) for d in range(1, 13)]
    df = spark.createDataFrame(rows, "DATASOTTOSCRIZIONE string, CREAZIONE_ANTENNA string, IDCONTRATTO string, n long, flag boolean, canale string, importo double")
    found = pairs(profiling.column_semantics(df), "column", "semantic_type")
    assert found == {
        "DATASOTTOSCRIZIONE": "DATE", "CREAZIONE_ANTENNA": "DATETIME", "IDCONTRATTO": "IDENTIFIER", "n": "IDENTIFIER", "flag": "BOOLEAN",
        "canale": "CATEGORY", "importo": "AMOUNT",
    }
    loose = spark.createDataFrame([(i % 3,) for i in range(12)], "grid long")
    assert pairs(profiling.column_semantics(loose), "column", "semantic_type") == {"grid": "IDENTIFIER"}
    assert pairs(profiling.column_semantics(loose, match="token"), "column", "semantic_type") == {"grid": "METRIC"}


def test_overview(spark):
    rows = [("open", "a", "2026-01-01", "2026-01-02", 1, "x"), ("closed", "b", "2026-01-02", "2026-01-03", 2, None)] + [("open", "a", "2026-01-03", "2026-01-05", 3, "y")] * 2
    df = spark.createDataFrame(rows, "stato string, categoria string, created_at string, resolved_at string, priority_score long, owner string")
    results, errors = auto_overview(df)
    assert not errors
    assert {"category-distribution", "time-trend", "duration-summary", "null-detection", "duplicate-detection"} <= set(results)
    assert results["duplicate-detection"].first().duplicate_rows == 1
    assert results["duration-summary"].first().valid_rows == 4
