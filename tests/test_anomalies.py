"""Detectors and root-cause groups, the groups against a pairwise brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tablewise.operators import anomalies, outliers, rootcause
from tablewise.operators.aggregates import summary_numeric


def months(spark, values, name):
    return spark.createDataFrame([(f"2026-{i + 1:02d}-01", float(v)) for i, v in enumerate(values)], f"mese string, {name} double")


def test_numeric_outlier(spark):
    df = spark.createDataFrame([(i, 10.0) for i in range(30)] + [(30, 100.0)], "id int, duration double")
    found = anomalies.anomaly_dedup(anomalies.numeric_anomalies(df, ["duration"], ["id"])).collect()
    assert [(r.observed_value, r.row_id, r.severity) for r in found] == [(100.0, '{"id":"30"}', "critical")]
    assert found[0].detection_methods == ["iqr", "zscore"] and found[0].method == "iqr" and found[0].detection_count == 2


def test_rows_without_a_key_keep_their_ids_under_any_partitions(spark, monkeypatch):
    monkeypatch.setattr(outliers, "NUMBER_BLOCK", 3)
    df = spark.createDataFrame([(f"r{i}", 10.0 + i % 3) for i in range(60)] + [("x", 100.0)] * 7 + [(None, 100.0), ("y", 100.0)], "name string, duration double")
    ids = [sorted((r.row_id, r.method, r.value) for r in outliers.outlier_rows(d, ["duration"], methods=["iqr", "zscore"]).collect())
           for d in (df.coalesce(1), df.repartition(5), df.orderBy(F.rand(1)))]
    assert ids[0] == ids[1] == ids[2] and len(set(ids[0])) == len(ids[0])
    rows = [i for i, method, _ in ids[0] if method == "iqr"]
    assert len(rows) == 9 and sorted(int(i.split("-")[1]) for i in rows) == [1, 1, 1, 2, 3, 4, 5, 6, 7]
    assert anomalies.anomaly_dedup(anomalies.numeric_anomalies(df, ["duration"])).count() == 9


def test_spike_needs_a_low_multiplier_or_an_excluding_window(spark):
    df = months(spark, [10, 10, 10, 100], "duration")
    assert [r.observed_value for r in anomalies.ts_spikes(df, "mese", "duration", window=3, multiplier=1.0).collect()] == [100.0]
    assert anomalies.ts_spikes(df, "mese", "duration", window=3, multiplier=2.0).count() == 0
    varied = months(spark, [10, 11, 10, 100], "duration")
    assert anomalies.ts_spikes(varied, "mese", "duration", multiplier=2.0, exclude_current=True).count() == 1
    change = anomalies.ts_sudden_changes(df, "mese", "duration").collect()
    assert [r.deviation for r in change] == [900.0]


def test_degradation(spark):
    df = months(spark, [10, 10, 11, 10, 11, 10, 20, 22], "latency")
    row = anomalies.degradation(df, "mese", "latency", recent_rows=2).first()
    assert row.severity in ("high", "critical") and row.observed_value == 21.0
    assert row.affected_period.startswith("2026-07-01") and "/2026-08-01" in row.affected_period
    assert anomalies.degradation(df.limit(5), "mese", "latency").count() == 0
    assert anomalies.degradation(df, "mese", "latency", recent_rows=2, higher_is_worse=False).count() == 0


def test_drift_and_sla(spark):
    def summary(values):
        return summary_numeric(spark.createDataFrame([(float(v),) for v in values], "d double"))

    row = anomalies.drift_anomalies(summary([20, 21, 19, 20]), summary([10, 11, 9, 10])).first()
    assert (row.anomaly_type, row.deviation, row.severity) == ("baseline_drift", 100.0, "critical")
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "duration double")
    row = anomalies.sla_violations(df, "duration", 2).first()
    assert (row.observed_value, row.severity, row.evidence["breach_count"]) == (50.0, "critical", "2")


def test_subset_against_baseline(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(1, 21)] + [("b", 100.0), ("b", 120.0), ("b", -5.0)], "k string, v double")
    row = outliers.subset_vs_baseline(df, F.col("k") == "b", "v").first()
    assert (row.baseline_rows, row.subset_rows, row.subset_median, row.conclusion) == (23, 3, 110.0, "subset_worse")


SCHEMA = (
    "anomaly_id string, anomaly_type string, severity string, confidence_score double, affected_column string, affected_period string"
)
RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}


def related(a, b):
    trend = [any(t in x[1] for t in rootcause.TREND_TERMS) for x in (a, b)]
    return {
        reason for reason, holds in (
            ("same_column", bool(a[4]) and a[4] == b[4]), ("same_or_similar_period", bool(a[5]) and a[5] == b[5]),
            ("same_anomaly_type", a[1] == b[1]), ("similar_severity", abs(RANK[a[2]] - RANK[b[2]]) <= 1),
            ("trend_or_degradation_signal", all(trend)),
        ) if holds
    }


def random_anomalies(seed):
    rng = random.Random(seed)
    levels = rng.sample(list(RANK), rng.randint(1, 4)) if seed else ["low", "critical"]
    return [
        (f"a{i}", rng.choice(["numeric_outlier", "sla_violation"]) if seed % 2 else f"type{i}", rng.choice(levels), 0.5,
         f"c{rng.randint(0, 9)}_{i if seed < 3 else 0}", rng.choice([None, "2026-01"]) if seed > 3 else None)
        for i in range(rng.randint(2, 9))
    ]


def pairwise_groups(rows):
    """(size, reasons, ids) of every component, by comparing all pairs."""
    left, expected = set(range(len(rows))), []
    while left:
        stack, group, reasons = [left.pop()], set(), set()
        while stack:
            i = stack.pop()
            group.add(i)
            for j in list(left):
                if related(rows[i], rows[j]):
                    left.discard(j)
                    stack.append(j)
        for i in group:
            for j in group:
                if i < j:
                    reasons |= related(rows[i], rows[j])
        expected.append((len(group), sorted(reasons), sorted(rows[i][0] for i in group)))
    return sorted(expected)


@pytest.mark.parametrize("seed", range(6))
def test_components_match_pairwise_search(spark, seed):
    rows = random_anomalies(seed)
    found = rootcause.rca_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.anomaly_count, sorted(r.relationship_reasons)) for r in found) == sorted(g[:2] for g in pairwise_groups(rows))


# Names of a run and a tenant, with nulls, an empty text and one analysis that holds most rows.
ANALYSES = [("r1", 1), ("r1", 2), ("r1", None), (None, 1), (None, None), ("", None), ("r2", 1), ("r2", 2), ("r3", 1), ("r3", 2)]


def keyed_anomalies(spark):
    analyses = {key: random_anomalies(seed) for seed, key in enumerate(ANALYSES)}
    analyses["hot", 1] = [(f"h{i}", ("trend_up", "sla_violation")[i % 2], ("low", "critical")[i % 2], 0.5, None, None) for i in range(3000)]
    rows = [(*key, *row) for key, found in analyses.items() for row in found]
    random.Random(5).shuffle(rows)
    return analyses, spark.createDataFrame(rows, "run string, tenant int, " + SCHEMA)


def test_keyed_components_match_pairwise_search_of_each_analysis(spark):
    analyses, df = keyed_anomalies(spark)
    hot = analyses.pop(("hot", 1))
    found = {}
    for r in rootcause.rca_components(df, ["run", "tenant"]).collect():
        found.setdefault((r.run, r.tenant), []).append(r)
    parts = found.pop(("hot", 1))
    assert sorted((r.anomaly_count, r.anomaly_types) for r in parts) == [(1500, ["sla_violation"]), (1500, ["trend_up"])] and len(hot) == 3000
    assert {k: sorted((r.anomaly_count, sorted(r.relationship_reasons)) for r in v) for k, v in found.items()} == {
        k: sorted(g[:2] for g in pairwise_groups(rows)) for k, rows in analyses.items()}
    ids = [r.group_id for v in [*found.values(), parts] for r in v]
    assert len(set(ids)) == len(ids)
    members = {}
    for r in rootcause.rca_members(df, ["run", "tenant"]).where("run is null or run <> 'hot'").collect():
        members.setdefault((r.run, r.tenant, r.component), []).append(r.anomaly_id)
    assert sorted(((a, b), sorted(v)) for (a, b, _), v in members.items() if a and b) == sorted(
        (k, g[2]) for k, rows in analyses.items() for g in pairwise_groups(rows) if k[0] and k[1])
    assert rootcause.rca_components(df.limit(0), ["run", "tenant"]).collect() == []


def test_keyed_anomalies_are_combined_before_the_shuffle(spark):
    _, df = keyed_anomalies(spark)
    plan = rootcause._properties(df, ["run", "tenant"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortAggregate" not in plan and plan.index("Exchange") < plan.rindex("HashAggregate")


def test_keyed_causes_rank_within_their_analysis(spark):
    analyses, df = keyed_anomalies(spark)
    profiled = spark.createDataFrame([("c1_0",), ("c2_0",)], "column string")
    causes = rootcause.rca_rank(rootcause.rca_causes(df, profiled, keys=["run", "tenant"]), ["run", "tenant"]).collect()
    ranks = {}
    for r in causes:
        ranks.setdefault((r.run, r.tenant), []).append(r.rank)
        assert r.evidence_count == r.anomaly_count + len({"c1_0", "c2_0"} & set(r.affected_metrics))
    assert set(ranks) == set(analyses) and all(sorted(v) == list(range(1, len(v) + 1)) for v in ranks.values())


def test_causes_are_scored_and_ranked(spark):
    rows = [
        ("a1", "sla_violation", "high", 0.82, "duration", "2026-01"), ("a2", "performance_degradation", "critical", 0.92, "duration", "2026-01"),
        ("a3", "time_series_spike", "medium", 0.68, "volume", "2026-01"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    cause = rootcause.rca_rank(rootcause.rca_causes(df, spark.createDataFrame([("duration",)], "column string"))).first()
    assert cause.title == "Possible operational degradation on duration, volume"
    assert cause.evidence_count == 4 and cause.rank == 1 and cause.severity == "critical"
    assert cause.confidence_score == pytest.approx(min(0.99, round((0.82 + 0.92 + 0.68) / 3, 4) + 0.09 + 0.12), abs=1e-4)
    assert "same_column" in cause.relationship_reasons
    shuffled = rootcause.rca_components(df.orderBy(F.rand(3))).first()
    assert shuffled.group_id == cause.group_id
