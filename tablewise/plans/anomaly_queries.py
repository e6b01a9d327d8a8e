"""Outliers, anomalies, root causes and business summaries over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewise.functions import numeric
from tablewise.operators import anomalies, business, outliers, rootcause
from tablewise.operators.aggregates import summary_numeric
from tablewise.plans.registry import QuerySet, table

SET = QuerySet()

SEVERITY = """CASE WHEN {r} >= 4 THEN 'critical' WHEN {r} >= 2.5 THEN 'high' WHEN {r} >= 1.25 THEN 'medium' ELSE 'low' END"""
CONFIDENCE = "CASE {s} WHEN 'low' THEN 0.55::DOUBLE WHEN 'medium' THEN 0.68 WHEN 'high' THEN 0.82 ELSE 0.92 END"
PUBLIC = ("anomaly_type", "severity", "confidence_score", "affected_column", "observed_value", "expected_value",
          "deviation", "method")

_LIMITS = """
WITH s AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q3,
   avg(value) AS mean, stddev_pop(value) AS sd, mad(value) AS mad FROM events),
 h AS (SELECT event_id, value, med, q3 - q1 AS iqr, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS iqr_hit,
   sd > 0 AND abs((value - mean) / sd) > 3 AS z_hit, mad > 0 AND abs(0.6745 * (value - med) / mad) > 3.5 AS mz_hit FROM events, s),
 o AS (SELECT *, 'iqr' AS method FROM h WHERE iqr_hit UNION ALL SELECT *, 'zscore' FROM h WHERE z_hit
   UNION ALL SELECT *, 'modified_zscore' FROM h WHERE mz_hit),
 a AS (SELECT *, abs(round(value, 4) - round(med, 4)) / round(iqr, 4) AS r FROM o)"""


def _outliers(method):
    def run(spark, folder):
        found = outliers.outlier_rows(table(spark, folder, "events"), ["value"], ["event_id"], [method])
        return found.select("row_id", "value")

    return run


for _name, _method, _hit in (
    ("outlier_iqr", "iqr", "iqr_hit"), ("outlier_zscore", "zscore", "z_hit"), ("outlier_modz", "modified_zscore", "mz_hit"),
):
    SET.add(_name, _LIMITS + f'''SELECT '{{"event_id":"' || event_id || '"}}' AS row_id, value FROM h WHERE {_hit}''')(_outliers(_method))


@SET.add("outlier_counts", _LIMITS + """
, n AS (SELECT count(*) AS n, count(*) FILTER (iqr_hit) AS a, count(*) FILTER (z_hit) AS b, count(*) FILTER (mz_hit) AS c FROM h)
SELECT 'value' AS "column", 'iqr' AS method, a AS outlier_count, round(a / n * 100, 4) AS outlier_percent FROM n
UNION ALL SELECT 'value', 'zscore', b, round(b / n * 100, 4) FROM n
UNION ALL SELECT 'value', 'modified_zscore', c, round(c / n * 100, 4) FROM n""")
def _(spark, folder):
    return outliers.outlier_counts(table(spark, folder, "events"), ["value"])


@SET.add("numeric_anomalies", _LIMITS + f"""
SELECT '{{"event_id":"' || event_id || '"}}' AS row_id, 'numeric_outlier' AS anomaly_type, {SEVERITY.format(r='r')} AS severity,
  {CONFIDENCE.format(s=SEVERITY.format(r='r'))} AS confidence_score, 'value' AS affected_column, round(value, 4) AS observed_value,
  round(med, 4) AS expected_value, round(round(value, 4) - round(med, 4), 4) AS deviation, method FROM a""")
def _(spark, folder):
    found = anomalies.numeric_anomalies(table(spark, folder, "events"), ["value"], ["event_id"])
    return found.select("row_id", *PUBLIC)


@SET.add("anomaly_dedup", _LIMITS + f"""
SELECT '{{"event_id":"' || event_id || '"}}' AS row_id, any_value({SEVERITY.format(r='r')}) AS severity,
  round(any_value(value), 4) AS observed_value, string_agg(method, ',' ORDER BY method) AS detection_methods,
  cast(count(*) AS INTEGER) AS detection_count FROM a GROUP BY event_id""")
def _(spark, folder):
    found = anomalies.anomaly_dedup(anomalies.numeric_anomalies(table(spark, folder, "events"), ["value"], ["event_id"]))
    return found.select(
        "row_id", "severity", "observed_value", F.array_join("detection_methods", ",").alias("detection_methods"), "detection_count"
    )


_DAILY = """
WITH b AS (SELECT cast(ts AS DATE) AS period, avg(value) AS v FROM events GROUP BY 1),
 p AS (SELECT period, round(v, 4) AS v, round(avg(v) OVER r, 4) AS rm, round(stddev_samp(v) OVER r, 4) AS rs,
   round((v / lag(v) OVER o - 1) * 100, 4) AS g FROM b
   WINDOW o AS (ORDER BY period), r AS (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""


@SET.add("ts_spike", _DAILY + f"""
SELECT 'time_series_spike' AS anomaly_type, {SEVERITY.format(r='abs((v - rm) / rs)')} AS severity,
  {CONFIDENCE.format(s=SEVERITY.format(r='abs((v - rm) / rs)'))} AS confidence_score, 'value' AS affected_column,
  cast(period AS VARCHAR) AS affected_period, v AS observed_value, rm AS expected_value, round(v - rm, 4) AS deviation,
  'rolling_mean_std' AS method FROM p WHERE rs > 0 AND v > rm + 1.0 * rs""")
def _(spark, folder):
    found = anomalies.ts_spikes(table(spark, folder, "events"), "ts", "value", frequency="D", multiplier=1.0)
    return found.select("affected_period", *PUBLIC)


@SET.add("ts_sudden_change", _DAILY + f"""
SELECT 'sudden_change' AS anomaly_type, {SEVERITY.format(r='abs(g) / 15.0')} AS severity,
  {CONFIDENCE.format(s=SEVERITY.format(r='abs(g) / 15.0'))} AS confidence_score, 'value' AS affected_column,
  cast(period AS VARCHAR) AS affected_period, v AS observed_value, rm AS expected_value, g AS deviation,
  'period_over_period_growth' AS method FROM p WHERE abs(g) >= 15.0""")
def _(spark, folder):
    found = anomalies.ts_sudden_changes(table(spark, folder, "events"), "ts", "value", frequency="D", threshold=15.0)
    return found.select("affected_period", *PUBLIC)


_RECENT = """
WITH d AS (SELECT o_orderdate AS t, o_totalprice + CASE WHEN o_orderdate >= TIMESTAMP '2000-01-01' THEN 90000 ELSE 0 END AS x FROM orders),
 o AS (SELECT *, row_number() OVER (ORDER BY t DESC, x DESC) AS i, count(*) OVER () AS n FROM d),
 m AS (SELECT any_value(n) AS n, any_value(greatest(2, n // 3)) AS k, avg(x) FILTER (i > greatest(2, n // 3)) AS base,
   avg(x) FILTER (i <= greatest(2, n // 3)) AS recent, min(t) FILTER (i <= greatest(2, n // 3)) AS f, max(t) AS u FROM o)"""


def _worsening(spark, folder):
    late = F.when(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz"), 90000).otherwise(0)
    return table(spark, folder, "orders").select("o_orderdate", (F.col("o_totalprice") + late).alias("x"))


@SET.add("recent_vs_baseline", _RECENT + """
SELECT n, cast(k AS BIGINT) AS recent_rows, round(base, 4) AS baseline_mean, round(recent, 4) AS recent_mean,
  round((recent - base) / abs(base) * 100, 4) AS change_percent, f AS recent_from, u AS recent_to FROM m""")
def _(spark, folder):
    found = anomalies.recent_vs_baseline(_worsening(spark, folder), "o_orderdate", "x")
    return found.withColumns({c: F.round(c, 4) for c in ("baseline_mean", "recent_mean", "change_percent")})


_CHANGE = "abs((recent - base) / abs(base) * 100) / 20.0"


@SET.add("degradation", _RECENT + f"""
SELECT 'performance_degradation' AS anomaly_type, {SEVERITY.format(r=_CHANGE)} AS severity,
  {CONFIDENCE.format(s=SEVERITY.format(r=_CHANGE))} AS confidence_score, 'x' AS affected_column, round(recent, 4) AS observed_value,
  round(base, 4) AS expected_value, round((recent - base) / abs(base) * 100, 4) AS deviation,
  'recent_window_vs_baseline_mean' AS method FROM m WHERE (recent - base) / abs(base) * 100 >= 20""")
def _(spark, folder):
    return anomalies.degradation(_worsening(spark, folder), "o_orderdate", "x").select(*PUBLIC)


def _drift_sides(spark, folder):
    lines = table(spark, folder, "lineitem")
    open_lines = lines.where("l_linestatus = 'O'").withColumn("l_tax", F.col("l_tax") * 1.5)
    metrics = ["l_quantity", "l_tax", "l_discount"]
    return summary_numeric(open_lines, metrics), summary_numeric(lines.where("l_linestatus = 'F'"), metrics)


_DRIFT = """WITH d AS (""" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", avg({c}{' * 1.5' if c == 'l_tax' else ''}) FILTER (l_linestatus = 'O') AS cur,
    avg({c}) FILTER (l_linestatus = 'F') AS base FROM lineitem""" for c in ("l_quantity", "l_tax", "l_discount")) + ")"


@SET.add("baseline_drift", _DRIFT + """
SELECT "column", round(cur, 4) AS current_mean, round(base, 4) AS baseline_mean, round((cur - base) / abs(base) * 100, 4) AS change_percent FROM d""")
def _(spark, folder):
    found = anomalies.baseline_drift(*_drift_sides(spark, folder))
    return found.withColumns({c: F.round(c, 4) for c in ("current_mean", "baseline_mean", "change_percent")})


_DRIFT_RATIO = "abs((cur - base) / abs(base) * 100) / 20.0"


@SET.add("drift_vs_baseline", _DRIFT + f"""
SELECT 'baseline_drift' AS anomaly_type, {SEVERITY.format(r=_DRIFT_RATIO)} AS severity,
  {CONFIDENCE.format(s=SEVERITY.format(r=_DRIFT_RATIO))} AS confidence_score, "column" AS affected_column, round(cur, 4) AS observed_value,
  round(base, 4) AS expected_value, round((cur - base) / abs(base) * 100, 4) AS deviation, 'mean_drift_vs_baseline' AS method
FROM d WHERE abs((cur - base) / abs(base) * 100) >= 20""")
def _(spark, folder):
    return anomalies.drift_anomalies(*_drift_sides(spark, folder)).select(*PUBLIC)


_RATE = "round(count(*) FILTER (NOT value <= 60) * 100.0::DOUBLE / count(value), 4)"


@SET.add("sla_violation", f"""
WITH r AS (SELECT {_RATE} AS rate FROM events), s AS (SELECT rate, CASE WHEN rate >= 50 THEN 'critical' WHEN rate >= 25 THEN 'high'
  WHEN rate >= 10 THEN 'medium' ELSE 'low' END AS severity FROM r)
SELECT 'sla_violation' AS anomaly_type, severity, {CONFIDENCE.format(s='severity')} AS confidence_score, 'value' AS affected_column,
  rate AS observed_value, 0.0::DOUBLE AS expected_value, rate AS deviation, 'threshold_comparison' AS method FROM s WHERE rate > 0""")
def _(spark, folder):
    return anomalies.sla_violations(table(spark, folder, "events"), "value", 60).select(*PUBLIC)


def all_anomalies(spark, folder):
    """Every detector on the event stream table; the base of the root-cause queries."""
    return anomalies.detect_all(
        table(spark, folder, "events"), numeric=["value"], time="ts", value="value", keys=["event_id"],
        sla={"column": "value", "threshold": 60}, frequency="D", multiplier=1.0, growth_threshold=15.0,
    )


# The same anomalies in SQL: outliers, spikes and sudden changes of the daily mean, degradation and SLA.
_ALL_SQL = f"""
WITH s AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q3,
   avg(value) AS mean, stddev_pop(value) AS sd, mad(value) AS mad FROM events),
 n AS (SELECT event_id, value, abs(round(value, 4) - round(med, 4)) / round(q3 - q1, 4) AS r FROM events, s
   WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) OR abs((value - mean) / sd) > 3
     OR abs(0.6745 * (value - med) / mad) > 3.5),
 b AS (SELECT cast(ts AS DATE) AS period, avg(value) AS v FROM events GROUP BY 1),
 p AS (SELECT period, round(v, 4) AS v, round(avg(v) OVER r, 4) AS rm, round(stddev_samp(v) OVER r, 4) AS rs,
   round((v / lag(v) OVER o - 1) * 100, 4) AS g FROM b
   WINDOW o AS (ORDER BY period), r AS (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
 o AS (SELECT ts, value, row_number() OVER (ORDER BY ts DESC, value DESC) AS i, count(*) OVER () AS n FROM events),
 m AS (SELECT avg(value) FILTER (i > greatest(2, n // 3)) AS base, avg(value) FILTER (i <= greatest(2, n // 3)) AS recent FROM o),
 q AS (SELECT {_RATE} AS rate FROM events),
 a AS (SELECT 'numeric_outlier' AS t, {SEVERITY.format(r='r')} AS severity, '' AS period FROM n
  UNION ALL SELECT 'time_series_spike', {SEVERITY.format(r='abs((v - rm) / rs)')}, strftime(period, '%Y-%m') FROM p WHERE rs > 0 AND v > rm + rs
  UNION ALL SELECT 'sudden_change', {SEVERITY.format(r='abs(g) / 15.0')}, strftime(period, '%Y-%m') FROM p WHERE abs(g) >= 15.0
  UNION ALL SELECT 'performance_degradation', {SEVERITY.format(r='abs((recent - base) / abs(base) * 100) / 20.0')}, 'late' FROM m
    WHERE (recent - base) / abs(base) * 100 >= 20
  UNION ALL SELECT 'sla_violation', CASE WHEN rate >= 50 THEN 'critical' WHEN rate >= 25 THEN 'high' WHEN rate >= 10 THEN 'medium' ELSE 'low' END, ''
    FROM q WHERE rate > 0)"""


@SET.add("detect_all", _ALL_SQL + "SELECT t AS anomaly_type, severity, count(*) AS anomaly_count FROM a GROUP BY 1, 2")
def _(spark, folder):
    found = all_anomalies(spark, folder)
    return found.groupBy("anomaly_type", "severity").agg(F.count(F.lit(1)).alias("anomaly_count"))


@SET.add("anomaly_union", _LIMITS + "SELECT method, count(*) AS rows FROM o GROUP BY 1")
def _(spark, folder):
    events = table(spark, folder, "events")
    parts = [anomalies.numeric_anomalies(events, ["value"], ["event_id"], [m]) for m in outliers.METHODS]
    return anomalies.anomaly_union(parts).groupBy("method").agg(F.count(F.lit(1)).alias("rows"))


@SET.add("anomaly_summary", _ALL_SQL + """
SELECT t AS anomaly_type, count(*) AS anomaly_count, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'medium') AS medium,
  count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'critical') AS critical FROM a GROUP BY 1""")
def _(spark, folder):
    return anomalies.anomaly_summary(all_anomalies(spark, folder))


_CHANGE_OF_M = "(recent - base) / abs(base) * 100"


@SET.add("top_anomalies", _ALL_SQL + f""",
 x AS (SELECT 'numeric_outlier' AS anomaly_type, {SEVERITY.format(r='r')} AS severity, NULL::VARCHAR AS period, round(value, 4) AS observed_value,
   round(med, 4) AS expected_value, round(round(value, 4) - round(med, 4), 4) AS deviation,
   CASE WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) THEN 'iqr' WHEN abs((value - mean) / sd) > 3 THEN 'zscore'
     ELSE 'modified_zscore' END AS method, '{{"event_id":"' || event_id || '"}}' AS row_id FROM n, s
  UNION ALL SELECT 'time_series_spike', {SEVERITY.format(r='abs((v - rm) / rs)')}, cast(period AS VARCHAR), v, rm, round(v - rm, 4), 'rolling_mean_std', NULL
    FROM p WHERE rs > 0 AND v > rm + rs
  UNION ALL SELECT 'sudden_change', {SEVERITY.format(r='abs(g) / 15.0')}, cast(period AS VARCHAR), v, rm, g, 'period_over_period_growth', NULL
    FROM p WHERE abs(g) >= 15.0
  UNION ALL SELECT 'performance_degradation', {SEVERITY.format(r=f'abs({_CHANGE_OF_M}) / 20.0')}, 'late', round(recent, 4), round(base, 4),
    round({_CHANGE_OF_M}, 4), 'recent_window_vs_baseline_mean', NULL FROM m WHERE {_CHANGE_OF_M} >= 20
  UNION ALL SELECT 'sla_violation', CASE WHEN rate >= 50 THEN 'critical' WHEN rate >= 25 THEN 'high' WHEN rate >= 10 THEN 'medium' ELSE 'low' END, NULL,
    rate, 0.0, rate, 'threshold_comparison', NULL FROM q WHERE rate > 0)
SELECT row_id, anomaly_type, severity, {CONFIDENCE.format(s='severity')} AS confidence_score, 'value' AS affected_column, observed_value, expected_value,
  deviation, method FROM x
ORDER BY confidence_score DESC, abs(deviation) DESC NULLS LAST, anomaly_type, period NULLS FIRST, observed_value, row_id NULLS FIRST, method LIMIT 10""")
def _(spark, folder):
    return anomalies.top_anomalies(all_anomalies(spark, folder)).select("row_id", *PUBLIC)


@SET.add("extreme_from_summary", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(min({c}), 2) AS min, round(max({c}), 2) AS max, round(avg({c}), 4) AS mean,
    round(stddev_samp({c}), 4) AS std FROM {t} HAVING max({c}) > avg({c}) + 3 * stddev_samp({c})
    OR min({c}) < avg({c}) - 3 * stddev_samp({c}) OR max({c}) / abs(avg({c})) >= 5"""
    for t, c in (("events", "value"),)))
def _(spark, folder):
    found = outliers.extreme_from_summary(summary_numeric(table(spark, folder, "events"), ["value"]))
    return found.withColumns({"min": F.round("min", 2), "max": F.round("max", 2), "mean": F.round("mean", 4), "std": F.round("std", 4)})


@SET.add("rca_related", _ALL_SQL + """
, k AS (SELECT 'same_column' AS reason, 'value' AS key, count(*) AS c FROM a
  UNION ALL SELECT 'same_or_similar_period', period, count(*) FROM a WHERE period <> '' GROUP BY 2
  UNION ALL SELECT 'same_anomaly_type', t, count(*) FROM a GROUP BY 2
  UNION ALL SELECT 'trend_or_degradation_signal', 'trend', count(*) FROM a WHERE t IN ('time_series_spike', 'sudden_change', 'performance_degradation')),
 l AS (SELECT count(*) FILTER (severity = 'low') AS n1, count(*) FILTER (severity = 'medium') AS n2,
   count(*) FILTER (severity = 'high') AS n3, count(*) FILTER (severity = 'critical') AS n4 FROM a)
SELECT reason, key, c AS members, c * (c - 1) // 2 AS related_pairs FROM k WHERE c > 1
UNION ALL SELECT 'similar_severity', 'adjacent', n1 + n2 + n3 + n4,
  n1 * (n1 - 1) // 2 + n2 * (n2 - 1) // 2 + n3 * (n3 - 1) // 2 + n4 * (n4 - 1) // 2 + n1 * n2 + n2 * n3 + n3 * n4 FROM l""")
def _(spark, folder):
    return rootcause.rca_related(all_anomalies(spark, folder))


_CAUSES = _ALL_SQL + f"""
, lv AS (SELECT *, CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END AS lvl FROM a),
 g AS (SELECT count(*) AS n, max(lvl) AS top, round(avg({CONFIDENCE.format(s='severity')}), 4) AS conf,
   string_agg(DISTINCT t, ',' ORDER BY t) AS types FROM lv)"""


@SET.add("rca_components", _CAUSES + """
SELECT n AS anomaly_count, ['low', 'medium', 'high', 'critical'][top] AS severity, conf AS confidence_score,
  'value' AS affected_metrics, types AS anomaly_types FROM g""")
def _(spark, folder):
    found = rootcause.rca_components(all_anomalies(spark, folder))
    return found.select(
        "anomaly_count", "severity", "confidence_score", F.array_join("affected_metrics", ",").alias("affected_metrics"),
        F.array_join("anomaly_types", ",").alias("anomaly_types"),
    )


@SET.add("rca_causes", _CAUSES + """
SELECT n + 1 AS evidence_count, n AS anomaly_count, ['low', 'medium', 'high', 'critical'][top] AS severity,
  round(least(0.99, conf + least(0.2, greatest(0, n) * 0.03) + top * 0.03), 4) AS confidence_score,
  CASE WHEN types LIKE '%performance_degradation%' THEN 'Possible operational degradation on value'
    WHEN types LIKE '%sla_violation%' THEN 'Possible systematic SLA breach on value'
    WHEN types LIKE '%sudden_change%' OR types LIKE '%spike%' THEN 'Possible temporary operational event on value'
    ELSE 'Possible extreme value on value' END AS title FROM g""")
def _(spark, folder):
    profiled = summary_numeric(table(spark, folder, "events"), ["value"]).select("column")
    found = rootcause.rca_causes(all_anomalies(spark, folder), profiled)
    return found.select("evidence_count", "anomaly_count", "severity", "confidence_score", "title")


@SET.add("rca_rank", _CAUSES + """
SELECT 1::BIGINT AS rank, ['low', 'medium', 'high', 'critical'][top] AS severity, n AS evidence_count FROM g""")
def _(spark, folder):
    ranked = rootcause.rca_rank(rootcause.rca_causes(all_anomalies(spark, folder)))
    return ranked.select("rank", "severity", "evidence_count")


# The lines of a supplier and flag are one analysis; every tenth supplier and the flag N stand for "unknown", which is a
# key as well. A supplier has two or three kinds of anomaly, so that an analysis can have several components.
_ANALYSES = f"""
WITH l AS (SELECT CASE WHEN l_suppkey % 10 <> 0 THEN l_suppkey END AS supplier, nullif(l_returnflag, 'N') AS flag, l_quantity AS q, l_discount AS d, l_tax AS x,
   l_suppkey % 3 AS kind, strftime(l_shipdate, '%Y-%m') AS month FROM lineitem),
 a AS (SELECT supplier, flag, 'numeric_outlier' AS t, {SEVERITY.format(r='q / 12')} AS severity, 'l_quantity' AS col, '' AS period FROM l WHERE q >= 48
  UNION ALL SELECT supplier, flag, 'sla_violation', {SEVERITY.format(r='d * 12')}, 'l_discount', '' FROM l WHERE d >= 0.1 AND kind = 0
  UNION ALL SELECT supplier, flag, 'sla_violation', {SEVERITY.format(r='d * 12')}, '', '' FROM l WHERE d <= 0.01 AND kind = 1
  UNION ALL SELECT supplier, flag, 'time_series_spike', {SEVERITY.format(r='x * 40')}, 'l_tax', month FROM l WHERE x >= 0.08 AND kind = 2),
 v AS (SELECT *, CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END AS lvl FROM a),
 p AS (SELECT supplier, flag, lvl, 'c' AS kind, col AS k FROM v WHERE col <> '' UNION SELECT supplier, flag, lvl, 'p', period FROM v WHERE period <> ''
  UNION SELECT supplier, flag, lvl, 't', t FROM v UNION SELECT supplier, flag, lvl, 'x', '' FROM v WHERE t = 'time_series_spike'),
 e AS (SELECT DISTINCT b.supplier, b.flag, b.lvl AS f, c.lvl AS g FROM p b JOIN p c ON b.supplier IS NOT DISTINCT FROM c.supplier
   AND b.flag IS NOT DISTINCT FROM c.flag AND (b.kind = c.kind AND b.k = c.k OR abs(b.lvl - c.lvl) = 1)),
 r AS (SELECT supplier, flag, f, g FROM e UNION SELECT e.supplier, e.flag, e.f, n.g FROM e JOIN e n ON e.supplier IS NOT DISTINCT FROM n.supplier
   AND e.flag IS NOT DISTINCT FROM n.flag AND e.g = n.f),
 w AS (SELECT supplier, flag, f, min(g) AS g FROM r GROUP BY ALL),
 z AS (SELECT w.supplier, w.flag, w.f, min(n.g) AS component FROM w JOIN w n ON w.supplier IS NOT DISTINCT FROM n.supplier
   AND w.flag IS NOT DISTINCT FROM n.flag AND w.g = n.f GROUP BY ALL),
 m AS (SELECT v.*, component FROM v JOIN z ON v.supplier IS NOT DISTINCT FROM z.supplier AND v.flag IS NOT DISTINCT FROM z.flag AND lvl = f)"""


def _supplier_anomalies(spark, folder):
    """Anomaly records of the lines, with the columns that tell analyses apart."""
    lines = table(spark, folder, "lineitem")
    kind = F.col("l_suppkey") % 3
    checks = (
        ("numeric_outlier", "l_quantity", F.col("l_quantity") / 12, None, F.col("l_quantity") >= 48),
        ("sla_violation", "l_discount", F.col("l_discount") * 12, None, (F.col("l_discount") >= 0.1) & (kind == 0)),
        ("sla_violation", None, F.col("l_discount") * 12, None, (F.col("l_discount") <= 0.01) & (kind == 1)),
        ("time_series_spike", "l_tax", F.col("l_tax") * 40, F.date_format("l_shipdate", "yyyy-MM-dd"), (F.col("l_tax") >= 0.08) & (kind == 2)),
    )
    records = [F.when(applies, F.struct(
        F.lit(name).alias("anomaly_type"), F.lit(column).cast("string").alias("affected_column"), numeric.severity_from_ratio(ratio).alias("severity"),
        (period if period is not None else F.lit(None)).cast("string").alias("affected_period"))) for name, column, ratio, period, applies in checks]
    found = lines.select(
        F.when(F.col("l_suppkey") % 10 != 0, F.col("l_suppkey")).alias("supplier"), F.nullif("l_returnflag", F.lit("N")).alias("flag"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line"), F.explode(F.array_compact(F.array(*records))).alias("_r"),
    ).select("supplier", "flag", "line", "_r.*")
    return found.select(
        "*", F.concat_ws("|", "line", "anomaly_type").alias("anomaly_id"), numeric.confidence_for_severity(F.col("severity")).alias("confidence_score"))


_ANALYSIS = ["supplier", "flag"]


@SET.add("rca_components_keyed", _ANALYSES + f"""
SELECT supplier, flag, component::INTEGER AS component, count(*) AS anomaly_count, ['low', 'medium', 'high', 'critical'][max(lvl)] AS severity,
  round(avg({CONFIDENCE.format(s='severity')}), 4) AS confidence_score, coalesce(string_agg(DISTINCT nullif(col, ''), ',' ORDER BY nullif(col, '')), '') AS affected_metrics,
  coalesce(string_agg(DISTINCT nullif(period, ''), ',' ORDER BY nullif(period, '')), '') AS affected_periods, string_agg(DISTINCT t, ',' ORDER BY t) AS anomaly_types
FROM m GROUP BY supplier, flag, component""")
def _(spark, folder):
    found = rootcause.rca_components(_supplier_anomalies(spark, folder), _ANALYSIS)
    lists = ("affected_metrics", "affected_periods", "anomaly_types")
    return found.select(
        *_ANALYSIS, "component", "anomaly_count", "severity", "confidence_score", *[F.array_join(c, ",").alias(c) for c in lists])


@SET.add("rca_rank_keyed", _ANALYSES + f""",
 g AS (SELECT supplier, flag, component, count(*) AS n, max(lvl) AS top, round(avg({CONFIDENCE.format(s='severity')}), 4) AS conf FROM m GROUP BY ALL)
SELECT supplier, flag, ['low', 'medium', 'high', 'critical'][top] AS severity, n AS evidence_count,
  round(least(0.99, conf + least(0.2, greatest(0, n - 1) * 0.03) + top * 0.03), 4) AS confidence_score,
  row_number() OVER (PARTITION BY supplier, flag ORDER BY top DESC) AS rank FROM g""")
def _(spark, folder):
    ranked = rootcause.rca_rank(rootcause.rca_causes(_supplier_anomalies(spark, folder), keys=_ANALYSIS), _ANALYSIS)
    return ranked.select(*_ANALYSIS, "severity", "evidence_count", "confidence_score", "rank")


@SET.add("rca_related_keyed", _ANALYSES + """,
 k AS (SELECT supplier, flag, 'same_column' AS reason, col AS key, count(*) AS c FROM v WHERE col <> '' GROUP BY ALL
  UNION ALL SELECT supplier, flag, 'same_or_similar_period', period, count(*) FROM v WHERE period <> '' GROUP BY ALL
  UNION ALL SELECT supplier, flag, 'same_anomaly_type', t, count(*) FROM v GROUP BY ALL
  UNION ALL SELECT supplier, flag, 'trend_or_degradation_signal', 'trend', count(*) FROM v WHERE t = 'time_series_spike' GROUP BY ALL),
 n AS (SELECT supplier, flag, count(*) FILTER (lvl = 1) AS n1, count(*) FILTER (lvl = 2) AS n2, count(*) FILTER (lvl = 3) AS n3,
   count(*) FILTER (lvl = 4) AS n4 FROM v GROUP BY ALL)
SELECT supplier, flag, reason, key, c AS members, c * (c - 1) // 2 AS related_pairs FROM k WHERE c > 1
UNION ALL SELECT supplier, flag, 'similar_severity', 'adjacent', n1 + n2 + n3 + n4,
  n1 * (n1 - 1) // 2 + n2 * (n2 - 1) // 2 + n3 * (n3 - 1) // 2 + n4 * (n4 - 1) // 2 + n1 * n2 + n2 * n3 + n3 * n4 FROM n""")
def _(spark, folder):
    return rootcause.rca_related(_supplier_anomalies(spark, folder), _ANALYSIS)


@SET.add("fn_severity", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity / 10 >= 4 THEN 'critical' WHEN l_quantity / 10 >= 2.5 THEN 'high'
  WHEN l_quantity / 10 >= 1.25 THEN 'medium' ELSE 'low' END AS by_ratio, CASE WHEN l_quantity >= 50 THEN 'critical'
  WHEN l_quantity >= 25 THEN 'high' WHEN l_quantity >= 10 THEN 'medium' ELSE 'low' END AS by_rate FROM lineitem""")
def _(spark, folder):
    quantity = F.col("l_quantity")
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", numeric.severity_from_ratio(quantity / 10).alias("by_ratio"),
        numeric.severity_from_rate(quantity).alias("by_rate"),
    )


@SET.add("fn_confidence", f"""
SELECT event_id, {CONFIDENCE.format(s=SEVERITY.format(r='value / 20'))} AS confidence FROM events""")
def _(spark, folder):
    level = numeric.severity_from_ratio(F.col("value") / 20)
    return table(spark, folder, "events").select("event_id", numeric.confidence_for_severity(level).alias("confidence"))


_POSITIVE = "c_acctbal >= 0"


@SET.add("subset_vs_baseline", """
WITH v AS (SELECT 'baseline' AS side, c_acctbal AS x FROM customer UNION ALL SELECT 'subset', c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'),
 q AS (SELECT side, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.95) AS p95, quantile_cont(x, 0.75) + 1.5 *
   (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) AS fence FROM v WHERE x >= 0 GROUP BY 1),
 r AS (SELECT v.side, any_value(med) AS med, any_value(p95) AS p95, avg((x > fence)::INT) AS ratio FROM v JOIN q ON v.side = q.side WHERE x >= 0 GROUP BY 1),
 b AS (SELECT * FROM r WHERE side = 'baseline'), s AS (SELECT * FROM r WHERE side = 'subset')
SELECT (SELECT count(*) FROM customer) AS baseline_rows, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS subset_rows,
  round(b.med, 4) AS baseline_median, round(s.med, 4) AS subset_median, round(b.p95, 4) AS baseline_p95, round(s.p95, 4) AS subset_p95,
  round((s.med - b.med) / abs(b.med) * 100, 4) AS median_pct, round((s.p95 - b.p95) / abs(b.p95) * 100, 4) AS p95_pct,
  round(s.ratio - b.ratio, 4) AS outlier_ratio_delta, CASE WHEN (s.p95 - b.p95) / abs(b.p95) * 100 > 10 THEN 'subset_worse'
  WHEN (s.p95 - b.p95) / abs(b.p95) * 100 < -10 THEN 'subset_better' ELSE 'subset_similar' END AS conclusion FROM b, s""")
def _(spark, folder):
    found = outliers.subset_vs_baseline(table(spark, folder, "customer"), F.col("c_mktsegment") == "BUILDING", "c_acctbal")
    rounded = ("baseline_median", "subset_median", "baseline_p95", "subset_p95", "median_pct", "p95_pct", "outlier_ratio_delta")
    return found.withColumns({c: F.round(c, 4) for c in rounded})


SALES_SQL = """(SELECT l_extendedprice * (1 - l_discount) AS revenue, l_extendedprice * l_tax * 10 AS cost, l_discount AS churn,
  o_orderpriority AS channel, c_mktsegment AS segment, strftime(o_orderdate, '%Y-%m') AS month
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def sales(spark, folder):
    lines, orders, customers = (table(spark, folder, t) for t in ("lineitem", "orders", "customer"))
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, orders.o_custkey == customers.c_custkey)
    return joined.select(
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        (F.col("l_extendedprice") * F.col("l_tax") * 10).alias("cost"),
        F.col("l_discount").alias("churn"), F.col("o_orderpriority").alias("channel"),
        F.col("c_mktsegment").alias("segment"), F.date_format("o_orderdate", "yyyy-MM").alias("month"),
    )


_SUMS = """round(sum(revenue), 2) AS revenue, round(sum(cost), 2) AS cost, round(sum(revenue) - sum(cost), 2) AS margin,
  round((sum(revenue) - sum(cost)) / sum(revenue), 6) AS margin_rate, round(avg(churn), 6) AS churn_rate"""


def _rounded(df):
    return df.withColumns({
        "revenue": F.round("revenue", 2), "cost": F.round("cost", 2), "margin": F.round("margin", 2),
        "margin_rate": F.round("margin_rate", 6), "churn_rate": F.round("churn_rate", 6),
    })


@SET.add("business_totals", f"SELECT {_SUMS} FROM {SALES_SQL}")
def _(spark, folder):
    return _rounded(business.business_totals(sales(spark, folder), "revenue", "cost", "churn"))


@SET.add("business_by_dim", f"""
SELECT channel AS name, {_SUMS} FROM {SALES_SQL} GROUP BY 1 ORDER BY sum(revenue) - sum(cost) DESC, 1 LIMIT 6""")
def _(spark, folder):
    return _rounded(business.business_by_dim(sales(spark, folder), "channel", "revenue", "cost", "churn", 6))


@SET.add("business_periods", f"""
SELECT month AS period, round(sum(revenue), 2) AS revenue FROM {SALES_SQL} GROUP BY 1 ORDER BY 1 LIMIT 12""")
def _(spark, folder):
    return business.business_periods(sales(spark, folder), "month", "revenue", 12).withColumn("revenue", F.round("revenue", 2))


@SET.add("business_trend", f"""
WITH p AS (SELECT month, sum(revenue) AS r FROM {SALES_SQL} GROUP BY 1), e AS (SELECT min(month) AS f, max(month) AS l,
  arg_min(r, month) AS fr, arg_max(r, month) AS lr FROM p)
SELECT f AS first_period, l AS last_period, round(fr, 2) AS first_revenue, round(lr, 2) AS last_revenue,
  round((lr - fr) / fr, 6) AS revenue_growth_rate FROM e""")
def _(spark, folder):
    found = business.business_trend(sales(spark, folder), "month", "revenue")
    return found.withColumns({
        "first_revenue": F.round("first_revenue", 2), "last_revenue": F.round("last_revenue", 2),
        "revenue_growth_rate": F.round("revenue_growth_rate", 6),
    })


@SET.add("business_extremes", f"""
WITH c AS (SELECT channel AS name, sum(revenue) AS r, sum(cost) AS c FROM {SALES_SQL} GROUP BY 1),
 s AS (SELECT segment AS name, avg(churn) AS churn FROM {SALES_SQL} GROUP BY 1)
SELECT 'lowest_margin_rate' AS finding, arg_min(name, (r - c) / r) AS name, round(min((r - c) / r), 6) AS value FROM c
UNION ALL SELECT 'highest_cost_ratio', arg_max(name, c / r), round(max(c / r), 6) FROM c
UNION ALL SELECT 'highest_churn', arg_max(name, churn), round(max(churn), 6) FROM s""")
def _(spark, folder):
    rows = sales(spark, folder)
    by_channel = business.business_by_dim(rows, "channel", "revenue", "cost", "churn")
    by_segment = business.business_by_dim(rows, "segment", "revenue", "cost", "churn")
    return business.business_extremes(by_channel, by_segment).withColumn("value", F.round("value", 6))


@SET.add("ticket_overview", """
WITH t AS (SELECT o_orderstatus AS s, o_orderdate AS o, l_shipdate AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 m AS (SELECT last_day(cast(c AS DATE)) AS p, count(*) AS n FROM t GROUP BY 1)
SELECT 'status ' || s AS item, count(*)::DOUBLE AS value FROM t GROUP BY s
UNION ALL SELECT 'valid_closures', count(c)::DOUBLE FROM t
UNION ALL SELECT 'peak ' || (SELECT cast(p AS VARCHAR) FROM m ORDER BY n DESC, p LIMIT 1), max(n)::DOUBLE FROM m
UNION ALL SELECT 'average_hours', round(avg(h), 4) FROM (SELECT date_diff('microsecond', o, c) / 3600e6 AS h FROM t) WHERE h >= 0""")
def _(spark, folder):
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    tickets = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    parts = business.ticket_overview(tickets, "o_orderstatus", "o_orderdate", "l_shipdate")
    status = parts["by_status"].select(F.concat(F.lit("status "), "value").alias("item"), F.col("count").cast("double").alias("value"))
    ends = parts["closure_ends"]
    return (
        status.unionByName(ends.select(F.lit("valid_closures").alias("item"), F.col("valid_closures").cast("double").alias("value")))
        .unionByName(ends.select(F.concat(F.lit("peak "), F.col("peak_period").cast("string")).alias("item"),
                                 F.col("peak_closures").cast("double").alias("value")))
        .unionByName(parts["elapsed"].select(F.lit("average_hours").alias("item"), F.col("average_hours").alias("value")))
    )


@SET.add("kpi_rows", """
SELECT 'rows' AS name, count(*)::DOUBLE AS value, 'volume' AS kind FROM customer UNION ALL SELECT 'columns', 5::DOUBLE, 'structure'
UNION ALL SELECT 'mean c_acctbal', round(avg(c_acctbal), 4), 'numeric_metric' FROM customer
UNION ALL SELECT 'sum c_acctbal', round(sum(c_acctbal), 2), 'numeric_metric' FROM customer
UNION ALL SELECT 'min c_acctbal', round(min(c_acctbal), 4), 'numeric_metric' FROM customer
UNION ALL SELECT 'max c_acctbal', round(max(c_acctbal), 4), 'numeric_metric' FROM customer""")
def _(spark, folder):
    from tablewise.operators.report import kpi_rows

    found = kpi_rows(table(spark, folder, "customer"), ["c_acctbal"])
    return found.withColumn("value", F.when(F.col("name").startswith("sum"), F.round("value", 2)).otherwise(F.round("value", 4)))


@SET.add("segment_leaders", """
WITH v AS (SELECT 'o_orderstatus' AS c, o_orderstatus AS x, count(*) AS n FROM orders GROUP BY 2
  UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2)
SELECT c AS "column", count(*) AS segments, (SELECT x FROM v w WHERE w.c = v.c ORDER BY n DESC, x LIMIT 1) AS leading_segment,
  max(n) AS leading_value, round(max(n) / sum(n) * 100, 2) AS leading_share_percent FROM v GROUP BY c HAVING max(n) / sum(n) < 0.95""")
def _(spark, folder):
    from tablewise.operators.report import segment_leaders

    return segment_leaders(table(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority"])
