"""Durations, trends and concentration in time over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewise.functions import dates
from tablewise.operators import durations, report, timeseries
from tablewise.operators.ordering import lag_in_chunks
from tablewise.plans.registry import QuerySet, table

SET = QuerySet()

SHIPPED_SQL = """(SELECT o_orderkey, o_orderdate, l_shipdate, l_returnflag, o_orderstatus, l_linenumber
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def shipped(spark, folder):
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        "o_orderkey", "o_orderdate", "l_shipdate", "l_returnflag", "o_orderstatus", "l_linenumber"
    )


DAYS = "(date_diff('microsecond', o_orderdate, l_shipdate) / 86400e6)"
HOURS = "(date_diff('microsecond', o_orderdate, l_shipdate) / 3600e6)"


@SET.add("datetime_shift", """
SELECT event_id, ts + INTERVAL 5 HOUR AS "ts_ADJUSTED" FROM events""")
def _(spark, folder):
    return durations.datetime_shift(table(spark, folder, "events"), "ts", 5).select("event_id", "ts_ADJUSTED")


@SET.add("datetime_shift_report", """
SELECT count(ts) AS parsed_count, count(*) - count(ts) AS missing_count, cast(0 AS BIGINT) AS failed_parse_count,
  min(ts) AS min_before, max(ts) AS max_before, min(ts) + INTERVAL 1 HOUR AS min_after, max(ts) + INTERVAL 1 HOUR AS max_after
FROM events""")
def _(spark, folder):
    return durations.datetime_shift_report(table(spark, folder, "events"), "ts", 1)


@SET.add("duration_feature", f"""
SELECT o_orderkey, l_linenumber, round({DAYS}, 6) AS days FROM {SHIPPED_SQL}""")
def _(spark, folder):
    featured = durations.duration_feature(shipped(spark, folder), "o_orderdate", "l_shipdate", "days")
    return featured.select("o_orderkey", "l_linenumber", F.round("days", 6).alias("days"))


@SET.add("duration_report", f"""
SELECT count({DAYS}) AS valid_count, count(*) - count({DAYS}) AS missing_count,
  count(*) FILTER ({DAYS} < 0) AS negative_duration_count, count(*) - count(o_orderdate) AS start_parse_errors,
  count(*) - count(l_shipdate) AS end_parse_errors FROM {SHIPPED_SQL}""")
def _(spark, folder):
    return durations.duration_report(shipped(spark, folder), "o_orderdate", "l_shipdate")


_BETWEEN = f"""count({HOURS}) FILTER ({HOURS} >= 0) AS valid_rows, round(avg({HOURS}) FILTER ({HOURS} >= 0), 4) AS average_hours,
  round(quantile_cont({HOURS}, 0.5) FILTER ({HOURS} >= 0), 4) AS median_hours,
  round(min({HOURS}) FILTER ({HOURS} >= 0), 4) AS min_hours, round(max({HOURS}) FILTER ({HOURS} >= 0), 4) AS max_hours"""


@SET.add("duration_between_dates", f"SELECT {_BETWEEN} FROM {SHIPPED_SQL}")
def _(spark, folder):
    return durations.duration_between_dates(shipped(spark, folder), "o_orderdate", "l_shipdate")


@SET.add("elapsed_summary", f"""
SELECT {_BETWEEN}, count(*) AS total_rows, count(*) - count({HOURS}) FILTER ({HOURS} >= 0) AS excluded_rows FROM {SHIPPED_SQL}""")
def _(spark, folder):
    return durations.elapsed_summary(shipped(spark, folder), "o_orderdate", "l_shipdate")


@SET.add("activation_profile", f"""
WITH d AS (SELECT {DAYS} AS d FROM {SHIPPED_SQL}),
 q AS (SELECT quantile_cont(d, 0.25) AS q1, quantile_cont(d, 0.5) AS q2, quantile_cont(d, 0.75) AS q3, quantile_cont(d, 0.95) AS p95 FROM d)
SELECT count(d) AS valid_count, count(*) - count(d) AS missing_count, count(*) FILTER (d < 0) AS negative_duration_count,
  round(avg(d), 4) AS mean, round(quantile_cont(d, 0.5), 4) AS median, round(quantile_cont(d, 0.75), 4) AS p75,
  round(quantile_cont(d, 0.9), 4) AS p90, round(quantile_cont(d, 0.95), 4) AS p95, round(quantile_cont(d, 0.99), 4) AS p99,
  round(any_value(q3 - q1), 4) AS iqr, round(mad(d), 4) AS mad,
  count(*) FILTER (d < q1 - 1.5 * (q3 - q1) OR d > q3 + 1.5 * (q3 - q1)) AS outlier_count,
  any_value(q2 > 0 AND q.p95 / q2 >= 2) AS long_tail FROM d, q""")
def _(spark, folder):
    found = durations.activation_profile(shipped(spark, folder), "o_orderdate", "l_shipdate")
    return found.withColumns({c: F.round(c, 4) for c in ("mean", "median", "p75", "p90", "p95", "p99", "iqr", "mad")})


@SET.add("activation_by_method", f"""
WITH d AS (SELECT l_returnflag AS method, {DAYS} AS d FROM {SHIPPED_SQL}), m AS (SELECT method, avg(d) AS m FROM d GROUP BY 1)
SELECT method, round(m, 4) AS mean_metric, m = (SELECT max(m) FROM m) AS is_leader,
  (SELECT quantile_cont(d, 0.95) >= greatest(2 * quantile_cont(d, 0.5), quantile_cont(d, 0.5) + 1) FROM d) AS long_tail FROM m""")
def _(spark, folder):
    featured = durations.duration_feature(shipped(spark, folder), "o_orderdate", "l_shipdate", "days")
    found = durations.activation_by_method(featured, "days", "l_returnflag")
    return found.withColumn("mean_metric", F.round("mean_metric", 4))


@SET.add("time_trend", """
WITH b AS (SELECT make_date(cast(year(o_orderdate) AS INTEGER), 12, 31) AS period, sum(o_totalprice) AS v FROM orders GROUP BY 1),
 s AS (SELECT make_date(cast(y AS INTEGER), 12, 31) AS period FROM generate_series(
   (SELECT min(year(o_orderdate)) FROM orders), (SELECT max(year(o_orderdate)) FROM orders)) t(y))
SELECT s.period, round(coalesce(v, 0), 2) AS value, 'Y' AS frequency FROM s LEFT JOIN b ON s.period = b.period""")
def _(spark, folder):
    found = timeseries.time_trend(table(spark, folder, "orders"), "o_orderdate", "o_totalprice", "sum")
    return found.withColumn("value", F.round("value", 2))


@SET.add("time_trend_daily", """
SELECT cast(ts AS DATE) AS period, round(avg(value), 6) AS value, 'D' AS frequency FROM events GROUP BY 1""")
def _(spark, folder):
    found = timeseries.time_trend(table(spark, folder, "events"), "ts", "value", "mean")
    return found.withColumn("value", F.round("value", 6))


@SET.add("time_trend_gaps", """
WITH t AS (SELECT CASE WHEN event_type = 'error' AND value > 250 THEN cast(ts AS DATE) END AS d FROM events), e AS (SELECT d FROM t WHERE d IS NOT NULL),
 s AS (SELECT cast(x AS DATE) AS d FROM generate_series((SELECT min(d) FROM e)::TIMESTAMP, (SELECT max(d) FROM e)::TIMESTAMP, INTERVAL 1 DAY) t(x))
SELECT s.d AS period, count(e.d) AS value, 'D' AS frequency FROM s LEFT JOIN e ON s.d = e.d GROUP BY 1""")
def _(spark, folder):
    rare = F.when((F.col("event_type") == "error") & (F.col("value") > 250), F.col("ts"))
    return timeseries.time_trend(table(spark, folder, "events").withColumn("ts", rare), "ts")


_STATS = """
WITH b AS (SELECT {start} AS period, avg({x}) AS value FROM {t} GROUP BY 1),
 w AS (SELECT period, value, avg(value) OVER r AS rm, stddev_samp(value) OVER r AS rs,
   (value / lag(value) OVER o - 1) * 100 AS g, first(value) OVER a AS f, last(value) OVER a AS l FROM b
   WINDOW o AS (ORDER BY period), r AS (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
   a AS (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""
_ORDER_STATS = _STATS.format(start="cast(date_trunc('month', o_orderdate) AS DATE)", x="o_totalprice", t="orders")


def _order_stats(spark, folder):
    return timeseries.trend_stats(table(spark, folder, "orders"), "o_orderdate", "o_totalprice")


@SET.add("trend_stats", _ORDER_STATS + """
SELECT period, round(value, 4) AS value, round(rm, 4) AS rolling_mean, round(rs, 4) AS rolling_std, round(g, 4) AS growth_percent,
  round(f, 4) AS first_value, round(l, 4) AS last_value, round((l - f) / abs(f) * 100, 4) AS total_growth_percent FROM w""")
def _(spark, folder):
    stats = _order_stats(spark, folder)
    return stats.select("period", *[F.round(c, 4).alias(c) for c in stats.columns if c != "period"])


@SET.add("rolling_mean", _ORDER_STATS + "SELECT period, round(rm, 4) AS rolling_mean FROM w")
def _(spark, folder):
    return _order_stats(spark, folder).select("period", F.round("rolling_mean", 4).alias("rolling_mean"))


@SET.add("rolling_std", _ORDER_STATS + "SELECT period, round(rs, 4) AS rolling_std FROM w")
def _(spark, folder):
    return _order_stats(spark, folder).select("period", F.round("rolling_std", 4).alias("rolling_std"))


@SET.add("period_growth", _ORDER_STATS + "SELECT period, round(g, 4) AS growth_percent FROM w")
def _(spark, folder):
    return _order_stats(spark, folder).select("period", F.round("growth_percent", 4).alias("growth_percent"))


@SET.add("total_growth", _ORDER_STATS + """
SELECT round(any_value(f), 4) AS first_value, round(any_value(l), 4) AS last_value,
  round(any_value((l - f) / abs(f) * 100), 4) AS total_growth_percent FROM w""")
def _(spark, folder):
    names = ("first_value", "last_value", "total_growth_percent")
    return _order_stats(spark, folder).select(*[F.round(c, 4).alias(c) for c in names]).distinct()


@SET.add("trend_direction", """
WITH p AS (SELECT make_date(cast(year(o_orderdate) AS INTEGER), 12, 31) AS period, count(*) AS v FROM orders GROUP BY 1),
 e AS (SELECT arg_min(v, period)::DOUBLE AS f, arg_max(v, period)::DOUBLE AS l FROM p)
SELECT f AS first_value, l AS last_value, round(l - f, 4) AS absolute_change,
  CASE WHEN f <> 0 AND f * l >= 0 AND abs(f) >= 1 THEN round((l - f) / abs(f) * 100, 2) END AS percentage_change,
  CASE WHEN l > f THEN 'rising' WHEN l < f THEN 'falling' ELSE 'stable' END AS direction,
  (SELECT period FROM p ORDER BY v DESC, period LIMIT 1) AS peak_period, (SELECT max(v)::DOUBLE FROM p) AS peak_value,
  (SELECT period FROM p ORDER BY v, period LIMIT 1) AS minimum_period, (SELECT min(v)::DOUBLE FROM p) AS minimum_value FROM e""")
def _(spark, folder):
    return timeseries.trend_direction(timeseries.time_trend(table(spark, folder, "orders"), "o_orderdate"))


@SET.add("event_volume_trend", """
WITH b AS (SELECT last_day(cast(o_orderdate AS DATE)) AS period, count(*) AS n FROM orders GROUP BY 1),
 s AS (SELECT last_day(cast(x AS DATE)) AS period FROM generate_series(
  (SELECT date_trunc('month', min(o_orderdate)) FROM orders)::TIMESTAMP, (SELECT max(o_orderdate) FROM orders)::TIMESTAMP, INTERVAL 1 MONTH) t(x))
SELECT s.period, coalesce(n, 0) AS value, 'M' AS frequency FROM s LEFT JOIN b ON s.period = b.period""")
def _(spark, folder):
    return timeseries.event_volume_trend(table(spark, folder, "orders"), "o_orderdate")


@SET.add("weekly_mean_median", """
SELECT cast(date_trunc('week', ts) AS DATE) + 6 AS week_end, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median
FROM events GROUP BY 1""")
def _(spark, folder):
    found = timeseries.weekly_mean_median(table(spark, folder, "events"), "ts", "value")
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "median")})


_CONCENTRATION = """
WITH v AS (SELECT cast(ts AS DATE) AS day, value AS m FROM events),
 q AS (SELECT quantile_cont(m, 0.25) AS q1, quantile_cont(m, 0.75) AS q3, quantile_cont(m, 0.95) AS p95 FROM v),
 t AS (SELECT CASE WHEN q3 + 1.5 * (q3 - q1) > q3 THEN least(p95, q3 + 1.5 * (q3 - q1)) ELSE p95 END AS threshold FROM q),
 d AS (SELECT day, count(*) FILTER (m >= threshold) AS outlier_count, count(*) AS total_count, any_value(threshold) AS threshold FROM v, t GROUP BY 1)"""


@SET.add("daily_ratio", _CONCENTRATION + """
SELECT day, outlier_count, total_count, round(threshold, 6) AS threshold, round(outlier_count / total_count, 4) AS outlier_ratio
FROM d WHERE outlier_count > 0""")
def _(spark, folder):
    found = timeseries.daily_ratio(table(spark, folder, "events"), "ts", "value")
    return found.withColumn("threshold", F.round("threshold", 6))


@SET.add("top_days", _CONCENTRATION + """
SELECT day, outlier_count, total_count, round(outlier_count / total_count, 4) AS outlier_ratio
FROM d WHERE outlier_count > 0 ORDER BY outlier_count DESC, day LIMIT 10""")
def _(spark, folder):
    days = timeseries.daily_ratio(table(spark, folder, "events"), "ts", "value")
    return timeseries.top_days(days).drop("threshold")


@SET.add("temporal_concentration", _CONCENTRATION + """
, o AS (SELECT * FROM d WHERE outlier_count > 0)
SELECT cast(sum(outlier_count) AS BIGINT) AS outlier_count, round(max(threshold), 4) AS outlier_threshold, count(*) AS outlier_days,
  (SELECT day FROM o ORDER BY outlier_count DESC, day LIMIT 1) AS top_day, max(outlier_count) AS top_day_outliers,
  CASE WHEN max(outlier_count) / sum(outlier_count) >= 0.5 THEN 'concentrated' ELSE 'distributed' END AS conclusion FROM o""")
def _(spark, folder):
    return timeseries.temporal_concentration(table(spark, folder, "events"), "ts", "value")


@SET.add("daily_outlier_counts", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events WHERE value >= 0)
SELECT cast(ts AS DATE) AS day, count(*) AS outlier_count FROM events, q WHERE value > q3 + 1.5 * (q3 - q1) GROUP BY 1""")
def _(spark, folder):
    return timeseries.daily_outlier_counts(table(spark, folder, "events"), "ts", "value")


@SET.add("hist_30", """
WITH v AS (SELECT 'l_quantity' AS c, l_quantity AS x FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem),
 e AS (SELECT c, min(x) AS lo, max(x) AS hi FROM v GROUP BY 1),
 b AS (SELECT v.c, cast(least(30, floor((x - lo) / ((hi - lo) / 30)) + 1) AS INTEGER) AS bin, count(*) AS n FROM v JOIN e ON v.c = e.c GROUP BY 1, 2),
 s AS (SELECT c, lo, hi, cast(i AS INTEGER) AS bin FROM e, generate_series(1, 30) t(i))
SELECT s.c AS "column", s.bin, round(lo + (hi - lo) / 30 * (s.bin - 1), 4) AS lower, round(lo + (hi - lo) / 30 * s.bin, 4) AS upper,
  coalesce(n, 0) AS count FROM s LEFT JOIN b ON s.c = b.c AND s.bin = b.bin""")
def _(spark, folder):
    found = report.histogram(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice"])
    return found.withColumns({c: F.round(c, 4) for c in ("lower", "upper")})


@SET.add("box_stats", """
SELECT l_returnflag, count(*) AS n, min(l_extendedprice) AS min, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1,
  round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3,
  max(l_extendedprice) AS max, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std
FROM lineitem GROUP BY 1""")
def _(spark, folder):
    found = report.box_stats(table(spark, folder, "lineitem"), "l_extendedprice", "l_returnflag")
    return found.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3", "mean", "std")})


@SET.add("status_bar", "SELECT o_orderstatus AS value, count(*) AS count FROM orders GROUP BY 1")
def _(spark, folder):
    from tablewise.operators.counts import count_occurrences

    return count_occurrences(table(spark, folder, "orders"), "o_orderstatus", None)


@SET.add("snapshot_change", """
SELECT user_id, event_id, event_type FROM (
  SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events)
WHERE previous IS NULL OR previous <> event_type""")
def _(spark, folder):
    events = table(spark, folder, "events")
    seen = lag_in_chunks(events, ["user_id"], "event_id", "event_type", "previous", chunk_width=1000)
    changed = F.col("previous").isNull() | (F.col("previous") != F.col("event_type"))
    return seen.where(changed).select("user_id", "event_id", "event_type")


@SET.add("fn_parse_datetime_strict", """
WITH d AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y')
   WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') WHEN 3 THEN strftime(o_orderdate, '%d-%m-%Y') ELSE '31/02/2026' END AS text FROM orders)
SELECT o_orderkey, coalesce(try_strptime(text, '%Y-%m-%dT%H:%M:%S'), try_strptime(text, '%Y-%m-%d'),
  try_strptime(text, '%d/%m/%Y'), try_strptime(text, '%d-%m-%Y')) AS parsed FROM d""")
def _(spark, folder):
    day = F.col("o_orderdate")
    text = (
        F.when(F.col("o_orderkey") % 5 == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(F.col("o_orderkey") % 5 == 1, F.date_format(day, "dd/MM/yyyy"))
        .when(F.col("o_orderkey") % 5 == 2, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(F.col("o_orderkey") % 5 == 3, F.date_format(day, "dd-MM-yyyy"))
        .otherwise("31/02/2026")
    )
    return table(spark, folder, "orders").select("o_orderkey", dates.parse_strict(text).alias("parsed"))


@SET.add("fn_parse_datetime", """
WITH d AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y%m%d') WHEN 1 THEN strftime(ts, '%Y%m%d%H%M%S')
   WHEN 2 THEN cast(date_diff('day', DATE '1899-12-30', cast(ts AS DATE)) AS VARCHAR) ELSE 'not a date' END AS text FROM events)
SELECT event_id, CASE event_id % 4 WHEN 0 THEN try_strptime(text, '%Y%m%d') WHEN 1 THEN try_strptime(text, '%Y%m%d%H%M%S')
   WHEN 2 THEN TIMESTAMP '1899-12-30' + to_days(try_cast(text AS INTEGER)) END AS parsed FROM d""")
def _(spark, folder):
    at = F.col("ts")
    text = (
        F.when(F.col("event_id") % 4 == 0, F.date_format(at, "yyyyMMdd"))
        .when(F.col("event_id") % 4 == 1, F.date_format(at, "yyyyMMddHHmmss"))
        .when(F.col("event_id") % 4 == 2, F.datediff(at, F.lit("1899-12-30").cast("date")).cast("string"))
        .otherwise("not a date")
    )
    return table(spark, folder, "events").select("event_id", dates.parse_text(text).alias("parsed"))


@SET.add("fn_has_time", """
SELECT event_type, avg(CASE WHEN hour(ts) + minute(ts) + second(ts) > 0 THEN 1.0 ELSE 0.0 END) >= 0.1 AS has_time FROM events GROUP BY 1""")
def _(spark, folder):
    return table(spark, folder, "events").groupBy("event_type").agg(dates.has_time(F.col("ts")).alias("has_time"))


@SET.add("fn_period_key", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'no period in this long text'
  WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m')
  ELSE strftime(o_orderdate, '%Y-%m') || '-' || strftime(o_orderdate + INTERVAL 40 DAY, '%Y-%m') END AS period FROM orders""")
def _(spark, folder):
    day, key = F.col("o_orderdate"), F.col("o_orderkey")
    text = F.when(key % 3 == 0, "no period in this long text").otherwise(F.concat(F.lit("on "), day.cast("string")))
    later = (day + F.make_dt_interval(days=F.lit(40))).cast("string")
    period = F.when(key % 3 == 2, dates.period_range_key(day.cast("string"), later)).otherwise(dates.period_key(text))
    return table(spark, folder, "orders").select("o_orderkey", period.alias("period"))


@SET.add("fn_duration_text", f"""
WITH d AS (SELECT o_orderkey, l_linenumber, cast(abs({HOURS} * 3600) AS BIGINT) + l_linenumber * 4000 AS s FROM {SHIPPED_SQL})
SELECT o_orderkey, l_linenumber, concat_ws(', ', CASE WHEN s // 86400 > 0 THEN (s // 86400) || ' giorni' END,
  CASE WHEN s % 86400 // 3600 > 0 THEN (s % 86400 // 3600) || ' ore' END,
  CASE WHEN s % 3600 // 60 > 0 OR s < 3600 THEN (s % 3600 // 60) || ' minuti' END) AS duration FROM d""")
def _(spark, folder):
    seconds = F.abs(dates.elapsed(F.col("o_orderdate"), F.col("l_shipdate"), "hours") * 3600) + F.col("l_linenumber") * 4000
    return shipped(spark, folder).select("o_orderkey", "l_linenumber", dates.duration_text(seconds).alias("duration"))
