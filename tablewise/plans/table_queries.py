"""Counts, aggregates and quality checks over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewise.operators import aggregates, counts, quality
from tablewise.operators.correlation import corr_kendall, corr_pearson, corr_spearman, top_correlated_pairs
from tablewise.operators.shape import null_label
from tablewise.plans.registry import QuerySet, table

SET = QuerySet()

# Rows with gaps, derived the same way in both engines: the shared tables hold no nulls.
GAPS_SQL = """(SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END AS discount,
  CASE WHEN l_linenumber = 5 THEN NULL ELSE l_returnflag END AS flag,
  CASE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity END AS quantity,
  l_linestatus AS status FROM lineitem)"""


def gaps(spark, folder):
    line = F.col("l_linenumber")
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(line != 3, F.col("l_discount")).alias("discount"),
        F.when(line != 5, F.col("l_returnflag")).alias("flag"),
        F.when(line != 2, F.col("l_quantity")).alias("quantity"),
        F.col("l_linestatus").alias("status"),
    )


@SET.add("count_occurrences", f"""
SELECT coalesce(flag, 'N/D') AS value, count(*) AS count FROM {GAPS_SQL} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(spark, folder):
    return counts.count_occurrences(gaps(spark, folder), "flag", 10)


@SET.add("occurrence_totals", f"""
SELECT count(*) AS total_records, least(count(DISTINCT coalesce(flag, 'N/D')), 10) AS displayed_unique_values,
       count(DISTINCT flag) AS non_null_unique_values FROM {GAPS_SQL}""")
def _(spark, folder):
    return counts.occurrence_totals(gaps(spark, folder), "flag")


@SET.add("related_counts", """
WITH c AS (SELECT 'o_orderpriority' AS "column", o_orderpriority AS value, count(*) AS count FROM orders GROUP BY 2
  UNION ALL SELECT 'o_orderdate', cast(o_orderdate AS VARCHAR), count(*) FROM orders GROUP BY 2)
SELECT "column", value, count, cast(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank FROM c) WHERE rank <= 10""")
def _(spark, folder):
    return counts.related_counts(table(spark, folder, "orders"), ["o_orderpriority", "o_orderdate"], 10)


GROUPS = [
    {"label": "URGENT", "operator": "include", "values": ["1-URGENT"]},
    {"label": "NOT URGENT", "operator": "exclude", "values": ["1-URGENT", "5-LOW"]},
]
GROUP_CASE = """CASE WHEN o_orderpriority = '1-URGENT' THEN 'URGENT'
  WHEN o_orderpriority NOT IN ('1-URGENT', '5-LOW') THEN 'NOT URGENT' ELSE 'ALTRO' END"""


@SET.add("semantic_groups", f"""
SELECT {GROUP_CASE} AS label, count(*) AS count, count(DISTINCT o_orderpriority) AS source_value_count
FROM orders GROUP BY 1""")
def _(spark, folder):
    return counts.semantic_groups(table(spark, folder, "orders"), "o_orderpriority", GROUPS)


@SET.add("semantic_group_values", f"""
SELECT {GROUP_CASE} AS label, o_orderpriority AS value, count(*) AS count FROM orders GROUP BY 1, 2""")
def _(spark, folder):
    return counts.semantic_group_values(table(spark, folder, "orders"), "o_orderpriority", GROUPS)


@SET.add("cross_tab", """
WITH d AS (SELECT o_orderstatus AS p, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS r FROM orders),
 spine AS (SELECT * FROM (SELECT DISTINCT p FROM d) CROSS JOIN (SELECT DISTINCT coalesce(r, 'N/D') AS r FROM d)),
 c AS (SELECT p, coalesce(r, 'N/D') AS r, count(*) AS n FROM d GROUP BY 1, 2)
SELECT spine.p AS primary_value, spine.r AS related_value, coalesce(n, 0) AS count,
  cast(sum(coalesce(n, 0)) OVER (PARTITION BY spine.p) AS BIGINT) AS total,
  round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY spine.p) * 100, 2) AS share_percent
FROM spine LEFT JOIN c ON spine.p = c.p AND spine.r = c.r""")
def _(spark, folder):
    orders = table(spark, folder, "orders").withColumn(
        "priority", F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority"))
    )
    return counts.cross_tab(orders, "o_orderstatus", "priority")


@SET.add("share_of_total", """
SELECT p_type AS value, count(*) AS count, round(count(*) / sum(count(*)) OVER () * 100, 4) AS share_percent
FROM part GROUP BY 1""")
def _(spark, folder):
    return counts.share_of_total(table(spark, folder, "part"), "p_type")


@SET.add("null_label", f"""
SELECT coalesce(flag, 'N/D') AS flag, status, count(*) AS count FROM {GAPS_SQL} GROUP BY 1, 2""")
def _(spark, folder):
    df = gaps(spark, folder)
    return df.groupBy(null_label(F.col("flag")).alias("flag"), "status").agg(F.count(F.lit(1)).alias("count"))


@SET.add("top_n_metric", f"""
SELECT flag AS value, round(coalesce(sum(quantity), 0), 2) AS metric FROM {GAPS_SQL}
GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 3""")
def _(spark, folder):
    top = counts.top_n(gaps(spark, folder), "flag", "quantity", "sum", 3)
    return top.withColumn("metric", F.round("metric", 2))


@SET.add("top_n_count", """
SELECT cast(o_custkey AS VARCHAR) AS value, count(*) AS metric FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(spark, folder):
    return counts.top_n(table(spark, folder, "orders"), "o_custkey", limit=10)


@SET.add("numeric_aggregation", f"""
SELECT flag AS "group", round(avg(discount), 6) AS value FROM {GAPS_SQL} GROUP BY 1""")
def _(spark, folder):
    grouped = aggregates.numeric_aggregation(gaps(spark, folder), "discount", "mean", "flag")
    return grouped.withColumn("value", F.round("value", 6))


@SET.add("numeric_aggregation_sum", """
SELECT o_orderstatus AS "group", round(coalesce(sum(o_totalprice), 0), 2) AS value FROM orders GROUP BY 1""")
def _(spark, folder):
    grouped = aggregates.numeric_aggregation(table(spark, folder, "orders"), "o_totalprice", "sum", "o_orderstatus")
    return grouped.withColumn("value", F.round("value", 2))


@SET.add("numeric_aggregation_total", f"""
SELECT round(sum(discount), 4) AS result, count(discount) AS count FROM {GAPS_SQL}""")
def _(spark, folder):
    return aggregates.numeric_aggregation(gaps(spark, folder), "discount").withColumn("result", F.round("result", 4))


def _summary_sql(columns, source):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(sum({c}), 2) AS sum, round(avg({c}), 4) AS mean,
        round(quantile_cont({c}, 0.5), 4) AS median, cast(min({c}) AS DOUBLE) AS min, cast(max({c}) AS DOUBLE) AS max,
        round(coalesce(stddev_samp({c}), 0), 4) AS std, count(*) - count({c}) AS missing FROM {source}"""
        for c in columns
    )


@SET.add("summary_numeric", _summary_sql(["discount", "quantity", "l_linenumber"], GAPS_SQL))
def _(spark, folder):
    summary = aggregates.summary_numeric(gaps(spark, folder), ["discount", "quantity", "l_linenumber"])
    return summary.withColumns({
        "sum": F.round("sum", 2), "mean": F.round("mean", 4), "median": F.round("median", 4), "std": F.round("std", 4),
    })


@SET.add("metric_kpis", """
SELECT 'c_acctbal' AS "column", round(avg(c_acctbal), 2) AS mean, round(stddev_samp(c_acctbal), 2) AS std,
  round(min(c_acctbal), 2) AS min, round(max(c_acctbal), 2) AS max FROM customer""")
def _(spark, folder):
    summary = aggregates.summary_numeric(table(spark, folder, "customer"), ["c_acctbal"])
    return summary.select("column", *[F.round(c, 2).alias(c) for c in ("mean", "std", "min", "max")])


@SET.add("summary_categorical", f"""
WITH v AS (SELECT 'flag' AS "column", flag AS value FROM {GAPS_SQL} UNION ALL SELECT 'status', status FROM {GAPS_SQL}),
 c AS (SELECT "column", value, count(*) AS count FROM v WHERE value IS NOT NULL GROUP BY 1, 2),
 t AS (SELECT "column", count(DISTINCT value) AS distinct_values, count(*) - count(value) AS missing FROM v GROUP BY 1)
SELECT t."column", distinct_values, missing, cast(rank AS INTEGER) AS rank, value, count FROM t JOIN (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank FROM c) r
ON t."column" = r."column" WHERE rank <= 5""")
def _(spark, folder):
    return aggregates.summary_categorical(gaps(spark, folder), 5)


@SET.add("time_ranges", """
SELECT 'l_shipdate' AS "column", min(l_shipdate) AS min, max(l_shipdate) AS max, count(l_shipdate) AS valid_values
FROM lineitem""")
def _(spark, folder):
    return aggregates.time_ranges(table(spark, folder, "lineitem"))


PROFILE_COLUMNS = ["quantity", "discount"]


def _profile_sql(columns, source):
    parts = []
    for c in columns:
        quantiles = ", ".join(f"round(quantile_cont({c}, {p / 100}), 4) AS p{p}" for p in aggregates.PERCENTILES)
        parts.append(f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS missing_count,
        round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4) AS median, min({c}) AS min, max({c}) AS max,
        round(sum({c}), 2) AS sum, {quantiles}, round(max({c}) - min({c}), 4) AS range,
        round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS iqr, round(var_samp({c}), 4) AS variance,
        round(stddev_samp({c}), 4) AS std, round(stddev_samp({c}) / abs(avg({c})), 4) AS cv, round(mad({c}), 4) AS mad
        FROM {source}""")
    return " UNION ALL ".join(parts)


@SET.add("numeric_profile", _profile_sql(PROFILE_COLUMNS, GAPS_SQL))
def _(spark, folder):
    profile = aggregates.numeric_profile(gaps(spark, folder), PROFILE_COLUMNS)
    exact = ("column", "count", "missing_count", "min", "max")
    return profile.select(*[
        F.col(c) if c in exact else F.round(c, 2 if c == "sum" else 4).alias(c) for c in profile.columns
    ])


@SET.add("frequency_table", f"""
WITH c AS (SELECT flag AS value, count(*) AS count FROM {GAPS_SQL} WHERE flag IS NOT NULL GROUP BY 1)
SELECT value, count, round(count / (SELECT sum(count) FROM c) * 100, 4) AS share_percent,
  (SELECT count(*) FROM c) AS unique_count, (SELECT cast(sum(count) AS BIGINT) FROM c) AS non_null_count
FROM c ORDER BY count DESC, value LIMIT 10""")
def _(spark, folder):
    return aggregates.frequency_table(gaps(spark, folder), "flag", 10)


GAP_COLUMNS = ["l_orderkey", "l_linenumber", "discount", "flag", "quantity", "status"]


@SET.add("completeness", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count,
    round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 4) AS missing_percent, count({c}) AS complete_count,
    round(count({c}) * 100.0::DOUBLE / count(*), 4) AS completeness_percent FROM {GAPS_SQL}""" for c in GAP_COLUMNS))
def _(spark, folder):
    return quality.completeness(gaps(spark, folder))


@SET.add("completeness_total", f"""
WITH m AS (SELECT count(*) AS n, 3 * count(*) - count(discount) - count(flag) - count(quantity) AS missing FROM {GAPS_SQL})
SELECT n AS row_count, cast(6 AS BIGINT) AS column_count, n * 6 AS total_cells, missing AS total_missing,
  round((n * 6 - missing) * 100.0::DOUBLE / (n * 6), 4) AS overall_completeness_percent FROM m""")
def _(spark, folder):
    return quality.completeness_total(gaps(spark, folder))


@SET.add("null_detection", f"""
WITH m AS ({" UNION ALL ".join(f"SELECT '{c}' AS col, count(*) - count({c}) AS n, count(*) AS total FROM {GAPS_SQL}"
                                 for c in GAP_COLUMNS)})
SELECT col AS "column", n AS null_count, round(n / total * 100, 2) AS null_percent,
  (SELECT cast(sum(n) AS BIGINT) FROM m) AS total_nulls FROM m WHERE n > 0""")
def _(spark, folder):
    return quality.null_detection(gaps(spark, folder))


@SET.add("missing_severity", f"""
WITH m AS ({" UNION ALL ".join(f"SELECT '{c}' AS col, count(*) - count({c}) AS n, count(*) AS total FROM {GAPS_SQL}"
                                 for c in GAP_COLUMNS)})
SELECT col AS "column", n AS missing_count, round(n / total * 100, 2) AS missing_percent,
  CASE WHEN round(n / total * 100, 2) >= 20 THEN 'high' WHEN round(n / total * 100, 2) >= 5 THEN 'medium' ELSE 'low' END AS severity
FROM m WHERE n > 0""")
def _(spark, folder):
    return quality.missing_severity(gaps(spark, folder))


COPIES_SQL = """(SELECT l_returnflag, l_linestatus, l_quantity, CASE WHEN l_linenumber > 3 THEN l_discount END AS discount
  FROM lineitem)"""


def _copies(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_quantity",
        F.when(F.col("l_linenumber") > 3, F.col("l_discount")).alias("discount"),
    )


@SET.add("duplicate_detection", f"""
WITH g AS (SELECT count(*) AS c FROM {COPIES_SQL} GROUP BY l_returnflag, l_linestatus, l_quantity, discount)
SELECT cast(sum(c) AS BIGINT) AS row_count, cast(sum(c - 1) AS BIGINT) AS duplicate_rows,
  cast(coalesce(sum(c) FILTER (c > 1), 0) AS BIGINT) AS duplicate_groups_rows FROM g""")
def _(spark, folder):
    return quality.duplicate_detection(_copies(spark, folder))


@SET.add("duplicate_sample", f"""
SELECT l_returnflag, l_linestatus, l_quantity, discount, count(*) AS copies FROM {COPIES_SQL}
GROUP BY 1, 2, 3, 4 HAVING count(*) > 1
ORDER BY copies DESC, 1 NULLS FIRST, 2 NULLS FIRST, 3 NULLS FIRST, 4 NULLS FIRST LIMIT 5""")
def _(spark, folder):
    return quality.duplicate_sample(_copies(spark, folder))


@SET.add("validation_score", f"""
WITH g AS (SELECT count(*) AS c FROM {COPIES_SQL} GROUP BY l_returnflag, l_linestatus, l_quantity, discount),
 d AS (SELECT cast(sum(c) AS BIGINT) AS row_count, cast(sum(c - 1) AS BIGINT) AS duplicate_rows FROM g),
 m AS (SELECT count(*) - count(discount) AS total_missing FROM {COPIES_SQL})
SELECT row_count, total_missing, duplicate_rows,
  100 - CASE WHEN total_missing > 0 THEN 10 ELSE 0 END - CASE WHEN duplicate_rows > 0 THEN 5 ELSE 0 END AS score FROM d, m""")
def _(spark, folder):
    return quality.validation_score(_copies(spark, folder))


@SET.add("quality_rows", f"""
WITH g AS (SELECT count(*) AS c FROM {COPIES_SQL} GROUP BY l_returnflag, l_linestatus, l_quantity, discount)
SELECT 'missing_cells' AS note, count(*) - count(discount) AS value FROM {COPIES_SQL}
UNION ALL SELECT 'duplicate_rows', cast(sum(c - 1) AS BIGINT) FROM g
UNION ALL SELECT 'rows', count(*) FROM {COPIES_SQL} UNION ALL SELECT 'columns', 4""")
def _(spark, folder):
    from tablewise.operators.report import quality_rows

    return quality_rows(_copies(spark, folder))


@SET.add("threshold_check", f"""
SELECT count(quantity) AS valid_count, count(*) FILTER (quantity <= 40) AS compliant_count,
  count(quantity) - count(*) FILTER (quantity <= 40) AS breach_count,
  round(count(*) FILTER (quantity <= 40) * 100.0::DOUBLE / count(quantity), 4) AS compliance_rate,
  round((count(quantity) - count(*) FILTER (quantity <= 40)) * 100.0::DOUBLE / count(quantity), 4) AS breach_rate
FROM {GAPS_SQL}""")
def _(spark, folder):
    return quality.threshold_check(gaps(spark, folder), "quantity", 40, "<=")


@SET.add("threshold_breaches", """
SELECT event_id, value FROM events WHERE NOT (value < 100)""")
def _(spark, folder):
    return quality.threshold_breaches(table(spark, folder, "events"), "value", 100, "<", ["event_id"])


SIGNED_SQL = "(SELECT c_custkey, c_acctbal - 600 AS balance FROM customer)"


def _signed(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", (F.col("c_acctbal") - 600).alias("balance"))


@SET.add("positive_filter", f"SELECT c_custkey, round(balance, 2) AS balance FROM {SIGNED_SQL} WHERE balance >= 0")
def _(spark, folder):
    return quality.positive_rows(_signed(spark, folder), "balance").withColumn("balance", F.round("balance", 2))


@SET.add("quality_null_negatives", f"""
SELECT c_custkey, round(CASE WHEN balance >= 0 THEN balance END, 2) AS balance FROM {SIGNED_SQL}""")
def _(spark, folder):
    return quality.null_negatives(_signed(spark, folder), "balance").withColumn("balance", F.round("balance", 2))


@SET.add("quality_gate", f"""
SELECT 'balance' AS metric, count(*) FILTER (balance < 0) AS negative_count,
  round(count(*) FILTER (balance < 0) / count(*), 8) AS negative_ratio, count(*) - count(balance) AS missing_count,
  round((count(*) - count(balance)) / count(*), 8) AS missing_ratio,
  CASE WHEN count(*) FILTER (balance < 0) / count(*) > 0.05 THEN 'high' ELSE 'low' END AS severity,
  CASE WHEN count(*) FILTER (balance < 0) / count(*) > 0.05 THEN 'requires_user_decision' ELSE 'passed' END AS status
FROM {SIGNED_SQL}""")
def _(spark, folder):
    gate = quality.quality_gate(_signed(spark, folder), "balance")
    return gate.withColumns({c: F.round(c, 8) for c in ("negative_ratio", "missing_ratio")})


@SET.add("segment_usefulness", """
WITH v AS (SELECT 'l_returnflag' AS "column", l_returnflag AS value FROM lineitem
  UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem
  UNION ALL SELECT 'l_mostly', CASE WHEN l_orderkey % 50 = 0 THEN 'x' ELSE 'y' END FROM lineitem),
 c AS (SELECT "column", value, count(*) AS n FROM v GROUP BY 1, 2)
SELECT "column", count(*) AS segments, round(max(n) / sum(n), 4) AS leader_share,
  count(*) > 1 AND max(n) / sum(n) < 0.95 AS useful FROM c GROUP BY 1""")
def _(spark, folder):
    lines = table(spark, folder, "lineitem").withColumn(
        "l_mostly", F.when(F.col("l_orderkey") % 50 == 0, "x").otherwise("y")
    )
    return quality.segment_usefulness(lines, ["l_returnflag", "l_linestatus", "l_mostly"])


def _pearson_sql(columns, source):
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS left_column, '{b}' AS right_column, round(corr({a}, {b}), 6) AS correlation FROM {source}"""
        for a, b in pairs
    )


LINE_METRICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@SET.add("corr_pearson", _pearson_sql(["discount", "quantity", "l_linenumber"], GAPS_SQL))
def _(spark, folder):
    found = corr_pearson(gaps(spark, folder), ["discount", "quantity", "l_linenumber"])
    return found.withColumn("correlation", F.round("correlation", 6))


@SET.add("top_correlated_pairs", f"""
SELECT left_column, right_column, correlation, round(abs(correlation), 6) AS correlation_abs FROM
({_pearson_sql(LINE_METRICS, "lineitem")}) ORDER BY abs(correlation) DESC, 1, 2 LIMIT 3""")
def _(spark, folder):
    found = top_correlated_pairs(corr_pearson(table(spark, folder, "lineitem"), LINE_METRICS), 3)
    return found.withColumns({c: F.round(c, 6) for c in ("correlation", "correlation_abs")})


@SET.add("corr_spearman", """
WITH r AS (SELECT avg(p) OVER (PARTITION BY a) AS ra, avg(q) OVER (PARTITION BY b) AS rb FROM (
  SELECT l_quantity AS a, l_extendedprice AS b, row_number() OVER (ORDER BY l_quantity) AS p,
    row_number() OVER (ORDER BY l_extendedprice) AS q FROM lineitem))
SELECT 'l_quantity' AS left_column, 'l_extendedprice' AS right_column, round(corr(ra, rb), 6) AS correlation FROM r""")
def _(spark, folder):
    found = corr_spearman(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice")
    return found.withColumn("correlation", F.round("correlation", 6))


@SET.add("corr_kendall", """
WITH t AS (SELECT p_size AS x, p_retailprice AS y, count(*) AS n FROM part GROUP BY 1, 2),
 s AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS both FROM t),
 tx AS (SELECT sum(c * (c - 1) / 2) AS v FROM (SELECT sum(n) AS c FROM t GROUP BY x)),
 ty AS (SELECT sum(c * (c - 1) / 2) AS v FROM (SELECT sum(n) AS c FROM t GROUP BY y)),
 pairs AS (SELECT sum(a.n * b.n) FILTER (a.y < b.y) AS con, sum(a.n * b.n) FILTER (a.y > b.y) AS dis FROM t a JOIN t b ON a.x < b.x)
SELECT 'p_size' AS left_column, 'p_retailprice' AS right_column, round((con - dis) /
  (sqrt(s.n * (s.n - 1) / 2 - tx.v) * sqrt(s.n * (s.n - 1) / 2 - ty.v)), 6) AS correlation FROM s, tx, ty, pairs""")
def _(spark, folder):
    found = corr_kendall(table(spark, folder, "part"), "p_size", "p_retailprice")
    return found.withColumn("correlation", F.round("correlation", 6))


@SET.add("latency_percentiles", """
WITH o AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events)
SELECT any_value(n) AS requests, round((SELECT count(*) FILTER (event_type = 'error') / count(*) FROM events), 6) AS error_rate,
  max(value) FILTER (i = floor((n - 1) * 0.5)) AS p50, max(value) FILTER (i = floor((n - 1) * 0.95)) AS p95 FROM o""")
def _(spark, folder):
    found = aggregates.latency_percentiles(table(spark, folder, "events"), "value", F.col("event_type") == "error")
    return found.withColumn("error_rate", F.round("error_rate", 6))


@SET.add("benchmark_pass_rates", """
SELECT o_orderpriority AS domain, count(*) AS total, count(*) FILTER (o_orderstatus <> 'F') AS passed,
  count(*) FILTER (o_orderstatus = 'F') AS failed FROM orders GROUP BY 1""")
def _(spark, folder):
    return aggregates.pass_rates(table(spark, folder, "orders"), "o_orderpriority", F.col("o_orderstatus") != "F")


@SET.add("chunk_union", """
SELECT event_type, count(*) AS rows FROM events GROUP BY 1""")
def _(spark, folder):
    events = table(spark, folder, "events")
    parts = [events.where(F.col("value") < 50), events.where(F.col("value") >= 50)]
    return quality.chunk_union(parts).groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))


@SET.add("table_parity", """
SELECT 'left_only' AS side, count(*) AS rows FROM (SELECT o_orderkey, o_orderstatus FROM orders EXCEPT ALL
  SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'X' ELSE o_orderstatus END FROM orders)
UNION ALL SELECT 'right_only', count(*) FROM (
  SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'X' ELSE o_orderstatus END FROM orders
  EXCEPT ALL SELECT o_orderkey, o_orderstatus FROM orders)""")
def _(spark, folder):
    orders = table(spark, folder, "orders")
    changed = F.when(F.col("o_totalprice") > 400000, "X").otherwise(F.col("o_orderstatus"))
    return quality.table_parity(
        orders.select("o_orderkey", "o_orderstatus"),
        orders.select("o_orderkey", changed.alias("o_orderstatus")),
    )


@SET.add("parity_rows", """
WITH l AS (SELECT l_partkey, l_returnflag, l_tax FROM lineitem),
 r AS (SELECT l_partkey, CASE WHEN l_quantity > 45 THEN NULL ELSE l_returnflag END AS l_returnflag, l_tax FROM lineitem WHERE l_linenumber <> 7)
SELECT 'left_only' AS side, count(*) AS copies, * FROM (FROM l EXCEPT ALL FROM r) GROUP BY ALL
UNION ALL SELECT 'right_only', count(*), * FROM (FROM r EXCEPT ALL FROM l) GROUP BY ALL""")
def _(spark, folder):
    lines = table(spark, folder, "lineitem")
    flag = F.when(F.col("l_quantity") > 45, None).otherwise(F.col("l_returnflag"))
    return quality.differing_rows(
        lines.select("l_partkey", "l_returnflag", "l_tax"),
        lines.where("l_linenumber <> 7").select("l_partkey", flag.alias("l_returnflag"), "l_tax"),
    )


@SET.add("field_parity", """
SELECT 'o_orderstatus' AS field, count(*) FILTER (o_totalprice <= 400000 AND o_custkey <> 7) AS matched,
  count(*) FILTER (o_totalprice > 400000 AND o_custkey <> 7) AS mismatched, count(*) FILTER (o_custkey = 7) AS unpaired FROM orders""")
def _(spark, folder):
    orders = table(spark, folder, "orders")
    changed = F.when(F.col("o_totalprice") > 400000, "X").otherwise(F.col("o_orderstatus"))
    return quality.field_parity(
        orders.select("o_orderkey", "o_orderstatus"),
        orders.where("o_custkey <> 7").select("o_orderkey", changed.alias("o_orderstatus")),
        "o_orderkey",
    )
