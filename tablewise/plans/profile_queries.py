"""Column semantics, informativeness and column picking over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewise.operators import profiling
from tablewise.plans.overview import overview_long
from tablewise.plans.registry import QuerySet, table

SET = QuerySet()

# Columns of the profiled tables with their kind, as known from the schemas.
COLUMNS = {
    "orders": [("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "text"), ("o_totalprice", "numeric"),
               ("o_orderdate", "datetime"), ("o_orderpriority", "text")],
    "lineitem": [("l_linenumber", "numeric"), ("l_quantity", "numeric"), ("l_extendedprice", "numeric"), ("l_discount", "numeric"),
                 ("l_tax", "numeric"), ("l_returnflag", "text"), ("l_linestatus", "text"), ("l_shipdate", "datetime")],
    "labels": [("doc_id", "numeric"), ("quality", "numeric"), ("toxic", "numeric")],
    "documents": [("lang", "text"), ("source", "text"), ("text", "text"), ("n_chars", "numeric")],
}


def _like(terms):
    return "(" + " OR ".join(f"name LIKE '%{t}%'" for t in terms) + ")"


def _facts_sql(name):
    parts = []
    for position, (column, kind) in enumerate(COLUMNS[name]):
        dated, clock = ("1.0", f"avg((hour({column}) + minute({column}) + second({column}) > 0)::INT)") if kind == "datetime" else ("0.0", "0.0")
        parts.append(f"""SELECT '{column}' AS "column", '{column.replace('_', '')}' AS name, '{kind}' AS kind, {position} AS position,
          count(*) AS n, count({column}) AS known, count(DISTINCT {column}) AS d, {dated} AS date_ratio, {clock} AS time_ratio,
          bool_and(lower(trim(cast({column} AS VARCHAR))) IN ('true','false','0','1','yes','no','si','sì')) AS bool_like,
          (SELECT max(c) FROM (SELECT count(*) AS c FROM {name} GROUP BY {column})) AS dominant FROM {name}""")
    return "WITH f AS (" + " UNION ALL ".join(parts) + ")"


_LIMIT = "least(50, greatest(10, floor(n * 0.5)))"


def _semantics_sql(name):
    rules = [
        (_like(profiling.DURATION_TERMS), "'DURATION'", 0.88),
        (f"({_like(profiling.DATE_TERMS)} AND date_ratio >= 0.3)", "CASE WHEN time_ratio >= 0.1 THEN 'DATETIME' ELSE 'DATE' END", 0.92),
        (_like(profiling.IDENTIFIER_TERMS), "'IDENTIFIER'", 0.95),
        ("bool_like", "'BOOLEAN'", 0.9),
        (_like(profiling.STATUS_TERMS), "'STATUS'", 0.9),
        (_like(profiling.AMOUNT_TERMS), "'AMOUNT'", 0.88),
        ("kind = 'datetime'", "'DATETIME'", 0.9),
        ("kind = 'numeric' AND n >= 10 AND d / known >= 0.95", "'IDENTIFIER'", 0.78),
        ("kind = 'numeric'", "'METRIC'", 0.75),
        (f"d BETWEEN 2 AND {_LIMIT}", "'CATEGORY'", 0.75),
        (f"d > {_LIMIT}", "'CODE'", 0.65),
    ]
    kind = "CASE " + " ".join(f"WHEN {c} THEN {t}" for c, t, _s in rules) + " ELSE 'UNKNOWN' END"
    score = "CASE " + " ".join(f"WHEN {c} THEN {s}::DOUBLE" for c, _t, s in rules) + " ELSE 0.4 END"
    return _facts_sql(name) + f""", s AS (SELECT "column", {kind} AS semantic_type, {score} AS confidence, d AS cardinality,
      round(d / known, 4) AS unique_ratio, kind AS dtype, position FROM f)"""


def _semantics(spark, folder, name):
    return profiling.column_semantics(table(spark, folder, name), [c for c, _k in COLUMNS[name]])


@SET.add("column_semantics", _semantics_sql("orders") + "SELECT * FROM s")
def _(spark, folder):
    return _semantics(spark, folder, "orders")


@SET.add("column_semantics_documents", _semantics_sql("documents") + "SELECT * FROM s")
def _(spark, folder):
    return _semantics(spark, folder, "documents")


@SET.add("column_semantics_labels", _semantics_sql("labels") + "SELECT * FROM s")
def _(spark, folder):
    return _semantics(spark, folder, "labels")


@SET.add("column_informativeness", _facts_sql("lineitem") + f"""
, k AS (SELECT *, CASE WHEN {_like(profiling.CHART_IDENTIFIER_TERMS)} THEN 'IDENTIFIER' WHEN {_like(profiling.CHART_METRIC_TERMS)} THEN 'METRIC'
   WHEN {_like(profiling.CHART_DATE_TERMS)} AND date_ratio >= 0.3 THEN 'DATE' WHEN bool_like THEN 'BOOLEAN'
   WHEN kind = 'numeric' AND d / n > 0.9 AND n >= 10 THEN 'IDENTIFIER' WHEN kind = 'numeric' THEN 'METRIC'
   WHEN d BETWEEN 2 AND {_LIMIT} THEN 'CATEGORY' WHEN d > {_LIMIT} THEN 'CODE' ELSE 'UNKNOWN' END AS semantic_type FROM f),
 r AS (SELECT *, CASE WHEN semantic_type = 'IDENTIFIER' THEN 'identifier' WHEN semantic_type = 'CODE' AND (d > 30 OR d / n > 0.5) THEN 'technical_code_high_cardinality'
   WHEN d <= 1 THEN 'constant' WHEN dominant / n > 0.95 THEN 'quasi_constant' WHEN semantic_type = 'UNKNOWN' THEN 'unsupported_semantic_type' ELSE '' END AS reason FROM k)
SELECT "column", semantic_type, reason, reason = '' AS chart_allowed, d AS distinct_count, round(dominant / n, 4) AS dominant_ratio,
  n - known AS missing_count, known - d AS duplicate_count FROM r""")
def _(spark, folder):
    found = profiling.column_informativeness(table(spark, folder, "lineitem"), [c for c, _k in COLUMNS["lineitem"]])
    return found.drop("dominant_value")


@SET.add("business_metric_filter", _semantics_sql("lineitem") + """
SELECT "column", semantic_type FROM s WHERE semantic_type IN ('METRIC', 'AMOUNT', 'PERCENTAGE', 'DURATION')""")
def _(spark, folder):
    return profiling.business_metrics(_semantics(spark, folder, "lineitem"))


@SET.add("pick_metric", _semantics_sql("lineitem") + """
SELECT "column", semantic_type FROM s WHERE semantic_type IN ('METRIC', 'AMOUNT', 'PERCENTAGE', 'DURATION') AND dtype = 'numeric' ORDER BY position LIMIT 1""")
def _(spark, folder):
    return profiling.pick_metric(_semantics(spark, folder, "lineitem"))


@SET.add("pick_dimension", _semantics_sql("orders") + """
SELECT "column", cardinality, ("column"[3:7] = 'order')::INT AS matches,
  (cardinality BETWEEN 1 AND greatest(50, floor((SELECT count(*) FROM orders) * 0.5)))::INT AS useful, position
FROM s WHERE dtype = 'text' AND semantic_type <> 'IDENTIFIER'""")
def _(spark, folder):
    orders = table(spark, folder, "orders")
    return profiling.pick_dimension(_semantics(spark, folder, "orders"), orders.count(), ["orderpriorities"])


@SET.add("pick_time_axis", """
SELECT 'l_shipdate' AS time_axis, count(l_shipdate) AS valid_values FROM lineitem""")
def _(spark, folder):
    lines = table(spark, folder, "lineitem")
    axis = profiling.pick_time_axis(lines)
    return lines.agg(F.count(axis).alias("valid_values")).select(F.lit(axis).alias("time_axis"), "valid_values")


@SET.add("pick_pair", """
SELECT 'o_orderdate' AS start_column, 'l_shipdate' AS end_column, count(*) AS rows FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def _(spark, folder):
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select("o_orderdate", "o_orderstatus", "l_shipdate")
    start, end = profiling.pick_pair(joined, ["orderdate"], ["shipdate"])
    return joined.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(start).alias("start_column"), F.lit(end).alias("end_column"), "rows")


@SET.add("auto_overview", """
WITH y AS (SELECT year(o_orderdate) AS y, sum(o_orderkey) AS v FROM orders GROUP BY 1)
SELECT 'category-distribution' AS step, o_orderstatus AS item, count(*)::DOUBLE AS value FROM orders GROUP BY 2
UNION ALL SELECT 'time-trend', y || '-12-31', v::DOUBLE FROM y
UNION ALL (SELECT 'top-category-2', o_orderpriority, sum(o_orderkey)::DOUBLE FROM orders GROUP BY 2 ORDER BY 3 DESC LIMIT 10)
UNION ALL SELECT 'numeric-summary', o_orderstatus, round(avg(o_orderkey), 4) FROM orders GROUP BY 2
UNION ALL SELECT 'duplicate-detection', 'duplicate_rows', 0""")
def _(spark, folder):
    return overview_long(table(spark, folder, "orders")).withColumn("value", F.round("value", 4))
