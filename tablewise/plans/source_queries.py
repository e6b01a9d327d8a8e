"""Readers, guards and catalog over the shared tables, written out and read back where needed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.plans.registry import QuerySet, table
from tablewise.session import reliable_checkpoint, shared_folder
from tablewise.sources import catalog, files, sql, workbooks

SET = QuerySet()


def _as_csv(spark, df: DataFrame, name: str, separator: str = ",") -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}.csv"
    df.write.option("header", True).option("sep", separator).csv(path)
    return path


@SET.add("src_csv", """
SELECT o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total, min(o_orderdate) AS first_date FROM orders GROUP BY 1""")
def _(spark, folder):
    orders = table(spark, folder, "orders")
    read = files.read_csv(spark, _as_csv(spark, orders, "orders"), orders.schema)
    return read.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_orderdate").alias("first_date"))


@SET.add("src_csv_sniff", "SELECT ';' AS delimiter, count(*) AS rows, sum(c_custkey)::BIGINT AS keys FROM customer")
def _(spark, folder):
    path = _as_csv(spark, table(spark, folder, "customer"), "customer", ";")
    fmt = files.sniff_csv(spark, path)
    read = files.read_csv(spark, path, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", fmt)
    return read.agg(F.count(F.lit(1)).alias("rows"), F.sum("c_custkey").alias("keys")).select(F.lit(fmt.delimiter).alias("delimiter"), "rows", "keys")


@SET.add("src_guard", "SELECT count(*) AS rows, 4::INT AS columns FROM supplier")
def _(spark, folder):
    guarded, _fmt = files.guarded_csv(spark, _as_csv(spark, table(spark, folder, "supplier"), "supplier"), max_rows=10**9)
    return guarded.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(len(guarded.columns)).alias("columns"))


@SET.add("src_excel", """
SELECT o_orderstatus, o_orderpriority, count(*) AS orders, sum(o_orderkey + o_custkey)::BIGINT AS keys, round(sum(o_totalprice), 2) AS total,
  max(o_totalprice) AS dearest, min(o_orderdate) AS first_date FROM orders GROUP BY 1, 2""")
def _(spark, folder):
    orders = table(spark, folder, "orders")
    # Workbooks in the shared folder, as rows of path and content.
    books = reliable_checkpoint(workbooks.as_workbooks(orders))
    read = workbooks.read_excel(books, schema=orders.schema)
    return read.groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("orders"), F.sum(F.col("o_orderkey") + F.col("o_custkey")).alias("keys"), F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.max("o_totalprice").alias("dearest"), F.min("o_orderdate").alias("first_date"))


@SET.add("src_records", "SELECT event_id, cast(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, folder):
    return files.parse_records(table(spark, folder, "events").select("event_id", "props"), "props", "k bigint")


@SET.add("sql_readonly", """
SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def _(spark, folder):
    for name in ("customer", "nation"):
        table(spark, folder, name).createOrReplaceTempView(f"readonly_{name}")
    return sql.sql_readonly(spark, """-- customers per nation
      SELECT n_name, count(*) AS customers FROM readonly_customer JOIN readonly_nation ON c_nationkey = n_nationkey GROUP BY n_name;""")


PROFILED = ("region", "nation", "customer")
_PROFILE_COLUMNS = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string")],
}


def _catalog_sql():
    parts = []
    for name, columns in _PROFILE_COLUMNS.items():
        for position, (column, kind) in enumerate(columns):
            samples = "NULL" if kind == "double" else f"""(SELECT string_agg(v, '|' ORDER BY v) FROM (
              SELECT DISTINCT cast({column} AS VARCHAR) AS v FROM {name} WHERE {column} IS NOT NULL ORDER BY 1 LIMIT 6))"""
            parts.append(f"""SELECT '{name}' AS "table", '{column}' AS "column", '{kind}' AS type, {position} AS position, count(*) AS row_count,
              count(DISTINCT {column}) AS distinct_values, count(*) = count(DISTINCT {column}) AS unique_key, {samples} AS sample_values FROM {name}""")
    return " UNION ALL ".join(parts)


@SET.add("catalog_profile", _catalog_sql())
def _(spark, folder):
    found = catalog.catalog_profile({name: table(spark, folder, name) for name in PROFILED})
    # Doubles print differently in the two engines, so their samples are left out of the check.
    return found.withColumn("sample_values", F.when(F.col("type") != "double", F.col("sample_values")))


def _linked(spark, folder):
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    return {
        "customers": table(spark, folder, "customer").where("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("id"), "c_name"),
        "orders": orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("status")),
        "line": lines.select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("box_id"), "l_quantity"),
        "boxes": table(spark, folder, "part").select(F.col("p_partkey").alias("id"), "p_name"),
    }


@SET.add("fk_infer", """
SELECT 'orders' AS from_table, 'customer_id' AS from_column, 'customers' AS to_table, 'id' AS to_column, count(*) AS orphan_rows FROM orders
  WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3)
UNION ALL SELECT 'line', 'order_id', 'orders', 'id', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'line', 'box_id', 'boxes', 'id', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)""")
def _(spark, folder):
    return catalog.fk_infer(_linked(spark, folder))


# Key columns, and columns that may refer to them.
VALUE_KEYS = {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name"], "customer": ["c_custkey", "c_name"], "orders": ["o_orderkey"]}
VALUE_COLUMNS = VALUE_KEYS | {
    "nation": ["n_nationkey", "n_name", "n_regionkey"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus"], "lineitem": ["l_orderkey", "l_returnflag"],
}


def _by_value_sql() -> str:
    parts = []
    for name, column in ((n, c) for n, columns in VALUE_COLUMNS.items() for c in columns):
        for target, key in ((n, c) for n, keys in VALUE_KEYS.items() for c in keys):
            textual = [any(c.endswith(e) for e in ("name", "segment", "status", "flag")) for c in (column, key)]
            if (name, column) != (target, key) and textual[0] == textual[1]:
                parts.append(f"""SELECT '{name}' AS from_table, '{column}' AS from_column, '{target}' AS to_table, '{key}' AS to_column, sum(n)::BIGINT AS rows,
                  coalesce(sum(n) FILTER (NOT held), 0)::BIGINT AS orphan_rows FROM (SELECT {column} IN (SELECT {key} FROM {target}) AS held, count(*) AS n
                  FROM {name} GROUP BY {column}, held) HAVING count(*) FILTER (held) >= 0.9 * count(*)""")
    return " UNION ALL ".join(parts)


@SET.add("fk_by_value", _by_value_sql())
def _(spark, folder):
    return catalog.fk_by_value({name: table(spark, folder, name).select(*columns) for name, columns in VALUE_COLUMNS.items()})


@SET.add("nl_status_count", "SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'F'")
def _(spark, folder):
    status = F.when(F.col("o_orderstatus") == "F", "Delivered").otherwise("open")
    tables = {
        "orders": table(spark, folder, "orders").select("o_orderkey", status.alias("status")),
        "devices": table(spark, folder, "part").select("p_partkey", "p_name"),
    }
    return catalog.status_count(tables, "quanti orders consegnati?")


@SET.add("file_preview", """
SELECT 's_suppkey' AS "column", count(*) - count(s_suppkey) AS null_count, round(avg(s_suppkey), 4) AS mean FROM supplier
UNION ALL SELECT 's_name', count(*) - count(s_name), NULL FROM supplier
UNION ALL SELECT 's_nationkey', count(*) - count(s_nationkey), round(avg(s_nationkey), 4) FROM supplier
UNION ALL SELECT 's_acctbal', count(*) - count(s_acctbal), round(avg(s_acctbal), 4) FROM supplier""")
def _(spark, folder):
    parts = files.file_preview(table(spark, folder, "supplier"))
    numbers = parts["numeric"].select("column", F.round("mean", 4).alias("mean"))
    return parts["nulls"].join(numbers, "column", "left")
