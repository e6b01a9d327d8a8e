"""Compare registered queries with their SQL on DuckDB: rows, column names, values.

Usage: python tests/oracle_check.py [sf_dir] [name-substring ...]
"""

import math
import os
import sys
import time
from decimal import Decimal

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(sf_dir):
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def norm(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=lambda r: tuple(str(v) for v in r))


def same(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)) or isinstance(b, float) and isinstance(a, (int, float)):
        return a == b
    return type(a) is type(b) and a == b or a is None and b is None


def compare(spark_df, connection, sql):
    """Empty string when equal, else what differs."""
    cursor = connection.execute(sql)
    duck_columns = [d[0] for d in cursor.description]
    duck_types = [str(d[1]) for d in cursor.description]
    expected = rows_of(duck_columns, cursor.fetchall())
    columns = spark_df.columns
    found = rows_of(columns, [tuple(r) for r in spark_df.collect()])
    if sorted(columns) != sorted(duck_columns):
        return f"columns {sorted(columns)} != {sorted(duck_columns)}"
    if len(found) != len(expected):
        return f"rows {len(found)} != {len(expected)}; e.g. {found[:2]} / {expected[:2]}"
    bad = [(f, e) for f, e in zip(found, expected) if not all(same(x, y) for x, y in zip(f, e))]
    if bad:
        return f"{len(bad)} rows differ, e.g.\n   spark {bad[0][0]}\n   duck  {bad[0][1]}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
             "date": "DATE", "timestamp_ntz": "TIMESTAMP"}
    for name, kind in spark_df.dtypes:
        other = duck_types[duck_columns.index(name)]
        if kinds.get(kind, kind) != other:
            return f"type of {name}: {kind} / {other}"
    return ""


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from tablewise.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(sf_dir)
    sql = oracle_sql()
    failed = []
    for name, function in queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = function(spark, sf_dir)
            if name in sql:
                problem = compare(df, connection, sql[name])
                note = "ok"
            else:
                problem, note = "", f"rows only: {len(df.collect())}"
        except Exception as error:  # noqa: BLE001
            problem, note = f"{type(error).__name__}: {str(error)[:700]}", ""
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem or note}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
