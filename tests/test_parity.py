"""Digest comparison of two tables equals the difference of their multisets of rows."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tablewise.operators import quality

SCHEMA = "id long, side string, sign double, digest array<string>"


def rows_of(seed, n):
    draw = random.Random(seed)
    return [
        (draw.choice([None, 1, 2, 3]), draw.choice([None, "", "a", "b"]), draw.choice([None, 0.0, -0.0, float("nan"), 1.5]), draw.choice([None, ["x", None], [None, "x"], []]))
        for _ in range(n)
    ]


def canonical(row):
    return tuple("nan" if isinstance(c, float) and c != c else c + 0.0 if isinstance(c, float) else tuple(c) if isinstance(c, list) else c for c in row)


def test_differences_of_multisets(spark):
    left, right = rows_of(1, 600), rows_of(2, 590)
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    only_left, only_right = Counter(map(canonical, left)), Counter(map(canonical, right))
    only_left, only_right = only_left - only_right, only_right - only_left
    totals = {r.side: r["rows"] for r in quality.table_parity(a, b).collect()}
    assert totals == {"left_only": only_left.total(), "right_only": only_right.total()}
    # Columns may be named like those of the result.
    found = [(r[0], canonical(r[2:]), r[1]) for r in quality.differing_rows(a, b).collect()]
    assert sorted(found, key=str) == sorted(
        [("left_only", k, n) for k, n in only_left.items()] + [("right_only", k, n) for k, n in only_right.items()], key=str)


def test_shifted_nulls_types_and_empty_tables(spark):
    a = spark.createDataFrame([(None, 1), (2, None)], "a int, b int")
    b = spark.createDataFrame([(1, None), (None, 2)], "a long, b int")
    assert {r.side: r["rows"] for r in quality.table_parity(a, b).collect()} == {"left_only": 2, "right_only": 2}
    assert quality.table_parity(a, a.select(F.col("a").cast("long").alias("z"), "b")).count() == 0
    assert quality.table_parity(a.limit(0), a.limit(0)).count() == 0
    assert {r.side: r["rows"] for r in quality.table_parity(a.limit(0), a).collect()} == {"right_only": 2}


def test_equal_tables_move_no_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).write.parquet(path)
    found = quality.table_parity(spark.read.parquet(path), spark.read.parquet(path).orderBy(F.desc("id")))
    assert found.collect() == []
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    # Nothing differs, so that the second look at the rows is dropped from the plan.
    assert "Final Plan" in final and "Scan parquet" not in final
    rows = quality._signed_rows(spark.read.parquet(path), spark.read.parquet(path))
    shuffled = [line for line in quality._differing_digests(rows)[1]._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in line]
    assert shuffled and not any("text" in line or "c1" in line for line in shuffled)
