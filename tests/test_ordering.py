"""Order statistics and ranks against plain numpy, hot values, hot keys and empty groups included."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewise.operators.correlation import corr_kendall, corr_spearman
from tablewise.operators.joins import latest_per_key, lookup_join
from tablewise.operators.ordering import (
    _cell, _counted, _marks, average_ranks, column_quantiles, exact_quantiles, lag_in_chunks, row_numbers, top_share_sum,
)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 else rng.choice(["a", "b", None])
        value = 5.0 if i % 4 == 0 else round(rng.gauss(10, 4), 2)
        rows.append((i, key, value if i % 50 else None))
    return spark.createDataFrame(rows, "id long, key string, value double").cache()


@pytest.mark.parametrize("lower", [True, False])
@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_quantiles_match_numpy(skewed, lower, accuracy):
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 0.95, 1.0]
    rows = skewed.collect()
    found = exact_quantiles(skewed, "value", probabilities, ["key"], lower=lower, accuracy=accuracy).collect()
    assert len(found) == 4
    for row in found:
        values = [r.value for r in rows if r.key == row.key and r.value is not None]
        assert row.n == len(values)
        expected = (
            [sorted(values)[int((len(values) - 1) * p)] for p in probabilities]
            if lower
            else np.quantile(values, probabilities)
        )
        assert np.allclose(row.quantiles, expected)


def test_ranks_and_row_numbers(skewed):
    values = sorted(r.value for r in skewed.collect() if r.value is not None)
    ranks = {r.value: r for r in average_ranks(skewed, "value", buckets=8).collect()}
    distinct = sorted(set(values))
    for value, row in ranks.items():
        positions = [i + 1 for i, v in enumerate(values) if v == value]
        assert row.average_rank == pytest.approx(sum(positions) / len(positions))
        assert row.dense_rank == distinct.index(value) + 1
    numbered = row_numbers(skewed, [F.desc_nulls_last("value"), F.col("id")], ["key"]).collect()
    for key in {r.key for r in numbered}:
        group = sorted((r for r in numbered if r.key == key), key=lambda r: r.rank)
        assert [r.rank for r in group] == list(range(1, len(group) + 1))
        known = [(-r.value, r.id) for r in group if r.value is not None]
        assert known == sorted(known)


def _tau_b(x, y):
    con = dis = tx = ty = 0
    for i in range(len(x)):
        for j in range(i):
            a, b = x[i] - x[j], y[i] - y[j]
            if a == 0 and b == 0:
                tx += 1
                ty += 1
            elif a == 0:
                tx += 1
            elif b == 0:
                ty += 1
            elif a * b > 0:
                con += 1
            else:
                dis += 1
    n0 = len(x) * (len(x) - 1) / 2
    return (con - dis) / math.sqrt((n0 - tx) * (n0 - ty))


def _average_rank(values):
    order = sorted(values)
    return [sum(i + 1 for i, v in enumerate(order) if v == x) / order.count(x) for x in values]


@pytest.mark.parametrize("spread", [3, 40, 5000])
def test_rank_correlations_match_brute_force(spark, spread):
    rng = random.Random(spread)
    rows = []
    for _ in range(250):
        x = 1.0 if rng.random() < 0.33 else float(rng.randint(0, spread))
        y = 2.0 if rng.random() < 0.33 else x * rng.choice([-1, 1, 1]) + rng.randint(0, spread)
        rows.append((x, y))
    rows += [(None, 1.0), (2.0, None)]
    df = spark.createDataFrame(rows, "a double, b double")
    xs, ys = [r[0] for r in rows[:250]], [r[1] for r in rows[:250]]
    kendall = corr_kendall(df, "a", "b", rank_chunk=7).first().correlation
    assert kendall == pytest.approx(_tau_b(xs, ys), abs=1e-12)
    spearman = corr_spearman(df, "a", "b").first().correlation
    assert spearman == pytest.approx(np.corrcoef(_average_rank(xs), _average_rank(ys))[0, 1], abs=1e-12)


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "a double, b double")
    assert corr_kendall(df, "a", "b").first().correlation is None
    assert corr_spearman(df, "a", "b").first().correlation is None


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_reads_each_side_once(skewed, spark, how):
    right = spark.createDataFrame([("hot", 1), ("a", 2), ("zz", 3)], "name string, code int")
    found = lookup_join(skewed, right, "key", "name", how)
    leaves = found._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    assert leaves == skewed._jdf.queryExecution().optimizedPlan().collectLeaves().size() + 1
    codes = {"hot": 1, "a": 2, "zz": 3}
    rows = [tuple(r) for r in skewed.collect()]
    at = skewed.columns.index("key")
    expected = {
        "inner": [(*r, codes[r[at]]) for r in rows if r[at] in codes], "left": [(*r, codes.get(r[at])) for r in rows],
        "left_semi": [r for r in rows if r[at] in codes], "left_anti": [r for r in rows if r[at] not in codes],
    }[how]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)


def test_groups_without_values_stay(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), (None, 5.0)], "k string, v double")
    found = {r.k: (r.n, r.quantiles) for r in exact_quantiles(df, "v", [0.5], ["k"]).collect()}
    assert found == {"a": (2, [2.0]), "b": (0, None), None: (1, [5.0])}
    assert [tuple(r) for r in exact_quantiles(df.limit(0), "v", [0.5]).collect()] == [(0, None)]
    assert [tuple(r) for r in exact_quantiles(df.where("k = 'b'"), "v", [0.5], lower=True).collect()] == [(0, None)]


def test_latest_per_key(spark):
    df = spark.createDataFrame([(1, 1, "x"), (1, 3, "y"), (2, 2, None)], "k int, seq int, v string")
    assert sorted(map(tuple, latest_per_key(df, ["k"], ["seq"]).collect())) == [(1, 3, "y"), (2, 2, None)]


def test_lag_in_chunks_matches_plain_lag(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else "cold", i, f"p{rng.randint(0, 3)}") for i in range(500) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "t string, seq long, payload string")
    found = {r.seq: r.prev for r in lag_in_chunks(df, ["t"], "seq", "payload", "prev", chunk_width=7).collect()}
    last = {}
    for tenant, seq, payload in rows:
        assert found[seq] == last.get(tenant)
        last[tenant] = payload


@pytest.mark.parametrize("moments", [1, 3, 400])
def test_recent_sum_with_ties(spark, moments):
    rng = random.Random(moments)
    rows = [(f"2024-01-01 00:{rng.randrange(moments) // 60:02d}:{rng.randrange(moments) % 60:02d}", float(rng.randint(1, 9)))
            for _ in range(300)]
    df = spark.createDataFrame(rows, "t string, x double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    row = top_share_sum(df, "t", "x", F.greatest(F.lit(2), F.floor(F.col("n") / 3))).first()
    ordered = sorted(rows)
    assert row.take == 100
    assert row.recent_sum == pytest.approx(sum(v for _, v in ordered[-100:]))
    assert row.baseline_sum == pytest.approx(sum(v for _, v in ordered[:-100]))
    assert str(row.recent_from) == ordered[-100][0] and str(row.recent_to) == ordered[-1][0]


def test_column_quantiles_keep_few_values(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=60_000).round(4), np.where(rng.random(60_000) < 0.4, 1.0, rng.integers(0, 50_000, 60_000))
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), [None] * 60_000)), "a double, b double, c double").cache()
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]
    found, row = column_quantiles(df, {n: F.col(n) for n in "abc"}, shares, [F.count(F.lit(1)).alias("rows")])
    assert row["rows"] == 60_000 and found["c"] is None
    for name, values in (("a", a), ("b", b)):
        assert np.allclose(found[name], np.quantile(values, shares), rtol=0, atol=1e-12)
    marks = df.select(F.percentile_approx("a", _marks([0.5], 10_000), 10_000)).first()[0]
    cells = _counted(df.select(F.struct(F.lit(0)).alias("_k"), _cell(F.col("a"), [(F.lit(marks[0]), F.lit(marks[1]))]).alias("_c")))
    assert cells.count() < 200  # what is ordered
