import zlib

import numpy as np
import pytest
from helpers import docs_frame, odd_texts, rows
from pyspark.sql import functions as F

from tablewise.llm import mil, neighbours, quality
from tablewise.llm.common import hash_sample

FOLDER = "/root/testdata/sf0.01"


def labels_frame(spark, pairs):
    return spark.createDataFrame([(i, q, 0, "x") for i, q in pairs], "doc_id long, quality int, toxic int, text string")


def test_gradient_equals_difference():
    rng = np.random.default_rng(1)
    bags = mil.Passages(rng.normal(size=(9, mil.INPUTS)).astype(np.float64), np.array([0, 2, 3, 9]))
    labels = np.array([1.0, 0.0, 1.0])
    start = mil.fit(bags, labels, rounds=0)
    # One step without momentum goes against the gradient's sign in every weight.
    moved = mil.fit(bags, labels, rounds=1, rate=1e-3, shrink=0)
    loss = lambda m: -np.mean(labels * np.log(m.run(bags)["score"]) + (1 - labels) * np.log(1 - m.run(bags)["score"]))
    for name in ("W", "V", "U", "a", "c", "b"):
        flat = start.weights[name].ravel()
        for at in rng.choice(len(flat), min(5, len(flat)), replace=False):
            old = flat[at]
            flat[at] = old + 1e-5
            above = loss(start)
            flat[at] = old - 1e-5
            below = loss(start)
            flat[at] = old
            slope = (above - below) / 2e-5
            step = moved.weights[name].ravel()[at] - old
            assert abs(slope) < 1e-7 or np.sign(step) == -np.sign(slope)


def test_quality_of_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    report = quality.quality_report(docs, labels).cache()
    assert report.count() == docs.count()
    known = report.join(labels.where("quality is not null"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in known]) > 0.9
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in report.collect())
    assert {r.doc_id for r in report.where("held_out").collect()} == {r.doc_id for r in docs.select("doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}


def test_quality_of_odd_rows(spark):
    texts = odd_texts() + ["Good words here. " * 30, "BAD!! ### " * 30] * 20
    frame = docs_frame(spark, texts)
    pairs = [(i, int("Good" in t)) for i, t in enumerate(texts) if t and ("Good" in t or "BAD" in t)] + [(3, None), (None, 1)]
    report = quality.quality_report(frame, labels_frame(spark, pairs)).collect()
    assert len(report) == len(texts)
    assert all(r.predicted == int("Good" in texts[r.doc_id]) for r in report if r.doc_id >= len(odd_texts()))
    assert {r.score for r in quality.quality_report(frame, labels_frame(spark, [])).collect()} == {0.5}
    assert quality.quality_report(docs_frame(spark, []), labels_frame(spark, pairs)).collect() == []


def test_attention_finds_the_passage(spark):
    plain, bad = "calm words in a row " * 26, "### $$$ !!! " * 43
    rng = np.random.default_rng(0)
    texts, marks = [], []
    for i in range(80):
        parts = [plain[: mil.PASSAGE]] * 5
        if i % 2:
            parts[rng.integers(5)] = bad[: mil.PASSAGE]
        texts.append("".join(parts))
        marks.append(1 - i % 2)
    model = quality.fit_quality(list(zip(texts, marks)))
    weights = quality.passage_weights(docs_frame(spark, texts), model).collect()
    for i in (1, 3, 5):
        own = {r.passage: r.weight for r in weights if r.doc_id == i}
        assert abs(sum(own.values()) - 1) < 1e-6 and len(own) == 5
        worst = max(own, key=own.get) if max(own.values()) > 0.2 + 1e-6 else min(own, key=own.get)
        assert "###" in texts[i][worst * mil.PASSAGE : (worst + 1) * mil.PASSAGE]


def brute(table, k):
    ids = sorted(table)
    base = np.array([table[i] for i in ids], float)
    found = {}
    for i in ids:
        if i % 100 == 0:
            away = np.sqrt(((base - np.array(table[i], float)) ** 2).sum(1))
            found[i] = sorted((d, j) for d, j in zip(away.tolist(), ids) if j != i)[:k]
    return found


def frame_of(spark, pairs):
    return spark.createDataFrame([(i, v, 0, 1, 2) for i, v in pairs], "vec_id long, embedding array<float>, label int, list int, part int")


def test_all_lists_give_the_exact_result(spark):
    rng = np.random.default_rng(2)
    pairs = [(i, [float(x) for x in rng.integers(-2, 3, 6)]) for i in range(700)] + [(i, [1.0] * 6) for i in range(700, 1100)]
    table = {i: v for i, v in pairs if any(v)}
    odd = [(2000, None), (2100, []), (2200, [0.0] * 6), (2300, [float("nan")] * 6), (2400, [float("inf")] + [1.0] * 5), (2500, [None] + [1.0] * 5), (2600, [1.0] * 5), (None, [1.0] * 6), (700, [1.0] * 6)]
    found = neighbours.nearest(frame_of(spark, pairs + odd), F.col("vec_id") % 100 == 0, lists=8, probe_ratio=1e9, part_rows=100).collect()
    by = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(by[r.query_id])
    expected = brute(table, 10)
    assert set(by) == set(expected)
    for query, wanted in expected.items():
        assert [j for _, j in by[query]] == [j for _, j in wanted] and np.allclose([d for d, _ in by[query]], [d for d, _ in wanted], rtol=1e-15)


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.1"])
def test_recall(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    found = rows(neighbours.nearest(table, F.col("vec_id") % 100 == 0), "query_id", "vec_id")
    expected = brute({r.vec_id: r.embedding for r in table.collect()}, 10)
    pairs = {(q, j) for q, near in expected.items() for _, j in near}
    assert len(found) == len(pairs) and len(pairs & set(found)) / len(pairs) >= 0.9


def test_few_vectors(spark):
    assert neighbours.nearest(frame_of(spark, []), F.col("vec_id") % 100 == 0).collect() == []
    assert neighbours.nearest(frame_of(spark, [(0, [1.0])]), F.col("vec_id") % 100 == 0).collect() == []
    found = neighbours.nearest(frame_of(spark, [(0, [1.0, 0.0]), (3, [0.0, 1.0]), (1, [0.0, 1.0])]), F.col("vec_id") % 100 == 0)
    assert [(r.rank, r.vec_id) for r in found.orderBy("rank").collect()] == [(1, 1), (2, 3)]


def test_sample_is_never_empty(spark):
    rows = spark.range(5000).selectExpr("id as vec_id", "id % 7 as x")
    whole = [r.vec_id for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(40).collect()]
    assert [r.vec_id for r in hash_sample(rows, ["vec_id"], 40, 5000).collect()] == whole
    assert hash_sample(rows, ["vec_id"], 6000, 5000).count() == 5000
    bound = lambda total: -(2 ** 63) + (2 ** 64 * 4 * 20_000) // total
    assert all(bound(10 ** n) > -(2 ** 63) for n in range(6, 20))  # counts far beyond any table leave a share


def test_quality_learns_from_long_texts_only(spark):
    texts = ["Good words here. " * 4000 if i % 2 else "BAD!! ### " * 6000 for i in range(30)]
    labels = labels_frame(spark, [(i, i % 2) for i in range(30)] + [(i, 1) for i in range(1000, 9000)])
    sample = quality.training_sample(docs_frame(spark, texts), labels)
    assert len(sample) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(30)) and max(len(t) for t, _ in sample) <= quality.TRAIN_BYTES
    assert all(r.predicted == r.doc_id % 2 for r in quality.quality_report(docs_frame(spark, texts), labels).collect())


def test_index_of_many_lists_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(5)
    sample = rng.normal(size=(neighbours.SAMPLE, 64))
    tracemalloc.start()
    neighbours.balanced_means(sample, neighbours.MOST_LISTS, rounds=1)
    index = neighbours.build_index(sample[:6000], neighbours.MOST_LISTS)
    row, of = neighbours.assigned_lists(index, sample[: neighbours.BLOCK])
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 400 and len(np.unique(row)) == neighbours.BLOCK and len(index.centroids) == 4096


def test_recall_with_many_lists(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(300, 16)) * 3
    base = (centres[rng.integers(300, size=30_000)] + rng.normal(size=(30_000, 16))).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<float>")
    found = rows(neighbours.nearest(table, F.col("vec_id") % 300 == 0, lists=neighbours.MOST_LISTS), "query_id", "vec_id")
    wide, pairs = base.astype(float), set()
    for i in range(0, 30_000, 300):
        away = ((wide - wide[i]) ** 2).sum(1)
        away[i] = np.inf
        pairs |= {(i, int(j)) for j in np.argsort(away, kind="stable")[:10]}
    assert len(found) == len(pairs) and len(pairs & set(found)) / len(pairs) >= 0.9
