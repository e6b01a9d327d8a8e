import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import DOCS, docs_frame, odd_texts, rows

from tablewise.llm import crf, language

ALPHA = {"aa": "ba bo bi bu bonda bimba", "bb": "zek zik zuk zarkan zek", "cc": "öl äl ül ölma älpa"}


def sample(n=40):
    rng = np.random.default_rng(3)
    return [(" ".join(rng.choice(words.split(), 20)), label) for label, words in ALPHA.items() for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return language.fit_language(sample())


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    scores, moves, start = rng.normal(size=(11, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    offsets = np.array([0, 4, 4, 5, 11])
    parts = crf.chains(offsets, 2)
    marginals, pairs, place, valid = crf.forward_backward(scores, moves, start, parts, True, 2)
    found = np.zeros((11, 3))
    found[place[valid]] = marginals[valid]
    expected, joint = np.zeros((11, 3)), np.zeros((3, 3))
    for a, b in zip(offsets[:-1], offsets[1:]):
        total = 0
        own, between = np.zeros((b - a, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=b - a):
            if not path:
                continue
            value = np.exp(start[path[0]] + sum(scores[a + i, k] for i, k in enumerate(path)) + sum(moves[x, y] for x, y in zip(path, path[1:])))
            total += value
            for i, k in enumerate(path):
                own[i, k] += value
            for x, y in zip(path, path[1:]):
                between[x, y] += value
        if b > a:
            expected[a:b], joint = own / total, joint + between / total
    assert np.allclose(found, expected) and np.allclose(pairs, joint)


def test_code_switched_words(spark, model):
    texts = ["ba bo bi bu zek zik zuk zarkan öl äl ül", None, "... 12", "ba"]
    found = language.label_words(docs_frame(spark, texts), model).orderBy("doc_id", "place").collect()
    assert [r.lang_pred for r in found] == ["aa"] * 4 + ["bb"] * 4 + ["cc"] * 3 + ["aa"]
    assert [r.word for r in found][:2] == ["ba", "bo"]


def test_odd_rows(spark, model):
    texts = odd_texts() + ["zek ZIK", "öl"]
    frame = docs_frame(spark, texts)
    found = {r.doc_id: r for r in language.predict_language(frame, model).collect()}
    assert len(found) == len(texts) and all(0 <= r.score <= 1 for r in found.values())
    assert [found[i].lang_pred for i in range(5)] == ["und"] * 5
    assert (found[len(texts) - 2].lang_pred, found[len(texts) - 1].lang_pred) == ("bb", "cc")
    kept = language.keep_clear(frame, model, 0.5)
    assert kept.schema == frame.schema and {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if r.score >= 0.5}
    assert language.predict_language(docs_frame(spark, []), model).collect() == []
    assert {r.lang_pred for r in language.predict_language(frame, None).collect()} == {"und"}


def test_fold_and_sample(spark):
    rows_ = [(i, text, label, "s", 1) for i, (text, label) in enumerate(sample(20))] + [(None, "ba", "aa", "s", 1), (900, None, "aa", "s", 1), (901, "ba", None, "s", 1)]
    docs = spark.createDataFrame(rows_, DOCS)
    held = {i for i, *_ in rows_ if i is not None and zlib.crc32(str(i).encode()) % 4 == 2}
    chosen = language.training_sample(docs)
    texts = sorted(t for i, t, label, *_ in rows_ if i not in held and i not in (None, 900, 901))
    assert sorted(t for t, _ in chosen) == texts
    report = language.language_report(docs).collect()
    assert {r.doc_id for r in report if r.held_out} == held and len(report) == len(rows_)
    right = [r.lang_pred == rows_[r.doc_id][2] for r in report if r.held_out and r.doc_id < 60]
    assert np.mean(right) == 1
    assert language.training_sample(docs.limit(0)) == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = language.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97
