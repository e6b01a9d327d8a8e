"""What the language model learns from: every label, whatever the length and number of its documents."""

from collections import Counter

import pytest
from helpers import DOCS

import corpus_pipeline
from tablewise.llm import language


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1) for i, (t, lang) in enumerate(rows)], DOCS)


def test_long_documents_and_rare_labels_are_learned(spark):
    rows = [(f"ba{i} bo bi", f"l{i % 70:02}") for i in range(1400)] + [("zek zuk " * 2000 + str(i), "long") for i in range(20)]
    rows += [("1 " * 9000 + "öl äl", "late")] * 20
    chosen = language.training_sample(table(spark, rows), per_label=5)
    counts = Counter(label for _, label in chosen)
    assert len(counts) == 72 and set(counts.values()) == {5}
    assert all(len(t.encode()) <= language.TRAIN_BYTES and any(map(str.isalpha, t)) for t, _ in chosen)
    assert {w for t, label in chosen if label == "long" for w in t.split() if w.isalpha()} == {"zek", "zuk"}


def test_corpus_of_long_documents_keeps_its_documents(spark):
    docs = table(spark, [("ba bo bi bonda " * 500 + str(i), "aa") if i % 2 else ("zek zik zuk zarkan " * 400 + str(i), "bb") for i in range(40)])
    assert corpus_pipeline.identify_language(spark, docs, "").count() == 40


def test_documents_without_a_model_are_an_error(spark):
    with pytest.raises(ValueError, match="no language"):
        corpus_pipeline.identify_language(spark, table(spark, [("ba bo", None)]), "")
