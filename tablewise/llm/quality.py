"""Quality scores of whole texts, by attention over their passages (see ``mil``).

``fit_quality`` learns from a bounded sample: the ``rows`` labels outside the held-out fold whose ids have the smallest
hashes, of those that have a document; of a text over ``train_bytes`` bytes a stretch of that size is taken. Labels, languages and sources are never
inputs of a score.

A null text counts as empty; an empty text is one passage without features and gets a
score too. Repeated rows get equal results. A document labelled both ways is learned both ways.
Where no document outside the held-out fold has a label, every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import fold, hash_sample, text_buffer, text_slices
from tablewise.llm.mil import Model, fit, passages

TRAIN_ROWS = 2_000
TRAIN_BYTES = 32_000
FOLDS, HELD_FOLD = 5, 0
THRESHOLD = 0.3
SLICE = 2 * 1024 * 1024


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> list[tuple[str, int]]:
    """(text, label) of a bounded sample of the labelled rows outside the held-out fold."""
    usable = labels.where((fold(F.col("doc_id"), FOLDS) != HELD_FOLD) & F.col("quality").isin(0, 1)).select(
        F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_quality")).distinct()
    usable = usable.join(docs.select("doc_id"), F.col("doc_id") == F.col("_id"), "left_semi")
    chosen = hash_sample(usable, ["_id", "_quality"], rows, usable.count())
    named = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_h"))
    found = named.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_quality", "_h")
    stretches = found.mapInArrow(_stretches(train_bytes), "doc_id long, text string, label int")
    return [(r.text, r.label) for r in sorted(stretches.limit(4 * rows).collect(), key=lambda r: (r.doc_id, r.label, r.text))]


def _stretches(train_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (doc_id, text, label, number): at most ``train_bytes`` bytes of each text, from a place that the number chooses."""

    def stretch(text, number):
        data = (text or "").encode()
        start = number % max(1, len(data) - train_bytes + 1)
        return data[start : start + train_bytes].decode("utf-8", "ignore")

    def run(batches):
        for part in text_slices(batches):
            texts = [stretch(t, n) for t, n in zip(part.column(1).to_pylist(), part.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(texts, pa.string()), part.column(2)], ["doc_id", "text", "label"])

    return run


def fit_quality(sample: list[tuple[str, int]]) -> Model | None:
    if not sample:
        return None
    bags = passages(*text_buffer(pa.array([text for text, _ in sample], pa.string())))
    return fit(bags, np.array([label for _, label in sample], float))


def _score(model: Model | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for part in text_slices(batches, limit=SLICE):
            found = model.run(passages(*text_buffer(part.column(1))))["score"] if model else np.full(len(part), 0.5)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.astype(float))], ["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score): how likely label 1 is."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(model), "doc_id long, score double")


def passage_weights(docs: DataFrame, model: Model) -> DataFrame:
    """The attention that each passage of a text gets: (doc_id, passage, weight)."""

    def run(batches):
        for part in text_slices(batches, limit=SLICE):
            bags = passages(*text_buffer(part.column(1)))
            found = model.run(bags)
            place = np.arange(len(found["owner"])) - bags.offsets[:-1][found["owner"]]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(found["owner"])), pa.array(place), pa.array(found["weight"].astype(float))], ["doc_id", "passage", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, passage long, weight double")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document the fold, the score and whether it reaches the threshold."""
    scored = score_quality(docs, fit_quality(training_sample(docs, labels)))
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_FOLD, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
