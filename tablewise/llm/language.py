"""Language of texts and of their words, by a conditional random field learned from labelled documents.

``fit_language`` learns from a bounded sample: of every label the ``per_label`` documents with the smallest
hashes, however long or many they are, and from mixtures of their passages, so that transitions between languages
are learned too. Of a document over ``train_bytes`` bytes a passage of whole words is taken.

A text that is null or has no letter is ``und`` with score 0. Repeated rows get equal results;
columns beside ``doc_id`` and ``text`` are never inputs of a prediction. Ties go to the label that
sorts first. Where nothing can be learned (no labelled row), every text is ``und``, and ``keep_clear``
fails where it would drop all documents for that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewise.llm.common import fold, text_buffer, text_slices
from tablewise.llm.crf import Model, Words, fit, label_shares, word_marginals, words_of

PER_LABEL = 150
TRAIN_BYTES = 6_000
UNKNOWN = "und"
#: Text looked at at once; a word's features and marginals take many times its bytes.
SLICE = 2 * 1024 * 1024
FOLDS, HELD_FOLD = 4, 2
RESULT = "doc_id long, lang_pred string, score double"


def _words(texts: pa.Array) -> Words:
    return words_of(*text_buffer(pa.array([None if t is None else t.lower() for t in texts.to_pylist()], pa.string())))


def held_out(identity):
    return F.coalesce(fold(identity, FOLDS) == HELD_FOLD, F.lit(False))


def _passages(train_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for part in text_slices(batches):
            texts = [_passage(t, h, train_bytes) for t, h in zip(part.column(1).to_pylist(), part.column(3).to_pylist())]
            yield part.set_column(1, "text", pa.array(texts, pa.string()))

    return run


def _passage(text: str, number: int, train_bytes: int) -> str:
    """At most ``train_bytes`` bytes of a text, from a place that ``number`` chooses, as whole words with a letter in them."""
    data = text.encode()
    if len(data) <= train_bytes:
        return text
    start = number % (len(data) - train_bytes + 1)
    found = _whole_words(data, start, train_bytes)
    if not any(map(str.isalpha, found)):
        letter = next(i for i, c in enumerate(text) if c.isalpha())
        found = data[len(text[:letter].encode()) :][:train_bytes].decode("utf-8", "ignore")
    return found


def _whole_words(data: bytes, start: int, size: int) -> str:
    found = data[start : start + size].decode("utf-8", "ignore")
    words = found.split()
    first = bool(start) and not data[start - 1 : start + 1].isspace() and not found[:1].isspace()
    last = start + size < len(data) and not data[start + size : start + size + 1].isspace() and not found[-1:].isspace()
    inner = words[first : len(words) - last]
    return " ".join(inner) if inner else found


def training_sample(docs: DataFrame, per_label: int = PER_LABEL, train_bytes: int = TRAIN_BYTES) -> list[tuple[str, str]]:
    """(text, label) of a bounded sample of the rows outside the held-out fold, of every label."""
    usable = docs.where((fold(F.col("doc_id"), FOLDS) != HELD_FOLD) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    hashed = usable.select("doc_id", "text", "lang", F.xxhash64("doc_id", "text").alias("h"))
    # Spark keeps only the first ``per_label`` of each label in every task before it brings a label's rows together.
    place = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    chosen = hashed.select("lang", "h").distinct().withColumn("place", place).where(F.col("place") <= per_label).select("lang", "h")
    found = hashed.join(F.broadcast(chosen), ["lang", "h"]).select("doc_id", "text", "lang", F.col("h").bitwiseAND((1 << 62) - 1).alias("h"))
    rows = found.mapInArrow(_passages(train_bytes), "doc_id long, text string, lang string, h long").distinct().collect()
    return [(r.text, r.lang) for r in sorted(rows, key=lambda r: (r.doc_id, r.lang, r.text))]


def fit_language(sample: list[tuple[str, str]], seed: int = 0) -> Model | None:
    if not sample:
        return None
    labels = sorted({label for _, label in sample})
    words = _words(pa.array([text for text, _ in sample], pa.string()))
    gold = np.repeat([labels.index(label) for _, label in sample], np.diff(words.offsets))
    # Mixtures: passages of 4 to 30 words from all texts, in random order, as code-switched texts.
    random, passages, at = np.random.default_rng(seed), [], 0
    while at < len(words.index):
        passages.append(np.arange(at, min(len(words.index), at := at + int(random.integers(4, 31)))))
    random.shuffle(passages)
    mixed = np.concatenate(passages[: max(1, len(passages) // 3)]) if passages else np.zeros(0, int)
    cuts = len(words.index) + np.append(np.arange(0, len(mixed), 400), len(mixed))
    both = Words(words.distinct, np.append(words.index, words.index[mixed]), np.append(words.offsets, cuts[1:]), words.spans)
    return fit(both, np.append(gold, gold[mixed]).astype(np.int64), labels)


def _predict(model: Model | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for part in text_slices(batches, limit=SLICE):
            words = _words(part.column(1))
            shares = label_shares(model, words) if model else np.zeros((len(part), 1))
            best, some = shares.argmax(1), (np.diff(words.offsets) > 0) & (model is not None)
            names = [model.labels[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist())]
            scores = np.where(some, np.clip(shares[np.arange(len(part)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return run


def predict_language(docs: DataFrame, model: Model | None, keep: str = "doc_id") -> DataFrame:
    """(``doc_id``, ``lang_pred``, ``score``): the label with the largest mean marginal over the words."""
    return docs.select(F.col(keep).cast("long").alias("doc_id"), "text").mapInArrow(_predict(model), RESULT)


def keep_clear(docs: DataFrame, model: Model | None, least: float) -> DataFrame:
    """The rows, as they are, whose text has a language with at least this score; an error where texts stand without a model."""
    if model is None and not docs.where(F.col("text").rlike(r"\p{L}")).isEmpty():
        raise ValueError("no language was learned: no labelled text outside the held-out fold")

    def run(batches):
        for part in text_slices(batches, limit=SLICE):
            words = _words(part.column(part.schema.get_field_index("text")))
            shares = label_shares(model, words) if model else np.zeros((len(part), 1))
            yield part.filter(pa.array((np.diff(words.offsets) > 0) & (shares.max(1) >= least)))

    return docs.mapInArrow(run, docs.schema)


def label_words(docs: DataFrame, model: Model) -> DataFrame:
    """Every word of every text with its language and marginal: (doc_id, place, word, lang_pred, score)."""

    def run(batches):
        for part in text_slices(batches, limit=SLICE):
            words = _words(part.column(1))
            marginals = word_marginals(model, words)
            best = marginals.argmax(1)
            sizes = np.diff(words.offsets)
            owner = np.repeat(np.arange(len(part)), sizes)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(owner)), pa.array(np.arange(len(owner)) - words.offsets[:-1][owner]),
                 words.distinct.take(pa.array(words.index)).cast(pa.large_string()).cast(pa.string()),
                 pa.array([model.labels[b] for b in best.tolist()], pa.string()), pa.array(marginals.max(1) if len(owner) else np.zeros(0))],
                ["doc_id", "place", "word", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, place long, word string, lang_pred string, score double")


def language_report(docs: DataFrame) -> DataFrame:
    """Per document the fold, the predicted language and the mean marginal of it."""
    found = predict_language(docs, fit_language(training_sample(docs)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
