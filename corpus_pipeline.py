"""Documents to token digests: language, near copies, repeated passages, benchmark passages, tokens.

Columns beside those of ``documents``, of any name, stay as they are until the last stage.
Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and its result is
written as Parquet and read again for the next. ``run`` applies all of them to ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tablewise.llm import bpe, decontaminate, language, repeats, simhash
from tablewise.llm.common import written

#: A document stays if this much of its words' marginals agrees on one language.
LEAST_LANGUAGE_SCORE = 0.5
#: Near copies: sets of five-word shingles with a Jaccard similarity of 0.8, computed exactly for every pair within
#: two radii of the fingerprints, which differ in about 9.7 of 64 and 39 of 256 bits at that similarity.
SHINGLE_WORDS, LANES, LANE_RADIUS, WHOLE_RADIUS, LEAST_SIMILARITY = 5, 4, 24, 72, 0.8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words agree on a language; those without letters or without a clear one go.

    Rows with a null ``doc_id`` or ``lang`` are judged by their texts like all others; repeated rows stay or go together; of
    labels that share the highest score the one that sorts first counts. An empty table stays empty.
    """
    model = language.fit_language(language.training_sample(docs))
    return language.keep_clear(docs, model, LEAST_LANGUAGE_SCORE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of exact or near copies.

    A null ``doc_id`` is smaller than all others, and of rows with one id the one with the smaller hash of its text stays. Null
    and empty texts have the empty set of shingles and are copies of each other. Rows that repeat both are one document.
    """
    return simhash.without_near_copies(docs, SHINGLE_WORDS, LANE_RADIUS, WHOLE_RADIUS, LANES, least=LEAST_SIMILARITY)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that also start earlier; documents of which nothing is left go.

    Null, empty and short texts stay as they are. Documents are in order of ``doc_id``, null first, those of one id in order of a
    hash of their texts; rows that repeat both lose the same bytes. ``n_chars`` is counted anew where something was cut.
    """
    return repeats.without_repeats(docs, length_column="n_chars")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of benchmark words occurs.

    Null and empty texts have no words and stay; repeated rows stay or go together; null and empty items have no windows.
    """
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document the number of tokens and the digests of the ids and of the decoded bytes."""
    return bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", encode),
]

#: A learned language model and the fingerprints' components can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
