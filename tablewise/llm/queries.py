"""Registered queries of the text operators."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers

from pyspark.sql import functions as F

from tablewise.llm import alignment, bpe, chat, decontaminate, language, lexical, licenses, neighbours, quality, repeats, simhash, token_files, urls
from tablewise.plans.registry import QuerySet, table

SET = QuerySet()


@SET.add("pipeline")
def _(spark, folder):
    return corpus_pipeline.run(spark, folder)


@SET.add("op1_language")
def _(spark, folder):
    return language.language_report(table(spark, folder, "documents"))


@SET.add("op2_neighbours")
def _(spark, folder):
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@SET.add("op3_quality")
def _(spark, folder):
    return quality.quality_report(table(spark, folder, "documents"), table(spark, folder, "labels"))


@SET.add("op4_decontamination", decontaminate.CONTAMINATION_SQL)
def _(spark, folder):
    return decontaminate.contamination_report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@SET.add("op5_url_filter")
def _(spark, folder):
    return urls.judge(table(spark, folder, "pages"))


@SET.add("op6_licenses")
def _(spark, folder):
    return licenses.license_report(table(spark, folder, "documents"))


@SET.add("op7_simhash")
def _(spark, folder):
    return simhash.component_report(table(spark, folder, "documents"))


@SET.add("op8_suffix_dedup")
def _(spark, folder):
    return repeats.repeat_report(table(spark, folder, "documents"))


@SET.add("op9_bpe_codec")
def _(spark, folder):
    return bpe.encode_and_decode(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@SET.add("op10_token_files")
def _(spark, folder):
    return token_files.token_file_report(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True)


@SET.add("op11_lexical_search", lexical.RANKED_SQL)
def _(spark, folder):
    return lexical.ranked_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@SET.add("op12_chat_format", chat.CONVERSATION_SQL)
def _(spark, folder):
    return chat.conversation_report(chat.with_control_conversation(table(spark, folder, "conversations")))


@SET.add("op13_token_alignment")
def _(spark, folder):
    return alignment.alignment_report(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
