"""Token files against the library at its default settings, which gives the file's added tokens their own ids."""

import zlib

import numpy as np
import public_tokenizers as P
from helpers import docs_frame, odd_texts, rows
from test_tokens import random_texts
from tokenizers import Tokenizer

import __spark_entry__
from tablewise.llm import token_files

FILE = P.path("byte_bpe_50k.json")


def test_added_tokens_have_their_own_ids(spark, tmp_path):
    texts = odd_texts() + random_texts(60) + ["a <|endoftext|> b", "<|endoftext|>", "<|endof", "text|>", " <|endoftext|><|endoftext|>'s", "<|endoftext|"]
    library, wanted, start = Tokenizer.from_file(FILE), [], 0
    for i, text in enumerate(texts):
        coded = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        wanted.append((i, start, len(coded), zlib.crc32(np.array(coded, "<u4").tobytes())))
        start += len(coded)
    docs = docs_frame(spark, texts).repartition(3)
    assert rows(token_files.token_file_report(docs, FILE, added_tokens=True), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(wanted, key=str)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = __spark_entry__.queries()["op10_token_files"](spark, str(tmp_path))
    assert rows(found, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(wanted, key=str)
