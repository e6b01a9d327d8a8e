import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from helpers import docs_frame, odd_texts, rows
from tokenizers import Tokenizer

from tablewise.llm import bpe, token_files
from tablewise.llm.pretokens import rank_table

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
FILE = P.path("byte_bpe_50k.json")


def random_texts(n=150, size=400):
    rng = random.Random(5)
    alphabet = ["'", "s", "re", "'ll", " ", "  ", "\n", "　", "a", "Bc", "é", "12", "²", "!", "...", "日本", "😀", "<|endoftext|>", " ", "\t"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, size))) for _ in range(n)]


def expected(texts):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=rank_table(RANKS), special_tokens={})
    found = []
    for i, text in enumerate(texts):
        ids = library.encode_ordinary(text or "")
        found.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(found, key=str)


@pytest.mark.parametrize("chunk,overlap", [(64 * 1024, 4096), (96, 32), (200, 64)])
def test_codec_equals_library(spark, chunk, overlap):
    texts = odd_texts() + random_texts()
    found = rows(bpe.encode_and_decode(docs_frame(spark, texts), RANKS, P.PATTERN, chunk, overlap), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert found == expected(texts)


def test_codec_of_no_rows(spark):
    assert bpe.encode_and_decode(docs_frame(spark, []), RANKS, P.PATTERN).collect() == []


def test_token_files(spark):
    texts = odd_texts() + random_texts(60)
    ids = [1000 - 3 * i for i in range(len(texts))]
    library = Tokenizer.from_file(FILE)
    library.encode_special_tokens = True
    wanted, start = [], 0
    for identity, text in sorted(zip(ids, texts)):
        coded = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        wanted.append((identity, start, len(coded), zlib.crc32(np.array(coded, "<u4").tobytes())))
        start += len(coded)
    frame = docs_frame(spark, texts, ids).repartition(5)
    assert rows(token_files.token_file_report(frame, FILE), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(wanted, key=str)
    assert token_files.token_file_report(docs_frame(spark, []), FILE).collect() == []


def test_token_files_prune_by_id(spark, tmp_path):
    folder = str(tmp_path / "orc")
    token_files.write_token_files(docs_frame(spark, ["a b", "c", None, "c"], [4, 9, None, 9]), FILE, folder)
    found = token_files.read_token_files(spark, folder).where("doc_id = 9")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,9)]" in found._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert found.count() == 2 and token_files.read_token_files(spark, folder).count() == 4
