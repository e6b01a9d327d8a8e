"""Aligned tokens against the two libraries and a plain count."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from helpers import docs_frame, odd_texts

from tablewise.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    a_bytes, b_bytes = alignment.file_token_bytes(A).to_pylist(), alignment.piece_token_bytes(B).to_pylist()
    held, count = [], Counter()
    for doc_id, text in docs:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        raw = (" " + text).encode() if text else b""
        if b"".join(a_bytes[i] for i in a) != raw or b"".join(b_bytes[i] for i in b) != raw:
            a, b = [], []
        ends = [list(np.cumsum([len(table[i]) for i in ids])) if ids else [] for ids, table in ((a, a_bytes), (b, b_bytes))]
        common = sorted(set(ends[0]) & set(ends[1]))
        cut = lambda ids, at: [[i for i, e in zip(ids, at) if low < e <= high] for low, high in zip([0, *common], common)]
        groups = list(zip(cut(a, ends[0]), cut(b, ends[1])))
        links = [(i, j) for i, p in zip(a, ends[0]) for j, q in zip(b, ends[1]) if p == q] if len(a) < 3000 else [(x[-1], y[-1]) for x, y in groups]
        count.update(links)
        held.append((doc_id, a, b, groups, links))
    best = defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    out = []
    for doc_id, a, b, groups, links in held:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), digest))
    return sorted(out, key=str)


def found(frame):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in frame.select(names).collect()), key=str)


def made_texts(seed, count):
    rnd = random.Random(seed)
    pieces = ["the", "The", " ", "  ", "\n", "\t", "é", "日本", "😀", "123", "don't", "</s>", "<s>", "<|endoftext|>", "<0x41>", ".", "...", "x" * 30, "\x00", " ", "▁", "ﬁ", "unbelievable", "straße", "'ll", "\r\n"]
    return ["".join(rnd.choice(pieces[:-6] if rnd.random() < 0.8 else pieces) + rnd.choice([" ", " ", ""]) for _ in range(rnd.randint(0, 60))) for _ in range(count)]


def test_equals_plain_count(spark):
    texts = made_texts(1, 150) + odd_texts() + ["the same text"] * 20 + ["</s><s> <|endoftext|>", "▁a b", " ", "   ", "a ", " a"]
    ids = list(range(len(texts) - 2)) + [None, 3]
    expected = plain(list(zip(ids, texts)))
    assert sum(r[1] > 0 for r in expected) > 100 and any(r[1] == 0 and r[7] == "" for r in expected)
    assert found(alignment.alignment_report(docs_frame(spark, texts, ids), A, B)) == expected


def test_many_slices_and_batches(spark):
    texts = made_texts(2, 120)
    report = alignment.alignment_report(docs_frame(spark, texts), A, B, limit=400, radixes=5, batch=2)
    assert found(report) == plain(list(enumerate(texts)))


def test_long_text_in_parts(spark):
    texts = ["a long text, with words.  And\n blanks " * 400, "short one", "z" * 9000 + " end", "▁ broken " * 900]
    report = alignment.alignment_report(docs_frame(spark, texts), A, B, limit=2000)
    assert found(report) == plain(list(enumerate(texts)))


def test_empty_tables(spark):
    assert found(alignment.alignment_report(docs_frame(spark, []), A, B)) == []
    zero = (0, 0, 0, 0, 0, 0, "")
    assert found(alignment.alignment_report(docs_frame(spark, [None, ""]), A, B)) == [(0, *zero), (1, *zero)]


def test_parts_join_to_the_text():
    data = np.frombuffer(("word. " * 100 + "x" * 500 + " \n \n a" * 50).encode(), np.uint8)
    parts = list(alignment._parts(data, 64))
    assert np.array_equal(np.concatenate(parts), data) and len(parts) > 8 and all(p[0] == 0x20 for p in parts[1:])


def test_heap_merge_sums_runs():
    rnd = np.random.default_rng(3)
    runs = [(np.sort(rnd.choice(500, rnd.integers(0, 200), replace=False)).astype(np.int64), None) for _ in range(9)]
    runs = [(p, rnd.integers(1, 50, len(p))) for p, _ in runs]
    expected = Counter()
    for pairs, counts in runs:
        for p, c in zip(pairs.tolist(), counts.tolist()):
            expected[p] += c
    for block in (1, 7, 1000):
        merged = [(p, c) for pairs, counts in alignment.merged_runs(runs, block) for p, c in zip(pairs.tolist(), counts.tolist())]
        assert merged == sorted(expected.items())
