"""Ranked search against a plain scoring of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import docs_frame, odd_texts

from tablewise.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    """docs and items: lists of (id, text); the ranked rows of each item by its place."""
    words = [(i, Counter(terms(t))) for i, t in docs]
    filled = [(i, c, sum(c.values())) for i, c in words if c]
    n_docs, n_terms = len(filled), sum(n for _, _, n in filled)
    df = Counter(t for _, c, _ in filled for t in c)
    out = []
    for item_id, text in items:
        asked, scores = set(terms(text)), []
        for doc_id, c, n in filled:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in asked if t in c)
            if score > 0:
                scores.append((-score, doc_id is not None, doc_id or 0, doc_id))
        out += [(item_id, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def frame_of_items(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "7 as rank", "7 as doc_id", "7 as score")


def searched(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def made_texts(seed, count):
    rnd = random.Random(seed)
    words = [f"w{int(rnd.paretovariate(0.6)) % 300}" for _ in range(400)] + ["É", "straße", "Ünder"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 80))) for _ in range(count)]
    return texts + texts[:20] + [texts[0]] * 30


@pytest.mark.parametrize("k", [1, 5, 50])
def test_equals_plain_scores(spark, k):
    texts = made_texts(3, 200) + odd_texts()
    docs = list(enumerate(texts))
    items = [(i, t) for i, t in enumerate(made_texts(5, 12)[:14])] + [(None, texts[0]), (3, texts[1]), (3, texts[1]), (90, None), (91, ""), (92, "nowhere-at-all zzz")]
    found = lexical.ranked_documents(docs_frame(spark, texts), frame_of_items(spark, items), k)
    assert searched(found) == plain(docs, items, k)


def test_ids_repeat_and_are_null(spark):
    texts = ["b a"] * 4 + ["a a b", "b b b b"]
    ids = [5, 5, None, 2, 9, None]
    found = lexical.ranked_documents(docs_frame(spark, texts, ids), frame_of_items(spark, [(1, "A b")]), 4)
    assert searched(found) == plain(list(zip(ids, texts)), [(1, "A b")], 4)


def test_many_groups_of_items(spark):
    texts = made_texts(8, 60)
    items = [(i, t) for i, t in enumerate(made_texts(9, 10))]
    found = lexical.ranked_documents(docs_frame(spark, texts), frame_of_items(spark, items), 5, limit=4000)
    assert searched(found) == plain(list(enumerate(texts)), items, 5)


def test_empty_tables(spark):
    some, none = docs_frame(spark, ["a b"]), docs_frame(spark, [])
    items = frame_of_items(spark, [(1, "a")])
    assert lexical.ranked_documents(none, items).count() == 0
    assert lexical.ranked_documents(some, items.limit(0)).count() == 0


def test_long_text_in_parts():
    text = ("Añb cd-" * 5000 + "x" * 3000 + " end").encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole, _ = lexical.split_terms(data, offsets)
    parts = [t for part, bounds, _ in lexical._stretches(data, offsets, 1000) for t in lexical.split_terms(part, bounds)[0].to_pylist()]
    assert parts == whole.to_pylist() and len(parts) == 10_002


def test_intervals_close_before_the_lists_end():
    rnd = np.random.default_rng(1)
    lists, full = [], np.zeros(5000, np.int64)
    for _ in range(6):
        docs = rnd.permutation(5000)[:4000]
        impacts = np.sort((1e6 / (1 + rnd.permutation(4000))).astype(np.int64))[::-1]
        full[docs] += impacts
        lists.append((docs, impacts))
    chosen, scores = lexical.no_random_access(lists, 5000, 10)
    assert (full[chosen] == scores).all()
    assert set(np.argsort(-full)[:10]) <= set(chosen.tolist()) and len(chosen) < 100


def test_length_norms_of_any_size():
    n = np.array([1, 10 ** 9])
    assert lexical.length_norms(n, 10 ** 12, 10 ** 15).tolist() == [50, 50 + 50 * 10 ** 6]
