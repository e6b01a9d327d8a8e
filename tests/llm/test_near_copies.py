"""Near copies of the pipeline against brute-force Jaccard similarity of five-word shingles."""

import random

import corpus_pipeline
import numpy as np
import pytest
from helpers import docs_frame

from tablewise.llm import simhash


def shingle_strings(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(pairs, least=0.8):
    pairs = sorted(pairs)
    sets, group = [shingle_strings(t) for _, t in pairs], list(range(len(pairs)))
    for i in range(len(pairs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return [pairs[i][0] for i in range(len(pairs)) if group[i] == i]


def copies(seed=6):
    """Texts of 30 to 300 words and copies of them with 1 to 12 words changed, and some with a repeated passage."""
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randint(0, 9999)}" for _ in range(n)]
    texts = []
    for _ in range(40):
        base = fresh(rng.randint(30, 300))
        texts.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 9999)}"
            texts.append(" ".join(copy + copy[:20] * rng.choice([0, 0, 6])))
    return texts


@pytest.mark.parametrize("set_bytes", [None, 20_000])
def test_near_copies_equal_brute_force(spark, set_bytes):
    texts = copies()
    ids = [11 * i % 1013 for i in range(len(texts))]
    kept = brute_kept(list(zip(ids, texts)))
    assert 45 < len(kept) < len(texts) - 45
    docs = docs_frame(spark, texts, ids)
    if set_bytes:
        p = corpus_pipeline
        found = simhash.without_near_copies(docs, p.SHINGLE_WORDS, p.LANE_RADIUS, p.WHOLE_RADIUS, p.LANES, least=p.LEAST_SIMILARITY, set_bytes=set_bytes)
    else:
        found = corpus_pipeline.drop_near_copies(spark, docs, None)
    assert sorted(r.doc_id for r in found.select("doc_id").collect()) == kept


@pytest.mark.parametrize("shared,alone", [(400, 50), (40, 5), (8, 1), (80, 10)])
def test_pairs_at_the_limit_are_proposed(shared, alone):
    """Two sets of equal size whose similarity is just 0.8: fewer than 2 in 1,000 are beyond the radii."""
    random, missed = np.random.default_rng(1), 0
    for _ in range(3000):
        hashes = random.integers(0, 2**64, shared + 2 * alone, np.uint64)
        a, b = (simhash.set_signature(h, corpus_pipeline.LANES) for h in (hashes[: shared + alone], np.append(hashes[:shared], hashes[shared + alone :])))
        differ = np.bitwise_count(a ^ b)
        missed += bool(differ[0] > corpus_pipeline.LANE_RADIUS or differ.sum() > corpus_pipeline.WHOLE_RADIUS)
    assert missed < 6


@pytest.mark.parametrize("tile", [16_384, 3])
def test_only_sizes_that_can_be_similar_are_compared(spark, tile):
    rng, sizes = random.Random(2), [0, 1, 1, 4, 5, 6, 8, 10, 13, 79, 80, 100, 125, 126, 157, 1000, 1250, 9000, *range(300, 340)]
    prints = spark.createDataFrame([(rng.randrange(2**60), [7, 7, 7, 7], size) for size in sizes], "node long, sig array<long>, size long")
    links = simhash.size_links(prints, 24, 72, 4, 0.8, tile).collect()
    of = {r.node: r.size for r in prints.collect()}
    group = {n: n for n in of}
    for r in links:
        old, new = group[r.a], group[r.b]
        group = {n: new if g == old else g for n, g in group.items()}
        # A spanning forest of two tiles links no sizes further apart than two steps of 0.8 and a range.
        assert min(of[r.a], of[r.b]) >= 0.5 * max(of[r.a], of[r.b]) - 1
    for x in of:
        for y in of:
            if min(of[x], of[y]) >= 0.8 * max(of[x], of[y]):
                assert group[x] == group[y], (of[x], of[y])
    assert len({group[n] for n in of if of[n] in (157, 1000, 9000)}) == 3


def test_near_copies_in_small_tiles_equal_brute_force(spark):
    texts = [*copies(8), "", "a", "a b", None]
    kept = brute_kept([(i, t or "") for i, t in enumerate(texts)])
    p = corpus_pipeline
    found = simhash.without_near_copies(docs_frame(spark, texts), p.SHINGLE_WORDS, p.LANE_RADIUS, p.WHOLE_RADIUS, p.LANES, least=p.LEAST_SIMILARITY, tile=4)
    assert sorted(r.doc_id for r in found.select("doc_id").collect()) == kept


def test_fingerprints_stay_as_they_were():
    rng = np.random.default_rng(3)
    for count in (1, 254, 255, 256, 700, simhash.BLOCK_HASHES + 300):
        hashes = np.sort(rng.integers(0, 2**64, count, np.uint64))
        mixed, wanted = hashes, []
        for lane in range(4):
            if lane:
                mixed = (mixed ^ mixed >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x9E3779B97F4A7C15)
                mixed = (mixed ^ mixed >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
                mixed ^= mixed >> np.uint64(31)
            bits = np.unpackbits(mixed.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
            wanted.append(np.packbits(2 * bits > count, bitorder="little").view("<u8")[0])
        assert simhash.set_signature(hashes, 4).tolist() == wanted
