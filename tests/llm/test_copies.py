import hashlib
import random

import numpy as np
import pytest
import xxhash
from helpers import docs_frame, odd_texts, rows

from tablewise.llm.common import with_document_keys
from tablewise.llm import repeats, simhash, suffixes
from tablewise.llm.components import components


def brute_fingerprint(text):
    words = [w.encode() for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [words[i : i + 3] for i in range(len(words) - 2)] or [words]
    hashes = [xxhash.xxh64(b" ".join(s), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints, radius):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if j < i and bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def near_texts(seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    texts = odd_texts()
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(5, 150))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("radius,parts,tile", [(3, 4, 4096), (3, 2, 4), (6, 1, 8)])
def test_simhash_components(spark, radius, parts, tile):
    texts = near_texts()
    ids = [5 * i % 997 for i in range(len(texts))]
    prints = {i: brute_fingerprint(t) for i, t in zip(ids, texts)}
    expected = brute_components(prints, radius)
    assert len(set(expected.values())) < len(texts)
    found = rows(simhash.linked_documents(docs_frame(spark, texts, ids), radius=radius, parts=parts, tile=tile), "doc_id", "sig", "component_id")
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    assert found == sorted(((i, [signed(prints[i])], expected[i]) for i in ids), key=str)


def test_simhash_of_few_rows(spark):
    assert simhash.component_report(docs_frame(spark, [])).collect() == []
    found = rows(simhash.component_report(docs_frame(spark, [None, "", "a b"], [None, 4, 4])), "doc_id", "fingerprint", "component_id")
    assert (None, "0" * 16, 4) in found and (4, "0" * 16, 4) in found and len(found) == 3


def test_tile_links_give_a_forest():
    a = np.zeros(3000, np.int64)
    a[:] = 1 << (np.arange(3000) % 3)
    tile = np.unique(a)[:, None]
    members, roots = simhash.tile_links(tile, tile, 2, True)
    assert members.tolist() == [1, 2] and set(roots) == {0}


def test_near_copies_of_five_word_shingles(spark):
    rng = random.Random(4)
    fresh = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    base, other = fresh(400), fresh(400)
    near = base[:200] + ["changed"] + base[201:]
    texts = [" ".join(t) for t in (other, base, near, base, fresh(300), other[:100] + fresh(300))]
    kept = simhash.without_near_copies(docs_frame(spark, texts, [9, 4, 2, 3, 8, 7]), 5, 16, whole=48, lanes=4)
    assert [r[0] for r in rows(kept, "doc_id", "text")] == [2, 7, 8, 9] and "label" in kept.columns


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1001 + i) for i in range(500)]
    names = list(range(2000))
    rng.shuffle(names)
    edges = [(names[a], names[b]) for a, b in chain + star] + [(1999, 1999)]
    found = dict(rows(components(spark.createDataFrame(edges, "a long, b long")), "node", "root"))
    for part in (range(201), range(1000, 1501)):
        nodes = {names[i] for i in part}
        assert {found[n] for n in nodes} == {min(nodes)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_repeats(pairs, length):
    seen, found = set(), {}
    for identity, text in sorted(pairs):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - length + 1):
            if data[i : i + length] in seen:
                gone[i : i + length] = True
            seen.add(data[i : i + length])
        left = bytes(b for b, g in zip(data, gone) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        found[identity] = (identity, len(data), len(data) - len(left), spans, hashlib.sha256(left).hexdigest())
    return sorted(found.values(), key=str)


def repeating_texts(seed, count=60):
    rng = random.Random(seed)
    alphabet = "ab é" if seed % 2 else "abcdefgh \n日"
    passages = ["".join(rng.choice(alphabet) for _ in range(rng.randint(60, 400))) for _ in range(8)]
    texts = [None, "", "x" * 99, "x" * 101, "y" * 400, "ab" * 500]
    for _ in range(count):
        parts = []
        for _ in range(rng.randint(1, 5)):
            passage = rng.choice(passages)
            low = rng.randint(0, 40)
            parts.append(passage[low : len(passage) - rng.randint(0, 40)] if rng.random() < 0.7 else "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 150))))
        texts.append("".join(parts))
    return texts + [texts[-1], texts[-2] + "!"]


def with_setting(run, hot_contexts):
    def changed(batches):
        repeats.HOT_CONTEXTS = hot_contexts
        return run(batches)

    return changed


@pytest.mark.parametrize("seed,hot_contexts", [(1, None), (2, 1), (4, None)])
def test_repeats_equal_brute_force(spark, monkeypatch, seed, hot_contexts):
    texts = repeating_texts(seed)
    ids = [7 * i % 1009 for i in range(len(texts))]
    frame = docs_frame(spark, texts, ids).repartition(3)
    if hot_contexts:
        # The code of a lambda goes to the workers by name, so that they need the setting too.
        for name in ("_compare_contexts",):
            source = getattr(repeats, name)
            monkeypatch.setattr(repeats, name, lambda length, source=source: with_setting(source(length), hot_contexts))
    found = rows(repeats.repeat_report(frame), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert found == brute_repeats(zip(ids, texts), 100)


def test_repeats_of_odd_rows(spark):
    texts = odd_texts()
    assert rows(repeats.repeat_report(docs_frame(spark, texts)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(enumerate(texts), 100)
    assert repeats.repeat_report(docs_frame(spark, [])).collect() == []
    twice = docs_frame(spark, ["abcdefghij" * 5 + "k" * 60] * 2 + ["abc" * 60], [3, 3, None])
    assert [r[1] for r in rows(repeats.repeat_report(twice), "doc_id", "n_removed")] == [0, 0, 177]


def test_cut_text_drops_broken_characters(spark):
    # "ü" and "é" share their first byte, so that a string of 100 bytes ends inside a character.
    shared = "x" * 99
    (found,) = repeats.cut_texts(with_document_keys(docs_frame(spark, [shared + "é1", shared + "ü2"], clash=False))).collect()
    assert (found.n_removed, found.kept) == (100, "2")


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh"])
def test_hash_sort_orders_suffixes(alphabet):
    rng = random.Random(9)
    data = np.frombuffer("".join(rng.choice(alphabet) for _ in range(3000)).encode() * 2, np.uint8)
    places = np.arange(len(data) - 40)
    order, same = suffixes.hash_sort(suffixes.PrefixHash(data), places, 40)
    raw = data.tobytes()
    keys = [raw[i : i + 40] for i in order]
    assert keys == sorted(keys) and [bool(s) for s in same[1:]] == [a == b for a, b in zip(keys, keys[1:])]


def test_hash_collisions_are_found():
    data = np.frombuffer(b"abcdefgh" + b"1" * 30 + b"abcdefgh" + b"2" * 30, np.uint8)
    hashes = suffixes.PrefixHash(data)
    hashes.of = lambda start, length: np.zeros(len(start), np.uint64)  # every hash collides
    order, same = suffixes.hash_sort(hashes, np.array([0, 38]), 20)
    assert not same.any() and order.tolist() == [0, 1]
