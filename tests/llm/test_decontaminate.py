import hashlib
import random
import re

from helpers import docs_frame, odd_texts, rows

from tablewise.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - size + 1)) if words else ():
            windows.setdefault(tuple(words[i : i + size]), set()).add(item)
    found = []
    for identity, text in docs:
        words, hit, held = words_of(text), set(), set()
        for window, names in windows.items():
            for i in range(len(words) - len(window) + 1):
                if tuple(words[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    held |= names
        listed = ",".join(sorted(str(n) for n in held))
        found.append((identity, len(words), len(hit), len(held), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return sorted(found, key=str)


def test_exact_matches_equal_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["the", "of", "a", "é1", "zeta", "Quo", "日本", "x9", "in"]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, line(rng.choice([1, 2, 3, 9, 10, 11, 30]))) for i in range(12)] + [(90, None), (91, "..."), (3, "zeta zeta"), (95, "the of"), (96, "the of"), (97, "absent")]
    texts = odd_texts() + [line(rng.randint(0, 80)) for _ in range(25)]
    texts += [line(5) + ", " + items[i % 12][1].upper() + "! " + line(5) for i in range(20)]
    docs = list(enumerate(texts)) + [(1, texts[-1]), (None, texts[-1]), (20, texts[20])]
    frame = docs_frame(spark, [t for _, t in docs], [i for i, _ in docs])
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS words", "2 AS window", "3 AS term")
    found = rows(D.contamination_report(frame, bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert found == brute(docs, items)
    assert sum(r[5] for r in found) > 20


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    docs = [(i, "a b c d e f g h i j k l " * 3 + str(i)) for i in range(4)]
    items = [(5, "b c d e f g h i j k l a b"), (6, "k l a")]
    frame = docs_frame(spark, [t for _, t in docs])
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert rows(D.contamination_report(frame, bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute(docs, items)


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    (row,) = D.contamination_report(docs_frame(spark, ["a b"]), bench).collect()
    assert (row.n_words, row.n_hit, row.contaminated) == (2, 0, False)
    assert D.contamination_report(docs_frame(spark, []), bench).collect() == []


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    texts = ["alpha x x beta y gamma", "alpha" + " x" * 40 + " beta" + " x" * 40 + " gamma", "gamma beta alpha", "alpha", "alpha alpha alpha beta gamma"]
    index = D.PositionalIndex(docs_frame(spark, texts), bench)
    assert {r._k1 for r in index.near(5).collect()} == {0, 2, 4}
