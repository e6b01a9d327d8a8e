"""Similarity join against all pairs, and the matching-block ratio against the standard library."""

import random
import time
from difflib import SequenceMatcher

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewise.functions import blocks, text
from tablewise.operators import learning, similarity


def made_rows(seed, count):
    rnd = random.Random(seed)
    words = [f"w{int(rnd.paretovariate(0.5)) % 60}" for _ in range(300)]
    rows = [(i, rnd.choice(["a", "b", None]), [rnd.choice(words) for _ in range(rnd.choice([1, 2, 8, 16, 17, 32]))]) for i in range(count)]
    rows += [(1000 + i, r[1], list(reversed(r[2])) * 2) for i, r in enumerate(rows[:30])]
    rows += [(1500 + i, r[1], r[2][1:] + ["other"] * (i % 2)) for i, r in enumerate(rows[30:90])]
    rows += [(2000 + i, "a", ["hot", "hotter", f"x{i % 40}"]) for i in range(120)]
    return rows + [(3000, "a", []), (3001, "a", None), (3002, "a", [None])]


def all_pairs(rows, threshold):
    classes = {}
    for i, group, words in rows:
        held = frozenset(w for w in words or () if w is not None)
        if held:
            classes.setdefault((group, held), []).append(i)
    named = sorted((min(ids), group, held) for (group, held), ids in classes.items())
    members = sorted((i, min(ids)) for ids in classes.values() for i in ids)
    pairs = []
    for n, (x, g, a) in enumerate(named):
        for y, h, b in named[n + 1 :]:
            if g == h and len(a & b) / len(a | b) >= threshold:
                pairs.append((x, y, len(a & b) / len(a | b)))
    return members, pairs


@pytest.mark.parametrize("threshold, part_rows", [(0.3, 2_000), (0.5, 7), (0.8, 20), (1.0, 2_000), (2 / 3, 3)])
def test_equals_all_pairs(spark, threshold, part_rows):
    rows = made_rows(int(threshold * 10), 150)
    frame = spark.createDataFrame(rows, "id int, g string, words array<string>").selectExpr("*", "1 as class", "2 as size", "3 as word")
    members, classes = similarity.word_classes(frame, "id", F.col("words"), "g")
    found = similarity.similar_classes(classes, threshold, part_rows)
    wanted_members, wanted = all_pairs(rows, threshold)
    assert sorted(map(tuple, members.collect())) == wanted_members
    assert sorted((r["class"], r.other, r.similarity) for r in found.collect()) == wanted
    assert threshold > 0.9 or wanted


@pytest.mark.parametrize("threshold, part_rows", [(0.2, None), (0.2, 13), (0.4, 1)])
def test_tiles_equal_all_pairs(spark, threshold, part_rows):
    rows = made_rows(3, 60)
    frame = spark.createDataFrame(rows, "id int, g string, words array<string>")
    _, classes = similarity.word_classes(frame, "id", F.col("words"), "g")
    found = similarity.similar_classes(classes, threshold, part_rows)
    assert sorted((r["class"], r.other, r.similarity) for r in found.collect()) == all_pairs(rows, threshold)[1]


@pytest.mark.parametrize("square, frequent", [(5, 0), (7, 4), (100, 512)])
def test_pairs_of_a_tile(monkeypatch, square, frequent):
    monkeypatch.setattr(similarity, "SQUARE", square)
    monkeypatch.setattr(similarity, "FREQUENT", frequent)
    rnd = random.Random(5)
    ids = [sorted(rnd.sample(range(25), rnd.randint(1, 9))) for _ in range(40)]
    for sides in ([0] * 40, [n % 2 for n in range(40)]):
        tile = pa.table({"class": range(40), "size": [len(i) + 1 for i in ids], "_ids": pa.array(ids, pa.list_(pa.int32())), "_side": sides})
        shared = lambda x, y: len({*ids[x]} & {*ids[y]})
        wanted = [(x, y) for x in range(40) for y in range(40) if (x < y if 1 not in sides else sides[x] < sides[y])
                  and shared(x, y) / (len(ids[x]) + len(ids[y]) + 2 - shared(x, y)) >= 0.2]
        found = pa.Table.from_batches(similarity._tile_pairs(tile, 0.2))
        assert sorted(zip(found["class"].to_pylist(), found["other"].to_pylist())) == wanted and wanted


def test_low_thresholds_shuffle_no_proposals(spark):
    frame = spark.createDataFrame(made_rows(1, 50), "id int, g string, words array<string>")
    found = similarity.similar_classes(similarity.word_classes(frame, "id", F.col("words"))[1], 0.2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Aggregate" not in plan.split("FlatMapGroupsInArrow")[0]
    assert "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()


def test_no_cross_join_in_the_plan(spark):
    frame = spark.createDataFrame(made_rows(1, 50), "id int, g string, words array<string>")
    found = similarity.similar_classes(similarity.word_classes(frame, "id", F.col("words"))[1], 0.5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_empty_tables(spark):
    frame = spark.createDataFrame([], "id int, g string, words array<string>")
    members, classes = similarity.word_classes(frame, "id", F.col("words"), "g")
    assert members.collect() == [] and similarity.similar_classes(classes, 0.5).collect() == []
    with pytest.raises(ValueError):
        similarity.similar_classes(classes, 0)


def test_ratio_equals_the_library(spark):
    rnd = random.Random(9)
    made = lambda: "".join(rnd.choice("aab c😀é\n.") for _ in range(rnd.randint(0, 40)))
    pairs = [(made(), made()) for _ in range(200)] + [("ordered item", "orders items"), ("", ""), ("a", ""), (None, "x"), (None, None), ("Total  by DAY", "total by day")]
    pairs += [("monthly total of orders by region", "total orders of each region by month"), ("x" * 300, "x" * 200 + "y")]
    frame = spark.createDataFrame(pairs, "a string, b string")
    found = frame.select("a", "b", text.text_ratio(F.col("a"), F.col("b")).alias("r"), text.ratio_bound(text.collapse_spaces(F.col("a")), text.collapse_spaces(F.col("b"))).alias("most")).collect()
    for row in found:
        a, b = (" ".join((t or "").lower().split()) for t in (row.a, row.b))
        assert abs(row.r - SequenceMatcher(None, a, b, autojunk=False).ratio()) < 1e-12 and row.r <= row.most + 1e-12
    assert next(r.r for r in found if r.a == "ordered item") > 0.8


def test_similar_requests(spark):
    rows = [("1", "sql", "orders by month", 1.0), ("2", "sql", "Month: orders by", 1.0), ("3", "sql", "orders by month and region", 1.0), ("4", "csv", "orders by month", 1.0), ("5", "sql", "???", 1.0), ("6", "sql", "orders by month", 0.0)]
    history = spark.createDataFrame(rows, "id string, source_type string, description string, feedback_score double")
    members, pairs = learning.similar_requests(history, threshold=0.6, minimum_feedback=0.5)
    assert sorted(map(tuple, members.collect())) == [("1", "1"), ("2", "1"), ("3", "3"), ("4", "4")]
    (pair,) = pairs.collect()
    assert (pair["class"], pair.other, pair.members, pair.other_members, pair.similarity) == ("1", "3", 2, 1, 0.6)
    assert pair.ratio == pytest.approx(2 * 15 / 41)


@pytest.mark.parametrize("characters, cells", [(1 << 20, 1 << 21), (100, 20)])
def test_matching_blocks_equal_the_library(monkeypatch, characters, cells):
    monkeypatch.setattr(blocks, "PART_CHARACTERS", characters)
    monkeypatch.setattr(blocks, "PART_CELLS", cells)
    rnd, pairs = random.Random(4), [("ab" * 300, "ba" * 200), ("", ""), ("a", ""), ("", "b"), ("x" * 90, "x" * 70 + "y")]
    for letters, most in (("ab", 30), ("aab c😀é\n.", 40), ("abcdefghijklmnop qrst", 200), ("".join(map(chr, range(1000, 40000))), 20)):
        made = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randint(0, most)))
        for _ in range(120):
            x, y = made(), made()
            pairs += [(x, y), (x, x[rnd.randint(0, len(x)):] + y[:5] + x[: rnd.randint(0, len(x))])]
    found = blocks.matched_characters(*zip(*pairs)).tolist()
    assert found == [sum(m.size for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()) for x, y in pairs]
    assert blocks.matched_characters([], []).tolist() == []


def test_many_long_texts_are_matched_in_little_time():
    """2,000 pairs of about 1,000 characters; a tenth of a second for each pair, as before, would be minutes."""
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 9))) for _ in range(400)]
    texts = [" ".join(rnd.choice(words) for _ in range(150)) for _ in range(2_001)]
    began = time.process_time()
    found = blocks.matched_characters(texts[:-1], texts[1:])
    assert time.process_time() - began < 30 and (found > 0).all()


def test_links_of_one_request_in_several_tasks(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [(f"{i:03}", "sql", " ".join(["orders", "by", "month", *rnd.sample("abcdefghij", rnd.randint(0, 3))]), 1.0) for i in range(60)]
    history = spark.createDataFrame(rows, "id string, source_type string, description string, feedback_score double")
    whole = learning.similar_requests(history, threshold=0.4)[1]
    monkeypatch.setattr(learning, "LINK_ROWS", 3)
    dealt = learning.similar_requests(history, threshold=0.4)[1]
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, whole.collect())) and whole.count() > 100
    # Links are sent on with one text each, and not again with both.
    last = dealt._jdf.queryExecution().optimizedPlan().toString().split("ArrowEvalPython")[1].lstrip().splitlines()
    assert not any("Repartition" in line for line in last[:last.index(next(line for line in last if "Join" in line))])
