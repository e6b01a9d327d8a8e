"""Similarity join of all rows of a table by the words that they share.

Rows with the same set of words are one class, which is compared once. Of each class the words are put in
order from the rarest. Two sets whose Jaccard similarity reaches the threshold share a word within their first words
(as many as may be missing from the other, and one more) and are alike in size, so that (word, size range) is the key of an
equi-join; what it proposes is checked on the whole sets. A key that many classes hold is cut into parts
that meet each other in tasks of their own.

Below ``JOIN_FROM`` nearly all words are first words, so that a join would propose most pairs of all, many times each. There the
classes of a group are cut into blocks by size, and each two blocks that may hold a pair are a tile: one task counts the
shared words of all its pairs by numbers of words, and only pairs that reach the threshold leave it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.operators.joins import spread
from tablewise.operators.ordering import row_numbers
from tablewise.session import reliable_checkpoint

#: Rows of one key that one task compares with as many others.
PART_ROWS = 2_000
#: Threshold from which first words are few enough for a join.
JOIN_FROM = 0.5
#: Classes of a block; a tile is two blocks, counted in squares of ``SQUARE`` rows.
BLOCK_ROWS, SQUARE = 8_000, 2_000
#: Words counted by a matrix product; the others by their places.
FREQUENT = 512
#: Products of the threshold and a size are taken a little lower, so that no rounding loses a pair.
SLACK = 1e-9


def word_classes(rows: DataFrame, key: str, words: Column, within: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(``key``, class) of all rows with words, and the classes: (group, class, words, size, members), written.

    A class is named by the smallest ``key`` among its rows. ``within`` names a column whose values are kept apart, null among them.
    """
    sets = rows.select(
        F.col(key).alias("_key"), (F.col(within).cast("string") if within else F.lit(None).cast("string")).alias("_group"),
        F.array_sort(F.array_distinct(F.array_compact(words))).alias("_words"),
    ).where(F.size("_words") > 0)
    # A digest is the key of the shuffle, and the words of one row go with it.
    named = sets.withColumn("_digest", F.sha2(F.to_json(F.struct("_group", "_words"), {"ignoreNullFields": "false"}), 256))
    classes = reliable_checkpoint(named.groupBy("_digest").agg(
        F.min("_key").alias("class"), F.first("_group").alias("group"), F.first("_words").alias("words"), F.count(F.lit(1)).alias("members")
    ).withColumn("size", F.size("words")))
    members = named.select("_key", "_digest").join(classes.select("_digest", "class"), "_digest").select(F.col("_key").alias(key), "class")
    return members, classes.drop("_digest")


def _first_words(classes: DataFrame, threshold: float) -> DataFrame:
    """(group, word, class, size, place) of each class's rarest words, one more than may be missing from a partner."""
    words = classes.select("group", "class", "size", F.explode("words").alias("word"))
    counts = words.groupBy("group", "word").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(F.col("group").alias("_g"), F.col("word").alias("_w"), "_n").where("_n > 1")
    # Words of one class alone propose nothing, but they hold the first places.
    counted = words.join(counts, (F.col("word") == F.col("_w")) & F.col("group").eqNullSafe(F.col("_g")), "left")
    ordered = counted.groupBy("group", "class", "size").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("_n", F.lit(1)).alias("n"), "word"))).alias("_ordered"))
    first = F.col("size") - F.ceil(F.col("size") * threshold - SLACK).cast("int") + 1
    placed = ordered.select("group", "class", "size", F.posexplode(F.slice("_ordered", F.lit(1), first)).alias("place", "_o"))
    return placed.where("_o.n > 1").select("group", "class", "size", "place", F.col("_o.word").alias("word"))


def _places(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and word number of each entry of an array of lists."""
    lengths = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(lists)), lengths), lists.flatten().to_numpy(zero_copy_only=False)


def _shared(left: pa.Array, right: pa.Array) -> np.ndarray:
    """How many words each list on the left has in common with each one on the right."""
    (row, word), (column, other) = _places(left), _places(right)

    def dense(rows: np.ndarray, words: np.ndarray, height: int) -> np.ndarray:
        held = np.zeros((height, FREQUENT), np.float32)
        few = words < FREQUENT
        held[rows[few], words[few]] = 1
        return held

    shared = dense(row, word, len(left)) @ dense(column, other, len(right)).T
    rare, rare_other = word >= FREQUENT, other >= FREQUENT
    row, word, column, other = row[rare], word[rare], column[rare_other], other[rare_other]
    order = np.argsort(other, kind="stable")
    column, other = column[order], other[order]
    first = np.searchsorted(other, word, "left")
    times = np.searchsorted(other, word, "right") - first
    place = np.arange(times.sum()) + np.repeat(first - np.cumsum(times) + times, times)
    met = np.bincount(np.repeat(row, times) * len(right) + column[place], minlength=shared.size)
    return shared + met.reshape(shared.shape)


def _tile_pairs(rows: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """The pairs of one tile: of its two blocks, or within the block that it meets itself."""
    rows = rows.combine_chunks()
    sides = rows["_side"].to_numpy()
    left = rows.take(np.flatnonzero(sides == 0))
    right = rows.take(np.flatnonzero(sides == 1)) if (sides == 1).any() else left
    for i in range(0, len(left), SQUARE):
        for j in range(i if right is left else 0, len(right), SQUARE):
            a, b = left.slice(i, SQUARE).combine_chunks(), right.slice(j, SQUARE).combine_chunks()
            shared = _shared(a["_ids"].combine_chunks(), b["_ids"].combine_chunks())
            either = a["size"].to_numpy()[:, None] + b["size"].to_numpy()[None, :] - shared
            likeness = shared / either
            found = likeness >= threshold
            x, y = np.nonzero(np.triu(found, 1) if right is left and i == j else found)
            yield from pa.table({"class": a["class"].take(x), "other": b["class"].take(y), "similarity": likeness[x, y]}).to_batches()


def _numbered_words(classes: DataFrame) -> DataFrame:
    """(class, size, group, _ids, _block): words as numbers, the most frequent first; blocks of classes alike in size.

    Words of one class alone are in no pair and have no number. A row is named by itself, since keys may repeat.
    """
    whole = ["group", "class", "size"]
    rows = reliable_checkpoint(classes.select(*whole, "words", F.sha2(F.to_json(F.struct("group", "words"), {"ignoreNullFields": "false"}), 256).alias("_name")))
    words = rows.select("_name", F.explode("words").alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    numbers = row_numbers(counts, [F.desc("_n"), F.col("word")], output="_number").select("word", (F.col("_number") - 1).cast("int").alias("_id"))
    ids = words.join(numbers, "word").groupBy("_name").agg(F.collect_list("_id").alias("_ids"))
    placed = row_numbers(rows.select("_name", *whole), [F.col("size"), F.col("_name")], ["group"], output="_place")
    return reliable_checkpoint(placed.join(ids, "_name").drop("_name"))


def _alike_in_tiles(classes: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """(class, other, similarity) of all pairs, from tiles of two blocks."""
    named = F.coalesce(F.concat(F.lit("="), "group"), F.lit(""))
    rows = _numbered_words(classes).select(
        named.alias("_group"), F.floor((F.col("_place") - 1) / block_rows).cast("int").alias("_block"), "class", "size", "_ids")
    blocks = rows.groupBy("_group", "_block").agg(F.min("size").alias("_least"), F.max("size").alias("_most"))
    later = blocks.select("_group", F.col("_block").alias("_later"), F.col("_least").alias("_later_least"))
    # Sizes grow from block to block; a pair's smaller set has the threshold of the larger one's size at least.
    may = (F.col("_block") <= F.col("_later")) & (F.col("_most") >= F.col("_later_least") * threshold - SLACK)
    tiles = reliable_checkpoint(blocks.join(later, "_group").where(may).select("_group", "_block", "_later"))
    left = rows.join(tiles, ["_group", "_block"]).withColumn("_side", F.lit(0))
    apart = tiles.where("_block < _later").withColumnsRenamed({"_block": "_earlier", "_later": "_block"})
    right = rows.join(apart, ["_group", "_block"]).select(
        "_group", F.col("_earlier").alias("_block"), F.col("_block").alias("_later"), "class", "size", "_ids", F.lit(1).alias("_side"))
    key = ["_group", "_block", "_later"]
    dealt = spread(left.unionByName(right), *key)
    kind = classes.schema["class"].dataType
    schema = T.StructType([T.StructField("class", kind), T.StructField("other", kind), T.StructField("similarity", T.DoubleType())])
    names = [f.name for f in schema]

    def pairs(tile: pa.Table) -> pa.Table:
        found = list(_tile_pairs(tile, threshold))
        return pa.Table.from_batches(found) if found else tile.slice(0, 0).select(["class", "class", "size"]).rename_columns(names).cast(pa.schema([
            ("class", tile["class"].type), ("other", tile["class"].type), ("similarity", pa.float64())]))

    found = dealt.groupBy(*key).applyInArrow(pairs, schema)
    return found.where(F.col("class") != F.col("other")).select(
        F.least("class", "other").alias("class"), F.greatest("class", "other").alias("other"), "similarity")


def similar_classes(classes: DataFrame, threshold: float, part_rows: int | None = None) -> DataFrame:
    """(class, other, similarity): all pairs of classes of one group whose Jaccard similarity is ``threshold`` at least."""
    if not 0 < threshold <= 1:
        raise ValueError("a threshold lies above 0 and is 1 at most")
    if threshold < JOIN_FROM:
        return _alike_in_tiles(classes, threshold, part_rows or BLOCK_ROWS)
    return _alike_by_join(classes, threshold, part_rows or PART_ROWS)


def _alike_by_join(classes: DataFrame, threshold: float, part_rows: int) -> DataFrame:
    """(class, other, similarity) of all pairs, from classes that share a first word."""
    step = math.log(1 / threshold) or 1.0
    prefix = reliable_checkpoint(_first_words(classes, threshold).withColumn("range", F.floor(F.log(F.col("size").cast("double")) / step + SLACK).cast("int")))
    # The smaller set of a pair looks among the sizes of its own range and of the next.
    small = prefix.withColumn("range", F.explode(F.array(F.col("range"), F.col("range") + 1)))
    keys = ["_group", "word", "range"]
    grouped = lambda side: side.withColumn("_group", F.coalesce(F.concat(F.lit("="), "group"), F.lit("")))
    small, large = grouped(small), grouped(prefix)
    count = lambda side, name: side.groupBy(keys).agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias(name))
    crowded = count(small, "_small").join(count(large, "_large"), keys).where("_small > 1 OR _large > 1")

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in its own part, beside every part of the other side."""
        marked = side.join(crowded, keys, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("_small", "_large")})
        part = F.pmod(F.xxhash64("class"), F.col(f"_{own}")).cast("int")
        return marked.withColumns({f"_{own}_part": part, f"_{other}_part": F.explode(F.sequence(F.lit(0), F.col(f"_{other}") - 1))})

    parts = ["_small_part", "_large_part"]
    left = dealt(small, "small", "large").select(*keys, *parts, "class", "size", "place")
    right = dealt(large, "large", "small").select(
        *keys, *parts, F.col("class").alias("other"), F.col("size").alias("other_size"), F.col("place").alias("other_place"))
    smaller = (F.col("size") < F.col("other_size")) | (F.col("size") == F.col("other_size")) & (F.col("class") < F.col("other"))
    alike = F.col("other_size") * threshold - SLACK <= F.col("size")
    # What both can share from this word on must be enough.
    still = F.least(F.col("size") - F.col("place"), F.col("other_size") - F.col("other_place"))
    enough = still >= (F.col("size") + F.col("other_size")) * (threshold / (1 + threshold)) - SLACK
    proposed = left.join(right, [*keys, *parts]).where(smaller & alike & enough).select("class", "other").distinct()
    mine = classes.select("class", "words")
    theirs = classes.select(F.col("class").alias("other"), F.col("words").alias("_words"))
    shared = F.size(F.array_intersect("words", "_words"))
    both = proposed.join(mine, "class").join(theirs, "other").withColumn("_shared", shared)
    similarity = F.col("_shared") / (F.size("words") + F.size("_words") - F.col("_shared"))
    found = both.withColumn("similarity", similarity).where(F.col("similarity") >= threshold)
    return found.select(F.least("class", "other").alias("class"), F.greatest("class", "other").alias("other"), "similarity")
