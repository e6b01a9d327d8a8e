"""Benchmark passages in documents, by a positional inverted index.

The postings of all benchmark terms in the documents (term, document, place) are stored as a
table. For every window of benchmark words the postings of its rarest term propose places, the
postings of its next rarest term at the right offset confirm them, and the other terms'
postings decide: an exact match has every word of the window in its place. The same
postings give proximity matches: the two rarest terms near each other, in any order.

Windows are ``size`` consecutive words of an item; a shorter item that isn't empty is one window.
A null or empty text has no words. Rows that repeat a document's id and text get the same
result; rows that share only the id are told apart. Items may repeat; null items and items
without words have no windows, and a null ``item_id`` never names an item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import free_names, row_key, word_count, word_line, written

SIZE = 10
SLOP = 5
#: A lookup table of so many rows at most is copied to all executors; beyond it both sides are shuffled.
BROADCAST_ROWS = 100_000


def sized(lookup: DataFrame) -> DataFrame:
    """A written table with a broadcast hint if its counted rows are few."""
    return F.broadcast(lookup) if lookup.count() <= BROADCAST_ROWS else lookup


def benchmark_windows(items: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """Distinct windows with their words (``window``, ``words``) and the items that hold them (``window``, ``item_id``)."""
    if not 1 <= size <= 62:
        raise ValueError("a window has 1 to 62 words")
    lines = items.select("item_id", word_line(F.col("text")).alias("_line")).where(F.col("_line") != "")
    words = lines.select("item_id", F.split("_line", " ").alias("_words"))
    last = F.greatest(F.size("_words") - size, F.lit(0))
    held = words.select(
        "item_id", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("_words", i + 1, size))).alias("words")
    ).distinct()
    held = written(held.select(F.sha2(F.array_join("words", " "), 256).alias("window"), "words", "item_id"))
    return held.groupBy("window").agg(F.first("words").alias("words")), held.select("window", "item_id").where(F.col("item_id").isNotNull())


def postings(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, _k1, _k2, place) of every place of the vocabulary's words (``word``, ``term``) in the documents."""
    lines = docs.select(*row_key(F.col("doc_id"), F.col("text")), F.split(word_line(F.col("text")), " ").alias("_words"))
    placed = lines.select("_k1", "_k2", F.posexplode("_words").alias("place", "word"))
    return placed.join(vocabulary, "word").select("term", "_k1", "_k2", "place")


class PositionalIndex:
    """Postings of the documents for a benchmark, and the matches that they give."""

    def __init__(self, docs: DataFrame, items: DataFrame, size: int = SIZE) -> None:
        self.windows, self.holders = benchmark_windows(items, size)
        self.windows = written(self.windows)
        words = self.windows.select(F.explode("words").alias("word")).distinct()
        # A term is the word's hash, so that no numbering of the vocabulary is needed.
        vocabulary = written(words.select("word", F.xxhash64("word").alias("term")))
        self.postings = written(postings(docs, sized(vocabulary)))
        counts = self.postings.groupBy("term").agg(F.count("place").alias("n"))
        terms = self.windows.select("window", F.posexplode("words").alias("offset", "word")).select("window", "offset", F.xxhash64("word").alias("term"))
        ranked = (
            terms.join(counts, "term").groupBy("window")
            .agg(F.sort_array(F.collect_list(F.struct("n", "offset", "term"))).alias("terms"))
            .join(self.windows.select("window", F.size("words").alias("size")), "window")
            .where(F.size("terms") == F.col("size"))  # else a word occurs nowhere
        )
        self.ranked = written(ranked)

    def _of_rank(self, rank: int) -> DataFrame:
        """Each window's term of this rank from the rarest; of fewer terms, the last."""
        chosen = F.col("terms")[F.least(F.lit(rank), F.col("size") - 1)]
        return self.ranked.select("window", "size", chosen["term"].alias("term"), chosen["offset"].alias("offset"))

    def candidates(self) -> DataFrame:
        """(window, _k1, _k2, start) where the two rarest terms stand in their places."""
        rarest = sized(written(self._of_rank(0)))
        proposed = self.postings.join(rarest, "term").select("window", "size", "_k1", "_k2", (F.col("place") - F.col("offset")).alias("start"))
        second = self._of_rank(1)
        terms = sized(written(second.select("term").distinct()))
        confirming = self.postings.join(terms, "term", "left_semi").select(
            F.col("term").alias("_c0"), F.col("_k1").alias("_c1"), F.col("_k2").alias("_c2"), F.col("place").alias("_c3"))
        named = second.select("window", F.col("term").alias("_term"), "offset")
        wanted = proposed.where("start >= 0").join(sized(named), "window").withColumn("place", F.col("start") + F.col("offset"))
        on = [F.col(a) == F.col(b) for a, b in (("_k1", "_c1"), ("_k2", "_c2"), ("place", "_c3"), ("_term", "_c0"))]
        return wanted.join(confirming, on, "left_semi").select("window", "size", "_k1", "_k2", "start").distinct()

    def exact(self) -> DataFrame:
        """(window, _k1, _k2, start, size) where all words of the window stand in their places."""
        found = written(self.candidates())
        documents = sized(written(found.select("_k1", "_k2").distinct()))
        inside = self.postings.join(documents, ["_k1", "_k2"], "left_semi")
        others = self.ranked.select("window", F.explode(F.slice("terms", 3, 62)).alias("t")).select("window", "t.term", "t.offset")
        asked = found.where("size > 2").join(sized(written(others)), "window").withColumn("place", F.col("start") + F.col("offset"))
        met = (
            asked.join(inside, ["_k1", "_k2", "place", "term"])
            .groupBy("window", "_k1", "_k2", "start", "size").agg(F.bit_or(F.expr("shiftleft(1L, offset)")).alias("seen"))
            .where(F.bit_count("seen") == F.col("size") - 2)
        )
        columns = ["window", "_k1", "_k2", "start", "size"]
        return met.select(columns).unionByName(found.where("size <= 2").select(columns))

    def near(self, slop: int = SLOP) -> DataFrame:
        """(window, _k1, _k2) where the two rarest terms stand within ``slop`` words of each other."""
        pair = self._of_rank(0).where("size > 1").select("window", "term").join(
            self._of_rank(1).select("window", F.col("term").alias("_term")), "window")
        pair = sized(written(pair))
        step = F.col("place") - F.pmod("place", F.lit(slop + 1))
        left = self.postings.join(pair, "term").withColumn("zone", F.explode(F.array(step - slop - 1, step, step + slop + 1)))
        terms = sized(written(pair.select(F.col("_term").alias("term")).distinct()))
        right = self.postings.join(terms, "term", "left_semi").select(
            F.col("term").alias("_term"), "_k1", "_k2", F.col("place").alias("_place"), step.alias("zone"))
        met = left.join(right, ["_k1", "_k2", "zone", "_term"])
        return met.where((F.abs(F.col("place") - F.col("_place")) <= slop) & (F.col("place") != F.col("_place"))).select("window", "_k1", "_k2").distinct()


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """(_k1, _k2, n_hit, item_ids) of the documents in which windows occur."""
    index = PositionalIndex(docs, items, size)
    exact = written(index.exact())
    hits = (
        exact.select("_k1", "_k2", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("place")).distinct()
        .groupBy("_k1", "_k2").agg(F.count("place").alias("n_hit"))
    )
    held = (
        exact.select("_k1", "_k2", "window").distinct().join(index.holders, "window").select("_k1", "_k2", F.col("item_id").cast("string").alias("item"))
        .distinct().groupBy("_k1", "_k2").agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
    )
    return written(hits.join(held, ["_k1", "_k2"], "left"))


def without_contaminated(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows in whose texts no window occurs, with their columns of any name as they are."""
    first, second = free_names(docs.columns, "_k1", "_k2")
    hit = contamination(docs.select("doc_id", "text"), items, size).select(F.col("_k1").alias(first), F.col("_k2").alias(second))
    keyed = docs.withColumns(dict(zip((first, second), row_key(F.col("doc_id"), F.col("text")))))
    return keyed.join(hit, [first, second], "left_anti").select(docs.columns)


def contamination_report(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """Per document the counts of words, of hit words and of items, and the digest of the items' ids."""
    found = contamination(docs, items, size)
    counted = docs.select("doc_id", *row_key(F.col("doc_id"), F.col("text")), word_count(word_line(F.col("text"))).alias("n_words"))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0))
    return counted.join(found, ["_k1", "_k2"], "left").select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


#: The same result in DuckDB, for windows of ten words.
CONTAMINATION_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS line FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS line FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT doc_id, i, dw.size, item_id FROM dw JOIN bw ON dw.line = bw.line AND dw.size = bw.size),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
