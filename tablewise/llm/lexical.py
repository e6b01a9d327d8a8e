"""Ranked lexical search over impact-sorted postings, with NRA (no random access).

1. Texts are cut into terms slice by slice. A slice becomes one block of postings of the searched
   terms: (term, document, occurrences). Blocks are written once, and their sums are the statistics:
   documents with terms, all terms, and documents that hold a term.
2. With these every posting has its impact, a whole number, and each list of a block is sorted by it;
   these blocks are the index, written as a table of its own.
3. A block is searched by reading its lists in step from the highest impact on. A document's score
   lies between the sum of the impacts read (lower) and that sum with the last impact read of each list
   in which it was not met yet (upper). Reading goes on until no document whose upper bound reaches
   the k-th best lower bound has an open interval, so that membership, ties and scores are exact. A task
   goes through its blocks with the k best so far of each item, which bound the next block from below.

Tasks hand on k rows an item, and the k best of all are chosen from these. Items are searched in groups whose texts have
about ``ITEM_BYTES`` together, so that what tasks are given of them is bounded.

Null and empty texts have no terms and never score. Each row of the documents counts as a document, also
those that repeat another's id or text; equal scores are in order of ``doc_id``, null first. Each row of the items gets its
own result, also those with a null or repeated ``item_id``; items without terms get no rows. Other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.llm.common import binary_array, text_buffer, text_slices, written

BEST = 50
ITEM_BYTES = 4 * 1024 * 1024
#: Postings read of each list in the first round; every further round reads as many again as all before.
FIRST_READ = 32
#: Parts of an item's results that are ranked apart before they meet.
SALTS = 16
POSTINGS = "doc_id array<long>, n array<long>, term array<int>, df array<long>, doc array<int>, tf array<long>"
IMPACTS = "doc_id array<long>, term array<int>, size array<long>, doc array<int>, impact array<long>"
FOUND = "item int, doc_id long, score long"
_BYTES = np.arange(256)
#: ASCII letters and digits and all bytes of other characters belong to terms; A-Z are lower-cased.
_INSIDE = (_BYTES >= 128) | np.isin(_BYTES, np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8))
_FOLDED = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
NO_ID = -(2 ** 63)


def split_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in ``data``, and the text of each."""
    inside = _INSIDE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    # Terms are the runs of kept bytes; a run ends where the next begins.
    before = np.append(0, np.cumsum(inside))
    bounds = np.append(before[starts], before[-1])
    return binary_array(_FOLDED[data[inside]], bounds), np.searchsorted(offsets, starts, "right") - 1


def _stretches(data: np.ndarray, offsets: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The texts as they are or, of one long text, parts that end between terms: (data, offsets, first text)."""
    if len(offsets) > 2 or len(data) <= 2 * limit:
        yield data, offsets, 0
        return
    start = 0
    while start < len(data):
        stop = min(start + limit, len(data))
        while stop < len(data):
            gap = np.flatnonzero(~_INSIDE[data[stop : stop + limit]])
            stop = min(stop + limit, len(data)) if not len(gap) else stop + int(gap[0])
            if len(gap):
                break
        yield data[start:stop], np.array([0, stop - start]), 0
        start = stop


def _count_terms(vocabulary: pa.Array, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (doc_id, text): one block of postings for each slice."""

    def run(batches):
        for rows in text_slices(batches, limit=limit):
            data, offsets = text_buffer(rows.column(1))
            n, found = np.zeros(len(rows), np.int64), []
            for part, bounds, base in _stretches(data, offsets, limit):
                terms, owner = split_terms(part, bounds)
                n += np.bincount(owner + base, minlength=len(rows))
                coded = terms.dictionary_encode()
                known = pc.index_in(coded.dictionary, value_set=vocabulary).fill_null(-1).to_numpy()
                term = known[coded.indices.to_numpy()] if len(terms) else np.zeros(0, np.int64)
                kept = term >= 0
                # By term and then by document, as the lists are kept.
                found.append(np.unique(term[kept].astype(np.int64) * len(rows) + owner[kept] + base, return_counts=True))
            keys, tf = (np.concatenate(x) for x in zip(*found))
            if len(found) > 1:
                keys, back = np.unique(keys, return_inverse=True)
                tf = np.bincount(back, weights=tf, minlength=len(keys))
            filled = np.flatnonzero(n)
            if not len(filled):
                continue
            term, size = np.unique(keys // len(rows), return_counts=True)
            place = np.cumsum(n > 0) - 1
            columns = (rows.column(0).take(pa.array(filled)), n[filled], term.astype(np.int32), size, place[keys % len(rows)].astype(np.int32), tf.astype(np.int64))
            yield _row(columns, ("doc_id", "n", "term", "df", "doc", "tf"))

    return run


def _row(columns: Sequence, names: Sequence[str]) -> pa.RecordBatch:
    """One row of lists."""
    values = [c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c)) for c in columns]
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values], list(names))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    """The lists of each row."""
    for batch in batches:
        for row in range(batch.num_rows):
            yield [column[row].values for column in batch.columns]


def length_norms(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """``100 - 50 + ((50 * n * N) div L)``, with whole numbers of any size where 64 bits might not hold the product."""
    if 50 * int(n.max(initial=0)) * documents < 2 ** 63:
        return 50 + (50 * n * documents) // terms
    return np.array([50 + (50 * int(x) * documents) // terms for x in n], np.int64)


def term_weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _weigh(documents: int, terms: int, weights: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of postings: blocks of impacts, each list from the highest impact down."""

    def run(batches):
        for doc_id, n, term, size, doc, tf in _lists(batches):
            m = length_norms(n.to_numpy(), documents, terms)
            term, size, doc, tf = (x.to_numpy() for x in (term, size, doc, tf))
            owner = np.repeat(term, size)
            impact = weights[owner] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
            order = np.lexsort((doc, -impact, owner))
            yield _row((doc_id, term, size, doc[order], impact[order]), ("doc_id", "term", "size", "doc", "impact"))

    return run


def no_random_access(lists: Sequence[tuple[np.ndarray, np.ndarray]], documents: int, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) that hold the k best of ``lists``, each (documents, impacts) from the highest impact down.

    Every document whose score reaches ``floor`` and the k-th best is returned with its exact score.
    """
    lower, depth = np.zeros(documents, np.int64), 0
    lists = [x for x in lists if len(x[0])]
    while True:
        ahead = 2 * depth or FIRST_READ
        open_lists = []
        for docs, impacts in lists:
            lower[docs[depth:ahead]] += impacts[depth:ahead]
            if ahead < len(docs):
                open_lists.append((docs[:ahead], int(impacts[ahead - 1])))
        # What a document may still get: the last impact of each open list in which it was not met.
        rest = np.full(documents, sum(last for _, last in open_lists), np.int64)
        for docs, last in open_lists:
            rest[docs] -= last
        least = max(floor, 1, int(np.partition(lower, documents - k)[documents - k]) if documents > k else 0)
        reached = lower + rest >= least
        if not (reached & (rest > 0)).any():
            chosen = np.flatnonzero(reached)
            return chosen, lower[chosen]
        depth = ahead


class _Best:
    """The k best documents of an item so far: highest score first, then smallest id."""

    def __init__(self, k: int) -> None:
        self.k, self.floor = k, 0
        self.scores, self.ids, self.missing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        scores, ids, missing = np.append(self.scores, scores), np.append(self.ids, ids), np.append(self.missing, missing)
        order = np.lexsort((ids, ~missing, -scores))[: self.k]
        self.scores, self.ids, self.missing = scores[order], ids[order], missing[order]
        if len(order) == self.k:
            self.floor = int(self.scores[-1])


def _search(queries: Sequence[np.ndarray], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of impacts: the k best of the task's documents for each query, which is an array of term numbers."""

    def run(batches):
        best = [_Best(k) for _ in queries]
        for doc_id, term, size, doc, impact in _lists(batches):
            ids, missing = doc_id.fill_null(NO_ID).to_numpy(), doc_id.is_null().to_numpy(zero_copy_only=False)
            cuts, doc, impact = np.append(0, np.cumsum(size.to_numpy())), doc.to_numpy(), impact.to_numpy()
            where = {t: (doc[a:b], impact[a:b]) for t, a, b in zip(term.to_numpy().tolist(), cuts[:-1].tolist(), cuts[1:].tolist())}
            for query, held in zip(queries, best):
                lists = [where[t] for t in query.tolist() if t in where]
                if not lists or sum(int(x[1][0]) for x in lists) < held.floor:
                    continue
                chosen, scores = no_random_access(lists, len(ids), k, held.floor)
                held.add(scores, ids[chosen], missing[chosen])
        for number, held in enumerate(best):
            if len(held.scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(held.scores), number, np.int32)), pa.array(held.ids, mask=held.missing), pa.array(held.scores)], ["item", "doc_id", "score"])

    return run


class ImpactIndex:
    """Impact-sorted postings of ``vocabulary`` in the documents, as written tables."""

    def __init__(self, docs: DataFrame, vocabulary: Sequence[bytes], slice_bytes: int = 8 * 1024 * 1024) -> None:
        self.number = {term: i for i, term in enumerate(vocabulary)}
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        postings = written(texts.mapInArrow(_count_terms(pa.array(vocabulary, pa.large_binary()), slice_bytes), POSTINGS))
        sums = postings.agg(F.sum(F.size("doc_id")).alias("n"), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("l")).first()
        self.documents, self.terms = sums.n or 0, sums.l or 0
        held = postings.select(F.explode(F.arrays_zip("term", "df")).alias("t")).groupBy("t.term").agg(F.sum("t.df").alias("df"))
        weights = np.zeros(len(vocabulary), np.int64)
        for row in held.collect():  # at most one row for each searched term
            weights[row.term] = term_weight(self.documents, row.df)
        self.blocks = written(postings.mapInArrow(_weigh(self.documents, self.terms, weights), IMPACTS))

    def search(self, items: Sequence[Sequence[bytes]], k: int = BEST) -> DataFrame:
        """(item, doc_id, score, rank) of the k best documents of each item, which is a sequence of terms."""
        queries = [np.array(sorted({self.number[t] for t in terms if t in self.number}), np.int32) for terms in items]
        order = [F.desc("score"), F.asc_nulls_first("doc_id")]
        found = self.blocks.mapInArrow(_search(queries, k), FOUND).withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        # One item's rows are as many as k times the tasks: parts are ranked first.
        parts = found.withColumn("rank", F.row_number().over(W.partitionBy("item", "_salt").orderBy(*order))).where(F.col("rank") <= k)
        ranked = parts.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        return ranked.select("item", "rank", "doc_id", "score")


def item_groups(items: DataFrame, limit: int = ITEM_BYTES) -> Iterator[list]:
    """Groups of (item_id, text) rows with about half of ``limit`` bytes of text together, an item at least."""
    texts = items.select("item_id", "text").where(F.length("text") > 0)
    total = texts.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    groups = 1 + 2 * total // limit
    for group in range(groups):
        dealt = F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == group
        yield texts.where(dealt).collect()


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = BEST, limit: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents of each item."""
    spark = docs.sparkSession
    named = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", items.schema["item_id"].dataType)])
    found = None
    for rows in item_groups(items, limit):
        data, offsets = text_buffer(pa.array([r.text for r in rows], pa.large_string()))
        terms, owner = split_terms(data, offsets)
        words, cuts = terms.to_pylist(), np.searchsorted(owner, np.arange(len(rows) + 1))
        queries = [words[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        index = ImpactIndex(docs, sorted(set(words)))
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], named)
        part = index.search(queries, k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        found = part if found is None else found.unionByName(part)
    return found


#: The same result in DuckDB.
RANKED_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT count(*)::BIGINT AS nd, sum(len(w))::BIGINT AS nt FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, nd),
sc AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * nd) // nt)))))::BIGINT AS score FROM q JOIN w USING (term) JOIN tf USING (term), s GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM sc WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
