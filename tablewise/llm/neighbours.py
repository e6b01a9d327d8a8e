"""Approximate nearest neighbours by balanced posting lists.

Centroids come from a balanced k-means on a bounded sample. Every vector is put in the list of its nearest
centroid and, near a boundary, in those of further centroids that are almost as near and not hidden behind
a chosen one; lists that come out large are cut into parts of a bounded size. A query finds its nearest
centroids in a neighbour graph held in memory and reads the lists whose distance is within a
ratio of the nearest one's. Distances are exact, in double precision, on the original vectors.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do those of
another length than most. Repeated rows of an id count once. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewise.llm.common import hash_sample, written

SAMPLE = 20_000
#: Vectors for each list, within these numbers of lists.
LIST_ROWS, LEAST_LISTS, MOST_LISTS = 800, 16, 4_096
COPIES = 4
COPY_RATIO = 1.03
#: A chosen centroid hides another that is this much nearer to it than the vector is.
HIDING = 0.4
PART_ROWS = 4_096
DEGREE = 12
#: Nearest centroids among which a centroid's neighbours are chosen, and centroids far from each other where searches begin.
NEAR, ENTRIES = 64, 64
#: Rows that the lists read for a query hold at least, for each neighbour asked for.
READ_ROWS = 40
BEAM = 48
#: Rows whose distances to all centroids are held at once.
BLOCK = 512
#: Lists up to this times the distance of the nearest centroid are read.
PROBE_RATIO = 1.15


@dataclass
class Index:
    centroids: np.ndarray
    graph: np.ndarray  # neighbours of each centroid
    entries: np.ndarray  # where searches begin


def usable(vector: Column) -> Column:
    """Vectors that take part: of finite components, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def vectors(table: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part, in double precision, once for each id."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(usable(F.col("v")), F.lit(False)))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    length = lengths[0].n if lengths else 0
    return rows.where(F.size("v") == length).groupBy("vec_id").agg(F.min("v").alias("v"))


def balanced_means(sample: np.ndarray, lists: int, rounds: int = 20, weight: float = 0.05, seed: int = 0) -> np.ndarray:
    """k-means in which a list's size adds to its distances, so that lists come out alike in size."""
    random = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    centroids = distinct[random.permutation(len(distinct))[:lists]].copy()
    spread = max(float(sample.var(0).sum()), 1e-12)
    load = np.full(len(centroids), len(sample) / len(centroids))
    for _ in range(rounds):
        fuller = weight * spread * (load * len(centroids) / len(sample) - 1)
        owner = np.concatenate([(squared(sample[i : i + BLOCK], centroids) + fuller).argmin(1) for i in range(0, len(sample), BLOCK)])
        load = 0.5 * load + 0.5 * np.bincount(owner, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, sample)
        size = np.bincount(owner, minlength=len(centroids))[:, None]
        centroids = np.where(size > 0, sums / np.maximum(size, 1), centroids)
    return centroids


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


def _neighbours(centroids: np.ndarray, begin: int) -> np.ndarray:
    """Neighbours of a block of centroids: of the nearest ones first those that no neighbour nearer than the centroid hides."""
    block = centroids[begin : begin + BLOCK]
    own, many = np.arange(len(block)), min(NEAR, len(centroids) - 1)
    away = squared(block, centroids)
    away[own, own + begin] = np.inf
    near = np.argsort(away, 1, kind="stable")[:, :many]
    away = np.take_along_axis(away, near, 1)
    kept = np.zeros(near.shape, bool)
    for rank in range(many):
        fits = kept.sum(1) < DEGREE
        for earlier in range(rank):
            between = ((centroids[near[:, rank]] - centroids[near[:, earlier]]) ** 2).sum(1)
            fits &= ~kept[:, earlier] | (between >= away[:, rank])
        kept[:, rank] = fits
    # The places left go to the nearest of the hidden ones.
    order = np.argsort(~kept, 1, kind="stable")[:, : min(DEGREE, many)]
    return np.take_along_axis(near, order, 1)


def build_index(sample: np.ndarray, lists: int) -> Index:
    centroids = balanced_means(sample, lists)
    nearest = np.concatenate([_neighbours(centroids, begin) for begin in range(0, len(centroids), BLOCK)])
    # A ring keeps the graph connected.
    ring = np.roll(np.arange(len(centroids)), -1)[:, None]
    entries, away = [0], ((centroids - centroids[0]) ** 2).sum(1)
    while len(entries) < min(ENTRIES, len(centroids)) and away.max() > 0:
        entries.append(int(away.argmax()))
        away = np.minimum(away, ((centroids - centroids[entries[-1]]) ** 2).sum(1))
    return Index(centroids, np.concatenate([nearest, ring], 1), np.array(entries))


def search_graph(index: Index, query: np.ndarray, ratio: float = PROBE_RATIO, least: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Centroids near the query, nearest first, and their distances: a best-first search from the entry
    points that goes on while what it can open next is within ratio of the nearest found, and for ``least`` steps."""
    away = lambda at: np.sqrt(((index.centroids[at] - query) ** 2).sum(-1))
    known = np.full(len(index.centroids), np.inf)
    closed = np.zeros(len(index.centroids), bool)
    known[index.entries] = away(index.entries)
    for step in range(len(known)):
        at = int(np.where(closed, np.inf, known).argmin())
        if closed[at] or not np.isfinite(known[at]) or step >= least and known[at] > ratio * known.min():
            break
        closed[at] = True
        fresh = np.unique(index.graph[at])
        fresh = fresh[~np.isfinite(known[fresh])]
        known[fresh] = away(fresh)
    order = np.argsort(known, kind="stable")
    order = order[np.isfinite(known[order])]
    return order, known[order]


def assigned_lists(index: Index, batch: np.ndarray, copies: int = COPIES, ratio: float = COPY_RATIO) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of every copy: the nearest list, and next ones within the ratio that no chosen centroid hides."""
    away = np.sqrt(squared(batch, index.centroids))
    order = np.argsort(away, 1, kind="stable")[:, : min(4 * copies, away.shape[1])]
    rows, lists = [np.arange(len(batch))], [order[:, 0]]
    chosen = [order[:, 0]]
    count = np.ones(len(batch), int)
    for rank in range(1, order.shape[1]):
        candidate = order[:, rank]
        distance = away[np.arange(len(batch)), candidate]
        fits = (distance <= ratio * away[np.arange(len(batch)), order[:, 0]]) & (count < copies)
        for earlier in chosen:
            between = np.sqrt(((index.centroids[candidate] - index.centroids[np.maximum(earlier, 0)]) ** 2).sum(1))
            fits &= (earlier < 0) | (between >= HIDING * distance)
        chosen.append(np.where(fits, candidate, -1))
        count += fits
        rows.append(np.flatnonzero(fits))
        lists.append(candidate[fits])
    return np.concatenate(rows), np.concatenate(lists)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _assign(index: Index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(begin, BLOCK)
                row, of = assigned_lists(index, _matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(of.astype(np.int32))], ["vec_id", "v", "list"])

    return run


def chosen_lists(index: Index, query: np.ndarray, ratio: float, sizes: np.ndarray, rows: int) -> np.ndarray:
    """The lists within the ratio of the nearest one, and as many more as it takes to hold ``rows`` rows."""
    near, away = search_graph(index, query, ratio)
    if sizes[near].sum() < rows:
        away = np.sqrt(((index.centroids - query) ** 2).sum(1))
        near = np.argsort(away, kind="stable")
        away = away[near]
    enough = int(np.searchsorted(sizes[near].cumsum(), rows)) + 1
    return near[: max(enough, int(np.count_nonzero(away <= ratio * away[0] + 1e-12)))]


def _probe(index: Index, ratio: float, sizes: np.ndarray, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in batches:
            rows, lists = [], []
            for i, query in enumerate(_matrix(batch.column(1)) if batch.num_rows else ()):
                near = chosen_lists(index, query, ratio, sizes, least)
                rows.append(np.full(len(near), i))
                lists.append(near)
            if rows:
                row = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(np.concatenate(lists).astype(np.int32))], ["query_id", "q", "list"])

    return run


def exact_nearest(queries: np.ndarray, query_ids: np.ndarray, base: np.ndarray, base_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, base row, distance) of each query's k nearest: a product bounds the distances, then they are computed exactly."""
    found = [], [], []
    scale = float((base * base).sum(1).max(initial=0))
    for begin in range(0, len(queries), 256):
        rough = squared(queries[begin : begin + 256], base)
        for i, line in enumerate(rough, begin):
            line = np.where(base_ids == query_ids[i], np.inf, line)
            limit = np.partition(line, k - 1)[k - 1] if len(line) > k else np.inf
            near = np.flatnonzero(line <= limit + 1e-9 * (scale + float(queries[i] @ queries[i])) if np.isfinite(limit) else np.isfinite(line))
            exact = np.sqrt(((base[near] - queries[i]) ** 2).sum(1))
            best = np.lexsort((base_ids[near], exact))[:k]
            found[0].append(np.full(len(best), i))
            found[1].append(near[best])
            found[2].append(exact[best])
    return tuple(np.concatenate(x) if x else np.zeros(0, int) for x in found)


def _search_part(k: int) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(key, base, queries):
        if not len(base) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        ids, query_ids = base["vec_id"].to_numpy(), queries["query_id"].to_numpy()
        q, b, score = exact_nearest(np.stack(queries["q"]), query_ids, np.stack(base["v"]), ids, k)
        return pd.DataFrame({"query_id": query_ids[q], "vec_id": ids[b], "score": score})

    return run


def training_sample(rows: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The ``sample`` vectors whose ids have the smallest hashes."""
    chosen = hash_sample(rows.select("vec_id", "v"), ["vec_id"], sample, rows.count()).collect()
    return np.array([r.v for r in sorted(chosen, key=lambda r: r.vec_id)])


def nearest(table: DataFrame, is_query: Column, k: int = 10, lists: int | None = None, probe_ratio: float = PROBE_RATIO, part_rows: int = PART_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found among all other vectors."""
    rows = written(vectors(table))
    sample = training_sample(rows)
    if not len(sample):
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = build_index(sample, lists or min(MOST_LISTS, max(LEAST_LISTS, rows.count() // LIST_ROWS)))
    listed = written(rows.mapInArrow(_assign(index), "vec_id long, v array<double>, list int"))
    rows_in = np.zeros(len(index.centroids), np.int64)
    for row in listed.groupBy("list").agg(F.count("list").alias("n")).collect():
        rows_in[row.list] = row.n
    # A vector has at most COPIES copies, so that these rows hold k others at least, if there are so many.
    asked = written(rows.where(is_query).mapInArrow(_probe(index, probe_ratio, rows_in, max(COPIES * (k + 1), READ_ROWS * k)), "query_id long, q array<double>, list int"))
    # One row for each list: as many as there are centroids. Both sides of a list are cut into parts, and each meets each.
    cut = lambda side, name: side.groupBy("list").agg(F.ceil(F.count("list") / part_rows).cast("int").alias(name))
    sizes = F.broadcast(cut(listed, "parts").join(cut(asked, "query_parts"), "list"))
    numbers = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    base = listed.join(sizes, "list").select(
        "list", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"), numbers("query_parts").alias("query_part"), "vec_id", "v")
    asked = asked.join(sizes, "list").select(
        "list", numbers("parts").alias("part"), F.pmod(F.xxhash64("query_id"), "query_parts").cast("int").alias("query_part"), "query_id", "q")
    keys = ["list", "part", "query_part"]
    found = base.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(_search_part(k), "query_id long, vec_id long, score double").distinct()
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
