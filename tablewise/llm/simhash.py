"""Near copies by SimHash: exact comparison of fingerprint tiles.

Distinct fingerprints are put in cells by the population counts of their parts. Two
fingerprints within the radius have counts whose differences sum to the radius at most, so
that only cells that near each other are compared; cells are cut into tiles of a bounded
size, and a pair of tiles is compared with numpy's exclusive-or and bit counts. A pair of tiles
gives the edges of a spanning forest of its links, never all pairs, and links are followed
over all tiles by ``components``.

Near copies (``without_near_copies``) are distinct texts whose sets of shingles have a Jaccard
similarity of ``least``. Fingerprints of the sets only propose them: the groups that they link are cut into
tiles again, which hold the sets, and each link is computed exactly before it counts. Sets whose sizes differ by more than
``least`` can't be that similar, so that their cells are ranges of sizes and only cells that near each other are compared.

A null or empty text has fingerprint zero and is linked like any other. Repeated rows share
their fingerprint. A null ``doc_id`` takes part but never names a component that has an id.
"""

from __future__ import annotations

import itertools
import math
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import free_names, row_key, text_slices, written
from tablewise.llm.components import components
from tablewise.operators.joins import spread

SEED = 42
TILE = 4096
#: Fingerprints in one tile of a range of sizes, and ranges between a size and the least one that it can be similar to.
SIZE_TILE, SIZE_STEPS = 16_384, 4
BLOCK_HASHES = 1 << 16
BLOCK_PAIRS = 1 << 20
#: Text whose sets of shingles are made at once; they take many times its bytes.
SET_SLICE = 2 * 1024 * 1024
#: Sets of shingles in one tile, and what a set counts besides its hashes, so that a tile has few thousand of them.
SET_BYTES, SET_EXTRA = 4 * 1024 * 1024, 1024


def _shingles(tokens: list[bytes], words: int) -> Iterator[list[bytes]]:
    """All shingles in blocks; a text of fewer words is one shingle."""
    count = max(1, len(tokens) - words + 1)
    for start in range(0, count, BLOCK_HASHES):
        stop = min(start + BLOCK_HASHES, count)
        if len(tokens) < words:
            yield [b" ".join(tokens)]
        else:
            yield [b" ".join(s) for s in zip(*(itertools.islice(tokens, start + i, stop + i) for i in range(words)))]


def signature(text: str | None, words: int, lanes: int = 1) -> np.ndarray:
    """Majority bits of the hashes of all shingles, for as many hash seeds as there are lanes."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(lanes, np.uint64)
    count = max(1, len(tokens) - words + 1)
    ones = np.zeros((lanes, 64), np.int64)
    for joined in _shingles(tokens, words):
        for lane in range(lanes):
            hashes = array("Q", [xxhash.xxh64_intdigest(s, SEED + lane) for s in joined])
            ones[lane] += np.unpackbits(np.frombuffer(hashes, np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > count, axis=1, bitorder="little").view("<u8")[:, 0]


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; none for a text without words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    line, count = b" ".join(tokens), max(1, len(tokens) - words + 1)
    stops = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts, stops, found = np.append(0, stops[:-1] + 1)[:count], stops[-count:], []
    for start in range(0, count, BLOCK_HASHES):
        # Each shingle is a piece of the line of all words.
        pieces = map(slice, starts[start : start + BLOCK_HASHES].tolist(), stops[start : start + BLOCK_HASHES].tolist())
        hashes = map(xxhash.xxh64_intdigest, map(line.__getitem__, pieces), itertools.repeat(SEED))
        found.append(np.fromiter(hashes, np.uint64, min(BLOCK_HASHES, count - start)))
    ordered = np.sort(np.concatenate(found))
    return ordered[np.append(True, ordered[1:] != ordered[:-1])]


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of each row's hashes have each of the 64 bits; bytes of up to 255 hashes are summed eight at a time."""
    lanes, count = hashes.shape
    packed = np.unpackbits(hashes.astype("<u8").view(np.uint8), axis=1, bitorder="little").view(np.uint64).reshape(lanes, count, 8)
    whole = count // 255 * 255
    sums = packed[:, :whole].reshape(lanes, -1, 255, 8).sum(2, dtype=np.uint64)
    sums = np.concatenate([sums, packed[:, whole:].sum(1, dtype=np.uint64, keepdims=True)], 1)
    return sums.view(np.uint8).reshape(lanes, -1, 64).sum(1, dtype=np.int64)


def set_signature(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """Majority bits of a set of shingles, each counted once; further lanes mix the hashes anew."""
    ones = np.zeros((lanes, 64), np.int64)
    for start in range(0, len(hashes), BLOCK_HASHES):
        mixed = [hashes[start : start + BLOCK_HASHES]]
        for _ in range(lanes - 1):
            last = mixed[-1]
            last = (last ^ last >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x9E3779B97F4A7C15)
            last = (last ^ last >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            mixed.append(last ^ last >> np.uint64(31))
        ones += _bit_counts(np.stack(mixed))
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view("<u8")[:, 0]


def _signatures(words: int, lanes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for part in text_slices(batches):
            found = np.stack([signature(t, words, lanes) for t in part.column(part.schema.get_field_index("text")).to_pylist()]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * lanes), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], lists], ["doc_id", "_k1", "_k2", "sig"])

    return run


def signatures(docs: DataFrame, words: int = 3, lanes: int = 1) -> DataFrame:
    """(doc_id, _k1, _k2, sig, node): the fingerprint's signed 64-bit lanes and a number that names it."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(F.col("doc_id"), F.col("text")), "text")
    marked = texts.mapInArrow(_signatures(words, lanes), "doc_id long, _k1 long, _k2 long, sig array<long>")
    return marked.withColumn("node", F.col("sig")[0] if lanes == 1 else F.xxhash64("sig"))


def near_shifts(parts: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of population counts that fingerprints within the radius can have, one of each sign."""
    reach = range(-radius, radius + 1)
    return [s for s in itertools.product(reach, repeat=parts) if sum(map(abs, s)) <= radius and s >= (0,) * parts]


def joined_roots(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Roots (smallest members) after the links left-right join the groups of ``parent``."""
    left, right, step = parent[left], parent[right], np.arange(len(parent))
    while True:
        low = np.minimum(step[left], step[right])
        before = step.copy()
        np.minimum.at(step, left, low)
        np.minimum.at(step, right, low)
        step = step[step]
        if np.array_equal(before, step):
            return step[parent]


def _true_places(found: np.ndarray) -> np.ndarray:
    """``flatnonzero`` of rare hits: eight places at once, and then those of the eights that have one."""
    whole = len(found) // 8 * 8
    eights = np.flatnonzero(found[:whole].view(np.uint64))
    hits = np.flatnonzero(found[:whole].reshape(-1, 8).take(eights, axis=0))
    return np.concatenate([eights.take(hits >> 3) * 8 + (hits & 7), np.flatnonzero(found[whole:]) + whole])


def tile_links(a: np.ndarray, b: np.ndarray, radius: int, same: bool, whole: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places in the two tiles (b's after a's) and the roots that they are linked to, without the roots themselves.

    Tiles are arrays of (fingerprint, lane). The first lanes have to be within ``radius``
    and all lanes together within ``whole``.
    """
    a, b = a.view(np.uint64), b.view(np.uint64)  # numpy counts the bits of a signed number's absolute value
    parent, shift = np.arange(len(a) + (0 if same else len(b))), 0 if same else len(a)
    rows, own, other = max(1, BLOCK_PAIRS // max(1, len(b))), np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    for start in range(0, len(a), rows):
        differ = np.bitwise_count(own[0, start : start + rows, None] ^ other[0]).ravel()
        near = _true_places(differ <= radius)
        total = differ[near].astype(np.int64)
        # A pair is dropped as soon as the lanes so far differ too much; few reach the last one.
        for lane in range(1, 0 if whole is None else len(own)):
            i, j = np.divmod(near, len(b))
            total += np.bitwise_count(own[lane].take(i + start) ^ other[lane].take(j))
            near, total = near[total <= whole], total[total <= whole]
        if whole is not None:
            near = near[total <= whole]
        i, j = np.divmod(near, max(1, len(b)))
        i += start
        keep = i != j + shift
        if keep.any():
            parent = joined_roots(parent, i[keep], j[keep] + shift)
    moved = np.flatnonzero(parent != np.arange(len(parent)))
    return moved, parent[moved]


def _compare(radius: int, whole: int | None, lanes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in batches:
            members, roots = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            numbers = lambda column: [np.ascontiguousarray(x.values.to_numpy()) for x in batch.column(column)]
            for a, b, x, y, same in zip(numbers(0), numbers(1), numbers(2), numbers(3), batch.column(4).to_pylist()):
                member, root = tile_links(a.reshape(-1, lanes), b.reshape(-1, lanes), radius, same, whole)
                names = x if same else np.concatenate([x, y])
                members.append(names[member])
                roots.append(names[root])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(members)), pa.array(np.concatenate(roots))], ["a", "b"])

    return run


def links(prints: DataFrame, radius: int = 3, parts: int = 4, tile: int = TILE, lanes: int = 1, whole: int | None = None) -> DataFrame:
    """Edges (a, b) that join all distinct fingerprints (``node``, ``sig``) that are near each other."""
    width = 64 // parts
    word = F.col("sig")[0]
    counts = [
        F.bit_count(F.shiftrightunsigned(word, width * i).bitwiseAND(F.lit((1 << width) - 1 if parts > 1 else -1))).cast("int") for i in range(parts)
    ]
    celled = prints.select("node", "sig", F.array(*counts).alias("cell"))
    # At most (width + 1) ** parts cells: 83,521 for four parts.
    sizes = celled.groupBy("cell").agg(F.ceil(F.count("node") / tile).alias("tiles"))
    tiles = written(
        celled.join(F.broadcast(sizes), "cell")
        .groupBy("cell", F.pmod(F.xxhash64("node"), "tiles").alias("tile")).agg(F.collect_list(F.struct("node", "sig")).alias("all"))
        .select("cell", "tile", F.flatten("all.sig").alias("sigs"), F.col("all.node").alias("nodes"))
    )
    shifts = F.array(*[F.array(*[F.lit(x) for x in s]) for s in near_shifts(parts, radius)])
    near = tiles.select(
        F.col("cell").alias("own"), F.col("tile").alias("own_tile"), F.col("sigs").alias("own_sigs"), F.col("nodes").alias("own_nodes"), F.explode(shifts).alias("shift")
    ).withColumn("cell", F.zip_with("own", "shift", lambda x, y: x + y)).drop("shift")
    pairs = near.join(tiles, "cell").where((F.col("own") != F.col("cell")) | (F.col("own_tile") <= F.col("tile")))
    same = (F.col("own") == F.col("cell")) & (F.col("own_tile") == F.col("tile"))
    return pairs.select("own_sigs", "sigs", "own_nodes", "nodes", same.alias("same")).mapInArrow(_compare(radius, whole, lanes), "a long, b long")


def _compare_tiles(radius: int, whole: int, lanes: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows):
        tiles = sorted(zip(rows["side"].to_pylist(), rows["sigs"], rows["nodes"]), key=lambda tile: tile[0])
        names = [np.ascontiguousarray(tile[2].values.to_numpy()) for tile in tiles]
        sigs = [np.ascontiguousarray(tile[1].values.to_numpy()).reshape(-1, lanes) for tile in tiles]
        member, root = tile_links(sigs[0], sigs[-1], radius, len(tiles) == 1, whole)
        every = np.concatenate(names)
        return pa.table({"a": every[member], "b": every[root]})

    return run


def size_links(prints: DataFrame, radius: int, whole: int, lanes: int, least: float, tile: int = SIZE_TILE) -> DataFrame:
    """Edges (a, b) that join all fingerprints (``node``, ``sig``, ``size``) within both radii whose sizes differ by ``least`` at most.

    Further pairs within the radii may be joined. Each pair of tiles is a group of its own.
    """
    width = max(math.log(1 / least), 1e-6) / SIZE_STEPS * (1 + 1e-9)
    celled = prints.select("node", "sig", F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / width).alias("cell"))
    sizes = celled.groupBy("cell").agg(F.ceil(F.count("node") / tile).alias("tiles"))
    tiles = written(
        celled.join(F.broadcast(sizes), "cell")
        .groupBy("cell", F.pmod(F.xxhash64("node"), "tiles").alias("tile")).agg(F.collect_list(F.struct("node", "sig")).alias("all"))
        .select("cell", "tile", F.flatten("all.sig").alias("sigs"), F.col("all.node").alias("nodes"))
    )
    named = tiles.select("cell", "tile")
    later = named.select(F.col("cell").alias("later_cell"), F.col("tile").alias("later_tile"))
    near = named.withColumn("later_cell", F.explode(F.sequence(F.col("cell"), F.col("cell") + SIZE_STEPS))).join(later, "later_cell")
    pairs = written(near.where((F.col("cell") < F.col("later_cell")) | (F.col("tile") <= F.col("later_tile"))))
    key = ["cell", "tile", "later_cell", "later_tile"]
    left = tiles.join(pairs, ["cell", "tile"]).select(*key, F.lit(0).alias("side"), "sigs", "nodes")
    apart = pairs.where((F.col("cell") != F.col("later_cell")) | (F.col("tile") != F.col("later_tile")))
    right = tiles.withColumnsRenamed({"cell": "later_cell", "tile": "later_tile"}).join(apart, ["later_cell", "later_tile"]).select(
        *key, F.lit(1).alias("side"), "sigs", "nodes")
    return spread(left.unionByName(right), *key).groupBy(*key).applyInArrow(_compare_tiles(radius, whole, lanes), "a long, b long")


def linked_documents(
    docs: DataFrame, words: int = 3, radius: int = 3, parts: int = 4, tile: int = TILE, lanes: int = 1, whole: int | None = None
) -> DataFrame:
    """Per document: doc_id, _k1, _k2, sig, component_id (the smallest ``doc_id`` reachable over links) and keeper, that document's _k1 and _k2."""
    marked = written(signatures(docs, words, lanes))
    least = F.min(F.struct("_k1", "_k2"))
    prints = written(marked.groupBy("node").agg(F.first("sig").alias("sig"), F.min("doc_id").alias("first_id"), least.alias("first_row")))
    roots = components(links(prints.select("node", "sig"), radius, parts, tile, lanes, whole))
    named = prints.select(F.col("node").alias("_node"), "first_id", "first_row")
    grouped = named.join(roots, F.col("_node") == F.col("node")).groupBy("root").agg(F.min("first_id").alias("least_id"), F.min("first_row").alias("least_row"))
    linked = roots.join(written(grouped), "root").select("node", "least_id", "least_row")
    every = written(named.join(linked, F.col("_node") == F.col("node"), "left").select(
        "_node", F.coalesce("least_id", "first_id").alias("component_id"), F.coalesce("least_row", "first_row").alias("keeper")))
    return marked.join(every, F.col("node") == F.col("_node")).drop("_node", "node")


def _set_signatures(words: int, lanes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for part in text_slices(batches, limit=SET_SLICE):
            sets = [shingle_set(t, words) for t in part.column(3).to_pylist()]
            found = np.stack([set_signature(s, lanes) for s in sets]).view(np.int64)
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * lanes), pa.array(found.ravel()))
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns[:3], lists, pa.array(nodes), sizes], ["doc_id", "_k1", "_k2", "sig", "node", "size"])

    return run


def _sets(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for part in text_slices(batches, limit=SET_SLICE):
            sets = [shingle_set(t, words).tobytes() for t in part.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sets, pa.binary())], ["node", "root", "sig", "shingles"])

    return run


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of two sorted sets; two empty sets are equal."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return float(len(b) == 0)
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return common / (len(a) + len(b) - common)


def similar_links(sides: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray], radius: int, whole: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places and the roots that pairs within both radii whose similarity is ``least`` link them to, without the roots themselves.

    Where two ``sides`` are given, only pairs of both are compared. A pair that other pairs have linked already isn't computed.
    """
    sigs, sizes, group = sigs.view(np.uint64), np.array([len(s) for s in sets], np.int64), np.arange(len(sets))
    cross = len(set(sides.tolist())) > 1
    for i in range(1, len(sets)):
        small, large = np.minimum(sizes[:i], sizes[i]), np.maximum(sizes[:i], sizes[i])
        fits = (group[:i] != group[i]) & (small >= least * large - 1)
        if cross:
            fits &= sides[:i] != sides[i]
        places = np.flatnonzero(fits)
        differ = np.bitwise_count(sigs[places] ^ sigs[i])
        near = places[(differ[:, 0] <= radius) & (differ.sum(1) <= whole)]
        while len(near):
            j, near = near[0], near[1:]
            if jaccard(sets[i], sets[j]) >= least:
                low, high = sorted((group[i], group[j]))
                group[group == high] = low
                near = near[group[near] != group[i]]
    moved = np.flatnonzero(group != np.arange(len(group)))
    return moved, group[moved]


def _compare_sets(radius: int, whole: int, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in batches:
            for rows in batch.column(0):
                sides, nodes, sigs, sets = (rows.values.field(i) for i in range(4))
                nodes, lists = nodes.to_numpy(), np.array(sigs.to_pylist(), np.int64)
                member, root = similar_links(sides.to_numpy(), lists, [np.frombuffer(s.as_buffer(), np.uint64) for s in sets], radius, whole, least)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[member]), pa.array(nodes[root])], ["a", "b"])

    return run


def similar_edges(docs: DataFrame, prints: DataFrame, words: int, radius: int, whole: int, least: float, near: DataFrame, set_bytes: int = SET_BYTES) -> DataFrame:
    """Edges (a, b) that join, within the groups ``near`` (node, root), all sets of shingles whose similarity is ``least``.

    A group of any size is cut into tiles, and a pair of tiles is compared by itself.
    """
    named = prints.select(F.col("node").alias("_node"), "sig", "first_row.*")
    rows = named.join(near, F.col("_node") == F.col("node")).select("node", "root", "sig", "_k1", "_k2")
    texts = rows.join(docs.select(*row_key(F.col("doc_id"), F.col("text")), "text"), ["_k1", "_k2"]).select("node", "root", "sig", "text")
    # Rows that repeat both id and text give their set several times.
    sets = written(texts.mapInArrow(_sets(words), "node long, root long, sig array<long>, shingles binary").dropDuplicates(["node"]))
    sizes = sets.groupBy("root").agg(F.ceil(F.sum(F.octet_length("shingles") + SET_EXTRA) / set_bytes).alias("tiles"))
    own = F.pmod(F.xxhash64("node"), "tiles")
    dealt = sets.join(sizes, "root").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    pairs = dealt.groupBy("root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    return pairs.agg(F.collect_list(F.struct("own", "node", "sig", "shingles")).alias("all")).select("all").mapInArrow(_compare_sets(radius, whole, least), "a long, b long")


def without_near_copies(
    docs: DataFrame, words: int, radius: int, whole: int, lanes: int = 1, least: float = 0.8, set_bytes: int = SET_BYTES, tile: int = SIZE_TILE
) -> DataFrame:
    """One row of each group of near copies (that of the smallest ``doc_id``), with its columns as they are.

    Texts are linked where their sets of shingles have a Jaccard similarity of ``least``.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(F.col("doc_id"), F.col("text")), "text")
    marked = written(texts.mapInArrow(_set_signatures(words, lanes), "doc_id long, _k1 long, _k2 long, sig array<long>, node long, size long"))
    prints = written(marked.groupBy("node").agg(F.first("sig").alias("sig"), F.first("size").alias("size"), F.min(F.struct("_k1", "_k2")).alias("first_row")))
    near = components(size_links(prints.select("node", "sig", "size"), radius, whole, lanes, least, tile))
    roots = components(similar_edges(docs, prints, words, radius, whole, least, near, set_bytes))
    named = prints.select(F.col("node").alias("_node"), "first_row").join(roots, F.col("_node") == F.col("node"), "left")
    kept = named.groupBy(F.coalesce("root", "_node").alias("root")).agg(F.min("first_row").alias("keeper"))
    first, second = free_names(docs.columns, "_k1", "_k2")
    kept = kept.select(F.col("keeper._k1").alias(first), F.col("keeper._k2").alias(second))
    keyed = docs.withColumns(dict(zip((first, second), row_key(F.col("doc_id"), F.col("text")))))
    return keyed.join(kept, [first, second]).dropDuplicates([first, second]).select(docs.columns)


def component_report(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """``linked_documents`` with the fingerprint as 16 hexadecimal digits."""
    return linked_documents(docs, words, radius).select(
        "doc_id", F.lower(F.lpad(F.hex(F.col("sig")[0]), 16, "0")).alias("fingerprint"), "component_id")
