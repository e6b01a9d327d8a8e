"""Repeated byte strings across all documents, by a hash-compared suffix sort.

A byte goes if a string of ``length`` bytes that covers it also starts earlier (in a document
of smaller id, or earlier in the same one). Equal strings have the same content-chosen anchor
at the same offset, so the work goes by anchors instead of by every byte:

1. Each text gives its anchors with a hash of the anchor's gram and a hash of all the bytes that
   the anchor's windows cover. Repeats inside one slice of texts are resolved there.
2. Anchors are sorted by (gram, context) over range partitions. All but the first of equal contexts
   are repeats; grams with several contexts are where a shared passage begins, ends or is edited.
3. Only the contexts of those anchors are compared by their bytes: the windows of the contexts
   of one gram are sorted as suffixes, by a mergesort that finds common prefixes with prefix hashes and binary
   search, and equal ones are verified on the bytes.

Grams with more contexts than ``HOT_CONTEXTS``, or at the edge of a range partition, are dealt by
their windows instead, after each slice has reduced equal windows to one; so no key is hot.

A null text counts as empty; a null ``doc_id`` comes before all others. Rows of one ``doc_id`` (or
none) with different texts are documents of their own, in the order of a hash of their texts. Rows that repeat both
are one document: the same place in them is not a repeat of itself, and what goes from one goes from the other.
Texts shorter than ``length`` bytes lose nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.llm.common import binary_array, free_names, text_buffer, text_slices, with_document_keys, written
from tablewise.llm.suffixes import PrefixHash, anchors, hash_sort, merged_spans

LENGTH = 100
GRAM = 32
#: Under 4 MB of text at once, so that the tables of powers stay at that size.
SLICE = 3 * 1024 * 1024
HOT_CONTEXTS = 2_000
ANCHOR, SPAN, CONTEXT, HOT = 0, 1, 2, 3
#: ``doc`` and ``row`` are a row's two keys; together they name a document and give its place in the order.
ROW = "kind int, a long, b long, doc long, row long, c long"
_NAMES = ["kind", "a", "b", "doc", "row", "c"]
KEYS = np.dtype([("doc", np.int64), ("row", np.int64)])


def _keys(doc: pa.Array, row: pa.Array) -> np.ndarray:
    keys = np.empty(len(doc), KEYS)
    keys["doc"], keys["row"] = doc.to_numpy(), row.to_numpy()
    return keys


def _batch(kind, a, b, doc, c) -> pa.RecordBatch:
    signed = lambda x: pa.array(np.ascontiguousarray(x).astype(np.uint64).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), signed(a), signed(b), signed(doc["doc"]), signed(doc["row"]), signed(c)], _NAMES)


def _spans(docs, starts, ends) -> pa.RecordBatch:
    """Merged spans of each document."""
    order = np.lexsort((docs["row"], docs["doc"]))
    docs, starts, ends = docs[order], starts[order], ends[order]
    cuts = np.append(np.flatnonzero(np.append(True, docs[1:] != docs[:-1])), len(docs)) if len(docs) else np.zeros(1, int)
    found = [merged_spans(starts[i:j], ends[i:j]) for i, j in zip(cuts[:-1], cuts[1:])]
    if not found:
        none = np.zeros(0, np.int64)
        return _batch(SPAN, none, none, np.zeros(0, KEYS), none)
    return _batch(
        SPAN, np.concatenate([s for s, _ in found]), np.concatenate([e for _, e in found]),
        np.repeat(docs[cuts[:-1]], [len(s) for s, _ in found]), np.zeros(sum(len(s) for s, _ in found), np.int64))


def _later(order, same, docs, places):
    """Of equal neighbours in ``order``: which come after the first place of their group."""
    group = np.cumsum(~same) - 1
    first = order[np.flatnonzero(~same)][group]
    return (docs[order] != docs[first]) | (places[order] != places[first])


def _blocks(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Stretches of at most about two slices: (begin, end, text bounds in it); long texts in overlapping parts."""
    if len(data) <= 2 * SLICE:
        yield 0, len(data), offsets
        return
    for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        for start in range(begin, max(begin + 1, end - length + 1), SLICE):
            stop = min(start + SLICE + length - 1, end)
            yield start, stop, np.array([0, stop - start])


def _find_anchors(length: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for part in text_slices(batches, limit=SLICE):
            data, offsets = text_buffer(part.column(2))
            keys = _keys(part.column(0), part.column(1))
            rows = []
            for begin, end, bounds in _blocks(data, offsets, length):
                block = data[begin:end]
                hashes = PrefixHash(block)
                place, low, high, ha = anchors(hashes, bounds[1:], bounds[:-1], length, gram)
                raw = memoryview(np.ascontiguousarray(block))
                stops = high + length
                hc = np.fromiter((xxhash.xxh3_64_intdigest(raw[i:j]) for i, j in zip(low.tolist(), stops.tolist())), np.uint64, len(low))
                owner = np.searchsorted(offsets, begin + low, "right") - 1
                base = begin - offsets[owner]
                rows.append((keys[owner], ha, hc ^ (place - low).astype(np.uint64), base + place, base + low, base + high))
            doc, ha, hc, place, low, high = (np.concatenate(x) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 6
            if not len(doc):
                continue
            order = np.lexsort((place, doc["row"], doc["doc"], hc, ha))
            same = np.zeros(len(order), bool)
            same[1:] = (ha[order][1:] == ha[order][:-1]) & (hc[order][1:] == hc[order][:-1])
            later = same & _later(order, same, doc, low)
            gone = order[later]
            yield _spans(doc[gone], low[gone], high[gone] + length)
            kept = order[~same]
            several = np.zeros(len(kept), bool)
            several[1:] = ha[kept][1:] == ha[kept][:-1]
            several[:-1] |= several[1:]
            packed = place[kept] << 20 | (place - low)[kept] << 10 | (high - low)[kept]
            yield _batch(ANCHOR, ha[kept], hc[kept], doc[kept], packed << 1 | several)

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in blocks that end where the first column changes; the last block is the last group."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        change = np.flatnonzero(key[1:] != key[:-1])
        if rest and rest[-1].column(0)[-1].as_py() != key[0]:
            yield pa.concat_batches(rest)
            rest = []
        if len(change):
            cut = int(change[-1]) + 1
            yield pa.concat_batches([*rest, batch.slice(0, cut)])
            rest = [batch.slice(cut)]
        else:
            rest.append(batch)
    if rest:
        yield pa.concat_batches(rest)


def _compare_contexts(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (a, b, doc, row, c) of a range partition, sorted: repeats of a context, and contexts that share a gram."""

    def judged(block, edge):
        a, b, c = (block.column(i).to_numpy() for i in (0, 1, 4))
        doc = _keys(block.column(2), block.column(3))
        c, several = c >> 1, (c & 1).astype(bool)
        place, low, high = c >> 20, (c >> 20) - (c >> 10 & 1023), (c >> 20) - (c >> 10 & 1023) + (c & 1023)
        same = np.zeros(len(a), bool)
        same[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        later = same & _later(np.arange(len(a)), same, doc, place)
        yield _spans(doc[later], low[later], high[later] + length)
        fresh = np.append(True, a[1:] != a[:-1])
        group = np.cumsum(fresh) - 1
        contexts = np.bincount(group, weights=~same)
        shared = (contexts > 1) | np.maximum.reduceat(several, np.flatnonzero(fresh))
        hot = contexts > HOT_CONTEXTS
        # A group at the partition's edge may go on in the next partition, so that all of it is dealt by windows.
        for place_ in edge:
            hot[place_] = shared[place_] = True
        for kind, groups in ((CONTEXT, shared & ~hot), (HOT, shared & hot)):
            chosen = groups[group] & ~same
            yield _batch(kind, low[chosen], high[chosen], doc[chosen], a[chosen])

    def run(batches):
        before = None
        for number, block in enumerate(_grouped(batches)):
            if before is not None:
                yield from judged(before, [0] if number == 1 else [])
            before = block
        if before is not None:
            yield from judged(before, [0, -1])

    return run


def _gathered(data: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> pa.Array:
    bounds = np.append(0, np.cumsum(sizes))
    packed = data[np.repeat(begin - bounds[:-1], sizes) + np.arange(bounds[-1])]
    return binary_array(packed, bounds).cast(pa.binary())


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in the third column as compressed bytes, which take less room in shuffles and tables."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = pa.array([squeeze((t or "").encode()) for t in batch.column(2).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], texts], ["_k1", "_k2", "packed"])


def _unpacked(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices, with the bytes of their texts in place of the packed ones."""
    open_ = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        texts, held, start = [], 0, 0
        for row, packed in enumerate(batch.column(column).to_pylist(), 1):
            texts.append(open_(packed))
            held += len(texts[-1])
            if held >= SLICE or row == batch.num_rows:
                part = batch.slice(start, row - start)
                yield part.set_column(column, "text", pa.array(texts, pa.large_binary()))
                texts, held, start = [], 0, row


def _read_contexts(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (_k1, _k2, packed, marks): the bytes of the marked contexts, of hot ones those of each distinct window."""

    def rows_of(part, data, offsets):
        marks = part.column(3)
        owner = np.repeat(np.arange(len(part)), np.diff(marks.offsets.to_numpy()))
        kind, low, high, key = (marks.flatten().field(i).to_numpy() for i in range(4))
        keys = _keys(part.column(0), part.column(1))
        at = np.flatnonzero(kind == CONTEXT)
        yield _with_data(_batch(CONTEXT, low[at], high[at], keys[owner[at]], key[at]), _gathered(data, offsets[owner[at]] + low[at], high[at] - low[at] + length))
        at = np.flatnonzero(kind == HOT)
        sizes = high[at] - low[at] + 1
        places = np.unique(np.repeat(offsets[owner[at]] + low[at] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum()))
        if not len(places):
            return
        text = np.searchsorted(offsets, places, "right") - 1
        doc, local = keys[text], places - offsets[text]
        later, first = _repeated(data, places, doc, local, length)
        yield _with_data(_spans(doc[later], local[later], local[later] + length), None)
        raw = memoryview(np.ascontiguousarray(data))
        hashed = np.fromiter((xxhash.xxh3_64_intdigest(raw[p : p + length]) for p in places[first].tolist()), np.uint64, len(first))
        yield _with_data(_batch(CONTEXT, local[first], local[first], doc[first], hashed), _gathered(data, places[first], np.full(len(first), length)))

    def run(batches):
        for part in _unpacked(batches, 2):
            yield from rows_of(part, *text_buffer(part.column(2)))

    return run


def _with_data(rows: pa.RecordBatch, data: pa.Array | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*rows.columns, pa.nulls(len(rows), pa.binary()) if data is None else data], [*_NAMES, "data"])


def _repeated(data, places, doc, local, length) -> tuple[np.ndarray, np.ndarray]:
    """Of windows at ``places``: which come after an equal one, and the first of each distinct one."""
    ranked = np.lexsort((local, doc["row"], doc["doc"]))
    order, same = hash_sort(PrefixHash(data), places[ranked], length)
    order = ranked[order]
    later = same & _later(order, same, doc, local)
    return order[later], order[~same]


def _compare_windows(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (c, doc, row, a, data) sorted by c: windows that also start earlier in a context of the same key."""

    def run(batches):
        for block in _grouped(batches):
            data, offsets = text_buffer(block.column(4))
            doc, start, sizes = _keys(block.column(1), block.column(2)), block.column(3).to_numpy(), np.diff(offsets) - length + 1
            row = np.repeat(np.arange(len(block)), sizes)
            within = np.arange(sizes.sum()) - np.repeat(np.append(0, np.cumsum(sizes)[:-1]), sizes)
            docs, local = doc[row], start[row] + within
            later, _ = _repeated(data, offsets[row] + within, docs, local, length)
            yield _spans(docs[later], local[later], local[later] + length)

    return run


def repeated_spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Of rows (_k1, _k2, text) those that hold repeats: ``_k1``, ``_k2``, ``packed`` (the text, compressed) and ``spans`` (in bytes)."""
    keyed = keyed.select("_k1", "_k2", "text")
    rows = written(keyed.mapInArrow(_find_anchors(length, gram), ROW))
    found = rows.where(F.col("kind") == ANCHOR).select("a", "b", "doc", "row", "c")
    contexts = written(found.repartitionByRange("a", "b").sortWithinPartitions("a", "b", "doc", "row", "c").mapInArrow(_compare_contexts(length), ROW))
    marks = (
        contexts.unionByName(rows.where(F.col("kind") == SPAN))
        .groupBy("doc", "row").agg(F.collect_list(F.struct("kind", "a", "b", "c")).alias("marks"))
    )
    packed = keyed.mapInArrow(_packed, "_k1 long, _k2 long, packed binary")
    own = (F.col("_k1") == F.col("doc")) & (F.col("_k2") == F.col("row"))
    flagged = written(packed.join(marks, own).select("_k1", "_k2", "packed", "marks"))
    read = written(flagged.mapInArrow(_read_contexts(length), f"{ROW}, data binary"))
    met = (
        read.where(F.col("kind") == CONTEXT).select("c", "doc", "row", "a", "data")
        .repartition("c").sortWithinPartitions("c").mapInArrow(_compare_windows(length), ROW)
    )
    more = (
        met.unionByName(read.where(F.col("kind") == SPAN).drop("data"))
        .groupBy("doc", "row").agg(F.collect_list(F.struct("kind", "a", "b", "c")).alias("more"))
    )
    spans = F.filter(F.concat("marks", F.coalesce("more", F.array())), lambda m: m["kind"] == SPAN)
    found = flagged.join(more, own, "left").select("_k1", "_k2", "packed", spans.alias("spans"))
    return found.where(F.size("spans") > 0)


def _kept_bytes(data: bytes, spans: pa.Array) -> tuple[bytes, int]:
    """The bytes outside the spans, and the number of maximal runs removed."""
    starts, ends = merged_spans(*(np.minimum(spans.field(i).to_numpy(), len(data)) for i in (1, 2)))
    starts, ends = starts[starts < ends], ends[starts < ends]
    edges = [0, *np.stack([starts, ends], 1).ravel().tolist(), len(data)]
    return b"".join(data[i:j] for i, j in zip(edges[::2], edges[1::2])), len(starts)


def _cut(frames: Iterator[pa.RecordBatch], keep_text: bool) -> Iterator[pa.RecordBatch]:
    for part in _unpacked(frames, 2):
        removed, counts, kept, texts = [], [], [], []
        for data, spans in zip(part.column(2).to_pylist(), part.column(3)):
            left, number = _kept_bytes(data, spans.values)
            removed.append(len(data) - len(left))
            counts.append(number)
            kept.append(left.decode("utf-8", "ignore") if keep_text else hashlib.sha256(left).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(kept, pa.string())],
            ["_k1", "_k2", "n_removed", "n_spans", "kept"])


def cut_texts(keyed: DataFrame, length: int = LENGTH, keep_text: bool = True) -> DataFrame:
    """Of rows (_k1, _k2, text): ``_k1``, ``_k2``, ``n_removed``, ``n_spans`` and ``kept`` (text, or its digest) of documents with repeats.

    A character of which a byte goes is left out of the kept text; the digest is of the bytes.
    """
    cut = repeated_spans(keyed, length).mapInArrow(
        lambda batches: _cut(batches, keep_text), "_k1 long, _k2 long, n_removed long, n_spans long, kept string")
    return cut.dropDuplicates(["_k1", "_k2"])


def _pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        at = batch.schema.get_field_index("text")
        texts = [None if t is None else squeeze(t.encode()) for t in batch.column(at).to_pylist()]
        yield batch.set_column(at, "text", pa.array(texts, pa.binary()))


def _cut_rows(columns: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with packed texts and, last, spans: the cut texts and whether anything was cut."""

    def run(batches):
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            at = batch.schema.get_field_index("text")
            start, held, texts, changed = 0, 0, [], []
            for row, (packed, own) in enumerate(zip(batch.column(at).to_pylist(), batch.column(columns)), 1):
                data = None if packed is None else open_(packed)
                cut = data is not None and own.is_valid
                if cut:
                    data = _kept_bytes(data, own.values)[0]
                texts.append(None if data is None else data.decode("utf-8", "ignore"))
                changed.append(cut)
                held += len(data or b"")
                if held >= SLICE or row == batch.num_rows:
                    part = batch.slice(start, row - start).set_column(at, "text", pa.array(texts, pa.string()))
                    yield pa.RecordBatch.from_arrays([*part.columns[:columns], pa.array(changed)], [*part.schema.names[:columns], batch.schema.names[columns]])
                    start, held, texts, changed = row, 0, [], []

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH, length_column: str | None = None) -> DataFrame:
    """The rows with their cut texts; a row of which nothing is left goes.

    A character of which a byte goes is left out. ``length_column`` names a column that gets the characters of cut
    texts; all others beside ``text``, of any name, stay as they are.
    """
    first, second, spans = free_names(docs.columns, "_k1", "_k2", "_spans")
    keyed = with_document_keys(docs, first, second)
    found = repeated_spans(keyed.select(F.col(first).alias("_k1"), F.col(second).alias("_k2"), "text"), length)
    found = found.select(F.col("_k1").alias(first), F.col("_k2").alias(second), F.col("spans").alias(spans)).dropDuplicates([first, second])
    schema = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == "text" else f for f in keyed.schema])
    joined = keyed.mapInArrow(_pack_rows, schema).join(found, [first, second], "left").select(*docs.columns, spans)
    cut = joined.mapInArrow(_cut_rows(len(docs.columns)), T.StructType([*docs.schema, T.StructField(spans, T.BooleanType())]))
    cut = cut.where(~F.col(spans) | (F.col("text") != ""))
    if length_column:
        counted = F.when(F.col(spans), F.length("text").cast(docs.schema[length_column].dataType)).otherwise(F.col(length_column))
        cut = cut.withColumn(length_column, counted)
    return cut.select(docs.columns)


def repeat_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document what was removed and the digest of the bytes that stay."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = with_document_keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    every = keyed.select("doc_id", "_k1", "_k2", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("_whole"))
    cut = cut_texts(keyed.select("_k1", "_k2", "text"), length, keep_text=False)
    return every.join(cut, ["_k1", "_k2"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept", "_whole").alias("kept_sha256"))
