"""Tokens of two tokenizers aligned by their byte offsets, with corpus-wide counts of the linked ids.

A is a byte-level tokenizer file, B a piece model; both encode a blank and the text. Where tokens of both end at the
same byte a group ends, and the two tokens that end there are linked. Counting goes by spilled runs:

1. Each slice of texts gives the records of its documents (document, pair, links) and, for each radix of
   the B id, one zstd run of its distinct pairs with their links, in side-major order (by B, then by A). Runs and
   records are written as a table.
2. Runs are dealt to tasks by (radix, batch of slices), merged there by a heap over their blocks, and the sums
   of the batches are added up. In side-major order the pairs of a B id follow each other, so that one pass over
   a radix has every pair's count and the highest of its B id.
3. The counts go back to the same batches beside the runs, each run gets those of its pairs, and they meet
   the records of their slice, which sum them up for each document.

A pair that every document holds is one entry in a slice's run, so that no key is hot; a task holds the runs
of ``BATCH`` slices and the distinct pairs of one radix.

Null and empty texts, and texts that one of the tokenizers doesn't give back byte for byte, have no tokens.
Each row is a document of its own, also those that repeat an id; a null ``doc_id`` stays null. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import binary_array, text_buffer, text_slices, written
from tablewise.llm.pretokens import Encoder, file_encoder

SLICE = 3 * 1024 * 1024
RADIXES = 64
BATCH = 128
#: Entries of a run that are merged at once.
BLOCK = 4_096
#: Distinct pre-tokens of each tokenizer whose ids are kept.
ENTRIES = 200_000
DOCS, COUNTS = -1, -1
SPILLED = "slice long, radix int, ints binary, records binary, digests array<string>"
REPORT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def pack(*arrays: np.ndarray) -> bytes:
    """Whole-number arrays of one length, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(np.stack([np.asarray(a, "<i8") for a in arrays]).tobytes())


def unpack(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i8").reshape(count, -1)


def byte_level_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves."""
    itself = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    others = [b for b in range(256) if b not in itself]
    return {chr(b): b for b in itself} | {chr(256 + i): b for i, b in enumerate(others)}


def _table(entries: Sequence[bytes | None]) -> pa.Array:
    return pa.array(entries, pa.large_binary())


@lru_cache(maxsize=2)
def file_token_bytes(path: str) -> pa.Array:
    """The bytes of each id of a byte-level tokenizer file."""
    alphabet = byte_level_alphabet()
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    entries: list[bytes | None] = [None] * (max(vocabulary.values()) + 1)
    for piece, number in vocabulary.items():
        entries[number] = bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else piece.encode()
    return _table(entries)


@lru_cache(maxsize=2)
def _piece_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def piece_token_bytes(path: str) -> pa.Array:
    """The bytes of each id of a piece model: a blank for U+2581, the byte itself for a byte's piece."""
    model = _piece_model(path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return _table([bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])


@lru_cache(maxsize=2)
def piece_encoder(path: str, entries: int = ENTRIES) -> Encoder:
    """Encodes words, each without the blank before it, which the model adds by itself."""
    model = _piece_model(path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any("▁" in p.lstrip("▁") for p in pieces):
        raise ValueError("pieces that go on after a blank don't allow words to be encoded apart")
    blank = [model.piece_to_id("▁")]

    def encode(words: list[bytes]) -> list[list[int]]:
        return [ids or blank for ids in model.encode([w.decode() for w in words], num_threads=1)]

    return Encoder(encode, entries)


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where words begin: at the first of each run of blanks."""
    starts = data == 0x20
    starts[1:] &= data[:-1] != 0x20
    starts[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(starts)


def encode_words(encoder: Encoder, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts that begin with a blank, and where each text begins in them."""
    starts = word_starts(data, offsets)
    kept = np.ones(len(data), bool)
    kept[starts] = False  # a word's first blank
    shorter = starts - np.arange(len(starts))
    # A lone blank leaves an empty word, so that words are cut here and not by their places alone.
    words = binary_array(data[kept], np.append(shorter, len(data) - len(starts)))
    return encoder.encoded(words, np.searchsorted(starts, offsets))


def _joined(table: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the ids, and where each ends."""
    if not len(ids):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    placed = table.take(pa.array(ids.astype(np.int64)))
    _, cuts, raw = placed.buffers()
    ends = np.frombuffer(cuts, np.int64)[placed.offset : placed.offset + len(placed) + 1]
    return np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]], ends[1:] - ends[0]


def _given_back(data: np.ndarray, offsets: np.ndarray, joined: np.ndarray, ends: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Whether each text is what its tokens join to."""
    if len(joined) == len(data) and np.array_equal(joined, data):
        bounds = np.append(0, ends)[cuts]
        return bounds[1:] - bounds[:-1] == np.diff(offsets)
    bounds, text, own = np.append(0, ends)[cuts], memoryview(np.ascontiguousarray(data)), memoryview(np.ascontiguousarray(joined))
    return np.array([text[a:b] == own[c:d] for a, b, c, d in zip(offsets[:-1], offsets[1:], bounds[:-1], bounds[1:])], bool)


@lru_cache(maxsize=1)
def _id_texts(a_size: int, b_size: int) -> pa.Array:
    """Decimal ids with what follows each: A inside and at the end of a group, B inside, at the end, and at the text's end."""
    return _table([f"{i}{sign}".encode() for size, sign in ((a_size, ","), (a_size, "|"), (b_size, ","), (b_size, ";"), (b_size, "")) for i in range(size)])


class Aligner:
    """Aligned tokens of texts that begin with a blank."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = file_encoder(path_a, False, ENTRIES), piece_encoder(path_b)
        self.a_bytes, self.b_bytes = file_token_bytes(path_a), piece_token_bytes(path_b)
        self.texts = _id_texts(len(self.a_bytes), len(self.b_bytes))

    def align(self, data: np.ndarray, offsets: np.ndarray):
        """Per text: whether it has tokens, tokens of A, of B, groups, the groups' bytes; and (text, A id, B id) of the links."""
        a, a_cuts = self.a.ids(data, offsets)
        b, b_cuts = encode_words(self.b, data, offsets)
        good = _given_back(data, offsets, *_joined(self.a_bytes, a), a_cuts) & _given_back(data, offsets, *_joined(self.b_bytes, b), b_cuts)
        n_a, n_b = np.where(good, np.diff(a_cuts), 0), np.where(good, np.diff(b_cuts), 0)
        if not good.all():
            a, b = a[np.repeat(good, np.diff(a_cuts))], b[np.repeat(good, np.diff(b_cuts))]
        a_cuts, b_cuts = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
        a_ends, b_ends = _joined(self.a_bytes, a)[1], _joined(self.b_bytes, b)[1]
        both = np.zeros((2, int(np.diff(offsets)[good].sum()) + 1), bool)
        both[0, a_ends] = both[1, b_ends] = True
        a_last, b_last = both[1, a_ends], both[0, b_ends]
        a_at, b_at = np.flatnonzero(a_last), np.flatnonzero(b_last)
        owner = np.searchsorted(a_cuts, a_at, "right") - 1
        return good, n_a, n_b, np.bincount(owner, minlength=len(good)), self._texts(a, b, a_last, b_last, a_cuts, b_cuts), (owner, a[a_at].astype(np.int64), b[b_at].astype(np.int64))

    def _texts(self, a, b, a_last, b_last, a_cuts, b_cuts) -> list[memoryview]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        if not len(a):
            return [memoryview(b"")] * (len(a_cuts) - 1)
        a_size, b_size = len(self.a_bytes), len(self.b_bytes)
        sign_b = 2 * a_size + b_size * b_last
        sign_b[b_cuts[1:][np.diff(b_cuts) > 0] - 1] = 2 * a_size + 2 * b_size
        a_stop, b_stop = np.flatnonzero(a_last) + 1, np.flatnonzero(b_last) + 1
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        coded = np.empty(len(a) + len(b), np.int64)
        coded[np.arange(len(a)) + np.append(0, b_stop)[a_group]] = a + a_size * a_last
        coded[np.arange(len(b)) + a_stop[b_group]] = b + sign_b
        joined, ends = _joined(self.texts, coded)
        bounds, raw = np.append(0, ends)[a_cuts + b_cuts].tolist(), memoryview(np.ascontiguousarray(joined))
        return [raw[i:j] for i, j in zip(bounds[:-1], bounds[1:])]


def _with_blanks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a blank before each."""
    return np.insert(data, offsets[:-1], 0x20), offsets + np.arange(len(offsets))


def _parts(data: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """Stretches of one text that both tokenizers encode apart: each begins with a blank after a visible ASCII character."""
    start = 0
    while start < len(data):
        stop = len(data)
        for begin in range(start + limit, len(data), limit):
            near = data[begin - 1 : begin + limit]
            cuts = np.flatnonzero((near[1:] == 0x20) & (near[:-1] > 0x20) & (near[:-1] < 0x7F))
            if len(cuts):
                stop = begin + int(cuts[0])
                break
        yield data[start:stop]
        start = stop


def _side_major(a: np.ndarray, b: np.ndarray, radixes: int) -> np.ndarray:
    """One number for a pair: by radix of the B id, then by B, then by A."""
    return (b % radixes) << 48 | b << 24 | a


def _spill(path_a: str, path_b: str, limit: int, radixes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def long_text(aligner, data):
        digest, sums, keys, links, good = hashlib.sha256(), np.zeros(3, np.int64), [], [], True
        for number, part in enumerate(_parts(data, limit)):
            fine, n_a, n_b, groups, texts, (_, a, b) = aligner.align(part, np.array([0, len(part)]))
            good &= bool(fine[0])
            digest.update(b";" * (number > 0))
            digest.update(texts[0])
            sums += [n_a[0], n_b[0], groups[0]]
            key, n = np.unique(_side_major(a, b, radixes), return_counts=True)
            keys.append(key)
            links.append(n)
        if not good:
            return np.zeros((3, 1), np.int64), [""], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        key, place = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(place, weights=np.concatenate(links), minlength=len(key)).astype(np.int64)
        return sums[:, None], [digest.hexdigest()], key, np.zeros(len(key), np.int64), n

    def short_texts(aligner, data, offsets):
        good, n_a, n_b, groups, texts, (owner, a, b) = aligner.align(data, offsets)
        digests = [hashlib.sha256(t).hexdigest() if g else "" for t, g in zip(texts, good.tolist())]
        key, place = np.unique(_side_major(a, b, radixes), return_inverse=True)
        record, n = np.unique(owner * max(len(key), 1) + place, return_counts=True)
        return np.stack([n_a, n_b, groups]), digests, key[record % max(len(key), 1)], record // max(len(key), 1), n

    def run(batches):
        aligner, part = Aligner(path_a, path_b), TaskContext.get().partitionId()
        for number, rows in enumerate(text_slices(batches, limit=limit)):
            data, offsets = text_buffer(rows.column(1))
            filled = np.flatnonzero(np.diff(offsets))
            data, offsets = _with_blanks(data, np.append(offsets[:-1][filled], len(data)))
            if len(filled) == 1 and len(data) > 2 * limit:
                sums, digests, key, owner, n = long_text(aligner, data)
            else:
                sums, digests, key, owner, n = short_texts(aligner, data, offsets)
            pairs, place = np.unique(key, return_inverse=True)
            links = np.bincount(place, weights=n, minlength=len(pairs)).astype(np.int64)
            texts = np.zeros((5, len(rows)), np.int64)
            texts[0], texts[1] = rows.column(0).fill_null(0).to_numpy(), rows.column(0).is_null().to_numpy(zero_copy_only=False)
            texts[2:, filled] = sums
            all_digests = np.full(len(rows), "", object)
            all_digests[filled] = digests
            name = part << 32 | number
            spilled = [(DOCS, pack(*texts), pack(filled[owner], place, n), all_digests.tolist())]
            cuts = np.searchsorted(pairs >> 48, np.arange(radixes + 1))
            spilled += [(r, pack(pairs[i:j], links[i:j]), None, None) for r, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if j > i]
            radix, ints, records, digests = zip(*spilled)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(radix), pa.int64()), pa.array(radix, pa.int32()), pa.array(ints, pa.binary()), pa.array(records, pa.binary()),
                 pa.array(digests, pa.list_(pa.string()))], ["slice", "radix", "ints", "records", "digests"])

    return run


def merged_runs(runs: Sequence[tuple[np.ndarray, np.ndarray]], block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct pairs in order with the sums of their counts, from sorted runs.

    A heap holds where each run's next block ends. Up to the least of these ends every run is known, so
    that much is taken from all of them and summed.
    """
    at = [0] * len(runs)
    end = lambda r: (int(runs[r][0][min(at[r] + block, len(runs[r][0])) - 1]), r)
    ends = [end(r) for r in range(len(runs)) if len(runs[r][0])]
    heapq.heapify(ends)
    while ends:
        limit, taken = ends[0][0], []
        for run, (pairs, counts) in enumerate(runs):
            stop = at[run] + int(np.searchsorted(pairs[at[run] : at[run] + block], limit, "right"))
            if stop > at[run]:
                taken.append((pairs[at[run] : stop], counts[at[run] : stop]))
                at[run] = stop
        while ends and ends[0][0] <= limit:
            run = heapq.heappop(ends)[1]
            if at[run] < len(runs[run][0]):
                heapq.heappush(ends, end(run))
        pairs, counts = (np.concatenate(x) for x in zip(*taken))
        order = np.argsort(pairs, kind="stable")
        starts = np.flatnonzero(np.diff(pairs[order], prepend=-1))
        yield pairs[order][starts], np.add.reduceat(counts[order], starts)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs (radix, batch, ints) of a (radix, batch) after each other: their pairs and sums."""

    def summed(radix, runs):
        for pairs, counts in merged_runs(runs):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), radix, np.int32)), pa.array(pairs), pa.array(counts)], ["radix", "pair", "n"])

    key, runs = None, []
    for radix, batch, ints in _rows(batches):
        if key != (radix, batch):
            if runs:
                yield from summed(key[0], runs)
            key, runs = (radix, batch), []
        runs.append(tuple(unpack(ints, 2)))
    if runs:
        yield from summed(key[0], runs)


def _count_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (radix, pair, n): one row for each radix with its pairs, counts, and whether a count is its B id's highest."""

    def table(radix, held):
        pairs, counts = (np.concatenate(x) for x in zip(*held))
        sides = np.flatnonzero(np.diff(pairs >> 24, prepend=-1))
        highest = np.repeat(np.maximum.reduceat(counts, sides), np.diff(np.append(sides, len(pairs))))
        return pa.RecordBatch.from_arrays([pa.array([radix], pa.int32()), pa.array([pack(pairs, counts, counts == highest)], pa.binary())], ["radix", "ints"])

    radix, held = None, []
    for batch in batches:
        radixes, pairs, counts = (c.to_numpy() for c in batch.columns)
        starts = np.flatnonzero(np.diff(radixes, prepend=-1))
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(radixes)]):
            if held and radix != radixes[i]:
                yield table(radix, held)
                held = []
            radix = int(radixes[i])
            held.append((pairs[i:j], counts[i:j]))
    if held:
        yield table(radix, held)


def _counts_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (radix, batch, slice, ints), the counts before the runs: each run's counts, for its slice."""
    table = None
    for radix, _, name, ints in _rows(batches):
        if name == COUNTS:
            table = unpack(ints, 3)
            continue
        pairs, counts, best = table
        place = np.searchsorted(pairs, unpack(ints, 2)[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array([name], pa.int64()), pa.array([radix], pa.int32()), pa.array([pack(counts[place], best[place])], pa.binary()),
             pa.nulls(1, pa.binary()), pa.nulls(1, pa.list_(pa.string()))], ["slice", "radix", "ints", "records", "digests"])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a slice after each other, its documents first and then the counts of its runs by radix: the documents' rows."""

    def report(texts, records, digests, counts):
        ids, missing, n_a, n_b, groups = unpack(texts, 5)
        owner, pair, n = unpack(records, 3)
        every = np.concatenate([unpack(c, 2) for c in counts], axis=1) if counts else np.zeros((2, 0), np.int64)
        sums = np.zeros((2, len(ids)), np.int64)
        if len(owner):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            sums[:, owner[starts]] = np.add.reduceat(np.stack([n * every[1][pair], n * every[0][pair]]), starts, axis=1)
        columns = [pa.array(ids, mask=missing.astype(bool)), *map(pa.array, (n_a, n_b, groups, groups, *sums)), pa.array(digests, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    held, counts = None, []
    for _, radix, ints, records, digests in _rows(batches):
        if radix == DOCS:
            if held:
                yield report(*held, counts)
            held, counts = (ints, records, digests), []
        else:
            counts.append(ints)
    if held:
        yield report(*held, counts)


def alignment_report(docs: DataFrame, path_a: str, path_b: str, limit: int = SLICE, radixes: int = RADIXES, batch: int = BATCH) -> DataFrame:
    """Per document its tokens, groups and links, and how often the linked ids are linked in the corpus."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spilled = written(texts.mapInArrow(_spill(path_a, path_b, limit, radixes), SPILLED))
    slices = spilled.where(F.col("radix") == DOCS)
    batches = 1 + slices.count() // batch
    runs = spilled.where(F.col("radix") != DOCS).select("radix", F.pmod(F.xxhash64("slice"), F.lit(batches)).alias("batch"), "slice", "ints")
    met = runs.select("radix", "batch", "ints").repartition("radix", "batch").sortWithinPartitions("radix", "batch")
    sums = met.mapInArrow(_count_runs, "radix int, pair long, n long").groupBy("radix", "pair").agg(F.sum("n").alias("n"))
    tables = written(sums.repartition("radix").sortWithinPartitions("radix", "pair").mapInArrow(_count_tables, "radix int, ints binary"))
    every = tables.select(
        "radix", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batches - 1).cast("long"))).alias("batch"), F.lit(COUNTS).cast("long").alias("slice"), "ints")
    back = every.unionByName(runs).repartition("radix", "batch").sortWithinPartitions("radix", "batch", "slice").mapInArrow(_counts_of_runs, SPILLED)
    return slices.unionByName(back).repartition("slice").sortWithinPartitions("slice", "radix").mapInArrow(_documents, REPORT)
