"""Byte-level BPE encoding of whole texts and decoding back to bytes.

Texts up to ``chunk_bytes`` are encoded where they are read. Longer ones are cut into chunks
that overlap; the chunks are pre-tokenised by any tasks, neighbours are stitched at the first
boundary in their overlap that both have (from there on both cuts agree, since a match looks
only ahead), each chunk's own pieces are encoded, and the pieces' ids are put together. A text
in which neighbours share no boundary in an overlap is encoded whole.

Null and empty texts have no ids: zero tokens and the digests of nothing. Repeated rows are
encoded one by one, and columns beside ``doc_id`` and ``text`` aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import text_buffer, text_slices, written
from tablewise.llm.pretokens import decode, pretoken_starts, rank_encoder

CHUNK_BYTES = 64 * 1024
OVERLAP_BYTES = 4 * 1024
SLICE = 4 * 1024 * 1024
#: A cut this close to a chunk's end may depend on what follows.
UNSURE_BYTES = 16
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@lru_cache(maxsize=1)
def _decimal(size: int) -> pa.Array:
    return pa.array([f"{i},".encode() for i in range(size)], pa.large_binary())


def digests(path: str, ids: np.ndarray, offsets: np.ndarray) -> list[tuple[int, str, str]]:
    """Per text: the number of ids, the digest of the ids in decimal, the digest of the decoded bytes."""
    raw, cuts = decode(path, ids, offsets)
    size = 1 << int(ids.max()).bit_length() if len(ids) else 1
    placed = _decimal(max(size, 65536)).take(pa.array(ids.astype(np.int64)))
    _, ends, decimal = placed.buffers()
    ends = np.frombuffer(ends, np.int64)[placed.offset : placed.offset + len(placed) + 1] if len(ids) else np.zeros(1, np.int64)
    decimal = memoryview(decimal) if decimal is not None else memoryview(b"")
    rows, view = [], memoryview(np.ascontiguousarray(raw))
    for i in range(len(offsets) - 1):
        a, b = offsets[i], offsets[i + 1]
        listed = decimal[ends[a] : max(ends[b] - 1, ends[a])]
        rows.append((int(b - a), hashlib.sha256(listed).hexdigest(), hashlib.sha256(view[cuts[i] : cuts[i + 1]]).hexdigest()))
    return rows


def _encode_whole(path: str, pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        encoder = rank_encoder(path, pattern)
        for part in text_slices(batches, limit=SLICE):
            data, offsets = text_buffer(part.column(1))
            counts, ids, decoded = zip(*digests(path, *encoder.ids(data, offsets)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def _cut_chunks(chunk: int, overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks begin and end between characters."""

    def run(batches):
        for part in text_slices(batches):
            for uid, identity, text in zip(part.column(2).to_pylist(), part.column(0).to_pylist(), part.column(1).to_pylist()):
                data = text.encode()
                even = lambda at: next(p for p in range(min(at, len(data)), len(data) + 1) if p == len(data) or data[p] & 0xC0 != 0x80)
                begins = [even(at) for at in range(0, len(data), chunk)]
                for n, begin in enumerate(begins):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([uid], pa.int64()), pa.array([identity], pa.int64()), pa.array([n], pa.int64()), pa.array([begin], pa.int64()),
                         pa.array([n == len(begins) - 1]), pa.array([data[begin : even(begin + chunk + overlap)]], pa.binary())],
                        ["uid", "doc_id", "n", "begin", "last", "data"],
                    )

    return run


def _chunk_starts(data: bytes) -> np.ndarray:
    return pretoken_starts(np.frombuffer(data, np.uint8), np.array([0, len(data)]))


def _overlap_cuts(chunk: int, overlap: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The boundaries that a chunk shares with its neighbours, as places in the text."""

    def run(frames):
        for frame in frames:
            head, tail = [], []
            for begin, data, last in zip(frame["begin"], frame["data"], frame["last"]):
                starts = _chunk_starts(data)
                head.append((begin + starts[starts <= overlap + 4]).tolist())
                sure = starts[(starts >= chunk - 4) & (starts < len(data) - UNSURE_BYTES)]
                tail.append([] if last else (begin + sure).tolist())
            yield frame[["uid", "n", "begin", "last"]].assign(head=head, tail=tail)

    return run


def _stitch(frame: pd.DataFrame) -> pd.DataFrame:
    """Where each chunk's own part begins and ends; -1 where neighbours don't meet again."""
    frame = frame.sort_values("n").reset_index(drop=True)
    begins = [0]
    for i in range(len(frame) - 1):
        shared = np.intersect1d(frame["tail"][i], frame["head"][i + 1])
        shared = shared[shared >= begins[-1]] if len(shared) else shared
        begins.append(int(shared[0]) if len(shared) else -1)
        if begins[-1] < 0:
            return pd.DataFrame({"uid": frame["uid"], "n": frame["n"], "own_begin": -1, "own_end": -1})
    return pd.DataFrame({"uid": frame["uid"], "n": frame["n"], "own_begin": begins, "own_end": [*begins[1:], 2 ** 62]})


def _encode_own(path: str, pattern: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames):
        encoder = rank_encoder(path, pattern)
        for frame in frames:
            coded = []
            for begin, data, own_begin, own_end in zip(frame["begin"], frame["data"], frame["own_begin"], frame["own_end"]):
                if own_begin < 0:
                    coded.append(data)
                    continue
                starts = _chunk_starts(data)
                low, high = own_begin - begin, min(own_end - begin, len(data))
                own = starts[(starts >= low) & (starts < high)] - low
                piece = np.frombuffer(data, np.uint8)[low:high]
                coded.append(encoder.piece_ids(piece, own, np.array([0, len(piece)]))[0].tobytes())
            yield frame[["uid", "doc_id", "n", "begin", "own_begin"]].assign(coded=coded)

    return run


def _gather(path: str, pattern: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One text's pieces in order; a text that couldn't be stitched is encoded here."""

    def run(frame):
        frame = frame.sort_values("n")
        if frame["own_begin"].iloc[0] < 0:
            ends = [*frame["begin"].iloc[1:], 2 ** 62]
            data = np.frombuffer(b"".join(c[: e - b] for c, b, e in zip(frame["coded"], frame["begin"], ends)), np.uint8)
            ids = rank_encoder(path, pattern).ids(data, np.array([0, len(data)]))[0]
        else:
            ids = np.frombuffer(b"".join(frame["coded"]), "<u4")
        count, listed, decoded = digests(path, ids, np.array([0, len(ids)]))[0]
        return pd.DataFrame({"doc_id": [frame["doc_id"].iloc[0]], "n_tokens": [count], "ids_sha256": [listed], "decoded_sha256": [decoded]}).astype({"doc_id": "Int64"})

    return run


def encode_and_decode(docs: DataFrame, path: str, pattern: str, chunk_bytes: int = CHUNK_BYTES, overlap_bytes: int = OVERLAP_BYTES) -> DataFrame:
    """Per document the number of ids and the digests of the ids and of the decoded bytes."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    long_text = F.coalesce(F.octet_length("text") > chunk_bytes, F.lit(False))
    short = texts.where(~long_text).mapInArrow(_encode_whole(path, pattern), RESULT)
    named = texts.where(long_text).withColumn("uid", F.monotonically_increasing_id())
    chunks = written(named.mapInArrow(
        _cut_chunks(chunk_bytes, overlap_bytes), "uid long, doc_id long, n long, begin long, last boolean, data binary"))
    cuts = (
        chunks.mapInPandas(_overlap_cuts(chunk_bytes, overlap_bytes), "uid long, n long, begin long, last boolean, head array<long>, tail array<long>")
        .groupBy("uid").applyInPandas(_stitch, "uid long, n long, own_begin long, own_end long")
    )
    pieces = chunks.join(cuts, ["uid", "n"]).mapInPandas(
        _encode_own(path, pattern), "uid long, doc_id long, n long, begin long, own_begin long, coded binary")
    return short.unionByName(pieces.groupBy("uid").applyInPandas(_gather(path, pattern), RESULT))
