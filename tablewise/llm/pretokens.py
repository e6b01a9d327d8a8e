"""Byte-level BPE of many texts at once: cut into pre-tokens with numpy, encode distinct ones.

The cut follows the public pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+|
?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. Every pre-token is encoded separately, so a distinct
pre-token is given to the tokenizer's library once and its ids are copied to its places.
"""

from __future__ import annotations

import base64
import json
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa

from tablewise.llm.common import binary_array

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Distinct pre-tokens whose ids are kept; the slower library gets the larger store.
RANK_ENTRIES, FILE_ENTRIES = 200_000, 700_000
#: Letters that may follow an apostrophe as a pre-token of its own.
SHORT_FORMS = ("s", "t", "m", "d", "re", "ve", "ll")


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    everything = "".join(map(chr, points))
    classes = np.full(0x110000, OTHER, np.uint8)
    places = np.array(points)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for match in regex.finditer(pattern, everything):
            classes[places[match.start() : match.end()]] = kind
    return classes


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    table = character_classes()
    kinds = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        value = data[lead].astype(np.int64)
        width = 2 + (value >= 0xE0) + (value >= 0xF0)
        point = value & np.array([0, 0, 0x1F, 0x0F, 0x07])[width]
        for step in (1, 2, 3):
            inside = step < width
            point[inside] = point[inside] << 6 | data[lead[inside] + step] & 0x3F
        found = table[np.minimum(point, 0x10FFFF)]
        for step in range(4):
            inside = step < width
            kinds[lead[inside] + step] = found[inside]
    return kinds


def pretoken_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in ``data``, whose texts begin at ``offsets[:-1]``."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kinds = byte_classes(data)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    run = first[:n].copy()
    run[1:] |= kinds[1:] != kinds[:-1]
    starts = run.copy()
    # A run after white space: its last white-space character begins a pre-token, and the run
    # itself only where that character isn't a blank.
    joined = np.flatnonzero(run & ~first[:n] & (kinds != SPACE))
    joined = joined[kinds[joined - 1] == SPACE]
    last = joined - 1
    while len(inner := np.flatnonzero(data[last] & 0xC0 == 0x80)):
        last[inner] -= 1
    starts[joined[data[joined - 1] == 0x20]] = False
    starts[last] = True
    quote = np.flatnonzero(run & (data == 0x27))
    if len(quote):
        _short_forms(data, kinds, first, run, starts, quote)
    return np.flatnonzero(starts)


def _short_forms(data, kinds, first, run, starts, quote) -> None:
    n = len(data)
    quote = quote[(quote + 1 < n) & ~((quote > 0) & ~first[quote] & (data[np.maximum(quote - 1, 0)] == 0x20))]
    quote = quote[run[quote + 1] & ~first[quote + 1] & (kinds[quote + 1] == LETTER)]
    for form in SHORT_FORMS:
        size, fits = len(form), np.ones(len(quote), bool)
        for step, letter in enumerate(form, 1):
            place = np.minimum(quote + step, n - 1)
            fits &= (quote + step < n) & (data[place] == ord(letter)) & ((step == 1) | ~first[place])
        found, quote = quote[fits], quote[~fits]
        starts[found + 1] = False
        after = found + 1 + size
        after = after[after < n]
        starts[after[(kinds[after] == LETTER) & ~first[after]]] = True


class Encoder:
    """Ids of whole texts from a function that encodes a list of distinct pre-tokens.

    What matches ``added`` is a piece of its own, and texts are pre-tokenised only between such pieces.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], entries: int, added: re.Pattern[bytes] | None = None) -> None:
        self.encode_pieces, self.entries, self.added = encode, entries, added
        self.cache: dict[bytes, bytes] = {}

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (little-endian unsigned 32-bit) and the offsets of each text in them."""
        spans = self._added_spans(data, offsets) if self.added else []
        if not spans:
            return self.piece_ids(data, pretoken_starts(data, offsets), offsets)
        begin, end = np.array(spans, np.int64).T
        starts = pretoken_starts(data, np.concatenate([offsets, begin, end]))
        last = np.searchsorted(begin, starts, "right") - 1
        inside = (last >= 0) & (starts > begin[last]) & (starts < end[last])
        return self.piece_ids(data, starts[~inside], offsets)

    def _added_spans(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        raw = np.ascontiguousarray(data)
        return [m.span() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()) if b > a for m in self.added.finditer(raw, a, b)]

    def piece_ids(self, data: np.ndarray, starts: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        return self.encoded(binary_array(data, np.append(starts, len(data))), np.searchsorted(starts, offsets))

    def encoded(self, pieces: pa.Array, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and where the ids begin of the pieces that ``firsts`` names."""
        if not len(pieces):
            return np.zeros(0, "<u4"), np.zeros(len(firsts), np.int64)
        pieces = pieces.dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        cache = self.cache
        if len(cache) > self.entries:
            cache.clear()
        unknown = [p for p in distinct if p not in cache]
        for piece, ids in zip(unknown, self.encode_pieces(unknown) if unknown else ()):
            cache[piece] = array("I", ids).tobytes()
        coded = [cache[p] for p in distinct]
        bounds = np.zeros(len(coded) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)), out=bounds[1:])
        table = binary_array(np.frombuffer(b"".join(coded), np.uint8), bounds)
        placed = table.take(pieces.indices)
        _, cuts, raw = placed.buffers()
        ends = np.frombuffer(cuts, np.int64)[placed.offset : placed.offset + len(placed) + 1] // 4
        return np.frombuffer(raw, "<u4")[ends[0] : ends[-1]], (ends - ends[0])[firsts]


@lru_cache(maxsize=4)
def rank_table(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a public rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def rank_encoder(path: str, pattern: str) -> Encoder:
    """Encodes by the ranks of a file, with tiktoken."""
    import tiktoken

    library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=rank_table(path), special_tokens={})
    return Encoder(lambda pieces: [library.encode_ordinary(p.decode()) for p in pieces], RANK_ENTRIES)


def added_pattern(path: str) -> re.Pattern[bytes] | None:
    """The added tokens of a tokenizer file as they occur in texts, the longest of those that begin together."""
    with open(path, encoding="utf-8") as file:
        tokens = [t for t in json.load(file).get("added_tokens") or [] if t["content"]]
    if any(t.get(flag) for t in tokens for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that depend on what is beside them are not supported")
    contents = sorted((t["content"].encode() for t in tokens), key=len, reverse=True)
    return re.compile(b"|".join(map(re.escape, contents))) if contents else None


@lru_cache(maxsize=4)
def file_encoder(path: str, added_tokens: bool = False, entries: int = FILE_ENTRIES) -> Encoder:
    """Encodes by a tokenizer file, with the tokenizers library; the file's added tokens get their own ids or are plain text."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = not added_tokens

    def encode(pieces: list[bytes]) -> list[list[int]]:
        found = library.encode([p.decode() for p in pieces], is_pretokenized=True, add_special_tokens=False)
        ids, cuts = found.ids, np.zeros(len(pieces) + 1, np.int64)
        np.cumsum(np.bincount(np.array(found.word_ids, np.int64), minlength=len(pieces)), out=cuts[1:])
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    return Encoder(encode, entries, added_pattern(path) if added_tokens else None)


@lru_cache(maxsize=4)
def token_bytes(path: str) -> pa.Array:
    """The bytes of every rank, in order."""
    ranks = rank_table(path)
    ordered: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        ordered[rank] = token
    return pa.array(ordered, pa.large_binary())


def decode(path: str, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Raw bytes of the ids, concatenated, and where each text begins in them."""
    placed = token_bytes(path).take(pa.array(ids.astype(np.int64)))
    _, cuts, raw = placed.buffers()
    if not len(ids):
        return np.zeros(0, np.uint8), np.zeros(len(offsets), np.int64)
    ends = np.frombuffer(cuts, np.int64)[placed.offset : placed.offset + len(placed) + 1]
    return np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]], (ends - ends[0])[offsets]
