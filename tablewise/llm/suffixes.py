"""Numpy parts of the suffix-array operator: prefix hashes, anchors and the hash-compared sort."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
#: Places that fit beside a gram's hash: stretches of under 16 MB are looked at at once.
PLACE_BITS = 24


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64; made anew each time, since a kept table fills idle workers."""
    inverse = pow(BASE, -1, 1 << 64)
    tables = []
    for factor in (BASE, inverse):
        table = np.ones(size, np.uint64)
        filled = 1
        while filled < size:
            step = min(filled, size - filled)
            table[filled : filled + step] = table[:step] * np.uint64(pow(factor, filled, 1 << 64))
            filled += step
        tables.append(table)
    return tables[0], tables[1]


class PrefixHash:
    """Polynomial hashes of any substring of ``data`` from prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = data
        size = 1 << max(10, int(len(data)).bit_length())
        powers, self.inverse = _powers(size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]

    def all_of(self, length: int) -> np.ndarray:
        n = len(self.data) - length + 1
        return (self.sums[length:] - self.sums[:n]) * self.inverse[:n]

    def common(self, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``a`` and ``b``, up to ``depth``."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), depth, np.int64)
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_] + 1) >> 1
            equal = self.of(a[open_], middle) == self.of(b[open_], middle)
            low[open_[equal]] = middle[equal]
            high[open_[~equal]] = middle[~equal] - 1
        return low


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(29))


def anchors(hashes: PrefixHash, ends: np.ndarray, starts: np.ndarray, length: int, gram: int):
    """Anchor of every run of windows: (place, first window, last window, hash of the anchor's gram).

    A window is a substring of ``length`` bytes inside one text. Its anchor is the place of the
    smallest gram hash in it (the leftmost, of equal ones), which depends on its bytes alone, so
    that equal windows have equal anchors at equal offsets.
    """
    n, none = len(hashes.data), np.zeros(0, np.int64)
    if n >> PLACE_BITS:
        raise ValueError("too many bytes at once")
    if n < length:
        return none, none, none, np.zeros(0, np.uint64)
    grams = mixed(hashes.all_of(gram))
    bits = np.uint64(PLACE_BITS)  # the same for all inputs: it says which bits of a hash count
    key = (grams << bits) | np.arange(len(grams), dtype=np.uint64)
    width, reach = length - gram + 1, 1
    while 2 * reach <= width:
        key = np.minimum(key[:-reach], key[reach:])
        reach *= 2
    if width > reach:
        key = np.minimum(key[: len(key) - (width - reach)], key[width - reach :])
    place = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    inside = np.zeros(n + 1, np.int64)
    whole = ends - starts >= length
    np.add.at(inside, starts[whole], 1)
    np.add.at(inside, ends[whole] - length + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside)[: len(place)] > 0)
    if not len(windows):
        return none, none, none, np.zeros(0, np.uint64)
    place = place[windows]
    fresh = np.ones(len(windows), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(windows)) - 1
    return place[first], windows[first], windows[last], grams[place[first]]


def hash_sort(hashes: PrefixHash, places: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``places`` by their first ``depth`` bytes (then as given), and which equal the one before.

    Suffixes are grouped by their first eight bytes; inside the groups, a bottom-up mergesort
    compares two suffixes by the hash-found length of their common prefix and the next byte.
    Suffixes that hash as equal are compared byte by byte; if any differ, the sort is
    done again on the bytes themselves.
    """
    n = len(places)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    head = np.zeros(n, np.uint64)
    for step in range(min(8, depth)):
        head = head << np.uint64(8) | hashes.data[places + step]
    order = np.argsort(head, kind="stable")
    new = np.ones(n, bool)
    new[1:] = head[order][1:] != head[order][:-1]
    group_start = np.flatnonzero(new)
    group_size = np.diff(np.append(group_start, n))
    run, largest = 1, int(group_size.max())
    while run < largest:
        order = _merge_runs(hashes, places, order, group_start, group_size, run, depth)
        run *= 2
    same = np.zeros(n, bool)
    left, right = places[order[:-1]], places[order[1:]]
    same[1:] = ~new[1:] & (hashes.common(left, right, depth) >= depth)
    if not _equal_bytes(hashes.data, places[order], same, depth):
        return _byte_sort(hashes.data, places, depth)
    return order, same


def _merge_runs(hashes, places, order, group_start, group_size, run, depth):
    """One level of the mergesort in all groups at once: each suffix finds its rank in the run beside its own."""
    busy = group_size > run
    starts, sizes = group_start[busy], group_size[busy]
    at = np.repeat(starts - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
    base = np.repeat(starts, sizes)
    limit = base + np.repeat(sizes, sizes)
    within = at - base
    right = (within // run) % 2 == 1
    pair = base + within // (2 * run) * (2 * run)
    low = np.where(right, pair, np.minimum(pair + run, limit))
    high = np.where(right, pair + run, np.minimum(pair + 2 * run, limit))
    begin, own = low.copy(), order[at]
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_]) >> 1
        a, b = places[order[middle]], places[own[open_]]
        common = hashes.common(a, b, depth)
        spot = np.minimum(common, depth - 1)
        before = np.where(common >= depth, right[open_], hashes.data[a + spot] < hashes.data[b + spot])
        low[open_[before]] = middle[before] + 1
        high[open_[~before]] = middle[~before]
    merged = order.copy()
    merged[np.where(right, at - run, at) + (low - begin)] = own
    return merged


def _equal_bytes(data: np.ndarray, ordered: np.ndarray, same: np.ndarray, depth: int) -> bool:
    pairs = np.flatnonzero(same)
    for part in range(0, len(pairs), 1 << 15):
        chosen = pairs[part : part + (1 << 15), None]
        if not np.array_equal(data[ordered[chosen[:, 0], None] + np.arange(depth)], data[ordered[chosen[:, 0] - 1, None] + np.arange(depth)]):
            return False
    return True


def _byte_sort(data: np.ndarray, places: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    raw = data.tobytes()
    texts = [raw[p : p + depth] for p in places.tolist()]
    order = np.array(sorted(range(len(texts)), key=texts.__getitem__), np.int64)
    same = np.array([i > 0 and texts[order[i]] == texts[order[i - 1]] for i in range(len(order))], bool)
    return order, same


def merged_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of covered bytes."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.ones(len(starts), bool)
    fresh[1:] = starts[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    return starts[first], reach[np.append(first[1:], len(starts)) - 1]
