"""Characters in the matching blocks of many pairs of texts at once.

The longest common block of two texts counts, and those found likewise on both of its sides; of equally long blocks the first on the
left and then the first on the right. For each size of ``GRAMS``, the runs of equal characters that are at least so long are
listed once for each stretch (a piece of a text and a piece of the other). All stretches that are still open take their
longest run at once, and what is left of the other runs belongs to one of its sides. Stretches without such a run are
searched for shorter ones, which are many only where the stretches have become small.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Least sizes of the runs that are listed, one after the other.
GRAMS = (4, 2, 1)
#: Characters, and products of two lengths, of the pairs that are taken together; a larger pair is taken alone.
PART_CHARACTERS, PART_AREA = 1 << 20, 1 << 28
#: Equal pieces that are looked at side by side.
PART_CELLS = 1 << 21


def _characters(texts: Sequence[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


def _numbered(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Characters as numbers from 1 on, and the bits that they take."""
    used = np.zeros(int(max(left.max(initial=0), right.max(initial=0))) + 1, bool)
    used[left] = used[right] = True
    numbers = np.cumsum(used)
    return numbers[left], numbers[right], int(numbers[-1]).bit_length()


def _grams(characters: np.ndarray, size: int, bits: int) -> np.ndarray:
    """The number of the piece that begins at each place; the last ones are never asked for."""
    found = np.zeros(len(characters), np.int64)
    for i in range(size):
        found = found << bits
        found[: len(found) - i] |= characters[i:]
    return found


def _spans(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the span and place of all places of spans."""
    which = np.repeat(np.arange(len(first)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count - first, count)


def _runs(left: np.ndarray, right: np.ndarray, bits: int, stretches: np.ndarray, size: int) -> np.ndarray:
    """(stretch, i, j, length) of all runs of ``size`` equal characters or more, in rows, none longer on either side."""
    a, a_end, b, b_end = stretches
    count, other_count = np.maximum(a_end - a - size + 1, 0), np.maximum(b_end - b - size + 1, 0)
    count, other_count = np.where(other_count > 0, count, 0), np.where(count > 0, other_count, 0)
    which, places = _spans(a, count)
    other_which, other_places = _spans(b, other_count)
    if not len(places):
        return np.zeros((4, 0), np.int64)
    shift = np.int64(size * bits)
    keys = (which << shift) | _grams(left, size, bits)[places]
    others = (other_which << shift) | _grams(right, size, bits)[other_places]
    order = np.argsort(others)
    others = others[order]
    changes = np.append(True, others[1:] != others[:-1])
    first = np.flatnonzero(changes)
    found = np.searchsorted(others[first], keys)
    hit = np.flatnonzero(others[first][np.minimum(found, len(first) - 1)] == keys)
    found, which, places = found[hit], which[hit], places[hit]
    first, times = first[found], np.diff(np.append(first, len(others)))[found]
    parts = []
    ends = np.cumsum(times)
    start = 0
    while start < len(times):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] - times[start] + PART_CELLS, "right")))
        one, place = _spans(first[start:stop], times[start:stop])
        stretch, i, j = which[start:stop][one], places[start:stop][one], other_places[order[place]]
        goes_on = (i > a[stretch]) & (j > b[stretch]) & (left[i - 1] == right[j - 1])
        parts.append(np.stack([stretch, i, j])[:, ~goes_on])
        start = stop
    stretch, i, j = np.concatenate(parts, 1) if parts else np.zeros((3, 0), np.int64)
    length, open_ = np.full(len(i), size), np.arange(len(i))
    while len(open_):
        x, y = i[open_] + length[open_], j[open_] + length[open_]
        inside = (x < a_end[stretch[open_]]) & (y < b_end[stretch[open_]])
        open_, x, y = open_[inside], x[inside], y[inside]
        open_ = open_[left[x] == right[y]]
        length[open_] += 1
    return np.stack([stretch, i, j, length])


def _taken(runs: np.ndarray, stretches: np.ndarray, pairs: np.ndarray, matched: np.ndarray, size: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Adds the blocks of ``size`` or more to ``matched``; the stretches without one and their pairs."""
    rest, rest_pairs = [], []
    while len(pairs):
        stretch, i, j, length = runs
        best = np.zeros(len(pairs), np.int64)
        np.maximum.at(best, stretch, length)
        without = best == 0
        rest.append(stretches[:, without])
        rest_pairs.append(pairs[without])
        longest = np.flatnonzero(length == best[stretch])
        place = np.full(len(pairs), np.iinfo(np.int64).max)
        np.minimum.at(place, stretch[longest], (i[longest] << 31) | j[longest])
        live = np.flatnonzero(~without)
        (a, a_end, b, b_end), size_of, place = stretches[:, live], best[live], place[live]
        x, y = place >> 31, place & ((1 << 31) - 1)
        np.add.at(matched, pairs[live], size_of)
        stretches = np.concatenate([np.stack([a, x, b, y]), np.stack([x + size_of, a_end, y + size_of, b_end])], 1)
        pairs = np.tile(pairs[live], 2)
        number = np.cumsum(~without) - 1
        own = number[stretch]
        # No run is longer than the block, so that it reaches to one side of it at most.
        before = np.minimum(length, np.minimum(x[own] - i, y[own] - j))
        cut = np.maximum(0, np.maximum((x + size_of)[own] - i, (y + size_of)[own] - j))
        on_left, on_right = np.flatnonzero(before >= size), np.flatnonzero(length - cut >= size)
        runs = np.concatenate([
            np.stack([own[on_left], i[on_left], j[on_left], before[on_left]]),
            np.stack([own[on_right] + len(live), i[on_right] + cut[on_right], j[on_right] + cut[on_right], (length - cut)[on_right]])], 1)
    return rest, rest_pairs


def _matched(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    matched = np.zeros(len(left), np.int64)
    a, b, bits = _numbered(_characters(left), _characters(right))
    ends, other_ends = (np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))) for texts in (left, right))
    stretches, pairs = np.stack([np.append(0, ends[:-1]), ends, np.append(0, other_ends[:-1]), other_ends]), np.arange(len(left))
    for size in GRAMS:
        filled = (stretches[0] < stretches[1]) & (stretches[2] < stretches[3])
        stretches, pairs = stretches[:, filled], pairs[filled]
        # Pieces of many characters out of a large alphabet would not fit in a number.
        if size > 1 and size * bits + len(pairs).bit_length() > 62:
            continue
        rest, rest_pairs = _taken(_runs(a, b, bits, stretches, size), stretches, pairs, matched, size)
        if not rest:
            break
        stretches, pairs = np.concatenate(rest, 1), np.concatenate(rest_pairs)
    return matched


def matched_characters(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """How many characters of each pair of texts are in matching blocks."""
    lengths = np.array([[len(x) for x in left], [len(y) for y in right]], np.int64).reshape(2, -1)
    characters, area, found, start = lengths.sum(0).tolist(), lengths.prod(0).tolist(), [], 0
    while start < len(left):
        stop, size, product = start, 0, 0
        while stop < len(left) and (stop == start or size + characters[stop] <= PART_CHARACTERS and product + area[stop] <= PART_AREA):
            size, product, stop = size + characters[stop], product + area[stop], stop + 1
        found.append(_matched(left[start:stop], right[start:stop]))
        start = stop
    return np.concatenate(found) if found else np.zeros(0, np.int64)
